"""Linear models that are trained on bounded samples."""

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 100) -> np.ndarray:
    """Weights and, last, bias of a linear SVM with squared hinge, by accelerated gradients.

    ``y`` holds 1 and -1. The two classes weigh the same in sum, however many rows each has.
    """
    x = np.hstack([x.astype(np.float32, copy=False), np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    share = share.astype(np.float32)
    # the curvature is at most 1 + 2 cost times the largest squared row norm
    pace = np.float32(1.0 / (1.0 + 2 * cost * float((x**2).sum(axis=1).max(initial=1.0))))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead))
        new = ahead - pace * (ahead - np.float32(2 * cost) * ((share * slack * y) @ x))
        ahead = new + np.float32(step / (step + 3)) * (new - w)
        w = new
    return w


def fit_logistic(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn margins into chances, towards smoothed targets.

    The classes weigh as the square roots of their sizes in sum: between as they come and
    equally, so that a rare class is neither lost nor seen everywhere.
    """
    n, p = len(label), int(label.sum())
    share = 1 / np.sqrt(np.where(label == 1, max(p, 1), max(n - p, 1)) / n)
    target = np.where(label == 1, (p + 1) / (p + 2), 1 / (n - p + 2))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        weight = share * chance * (1 - chance) + 1e-6
        off = share * (target - chance)
        a, b, c = (weight * margin**2).sum() + 1e-3, (weight * margin).sum(), weight.sum() + 1e-6
        g, h = (off * margin).sum() - 1e-3 * slope, off.sum()
        det = a * c - b * b
        if det <= 1e-12:
            break
        slope += float(np.clip((c * g - b * h) / det, -2, 2))
        shift += float(np.clip((a * h - b * g) / det, -2, 2))
    return float(slope), float(shift)


def fit_small_svm(x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 40) -> np.ndarray:
    """The same by Newton steps on the rows inside the margin, for few columns."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, inside = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        near, weight = x[inside], 2 * cost * share[inside]
        w = np.linalg.solve(ridge + (near.T * weight) @ near, near.T @ (weight * y[inside]))
    return w
