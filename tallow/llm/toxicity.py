"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

*Kernel.* Two units (a word, or letters standing alone in a row such as ``i d i o t``) are
compared by the subsequences of three letters they share, their two edges counting as letters. Between two letters of one up to
``GAP - 1`` other characters may stand; each step weighs ``DECAY`` less. So gaps and inserted
characters lower the kernel, and do not break it. It is normalised, and values below
``FLOOR`` count as zero. A unit is read whole and, where it holds at least ``HOLD`` of a landmark's
own subsequences within its edges, also in windows about as long as that landmark and in the parts
between its marks; runs of single letters between marks are read in windows of a landmark's
spelled-out length: what is glued into a longer unit counts as if it stood alone. Units of more
than ``_LONG`` characters hold nearly everything; they are read in windows and parts only.

*Nyström.* Landmarks are units that stand out in toxic texts of the training sample. With K
the kernel between landmarks and k that of a unit with each of them, K^-1/2 k is the unit's
vector. A sentence takes the largest kernel of its units with each landmark.

*SVM.* Labels are of documents, sentences inherit them: all sentences of a clean document
are negative; of a toxic one those are positive that the current model takes for toxic, or
the one it likes best, in four rounds. Broken spellings of sure landmarks are positive too. A document scores as its most toxic sentence, as a chance.

Scoring reads whole texts. A unit's vector depends on the unit alone, so a task computes each
distinct one once; a bound on the kernel (a square norm is at least the sum of squared terms)
spares nearly all of them the exact norm.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.linear import fit_logistic, fit_small_svm
from tallow.llm.tables import fold, slices, smallest_by_hash

SAMPLE = 2500  # labelled rows of each class that are learned from
LANDMARKS = 64
SENTENCES = 8  # of a document of the sample, those with the largest kernels
LENGTHS = (3, 40)  # characters of a unit that may become a landmark
GAP = 3
DECAY = 0.6
FLOOR = 0.4
HOLD = 0.6
COST = 1000.0
SURE = 2.5  # standard errors by which a landmark must be more frequent in toxic texts
_SEED = 2
_PAD = 2 * GAP
_BREAK = "\0" * _PAD  # keeps subsequences within a unit
_LONG, _STEP = 40, 20  # units longer than this are read in overlapping windows
_MARKS = re.compile(r"[\W_]+")
_DOTTED = re.compile(r"[^\W_](?:[\W_][^\W_]){2,}")
_CACHE = 200_000
_BLOCK = 10_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_STEPS = [(a, b) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]
_EDGE = "\x01"
_EDGE_LETTER = 63
_ALONE, _NOTHING = -2, -1


def unit_of(word: str) -> str:
    return word.strip(_EDGES).lower()


def _letter(character: str) -> int:
    """1 to 62 for letters and digits, 63 for a unit's edge; 0 for what can only be a gap."""
    if "a" <= character <= "z":
        return ord(character) - 96
    if character == _EDGE:
        return _EDGE_LETTER
    return 27 + ord(character) % 36 if character.isalnum() else 0


def _terms(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence, weight) for every occurrence of three letters within the gaps."""
    marked = "".join(f"{_EDGE}{u}{_EDGE}{_BREAK}" for u in units)
    codes = np.frombuffer(marked.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    owner = np.repeat(np.arange(len(units)), lengths + 2 + _PAD)
    small = np.minimum(codes, 0xFFFF)
    letters = _LETTERS[small].astype(np.int32)
    found = []
    for a, b in _STEPS:
        n = len(letters) - a - b
        if n <= 0:
            continue
        x, y, z = letters[:n], letters[a : a + n], letters[a + b :]
        at = np.flatnonzero((x != 0) & (y != 0) & (z != 0))
        code = (x[at] << 12) | (y[at] << 6) | z[at]
        found.append((owner[at], code, np.full(len(at), DECAY ** (a + b), np.float32)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


_LETTERS = np.array([_letter(chr(c)) for c in range(0x10000)], np.uint8)


def _merged(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_terms`` with equal subsequences of a unit added up, and the units' norms."""
    owner, code, weight = _terms(units)
    key, place = np.unique(owner * (1 << 18) + code, return_inverse=True)
    value = np.bincount(place, weight, len(key))
    owner, code = key >> 18, key & ((1 << 18) - 1)
    return owner, code, value, np.sqrt(np.bincount(owner, value**2, len(units)))


class Landmarks:
    """Kernels of units with a fixed list of landmark units."""

    def __init__(self, units: list[str]):
        self.units = units
        owner, code, value, norm = _merged(units)
        value = value / np.where(norm > 0, norm, 1)[owner]
        codes, row = np.unique(code, return_inverse=True)
        self.row = np.full(1 << 18, len(codes), np.int32)  # the last row is empty
        self.row[codes] = np.arange(len(codes))
        # by row, the landmarks with this subsequence, and its values with and without edges
        order = np.argsort(row, kind="stable")
        inner = (code >> 12 != _EDGE_LETTER) & (code & 63 != _EDGE_LETTER)
        self.owner, self.value = owner[order], value[order]
        self.inner = (value * inner)[order]
        self.count = np.bincount(row, minlength=len(codes) + 1)
        self.start = np.cumsum(self.count) - self.count
        own = np.arange(len(units))
        itself = self._products(*_terms(units), len(units))[1][own, own]
        self.enough = np.where(itself > 0, HOLD * itself, np.inf)

    def _products(self, owner, code, weight, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of units with landmarks before the units' norm, all and without edges."""
        row = self.row[code]
        some = np.flatnonzero(self.count[row])
        times = self.count[row[some]]
        at = np.repeat(self.start[row[some]] - (np.cumsum(times) - times), times)
        at += np.arange(len(at))
        key = np.repeat(owner[some], times) * len(self.units) + self.owner[at]
        weight, size = np.repeat(weight[some], times), n * len(self.units)
        sums = (np.bincount(key, weight * part[at], size) for part in (self.value, self.inner))
        return tuple(x.reshape(n, len(self.units)) for x in sums)

    def read(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kernels, a row for each unit with zero for what is below the floor; and as places in
        both lists, (unit, landmark) for every landmark that a unit holds."""
        out = np.zeros((len(units), len(self.units)), np.float32)
        holders, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(units), _BLOCK):
            part = units[at : at + _BLOCK]
            owner, code, weight = _terms(part)
            products, inner = self._products(owner, code, weight, len(part))
            least = np.sqrt(np.bincount(owner, weight**2, len(part)))
            bound = FLOOR * 0.999 * np.where(least > 0, least, np.inf)
            close = np.flatnonzero((products >= bound[:, None]).any(axis=1))
            if len(close):
                norm = _merged([part[i] for i in close])[3]
                kernels = products[close] / norm[:, None]
                out[at + close] = np.where(kernels >= FLOOR, kernels, 0)
            unit, landmark = np.nonzero(inner >= self.enough)
            holders.append(unit + at)
            held.append(landmark)
        return out, np.concatenate(holders), np.concatenate(held)

    def kernels(self, units: list[str]) -> np.ndarray:
        return self.read(units)[0]


class Reader:
    """Sentence vectors of texts, with a bounded memory of the units seen."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        # widths of windows: a landmark's length, plain, with one more character, and spelled out
        lengths = {len(u) for u in landmarks.units}
        self.narrow = sorted({w for n in lengths for w in (n, n + 1, 2 * n - 1) if w < _LONG})
        self.spelled = sorted({w for n in lengths for w in (2 * n - 1, 2 * n + 1)})
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _learn(self, words) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.codes]
        for at in range(0, len(new), _CACHE):
            part = new[at : at + _CACHE]
            units = [unit_of(w) for w in part]
            for word, unit, row in zip(part, units, self._kernels(units), strict=True):
                self.codes[word] = _ALONE if len(unit) == 1 and unit.isalnum() else self._keep(row)

    def _keep(self, row: np.ndarray | None) -> int:
        if row is None:
            return _NOTHING
        self.rows.append(row)
        return len(self.rows) - 1

    def _kernels(self, units: list[str]) -> list[np.ndarray | None]:
        short = [u if len(u) <= _LONG else "" for u in units]
        found, holders, held = self.landmarks.read(short)
        self._look_inside(short, found, zip(holders.tolist(), held.tolist(), strict=True))
        some = found.any(axis=1)
        rows = [found[i] if some[i] else None for i in range(len(units))]
        for i, u in enumerate(units):
            if len(u) > _LONG:
                best = self._windows(u, self.narrow)
                parts = [p for p in _MARKS.split(u) if 3 <= len(p) <= _LONG]
                best = np.maximum(best, self.landmarks.kernels(parts).max(axis=0, initial=0))
                rows[i] = best if best.any() else None
        return rows

    def _look_inside(self, units: list[str], found: np.ndarray, held) -> None:
        """Raise ``found`` to the kernels of windows and parts, for landmarks that units hold, and of
        letters spelled out with marks."""
        inside: dict[tuple[int, str], None] = {}
        for i, j in held:
            unit, n = units[i], len(self.landmarks.units[j])
            for width in (n, n + 1):
                inside.update(((i, unit[s : s + width]), None) for s in range(len(unit) - width + 1))
            inside.update(((i, part), None) for part in _MARKS.split(unit) if len(part) >= 3)
        for i, unit in enumerate(units):
            for run in _DOTTED.findall(unit):
                for width in self.spelled:
                    starts = range(0, max(1, len(run) - width + 1), 2)
                    inside.update(((i, run[s : s + width]), None) for s in starts)
        pieces = [(i, piece) for i, piece in inside if piece != units[i]]
        for at in range(0, len(pieces), _BLOCK):
            own = pieces[at : at + _BLOCK]
            place = {piece: n for n, piece in enumerate(dict.fromkeys(piece for _, piece in own))}
            rows = self.landmarks.kernels(list(place))
            near = rows.any(axis=1)
            hits = [(i, place[piece]) for i, piece in own if near[place[piece]]]
            if hits:
                unit, row = np.array(hits).T
                np.maximum.at(found, unit, rows[row])

    def _windows(self, unit: str, narrow: list[int], step: int = 1) -> np.ndarray:
        """Largest kernels over overlapping windows of a long unit, block by block.

        A wide window dilutes an insult, so ``narrow`` ones slide over the unit, too.
        """
        best = np.zeros(len(self.landmarks.units), np.float32)
        runs = [(_LONG, range(0, max(1, len(unit) - _STEP), _STEP))]
        runs += [(n, range(0, len(unit) - n + 1, step)) for n in narrow]
        for width, starts in runs:
            for at in range(0, len(starts), 1000):
                windows = list(dict.fromkeys(unit[s : s + width] for s in starts[at : at + 1000]))
                best = np.maximum(best, self.landmarks.kernels(windows).max(axis=0))
        return best

    def sentences(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the vectors of its sentences that are not all zero, as rows."""
        if len(self.codes) > _CACHE:
            self._forget()
        split = [(t or "").split() for t in texts]
        for words in split:
            self._learn(words)
        return [self._sentences(words) for words in split]

    def _sentences(self, words: list[str]) -> np.ndarray:
        width = len(self.landmarks.units)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        hits = np.flatnonzero(codes >= 0)
        rows = [(int(p), self.rows[codes[p]]) for p in hits]
        rows += self._spelled(words, codes == _ALONE)
        if not rows:
            return np.zeros((0, width), np.float32)
        ends = np.fromiter((w[-1] in ".!?" for w in words), np.int64, len(words))
        sentence = np.cumsum(ends) - ends
        best: dict[int, np.ndarray] = {}
        for place, row in rows:
            key = int(sentence[place])
            best[key] = np.maximum(best[key], row) if key in best else row
        return np.array([best[k] for k in sorted(best)], np.float32)

    def _spelled(self, words: list[str], alone: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Runs of three or more letters that stand alone, read as one unit with gaps."""
        edge = np.flatnonzero(np.diff(np.r_[False, alone, False].astype(np.int8)))
        found = []
        for start, end in zip(edge[::2], edge[1::2], strict=True):
            if end - start >= 3:
                row = self._windows(" ".join(unit_of(w) for w in words[start:end]), self.spelled, 2)
                if row.any():
                    found.append((int(start), row))
        return found


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    weights: np.ndarray  # on kernels with the landmarks: the SVM's, times K^-1/2
    bias: float
    slope: float
    shift: float

    def margins(self, sentences: np.ndarray) -> np.ndarray:
        return sentences @ self.weights + self.bias

    def score(self, sentences: np.ndarray) -> float:
        margin = max(self.bias, float(self.margins(sentences).max(initial=-np.inf)))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _labelled(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of the sample: of each class the ids with the smallest seeded hash.

    Ids of fold 0 and null labels are left out; an id labelled both ways counts as toxic.
    The drawn ids are at most twice ``sample``, so they may be broadcast.
    """
    marks = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(fold("doc_id", 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    drawn = smallest_by_hash(marks, "doc_id", sample, "toxic", _SEED)
    whole = documents.select("doc_id", F.col("text").cast("string")).where("text is not null")
    rows = whole.join(F.broadcast(drawn), "doc_id")
    # an id may be repeated without end: one text of it is enough
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _unit_batches(shortest: int, longest: int):
    def read(batches):
        for batch in batches:
            for start, texts in slices(batch, "text"):
                toxic = batch.column("toxic").slice(start, len(texts)).to_pylist()
                rows = [
                    (u, t)
                    for text, t in zip(texts, toxic, strict=True)
                    for u in {unit_of(w) for w in text.split()}
                    if shortest <= len(u) <= longest
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u for u, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.int32())],
                    ["unit", "toxic"],
                )

    return read


def _telling_units(sample: DataFrame, lengths: tuple[int, int], most: int = 500) -> list[str]:
    """Units that are far more frequent in toxic texts, the surest first."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if 1 not in sizes or 0 not in sizes:
        return []
    units = sample.mapInArrow(_unit_batches(*lengths), "unit string, toxic int")
    p, q = F.sum("toxic") / sizes[1], F.sum(1 - F.col("toxic")) / sizes[0]
    counted = units.groupBy("unit").agg(F.sum("toxic").alias("n"), p.alias("p"), q.alias("q"))
    noise = F.sqrt(F.col("p") / sizes[1] + F.col("q") / sizes[0])
    ranked = (
        counted.where("n >= 2 and p >= 5 * q")
        .withColumn("z", F.round((F.col("p") - F.col("q")) / noise, 9))
        .where(F.col("z") >= SURE)
        .orderBy(F.desc("z"), "unit")
        .limit(most)
    )
    return [r["unit"] for r in ranked.collect()]


def _spread(units: list[str], most: int) -> list[str]:
    """The first units in order that are not nearly the same as one before."""
    chosen: list[str] = []
    kernels = Landmarks(units).kernels(units) if units else np.zeros((0, 0))
    places: list[int] = []
    for i, unit in enumerate(units):
        if kernels[i, i] > 0 and (not places or kernels[i, places].max() < 0.75):
            chosen.append(unit)
            places.append(i)
        if len(chosen) == most:
            break
    return chosen


def _sentence_batches(landmarks: Landmarks, most: int):
    def read(batches):
        reader = Reader(landmarks)
        for batch in batches:
            for start, texts in slices(batch, "text"):
                toxic = batch.column("toxic").slice(start, len(texts)).to_pylist()
                rows = []
                for label, found in zip(toxic, reader.sentences(texts), strict=True):
                    order = np.argsort(-found.sum(axis=1), kind="stable")[:most]
                    rows.append({"toxic": label, "x": found[order].tobytes()})
                yield pa.RecordBatch.from_pylist(
                    rows, pa.schema([("toxic", pa.int32()), ("x", pa.binary())])
                )

    return read


def fit(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    sentences: int = SENTENCES,
    lengths: tuple[int, int] = LENGTHS,
) -> ToxicityModel | None:
    """Learn from a bounded sample of labelled documents; None if a class is missing.

    The bounds: ``sample`` documents of each class; of a document the ``sentences`` sentences with
    the largest kernels; ``LANDMARKS`` landmarks, of units with a number of characters in
    ``lengths``. Scoring has none of them.
    """
    drawn = _labelled(documents, labels.withColumn("toxic", F.col("toxic").cast("int")), sample)
    units = _spread(_telling_units(drawn, lengths), LANDMARKS)
    if not units:
        return None
    landmarks = Landmarks(units)
    rows = drawn.mapInArrow(_sentence_batches(landmarks, sentences), "toxic int, x binary").toPandas()
    rows = rows.sort_values(["toxic", "x"], ignore_index=True)
    texts = [np.frombuffer(b, np.float32).reshape(-1, len(units)) for b in rows["x"]]
    return train(landmarks, texts, rows["toxic"].to_numpy())


def _spellings(units: list[str], sure: np.ndarray) -> list[str]:
    """Spaced and broken spellings of the landmarks that are toxic beyond doubt."""
    cuts = [(u, c) for u, s in zip(units, sure, strict=True) if s for c in range(2, len(u) - 1)]
    broken = [u[:c] + mark + u[c:] for u, c in cuts for mark in ("-", "x")]
    return broken + [".".join(u) for u, c in cuts if c == 2]


def train(landmarks: Landmarks, texts: list[np.ndarray], label: np.ndarray) -> ToxicityModel:
    """SVM over sentence vectors; ``texts`` holds the sentences of each labelled text."""
    width = len(landmarks.units)
    value, vector = np.linalg.eigh(landmarks.kernels(landmarks.units).astype(np.float64))
    root = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    none = np.zeros((1, width), np.float32)
    negative = np.concatenate([none, *[t for t, y in zip(texts, label, strict=True) if y == 0]])
    toxic = [t for t, y in zip(texts, label, strict=True) if y == 1 and len(t)] or [none]
    scored = [t.max(axis=1) - 0.8 for t in toxic]
    spelled = np.zeros((0, width), np.float32)
    for last in (False, False, False, True):
        positive = [t[(m > 0) | (m == m.max())] for t, m in zip(toxic, scored, strict=True)]
        x = np.concatenate([*positive, spelled, negative]) @ root
        y = np.r_[np.ones(len(x) - len(negative)), -np.ones(len(negative))]
        fitted = fit_small_svm(x, y, COST)
        weights, bias = root @ fitted[:-1], float(fitted[-1])
        scored = [t @ weights + bias for t in toxic]
        if not last:
            sure = landmarks.kernels(landmarks.units) @ weights + bias >= 0.4
            spelled = landmarks.kernels(_spellings(landmarks.units, sure))
            spelled = spelled[spelled.any(axis=1)]
            # a fifth of the weight of the sentences, however few they are
            weight = sum(map(len, positive)) // (5 * len(spelled)) if len(spelled) else 0
            spelled = np.repeat(spelled, max(1, weight), axis=0)
    margins = np.array([max(bias, (t @ weights + bias).max(initial=-np.inf)) for t in texts])
    slope, shift = fit_logistic(margins, label)
    return ToxicityModel(landmarks, weights, bias, slope, shift)


def _scorer(model: ToxicityModel | None):
    def score(batches):
        reader = Reader(model.landmarks) if model else None
        for batch in batches:
            scores = []
            for _, texts in slices(batch, "text"):
                if model:
                    scores += [model.score(s) for s in reader.sentences(texts)]
                else:
                    scores += [0.0] * len(texts)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"]
            )

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(record, score) for every row; ``record`` holds the row as it came.

    A null text counts as empty; an empty text scores as a sentence without insult. Without
    a model, as there were no labels of both classes, all score 0. Equal texts score equal.
    """
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col("text").cast("string").alias("text"),
    )
    return whole.mapInArrow(_scorer(model), whole.drop("text").schema.add("score", "double"))


def predict_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        F.col("record.doc_id").cast("bigint").alias("doc_id"),
        (fold("record.doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_civil(docs: DataFrame, model: ToxicityModel | None, below: float = 0.5) -> DataFrame:
    """Rows that score below ``below``, columns as they came."""
    return score_toxicity(docs, model).where(F.col("score") < below).select("record.*")
