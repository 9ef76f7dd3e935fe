"""Language of whole texts: the family first, then linear SVMs between its languages.

A text becomes the square roots of its hashed byte n-gram frequencies (a vector of length
one). One-versus-rest linear SVMs choose the family; within it every pair of languages has
an SVM of its own, and the language with most votes wins, ties going to the larger sum of
margins. A family of one language needs no vote.

The SVMs learn from a bounded sample: the ``SAMPLE`` rows of each label with the smallest
seeded hash of their id. Whole texts are read, in training and in prediction.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.linear import fit_svm
from tallow.llm.tables import fold, slices, smallest_by_hash

SAMPLE = 500
DIMENSIONS = 4096
UNKNOWN = "und"
_SEED = 5

# Language families by ISO 639-1 code. A code that is not listed is a family
# of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no nb nn sv".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(text: str | None) -> np.ndarray | None:
    """Hashed 1- to 4-gram bytes of the lower-cased text; None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = text.lower().encode("utf-8", "replace")
    codes = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS)
    gram = codes
    for width in range(1, 5):
        if width > 1:
            if len(codes) < width:
                break
            gram = gram[:-1] * np.uint32(0x01000193) + codes[width - 1 :]
        slot = ((gram + np.uint32(width)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        counts += np.bincount(slot, minlength=DIMENSIONS) / len(slot)
    return np.sqrt(counts / counts.sum())


@dataclass
class LanguageModel:
    """Weights: a row per family, and per family a row for each pair of its languages."""

    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and a score from 0 to 1: the chance of the family times that of the vote."""
        if not self.families:
            return UNKNOWN, 0.0
        margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        best = int(np.argmax(margins))
        rest = np.delete(margins, best)
        chance = _logistic(margins[best] - rest.max()) if len(rest) else 1.0
        family = self.families[best]
        languages = self.members[family]
        if len(languages) == 1:
            return languages[0], chance
        weights = self.pair_weights[family]
        votes, total = np.zeros(len(languages)), np.zeros(len(languages))
        lowest = np.full(len(languages), np.inf)
        pairs = combinations(range(len(languages)), 2)
        for (a, b), m in zip(pairs, weights[:, :-1] @ x + weights[:, -1], strict=True):
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            lowest[a], lowest[b] = min(lowest[a], m), min(lowest[b], -m)
        winner = max(range(len(languages)), key=lambda i: (votes[i], total[i], -i))
        return languages[winner], chance * _logistic(2 * lowest[winner])


def _logistic(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-4.0 * margin)))


def _feature_batches(batches):
    for batch in batches:
        for start, texts in slices(batch, "text"):
            rows = [
                (lang, x.astype(np.float16).tobytes())
                for lang, x in zip(
                    batch.column("lang").slice(start, len(texts)).to_pylist(),
                    map(features, texts),
                    strict=True,
                )
                if x is not None
            ]
            yield pa.RecordBatch.from_pylist(
                [{"lang": a, "x": b} for a, b in rows],
                pa.schema([("lang", pa.string()), ("x", pa.binary())]),
            )


def fit(documents: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from rows with a label, an id whose fold is not 2, and at least one letter."""
    known = documents.select(
        F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    # ids are drawn first, so that no text moves for the draw
    drawn = smallest_by_hash(known.select("doc_id", "lang"), "doc_id", sample, "lang", _SEED)
    drawn = drawn.distinct()
    rows = known.join(F.broadcast(drawn), ["doc_id", "lang"], "left_semi")
    # an id may be repeated without end: one text of it is enough
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")
    found = rows.mapInArrow(_feature_batches, "lang string, x binary").toPandas()
    found = found.sort_values(["lang", "x"], ignore_index=True)
    x = np.array([np.frombuffer(b, np.float16) for b in found["x"]], np.float32)
    x = x.reshape(len(found), DIMENSIONS)
    return train(x, found["lang"].to_numpy())


def train(x: np.ndarray, lang: np.ndarray) -> LanguageModel:
    members: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        members.setdefault(_FAMILY_OF.get(code, code), []).append(code)
    families = sorted(members)
    family = np.array([_FAMILY_OF.get(code, code) for code in lang])
    of_family = [fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in families]
    pair_weights = {}
    for f in families:
        fitted = []
        for a, b in combinations(members[f], 2):
            here = (lang == a) | (lang == b)
            fitted.append(fit_svm(x[here], np.where(lang[here] == a, 1.0, -1.0)))
        pair_weights[f] = np.array(fitted).reshape(len(fitted), DIMENSIONS + 1)
    weights = np.array(of_family).reshape(len(families), DIMENSIONS + 1)
    return LanguageModel(families, members, weights, pair_weights)


def _predictor(model: LanguageModel):
    def predict(batches):
        for batch in batches:
            names, scores = [], []
            for _, texts in slices(batch, "text"):
                for x in map(features, texts):
                    name, score = model.predict(x) if x is not None else (UNKNOWN, 0.0)
                    names.append(name)
                    scores.append(score)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "lang_score"],
            )

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(record, lang_pred, lang_score) for every row; ``record`` holds the row as it came.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    there was nothing to learn from. Equal texts get equal results. Columns of any name are
    carried.
    """
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col("text").cast("string").alias("text"),
    )
    schema = whole.drop("text").schema.add("lang_pred", "string").add("lang_score", "double")
    return whole.mapInArrow(_predictor(model), schema)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("record.doc_id").cast("bigint").alias("doc_id"),
        (fold("record.doc_id", 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """Rows whose language is known with a score of at least ``least``, columns as they came."""
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)).select(
        "record.*"
    )
