"""Personal data: four base patterns, and a semi-Markov conditional random field that adds more.

The field reads regions around digits, at-signs, the word "dot" and the word "at" where it is
in brackets or a name with a dot follows. A region is cut into
atoms (runs of letters and digits, single signs), and a candidate segment is a run of atoms
of bounded number that has one of four loose forms. Features are of the whole segment: which
forms it has, checksum, ranges, counts, what stands on both sides. A segmentation's score is
the sum over its segments, with single atoms outside any entity at zero; dynamic programming
over atom ends sums over all segmentations in training and finds the best one in use, so
borders and kinds are chosen together. Each region holds what it needs: a segment without a
trigger is no candidate, so regions do not bear on each other.

It learns from a bounded sample of regions in which the base patterns mark the entities, and
from the same regions with entities in spellings that the base patterns miss.
"""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.tables import slices, smallest_by_hash

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 3000  # documents with a digit or an at-sign that are learned from
REGIONS = 400  # regions with an entity that are learned from, and as many without
PER_TEXT = 3  # regions of a text that may be drawn
REGION_CHARS = 600  # characters of a region that are learned from
ATOMS = 24
SPAN = 80  # characters of an entity that the field finds, and of the context around a trigger
_SEED = 9

# The base patterns. Possessive runs and looking behind save repeated tries within a run of
# digits, which could only fail again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# An at-word counts in brackets, and bare where a dotted name follows whose dot has space on
# both sides or none ("at home. Then" is no name). It is found in the whole text, not in an atom.
_AT_WORD = (
    r"[\[({]\s*+[Aa][Tt]\s*+[\])}]"
    r"|(?<=\s)[Aa][Tt]\s++(?=[A-Za-z0-9-]++(?:\.|\s++\.\s++|\s*+[\[({]\s*+\.\s*+[\])}]\s*+)[A-Za-z0-9-])"
)
_IN_ATOM = re.compile(r"[0-9@]|\b[Dd][Oo][Tt]\b")
_AT_WORDS = re.compile(_AT_WORD)
_TRIGGER = re.compile(f"{_IN_ATOM.pattern}|{_AT_WORD}")
_ATOM = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_AT = r"(?:\s*@\s*|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)"
_DOT = r"(?:\s*\.\s*|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+)"
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|" + _DOT + r"(?=[A-Za-z0-9]))*"
_LOOSE = {
    "email": re.compile(rf"{_NAME}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I),
    "card": re.compile(r"[0-9](?:[\s./_-]{0,2}[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+|00)?\s?\(?[0-9](?:[\s().-]{0,2}[0-9]){8,14}"),
}


def luhn(digits: str) -> bool:
    """Whether the checksum of a number is right."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str):
    """Leftmost matches: an at-sign with the run of name characters before it and a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def regions(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of triggers, as (start, end)."""
    found: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - SPAN), min(len(text), m.end() + SPAN)
        if found and start <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def _features(kind: int, text: str, segment: str, start: int, end: int) -> np.ndarray:
    """What is known of a whole candidate segment of one kind."""
    digits = _digits(segment)
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    parts = [int(p) for p in re.findall(r"[0-9]+", segment)]
    spaces = sum(c.isspace() for c in segment)
    values = (
        1.0,
        "@" in segment,
        bool(re.search(r"\bat\b", segment, re.I)),
        bool(re.search(r"[\[({]", segment)),
        bool(re.search(r"[A-Za-z]{2,}$", segment)),
        kind == 1 and len(parts) == 4 and max(parts, default=999) <= 255,
        kind == 2 and luhn(digits),
        segment[0] == "+",
        kind == 3 and bool(re.search(r"\(?[0-9]{3}\)?[\s.-][0-9]{3}[\s.-][0-9]{4}$", segment)),
        before.isalnum() or before in "=\"'._-/:+@#",
        after.isalnum() or after in "\"'_/@",
        spaces / 10,
        len(digits) / 20,
        len(segment) / SPAN,
        before in "(" or after in ".-",
        not re.search(r"[^0-9]", segment),
    )
    return np.array(values, float)


FEATURES = 16


@dataclass
class Lattice:
    """Atom ends of a region and its candidates: (first atom, atom after, kind), features."""

    atoms: list[tuple[int, int]]
    segments: list[tuple[int, int, int]]
    features: np.ndarray


def lattice(text: str) -> Lattice:
    atoms = [m.span() for m in _ATOM.finditer(text)]
    marks = {m.start() for m in _AT_WORDS.finditer(text)}
    hot = np.cumsum([0] + [a in marks or bool(_IN_ATOM.search(text, a, b)) for a, b in atoms])
    segments, rows = [], []
    for i, (start, _) in enumerate(atoms):
        if not (text[start].isascii() and (text[start].isalnum() or text[start] in "+(")):
            continue
        for kind, name in enumerate(KINDS):
            longest = _LOOSE[name].match(text, start, min(len(text), start + SPAN))
            if not longest:
                continue
            for j in range(i + 1, min(len(atoms), i + ATOMS) + 1):
                end = atoms[j - 1][1]
                if end > longest.end():
                    break
                segment = text[start:end]
                if hot[j] > hot[i] and _LOOSE[name].fullmatch(segment):
                    segments.append((i, j, kind))
                    rows.append(_features(kind, text, segment, start, end))
    return Lattice(atoms, segments, np.array(rows, float).reshape(len(rows), FEATURES))


class SemiMarkovField:
    """Weights by kind and feature."""

    def __init__(self, weights: np.ndarray | None = None):
        start = np.zeros((len(KINDS), FEATURES))
        start[:, 0] = -1.0
        self.weights = start if weights is None else weights

    def _scores(self, region: Lattice) -> np.ndarray:
        kinds = np.array([k for _, _, k in region.segments], int)
        return (region.features * self.weights[kinds]).sum(axis=1)

    def best(self, region: Lattice) -> list[tuple[int, int, int]]:
        """The segments of the best segmentation."""
        if not region.segments:
            return []
        ending: dict[int, list[int]] = {}
        for s, (_, j, _) in enumerate(region.segments):
            ending.setdefault(j, []).append(s)
        scores = self._scores(region)
        value, chosen = [0.0], [-1]
        for j in range(1, len(region.atoms) + 1):
            top, by = value[j - 1], -1
            for s in ending.get(j, ()):
                with_s = value[region.segments[s][0]] + scores[s]
                if with_s > top:
                    top, by = with_s, s
            value.append(top)
            chosen.append(by)
        found, j = [], len(region.atoms)
        while j > 0:
            s = chosen[j]
            if s < 0:
                j -= 1
            else:
                found.append(region.segments[s])
                j = region.segments[s][0]
        return found[::-1]

    def gradient(self, region: Lattice, gold: set[tuple[int, int, int]]) -> np.ndarray:
        """Of the log-likelihood of ``gold``: its features less the expected ones."""
        out = np.zeros_like(self.weights)
        n, scores = len(region.atoms), self._scores(region)
        starting: dict[int, list[int]] = {}
        ending: dict[int, list[int]] = {}
        for s, (i, j, _) in enumerate(region.segments):
            starting.setdefault(i, []).append(s)
            ending.setdefault(j, []).append(s)
        ahead, back = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            ways = [ahead[j - 1]]
            ways += [ahead[region.segments[s][0]] + scores[s] for s in ending.get(j, ())]
            ahead[j] = np.logaddexp.reduce(ways)
        for i in range(n - 1, -1, -1):
            ways = [back[i + 1]]
            ways += [back[region.segments[s][1]] + scores[s] for s in starting.get(i, ())]
            back[i] = np.logaddexp.reduce(ways)
        for s, (i, j, kind) in enumerate(region.segments):
            chance = np.exp(ahead[i] + scores[s] + back[j] - ahead[n])
            out[kind] += (((i, j, kind) in gold) - chance) * region.features[s]
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        for a, b in regions(text):
            region = lattice(text[a:b])
            for i, j, kind in self.best(region):
                found.append((KINDS[kind], a + region.atoms[i][0], a + region.atoms[j - 1][1]))
        return found


def all_spans(text: str, field: SemiMarkovField) -> list[tuple[str, int, int]]:
    """Base spans, and those of the field that touch none of them, by kind and start."""
    base = base_spans(text)
    if not base and "@" not in text and not _TRIGGER.search(text):
        return base
    taken = sorted((a, b) for _, a, b in base)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else []
    added = []
    for kind, a, b in field.spans(text):
        before = np.searchsorted([x for x, _ in taken], b) if taken else 0
        if not before or ends[before - 1] <= a:
            added.append((kind, a, b))
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _respelled(kind: str, text: str, turn: int) -> str:
    """An entity in a spelling that the base patterns miss."""
    if kind == "email":
        name, _, domain = text.partition("@")
        return (
            f"{name} at {domain.replace('.', ' dot ')}",
            f"{name}[at]{domain.replace('.', '[dot]')}",
            f"{name} (at) {domain}",
            f"{name} @ {domain.replace('.', ' . ')}",
        )[turn % 4]
    if kind == "ip":
        return text.replace(".", (" . ", "[.]", " dot ", "(.)")[turn % 4])
    digits = _digits(text)
    if kind == "card":
        return (". ", "  ", "/", ".")[turn % 4].join(re.findall("[0-9]{1,4}", digits))
    short = digits[-10:]
    return (
        f"({short[:3]}) {short[3:6]}-{short[6:]}",
        f"{short[:3]}-{short[3:6]}-{short[6:]}",
        f"00{digits[:-10]} {short[:3]} {short[3:6]} {short[6:]}",
        f"{short[:3]}.{short[3:6]}.{short[6:]}",
    )[turn % 4]


def _marked(text: str, spans: list[tuple[str, int, int]]) -> tuple[Lattice, set]:
    region = lattice(text)
    first = {a: i for i, (a, _) in enumerate(region.atoms)}
    last = {b: j + 1 for j, (_, b) in enumerate(region.atoms)}
    gold = {(first.get(a), last.get(b), KINDS.index(k)) for k, a, b in spans}
    return region, gold & set(region.segments)


def train(texts: list[str], rounds: int = 6, rate: float = 0.4) -> SemiMarkovField:
    """Stochastic gradient steps over regions and respelled copies of them."""
    examples = []
    for turn, text in enumerate(texts):
        spans, last = [], 0
        for kind, a, b in sorted(base_spans(text), key=lambda s: s[1:]):
            if a >= last:
                spans.append((kind, a, b))
                last = b
        examples.append(_marked(text, spans))
        out, moved, done = "", [], 0
        for kind, a, b in spans:
            new = _respelled(kind, text[a:b], turn)
            out += text[done:a]
            moved.append((kind, len(out), len(out) + len(new)))
            out, done = out + new, b
        if spans:
            examples.append(_marked(out + text[done:], moved))
    examples = [(r, g) for r, g in examples if r.segments]
    field, seen = SemiMarkovField(), np.full((len(KINDS), FEATURES), 1e-3)
    for _ in range(rounds):
        for region, gold in examples:
            step = field.gradient(region, gold) - 1e-3 * field.weights
            seen += step**2
            field.weights += rate * step / np.sqrt(seen)
    return field


def _region_batches(per_text: int, chars: int):
    def read(batches):
        for batch in batches:
            rows = []
            for _, texts in slices(batch, "text"):
                for text in texts:
                    for a, b in regions(text)[:per_text]:
                        part = text[a : min(b, a + chars)]
                        rows.append((part, bool(base_spans(part))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in rows], pa.string()), pa.array([m for _, m in rows], pa.bool_())],
                ["region", "marked"],
            )

    return read


def fit(
    documents: DataFrame,
    sample: int = SAMPLE,
    most: int = REGIONS,
    per_text: int = PER_TEXT,
    chars: int = REGION_CHARS,
) -> SemiMarkovField:
    """Learn from a bounded sample of the documents that have a digit or an at-sign.

    The bounds: ``sample`` documents, whose ids may so be broadcast; the first ``per_text``
    regions of a document; the first ``chars`` characters of a region; and of all regions
    ``most`` with an entity and as many without. Finding has none of them.
    """
    some = documents.select("doc_id", F.col("text").cast("string")).where(
        F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()
    )
    ids = some.select("doc_id", F.lit(0).alias("all"))
    drawn = smallest_by_hash(ids, "doc_id", sample, "all", _SEED).select("doc_id").distinct()
    rows = some.join(F.broadcast(drawn), "doc_id", "left_semi")
    # an id may be repeated without end: one text of it is enough
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    rows = rows.mapInArrow(_region_batches(per_text, chars), "region string, marked boolean")
    place = F.xxhash64(F.lit(_SEED), "region")
    kept = [
        rows.where(F.col("marked") == m).distinct().orderBy(place, "region").limit(most)
        for m in (True, False)
    ]
    return train(sorted(r["region"] for r in kept[0].union(kept[1]).collect()))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find_batches(field: SemiMarkovField):
    def find(batches):
        for batch in batches:
            rows = []
            for _, texts in slices(batch, "text"):
                for text in texts:
                    text = text or ""
                    base, spans = base_spans(text), all_spans(text, field)
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    mark = hashlib.sha256(digest(base).encode()).hexdigest()
                    rows.append((*counts, mark, digest(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return find


def find_personal_data(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """Counts and digest of base spans, and all spans, one row per row.

    A null text counts as empty, without spans. ``n_*`` count base spans. Equal rows get
    equal results.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    ddl = f"doc_id bigint, {counts}, base_sha256 string, spans string"
    return narrow.mapInArrow(_find_batches(field), ddl)


def masked(text: str, field: SemiMarkovField) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones as one."""
    out, done = [], 0
    for kind, a, b in sorted(all_spans(text, field), key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_personal_data(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """The same rows and columns with masked texts, and ``n_chars``, if there, to match."""

    def mask(batches):
        for batch in batches:
            texts = [t if t is None else masked(t, field) for _, s in slices(batch, "text") for t in s]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    plain = docs.withColumn("text", F.col("text").cast("string"))
    found = plain.mapInArrow(mask, plain.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.char_length("text").cast(kind))
    return found
