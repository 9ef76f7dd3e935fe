"""Spelling variants of words, found among the sorted rotations of a permuterm index.

A word is closed by a terminator and rotated in every way. Rotated until the edited character
is last, two words that differ in one character share all that stands before it, and a word with
one character more has the whole rotation of the shorter one before it. So a rotation is filed
under itself and, where it ends in a character of the word, under itself without that: the
prefix whose range holds all replacements of the character, and the word that lacks it. Rows of a
key are brought together by sorting; each word of a group gets from it how many neighbours it
has there and the first of them, and no pairs are made.

A group holds distinct words that differ in one character, so it is as small as the alphabet, and
no key is hot. Words are named by their place in the order of frequency, so the first neighbour
is the one with the smallest number. Keys longer than ``LONG`` characters stand as hashes of 127
bits, which roll from one rotation to the next: rotations of a word take space in proportion to
its length, whatever that is.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.tables import slices
from tallow.session import stage

LEAST_LETTERS = 7
LEAST_COUNT = 2
FACTOR = 10  # a form is so many times as frequent
DROP_EVERY = 31
LONG = 256
WORDS_PER_TASK = 50_000
TERMINATOR = "$"
_HELD = 200_000  # words that a task counts before it hands them on
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC834  # of the rolling hash
_ROUNDS = 8  # of doubling; counts grow tenfold along a chain, so 63 bits end it after 19 links


def runs(text: str, least: int) -> list[str]:
    """Maximal runs of Latin letters of at least ``least``, only A-Z lower-cased."""
    lowered = text.encode("utf-8", "replace").lower().decode("utf-8")
    return re.findall(f"[a-zÀ-ÿ]{{{least},}}", lowered)


def spelt(run: str, start: int) -> str:
    """The run as it counts: one in ``DROP_EVERY`` of a document's runs loses a letter.

    ``start`` is the crc32 of what stands before the run in the hashed text.
    """
    h = zlib.crc32(run.encode(), start)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(least: int):
    def batch_of(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    def count(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for start, texts in slices(batch, "text"):
                names = batch.column("doc_id").slice(start, len(texts)).to_pylist()
                for name, text in zip(names, texts, strict=True):
                    before = zlib.crc32(f"{'' if name is None else name}:".encode())
                    # a run that is too short does not grow
                    for run, n in Counter(runs(text or "", least)).items():
                        held[spelt(run, before)] += n
                if len(held) > _HELD:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    return count


def count_words(docs: DataFrame, least: int = LEAST_LETTERS, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least`` letters that occur ``often`` or more times in all.

    Each task counts for itself before anything moves, so frequent words do not heap up.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    counted = narrow.mapInArrow(_count_batches(least), "word string, n bigint")
    total = counted.where(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= often)


def rotation_keys(word: str) -> list[tuple[str, bool, bool]]:
    """(key, whether a character is skipped, whether that begins a run of equal ones).

    Leaving out any one of a run of equal letters gives the same word; only the first counts
    where the shorter word is sought.
    """
    if len(word) >= LONG:  # keys have the length of the word, or one more
        return _hashed_keys(word)
    keys = []
    for i in range(len(word) + 1):
        rotation = word[i:] + TERMINATOR + word[:i]
        keys.append((rotation, False, False))
        if i:
            keys.append((rotation[:-1], True, i == 1 or word[i - 2] != word[i - 1]))
    return keys


def _hashed_keys(word: str) -> list[tuple[str, bool, bool]]:
    """The same with keys of more than ``LONG`` characters as hashes, and as text up to that."""
    n = len(word) + 1
    codes = [ord(c) for c in word] + [ord(TERMINATOR)]
    top, value = pow(_BASE, n - 1, _PRIME), 0
    inverse = pow(_BASE, -1, _PRIME)
    for c in codes:
        value = (value * _BASE + c) % _PRIME
    keys = []
    for i in range(n):
        keys.append((f"{n}#{value:x}", False, False))
        if i:
            # the rotation from i on ends in the letter before i
            last = codes[i - 1]
            first = i == 1 or codes[i - 2] != last
            if n - 1 > LONG:
                keys.append((f"{n - 1}#{(value - last) * inverse % _PRIME:x}", True, first))
            else:
                keys.append((word[i:] + TERMINATOR + word[: i - 1], True, first))
        value = ((value - codes[i] * top) * _BASE + codes[i]) % _PRIME
    return keys


def _rotation_batches(batches):
    fields = ["key", "skips", "begins", "place"]
    types = [pa.string(), pa.bool_(), pa.bool_(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    for batch in batches:
        rows: list[tuple] = []
        for word, place in zip(*(batch.column(c).to_pylist() for c in ("word", "place")), strict=True):
            rows += [(*key, place) for key in rotation_keys(word)]
            if len(rows) > 100_000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)


def neighbours(words: DataFrame) -> DataFrame:
    """(place, n_near, near): of each word with a neighbour, how many, and the smallest place.

    ``words`` are (word, place), distinct.
    """
    # a row becomes some twenty, so rows are dealt by count and not by their size
    tasks = max(1, -(-words.count() // WORDS_PER_TASK))
    spread = words.select("word", "place").repartition(tasks).mapInArrow(
        _rotation_batches, "key string, skips boolean, begins boolean, place bigint"
    )
    # a key has at most one whole rotation, and one row for each letter that may be skipped
    grouped = spread.groupBy("key").agg(
        F.max(F.when(~F.col("skips"), F.col("place"))).alias("shorter"),
        F.array_sort(F.collect_list(F.when(F.col("skips"), F.struct("place", "begins")))).alias("longer"),
    )
    grouped = grouped.where(F.size("longer") + F.col("shorter").isNotNull().cast("int") > 1)
    told = F.expr("""
        concat(
          transform(longer, x -> struct(
            x.place as place,
            size(longer) - 1 + int(x.begins and shorter is not null) as n_near,
            least(
              case when size(longer) > 1 then if(longer[0].place = x.place, longer[1].place, longer[0].place) end,
              case when x.begins then shorter end
            ) as near)),
          if(shorter is null, array(), array(struct(
            shorter as place,
            size(filter(longer, x -> x.begins)) as n_near,
            array_min(transform(filter(longer, x -> x.begins), x -> x.place)) as near))))
    """)
    each = grouped.select(F.inline(told)).where(F.col("n_near") > 0)
    return each.groupBy("place").agg(F.sum("n_near").cast("bigint").alias("n_near"), F.min("near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """(place, root) by doubling the steps taken along ``forms`` (place, next)."""
    steps = stage(forms.select("place", F.col("next").alias("root")), "steps")
    for _ in range(_ROUNDS):
        further = steps.select(F.col("place").alias("root"), F.col("root").alias("end"))
        joined = steps.join(further, "root", "left")
        moved = stage(joined.select("place", F.coalesce("end", "root").alias("root"), "end"), "steps")
        if moved.where(F.col("end").isNotNull()).isEmpty():
            break
        steps = moved.drop("end")
    return steps


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every one of ``words`` (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one the other. A
    word's form is its most frequent near word (of equal ones the first in code-point order), if
    that is at least ``factor`` times as frequent, and null else. Its root is where following
    forms ends, itself if it has none. Rows without a word or count are dropped, words that are
    there more than once count together. An empty table gives an empty result. ``factor`` is above
    1, or forms could go round in circles.
    """
    if factor <= 1:
        raise ValueError("a form must be more frequent than its word")
    known = words.where(F.col("word").isNotNull() & F.col("n").isNotNull())
    known = known.groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    ordered = known.orderBy(F.desc("n"), "word").withColumn("place", F.monotonically_increasing_id())
    placed = stage(ordered, "words")
    near = placed.join(neighbours(placed), "place", "left")
    other = placed.select(F.col("place").alias("near"), F.col("n").alias("near_n"))
    rows = stage(near.join(other, "near", "left"), "near")
    has_form = F.col("near_n") >= factor * F.col("n")
    linked = stage(rows.withColumn("next", F.when(has_form, F.col("near"))), "forms")
    roots = _roots(linked.where(F.col("next").isNotNull()).select("place", "next"))
    named = lambda place, word: placed.select(F.col("place").alias(place), F.col("word").alias(word))
    return (
        linked.join(roots, "place", "left")
        .join(named("next", "form"), "next", "left")
        .join(named("root", "root_word"), "root", "left")
        .select(
            "word", "form", F.coalesce("root_word", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(F.col("next").isNotNull(), F.col("near_n")).alias("form_n"),
        )
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole texts of (doc_id, text); see ``group_variants``.

    Null and empty texts have no words; a null id counts as empty text before the colon. Equal
    rows count as often as they are there.
    """
    return group_variants(count_words(docs))
