"""Near duplicates by SimHash, linked through deletion variants of fingerprint halves.

Fingerprints that differ in at most two bits are cut into two halves of 32 bits. Then
either a half is equal and the other differs by two bits at most, or each half differs by
exactly one bit. Both are found by equality joins:

* equal half: key is that half and one third of the other half; of three thirds, two
  differing bits leave one untouched.
* one bit in each half: key is the upper half with one bit deleted (one variant for each
  bit) and one half of the lower half, one of which is untouched. The side whose deleted
  bit was 0 joins the side on which it was 1, so equal halves do not meet here again.

A key holds 42 to 47 bits of the fingerprint, so groups stay small without any cap, and
every candidate is verified in the join condition. A fingerprint has at most 2,080 others
within two bits, which bounds the links. Only distinct fingerprints are linked, so groups of
copies, however large, count as one.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.components import components
from tallow.llm.tables import slices
from tallow.session import stage

WORDS = 3
SEED = 42
_THIRDS = ((0, 11), (11, 11), (22, 10))  # shift and width
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a whole text as a signed 64-bit number; 0 for a text without words.

    ``bytes.lower`` lower-cases A-Z alone and ``bytes.split`` cuts at the six ASCII spaces.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches):
    for batch in batches:
        found = [fingerprint(t) for _, texts in slices(batch, "text") for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(found, pa.int64())],
            ["doc_id", "row_key", "fp"],
        )


def _row_key(record: str = ""):
    """Tells rows apart; equal rows share it."""
    doc_id, text = F.col(f"{record}doc_id"), F.col(f"{record}text")
    return F.xxhash64(doc_id.cast("bigint"), text.cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) for every row."""
    narrow = docs.select(
        F.col("doc_id").cast("bigint"), _row_key().alias("row_key"), F.col("text").cast("string")
    )
    return narrow.mapInArrow(_fingerprint_batches, "doc_id bigint, row_key bigint, fp bigint")


def _bits(value, shift: int, width: int):
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _packed(case, value):
    return F.shiftleft(case, 54).bitwiseOR(value)


def _keyed(distinct: DataFrame, deleted_bit: int) -> DataFrame:
    """(key, fp) of one side of the join."""
    fp = F.col("fp")
    halves = [_bits(fp, 32, 32), _bits(fp, 0, 32)]
    keys = []
    for h in (0, 1):
        for t, (shift, width) in enumerate(_THIRDS):
            case = F.lit(3 * h + t).cast("bigint")
            part = _bits(halves[1 - h], shift, width)
            keys.append(_packed(case, F.shiftleft(halves[h], 11).bitwiseOR(part)))
    for j in range(32):
        bit = 1 << j
        short = halves[0].bitwiseAND(F.lit(0xFFFFFFFF ^ bit))
        mine = halves[0].bitwiseAND(F.lit(bit)) == F.lit(bit if deleted_bit else 0)
        for half in (0, 1):
            # 32 bits, then 16 of the lower half, then the half: 49; the deleted place above
            value = F.shiftleft(short, 17).bitwiseOR(F.shiftleft(_bits(halves[1], 16 * half, 16), 1))
            value = value.bitwiseOR(F.lit(half)).bitwiseOR(F.lit(j << 49))
            keys.append(F.when(mine, _packed(F.lit(6).cast("bigint"), value)))
    exploded = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    return exploded.where(F.col("key").isNotNull())


def link(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints (column fp) with at most two differing bits.

    The join is a merge: Spark takes a side for as large as its fingerprints before they are
    exploded to 38 keys, and would send it through the driver.
    """
    left, right = _keyed(distinct, 0).toDF("a", "key"), _keyed(distinct, 1).toDF("b", "key")
    # keys of equal halves are on both sides: there the order keeps one of two
    once = (F.shiftrightunsigned("key", 54) == 6) | (F.col("a") < F.col("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    joined = left.withColumnRenamed("key", "k").join(right.hint("merge"), (F.col("k") == F.col("key")) & once & near)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, root, rep, first) for every distinct fingerprint.

    ``rep`` is its smallest doc_id, ``first`` the key of the row that would stay of it.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), first.alias("first"))
    reps = stage(reps, "reps")
    roots = components(link(reps.select("fp"))).toDF("fp", "root")
    joined = reps.join(roots, "fp", "left")
    return stage(joined.withColumn("root", F.coalesce("root", "fp")), "roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    A null text counts as empty; texts without words have fingerprint zero and link like any
    other. ``component_id`` is the smallest doc_id reachable over links, the row itself
    included; null ids are passed over, and a component of null ids alone has null. Equal
    rows each get a row. Columns besides doc_id and text are not read.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    rooted = _rooted(prints)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    # every fingerprint is in both; only the right side of a left join may be broadcast, and equal
    # rows press the file of the left one to nothing
    return prints.join(of_fp, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns kept: that of the smallest doc_id.

    Rows without an id come after all others; of rows that share the id, the one with the
    smallest key stays, and of equal rows any one. A row is named by its id and its key.

    Only the names of rows that go, or that several equal rows have, are written and joined
    with the documents: where these are few, Spark sends them to the texts, and no text moves.
    Equal rows are put together by an aggregation, which is partial before its exchange.
    """
    name = ["doc_id", "row_key"]
    prints = stage(fingerprints(docs), "fingerprints")
    rooted = _rooted(prints)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    firsts = firsts.select("first.doc_id", "first.row_key").withColumn("stays", F.lit(True))
    names = prints.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).alias("names")
    first = _same_name(F.col("names.doc_id"), F.col("names.row_key"), "firsts")
    named = names.join(firsts.alias("firsts"), first, "left")
    named = named.select("names.*", F.coalesce("stays", F.lit(False)).alias("stays"))
    marked = stage(named.where("n > 1 or not stays"), "marked")
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    here = F.col("record.doc_id").cast("bigint"), _row_key("record.")
    alone = records.join(marked.alias("marked"), _same_name(*here, "marked"), "left_anti")
    equal = records.select("record", here[0].alias("own_id"), here[1].alias("own_key"))
    repeated = marked.where("stays").alias("repeated")
    equal = equal.join(repeated, _same_name(F.col("own_id"), F.col("own_key"), "repeated"), "left_semi")
    one = equal.groupBy("own_id", "own_key").agg(F.any_value("record").alias("record"))
    return alone.unionByName(one.select("record")).select("record.*")


def _same_name(doc_id, row_key, side: str):
    return doc_id.eqNullSafe(F.col(f"{side}.doc_id")) & (row_key == F.col(f"{side}.row_key"))
