import random
import re

import xxhash

from tallow.llm import simhash
from tests.llm.cases import documents, none


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=2):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, n in zip(label, ids, strict=True):
        if n is not None:
            least[x] = min(least.get(x, n), n)
    return [least.get(x) for x in label]


def compare(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = [
        (i, f"{p:016x}", c)
        for i, p, c in zip(ids, prints, brute_components(ids, prints), strict=True)
    ]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    compare(documents(spark, [(9, "Éa ÉA\x0bb\x1cc", "fr", None), (10, "one two", "en", None)]))


def test_near_copies(spark):
    random.seed(1)
    rows = []
    for i in range(60):
        words = [random.choice("abcdefgh") * random.randint(1, 4) for _ in range(60 + i)]
        for j in range(6):
            rows.append((1000 * j + i, " ".join(words), "en", None))
            words[random.randrange(len(words))] = "new"
    compare(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))


def test_links_against_all_pairs(spark):
    random.seed(2)
    prints = {random.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(12):
            flips = random.sample(range(64), random.randint(1, 3))
            prints.add(p ^ sum(1 << b for b in flips))
    signed = sorted(p - (1 << 64 if p >> 63 else 0) for p in prints)
    want = {
        (a, b)
        for i, a in enumerate(signed)
        for b in signed[i + 1 :]
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    }
    got = simhash.link(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_links_are_not_broadcast(spark):
    plan = executed(simhash.link(spark.range(1000).toDF("fp")))  # a size Spark would broadcast
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1


def test_rows_are_not_broadcast(spark):
    rows = [(1, "one text many times over", "en", None)] * 500
    rows += [(i, f"t{i} u{i} v{i}", "en", None) for i in range(100, 2000)]
    found = simhash.near_duplicates(documents(spark, rows))
    assert "BuildLeft" not in executed(found)
    assert sum(r.doc_id == 1 and r.component_id == 1 for r in found.collect()) >= 500


def test_one_of_each_component_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # empty texts, null texts and white space are one component, whose smallest id is 3
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "6", "7", "8", "None"])
    assert [r.text for r in rows if r.doc_id is None] == ["a text without an id"]


def test_rows_stay_whether_names_are_broadcast_or_merged(spark):
    """Ids that different texts share, keys that different ids share, equal rows without end."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, words(i), "en", "a") for i in range(40)] + [(100 + i, words(i), "en", "b") for i in range(40)]
    rows += [(7, words(50), "en", "c"), (None, words(51), "en", "d")] + [(60, words(52), "en", "e")] * 300
    rows += [(None, words(53), "en", "f")] * 200 + [(None, words(3), "en", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = {r[:2] for r in rows} - {(100 + i, words(i)) for i in range(40)} - {(None, words(3))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert len(kept) == len(want) and set(kept) == want


def test_texts_do_not_move_for_few_duplicates(spark):
    docs = documents(spark)
    plan = simhash.keep_first(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_empty_table(spark):
    empty = none(documents(spark))
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_first(empty).count() == 0
