"""The pipeline against the same steps done one document at a time."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from tallow.llm import langid, packing, pii, simhash, toxicity
from tests.llm.cases import documents, none
from tests.llm.test_langid import SYLLABLES
from tests.llm.test_simhash import brute_components, brute_fingerprint

INSULTS = ["idiot", "worthless", "moron"]


def corpus(spark, path, odd=False):
    random.seed(9)
    rows, labels = [], []
    for i in range(320):
        lang = list(SYLLABLES)[i % 4]
        parts = SYLLABLES[lang].split()
        words = ["".join(random.choices(parts, k=random.randint(1, 3))) for _ in range(70)]
        toxic = i % 8 == 0
        if toxic:
            for insult in INSULTS:
                words[random.randrange(70)] = insult
        if i % 10 == 3:
            words[7] = f"ab.{i}@mail.example.com"
            words[20] = f"10.0.{i % 200}.7"
        text = " ".join(words)
        rows += [(5000 + i, text, lang, "s")] + [(7000 + i, text, lang, "s")] * (i % 16 == 5)
        labels.append((5000 + i, 1, int(toxic)))
    docs = documents(spark, rows, odd)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    return docs


def brute(spark, docs, labels):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    languages = langid.fit(docs)
    kept = []
    for doc_id, text in rows:
        x = langid.features(text)
        if x is not None and languages.predict(x)[1] >= 0.3:
            kept.append((doc_id, text))
    model = toxicity.fit(docs, labels)
    reader = toxicity.Reader(model.landmarks)
    rows = [(d, t) for d, t in kept if model.score(reader.sentences([t])[0]) < 0.5]
    ids = [d if d is not None else 10**9 for d, _ in rows]
    groups = brute_components(ids, [brute_fingerprint(t) for _, t in rows])
    firsts = {}
    for i, g, row in zip(ids, groups, rows, strict=True):
        if i == g:  # rows that share an id share their text here
            firsts[g] = row
    field = pii.fit(docs)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    pieces = []
    for doc_id, text in firsts.values():
        ids = [*tokenizer.encode(pii.masked(text, field), add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            pieces.append((doc_id, n, at, len(own), zlib.crc32(own.tobytes())))
    return pieces


@pytest.mark.parametrize("odd", [False, True])  # with columns of clashing names
def test_against_one_document_at_a_time(spark, tmp_path, odd):
    docs = corpus(spark, tmp_path, odd)
    want = brute(spark, docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = {r.doc_id for r in rows}
    assert not any(5000 + i in kept for i in range(0, 320, 8))  # toxic
    assert not any(i >= 7000 for i in kept if i is not None)  # copies
    assert sum(5000 + i in kept for i in range(320)) > 250


def test_stages_are_named_and_keep_the_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "toxicity", "simhash_near_dedup", "pii", "best_fit_packing"
    ]
    docs = corpus(spark, tmp_path).withColumn("n_chars", spark.range(1).selectExpr("1").scalar())
    docs = docs.withColumn("n_chars", docs.n_chars.cast("bigint"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_near_duplicates_are_found_without_broadcasting_keys(spark, tmp_path, monkeypatch):
    docs, plans, link = corpus(spark, tmp_path), [], simhash.link

    def watched(distinct):
        links = link(distinct)
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return links

    monkeypatch.setattr(simhash, "link", watched)
    corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_empty_tables(spark, tmp_path):
    empty = none(documents(spark, odd=False))
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    none(spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")).write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered(spark):
    names = entry_points.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry_points.oracle_sql()) <= set(names)
