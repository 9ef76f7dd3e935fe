import io

import zstandard

from tallow.llm import warc
from tests.llm.cases import none

SCHEMA = "page_id bigint, url string, html string, bundle string"


def pages(spark):
    rows = [
        (3, "http://a/ b\r\nX: y", "<p>é</p>", None),
        (1, None, "<p>é</p>", "odd"),
        (2, "http://c", "<p>é</p>", "odd"),
        (4, "http://d", None, None),
        (5, "http://e", "", None),
        (6, "http://f", "x\r\n\r\n" * 100_000, None),
        (7, "http://g", "own", None),
        (7, "http://g", "own", None),
        (None, "http://h", "own", None),
        (None, "http://i", "alone", None),
        *[(100 + i, "http://many", f"page {i % 50}" * 50, None) for i in range(200)],
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark):
    df = pages(spark).repartition(3)
    index, root = warc.write_bundles(df)
    got = warc.read_bundles(index, root).collect()
    rows = df.collect()
    firsts = {}
    for r in rows:
        if r.page_id is not None:
            firsts[r.html or ""] = min(r.page_id, firsts.get(r.html or "", r.page_id))
    want = []
    for r in rows:
        data = (r.html or "").encode()
        first = firsts.get(r.html or "")
        other = first if first is not None and r.page_id != first else None
        kind = "response" if other is None else "revisit"
        want.append((r.page_id, len(data), warc.digest_of(data), kind, other))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_one_record_by_its_place_and_the_bundle_as_one_stream(spark, monkeypatch):
    df = pages(spark).where("page_id >= 100").coalesce(1)
    index, root = warc.write_bundles(df)
    html = {r.page_id: r.html for r in df.collect()}
    for r in index.where("page_id % 37 = 0").collect():
        found = warc.read_record(root, r.bundle, r.frame, r.start, r.bytes)
        assert found.page_id == r.page_id
        assert found.payload in (None, html[r.page_id].encode())
    name = index.first().bundle
    with open(f"{root}/{name}", "rb") as file:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == index.where(f"bundle = '{name}'").count()


def test_small_payloads_are_all_responses(spark):
    index, root = warc.write_bundles(pages(spark), least_bytes=1000)
    kinds = {r.record_type for r in warc.read_bundles(index, root).collect()}
    assert kinds == {"response"}


def test_full_bundles_are_followed_by_others(spark, tmp_path):
    writer = warc.BundleWriter(str(tmp_path), "a")
    for i in range(warc.BUNDLE_RECORDS):
        assert not writer.full
        writer.add(i, b"x")
    assert writer.full and writer.close().num_rows == warc.BUNDLE_RECORDS


def test_damage_is_seen():
    data = warc.record(1, "u", b"payload", None)
    assert warc.parse(data).payload == b"payload"
    try:
        warc.parse(data.replace(b"payload\r\n", b"pay1oad\r\n"))
    except ValueError:
        return
    raise AssertionError("a damaged payload was read")


def test_empty_table(spark):
    index, root = warc.write_bundles(none(pages(spark)))
    assert warc.read_bundles(index, root).collect() == []
