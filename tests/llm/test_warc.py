import hashlib
import os
import zlib

import pytest

from leafmill.llm import warc

SHAPE = "page_id long, url string, html string, size long, digest string, shard int"


@pytest.fixture()
def pages(spark):
    long = "<p>" + "é" * 200 + "</p>"
    rows = [(3, "http://a/ b\n", long), (1, "http://a/1", long), (7, None, long), (None, "http://n", long), (2, "http://s", "short"), (4, "http://s2", "short"), (5, "http://e", None), (6, "http://e", ""), (1, "http://a/1", long)]
    rows += [(100 + i, f"http://x/{i}", f"<html>{i}" + "\r\n\r\nWARC/1.1\r\n" * 50) for i in range(60)] + [(99, "u", "x" * 300_000)]
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], SHAPE).repartition(4)


def test_archive(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(spark, pages, folder, shard=8000, roll=3000).collect()
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == pages.count() == sum(r.records for r in manifest) and len({r.shard for r in manifest}) > 3
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[1]] == ["response"] * 2 and all((by[i][0].record_type, by[i][0].refers_to) == ("revisit", 1) for i in (3, 7, None))
    assert all(by[i][0].record_type == "response" for i in (2, 4, 5, 6)) and by[5][0].payload_bytes == 0
    for page in pages.collect():
        raw = (page.html or "").encode()
        for r in by[page.page_id]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert r.record_type == "revisit" or bytes(r.payload) == raw
    for r in manifest:
        data = (tmp_path / "a" / r.file).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
    assert all(f == "manifest" or f.strip(".").startswith("shard-") for f in os.listdir(tmp_path / "a"))  # nothing unfinished
    assert [b.startswith(b"WARC/1.1\r\nWARC-Type: ") for b in warc._members((tmp_path / "a" / manifest[0].file).open("rb"))][0]


def test_same_files_in_every_run(spark, pages, tmp_path):
    runs = []
    for i, own in enumerate((pages, pages.repartition(7))):
        warc.write_archives(spark, own, f"{tmp_path}/{i}", shard=5000, roll=2000)
        runs.append({f: (tmp_path / str(i) / f).read_bytes() for f in os.listdir(tmp_path / str(i)) if f.endswith(".gz")})
    assert runs[0] == runs[1]


def test_one_id_many_rows(spark, tmp_path):
    rows = spark.range(500).selectExpr("42L AS page_id", "concat('u', id) AS url", "repeat(concat('p', id), 100) AS html")
    manifest = warc.write_archives(spark, rows, f"{tmp_path}/h", shard=20_000, roll=10_000).collect()
    assert len({r.shard for r in manifest}) > 5 and warc.read_archives(spark, f"{tmp_path}/h").count() == 500


def test_ids_that_span_everything(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", "x" * 50) for i in (-(2**63), -5, 0, 7, 2**63 - 1)], "page_id long, url string, html string")
    warc.write_archives(spark, rows, f"{tmp_path}/w", shard=700)
    assert sorted(r.page_id for r in warc.read_archives(spark, f"{tmp_path}/w").collect()) == [-(2**63), -5, 0, 7, 2**63 - 1]


def test_shards_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARDS", 3)
    rows = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('p', id), 100) AS html")
    manifest = warc.write_archives(spark, rows, f"{tmp_path}/s", shard=1000).collect()
    assert len({r.shard for r in manifest}) <= 4 and sum(r.records for r in manifest) == 300


def test_damage(spark, pages, tmp_path):
    manifest = warc.write_archives(spark, pages.limit(5), f"{tmp_path}/d").collect()
    file = tmp_path / "d" / manifest[0].file
    raw = b"".join(warc._members(file.open("rb")))
    first = next(warc._members(file.open("rb")))
    warc.parsed(first)
    with pytest.raises(ValueError):
        warc.parsed(first.replace(b"format", b"farmat"))
    file.write_bytes(file.read_bytes()[:-20])
    with pytest.raises((ValueError, zlib.error)):
        list(warc._members(file.open("rb")))
    assert b"WARC-Type: response" in raw


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SHAPE)
    assert warc.write_archives(spark, none, f"{tmp_path}/e").count() == 0 and warc.read_archives(spark, f"{tmp_path}/e").count() == 0
