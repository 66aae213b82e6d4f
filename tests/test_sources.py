import gzip
import io
import os
import sys

import pytest

from leafmill.cli import main
from leafmill.operators import records as ops
from leafmill.sources import scan, sinks
from leafmill.sources.encode import encoded as encode
from leafmill.streaming.records import stream_dedup, stream_frequency, stream_records, stream_select
from tests.records import CHART, encoded

GOOD = encoded(CHART)
OTHER = encoded("001 2\n052 $a é $2 grid")


def damaged(change) -> bytes:
    raw = bytearray(OTHER)
    change(raw)
    return bytes(raw)


BROKEN = {
    "invalid leader": [b"\x1d", damaged(lambda r: r.__setitem__(5, 32)), damaged(lambda r: r.__setitem__(slice(10, 12), b"23")), damaged(lambda r: r.__setitem__(0, 65)), b"\n" + OTHER],
    "invalid directory": [damaged(lambda r: r.__setitem__(24, 65)), damaged(lambda r: r.__delitem__(slice(24, 25)))],
    "invalid size": [damaged(lambda r: r.__setitem__(slice(0, 5), b"00099")), damaged(lambda r: r.__delitem__(-3))],
    "invalid length": [damaged(lambda r: r.__setitem__(slice(0, 5), b"00010"))],
    "invalid fields": [damaged(lambda r: r.__setitem__(slice(27, 31), b"0003")), damaged(lambda r: r.__setitem__(slice(39, 43), b"0000")), damaged(lambda r: r.__setitem__(r.rindex(b"\x1f") + 1, 33)), damaged(lambda r: r.__setitem__(r.index(b"\x1f") - 1, 65))],
}


@pytest.mark.parametrize("err", sorted(BROKEN))
def test_invalid(spark, err):
    got = scan.from_bytes(spark, OTHER + OTHER.join(x if x.endswith(b"\x1d") else x + b"\x1d" for x in BROKEN[err])).orderBy("ord").collect()
    bad = [r.err for r in got if not r.valid]
    assert bad == [err] * len(BROKEN[err]) and all(r.fields is None for r in got if not r.valid)


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "a.mrc").write_bytes(OTHER + GOOD)
    (tmp_path / "b.mrc").write_bytes(OTHER[:-1])
    with gzip.open(tmp_path / "c.mrc.gz", "wb") as f:
        f.write(GOOD + OTHER)
    return tmp_path


def test_scan(spark, files):
    rows = scan.scan_records(spark, [f"{files}/a.mrc", f"{files}/c.mrc.gz"], "001, 052.a", header="cn, a", where="052?")
    assert sorted(map(tuple, rows.collect())) == sorted([("2", "é"), ("MP-4471", "6920"), ("MP-4471", "6924")] * 2)
    assert scan.read_records(spark, f"{files}/[ab].mrc", "001").shape == (2, 1)
    order = scan.read_files(spark, [f"{files}/c.mrc.gz", f"{files}/a.mrc"]).orderBy("ord").select("raw").collect()
    assert [bytes(r.raw) for r in order] == [GOOD, OTHER, OTHER, GOOD]
    assert scan.read_files(spark, []).count() == 0 and scan.expanded("~/x") == [os.path.expanduser("~/x")]


def test_cut_records_anywhere(spark, files):
    """A last record without terminator shows in plain files, in gzip files (of several members too) and by address."""
    with gzip.open(files / "cut one.mrc.gz", "wb") as f:
        f.write(GOOD)
    with gzip.open(files / "cut one.mrc.gz", "ab") as f:
        f.write(OTHER + OTHER[:-1])
    (files / "empty.mrc").write_bytes(b"")
    with gzip.open(files / "none.mrc.gz", "wb"):
        pass
    for source in (files / "cut one.mrc.gz", f"file://{files}/cut one.mrc.gz", f"file:{files}/b.mrc", [f"file://{files}/*.mrc"], [files / "none.mrc.gz", files / "empty.mrc", files / "b.mrc", files / "b.mrc"]):
        got = scan.read_files(spark, source if isinstance(source, list) else str(source), "PERMISSIVE").orderBy("ord").collect()
        assert got[-1].err == "invalid terminator" and bytes(got[-1].raw) == OTHER[:-1] and len({r.ord for r in got}) == len(got)
    assert [r.err for r in scan.read_files(spark, str(files / "cut one.mrc.gz"), "PERMISSIVE").orderBy("ord").collect()] == [None, None, "invalid terminator"]


def test_directories_and_many_files(spark, files, monkeypatch):
    sinks.write_raw(scan.from_bytes(spark, GOOD * 5 + OTHER * 4).repartition(3), f"{files}/d1")
    sinks.write_raw(scan.from_bytes(spark, GOOD * 2 + OTHER).repartition(2), f"{files}/d2", "gzip", level=9)
    for mapped in (scan.MAPPED, 0):
        monkeypatch.setattr(scan, "MAPPED", mapped)
        got = scan.read_files(spark, [f"{files}/d1", f"{files}/a.mrc", f"{files}/d2"]).orderBy("ord").collect()
        assert len({r.ord for r in got}) == len(got) == 14 and [r.source.split("/")[-2] for r in got] == ["d1"] * 9 + [files.name] * 2 + ["d2"] * 3


def test_positions_that_do_not_fit(spark, files, monkeypatch):
    monkeypatch.setattr(scan, "_row_bits", lambda count: 0)
    with pytest.raises(Exception, match="do not fit"):
        scan.read_files(spark, f"{files}/a.mrc").collect()
    monkeypatch.undo()
    with pytest.raises(ValueError, match="too many"):
        scan._row_bits(1 << 20)


def test_levels_and_document(spark, files):
    import json

    from leafmill import cli

    many = scan.from_bytes(spark, b"".join([GOOD, OTHER] * 200))
    sizes = []
    for level in (0, 1, 9):
        sinks.write_raw(many.coalesce(1), f"{files}/l{level}", "gzip", level=level)
        sizes.append(sum(os.path.getsize(f"{files}/l{level}/{f}") for f in os.listdir(f"{files}/l{level}") if f.endswith(".gz")))
    assert sizes[0] > sizes[1] > sizes[2]
    (files / "r.toml").write_text("[rule.R]\nmatcher = '052?'\nmessage = 'm'\n")
    for name in ("report.json", "report.gz"):
        assert cli.main(["check", f"{files}/a.mrc", "-R", str(files / "r.toml"), "-o", f"{files}/{name}"], spark) == 0
        with (gzip.open if name.endswith(".gz") else open)(files / name, "rt") as f:
            assert [r["position"] for r in json.load(f)["records"]] == [{"id": "2"}, {"id": "MP-4471"}]


def test_shell_files(tmp_path):
    import subprocess

    from leafmill import cli, shell

    for name in shell.SHELLS:
        assert cli.main(["build-completion", name, "-o", f"{tmp_path}/sub/{name}"]) == 0
        text = (tmp_path / "sub" / name).read_text()
        assert "frequency" in text and "ignore-case" in text
    assert subprocess.run(["bash", "-c", f". {tmp_path}/sub/bash; COMP_WORDS=(leafmill fre); COMP_CWORD=1; _leafmill; echo $COMPREPLY"], capture_output=True, text=True).stdout == "frequency\n"
    assert subprocess.run(["bash", "-c", f". {tmp_path}/sub/bash; COMP_WORDS=(leafmill grep --ig); COMP_CWORD=2; _leafmill; echo $COMPREPLY"], capture_output=True, text=True).stdout == "--ignore-case\n"
    assert cli.main(["build-man", "-o", f"{tmp_path}/man"]) == 0
    pages = sorted(os.listdir(tmp_path / "man"))
    assert "leafmill.1" in pages and "leafmill-grep.1" in pages and "\\-\\-ignore\\-case" in (tmp_path / "man" / "leafmill-grep.1").read_text()


def test_bytes_that_are_no_text(spark):
    raw = bytearray(OTHER)
    raw[raw.index("é".encode())] = 0xFF
    records = scan.from_bytes(spark, bytes(raw))
    from leafmill.operators import aggregates, records as ops

    assert [bytes(r.raw) for r in records.collect()] == [bytes(raw)]
    assert ops.partition(records, "052.a").first().value == "��" and aggregates.glimpse(records, "052.a").first()["values"] == ["��"]


def test_modes(spark, files):
    assert scan.read_files(spark, f"{files}/b.mrc", "PERMISSIVE").first().err == "invalid terminator"
    assert scan.read_files(spark, f"{files}/b.mrc", "DROPMALFORMED").count() == 0
    with pytest.raises(Exception, match="invalid record"):
        scan.read_files(spark, f"{files}/b.mrc").collect()


def test_round_trip(spark, files):
    records = scan.read_files(spark, f"{files}/a.mrc")
    assert [bytes(r.raw) for r in encode(records).orderBy("ord").collect()] == [OTHER, GOOD]
    out = f"{files}/out"
    sinks.write_raw(records, out)
    assert scan.read_files(spark, out).count() == 2
    long = scan.from_bytes(spark, OTHER).withColumn("fields", __import__("pyspark").sql.functions.expr("transform(fields, f -> named_struct('tag', f.tag, 'ind1', f.ind1, 'ind2', f.ind2, 'value', repeat('x', 20000), 'subfields', cast(null as array<struct<code:string,value:string>>)))"))
    assert encode(long, strict=False).first().raw is None
    with pytest.raises(Exception, match="too large"):
        encode(long).collect()


def test_not_utf8(spark):
    raw = OTHER.replace("é".encode(), b"\xff\xfe")
    row = scan.from_bytes(spark, raw).first()
    assert row.valid and bytes(row.raw) == raw


def run(spark, *args):
    return main([str(a) for a in args], spark)


def test_cli(spark, files, capsys, monkeypatch):
    a, out = files / "a.mrc", files / "res"
    assert run(spark, "count", a) == 0 and capsys.readouterr().out == "2\n"
    assert run(spark, "sel", "001,052.a", a, "-H", "cn,v", "-o", f"{out}.csv") == 0
    assert (files / "res.csv").read_text().splitlines()[0] == "cn,v" and len((files / "res.csv").read_text().splitlines()) == 4
    assert run(spark, "freq", "052.2", "-H", "code,n", a, "--tsv") == 0 and capsys.readouterr().out == "code\tn\ngrid\t3\n"
    assert run(spark, "filter", "001 == '2'", a, "-o", f"{out}.mrc") == 0 and (files / "res.mrc").read_bytes() == OTHER
    assert run(spark, "concat", a, "-o", f"{out}.mrc", "--append", "--tee", f"{out}.tee") == 0 and (files / "res.mrc").read_bytes() == OTHER + OTHER + GOOD == OTHER + (files / "res.tee").read_bytes()
    assert run(spark, "cat", a, "-o", f"{out}.mrc.gz") == 0 and gzip.open(f"{out}.mrc.gz").read() == OTHER + GOOD
    assert run(spark, "cat", a, "-a", "-o", f"{out}.mrc.gz") == 1
    assert run(spark, "partition", "052.2", a, "-o", files / "parts", "-t", "x-{}.mrc") == 0 and os.listdir(files / "parts") == ["x-grid.mrc"]
    assert run(spark, "split", 1, a, "-o", files / "chunks") == 0 and sorted(os.listdir(files / "chunks")) == ["0.mrc", "1.mrc"] and (files / "chunks/0.mrc").read_bytes() == OTHER
    assert run(spark, "print", a, "-l", "1", "-o", f"{out}.txt") == 0 and (files / "res.txt").read_text() == f"LDR {len(OTHER):05d}nz  a2200049   4500\n001 2\n052 $a é $2 grid\n\n"
    capsys.readouterr()
    assert run(spark, "grep", "Bælt", a, "-o", f"{out}.g") == 0 and (files / "res.g").read_bytes() == GOOD
    assert run(spark, "hash", a) == 0 and len(capsys.readouterr().out.splitlines()) == 3
    assert run(spark, "describe", a, "--where", "001 == '2'") == 0 and capsys.readouterr().out == "field,ind1,ind2,2,a\n052, , ,1,1\n"
    assert run(spark, "glimpse", "052.a", a) == 0 and capsys.readouterr().out == "$a é, 6920, 6924\n"
    assert run(spark, "dedup", a, a, "-o", f"{out}.d") == 0 and (files / "res.d").read_bytes() == OTHER + GOOD
    assert run(spark, "sample", 1, a, "-o", f"{out}.s") == 0 and (files / "res.s").read_bytes() in (OTHER, GOOD)
    assert run(spark, "invalid", files / "b.mrc", "-o", f"{out}.i") == 0
    (files / "r.toml").write_text("[rule.R]\nmatcher = '052?'\nmessage = 'm'\n")
    assert run(spark, "check", a, "-R", files / "r.toml") == 0 and capsys.readouterr().out == "cn,rule,level,message\n2,R,error,m\nMP-4471,R,error,m\n"
    (files / "s.toml").write_text("uri = { path = '001' }\n[concept.c]\nlabels = [{ kind = 'preferred', path = '052.a' }]\n")
    assert run(spark, "skosify", a, "-c", files / "s.toml", "-o", f"{out}.nt") == 0 and len((files / "res.nt").read_text().splitlines()) == 5
    assert run(spark, "count", files / "none.mrc") == 1 and run(spark, "count", files / "b.mrc") == 1 and run(spark, "count", "-s", files / "b.mrc") == 0
    assert run(spark, "filter", "nonsense", a) == 1
    capsys.readouterr()
    assert run(spark, "count", "-p", "-s", a, files / "b.mrc") == 0 and "records: 3, invalid: 1" in capsys.readouterr().err
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(GOOD)))
    capsys.readouterr()
    assert run(spark, "count") == 0 and capsys.readouterr().out == "1\n"


def test_stream(spark, files, tmp_path):
    records = stream_records(spark, str(files), 1)

    def result(frame, name, mode="append"):
        query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return sorted(map(tuple, spark.table(name).collect()))

    assert len(result(stream_select(records, "001, 052.a", "052?"), "s1")) == 7
    assert result(stream_frequency(records, "052.2", "code"), "s2", "complete") == [("grid", 7)]
    assert len(result(stream_dedup(records).select("ord"), "s3")) == 2


def test_objects(spark):
    from pyspark.sql import functions as F

    from leafmill.errors import InvalidRecordError
    from leafmill.sources import model
    from leafmill.sources.objects import Entry, Leader, Record, Subfield, directory

    record = Record.from_bytes(GOOD)
    assert record.control_number == b"MP-4471" and record.is_utf8() and str(record.leader).encode() == GOOD[:24]
    assert [f.tag for f in record.fields] == [line[:3] for line in CHART.split("\n")] and record.fields[9].subfields[0] == Subfield("a", b"Sound and Belt")
    assert not Record.from_bytes(OTHER.replace("é".encode(), b"\xff\xfe")).is_utf8()
    for err in BROKEN:
        for raw in BROKEN[err]:
            with pytest.raises(InvalidRecordError):
                Record.from_bytes(raw)
    for make, raw in ((Leader.from_bytes, b"x"), (Entry.from_bytes, b"001000000000"), (directory, b"\x1e"), (Subfield.from_bytes, b"\x1f?a")):
        with pytest.raises(InvalidRecordError):
            make(raw)
    leader = Leader.from_bytes(b"00100nam a2200049   4500")
    assert leader.is_bibliographic and leader.bibliographic_level == "m" and leader.type_of_control is None and leader.kind_of_data is None
    row = scan.from_bytes(spark, OTHER.replace(b"nz  a", b"nqb a") + OTHER.replace("é".encode(), b"\xff\xfe")).orderBy("ord")
    one, two = row.select(model.is_bibliographic(F.col("leader")), model.kind_of_data(F.col("leader")), model.bibliographic_level(F.col("leader")), model.type_of_control(F.col("leader")), model.is_community_information(F.col("leader")), model.is_utf8(F.col("fields"))).collect()
    assert tuple(one) == (False, "b", None, None, True, True) and two[5] is False
