import datetime
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from certalog.sources import readers
from certalog.streaming import ingest


def test_devices_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "PART1_Of_2.xml").write_text(
        "<root><device><zxxsdycpbs>001</zxxsdycpbs><ggxh>m</ggxh><packingList><packing><bzcpbs>010</bzcpbs><cpbzjb>box</cpbzjb><bznhxyjcpbssl>10</bznhxyjcpbssl></packing>"
        "<packing><bzcpbs>011</bzcpbs><bznhxyjcpbssl>x</bznhxyjcpbssl></packing></packingList>"
        "<storageList><storage><cchcztj>cool</cchcztj><zdz>2</zdz><zgz>8</zgz><jldw>℃</jldw></storage><storage><zgz>30</zgz><jldw>℃</jldw></storage></storageList></device></root>"
    )
    r = readers.devices(spark, str(tmp_path)).first()
    assert r.zxxsdycpbs == "001"
    assert [(p.package_di, p.package_level, p.contains_qty) for p in r.packings] == [("010", "box", 10), ("011", None, None)]
    assert [s.range for s in r.storages] == ["2~8℃", "30℃"]
    assert readers.part_files(readers.devices(spark, str(tmp_path)), 2, 3).count() == 0


def test_staged_mix_and_sheets(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    (tmp_path / "in" / "a.csv").write_text("code,name\n01,x\n")
    (tmp_path / "in" / "deep" / "b.json").write_text('[{"code": "02", "spec": "s"}, {"code": "03"}]')
    got = {(r.code, r.name, r.spec) for r in readers.staged(spark, str(tmp_path / "in")).collect()}
    assert got == {("01", "x", None), ("02", None, "s"), ("03", None, None)}
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "in" / "t.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>no</t></si><si><t>name</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>n</t></is></c></row></sheetData></worksheet>')
    assert [r.row for r in readers.sheets(spark, str(tmp_path / "in")).collect()] == [{"no": "7", "name": "n"}]


def test_package_links(spark):
    html = f'<a href="a.zip">a</a> {"0" * 32} <a href="b.zip">b</a> {"1" * 32} <a href="a.zip">a</a> {"2" * 32}'
    got = [(r.url, r.md5) for r in readers.package_links(spark.createDataFrame([(html,)], "html string")).collect()]
    assert got == [("b.zip", "1" * 32), ("a.zip", "2" * 32)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.event_stream(spark, str(tmp_path / "in"), events.schema)
    ingest.latest_state(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    version = sorted(os.listdir(tmp_path / "out"))[-1]
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out" / version)).collect()}
    want = {(r.user_id, r.event_id) for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()}
    assert got == want
    query = ingest.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()


def test_staged_of_any_kinds(spark, tmp_path):
    for kind, body in (("csv", "﻿code,name\n01,x\n"), ("json", '{"rows": [{"code": "02"}, {"code": "03"}]}'), ("xml", "<r><device><zxxsdycpbs>007</zxxsdycpbs></device></r>")):
        os.makedirs(tmp_path / kind)
        (tmp_path / kind / f"a.{kind}").write_text(body, encoding="utf-8")
    assert [(r.code, r.name) for r in readers.staged(spark, str(tmp_path / "csv")).collect()] == [("01", "x")]
    assert sorted(r.code for r in readers.staged(spark, str(tmp_path / "json")).collect()) == ["02", "03"]
    assert [r.zxxsdycpbs for r in readers.staged(spark, str(tmp_path / "xml")).collect()] == ["007"]
    assert readers.staged(spark, str(tmp_path)).count() == 4
    os.makedirs(tmp_path / "none")
    (tmp_path / "none" / "a.txt").write_text("x")
    assert readers.staged(spark, str(tmp_path / "none")).count() == 0


def test_malformed_devices(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><device><ZXXSDYCPBS>001</ZXXSDYCPBS><ggxh>a & b</ggxh><packingList><packing><bzcpbs>9</bzcpbs></packing></packingList></device><device><ggxh>open")
    got = [r.record for r in readers.loose_devices(spark, str(tmp_path)).collect()]
    assert got == [{"zxxsdycpbs": "001", "ggxh": "a & b"}, {"ggxh": "open"}]


def test_archives_in_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/b.csv", b"\xef\xbb\xbfcode,name\n01,\xffx\n")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        entry = tarfile.TarInfo("in.zip")
        entry.size = len(inner.getvalue())
        t.addfile(entry, io.BytesIO(inner.getvalue()))
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("x.tar", tar.getvalue())
        z.writestr("a.csv", "code,name\n02,y\n")
    (tmp_path / "plain.txt").write_text("no archive")
    got = {r.member for r in readers.archived_files(spark, str(tmp_path)).collect()}
    assert got == {"outer.zip!a.csv", "outer.zip!x.tar!in.zip!deep/b.csv", "plain.txt"}
    assert sorted(r.row["code"] + r.row["name"] for r in readers.archived_csv(spark, str(tmp_path)).collect()) == ["01x", "02y"]


def test_recent_rows_and_hints(spark):
    at = datetime.datetime(2001, 1, 4)
    df = spark.createDataFrame([(datetime.datetime(2001, 1, 1, 1), "d", "r"), (datetime.datetime(2000, 12, 1), "e", "s")], "updated_at timestamp, di string, reg_no string")
    assert [r.di for r in readers.recent(df, 72, at).collect()] == ["d"]
    with pytest.raises(ValueError, match="reg_no or registry_no"):
        readers.recent(df.drop("reg_no"), 72, at)
    page = spark.createDataFrame([("证号 国械注准20203400001 批准 2020-1-5 至 2025-01-04",)], "t string").select(readers.hints(F.col("t")).alias("h")).first().h
    assert (page.reg_no, page.approved, page.expires) == ("国械注准20203400001", datetime.date(2020, 1, 5), datetime.date(2025, 1, 4))


def test_package_links_by_file_name(spark):
    rows = [(2, f'<a href="/new/a.zip">a</a> {"3" * 32}'), (1, f'<a href="/old/a.zip">a</a> {"1" * 32}')]
    got = readers.package_links(spark.createDataFrame(rows, "page_id int, html string")).collect()
    assert [(r.name, r.url, r.md5) for r in got] == [("a.zip", "/new/a.zip", "3" * 32)]
