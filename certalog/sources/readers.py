"""Readers of source packages: device XML, staged CSV, JSON and XML, archives, spreadsheets and pages."""

from __future__ import annotations

import csv
import io
import re
import tarfile
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Device records; identifiers are text so that leading zeros stay.
DEVICE = (
    "zxxsdycpbs string, zczbhhzbapzbh string, cpmctymc string, ggxh string, cpms string, flbm string, ylqxzcrbarmc string, bszt string, versionNumber string, "
    "packingList struct<packing: array<struct<bzcpbs: string, cpbzjb: string, bznhxyjcpbssl: string, bznhxyjbzcpbs: string>>>, "
    "storageList struct<storage: array<struct<cchcztj: string, zdz: string, zgz: string, jldw: string>>>"
)


def devices(spark: SparkSession, path: str) -> DataFrame:
    """One row a device element, with packings and storages as arrays of structs; numbers that don't parse are null."""
    raw = spark.read.format("xml").option("rowTag", "device").schema(DEVICE).load(path)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    packings = F.transform("packingList.packing", lambda x: F.struct(
        blank(x["bzcpbs"]).alias("package_di"), blank(x["cpbzjb"]).alias("package_level"), x["bznhxyjcpbssl"].try_cast("double").cast("int").alias("contains_qty"), blank(x["bznhxyjbzcpbs"]).alias("child_di")))
    number = lambda c: F.regexp_replace(c.try_cast("double").cast("string"), r"\.0$", "")

    def storage(x):
        low, high, unit = number(x["zdz"]), number(x["zgz"]), F.coalesce(blank(x["jldw"]), F.lit(""))
        spread = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("~"), high, unit)).otherwise(F.concat(F.coalesce(low, high), unit))
        return F.struct(blank(x["cchcztj"]).alias("type"), x["zdz"].try_cast("double").alias("min"), x["zgz"].try_cast("double").alias("max"), blank(x["jldw"]).alias("unit"), spread.alias("range"))

    return raw.withColumns({"packings": packings, "storages": F.transform("storageList.storage", storage)}).drop("packingList", "storageList")


def part_files(df: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of the files named PART<n>_Of_<m> with n from low to high."""
    n = F.regexp_extract(F.input_file_name(), r"PART(\d+)_Of_\d+", 1).try_cast("int")
    return df.where(n.between(low, high))


def staged(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON and device XML files below a folder as rows of text columns; columns that a file lacks are null.

    JSON files hold a list of records, one record, or records under the name rows; CSV files may begin with a byte-order mark. XML
    gives its flat elements only. Kinds that the folder doesn't have are left out; a folder of none gives no rows and no columns.
    """
    under = lambda kind: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
    found = []
    for kind in ("csv", "json", "xml"):
        if under(kind).format("binaryFile").load(path).select("path").isEmpty():
            continue
        if kind == "csv":
            df = under(kind).option("header", True).csv(path)
            df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
        elif kind == "json":
            df = under(kind).option("multiLine", True).option("primitivesAsString", True).json(path)
            if dict(df.dtypes).get("rows", "").startswith("array<struct"):
                inner = df.where("rows is not null").select(F.explode("rows").alias("r")).select("r.*")
                rest = df.where("rows is null").drop("rows")
                df = inner.unionByName(rest, allowMissingColumns=True) if rest.columns else inner
        else:
            raw = under(kind).format("xml").option("rowTag", "device").schema(DEVICE).load(path)
            df = raw.select(*[c for c, kind_ in raw.dtypes if kind_ == "string"])
        found.append(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]))
    out = spark.createDataFrame([], "") if not found else found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def loose_devices(spark: SparkSession, path: str) -> DataFrame:
    """(path, record): device records of XML files that a strict parser refuses, as maps of their flat elements by lower-case names.

    What lies between a device's tags is read element by element; packings and storages are left out.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    each = files.select(F.input_file_name().alias("path"), F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<device\b[^>]*>(.*?)(?=</device\s*>|<device\b|\z)"), F.lit(1))).alias("body"))
    flat = F.regexp_replace("body", r"(?is)<(packinglist|storagelist)\b.*?(</\1\s*>|\z)", "")
    names = F.regexp_extract_all(flat, F.lit(r"<([A-Za-z]\w*)\s*>([^<]*)"), F.lit(1))
    values = F.regexp_extract_all(flat, F.lit(r"<([A-Za-z]\w*)\s*>([^<]*)"), F.lit(2))
    entries = F.filter(F.arrays_zip(F.transform(names, lambda n: F.lower(n)).alias("k"), F.transform(values, lambda v: F.trim(v)).alias("v")), lambda x: x["v"] != "")
    first = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))
    return each.select("path", first.alias("record"))


#: How deep archives within archives are opened.
DEPTH = 4


def members(content: bytes, name: str, depth: int = DEPTH):
    """(name, bytes) of the files of an archive, told by its content, archives in it opened in turn; of no archive itself."""
    if depth and content[:4] in (b"PK\x03\x04", b"PK\x05\x06") and not name.endswith(".xlsx"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in sorted(z.namelist()):
                if not n.endswith("/"):
                    yield from members(z.read(n), f"{name}!{n}", depth - 1)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            files = sorted((m.name, t.extractfile(m).read()) for m in t if m.isfile()) if depth else None
    except tarfile.TarError:
        files = None
    if files is None:
        yield name, content
    else:
        for n, data in files:
            yield from members(data, f"{name}!{n}", depth - 1)


def archived_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content): the files of every archive below a folder, however nested; a file that is no archive is its own member."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for member, data in members(content, name.rsplit("/", 1)[-1]):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([data], pa.binary())], names=["path", "member", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def archived_csv(spark: SparkSession, path: str) -> DataFrame:
    """(member, row): the rows of the CSV files in archives, as maps by their header; bytes that are no UTF-8 are left out."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [[(k, v) for k, v in r.items() if k is not None] for r in csv.DictReader(io.StringIO(content.decode("utf-8-sig", "ignore")))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["member", "row"])

    files = archived_files(spark, path).where(F.lower("member").endswith(".csv"))
    return files.select("member", "content").mapInArrow(run, "member string, row map<string,string>")


def table_query(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, fetch: int = 5000, **options: str) -> DataFrame:
    """Rows of a query at a database, fetched some at a time; split by a key's bounds where they are given."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**options)
    if key is None or bounds is None:
        return reader.option("query", query).load()
    low, high = bounds
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def recent(df: DataFrame, hours: int, asof) -> DataFrame:
    """Rows updated in the hours before a time. The table must say when it was updated, which device and which registration a row is of."""
    missing = [" or ".join(names) for names in (("updated_at",), ("udi_di", "di"), ("reg_no", "registry_no")) if not set(names) & set(df.columns)]
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}")
    return df.where((F.col("updated_at") >= F.lit(asof) - F.expr(f"interval {int(hours)} hours")) & (F.col("updated_at") <= F.lit(asof)))


def hints(c: Column) -> Column:
    """(reg_no, approved, expires): the first certificate number and the first two dates of a page's text."""
    dates = F.regexp_extract_all(c, F.lit(r"(20\d\d-\d{1,2}-\d{1,2})"), F.lit(1))
    day = lambda i: F.try_to_date(F.get(dates, i), "yyyy-M-d")
    number = F.nullif(F.regexp_extract(c, r"([\u4e00-\u9fff]{1,2}械(?:注准|注进|注许|备)\s*\d{6,})", 1), F.lit(""))
    return F.struct(number.alias("reg_no"), day(0).alias("approved"), day(1).alias("expires"))


def sheet_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet of one workbook, by the header in its first row."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in x.iter(f"{space}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        first = sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]
        table = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{space}row"):
            cells = {}
            for c in row.iter(f"{space}c"):
                column = re.match("[A-Z]+", c.get("r", "A"))[0]
                value = c.find(f"{space}v")
                text = "".join(t.text or "" for t in c.iter(f"{space}t")) if value is None else value.text or ""
                cells[column] = strings[int(text)] if c.get("t") == "s" else text
            table.append(cells)
    if not table:
        return []
    return [{name: row.get(column, "") for column, name in table[0].items()} for row in table[1:]]


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, row): the rows of the first sheet of each workbook file, as maps."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [list(r.items()) for r in sheet_rows(content)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["path", "row"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, row map<string,string>")


def package_links(pages: DataFrame) -> DataFrame:
    """(name, url, md5): the package links of pages with the checksum that follows, the last one of each file name, newest name first.

    Pages come in the order of their page_id where they have one.
    """
    pattern = F.lit(r"(?is)href=[\"']([^\"']+\.zip)[\"'](?:(?!href=).)*?([0-9a-f]{32})")
    links, sums = (F.regexp_extract_all("html", pattern, F.lit(k)) for k in (1, 2))
    page = F.col("page_id") if "page_id" in pages.columns else F.lit(0)
    each = pages.select(page.alias("page"), F.posexplode(F.arrays_zip(links.alias("url"), sums.alias("md5"))).alias("pos", "x"))
    named = each.select(F.regexp_extract("x.url", r"([^/]+)$", 1).alias("name"), F.struct("page", "pos").alias("at"), "x.url", "x.md5")
    return named.groupBy("name").agg(F.max_by("url", "at").alias("url"), F.max_by("md5", "at").alias("md5")).orderBy(F.col("name").desc())
