"""Reading raw logs of several formats into DataFrames, and scans by time."""

from __future__ import annotations

import csv
import datetime
import io
import itertools
import os
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at the head of a file from which separator and encoding are told.
SNIFF_BYTES = 65_536
SEPARATORS = (",", ";", "\t", "|")


def detect_encoding(data: bytes) -> str:
    """utf-8 (with or without mark), windows-1251 or latin-1, the first that can read the bytes."""
    for name, codec in (("utf-8", "utf-8"), ("windows-1251", "cp1251")):
        try:
            data.decode(codec)
            return name
        except UnicodeDecodeError:
            continue
    return "iso-8859-1"


def detect_separator(text: str) -> str:
    """The first separator that gives the header more than one column, else what the sniffer says."""
    header = next(iter(io.StringIO(text)), "")
    for sep in SEPARATORS:
        if len(next(csv.reader([header], delimiter=sep), [])) > 1:
            return sep
    try:
        return csv.Sniffer().sniff(text).delimiter
    except csv.Error:
        return ","


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, wherever Hadoop can read it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readNBytes(SNIFF_BYTES))
    finally:
        stream.close()


def file_encodings(spark: SparkSession, path: str) -> dict[str, str]:
    """Encoding of each file that isn't empty, as ``detect_encoding`` tells it from all bytes.

    The files are read in parallel by lines: no character of the three encodings holds the byte
    of a line break unless it is one, so lines can be judged one by one.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    utf8 = F.is_valid_utf8("value")
    # 98 is the one byte that windows-1251 doesn't know; it may also stand in a line that is UTF-8.
    b98 = F.hex(F.col("value").cast("binary")).rlike("^(?:..)*?98")
    rows = lines.groupBy("file").agg(F.bool_and(utf8).alias("utf8"), F.bool_or(b98).alias("b98"))
    return {unquote(r["file"]): "utf-8" if r["utf8"] else "iso-8859-1" if r["b98"] else "windows-1251" for r in rows.collect()}


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """CSV with header, all columns strings; the encoding of each file is found out from all of it,
    the separator from its head. Files of one kind are read together, kinds are joined by name.

    Quoted values may hold line breaks (read as ``\\n``), so a file is read by one task. Where it is known that none
    does, ``multi_line=False`` splits files among tasks.
    """
    kinds: dict[tuple[str, str, str], list[str]] = {}
    for file, encoding in sorted(file_encodings(spark, path).items()):
        head = _head(spark, file).decode({"windows-1251": "cp1251", "iso-8859-1": "latin-1"}.get(encoding, "utf-8-sig"), errors="ignore")
        kinds.setdefault((encoding, detect_separator(head), next(iter(io.StringIO(head)), "")), []).append(file)
    if any(encoding == "windows-1251" for encoding, _, _ in kinds):
        # Spark reads charsets beyond its short list only under this setting.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    out = None
    for (encoding, sep, _), files in kinds.items() or {("utf-8", ",", ""): [path]}.items():
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]  # no patterns
        part = spark.read.csv(names, sep=sep, encoding=encoding, header=True, quote='"', escape='"', multiLine=multi_line)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or an object with them under data, records, items or rows."""
    df = spark.read.json(path, multiLine=True)
    for name in ("data", "records", "items", "rows"):
        if name in df.columns and df.schema[name].dataType.simpleString().startswith("array<struct"):
            return df.select(F.inline(F.col(name)))
    return df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped."""
    return spark.read.json(path, mode="DROPMALFORMED")


def read_queue(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Waiting rows of a queue of JSON lines, broken lines skipped; the first ``n`` of them (by file
    and place, the number is the feature)."""
    rows = read_jsonl(spark, path)
    return rows if n is None else rows.limit(n)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _texts(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_NS}t"))


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet of a workbook, as strings, row by row; its XML is read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as xml:
                for _, element in ElementTree.iterparse(xml):
                    if element.tag == f"{_NS}si":
                        shared.append(_texts(element))
                        element.clear()
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        if not sheets:
            return
        with book.open(min(sheets, key=lambda n: (len(n), n))) as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for c in row.findall(f"{_NS}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", "")).group() or "A":
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (at - 1 - len(cells))
                    v = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        cells.append(_texts(c))
                    elif v is None or v.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                row.clear()
                yield cells


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of an .xlsx file or a folder of them, wherever Hadoop can read them: the first row
    of the first file gives the columns, all of them strings; repeated and empty names get numbers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    first = files.orderBy("path").select("content").limit(1).collect()
    header = next(_sheet_rows(first[0]["content"]), []) if first else []
    names: list[str] = []
    for i, h in enumerate(header):
        name = (h or f"column_{i}").replace("`", "")
        names.append(name if name.lower() not in {x.lower() for x in names} else f"{name}_{i}")
    width = len(names)

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for content in frame.column(0):
                sheet = itertools.islice(_sheet_rows(content.as_py()), 1, None)
                while part := list(itertools.islice(sheet, 5000)):
                    cells = list(zip(*[(r + [None] * width)[:width] for r in part]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cells], names=names)

    if not names:
        return spark.createDataFrame([], "value string").drop("value")
    return files.select("content").mapInArrow(rows, ", ".join(f"`{n}` string" for n in names))


def read_any(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """By the ending of the path; an unknown one is a ValueError. ``multi_line`` is for CSV."""
    readers = {".csv": read_csv, ".json": read_json, ".jsonl": read_jsonl, ".xlsx": read_workbook, ".parquet": lambda s, p: s.read.parquet(p)}
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending not in readers:
        raise ValueError(f"no reader for {ending or path}")
    return read_csv(spark, path, multi_line=multi_line) if ending == ".csv" else readers[ending](spark, path)


def recent(df: DataFrame, at: str, *, as_of: datetime.datetime, days: int = 7, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the last days, newest first; the filters reach the scan. A limit is the caller's."""
    out = df.where(F.col(at) >= F.lit((as_of - datetime.timedelta(days=days)).replace(hour=0, minute=0, second=0, microsecond=0)))
    if where is not None:
        out = out.where(where)
    return out.orderBy(F.desc(at)).limit(limit) if limit is not None else out


def between(df: DataFrame, at: str, start: datetime.datetime, end: datetime.datetime) -> DataFrame:
    """Rows with ``start <= at < end``."""
    return df.where((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end)))


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, lower: str = "", upper: str = "", partitions: int = 16, **options: str) -> DataFrame:
    """A remote table; with a column to partition by it is read in parallel. Filters, columns and
    limits on the result are pushed to the server."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("pushDownLimit", "true").options(**options)
    if partition_column is not None:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()
