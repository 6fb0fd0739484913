"""From raw rows of any columns to normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.config import EtlConfig
from siltwork.functions.text import collapse_ws

# Names under which a field may arrive, best first.
TEXT_COLUMNS = ("text", "query_text", "message", "utterance", "request", "user_text", "question", "content", "msg", "query", "q")
TS_COLUMNS = ("ts", "timestamp", "time", "created_at", "datetime", "date", "dt")
USER_COLUMNS = ("user_id", "uid", "client_id", "cid", "user", "userid")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Column names trimmed and lower-cased; of names that then clash the first column stays."""
    seen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c.strip().lower(), i)
    unique = df.toDF(*[f"__sw_{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"__sw_{i}").alias(c) for c, i in seen.items()])


def _present(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names if n in df.columns]


def extract_text(df: DataFrame) -> Column:
    """First non-null text column of a row, or else its first string of five or more characters."""
    named = _present(df, TEXT_COLUMNS)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    long = [F.when(F.char_length(F.col(f"`{c}`")) >= 5, F.col(f"`{c}`")) for c in strings]
    return F.coalesce(*[c.cast("string") for c in named], *long, F.lit(None).cast("string"))


def extract_timestamp(df: DataFrame) -> Column:
    """First time column that has a value which parses."""
    return F.coalesce(*[c.try_cast("timestamp") for c in _present(df, TS_COLUMNS)], F.lit(None).cast("timestamp"))


def extract_user(df: DataFrame) -> Column:
    """First non-null user column, as a string."""
    return F.coalesce(*[c.cast("string") for c in _present(df, USER_COLUMNS)], F.lit(None).cast("string"))


def extract_metadata(df: DataFrame, taken: tuple[str, ...] = ()) -> Column:
    """All other columns with a value, as a map of strings (nested ones as JSON)."""
    skip = {*TEXT_COLUMNS, *TS_COLUMNS, *USER_COLUMNS, *taken}
    nested = (T.MapType, T.ArrayType, T.StructType)
    pairs = []
    for f in df.schema.fields:
        if f.name not in skip:
            col = F.col(f"`{f.name}`")
            pairs += [F.lit(f.name), F.to_json(col) if isinstance(f.dataType, nested) else col.cast("string")]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def process_records(df: DataFrame, *, row_id: str = "row_id", source: str | None = None, config: EtlConfig = EtlConfig()) -> DataFrame:
    """``row_id``, ``text``, ``ts``, ``user_id``, ``source``, ``metadata`` of the rows with a usable text.

    Texts have their white space collapsed; shorter ones than ``min_length`` go, longer ones than
    ``max_length`` are cut. Of equal texts the row of least ``row_id`` stays (null last). A null
    or empty text drops the row, also where a later column has one after an empty one. Unreadable
    times are null. An empty table gives an empty table.
    """
    df = normalise_headers(df)
    label = F.lit(source) if source is not None else (F.col("source") if "source" in df.columns else F.lit(None).cast("string"))
    text = F.substring(collapse_ws(extract_text(df)), 1, config.max_length)
    out = df.select(
        F.col(f"`{row_id}`").alias("row_id"), text.alias("text"), extract_timestamp(df).alias("ts"), extract_user(df).alias("user_id"),
        label.alias("source"), extract_metadata(df, (row_id, "source")).alias("metadata"),
    ).where(F.char_length("text") >= config.min_length)
    if config.deduplicate:
        out = keep_first(out, "text", "row_id")
    if config.max_rows is not None:
        out = out.orderBy(F.col("ts").asc_nulls_last(), "row_id").limit(config.max_rows)
    return out


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least ``order`` (null last) of each value of ``key``, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(F.col(order).isNull(), F.col(order)))
    return df.groupBy(key).agg(first.alias("__sw_row")).select(*[F.col(key) if c == key else F.col(f"__sw_row.`{c}`") for c in df.columns])


def etl_statistics(df: DataFrame, *, row_id: str = "row_id", config: EtlConfig = EtlConfig()) -> DataFrame:
    """One row: ``total``, ``processed``, ``filtered``, ``duplicates``."""
    df = normalise_headers(df)
    text = F.substring(collapse_ws(extract_text(df)), 1, config.max_length)
    good = F.when(F.char_length(text) >= config.min_length, text)
    counts = df.select(good.alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("t").alias("processed"),
        F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("filtered"),
        F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


def is_object_text(c: Column) -> Column:
    """Whether a text is one readable JSON object; null and broken texts are none."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def ingest_errors(lines: DataFrame, *, payload: str = "payload", file_id: str = "file_id") -> DataFrame:
    """``file_id``, ``n_lines``, ``n_errors``: lines of each file, and those that can't be read. Blank
    lines are skipped, not counted; lines without file count together."""
    text = F.col(f"`{payload}`")
    rows = lines.where(F.coalesce(F.trim(text) != "", F.lit(False)))
    return rows.groupBy(F.col(f"`{file_id}`").alias("file_id")).agg(F.count("*").alias("n_lines"), F.count_if(~is_object_text(text)).alias("n_errors"))
