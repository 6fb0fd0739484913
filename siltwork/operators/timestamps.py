"""Mixed timestamp notations and time zones, brought to one UTC instant.

An ordered cascade of anchored patterns: the first that matches the whole (stripped) value
decides how it is read, and reading is strict (a month 13, a 30 February or a minute 61 give
null, never a shifted date). Everything is a Catalyst expression; the only join is the lookup
of the zone of a source, broadcast where its size is proven small.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.text import strip_ws
from siltwork.session import bounded_broadcast

# Minutes east of UTC of the zone abbreviations that are read.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "SAMT": 240, "YEKT": 300, "IST": 330,
    "OMST": 360, "NOVT": 420, "KRAT": 420, "IRKT": 480, "JST": 540, "YAKT": 540, "VLAT": 600,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
}

# Beginnings of month names (English, Russian nominative and genitive).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6,
    "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12,
}

_ZONE = r"(?: ?(Z|[A-Z]{2,4}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?)(?:\[[\w/+-]+\])?)?"
_CLOCK = r"(\d{1,2}:\d{2})(:\d{2})?(?:[.,](\d{1,9}))?(?: ?([AaPp][Mm]))?"
_TAIL = "T$4$5.$6|$7|$8"

#: (pattern, order): a value is rewritten to year-month-dayThour:minute:second.fraction|half|zone.
#: In slash dates, whose order the source decides, DAY and MONTH stand for the groups.
CASCADE: list[tuple[str, str]] = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK}{_ZONE}$", f"$1-$2-$3{_TAIL}"),
    (r"^(\d{4})-(\d{2})-(\d{2})$", "$1-$2-$3T.||"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_CLOCK}{_ZONE})?$", f"$3-$2-$1{_TAIL}"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2}})(?:,? {_CLOCK}{_ZONE})?$", f"20$3-$2-$1{_TAIL}"),
    (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(Z?)$", "$1-$2-$3T$4:$5:$6.||$7"),
    (rf"^(\d{{4}})/(\d{{2}})/(\d{{2}})(?:[T ]{_CLOCK}{_ZONE})?$", f"$1-$2-$3{_TAIL}"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK}{_ZONE})?$", f"$3-MONTH-DAY{_TAIL}"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{2}})(?:,? {_CLOCK}{_ZONE})?$", f"20$3-MONTH-DAY{_TAIL}"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3T.||"),
]
_NAME = r"(\p{L}{3})\p{L}{0,7}"
#: The same for dates with a month's name, whose number is put in afterwards.
NAMED: list[tuple[str, str]] = [
    (rf"^(?:\p{{L}}{{2,9}}, )?(\d{{1,2}}) {_NAME}\.? (\d{{4}})(?: г\.?)?(?:,? {_CLOCK}{_ZONE})?$", f"$3-$2-$1{_TAIL}"),
    (rf"^{_NAME}\.? (\d{{1,2}}), (\d{{4}})(?:,? {_CLOCK}{_ZONE})?$", f"$3-$1-$2{_TAIL}"),
]
_EPOCH = r"^(\d{10}(?:\.\d{1,9})?|\d{13}|\d{16})$"
_SHEET = r"^\d{5}(?:\.\d{1,12})?$"
_SHEET_ZERO = 25_569  # days from 1899-12-30 to 1970-01-01
_HALF_DAY_US = 43_200_000_000
#: Lengths by which clocks are set back in the IANA data since 1970.
_SET_BACK_MINUTES = (60, 30, 20, 120, 180, 1440)


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def _rewritten(t: Column, day_first: Column) -> Column:
    """The value in the one order that the cast reads, with half and zone behind, or null."""
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for pattern, order in CASCADE:
        read = lambda day, month, p=pattern, o=order: F.regexp_replace(t, p, o.replace("DAY", day).replace("MONTH", month))
        out = out.when(
            t.rlike(pattern),
            F.when(day_first, read("$1", "$2")).otherwise(read("$2", "$1")) if "DAY" in order else read("", ""),
        )
    letters = t.rlike(r"^(?:\p{L}{2,9}, )?\d{1,2} \p{L}|^\p{L}")
    for pattern, order in NAMED:
        read = F.regexp_replace(t, pattern, order)
        number = _lookup(MONTHS, F.lower(F.substring_index(F.substring_index(read, "-", 2), "-", -1)))
        out = out.when(
            letters & t.rlike(pattern),
            F.concat(F.substring_index(read, "-", 1), F.lit("-"), number.cast("string"), F.regexp_replace(read, r"^\d+-[^-]+", "")),
        )
    return out


def normalise_timestamps(
    df: DataFrame,
    zones: DataFrame,
    *,
    ts_col: str = "ts",
    source_col: str = "source",
    out_col: str = "ts_us",
    default_zone: str = "UTC",
    default_day_first: bool = True,
    ambiguous: str = "first",
    nonexistent: str = "shift_forward",
    max_zone_rows: int = 100_000,
) -> DataFrame:
    """Add ``out_col``: the instant of ``ts_col`` as microseconds since 1970-01-01 UTC.

    ``zones`` has ``source``, ``tz`` (IANA name) and ``day_first``; it gives the zone of values
    without one and the order of slash dates. A source that is null, not listed, listed without
    zone or with one that doesn't exist takes ``default_zone``. Repeated rows of one source in
    ``zones`` count once (least zone).

    Policies: ``ambiguous`` is ``first``, ``last`` or ``null`` for a wall-clock time that occurs
    twice; ``nonexistent`` is ``shift_forward`` (by the length of the gap) or ``null`` for one
    that is skipped.

    Cases: null, empty, blank and unreadable values, and those naming no existing date and time
    (24:00 and second 60 included), give null. An offset in the value outweighs a zone name in
    brackets. Digits beyond microseconds are cut off; a spreadsheet day number is rounded to the
    second and is wall-clock time. Repeated rows are all kept, other columns pass through, a
    column already called ``out_col`` is replaced; an empty table gives an empty table.
    """
    if ambiguous not in ("first", "last", "null") or nonexistent not in ("shift_forward", "null"):
        raise ValueError("unknown policy")
    known = sorted(available_timezones())
    side = (
        zones.where(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("__sw_source"))
        .agg(
            F.min(F.when(F.col("tz").isin(known), F.col("tz"))).alias("__sw_tz"),
            F.min(F.col("day_first")).alias("__sw_day_first"),
        )
    )
    kept = [c for c in df.columns if c != out_col]
    joined = df.join(bounded_broadcast(side, max_zone_rows), df[source_col] == F.col("__sw_source"), "left")

    day_first = F.coalesce(F.col("__sw_day_first"), F.lit(default_day_first))
    step = joined.withColumn("__sw_t", strip_ws(F.col(ts_col)))
    t = F.col("__sw_t")
    step = step.withColumn("__sw_parts", F.split(_rewritten(t, day_first), r"\|"))
    part = lambda i: F.get(F.col("__sw_parts"), F.lit(i))

    # A date alone means 00:00; absent seconds and fractions are zero.
    clock = F.regexp_replace(part(0), r"\.$", ".0")
    clock = F.regexp_replace(F.regexp_replace(clock, r"T\.", "T00:00:00."), r"(T\d{1,2}:\d{2})\.", "$1:00.")
    readable = clock.rlike(r"T(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d\.\d+$")
    fields_us = F.unix_micros(F.when(readable, F.concat(clock, F.lit("Z")).try_cast("timestamp")))
    whole = t.rlike(r"^\d+$")
    epoch = (
        F.when(whole & (F.length(t) == 16), t.cast("long"))
        .when(whole & (F.length(t) == 13), t.cast("long") * 1000)
        .otherwise(F.floor(t.cast("decimal(19,9)") * 1_000_000).cast("long"))
    )
    sheet_us = (F.round(t.cast("decimal(28,12)") * 86_400, 0).cast("long") - _SHEET_ZERO * 86_400) * 1_000_000
    zone = F.regexp_replace(part(2), r"^(UTC|GMT)(?=[+-])|:", "")
    digits = F.rpad(F.substring(zone, 2, 4), 4, "0").cast("int")
    minutes = F.floor(digits / 100) * 60 + digits % 100
    offset = F.when(
        zone.rlike(r"^[+-](?:0\d|1[0-8])(?:[0-5]\d)?$"), F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    ).when(~zone.rlike("^[+-]"), _lookup(ZONE_MINUTES, zone))

    step = (
        step.withColumn("__sw_epoch", F.when(t.rlike(_EPOCH), epoch))
        .withColumn("__sw_wall", F.when(t.rlike(_SHEET), sheet_us).otherwise(fields_us))
        .withColumn("__sw_hour", F.regexp_extract(part(0), r"T(\d{1,2}):", 1))
        .withColumn("__sw_half", F.upper(part(1)))
        .withColumn("__sw_zoned", F.coalesce(part(2), F.lit("")) != "")
        .withColumn("__sw_offset", offset)
    )
    hour, half = F.col("__sw_hour"), F.coalesce(F.col("__sw_half"), F.lit(""))
    in_half = F.when(half == "", 0).when(
        hour.rlike("^(0?[1-9]|1[0-2])$"),
        F.when((half == "PM") & (hour != "12"), _HALF_DAY_US).when((half == "AM") & (hour == "12"), -_HALF_DAY_US).otherwise(0),
    )
    step = step.withColumn("__sw_wall", F.col("__sw_wall") + in_half)
    wall = F.col("__sw_wall")
    tz = F.coalesce(F.col("__sw_tz"), F.lit(default_zone))
    utc = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), tz))
    back = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), tz))
    local = utc
    if nonexistent == "null":
        local = F.when(back(utc) == wall, local)
    if ambiguous != "first":
        later = F.coalesce(
            *[F.when(back(utc + m * 60_000_000) == wall, utc + m * 60_000_000) for m in _SET_BACK_MINUTES]
        )
        local = F.coalesce(later, local) if ambiguous == "last" else F.when(later.isNull(), local)
    instant = F.coalesce(
        F.col("__sw_epoch"),
        F.when(F.col("__sw_zoned"), wall - F.col("__sw_offset").cast("long") * 60_000_000).otherwise(local),
    )
    # Through explode, so that a filter on the result isn't rewritten in terms of the whole cascade.
    return step.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(instant)).alias(out_col))
