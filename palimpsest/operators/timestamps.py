"""Dates and times written as text, in mixed notations, precisions and zones, to one normal form.

The work is a cascade in the JVM: each step is one anchored pattern over text that earlier steps have
rewritten, so no step sees what another has claimed. First every complete date becomes a marker
``<yyyy~mm~dd>``; then the time and zone beside the only marker are read; then the calendar and the
zone rules decide. A value with no date, with two different dates, or with an impossible date or time has no normal form.

Policy for local times: one that occurs twice is the first of the two; one that is skipped is read
with the offset in force before the change. A zone or offset in the value comes before the zone of
the source. A word with a slash that isn't the name of a zone, such as a place or a department, says
nothing about the zone: the zone of the source holds. An offset out of range makes the value unreadable.
Bare numbers of 9 digits or more are Unix times up to the end of 2099; larger ones are taken for
numbers of other kinds and have no normal form.
"""

from __future__ import annotations

import datetime
import re
import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and their common short forms (English, German, Spanish, French, Portuguese, Italian).
MONTH_NAMES: dict[int, str] = {
    1: "january jan januar jänner enero ene janvier janv janeiro gennaio gen",
    2: "february feb februar febrero février févr fév fevereiro fev febbraio",
    3: "march mar märz mär marzo mars março",
    4: "april apr abril abr avril avr aprile",
    5: "may mai mayo maio maggio mag",
    6: "june jun juni junio juin junho giugno giu",
    7: "july jul juli julio juillet juil julho luglio lug",
    8: "august aug agosto ago août aout",
    9: "september sep sept septiembre septembre setembro set settembre",
    10: "october oct oktober okt octubre octobre outubro out ottobre ott",
    11: "november nov noviembre novembre novembro",
    12: "december dec dezember dez diciembre dic décembre déc dezembro dicembre",
}
MONTH_OF = {name: number for number, names in MONTH_NAMES.items() for name in names.split()}
_MONTH = "(" + "|".join(sorted(MONTH_OF, key=lambda x: (-len(x), x))) + ")"

# Signs that stand for an ASCII one.
WIDE = {"：": ":", "／": "/", "－": "-", "．": ".", "，": ",", "＋": "+", "（": "(", "）": ")", "［": "[", "］": "]", "–": "-", "—": "-", "−": "-"}
_SPACES = "                 　"

DATE_ORDERS = ("dmy", "mdy", "ymd")

_ORD = r"(?:st|nd|rd|th|º|ª|er|\.)?"
_OF = r"(?:of |de |di |do |den )?"
#: Patterns of complete dates, in order, and what each becomes (over text that is lower-cased, with single spaces).
_DATES: list[tuple[str, str]] = [
    (r"(?<!\d)(\d{4}) ?年 ?(\d{1,2}) ?月 ?(\d{1,2}) ?日", "<$1~$2~$3>"),
    (r"(?<![\d.~/:+-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?=t\d|(?![\d~/]|[-.]\d))", "<$1~$3~$4>"),
    (r"(?<![\d.~/:+-])(\d{4})(\d{2})(\d{2})(?=t\d{4,6}|(?![\d~/:-]|[.,]\d))(?!\d)", "<$1~$2~$3>"),
    (rf"(?<![\d.~/:-])(\d{{1,2}}){_ORD}[ -]{_OF}{_MONTH}\.?,?[ -]{_OF}(\d{{4}})(?!\d|[-/.]\d)", "<$3~$2~$1>"),
    (rf"(?<![\p{{L}}\d]){_MONTH}\.?[ -](\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?!\d|[-/.]\d)", "<$3~$1~$2>"),
    (rf"(?<![\d.~/:-])(\d{{4}})[ -]{_MONTH}\.?[ -](\d{{1,2}})(?!\d|[-/.]\d)", "<$1~$2~$3>"),
]
_NUMERIC = r"(?<![\d.~/:+-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?=t\d|(?![\d~/:]|[-.]\d))"
_NUMERIC_AS = {"dmy": "<$4~$3~$1>", "mdy": "<$4~$1~$3>"}
_SHORT_YMD = r"(?<![\d.~/:+-])(\d{2})([-/.])(\d{1,2})\2(\d{1,2})(?=t\d|(?![\d~/:]|[-.]\d))"

_MARK = r"<(\d{2}|\d{4})~([^~<>]{1,12})~(\d{1,2})>"
_ZONE = (
    r"(?:(?<zr>[\[(]?[a-z]+(?:/[a-z_+-]+\d{0,2}){1,2}[\])]?)"
    r"|(?<zu>utc|gmt) ?(?<zs>[+-]\d{1,2}(?::?\d{2})?)?(?![\p{L}\d:])|(?<zo>[+-]\d{2}(?::?\d{2})?)(?![\p{L}\d:])|(?<za>z|[a-z]{2,5})(?![\p{L}\d/]))"
)
_CLOCK = r"(\d{1,2})(?:(?::| ?[时時] ?)(\d{2})(?::(\d{2})(?:[.,](\d+))?)?分?(?: ?([ap])\.? ?m\b\.?)?| ?([ap])\.? ?m\b\.?)"
#: Beside the marker: after it, or before it.
_AFTER = rf"{_MARK}(?:t|[, ] ?(?:\(?[\p{{L}}]{{2,10}}\.?\)?,? )?(?:at |um |a las |à |às )?|,| ?\([\p{{L}}]+\) ?|(?=\d{{1,2}} ?[时時]))(?:{_CLOCK}(?![\d:])(?: uhr)?|(\d{{2}})(\d{{2}})(\d{{2}})?(?![\d:]))"
_BEFORE = rf"(?<![\d:.]){_CLOCK}(?: uhr)? ?(?<z>[^\d<>]{{0,30}}?) ?(?:on |am |,)? ?(?:[\p{{L}}]{{2,10}}\.?,? )?(?:the |den )?{_MARK}"


def _plain(text: Column) -> Column:
    """Lower case, ASCII digits and signs, single spaces."""
    digits = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0x0660 + i) for i in range(10))
    out = F.translate(text, digits + "".join(WIDE) + _SPACES, "0123456789" * 2 + "".join(WIDE.values()) + " " * len(_SPACES))
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(out, r"[​-‏﻿⁠<>~\u0001]", ""), r"\s+", " ")))


def _marked(plain: Column, date_order: Column) -> Column:
    """Every complete date as a marker."""
    out = plain
    for pattern, to in _DATES:
        out = F.regexp_replace(out, pattern, to)
    return (
        F.when(date_order == "dmy", F.regexp_replace(out, _NUMERIC, _NUMERIC_AS["dmy"]))
        .when(date_order == "mdy", F.regexp_replace(out, _NUMERIC, _NUMERIC_AS["mdy"]))
        .otherwise(F.regexp_replace(F.regexp_replace(out, _SHORT_YMD, "<$1~$3~$4>"), _NUMERIC, _NUMERIC_AS["dmy"]))
    )


def _groups(text: Column, pattern: str, groups: list[str]) -> Column:
    """The groups of the first match, as an array; null where there is none."""
    whole = F.regexp_replace(text, "(?s)^.*?" + pattern + ".*$", "\u0001" + "\u0001".join(groups))
    return F.when(F.startswith(whole, F.lit("\u0001")), F.split(whole, "\u0001"))


@cache
def _zone_ids() -> dict[str, str]:
    """Names of zones with an area, by their lower-case form."""
    return {z.lower(): z for z in sorted(zoneinfo.available_timezones()) if "/" in z and z.split("/")[0] not in ("posix", "right", "SystemV")}


@cache
def _abbreviations(zone: str) -> dict[str, str]:
    """The offsets that the zone's own abbreviations stand for, as they were in use around 2020."""
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return {}
    out = {}
    for month in range(1, 13):
        at = datetime.datetime(2022, month, 15, 12, tzinfo=tz)
        name, minutes = at.tzname() or "", round(at.utcoffset().total_seconds() / 60)
        if re.fullmatch("[A-Za-z]{2,5}", name):
            out[name.lower()] = f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
    return out


# Usual abbreviations of zones whose time zone data only has numbers for them.
EXTRA_ABBREVIATIONS = {
    "America/Bogota": {"cot": "-05:00"},
    "America/Sao_Paulo": {"brt": "-03:00"},
    "America/Argentina/Buenos_Aires": {"art": "-03:00"},
    "Asia/Kathmandu": {"npt": "+05:45"},
    "Asia/Dubai": {"gst": "+04:00"},
    "Asia/Singapore": {"sgt": "+08:00"},
}


def zone_lookup(samples: DataFrame) -> DataFrame:
    """``sample_id, _zone, _order, _abbr``: per source the default zone, the order of numeric dates and
    the zone's abbreviations. One row per sample; an unknown zone is null. What is collected are distinct
    names of the public zone table, some hundreds at most."""
    spark = samples.sparkSession
    zones = [r[0] for r in samples.where(F.lower("time_zone").isin(*_zone_ids(), "utc", "gmt")).select("time_zone").distinct().collect()]
    known = {z: _zone_ids().get(z.lower(), z.upper() if z.lower() in ("utc", "gmt") else None) for z in zones}
    rows = [(z, k, _abbreviations(k) | EXTRA_ABBREVIATIONS.get(k, {})) for z, k in known.items() if k]
    abbr = spark.createDataFrame(rows, "time_zone string, _zone string, _abbr map<string,string>")
    return (
        samples.select("sample_id", "time_zone", F.lower("date_order").alias("_order"))
        .where("sample_id is not null")
        .dropDuplicates(["sample_id"])
        .join(abbr, "time_zone", "left")
        .drop("time_zone")
    )


def _iso(us: str) -> Column:
    """Microseconds since 1970-01-01 UTC as an instant with milliseconds, whatever the session's zone."""
    text = F.expr(f"cast(timestampadd(MICROSECOND, `{us}`, timestamp_ntz'1970-01-01 00:00:00') as string)")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), F.lpad(F.expr(f"cast(pmod(`{us}`, 1000000) div 1000 as string)"), 3, "0"), F.lit("Z"))


def normalize(values: DataFrame, value: str, zone: str, order: str, abbreviations: str, out: str = "normal_form") -> DataFrame:
    """``values`` with the column ``out`` added: ``yyyy-MM-dd`` for a date, ``yyyy-MM-ddTHH:mm:ss.SSSZ`` for
    an instant in UTC, null for a value that states no complete, existing date or more than one.

    ``zone`` is the default zone of the row (null: times without a zone have no normal form),
    ``order`` the order of numeric dates that do not begin with a four-digit year, ``abbreviations``
    a map from the zone's abbreviations to offsets. Two-digit years are 20xx. A bare number of 8
    digits is a date; of 9 to 11, 12 to 14, 15 to 17 or 18 to 20 digits a Unix time in seconds,
    milliseconds, microseconds or nanoseconds. Null and blank values are null. Times beside the same date stated twice count if they agree.
    """
    x = values.withColumn("_plain", _plain(F.col(value)))
    x = x.withColumn("_marked", _marked(F.col("_plain"), F.coalesce(F.col(order), F.lit("dmy"))))
    x = x.withColumn("_dates", F.array_distinct(F.regexp_extract_all("_marked", F.lit(_MARK), 0)))
    one = F.size("_dates") == 1
    mark = [F.regexp_extract(F.get("_dates", F.lit(0)), _MARK, i) for i in (1, 2, 3)]
    # Groups after the marker: 4 hour, 5 minute, 6 second, 7 fraction, 8/9 am or pm, 10-12 basic form.
    after = _groups(F.col("_marked"), _AFTER + rf"(?: ?{_ZONE})?", ["$4", "$5", "$6", "$7", "$8$9", "$10", "$11", "$12", "${zr}", "${zu}", "${zs}", "${zo}", "${za}"])
    before = _groups(F.col("_marked"), _BEFORE, ["$1", "$2", "$3", "$4", "$5$6", "", "", "", "", "", "", "", "${z}"])
    x = x.withColumn("_clock", F.when(one, F.coalesce(after, before)))
    part = lambda i: F.nullif(F.get("_clock", F.lit(i)), F.lit(""))
    month_map = F.create_map(*[F.lit(v) for pair in MONTH_OF.items() for v in pair])
    zones = F.create_map(*[F.lit(v) for pair in _zone_ids().items() for v in pair])
    number = lambda c: c.try_cast("int")
    x = x.select(
        "*",
        number(mark[0]).alias("_y0"),
        F.when(one, F.coalesce(number(mark[1]), F.try_element_at(month_map, mark[1]))).alias("_mo"),
        number(mark[2]).alias("_d"),
        number(F.coalesce(part(1), part(6))).alias("_h0"),
        number(F.coalesce(part(2), part(7), F.lit("0"))).alias("_mi"),
        number(F.coalesce(part(3), part(8), F.lit("0"))).alias("_s"),
        F.rpad(F.substring(F.coalesce(part(4), F.lit("0")), 1, 3), 3, "0").alias("_ms"),
        part(5).alias("_half"),
        F.regexp_replace(part(9), r"[\[\]()]", "").alias("_region"),
        part(10).alias("_utc"),
        F.coalesce(part(11), part(12)).alias("_off"),
        part(13).alias("_word"),
    )
    x = x.withColumn("_y", F.when(F.col("_y0") < 100, F.col("_y0") + 2000).otherwise(F.col("_y0")))
    half, h0 = F.col("_half"), F.col("_h0")
    hour = F.when(half.isNull(), h0).when(h0.between(1, 12), h0 % 12 + F.when(half == "p", 12).otherwise(0))
    off = F.regexp_extract("_off", r"^([+-])(\d{1,2}):?(\d{2})?$", 1)
    off_h, off_m = (F.regexp_extract("_off", r"^([+-])(\d{1,2}):?(\d{2})?$", i) for i in (2, 3))
    offset = F.concat(off, F.lpad(off_h, 2, "0"), F.lit(":"), F.when(off_m == "", "00").otherwise(off_m))
    offset = F.when((number(off_h) <= 14) & (F.coalesce(number(off_m), F.lit(0)) < 60), offset)
    word = F.coalesce(F.col("_word"), F.lit(""))
    named = F.when(word.isin("z", "utc", "gmt"), F.lit("+00:00")).otherwise(F.try_element_at(F.col(abbreviations), word))
    zone_of_value = (
        F.when(F.col("_region").isNotNull(), F.coalesce(F.try_element_at(zones, F.col("_region")), F.col(zone)))
        .when(F.col("_off").isNotNull(), offset)
        .when(F.col("_utc").isNotNull(), F.lit("+00:00"))
        .otherwise(F.coalesce(named, F.col(zone)))
    )
    x = x.withColumn("_hour", hour).withColumn("_in_zone", zone_of_value)
    day = F.try_make_timestamp("_y", "_mo", "_d", F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    second = (F.col("_s").cast("decimal(8,6)") + F.col("_ms").cast("decimal(9,6)") / 1000).cast("decimal(8,6)")
    valid_clock = F.col("_hour").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    instant = F.when(valid_clock & F.col("_in_zone").isNotNull(), F.try_make_timestamp("_y", "_mo", "_d", "_hour", "_mi", second, "_in_zone"))
    # Bare numbers.
    bare = F.when(F.col("_plain").rlike(r"^\d{9,20}$"), F.col("_plain").cast("decimal(20,0)"))
    digits = F.length("_plain")
    millis = (
        F.when(digits <= 11, bare * 1000)
        .when(digits <= 14, bare)
        .when(digits <= 17, F.floor(bare / 1000))
        .otherwise(F.floor(bare / 1000000))
    ).try_cast("bigint")
    unix = F.when(F.col("_plain").rlike(r"^\d{9,20}$") & (millis < 4102444800000), F.timestamp_millis(millis))
    ok = one & day.isNotNull() & (F.col("_y") >= 1)
    has_unix = unix.isNotNull() & (F.size("_dates") == 0)
    timed = ok & F.col("_clock").isNotNull()
    x = x.withColumn("_us", F.unix_micros(F.when(has_unix, unix).when(timed, instant)))
    form = F.when(F.col("_us").isNotNull(), _iso("_us")).when(ok & ~timed, F.format_string("%04d-%02d-%02d", "_y", "_mo", "_d"))
    # The generator keeps a filter on the result from being moved, with a copy of the whole cascade, below it.
    return x.select(*values.columns, F.explode(F.array(form)).alias(out))


def stated_times(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """The values to normalise: ``record_id, field_name, sample_id, value``. Repeated rows count once;
    null values and records without an id are left out."""
    a = mentions.select(F.col("mention_id").alias("record_id"), F.lit("session_date").alias("field_name"), "sample_id", F.col("session_date").alias("value"))
    b = facts.where("time_info is not null").select(
        F.col("fact_id").alias("record_id"), "sample_id",
        F.explode(F.create_map(F.lit("original_text"), F.col("time_info.original_text"), F.lit("absolute_date"), F.col("time_info.absolute_date"))).alias("field_name", "value"),
    )
    return a.unionByName(b).where("value is not null and record_id is not null").dropDuplicates(["record_id", "field_name"])


def normal_times(mentions: DataFrame, facts: DataFrame, samples: DataFrame) -> DataFrame:
    """``record_id, field_name, sample_id, value, normal_form`` of every stated value; ``normal_form`` is null
    where the value states no single complete date."""
    values = stated_times(mentions, facts).join(zone_lookup(samples), "sample_id", "left")
    return normalize(values, "value", "_zone", "_order", "_abbr").select("record_id", "field_name", "sample_id", "value", "normal_form")
