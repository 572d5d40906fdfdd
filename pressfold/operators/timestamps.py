"""Publication times in any common notation, as one instant in UTC.

Each text is reduced to a mask of character classes of the same length: a
digit is 9, a letter of a known word the class of that word (M month, D
weekday, V unit by the calendar, N word for a time near the crawl, P half of the day, Z abbreviation of a zone, R name of a zone, U unit,
G "ago"), other letters w. A mask is mapped to its parser once in a worker:
the places of year, month, day, hour and so on, which are the same for all
texts of the mask. All texts of a mask are then cut and converted as one array.

Defined results:
* null, empty, meaningless and impossible values give no row;
* a date alone is midnight; digits finer than milliseconds are dropped;
* a zone in the text holds, else the source's; without either there is no row;
* relative times count back from the time of the crawl, and give no row without it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.functions.zones import wall_to_utc

# Words of dates.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTH_NUMBER = {name: k for k, name in enumerate(MONTHS, 1)} | {name[:3]: k for k, name in enumerate(MONTHS, 1)} | {"sept": 9}
WEEKDAY_WORDS = {*WEEKDAYS, *(name[:3] for name in WEEKDAYS), "tues", "thur", "thurs"}
HALF_DAY = {"am": 0, "pm": 12, "오전": 0, "오후": 12}
# Abbreviations of zones and their minutes east of UTC.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "cet": 60, "cest": 120, "eet": 120, "eest": 180, "bst": 60, "kst": 540, "jst": 540, "aest": 600, "aedt": 660,
}
# Units of relative times, in seconds.
UNIT_SECONDS = {
    "second": 1, "seconds": 1, "sec": 1, "secs": 1, "초": 1,
    "minute": 60, "minutes": 60, "min": 60, "mins": 60, "분": 60,
    "hour": 3600, "hours": 3600, "hr": 3600, "hrs": 3600, "시간": 3600,
    "day": 86400, "days": 86400, "일": 86400,
    "week": 604800, "weeks": 604800, "주": 604800,
}
# Units by the calendar, in months, and words for times near the crawl, in seconds before it.
UNIT_MONTHS = {"month": 1, "months": 1, "개월": 1, "달": 1, "year": 12, "years": 12, "년": 12}
NEAR = {"yesterday": 86400, "어제": 86400, "그저께": 172800, "방금": 0}
AGO = {"ago", "전"}

_TOKEN = re.compile(r"\d+|[A-Za-z]+(?:/[A-Za-z]+(?:[_-][A-Za-z]+)*)+|[A-Za-z]+|[가-힣]+|[^\W\d_]+")


def _word_class(word: str) -> str:
    low = word.lower()
    if "/" in word:
        return "R"
    if low == "t" or low == "z":
        return low
    for words, letter in ((MONTH_NUMBER, "M"), (WEEKDAY_WORDS, "D"), (HALF_DAY, "P"), (ABBREVIATIONS, "Z"), (AGO, "G")):
        if low in words:
            return letter
    if word in ("년", "월"):
        return word
    if low in UNIT_MONTHS or low in NEAR:
        return "V" if low in UNIT_MONTHS else "N"
    return "U" if low in UNIT_SECONDS else "w"


_classes = lru_cache(maxsize=65536)(_word_class)


def _cover(match: re.Match) -> str:
    token = match.group()
    if token[0].isdigit():
        return "9" * len(token)
    return _classes(token) * len(token)


def mask(text: str) -> str:
    """The text with every character replaced by its class; punctuation stays."""
    return _TOKEN.sub(_cover, text)


_CLOCK = r"(?:(?P<p1>P+) ?)?(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<p2>P+))?"
_COMPACT_CLOCK = r"(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,](?P<f>9+))?"
_ZONE = r"(?: ?(?:Z+ ?)?(?P<o>(?P<os>[+-])(?P<oh>99)(?::?(?P<om>99)(?!9))?(?![9:]))(?:\[R+\])?| ?(?P<zulu>z)| ?\(?(?P<abbr>Z+)\)?| ?\[?(?P<region>R+)\]?)?"
_LAYOUTS = tuple(
    re.compile(rf"(?<![9w]){date}(?:(?:[t ]|, | t ){clock}(?!9){_ZONE})?(?![9:])")
    for date, clock in (
        (r"(?P<y>9999)(?P<mo>99)(?P<d>99)", _COMPACT_CLOCK),
        (r"(?P<y>9999)(?P<mo>99)(?P<d>99)", _CLOCK),
        (r"(?P<y>9999)(?P<sep>[-/.])(?P<mo>99?)(?P=sep)(?P<d>99?)\.?", _CLOCK),
        (r"(?P<y>9999)\. (?P<mo>99?)\. (?P<d>99?)\.?", _CLOCK),
        (r"(?P<y>9999)년 ?(?P<mo>99?)월 ?(?P<d>99?)U", _CLOCK),
        (r"(?P<a>99?)/(?P<b>99?)/(?P<y>9999)", _CLOCK),
        (r"(?:D+,? )?(?P<d>99?)[ -](?P<mn>M+)\.?,?[ -](?P<y>9999)", _CLOCK),
        (r"(?:D+,? )?(?P<mn>M+)\.? (?P<d>99?),? (?P<y>9999)", _CLOCK),
    )
)
_RELATIVE = re.compile(r"(?<!9)(?P<n>9{1,6}) ?(?P<u>U+) ?G+")
_MONTHS_AGO = re.compile(r"(?<!9)(?P<n>9{1,4}) ?(?P<u>V+|년) ?G+")
_NEAR = re.compile(r"^(?:w+ )?(?P<u>N+)(?: G+)?$")
_EPOCH = re.compile(r"(?<![9.:/-])(?P<e>9{10}|9{13}|9{16}|9{19})(?![9.:/-])")


@lru_cache(maxsize=65536)
def parser_of(shape: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """Kind of a mask and the places of its fields; None if it names no time."""
    found = _RELATIVE.search(shape)
    if found:
        return "ago", {k: found.span(k) for k in ("n", "u")}
    found = _MONTHS_AGO.search(shape)
    if found:
        return "months", {k: found.span(k) for k in ("n", "u")}
    found = _NEAR.search(shape)
    if found:
        return "near", {"u": found.span("u")}
    for layout in _LAYOUTS:
        found = layout.search(shape)
        if found:
            fields = {k: found.span(k) for k, v in found.groupdict().items() if v is not None and k != "sep"}
            return "wall", fields
    found = _EPOCH.search(shape)
    return ("epoch", {"e": found.span("e")}) if found else None


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """The digits at ``span`` of every row as one number."""
    value = np.zeros(len(codes), dtype=np.int64)
    for k in range(*span):
        value = value * 10 + (codes[:, k].astype(np.int64) - 48)
    return value


def _words(texts: list[str], span: tuple[int, int], table: dict[str, int]) -> np.ndarray:
    a, b = span
    return np.array([table[t[a:b].lower()] for t in texts], dtype=np.int64)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, ok & (d <= length)


def _wall(texts: list[str], codes: np.ndarray, at: dict, zones: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(texts)
    get = lambda k, other=0: _number(codes, at[k]) if k in at else np.full(size, other, dtype=np.int64)
    year = get("y")
    if "a" in at:
        a, b = get("a"), get("b")
        month, day = np.where(month_first, a, b), np.where(month_first, b, a)
    else:
        month = _words(texts, at["mn"], MONTH_NUMBER) if "mn" in at else get("mo")
        day = get("d")
    days, ok = _days(year, month, day)
    hour, minute, second = get("h"), get("mi"), get("s")
    half = at.get("p1") or at.get("p2")
    if half:
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + _words(texts, half, HALF_DAY)
    ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
    milli = np.zeros(size, dtype=np.int64)
    if "f" in at:
        a, b = at["f"]
        b = min(b, a + 3)
        milli = _number(codes, (a, b)) * 10 ** (3 - (b - a))
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    if "o" in at:
        oh, om = get("oh"), get("om")
        ok &= (om <= 59) & (oh * 60 + om <= 18 * 60)
        sign = np.where(codes[:, at["os"][0]] == ord("-"), -1, 1)
        return (wall - sign * (oh * 3600 + om * 60)) * 1000 + milli, ok
    if "zulu" in at:
        return wall * 1000 + milli, ok
    if "abbr" in at:
        return (wall - _words(texts, at["abbr"], ABBREVIATIONS) * 60) * 1000 + milli, ok
    if "region" in at:
        a, b = at["region"]
        zones = np.array([t[a:b] for t in texts], dtype=object)
    instant = np.zeros(size, dtype=np.int64)
    for zone in dict.fromkeys(zones):
        rows = zones == zone
        found = wall_to_utc(wall[rows], zone) if isinstance(zone, str) else None
        if found is None:
            ok &= ~rows
        else:
            instant[rows] = found
    return instant * 1000 + milli, ok


def to_utc_millis(texts: list[str | None], crawled: np.ndarray, zones: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants in milliseconds and whether each text names one.

    ``crawled`` is datetime64[ms] in UTC, NaT if unknown; ``zones`` has names
    or None; ``month_first`` says how slashed dates are read.
    """
    out, good = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    groups: dict[str, list[int]] = {}
    for k, text in enumerate(texts):
        if text:
            groups.setdefault(mask(text), []).append(k)
    for shape, rows in groups.items():
        parser = parser_of(shape)
        if parser is None:
            continue
        kind, at = parser
        index = np.array(rows)
        own = [texts[k] for k in rows]
        codes = np.array(own, dtype=f"U{len(shape)}").view(np.uint32).reshape(len(own), len(shape))
        if kind == "epoch":
            value, digits = _number(codes, at["e"]), at["e"][1] - at["e"][0]
            value = value * 1000 if digits == 10 else value // 10 ** (digits - 13)
            ok = value > 0
        elif kind == "months":
            ok = ~np.isnat(crawled[index])
            value = _months_before(np.where(ok, crawled[index].astype(np.int64), 0), _number(codes, at["n"]) * _words(own, at["u"], UNIT_MONTHS))
        elif kind in ("ago", "near"):
            seconds = _number(codes, at["n"]) * _words(own, at["u"], UNIT_SECONDS) if kind == "ago" else _words(own, at["u"], NEAR)
            ok = ~np.isnat(crawled[index])
            value = np.where(ok, crawled[index].astype(np.int64), 0) - seconds * 1000
        else:
            value, ok = _wall(own, codes, at, zones[index], month_first[index])
        out[index], good[index] = value, ok
    return out, good


def _months_before(millis: np.ndarray, months: np.ndarray) -> np.ndarray:
    """The same time of day so many months before, at the last day of a month that is too short."""
    days, rest = np.divmod(millis, 86_400_000)
    month = days.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    day = days - month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    first = (month - months).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (month - months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
    return (first + np.minimum(day, length - 1)) * 86_400_000 + rest


def iso_millis(value: np.ndarray) -> np.ndarray:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` of instants in milliseconds."""
    return np.char.add(np.datetime_as_string(value.astype("datetime64[ms]"), unit="ms"), "Z")


def _convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [t if isinstance(t, str) else None for t in b["raw"]]
        zones = np.array([z if isinstance(z, str) else None for z in b["zone"]], dtype=object)
        value, good = to_utc_millis(texts, b["crawled"].to_numpy(dtype="datetime64[ms]"), zones, (b["date_order"] == "MDY").to_numpy(dtype=bool))
        good &= (value >= -62135596800000) & (value <= 253402300799999)
        yield pd.DataFrame({"id": b["id"].to_numpy()[good], "published_utc": iso_millis(value[good]).astype(object)})


def normalise_times(records: DataFrame, source_zone: DataFrame, *, raw: str = "published_raw", crawled: str = "crawled_at") -> DataFrame:
    """(id, published_utc) of each record whose ``raw`` text names an existing time.

    ``records`` needs id, corporation_id, ``raw`` and ``crawled`` (in UTC);
    ``source_zone`` corporation_id, zone_name and date_order. Of several zones
    of one source the first by name counts. Rows without an id are dropped.
    """
    zones = source_zone.groupBy("corporation_id").agg(F.min(F.struct("zone_name", "date_order")).alias("z"))
    zones = zones.select("corporation_id", F.col("z.zone_name").alias("zone"), F.col("z.date_order").alias("date_order"))
    own = records.select("id", "corporation_id", F.col(raw).alias("raw"), F.col(crawled).cast("timestamp_ntz").alias("crawled"))
    own = own.where("id is not null and raw is not null and trim(raw) <> ''")
    own = own.join(zones, "corporation_id", "left").select("id", "raw", "crawled", "zone", "date_order")
    return own.mapInPandas(_convert, "id bigint, published_utc string")
