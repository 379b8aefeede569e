"""Column functions for clip tables: names, list-in-string values, labels, time parts, levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns and word lists that decide which rows match.
CLIP_NAME = r"(?i)(?:Audio[_ ]?Moth[_ ]?|AM)(\d+).*?(\d{8})_(\d{6})"
EMPTY_WORDS = ("", "nan", "None")
HUMAN_WORDS = ("human", "engine", "gun", "siren", "dog", "power tool", "chainsaw", "vehicle", "fireworks")
LIST_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- names and lists -------------------------------------------------------

def recorder_of(name: str | Column) -> Column:
    """``Audio_Moth_3_20250317_093654.wav`` -> ``AM3``; first number of other names, else ``AM?``."""
    n = F.regexp_extract(_c(name), CLIP_NAME, 1)
    other = F.regexp_extract(_c(name), r"(\d+)", 1)
    pick = F.when(n != "", n).when(other != "", other)
    return F.coalesce(F.concat(F.lit("AM"), F.regexp_replace(pick, r"^0+(?=\d)", "")), F.lit("AM?"))


def day_of(name: str | Column) -> Column:
    """The eight-digit day in a clip name, else the name itself."""
    d = F.regexp_extract(_c(name), CLIP_NAME, 2)
    other = F.regexp_extract(_c(name), r"(\d{8})", 1)
    return F.when(d != "", d).when(other != "", other).otherwise(_c(name))


def seconds_of(name: str | Column) -> Column:
    """Local-clock seconds since 1970 from the name's day and time; null when it has none."""
    stamp = F.regexp_extract(_c(name), r"(\d{8}_\d{6})", 1)
    return epoch_seconds(stamp_ntz(stamp))


def stamp_ntz(stamp: str | Column) -> Column:
    """``yyyyMMdd_HHmmss`` text to a zone-less timestamp, null when it does not parse."""
    s = _c(stamp)
    iso = F.concat_ws(" ", F.concat_ws("-", s.substr(1, 4), s.substr(5, 2), s.substr(7, 2)),
                      F.concat_ws(":", s.substr(10, 2), s.substr(12, 2), s.substr(14, 2)))
    return F.when(s.rlike(r"^\d{8}_\d{6}$"), iso.try_cast("timestamp_ntz"))


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 on the local clock of a zone-less timestamp, whatever the session time zone."""
    c = _c(ts).cast("timestamp_ntz")
    return F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def parse_list(value: str | Column) -> Column:
    """``"['A', 'B']"``, a bare scalar, or nothing -> array<string>."""
    s = F.trim(_c(value))
    listed = F.from_json(s, "array<string>", LIST_OPTIONS)
    empty = F.array().cast("array<string>")
    return (
        F.when(s.isNull() | s.isin(*EMPTY_WORDS), empty)
        .when(s.startswith("["), F.coalesce(listed, empty))
        .otherwise(F.array(s))
    )


def parse_numbers(value: str | Column) -> Column:
    """As :func:`parse_list` for numbers; entries that are not numbers become null."""
    return F.transform(parse_list(value), lambda x: x.try_cast("double"))


def first_relative(value: str | Column) -> Column:
    """First listed number, 0 when missing or malformed."""
    return F.coalesce(F.try_element_at(parse_numbers(value), F.lit(1)), F.lit(0.0))


# ---- labels ----------------------------------------------------------------

def is_simulation(sim_type: str | Column) -> Column:
    return F.coalesce(~F.trim(_c(sim_type)).isin("[]", *EMPTY_WORDS), F.lit(False))


# The label texts of the next four functions, and the words that they look for.

def disturbance_class(sim_type: str | Column) -> Column:
    s = _c(sim_type)
    return (F.when(s == "[]", "baseline").when(s.contains("Gunshot"), "gunshot")
            .when(s.contains("Vehicle"), "human_vehicle").otherwise("human_trail"))


def walking_only(sim_type: str | Column) -> Column:
    s = F.trim(_c(sim_type))
    played = s.contains("Vehicle") | s.contains("Chainsaw") | s.contains("Gunshot")
    return s.isin("[]", "", "nan") | (s.contains("Human Presence on Trail") & ~played)


def event_kind(event_type: str | Column) -> Column:
    return F.when(F.lower(_c(event_type)).contains("presence"), "presence").otherwise("sound")


def sound_type(event_type: str | Column) -> Column:
    s = F.lower(_c(event_type))
    return (F.when(s.contains("gun"), "gunshot").when(s.contains("chain"), "chainsaw")
            .when(s.contains("vehic"), "vehicle").otherwise(s))


def human_tag(tags: str | Column) -> Column:
    """Any tag names a human-made sound."""
    return F.exists(_c(tags), lambda s: F.lower(s).rlike("|".join(HUMAN_WORDS)))


# ---- detections ------------------------------------------------------------

def species_at(species: str | Column, confidence: str | Column, least: float) -> Column:
    """Distinct species with confidence >= ``least``; one confidence serves all species."""
    sp, cf = parse_list(species), parse_numbers(confidence)
    cf = F.when((F.size(cf) == 1) & (F.size(sp) > 1), F.array_repeat(F.element_at(cf, 1), F.size(sp))).otherwise(cf)
    both = F.slice(F.arrays_zip(sp.alias("s"), cf.alias("c")), 1, F.least(F.size(sp), F.size(cf)))
    kept = F.filter(both, lambda p: (p["c"] >= least) & (F.trim(p["s"]) != ""))
    return F.array_distinct(F.transform(kept, lambda p: p["s"]))


def common_name(species: str | Column) -> Column:
    return F.element_at(F.split(_c(species), "_"), -1)


def top_confidence(confidence: str | Column) -> Column:
    return F.greatest(F.coalesce(F.array_max(parse_numbers(confidence)), F.lit(0.0)), F.lit(0.0))


def zero_below(value: str | Column, least: float) -> Column:
    return F.when(_c(value) >= least, _c(value)).otherwise(0.0)


def mentions(tags: str | Column, word: str) -> Column:
    """Any entry contains ``word``, ignoring case."""
    return F.exists(_c(tags), lambda s: F.lower(s).contains(word.lower()))


# ---- time ------------------------------------------------------------------

def hour_of(t: str | Column) -> Column:
    return F.floor((_c(t) % 86400) / 3600).cast("int")


def minute_of_day(t: str | Column) -> Column:
    return F.floor((_c(t) % 86400) / 60).cast("int")


def floor_to(t: str | Column, seconds: int) -> Column:
    return _c(t) - _c(t) % seconds


def day_number(t: str | Column) -> Column:
    return F.floor(_c(t) / 86400).cast("int")


def slot_of(t: str | Column, minutes: int = 10) -> Column:
    return (minute_of_day(t) - minute_of_day(t) % minutes).cast("int")


def session_key(rec: str | Column, t: str | Column, hours: int = 24) -> Column:
    """``recorder|start of the N-hour block``: 24 hours is the recorder-day."""
    return F.concat_ws("|", _c(rec).cast("string"), floor_to(t, hours * 3600).cast("string"))


def in_hours(t: str | Column, exclude: Sequence[int] = (), keep: Sequence[int] | None = None) -> Column:
    ok = ~hour_of(t).isin(*exclude) if exclude else F.lit(True)
    return ok & hour_of(t).isin(*keep) if keep is not None else ok


def daytime_span(start: str | Column, end: str | Column, first_minute: int = 360, last_minute: int = 1050) -> Column:
    """The whole of before + during + after lies on one day between the two minutes of the day."""
    length = _c(end) - _c(start)
    a, b = _c(start) - length, _c(end) + length
    return (day_number(a) == day_number(b)) & (minute_of_day(a) >= first_minute) & (minute_of_day(b) <= last_minute)


# ---- levels ----------------------------------------------------------------

def finite(value: str | Column) -> Column:
    """Null, NaN and infinity become 0."""
    v = _c(value).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def decibel(power: str | Column, floor: float = 1e-15) -> Column:
    return 10 * F.log10(_c(power) + floor)


def band_mean(spectrum: str | Column, lo: float, hi: float, width: float) -> Column:
    """Mean of the entries whose band centre ``(i + 0.5) * width`` is in ``[lo, hi)``."""
    inside = F.filter(_c(spectrum), lambda _, i: ((i + 0.5) * width >= lo) & ((i + 0.5) * width < hi))
    total = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.try_divide(total, F.size(inside))


def shannon(counts: str | Column, total: str | Column) -> Column:
    """One term of the Shannon sum; add the terms up over the species."""
    p = F.try_divide(_c(counts), _c(total))
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)
