"""Joins in time: intervals, nearest and previous events, quiet-time rules, window measures.

Interval joins add a time bucket to the equality keys, so they are hash or merge joins that the
adaptive planner can split when one bucket is hot. "Is there an event near" needs only the first
and last event of each bucket. Nearest and previous matches put points and events in one order
and carry the last event along, so no pair of rows is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhush.operators.blocks import ordered, running
from fieldhush.sources.scratch import materialize, sized

DAY = 86400


# ---- interval joins --------------------------------------------------------

def interval_join(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, bucket: int) -> DataFrame:
    """Rows with the windows that hold them: equal ``by`` and ``start <= t < end``.

    ``bucket`` seconds should be near the usual window length: a window is repeated once per bucket it touches.
    """
    touched = F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))
    spread = windows.filter(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(touched))
    keyed = rows.withColumn("__bucket", F.floor(F.col(t) / bucket))
    both = keyed.join(spread, [*by, "__bucket"])
    return both.filter((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("__bucket")


def window_measures(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str,
                    aggs: Sequence[Column], bucket: int = 3600) -> DataFrame:
    """Aggregates of the rows in each window; windows without rows stay with nulls."""
    ids = windows.columns
    hit = interval_join(rows, windows, by, t, start, end, bucket).groupBy(*ids).agg(*aggs)
    return windows.join(hit, ids, "left")


def coverage(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, per_hour: float,
             bucket: int = 3600) -> DataFrame:
    """``n`` rows seen and ``cov``, the share of the rows expected at ``per_hour``. Windows of equal bounds are counted once."""
    spans = windows.select(*by, start, end).distinct()
    seen = interval_join(rows.select(*by, t), spans, by, t, start, end, bucket).groupBy(*by, start, end).agg(F.count("*").alias("n"))
    out = windows.join(seen, [*by, start, end], "left").fillna(0, ["n"])
    return out.withColumn("cov", F.try_divide(F.col("n") * 3600.0, (F.col(end) - F.col(start)) * per_hour))


def count_index(rows: DataFrame, by: Sequence[str], t: str, width: int = 1800) -> DataFrame:
    """A prefix-count index: for each key and bucket of ``width`` seconds the rows ``before`` it, and its own ``times`` with their counts.

    Every bucket from a key's first to one after its last has a row. ``t`` holds whole seconds, so a bucket has at most ``width`` times.
    """
    by = list(by)
    each = rows.filter(F.col(t).isNotNull()).groupBy(*by, F.col(t).cast("long").alias("__t")).agg(F.count("*").alias("__n"))
    held = each.groupBy(*by, F.floor(F.col("__t") / width).alias("__b")).agg(F.sum("__n").alias("__k"), F.sort_array(F.collect_list(F.struct("__t", "__n"))).alias("times"))
    span = rows.groupBy(*by).agg(F.min(F.floor(F.col(t) / width)).alias("__lo"), F.max(F.floor(F.col(t) / width)).alias("__hi")).filter("__lo is not null")
    grid = span.select(*by, F.explode(F.sequence("__lo", F.col("__hi") + 1)).alias("__b"))
    full = grid.join(held, [*by, "__b"], "left").fillna(0, ["__k"])
    cum = running(ordered(full, by, ["__b"]), {"before": ("sum", "__k")}, current=False)
    return cum.select(*by, "__b", F.coalesce("before", F.lit(0)).alias("before"), "times", F.lit(width).alias("width"))


def count_between(windows: DataFrame, index: DataFrame, by: Sequence[str], start: str, end: str, out: str, width: int = 1800) -> DataFrame:
    """``out``: the indexed rows in ``[start, end)`` of each window, by two lookups; 0 for a key without rows."""
    by = list(by)
    # One row per key.
    ends = sized(index.groupBy(*by).agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi")))
    w = windows.join(ends, by, "left")
    for c, name in ((start, "__na"), (end, "__nz")):
        bucket = F.least(F.greatest(F.floor(F.col(c) / width), F.col("__lo")), F.col("__hi"))
        w = w.withColumn("__b", bucket).join(index.select(*by, "__b", "before", "times"), [*by, "__b"], "left")
        inside = F.aggregate(F.filter("times", lambda x: x["__t"] < F.col(c)), F.lit(0).cast("long"), lambda s, x: s + x["__n"])
        w = w.withColumn(name, F.coalesce(F.col("before"), F.lit(0)) + F.coalesce(inside, F.lit(0))).drop("__b", "before", "times")
    return w.withColumn(out, F.col("__nz") - F.col("__na")).drop("__na", "__nz", "__lo", "__hi")


def split_parts(windows: DataFrame, start: str, end: str, after: int | None = None) -> DataFrame:
    """Each window as before / during / after parts of its own length (or ``after`` seconds after)."""
    s, e = F.col(start), F.col(end)
    length = e - s
    tail = F.lit(after) if after is not None else length
    part = lambda n, a, b: F.struct(F.lit(n).alias("part"), a.alias("part_start"), b.alias("part_end"))
    return windows.select("*", F.explode(F.array(part("before", s - length, s), part("during", s, e), part("after", e, e + tail))).alias("__p")
                          ).select("*", "__p.*").drop("__p")


# ---- event near a point ----------------------------------------------------

def bucket_edges(events: DataFrame, by: Sequence[str], t: str, width: int) -> DataFrame:
    """First and last event time of each bucket of ``width`` seconds."""
    return events.groupBy(*by, F.floor(F.col(t) / width).alias("__b")).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))


def _near(points: DataFrame, events: DataFrame, by: Sequence[str], at: str, t: str, width: int, how: str) -> DataFrame:
    edges = bucket_edges(events, by, t, width)
    # An event counts for its own bucket and, through its edge, for both neighbours.
    spread = edges.select(*by, F.explode(F.array(
        F.struct(F.col("__b"), F.lit(None).cast("double").alias("__from"), F.lit(None).cast("double").alias("__to")),
        F.struct((F.col("__b") + 1).alias("__b"), F.lit(None).cast("double").alias("__from"), (F.col("__hi") + width).cast("double").alias("__to")),
        F.struct((F.col("__b") - 1).alias("__b"), (F.col("__lo") - width).cast("double").alias("__from"), F.lit(None).cast("double").alias("__to")),
    )).alias("__e")).select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__e.__b").alias("__eb"), "__e.__from", "__e.__to")
    p = points.withColumn("__pb", F.floor(F.col(at) / width))
    cond = F.col("__pb") == F.col("__eb")
    for c in by:
        cond = cond & (F.col(c) == F.col(f"__k_{c}"))
    inside = (F.col("__from").isNull() | (F.col(at) > F.col("__from"))) & (F.col("__to").isNull() | (F.col(at) < F.col("__to")))
    return p.join(spread, cond & inside, how).drop("__pb")


def quiet(points: DataFrame, events: DataFrame, by: Sequence[str], at: str, t: str, width: int) -> DataFrame:
    """Points with no event closer than ``width`` seconds (equal ``by``; none means any event)."""
    return _near(points, events, by, at, t, width, "left_anti")


def active_around(windows: DataFrame, rows: DataFrame, by: Sequence[str], start: str, end: str, t: str, pad: int) -> DataFrame:
    """Windows with a row in ``[start - pad, start)`` and one in ``[end, end + pad)``."""
    edges = bucket_edges(rows, by, t, pad)
    out = windows
    for a, b in ((F.col(start) - pad, F.col(start)), (F.col(end), F.col(end) + pad)):
        # [a, b) is one bucket long: it holds the tail of a's bucket and the head of b's.
        for name, edge, c in (("__u", "__hi", a), ("__v", "__lo", b)):
            side = edges.select(*by, F.col("__b").alias(name), F.col(edge).alias(f"{name}_e"))
            out = out.withColumn(name, F.floor(c / pad)).join(side, [*by, name], "left").drop(name)
        hit = F.coalesce(F.col("__u_e") >= a, F.lit(False)) | F.coalesce(F.col("__v_e") < b, F.lit(False))
        out = out.filter(hit).drop("__u_e", "__v_e")
    return out


# ---- previous, next and nearest events -------------------------------------

def neighbours(points: DataFrame, events: DataFrame, by: Sequence[str], at: str, t: str, tie: Sequence[str],
               before: str | None = "prev", after: str | None = "next", same_time_is_before: bool = True,
               own: str | None = None, block_rows: int | None = None) -> DataFrame:
    """The event row before and after each point, as struct columns.

    With ``own`` (a column of both tables) only events whose value differs count: events "elsewhere".
    Points and events share one order; the last event is carried along it, so no pairs are formed.
    ``same_time_is_before`` says on which side an event at the very time of the point lies.
    """
    by = list(by)
    e = events
    if own:
        # The latest event elsewhere is the last event or, when that is one's own, the one before its run.
        o = ordered(e, by, [t, *tie], before=1, after=1, block_rows=block_rows)
        w = o.window
        cols = events.columns
        row = F.struct(*cols)
        tagged = o.df.withColumn("__row", row)
        tagged = tagged.withColumn("__was", F.lag("__row").over(w)).withColumn("__will", F.lead("__row").over(w))
        differs = lambda c: F.when(F.col(f"{c}.{own}") != F.col(own), F.col(c))
        e = o.home(tagged).select(*cols, differs("__was").alias("__was"), differs("__will").alias("__will"))
    ev = F.struct(*events.columns)
    left = points.select(*by, F.col(at).cast("double").alias("__t"), F.lit(1 if same_time_is_before else 0).alias("__side"),
                         F.struct(*points.columns).alias("__point"))
    right = e.select(*by, F.col(t).cast("double").alias("__t"), F.lit(0 if same_time_is_before else 1).alias("__side"),
                     ev.alias("__event"), *(["__was", "__will"] if own else []), *[F.col(c).alias(f"__tie_{c}") for c in tie])
    both = left.unionByName(right, allowMissingColumns=True)
    o = ordered(both, by, ["__t", "__side", *[f"__tie_{c}" for c in tie]], block_rows=block_rows)
    totals = {}
    if before:
        totals["__p"] = ("last", "__event")
        totals.update({"__p2": ("last", "__was")} if own else {})
    if after:
        totals["__n"] = ("next", "__event")
        totals.update({"__n2": ("next", "__will")} if own else {})
    out = running(o, totals).filter(F.col("__point").isNotNull())

    def pick(first: str, second: str) -> Column:
        if not own:
            return F.col(first)
        return F.when(F.col(f"{first}.{own}") != F.col(f"__point.{own}"), F.col(first)).otherwise(F.col(second))

    names = ([pick("__p", "__p2").alias(before)] if before else []) + ([pick("__n", "__n2").alias(after)] if after else [])
    return out.select("__point.*", *names)


def nearest(points: DataFrame, events: DataFrame, by: Sequence[str], at: str, t: str, tie: Sequence[str],
            out: str = "nearest", block_rows: int | None = None) -> DataFrame:
    """The closest event as a struct; the earlier one when two are equally far."""
    n = neighbours(points, events, by, at, t, tie, block_rows=block_rows)
    back, ahead = F.col(at) - F.col(f"prev.{t}"), F.col(f"next.{t}") - F.col(at)
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    return n.withColumn(out, pick).drop("prev", "next")


def signed_time(points: DataFrame, events: DataFrame, by: Sequence[str], at: str, t: str, tie: Sequence[str], out: str = "dt") -> DataFrame:
    """Time since the nearest event (negative before it); null without one."""
    n = nearest(points, events.select(*by, t, *[c for c in tie if c not in by and c != t]), by, at, t, tie, "__near")
    return n.withColumn(out, F.col(at) - F.col(f"__near.{t}")).drop("__near")


# The distance labels and their limits in minutes.
def distance_label(minutes: str | Column) -> Column:
    """approach [-60, -20), near |dt| < 20, after [20, 60), mid [60, 120) either way, else far."""
    m = F.col(minutes) if isinstance(minutes, str) else minutes
    return (F.when(F.abs(m) < 20, "near").when((m >= -60) & (m < -20), "approach").when((m >= 20) & (m < 60), "after")
            .when((F.abs(m) >= 60) & (F.abs(m) < 120), "mid").otherwise("far"))


# ---- windows on other days and elsewhere -----------------------------------

def same_clock_days(windows: DataFrame, days: DataFrame, by: Sequence[str], start: str, times: Sequence[str], day: str = "day") -> DataFrame:
    """Each window moved to the same clock time on the recorder's other days; ``offset`` is the shift in seconds.

    One row per window and other day is the result this operator stands for; filter it before joining clips.
    """
    own = F.floor(F.col(start) / DAY)
    moved = windows.join(days, list(by)).filter(F.col(day) != own).withColumn("offset", ((F.col(day) - own) * DAY).cast("long"))
    return moved.select(*[c for c in moved.columns if c not in (*times, day)], *[F.col(c).alias(f"base_{c}") for c in times],
                        *[(F.col(c) + F.col("offset")).alias(c) for c in times])


def chosen_days(windows: DataFrame, days: DataFrame, by: Sequence[str], start: str, times: Sequence[str], free: Callable[[DataFrame], DataFrame], k: int, seed: str,
                day: str = "day", first: int = 8) -> DataFrame:
    """Up to ``k`` of the moved windows that ``same_clock_days`` would give and ``free`` keeps, in hash order of (seed, by, start, moved start).

    Each key's recorded days are one sorted array, a number per calendar day. A window orders the array by its own hash and tests the first few days; only windows that still
    lack some go on with the next days, four times as many each time. So a window has a few rows instead of one for each recorded day.
    """
    by = list(by)
    recorded = materialize(days.select(*by, day).distinct().groupBy(*by).agg(F.sort_array(F.collect_list(day)).alias("__days")), "days")
    longest = recorded.agg(F.max(F.size("__days"))).first()[0] or 0
    own = F.floor(F.col(start) / DAY)
    ids = [F.col(c).cast("string") for c in by] + [F.col(start).cast("string")]
    moved_start = lambda d: (F.col(start) + (d - own) * DAY).cast("long")
    key = lambda d: F.struct(F.md5(F.concat_ws("|", F.lit(seed), *ids, moved_start(d).cast("string"))).alias("h"), d.alias("d"))
    rest, out, at, n = materialize(windows, "windows"), None, 0, first
    while True:
        order = F.array_sort(F.transform(F.filter("__days", lambda d: d != own), key))
        tries = rest.join(recorded, by).withColumn("__x", F.explode(F.transform(F.slice(order, at + 1, n), lambda x, i: F.struct(x["d"].alias("d"), (i + at).alias("i")))))
        tries = tries.withColumn("offset", ((F.col("__x.d") - own) * DAY).cast("long")).withColumn("__place", F.col("__x.i")).drop("__days", "__x")
        kept = [c for c in windows.columns if c not in times]
        tries = tries.select(*kept, "offset", "__place", *[F.col(c).alias(f"base_{c}") for c in times], *[(F.col(c) + F.col("offset")).alias(c) for c in times])
        found = materialize(free(tries), "found")
        out = found if out is None else out.unionByName(found)
        at, n = at + n, 4 * n
        if at >= longest:
            break
        done = out.groupBy(*by, F.col(f"base_{start}").alias(start)).agg(F.count("*").alias("__k")).filter(F.col("__k") >= k)
        rest = materialize(rest.join(done, [*by, start], "left_anti"), "lacking")
        if rest.isEmpty():
            break
    w = Window.partitionBy(*by, f"base_{start}").orderBy("__place")
    return out.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn", "__place")


def no_overlap(windows: DataFrame, sessions: DataFrame, by: Sequence[str], a: str, b: str, start: str, end: str) -> DataFrame:
    """Windows ``[a, b)`` that no session of the same key reaches into (``end > a`` and ``start < b``)."""
    left = windows.select(*by, F.col(b).cast("double").alias("__t"), F.lit(0).alias("__side"), F.struct(*windows.columns).alias("__w"))
    right = sessions.select(*by, F.col(start).cast("double").alias("__t"), F.lit(1).alias("__side"), F.col(end).alias("__end"))
    o = ordered(left.unionByName(right, allowMissingColumns=True), by, ["__t", "__side", F.col("__end")])
    seen = running(o, {"__latest": ("max", "__end")}).filter(F.col("__w").isNotNull())
    return seen.filter(F.col("__latest").isNull() | (F.col("__latest") <= F.col(f"__w.{a}"))).select("__w.*")


def previous_stop(visits: DataFrame, events: DataFrame, rec: str, at: str, t: str, tie: Sequence[str],
                  longest: int = 7200, shortest: int = 600) -> DataFrame:
    """Visits with the latest event at another recorder the same day, ``shortest`` to ``longest`` seconds earlier."""
    day = lambda c: F.floor(F.col(c) / DAY)
    n = neighbours(visits.withColumn("__day", day(at)), events.withColumn("__day", day(t)), ["__day"], at, t, [rec, *tie],
                   before="prev", after=None, same_time_is_before=False, own=rec)
    gap = F.col(at) - F.col(f"prev.{t}")
    return n.filter((gap <= longest) & (gap >= shortest)).drop("__day")


def approach_start(visits: DataFrame, sessions: DataFrame, rec: str, start: str, end: str, reach: int = 3600, least: int = 120) -> DataFrame:
    """``approach_t``: start of the earliest session elsewhere within ``reach`` seconds before, no earlier than one
    visit length before; visits with less than ``least`` seconds of approach are dropped."""
    p = visits.withColumn("__from", F.col(start) - reach)
    ev = sessions.select(rec, F.col(start).alias("__s"))
    n = neighbours(p, ev, [], "__from", "__s", [rec], before=None, after="next", same_time_is_before=False, own=rec)
    n = n.filter(F.col("next.__s") < F.col(start))
    first = F.greatest(F.col("next.__s"), 2 * F.col(start) - F.col(end))
    return n.withColumn("approach_t", first).filter(F.col(start) - F.col("approach_t") >= least).drop("__from", "next")


def active_integral(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, out: str) -> DataFrame:
    """``out``: the summed seconds of all ``spans`` of the same key up to the time of each point.

    A sweep over starts (+1) and ends (-1): at time t the integral of the number of open spans is t * A - B, with A the sum of the signs
    and B the sum of sign times time of all edges passed. Points ride along in the same order, so no point meets a span.
    """
    by = list(by)
    real = spans.filter(F.col(end) > F.col(start))
    edges = real.select(*by, F.explode(F.array(F.struct(F.col(start).alias("__t"), F.lit(1).alias("__s")), F.struct(F.col(end).alias("__t"), F.lit(-1).alias("__s")))).alias("__e"))
    edges = edges.groupBy(*by, F.col("__e.__t").cast("long").alias("__t")).agg(F.sum("__e.__s").cast("long").alias("__s"))
    left = points.select(*by, F.col(at).cast("long").alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__s"), F.struct(*points.columns).alias("__point"))
    both = left.unionByName(edges.withColumn("__side", F.lit(0)), allowMissingColumns=True).withColumn("__w", F.col("__s") * F.col("__t"))
    swept = running(ordered(both, by, ["__t", "__side"]), {"__a": ("sum", "__s"), "__b": ("sum", "__w")}).filter(F.col("__point").isNotNull())
    return swept.select("__point.*", (F.col("__t") * F.col("__a") - F.col("__b")).alias(out))


def activity_elsewhere(visits: DataFrame, sessions: DataFrame, rec: str, end: str, s_start: str, s_end: str, span: int = 3600) -> DataFrame:
    """``busy_s``: seconds of sessions at other recorders in the ``span`` seconds after each visit.

    The integral of all sessions over the window less that of the recorder's own, both by ``active_integral`` at the window's two ends.
    """
    ends = F.explode(F.array(F.struct(F.col(end).alias("p"), F.lit(-1).alias("w")), F.struct((F.col(end) + span).alias("p"), F.lit(1).alias("w")))).alias("__x")
    at = visits.select(rec, F.col(end).alias("__end")).distinct().withColumnRenamed("__end", end).select(rec, end, ends).select(rec, end, "__x.p", "__x.w")
    every = active_integral(at, sessions, [], "p", s_start, s_end, "__c")
    own = active_integral(at, sessions, [rec], "p", s_start, s_end, "__c")
    both = every.unionByName(own.withColumn("w", -F.col("w")))
    busy = both.groupBy(F.col(rec).alias("__r"), F.col(end).alias("__e")).agg(F.sum(F.col("w") * F.col("__c")).cast("long").alias("busy_s"))
    return visits.join(sized(busy), (F.col(rec) == F.col("__r")) & (F.col(end) == F.col("__e")), "left").drop("__r", "__e").fillna(0, ["busy_s"])


def hourly_mean(windows: DataFrame, hourly: DataFrame, start: str, end: str, hour_t: str, values: Sequence[str]) -> DataFrame:
    """Mean of the hourly rows in ``[floor hour of start, end)``."""
    a = F.col(start) - F.col(start) % 3600
    hours = windows.withColumn(hour_t, F.explode(F.sequence(a, F.col(end) - 1, F.lit(3600))))
    got = hours.join(hourly, hour_t).groupBy(*windows.columns).agg(*[F.avg(v).alias(v) for v in values])
    return windows.join(got, windows.columns, "left")


def far_windows(visits: DataFrame, events: DataFrame, rec: str, at: str, t: str, hours: Sequence[int] = (-3, 3, -4, 4, -5, 5, -6, 6),
                gap_same: int = 10800, gap_any: int = 7200, day_start: float = 5.5, day_end: float = 18.5, keep: int = 2) -> DataFrame:
    """The first ``keep`` daylight offsets with no event within ``gap_same`` here and ``gap_any`` anywhere."""
    tries = visits.withColumn("__o", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(h).alias("h")) for i, h in enumerate(hours)])))
    tries = tries.select("*", F.col("__o.rank").alias("__rank"), F.col("__o.h").alias("h")).drop("__o")
    tries = tries.withColumn("far_t", F.col(at) + F.col("h") * 3600)
    clock = F.floor(F.col("far_t") % DAY / 60) / 60
    tries = tries.filter((clock >= day_start) & (clock <= day_end))
    tries = quiet(quiet(tries, events, [rec], "far_t", t, gap_same), events, [], "far_t", t, gap_any)
    few = F.slice(F.array_sort(F.collect_list(F.struct("__rank", "h", "far_t"))), 1, keep)
    # At most len(hours) tries per visit, so the list is short.
    return tries.groupBy(*visits.columns).agg(F.explode(few).alias("__f")).select(*visits.columns, "__f.h", "__f.far_t")


def control_recorders(visits: DataFrame, placebos: DataFrame, events: DataFrame, rows: DataFrame, rec: str, visit: str, at: str, t: str, per_hour: float,
                      gaps: Sequence[int] = (5400, 3600), enough: int = 8, reach: int = 1800, least: float = 0.8, quiet_gap: int = 7200, keep: int = 3, seed: str = "23") -> DataFrame:
    """(rec, visit, ctrl, offset): up to ``keep`` recorders in hash order that had nobody at the time of a visit, with the placebo offsets usable there.

    ``visits`` has (rec, visit) with the visit's time in ``visit``, ``placebos`` its other windows (rec, visit, at). A recorder serves if no event lies within the gap of the visit
    and it recorded at least ``least`` of the rows expected ``reach`` seconds either way, there and at one placebo time at least, which must itself be ``quiet_gap``
    from events. The gap is the first of ``gaps`` with which ``enough`` visits have an unvisited recorder, else the last.
    """
    # One row that holds the recorders' names.
    names = rows.select(rec).distinct().agg(F.sort_array(F.collect_list(rec)).alias("__all"))
    pairs_ = visits.select(rec, visit).crossJoin(F.broadcast(names)).select(rec, visit, F.explode("__all").alias("ctrl")).filter(F.col("ctrl") != F.col(rec))
    ev = events.select(F.col(rec).alias("ctrl"), F.col(t).alias("__et"))
    free = None
    for gap in gaps:
        free = materialize(quiet(pairs_, ev, ["ctrl"], visit, "__et", gap), "unvisited")
        if free.select(rec, visit).distinct().count() >= enough:
            break
    index = materialize(count_index(rows.select(F.col(rec).alias("ctrl"), t), ["ctrl"], t), "count-index")
    need = least * per_hour * 2 * reach / 3600

    def covered(df: DataFrame, c: str) -> DataFrame:
        w = df.withColumn("__a", F.col(c) - reach).withColumn("__z", F.col(c) + reach)
        return count_between(w, index, ["ctrl"], "__a", "__z", "__n").filter(F.col("__n") >= need).drop("__a", "__z", "__n")

    there = covered(free, visit)
    other = there.join(placebos.select(rec, visit, at), [rec, visit])
    other = materialize(covered(quiet(other, ev, ["ctrl"], at, "__et", quiet_gap), at).withColumn("offset", F.col(at) - F.col(visit)), "usable")
    from fieldhush.operators.sampling import first_k

    chosen = first_k(other.select(rec, visit, "ctrl").distinct(), [rec, visit], ["ctrl", rec, visit], keep, seed)
    return other.join(chosen, [rec, visit, "ctrl"], "left_semi").select(rec, visit, "ctrl", "offset")


def pairs(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Every pair of groups once (``key_a < key_b``) with both vectors: for matrices over sites, one row per site."""
    a = df.select(F.col(key).alias(f"{key}_a"), F.col(vector).alias("vec_a"))
    b = df.select(F.col(key).alias(f"{key}_b"), F.col(vector).alias("vec_b"))
    return a.join(b, F.col(f"{key}_a") < F.col(f"{key}_b"))
