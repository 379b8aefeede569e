"""Sweep lines, prefix counts, chosen days, control recorders and sparse medians against plain loops."""

import hashlib
import random
from statistics import median

from pyspark.sql import functions as F

from fieldhush.operators import intervals as J
from fieldhush.operators.aggregates import padded_median, species_share
from fieldhush.operators.quality import noise_filtered_change
from fieldhush.operators.ranks import zero_medians

DAY = 86400


def test_active_integral_and_activity_elsewhere(spark):
    rnd = random.Random(1)
    spans = [(rnd.randrange(4), a := rnd.randrange(50_000), a + rnd.randrange(-5, 4_000)) for _ in range(400)]
    points = [(rnd.randrange(5), rnd.randrange(55_000)) for _ in range(200)] + [(9, 100)]
    s = spark.createDataFrame(spans, "rec int, s0 long, s1 long").repartition(3)
    p = spark.createDataFrame(points, "rec int, at long").repartition(3)
    part = lambda t, keep: sum(max(0, min(b, t) - min(a, t)) for r, a, b in spans if b > a and keep(r))
    got = sorted((r.rec, r.at, r.c) for r in J.active_integral(p, s, ["rec"], "at", "s0", "s1", "c").collect())
    assert got == sorted((r, t, part(t, lambda x, r=r: x == r)) for r, t in points)
    busy = sorted((r.rec, r.at, r.busy_s) for r in J.activity_elsewhere(p, s, "rec", "at", "s0", "s1", 3600).collect())
    assert busy == sorted((r, t, part(t + 3600, lambda x, r=r: x != r) - part(t, lambda x, r=r: x != r)) for r, t in points)
    assert J.activity_elsewhere(p.limit(0), s, "rec", "at", "s0", "s1").count() == 0


def test_count_between(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(10_000, 40_000)) for _ in range(900)] + [("a", 12_345)] * 50 + [("b", None)]
    wins = [(rnd.choice("abc"), a := rnd.randrange(0, 50_000), a + rnd.randrange(0, 9_000)) for _ in range(300)]
    index = J.count_index(spark.createDataFrame(rows, "rec string, t long"), ["rec"], "t", 600)
    got = J.count_between(spark.createDataFrame(wins, "rec string, a long, z long"), index, ["rec"], "a", "z", "n", 600).collect()
    assert sorted((r.rec, r.a, r.z, r.n) for r in got) == sorted((k, a, z, sum(1 for r, t in rows if r == k and t is not None and a <= t < z)) for k, a, z in wins)


def test_chosen_days(spark):
    """The first free days in hash order; a window with few free days is tried on all of them."""
    rnd = random.Random(3)
    days = {"a": list(range(100, 190)), "b": [100, 103, 107]}
    wins = [(k, rnd.choice(days[k]) * DAY + rnd.randrange(DAY)) for k in "aaaaaaaabb"]
    wins = sorted({(k, t) for k, t in wins})
    free = lambda k, t: (t // DAY) % 7 == 0 if t % 2 else t % 5 == 0
    w = spark.createDataFrame([(k, t, t + 60) for k, t in wins], "rec string, start_t long, end_t long")
    d = spark.createDataFrame([(k, x) for k in days for x in days[k] * 2], "rec string, day long")
    keep = F.when(F.col("start_t") % 2 == 1, F.expr("start_t div 86400") % 7 == 0).otherwise(F.col("start_t") % 5 == 0)
    got = J.chosen_days(w, d, ["rec"], "start_t", ["start_t", "end_t"], lambda m: m.filter(keep), 4, "s", first=3).collect()
    want = set()
    for k, t in wins:
        order = sorted((hashlib.md5(f"s|{k}|{t}|{t + (x - t // DAY) * DAY}".encode()).hexdigest(), x) for x in days[k] if x != t // DAY)
        ok = [t + (x - t // DAY) * DAY for _, x in order if free(k, t + (x - t // DAY) * DAY)]
        want |= {(k, t, m, m + 60, m - t) for m in ok[:4]}
    assert {(r.rec, r.base_start_t, r.start_t, r.end_t, r.offset) for r in got} == want and len(got) == len(want)


def test_control_recorders(spark):
    rnd = random.Random(4)
    rows = [(r, t) for r in "abcd" for t in range(0, 5 * DAY, 600) if not (r == "d" and t < 2 * DAY)]
    events = [(rnd.choice("abc"), rnd.randrange(5 * DAY)) for _ in range(25)]
    visits = [("a", t) for t in range(50_000, 5 * DAY, 70_000)]
    placebos = [(r, t, t + o * DAY) for r, t in visits for o in (-1, 1, 2) if 0 < t + o * DAY < 5 * DAY]
    quiet = lambda r, t, gap: all(k != r or abs(e - t) >= gap for k, e in events)
    covered = lambda r, t: sum(1 for k, x in rows if k == r and t - 1800 <= x < t + 1800) >= 0.8 * 6
    free = lambda gap: {(r, t, c) for r, t in visits for c in "abcd" if c != r and quiet(c, t, gap)}
    for enough in (1, 10**6):
        gap = 5400 if len({(r, t) for r, t, _ in free(5400)}) >= enough else 3600
        usable = {}
        for r, t, c in free(gap):
            ok = [m for k, v, m in placebos if (k, v) == (r, t) and quiet(c, m, 7200) and covered(c, m)] if covered(c, t) else []
            if ok:
                usable.setdefault((r, t), []).append((hashlib.md5(f"23|{c}|{r}|{t}".encode()).hexdigest(), c, ok))
        want = {(r, t, c, m - t) for (r, t), found in usable.items() for _, c, ok in sorted(found)[:2] for m in ok}
        got = J.control_recorders(spark.createDataFrame(visits, "rec string, v long"), spark.createDataFrame(placebos, "rec string, v long, at long"),
                                  spark.createDataFrame(events, "rec string, t long"), spark.createDataFrame(rows, "rec string, t long"), "rec", "v", "at", "t", 6.0, enough=enough, keep=2)
        assert {tuple(x) for x in got.collect()} == want and want


def test_medians_with_zeros(spark):
    rnd = random.Random(5)
    data = {k: ([rnd.choice([-2.0, -1.0, 0.0, 1.0, 3.5]) for _ in range(rnd.randrange(1, 9))], rnd.randrange(0, 9)) for k in range(40)}
    rows = [(k, v, len(vs) + z) for k, (vs, z) in data.items() for v in vs] + [(0, None, len(data[0][0]) + data[0][1])]
    df = spark.createDataFrame(rows, "k int, v double, n int")
    assert {r.k: r.v for r in zero_medians(df, ["k"], "v", F.col("n")).collect()} == {k: median([*vs, *[0.0] * z]) for k, (vs, z) in data.items()}
    short = df.filter("v is not null").groupBy("k").agg(F.collect_list("v").alias("a"), F.max("n").alias("n"))
    assert {r.k: r.m for r in short.select("k", padded_median(F.col("a"), F.col("n")).alias("m")).collect()} == {k: median([*vs, *[0.0] * z]) for k, (vs, z) in data.items()}


def test_species_share(spark):
    rows = spark.createDataFrame([("a", 1, ["x", "y", "x"]), ("a", 2, []), ("a", 3, ["x"]), ("a", 99, ["z"]), ("b", 1, ["y"])], "rec string, t long, tags array<string>")
    wins = spark.createDataFrame([("a", 0, 4), ("b", 0, 4), ("b", 50, 60)], "rec string, a long, z long")
    got = {(r.rec, r.a, r.species): (r.k, r.n) for r in species_share(rows, wins, ["rec"], "t", "a", "z", "tags").collect()}
    assert got == {("a", 0, "x"): (2, 3), ("a", 0, "y"): (1, 3), ("b", 0, "y"): (1, 1)}
    assert {r.species for r in species_share(rows, wins, ["rec"], "t", "a", "z", "tags", least=3).collect()} == {"x"}


def test_species_share_of_all_frequent_species(spark):
    """Dense: a frequent species that a window lacks is a row with the share 0."""
    rows = spark.createDataFrame([("a", 1, ["x", "y", "x"]), ("a", 2, []), ("a", 3, ["x"]), ("a", 99, ["z"]), ("b", 1, ["y"])], "rec string, t long, tags array<string>")
    wins = spark.createDataFrame([("a", 0, 4), ("b", 0, 4), ("b", 50, 60)], "rec string, a long, z long")
    got = [(r.rec, r.a, r.species, r.k, r.n, r.share) for r in species_share(rows, wins, ["rec"], "t", "a", "z", "tags", least=2, dense=True).collect()]
    assert sorted(got) == [("a", 0, "x", 2, 3, 2 / 3), ("a", 0, "y", 1, 3, 1 / 3), ("b", 0, "x", 0, 1, 0.0), ("b", 0, "y", 1, 1, 1.0)]


def test_noise_filtered_change(spark):
    rnd = random.Random(6)
    side = lambda n: [(k, rnd.gauss(10, 4), rnd.gauss(0, 1)) for k in range(3) for _ in range(n * (k + 1))]
    before, after = side(20), side(60)
    make = lambda r: spark.createDataFrame(r, "k int, noise double, v double")
    got = {r.k: (r.n_before, r.n_after, round(r.noisy_share, 9), round(r.change, 9)) for r in noise_filtered_change(make(before), make(after), ["k"], "noise", "v", 1.0, (20, 20)).collect()}
    want = {}
    for k in range(3):
        b, a = [x for x in before if x[0] == k], [x for x in after if x[0] == k]
        cut = median(x[1] for x in b) + 1.0
        kb, ka = [x[2] for x in b if x[1] <= cut], [x[2] for x in a if x[1] <= cut]
        if len(b) >= 10 and len(a) >= 10 and len(kb) >= 20 and len(ka) >= 60:
            want[k] = (len(kb), len(ka), round(1 - len(ka) / len(a), 9), round(median(ka) - median(kb), 9))
    assert got == want and 0 < len(want) < 3
