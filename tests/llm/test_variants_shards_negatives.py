"""Spelling variants, sharding and hard negatives against plain Python, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from edge_rows import document_rows
from pyspark.sql import functions as F

from fieldhush.llm import hard_negatives, sharding, spelling
from fieldhush.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(n):
    """Words meet by what is left when one letter goes; every pair is then looked at letter by letter."""
    by = defaultdict(set)
    for w in n:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by[x].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_error(a, b)}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_of_the_table(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got, want = rows_of(QUERIES["op11_spelling_variants"](spark, SF)), brute_variants(words_of(texts))
    assert got == want and any(w[4] for w in want)


def test_variants_in_cells(spark):
    """A hot beginning and a hot end cut into many cells, chains of forms, long words in their own length classes."""
    rnd = random.Random(3)
    n = Counter()
    for _ in range(1500):
        core = "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 5)))
        n[rnd.choice(["prefix", "preÿfi"]) + core + rnd.choice(["", "suffix", "uffix"])] += rnd.choice([1, 1, 3, 40, 900])
    n += Counter({"colours": 1, "colour": 99, "colourss": 20, "coloursss": 300, "coloursssx": 4000})
    for size in (47, 48, 49, 50, 95, 96, 97, 98, 5000, 5001):
        n[("longword" * (size // 8 + 1))[:size]] += size
    n = {w: c for w, c in n.items() if len(w) >= 7}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = {(r.word, r.n_near, r.best, r.best_n) for r in spelling.near_words(words, cell_words=64).collect()}
    want = {(w, k, f) for w, f, _, _, k, _ in brute_variants(n)}
    assert {(w, k) for w, k, *_ in got} == {(w, k) for w, k, _ in want if k}
    assert {(w, b) for w, _, b, m in got if m >= 10 * n[w]} == {(w, f) for w, _, f in want if f}
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {(r.word, r.root) for r in spelling.followed(chain).collect()} == {(f"w{i}", "w13") for i in range(13)}


def test_variants_of_edge_rows(docs, no_docs):
    rows = [(r[0], r[1]) for r in document_rows()]
    assert rows_of(spelling.variants(docs)) == brute_variants(words_of(rows))
    assert spelling.variants(no_docs).count() == 0
    assert spelling.variants(docs.filter("text is null")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, min_chars=6)


def test_differencing_is_tight():
    rnd = random.Random(1)
    w = [int(rnd.lognormvariate(8, 1)) + 1 for _ in range(3000)]
    sums = [0] * 16
    for x, p in zip(w, sharding.difference(w, 16), strict=True):
        sums[p] += x
    assert max(sums) - min(sums) <= 16 and sums == sorted(sums, reverse=True)
    # The textbook case: 8 7 6 5 4 into two parts leaves a difference of 2.
    two = sharding.difference([8, 7, 6, 5, 4], 2)
    assert abs(sum(x if p else -x for x, p in zip([8, 7, 6, 5, 4], two, strict=True))) == 2
    assert sharding.difference([], 3) == [] and sharding.difference([5], 3) == [0]


def check_shards(rows, got, n=16):
    assert sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows) == sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got)
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None} and {r.shard for r in got} <= set(range(n))
    slots, shards, sums = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.text_crc32, r["size"]].add(r.shard)
        sums[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    return [sums[s] for s in range(n)]


def test_shards_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    sums = check_shards(rows, QUERIES["op12_differencing_shards"](spark, SF).collect())
    assert max(sums) - min(sums) < 0.01 * sum(sums) / 16 or max(sums) == max(len((t or "").encode()) + 1 for _, t in rows)


def test_shards_in_levels(spark):
    """Several levels of bundles beside a group of a third of all bytes, which stands alone among even shards."""
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(5, 300)) for i in range(3000)]
    rows = [(i, f"{i} {t}") for i, t in rows]
    rows += [(None if i % 7 else 5000 + i, "the same text, many times over") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shards(docs, bucket_items=64, last_items=256).collect()
    sums = sorted(check_shards(rows, got))
    assert sums[-1] == 8000 * 31 and sums[-2] - sums[0] <= 0.01 * sums[0]


def test_shards_of_edge_rows(docs, no_docs):
    check_shards([(r[0], r[1]) for r in document_rows()], sharding.shards(docs).collect())
    assert sharding.shards(no_docs).count() == 0


def brute_negatives(rows, anchors):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for p, (a, la, va) in enumerate(rows):
        if not anchors(a):
            continue
        scored = sorted((-dot(va, v), i, lab) for q, (i, lab, v) in enumerate(rows) if q != p)
        for s, i, _ in [x for x in scored if x[2] == la][:5]:
            window = [(-t, j) for t, j, lab in scored if lab != la and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, i, k, j, -s, t) for k, (t, j) in enumerate(window[:5], 1)]
    return Counter(out)


@pytest.mark.parametrize("scale", [20, 10**8])
def test_hard_negatives(spark, scale):
    """Clusters, equal vectors, repeated ids, short vectors and tiny cells; with large components in 64-bit arithmetic."""
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((12, 6))
    rows = []
    for i in range(600):
        v = centres[i % 12] * scale + rnd.standard_normal(6) * scale * (0.05 if i % 3 else 1.0)
        rows.append((int(i % 590), int(rnd.integers(4)), [int(x) for x in v][: 4 if i % 50 == 0 else 6]))
    rows += [(1000 + i, i % 3, [scale] * 6) for i in range(40)] + [(2000, 1, []), (2100, 9, [1, 2, 3])]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, label int, vector array<long>, row int, score int").repartition(6)
    bad = spark.createDataFrame([(None, 1, [1], 1, 1), (1, None, [1], 1, 1), (2, 1, None, 1, 1), (3, 1, [1, None], 1, 1)], d.schema)
    got = hard_negatives.hard_negatives(d.union(bad), F.col("id") % 20 == 0, anchors=16, cell_rows=100)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 20 == 0)
    assert hard_negatives.hard_negatives(d.limit(0), F.col("id") % 20 == 0).count() == 0
    assert hard_negatives.hard_negatives(d, F.lit(False)).count() == 0


def test_tree_bounds_spare_scores():
    """Near anchors ask for far fewer scores than there are pairs, and lose none."""
    rnd = np.random.default_rng(7)
    x = (rnd.standard_normal((2000, 32)) * 100).astype(np.int64)
    a = (rnd.standard_normal(32) * 100).astype(np.int64) + rnd.integers(-2, 3, (64, 32))
    order, parent, edge = hard_negatives.spanning_tree(a)
    assert sorted(order) == list(range(64)) and (parent[1:] < np.arange(1, 64)).all() and parent[0] == -1
    tree = hard_negatives.Tree(order, order, a[order], parent, edge)
    s = a[order] @ x.T
    low, high = np.quantile(s, 0.99, axis=1).astype(np.int64), np.quantile(s, 0.995, axis=1).astype(np.int64)
    got = {(i, int(c)) for i, cols, _ in tree.scan(x, lambda at: np.ones((len(at), len(x)), bool), low, high) for c in cols}
    assert got == {(int(i), int(j)) for i, j in np.argwhere((s >= low[:, None]) & (s <= high[:, None]))}
    assert tree.scored < 0.2 * s.size


def test_scaled(spark):
    d = spark.createDataFrame([(1, [0.5, -0.001]), (2, [math.nan]), (3, [math.inf, 1.0]), (4, [None]), (5, None), (6, [])], "i int, v array<float>")
    assert {r.i: r.s for r in d.select("i", hard_negatives.scaled(F.col("v")).alias("s")).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
