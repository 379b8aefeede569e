"""The operators against plain Python on the smallest tables, and SQL where there is SQL."""

import random
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fieldhush.llm import bitplanes, jaccard, line_dedup, mixing, packing, rules, tokens, toxicity
from fieldhush.llm.queries import QUERIES, SQL
from fieldhush.llm.wordvec import shingle_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(sets, pct=80):
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * both >= pct * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    from compare import compare, duck

    ok, message = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_jaccard(spark, texts):
    sets = {i: shingles(t) for i, t in texts}
    comp = brute_components(sets)
    got = {tuple(r) for r in QUERIES["op9_ngram_jaccard"](spark, SF).collect()}
    assert got == {(i, len(s), comp[i]) for i, s in sets.items()}


def test_jaccard_on_edited_copies(spark):
    """Chains of edits around the limit, in short and long texts, with many near copies of one text."""
    rnd = random.Random(3)
    rows = []
    for n in (5, 6, 7, 9, 12, 20, 60, 200):
        base = [f"w{rnd.randrange(400)}" for _ in range(n)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(1 + n // 12)):
                w[rnd.randrange(n)] = f"x{rnd.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
            if rnd.random() < 0.3:
                base = w
    sets = {i: shingles(t) for i, t in rows}
    for pct in (80, 60):
        comp = brute_components(sets, pct)
        d = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard.similar_components(d, pct=pct).collect()}
        assert got == comp


def test_signatures_of_similar_sets_meet():
    """Any two sets within the limit share a chosen signature, whatever the order is."""
    rnd = np.random.default_rng(0)
    for _ in range(1500):
        n = int(rnd.integers(1, 120))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = a[rnd.random(len(a)) > rnd.random() * 0.2]
        b = np.unique(np.concatenate([b, rnd.integers(0, 2**63, int(rnd.integers(0, 1 + n // 6))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        sketch = rnd.integers(0, 3, 1 << jaccard.SKETCH_BITS).astype(np.int32)
        assert np.intersect1d(jaccard.chosen(a, 80, sketch), jaccard.chosen(b, 80, sketch)).size
        x, y = (np.packbits(jaccard.bitmap(e), bitorder="little").tobytes() for e in (a, b))
        assert jaccard.least_difference(x, y) <= len(a) + len(b) - 2 * both


def test_scheme_bounds():
    """By brute force: no choice of k differing parts breaks as many signatures as ``needed`` says are required."""
    from itertools import combinations

    for k in range(6):
        n1, n2, k2 = jaccard.scheme(k)
        subsets = [(g, frozenset(c)) for g in range(n1) for c in combinations(range(n2), n2 - k2)]
        parts = [(g, p) for g in range(n1) for p in range(n2)]
        worst = max(sum(any(g == h and p in s for h, p in hit) for g, s in subsets) for hit in combinations(parts, k)) if k else 0
        assert worst < jaccard.needed(k, n1, n2, k2) <= len(subsets)


def test_shingle_sets_count_distinct(texts):
    import pyarrow as pa

    assert [len(e) for e in shingle_sets(pa.array([t for _, t in texts]))] == [len(shingles(t)) for _, t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_ids_of_whole_texts(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    odd = ["", " a", "a ", "a  b", "a\n\nb", "x\ty", "Hello, world's best! it's 'll", "<|endoftext|> hi a<|endoftext|>.b", "é café", "a b", "a\nB\nc", "\n",
           "foo.\nBar, ba'z 12 3.4 !? .. x***", "ΑΣ Σ ß ſt", "日本 語", "a\0b c", "ª ʰx Ⅷ ²x", "dogs' 's", "a b\nc!\nDD?\n1"]
    every = [x for _, x in texts] + odd
    enc = tokens.UnitEncoder(tokens.vocabulary(name), kept_units=1000)
    for _ in range(2):
        for x, ids in zip(every, enc.encode(every), strict=True):
            assert ids == array("I", t.encode(x, add_special_tokens=False).ids).tobytes(), x


def ids_of(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    return {i: array("I", [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in texts}


def test_packing(spark, texts):
    ids = ids_of(texts, "word_bpe_49k.json")
    rows = QUERIES["op3_best_two_fit"](spark, SF).collect()
    want = {(i, p, p * 2048, len(c), zlib.crc32(c.tobytes())) for i, x in ids.items() for p in range(-(-len(x) // 2048)) for c in [x[p * 2048 : (p + 1) * 2048]]}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seq) <= 1.02 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_sequences_hold_their_ids(spark):
    d = spark.createDataFrame([(i, "some words here " * (i % 9 * 60 + 1)) for i in range(40)], "doc_id long, text string")
    pieces = tokens.token_pieces(d, tokens.vocabulary("word_bpe_49k.json"))
    placed = packing.pack(pieces.drop("ids"), ["doc_id", "piece"])
    s = packing.sequences(placed, pieces).collect()
    assert sum(len(r.ids) for r in s) == 4 * sum(r.length for r in pieces.collect()) and max(len(r.ids) for r in s) <= 4 * 2048


def test_two_fit_beats_greedy_filling():
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = [1, 1, 2]  # 6 + 3 leaves a gap of 1; 6 + 2 + 2 fills it
    assert packing.plan(counts, 10)[0] == ((6, 2, 2), 1)
    rnd = np.random.default_rng(1)
    for _ in range(50):
        counts = rnd.integers(0, 5, 65) * (np.arange(65) > 0)
        used = np.zeros(65, int)
        for lengths, times in packing.plan(counts, 64):
            assert sum(lengths) <= 64 and times > 0
            np.add.at(used, list(lengths), times)
        assert (used == counts).all()


def test_planes(spark, texts):
    at, want = 0, []
    for i, x in ids_of(texts, "byte_bpe_50k.json").items():
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in QUERIES["op7_token_planes"](spark, SF).collect()) == want


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_file(tmp_path, kind):
    import pyarrow as pa

    ids = np.random.default_rng(0).integers(0, 50_000, 1003).astype("<u4")
    with open(tmp_path / "x", "wb") as f:
        w = bitplanes.PlaneWriter(f, block_ids=128, kind=kind)
        for i in range(0, 1003, 100):
            w.add(ids[i : i + 100].tobytes())
        w.close(pa.table({"key": [1], "n": [1003]}))
    with pa.OSFile(str(tmp_path / "x")) as f:
        r = bitplanes.PlaneFile(f)
        assert (r.read(0, 1003) == ids).all() and (r.read(200, 300) == ids[200:500]).all() and len(r.read(5, 0)) == 0
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-1])
    with pa.OSFile(str(tmp_path / "y")) as f, pytest.raises(ValueError, match="cut short"):
        bitplanes.PlaneFile(f)


def test_mix(spark):
    rows = QUERIES["op1_source_mix"](spark, SF).collect()
    assert sorted(rows) == sorted(QUERIES["op1_source_mix"](spark, SF).collect())
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF}/documents.parquet'").fetchall())
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken <= 2 * r.size
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    want, free, rest = {}, set(size), 1.5 * sum(size.values())
    while True:  # share by weight, stop what is above, share the rest again
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            rest -= want[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s]


def test_pivotal_keeps_mass_and_means():
    rnd = np.random.default_rng(0)
    size = rnd.integers(1, 50, 301).astype(float)
    p = np.full(301, 0.3)
    total = np.zeros(301)
    for i in range(400):
        out = mixing.pivotal(p, size, rnd.integers(0, 2**63, 301).astype(np.uint64))
        part = (out > 1e-9) & (out < 1 - 1e-9)
        assert part.sum() <= 1 and (out * size).sum() == pytest.approx((p * size).sum())
        total += out
    assert abs(total / 400 - 0.3).max() < 0.12


def test_mix_through_the_tree(spark):
    """Small buckets and a fan-in of 2: residuals climb several levels, and the target is still met."""
    from pyspark.sql import functions as F

    r = spark.range(3000).select(F.col("id").alias("row"), "id", F.lit(0).alias("sid"), (F.col("id") % 37 + 1).alias("size"), F.lit(0.37).alias("want"), F.lit(3000).cast("long").alias("docs"))
    out = r.join(mixing.copies(r, bucket_rows=64, fan_in=2), "row").agg(F.sum(F.col("size") * F.col("copies")), F.sum("size"), F.count("*")).first()
    assert out[2] == 3000 and abs(out[0] - 0.37 * out[1]) <= 37


def test_counts(spark, texts):
    for r in QUERIES["op10_quality_rules"](spark, SF).collect():
        t = dict(texts)[r.doc_id] or ""
        w = t.encode().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in t.encode().split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in rules.SYMBOLS), dup, len(hit))
        assert tuple(r)[1:6] == want
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_rules_find_a_planted_list():
    import pandas as pd

    rnd = np.random.default_rng(0)
    x = pd.DataFrame(rnd.random((4000, 4)), columns=["symbol_share", "upper_share", "n_words", "word_length"])
    bad = ((x["symbol_share"] > 0.8) & (x["n_words"] < 0.6)) | (x["upper_share"] > 0.9)
    found = rules.learn_rules(x, bad.to_numpy())
    guess = np.zeros(len(x), bool)
    for rule in found:
        guess |= rules.covers(rule, x)
    assert (guess == bad).mean() > 0.97 and rules.learn_rules(x, np.zeros(4000, bool)) == []


def test_repeated_spans(spark, texts):
    """All later units go, and the short units that stand between the same two units again; by plain loops over one list of texts."""
    import re

    spans = {(r.doc_id, r.start, r.end, r.words, r.units) for r in QUERIES["op5_repeated_spans"](spark, SF).collect()}
    parts = {}  # of each text: long units, and the short ones after each
    for i, t in texts:
        parts[i] = here = []
        for m in re.finditer(line_dedup.UNITS["sentence"], t or ""):
            w = m[0].encode().lower().split()
            if len(w) >= 4:
                here.append(((*m.span(), w), []))
            elif w and here:
                here[-1][1].append((*m.span(), w))
    seen, seen_between, want = set(), set(), set()
    for i, here in sorted(parts.items()):
        run = []

        def close(run, i=i):
            if run:
                want.add((i, run[0][0], run[-1][1], sum(len(u[2]) for u in run), len(run)))

        for k, (unit, short) in enumerate(here):
            old = tuple(unit[2]) in seen
            seen.add(tuple(unit[2]))
            if not old:
                close(run)
                run = []
                between = []
            elif k and run and between:
                same = (tuple(here[k - 1][0][2]), tuple(tuple(u[2]) for u in between), tuple(unit[2])) in seen_between
                if same:
                    run = [*run, *between, unit]
                else:
                    close(run)
                    run = [unit]
            else:
                run = [*run, unit]
            if k and here[k - 1][1]:
                seen_between.add((tuple(here[k - 1][0][2]), tuple(tuple(u[2]) for u in here[k - 1][1]), tuple(unit[2])))
            between = short
        close(run)
    assert spans == want


def test_toxicity_holds_out():
    """A planted vocabulary with endings: held-out documents are told apart, hidden spellings too, and clean ones left alone."""
    rnd = random.Random(0)
    plain = ["".join(rnd.choice("aeiou") + rnd.choice("bdfgklmnprst") for _ in range(3)) for _ in range(800)]
    ends = ["x", "yw", "ha", "zed", "qi", "ov"]

    def doc(bad):
        w = [rnd.choice(plain) for _ in range(80)]
        if bad:
            w[rnd.randrange(80)] = rnd.choice(["jerkwad", "scumbag"]) + rnd.choice(ends)
        return " ".join(w) + "."

    y = np.array([i % 4 == 0 for i in range(1200)])
    docs = [doc(b) for b in y]
    model = toxicity.train(docs[:800], y[:800], 0.25)
    p = model.score(np.array([toxicity.document_summary(model, t) for t in docs[800:]]))
    assert (p[y[800:]] >= 0.7).mean() > 0.95 and (p[~y[800:]] >= 0.7).mean() < 0.02
    hidden = ["jerk-wadx", "j e r k w a d x", "scum*bagyw", "jerkqwadx"]
    assert all(model.score(np.array([toxicity.document_summary(model, f"{plain[0]} {h} {plain[1]}")]))[0] > 0.5 for h in hidden[:3])
    clean = model.words([plain[5]])[0]
    assert model.words([hidden[3]])[0] > clean


def test_language_holds_out(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op8_language_mixture"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows) > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_pipeline(spark, texts):
    """Each stage on what the one before kept."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in c.STAGES[:4]:
        out = c.materialize(stage(spark, kept, SF))
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.collect()]
        before = {r.doc_id: r.text for r in kept.collect()}
        assert set(ids) <= set(before)
        if name == "exact_dedup":
            top = {}
            for i, t in before.items():
                low = t.translate({x: x + 32 for x in range(65, 91)})
                top[low] = max(top.get(low, -1), i)
            assert sorted(ids) == sorted(top.values())
        if name == "near_dedup":
            comp = brute_components({i: shingles(t) for i, t in before.items()})
            assert sorted(ids) == sorted(set(comp.values()))
        if name == "source_mix":
            assert max(Counter(ids).values()) <= 2
        kept = out
    packed = c.STAGES[4][1](spark, kept, SF)
    n = ids_of([(r.doc_id, r.text) for r in kept.collect()], "word_bpe_49k.json")
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(n[r.doc_id]) for r in kept.collect())
