"""Cases in which an operator once did less than the whole job."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldhush.llm import jaccard, line_dedup
from fieldhush.llm.wordvec import shingle_sets


def windows(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_repeats_with_short_units_go_whole(spark):
    """Passages are found by word windows, whatever the units are."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    own = lambda: sentence(9) + " " + sentence(3) + " " + sentence(8)
    passage = " ".join(sentence(n) for n in (8, 2, 11, 1, 3, 6, 14, 2, 9)) + "\n" + sentence(12)
    line = sentence(6)
    rows = [(i, f"{own()} {passage} {own()}\n{line}\n{own()}") for i in range(8)]
    first, short, last = sentence(7), "Three short words.", sentence(7)
    rows += [(8, f"{first} {short} {last}"), (9, f"{first} Not the same. {last}"), (10, f"{first} {short} {last}")]
    out = {r.doc_id: r for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out[0].text == rows[0][1] and out[0].removed is None
    for i, t in rows[1:8]:
        assert not windows(out[i].text, 5) & (windows(passage, 5) | windows(line, 5)), i
        assert out[i].text.lower().split() == t.replace(passage, "").replace(line, "").lower().split()
        assert len(out[i].removed) == 2
    assert [out[i].text.strip() for i in (8, 9, 10)] == [rows[8][1], "Not the same.", ""]


def test_bridge_of_rows_that_share_a_key(spark):
    """Of two rows with one key, offsets decide: a bridge may come first in the row whose units come later."""
    a, b, pad = "Alpha beta gamma delta.", "Omega psi chi phi.", " " * 40
    rows = [(1, f"{a}{pad}{pad} So. {b}"), (1, f"{pad}{a} So. {b}")]
    spans = line_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.words for r in spans) == [4, 4] and all(r.units == 1 for r in spans)


def two_texts_under_one_id():
    rnd = random.Random(11)
    a, b, c = (" ".join(f"{x}{rnd.randrange(10**6)}" for _ in range(60)) for x in "abc")
    near = lambda t, w: t + " " + w
    return [(5, a), (5, b), (7, near(a, "seven")), (9, near(b, "nine")), (11, c), (11, near(a, "eleven")), (None, a), (13, ""), (13, None)]


def test_every_text_of_a_key_links(spark):
    d = spark.createDataFrame(two_texts_under_one_id(), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(d).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 11: 5, 13: 13, None: None}


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark):
    rows = two_texts_under_one_id()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_dedup(d)
    assert got.columns == d.columns
    # 7, 9 and one row of 11 are near copies of the two texts of 5; the other row of 11 is like nothing else.
    assert Counter(tuple(r) for r in got.collect()) == Counter([rows[0], rows[1], rows[4], *rows[6:]])


def test_near_dedup_of_equal_rows_under_one_id(spark):
    d = spark.createDataFrame([(2, "one two three four five six"), (2, "one two three four five six"), (3, "one two three four five six")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.near_dedup(d).collect()] == [(2, "one two three four five six")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_key_bitmaps_keep_every_key(spark, kind):
    """Rows of wanted keys all pass and few others do, so that joins need not shuffle texts that they would drop."""
    rows = spark.range(20_000).select(F.col("id").cast(kind).alias("key"), F.lit("x").alias("text"))
    got = jaccard.may_hold(rows, rows.filter("cast(key as long) % 50 = 0").select("key"))
    assert got.columns == ["key", "text"]
    keys = {int(r.key) for r in got.collect()}
    assert keys >= set(range(0, 20_000, 50)) and len(keys) < 500
    full = jaccard.may_hold(rows, rows.select("key"), bits=15)
    assert full.count() == 20_000
    assert jaccard.may_hold(rows, rows.limit(0).select("key")).count() == 0


def test_shingles_hold_a_slice_at_a_time():
    """8 MB of text took some 200 MB of a worker when slices were 4 MB."""
    text = " ".join(f"w{i % 977}" for i in range(200))
    texts = pa.array([text] * (8 * 10**6 // len(text)))
    tracemalloc.start()
    try:
        assert len({len(e) for e in shingle_sets(texts)}) == 1
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
