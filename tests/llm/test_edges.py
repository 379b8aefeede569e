"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import hashlib

import pytest
from edge_rows import document_rows

from fieldhush.llm import exact_dedup, jaccard, language, line_dedup, mixing, packing, rules, tokens, toxicity, warc
from fieldhush.llm.bitplanes import token_file

ROWS = document_rows()


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact_groups(docs):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect())
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(low(t), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        free = True
        for i in ids:
            want.append((str(i), str(keep), len(ids), i == keep and free, hashlib.sha256(t.encode()).hexdigest()))
            free &= i != keep
    assert got == sorted(want)


def test_exact_dedup_keeps_columns(docs, no_docs):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == len({low(r[1]) for r in ROWS})
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_equal_block_keys_are_told_apart(spark):
    """With keys of a few bits two blocks get one key under some seeds; the names stay exact."""
    d = spark.createDataFrame([(i, f"text {i % 5} " * 3) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(d, block_chars=8, key_bits=5).collect()}
    assert got == {i: (15 + i % 5, 4) for i in range(20)}


def test_long_texts_with_equal_first_blocks(spark):
    """Texts of as many blocks differ in a later one: every block counts, not the first alone."""
    texts = ["a" * 8192, "A" * 8192, "a" * 4097, "a" * 4096 + "b", "a" * 8193, "a" * 12288, "a" * 4096]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(d).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), **{i: (i, 1, True) for i in range(2, 7)}}


def test_mix(docs, no_docs):
    m = mixing.mix(docs).collect()
    assert len(m) == len(ROWS)
    assert all(r["size"] == len((t or "").split()) for r in m for i, t, *_ in ROWS if i is not None and i == r.doc_id and i != 7)
    assert all(0 <= r.copies <= 2 for r in m)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in m)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_mix_with_only_empty_texts(docs):
    assert {r.copies for r in mixing.mix(docs.filter("trim(text) = '' or text is null")).collect()} == {0}


def test_packing(docs, no_docs):
    p = packing.packed_documents(docs).collect()
    seq = {}
    for r in p:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len([r for r in p if r.piece == 0]) == len(ROWS)
    assert {r.length for r in p if r.doc_id in (4, 5, 6)} == {1}
    assert packing.packed_documents(no_docs).count() == 0


def test_token_file(docs, no_docs):
    r = token_file(docs).orderBy("start").collect()
    assert [x.doc_id for x in r] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    for x in r:
        assert x.start == at and len(x.ids) == 4 * x.n_tokens and x.ids[-4:] == bytes(4)
        at += x.n_tokens
    assert token_file(no_docs).count() == 0


def test_warc(spark, no_docs):
    rows = [(3, "u", "<p>a</p>"), (1, None, "<p>a</p>"), (1, "u", "<p>a</p>"), (2, "bad\r\nurl", None), (5, "u", ""), (None, "u", "<p>a</p>"), (None, "v", "only"), (6, "u", "é" * 400_000)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, row int, sha1 int")
    got = warc.archive(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([
        ("3", 8, "revisit", 1), ("1", 8, "response", None), ("1", 8, "revisit", 1), ("2", 0, "response", None), ("5", 0, "revisit", 2), ("None", 8, "revisit", 1),
        ("None", 4, "response", None), ("6", 800_000, "response", None)])
    assert all(r.payload_digest == warc.payload_digest(next((h or "").encode() for i, _, h in rows if i == r.page_id)) for r in got if r.page_id)
    assert warc.archive(pages, min_payload=9).filter("record_type = 'revisit'").count() == 0
    assert warc.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
def test_line_dedup(docs, no_docs, unit):
    spans = line_dedup.repeated_spans(docs, unit=unit, min_span_words=10).collect()
    assert {r.doc_id for r in spans} >= {2, 3}
    assert all(r.keep_doc_id == 1 for r in spans if r.doc_id in (2, 3))
    out = line_dedup.remove_repeats(docs, unit=unit, min_span_words=10)
    assert out.count() == len(ROWS) and out.filter("text is null").count() == 2
    assert line_dedup.repeated_spans(no_docs).count() == 0 and line_dedup.remove_repeats(no_docs).count() == 0


def test_toxicity(docs, no_docs, labels):
    r = toxicity.toxicity(docs, labels).collect()
    assert len(r) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in r)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_language(docs, no_docs):
    r = language.identify(docs).collect()
    assert len(r) == len(ROWS) and all(0 <= x.score <= 1 for x in r)
    assert {x.lang_pred for x in r if x.doc_id in (4, 5, 6)} == {"und"}
    assert language.identify(no_docs).count() == 0
    assert {x.lang_pred for x in language.identify(docs.filter("lang is null")).collect()} == {"und"}


def test_jaccard(docs, no_docs):
    r = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.similar_components(docs).collect()}
    assert {(1, 9, 1), (2, 9, 1), (3, 9, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 0, None), (8, 1, 8), (9, 59_996, 9), (10, 1, 10)} <= r
    out = jaccard.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(x.doc_id for x in out.collect() if x.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard.near_dedup(no_docs).count() == 0 and jaccard.similar_components(no_docs).count() == 0


def test_rules(docs, no_docs, labels):
    out, _ = rules.quality_rules(docs, labels)
    r = {x.doc_id: x for x in out.collect()}
    assert len(r) == len({i for i, *_ in ROWS}) and out.count() == len(ROWS)
    assert r[8].base_failed and not r[8].kept and r[4].n_words == 0 and r[9].n_words == 60_000
    assert rules.quality_rules(no_docs, labels)[0].count() == 0
    assert rules.quality_rules(docs, labels.limit(0))[1] == []


def test_pieces_of_nothing(no_docs):
    assert tokens.token_pieces(no_docs, tokens.vocabulary("word_bpe_49k.json")).count() == 0
