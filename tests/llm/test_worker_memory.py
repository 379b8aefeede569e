"""What a Python worker holds while it reads a batch of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fieldhush.llm import packing, stages, tokens, wordvec


def test_shingles_of_a_long_batch_in_little_memory():
    rnd = np.random.default_rng(3)
    names = np.array([f"w{i}" for i in range(5000)])
    texts = pa.array([" ".join(names[rnd.integers(0, len(names), 300)]) for _ in range(2000)])
    list(wordvec.shingle_sets(texts.slice(0, 1)))
    tracemalloc.start()
    sizes = [len(e) for e in wordvec.shingle_sets(texts)]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sizes == [len(e) for i in range(0, 2000, 7) for e in wordvec.shingle_sets(texts.slice(i, 7))]
    assert peak < 16, peak


def test_packing_stage_encodes_small_slices(monkeypatch):
    rnd = np.random.default_rng(4)
    names = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(names[rnd.integers(0, len(names), 4000)]) for _ in range(150)] + [None, "x" * (1 << 21), ""]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    path, said = tokens.vocabulary("word_bpe_49k.json"), {}
    monkeypatch.setattr(packing, "packed_documents", lambda docs, **options: said.update(options))
    stages.pack.__wrapped__(None, None, "")
    small = list(tokens.encoded([batch], path, **said))
    assert [x for _, ids in small for x in ids] == [x for _, ids in tokens.encoded([batch], path) for x in ids]
    sizes = [[len(t or "") for t in part["text"].to_pylist()] for part, _ in small]
    assert sum(map(len, sizes)) == len(texts)
    assert all(sum(s) <= 1 << 20 or len(s) == 1 for s in sizes)
