"""The kernel against a plain count of subsequences, and the trained model on held-out documents."""

import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest

from fieldhush.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain_kernel(a, b):
    """Common subsequences of 3 characters within 5 places and of 4 within 6, each side weighted by its gaps."""

    def count(w):
        out = {}
        w = f"^{w}$"
        for i in range(len(w)):
            for n, span in ((3, 5), (4, 6)):
                for rest in combinations(range(i + 1, min(i + span, len(w))), n - 1):
                    at = (i, *rest)
                    key = "".join(w[j] for j in at)
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - i + 1 - n)
        return out

    x, y = count(a), count(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def mapped(word):
    _, where, weight, _ = toxicity._maps([word])
    out = np.zeros(1 << toxicity.TABLE_BITS)
    np.add.at(out, where, weight.astype(float))
    return out


@pytest.mark.parametrize(("a", "b"), [("idiot", "idiot"), ("idiot", "id*iot"), ("moron", "m-o-ron"), ("worthless", "worthy"), ("abc", "xyz")])
def test_kernel(a, b):
    # Different subsequences share a table entry now and then, so values agree closely and not to the last digit.
    assert mapped(a) @ mapped(b) == pytest.approx(plain_kernel(a, b), rel=0.02, abs=0.6)


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.sql(f"SELECT d.doc_id, d.text, l.toxic FROM '{SF}/documents.parquet' d JOIN '{SF}/labels.parquet' l ON l.doc_id = d.doc_id WHERE l.toxic IS NOT NULL ORDER BY 1").fetchall()
    return [(zlib.crc32(str(i).encode()) % 3 == 1, t or "", y == 1) for i, t, y in rows]


def test_held_out_documents(labelled):
    learned = [(t, y) for out, t, y in labelled if not out]
    toxic = np.array([y for _, y in learned])
    model = toxicity.train([t for t, _ in learned], toxic, float(toxic.mean()))
    score = lambda texts: model.score(np.array([toxicity.document_summary(model, t) for t in texts]))
    bad, good = score([t for out, t, y in labelled if out and y]), score([t for out, t, y in labelled if out and not y])
    assert (bad >= 0.7).mean() >= 0.85 and (good >= 0.7).mean() <= 0.01
    # Plain insults of the training documents, alone in a sentence, and hidden ones.
    seen, clean = {}, set()
    for t, y in learned:
        for w in {toxicity.bare(w) for w in t.lower().split()}:
            if y:
                seen[w] = seen.get(w, 0) + 1
            else:
                clean.add(w)
    insults = [w for w, n in seen.items() if n >= 50 and w not in clean]
    sentence = lambda w: f"so that one there is a {w} and no more"
    assert len(insults) >= 8
    assert (score([sentence(w) for w in insults]) >= 0.7).all()
    assert (score([sentence(w[:k] + c + w[k:]) for w in insults for k in (2, 3) for c in "*-"]) >= 0.7).mean() > 0.95
    assert (score([sentence(w) for w in ("house", "table", "morning", "language")]) < 0.3).all()


def test_evidence_needs_more_than_chance():
    from collections import Counter

    toxic, clean = Counter({"insult": 9, "quoted": 30, "rare": 1, "common": 20}), Counter({"quoted": 1, "common": 180, **{f"w{i}": 5 for i in range(400)}})
    assert set(toxicity.evidence(toxic, clean)) == {"insult", "quoted"}


def test_learning_needs_little_memory():
    """The driver learns beside its JVM: arrays and sets of the whole sample must not be held at once."""
    import tracemalloc

    rnd = np.random.default_rng(1)
    names = np.array([f"word{i}" for i in range(3000)])
    sentence = lambda insult: " ".join([*names[rnd.integers(0, len(names), 7)], *insult])
    texts = [". ".join(sentence(["blockhead"] if i % 2 and j < 3 else []) for j in range(250)) for i in range(400)]
    toxic = np.arange(400) % 2 == 1
    tracemalloc.start()
    model = toxicity._machine(texts, toxic, 32, 0)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert model.words(["blockhead"])[0] > 0 > model.words(["word7"])[0]
    assert peak < 45, peak  # 700,000 words; 78 MB when copies of all arrays and a set of each sentence were kept


def test_nothing_to_learn_from_texts_without_words():
    both = np.array([True, False])
    assert toxicity._machine(["", " \n"], both, 16, 0) is None
    assert toxicity._machine(["...", "a clean text"], both, 16, 0) is None
    assert toxicity._machine(["a b", "c d"], both & False, 16, 0) is None
