"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character trigrams, counted over all training documents. A document is a mixture: every word is
drawn from one language, and the shares of the languages are what expectation-maximisation finds from the words' likelihoods. Sets
of languages are nested by share; the set with the best likelihood less a penalty of half the log of the number of words
for each language more is chosen, and the mixture is fitted again on it. The prediction is the language with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.llm.common import fold

BITS = 16
ROUNDS, MOST = 8, 4
UNKNOWN = "und"
SLICE_CHARS = 1 << 20

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram entry of every letter, first letter of every word, document of every word).

    A trigram is a letter with its neighbours; whatever is not a letter counts as one and the same mark.
    """
    low = [t.lower() for t in texts]
    s = np.frombuffer(("\n".join(["", *low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    is_letter = letters()[s]
    x = np.where(is_letter, s, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    h = (x[at - 1] * np.uint32(2654435761)) ^ (x[at] * np.uint32(2246822519) + np.uint32(1)) ^ ((x[at + 1] + np.uint32(77)) * np.uint32(3266489917))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(668265263)
    first = np.flatnonzero(~is_letter[at - 1])
    return h >> np.uint32(32 - BITS), first, np.searchsorted(ends, at[first], "right")


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        s = t.as_py() or ""
        part.append(s)
        size += len(s)
        if size > SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, counts) from columns lang and text: 2 ** BITS counts for each language, summed over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            i = 0
            for part in _slices(batch["text"]):
                own = np.array(langs[i : i + len(part)], object)
                i += len(part)
                for lang in set(own):
                    g, _, _ = trigrams([t for t, o in zip(part, own, strict=True) if o == lang])
                    total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    total[lang] += np.bincount(g, minlength=1 << BITS)
        for lang, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.tobytes()], pa.binary())], names=["lang", "counts"])

    def add(t: pa.Table) -> pa.Table:
        n = np.zeros(1 << BITS, np.int64)
        for x in t["counts"]:
            n += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"lang": t["lang"].slice(0, 1), "counts": pa.array([n.tobytes()], pa.binary())})

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, counts binary")
    # Sixteen tasks' tables at a time, then the sums: no task adds up more than its share.
    some = parts.withColumn("g", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("lang", "g").applyInArrow(add, "lang string, counts binary")
    return some.groupBy("lang").applyInArrow(add, "lang string, counts binary")


def log_table(counts: np.ndarray, smooth: float = 0.2) -> np.ndarray:
    """Log-probabilities, a row per language; entries that no language has count for none."""
    c = counts.astype(np.float64)
    return np.log((c + smooth) / (c.sum(1, keepdims=True) + smooth * c.shape[1])).astype(np.float32)


def _fit(like: np.ndarray, starts: np.ndarray, size: np.ndarray, allowed: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of the allowed languages in each document. ``like``: words x languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        r = like * np.repeat(share, size, 0)
        r /= r.sum(1, keepdims=True) + 1e-30
        share = np.add.reduceat(r, starts, 0) / size[:, None]
    return share


def infer(texts: list[str], table: np.ndarray, rounds: int = ROUNDS, most: int = MOST, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(best language or -1, its share) of each text; -1 where a text has no letter."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    g, first, doc = trigrams(texts)
    if not len(first) or not len(table):
        return best, score
    log = np.stack([np.add.reduceat(row[g], first) for row in table], 1)
    top = log.max(1, keepdims=True)
    like = np.exp(log - top).astype(np.float32)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(starts, len(doc)))
    n, k = len(starts), len(table)
    share = _fit(like, starts, size, np.ones((n, k), np.float32), rounds)
    order = np.argsort(-share, 1, kind="stable")
    rank = np.argsort(order, 1)
    value, chosen = np.full(n, -np.inf), share
    for m in range(1, min(k, most) + 1):
        s = _fit(like, starts, size, (rank < m).astype(np.float32), rounds if m > 1 else 1)
        fit = np.add.reduceat(np.log((like * np.repeat(s, size, 0)).sum(1) + 1e-30), starts) - penalty * (m - 1) * np.log(size + 1)
        better = fit > value
        value = np.where(better, fit, value)
        chosen = np.where(better[:, None], s, chosen)
    docs = doc[starts]
    best[docs] = chosen.argmax(1)
    score[docs] = np.minimum(chosen.max(1), 1.0)
    return best, score


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held_out: int = 0) -> DataFrame:
    """key, held_out, lang_pred, score for every row; learned from rows outside the held-out fold with text and lang.

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing could be learned. A null key
    is not held out. Of equally likely languages the first by code point is predicted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    held = F.coalesce(fold(F.col("key"), folds) == held_out, F.lit(False))
    learned = language_counts(rows.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())).collect()  # one row per language
    learned = sorted(learned, key=lambda r: r[0])
    names = [r[0] for r in learned]
    counts = np.stack([np.frombuffer(r[1], np.int64) for r in learned]) if learned else np.zeros((0, 1 << BITS), np.int64)
    model = spark.sparkContext.broadcast(log_table(counts))  # 256 KB per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = np.array([*names, UNKNOWN], object)
        for batch in batches:
            at = 0
            for part in _slices(batch["text"]):
                best, score = infer(part, model.value)
                yield pa.RecordBatch.from_arrays([batch["key"].slice(at, len(part)), pa.array(label[best], pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])
                at += len(part)

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.select("key", "text").mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return out.select(F.col("key").alias(key), held.alias("held_out"), "lang_pred", "score")
