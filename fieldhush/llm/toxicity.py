"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two words counts their common subsequences of 3 and 4 characters, each weighted by ``DECAY`` for every
character it spans, so "id*iot" is still close to "idiot". A word's subsequences are hashed into a fixed table; the kernel is the scalar product of
two such maps over their norms. Landmarks are words of the training sample; with K over them, the features of a word
are its kernel values times K^(-1/2). A linear machine is fitted on those features for the words that decide labelled sentences: in
toxic documents the words whose excess there cannot be chance, with one-character insertions, and then the loudest word of each sentence; in clean ones all
words, the most toxic-looking first, each the heavier the more documents have it. As the machine is linear in the map, it folds into one weight per
table entry: scoring a word needs no landmark any more.

A document is summarised by its loudest word, its three loudest, their share and its length; letters set apart by spaces ("i d i o t") are
read as one word too. A logistic curve over these, fitted on documents that its machine has not seen, gives 0 to 1.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.llm.common import fold, free_name
from fieldhush.llm.wordvec import mix as scramble
from fieldhush.sources.scratch import materialize, sized

#: At most so many labelled documents of either kind are used for learning, in hash order of their keys.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: Labelled texts of more characters take no part in learning; they are scored like all others.
SAMPLE_CHARS = 1 << 18
LANDMARKS, POSITIVE_WORDS, TABLE_BITS, DECAY = 256, 1500, 18, 0.7
THRESHOLD = 0.7
KEPT_WORDS = 1 << 17
#: Offsets of a subsequence's later characters: three within five places, four within six.
SHAPES = [(0, *c) for n, span in ((2, 5), (3, 6)) for c in combinations(range(1, span), n)]
EDGE = ".,;:!?\"'()[]{}|*#$%&<>-_"
_SPLIT, _OTHER = re.compile(r"[.!?\n]+"), re.compile(r"[\W_]+")
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def bare(word: str) -> str:
    return word.strip(EDGE) or word


def _maps(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, table entry, weight) of all subsequences, and each word's squared norm."""
    marked = ["^" + bare(w) + "$" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[owner]
    at = np.arange(len(code))
    who, where, weight = [], [], []
    for shape in SHAPES:
        p = at[at + shape[-1] < end]
        h = np.full(len(p), len(shape), np.uint32)
        for f, o in zip(_FACTORS, shape):
            h = (h ^ code[p + o]) * f
        h ^= h >> np.uint32(15)
        who.append(owner[p])
        where.append((h * np.uint32(2246822519)) >> np.uint32(32 - TABLE_BITS))
        weight.append(np.full(len(p), DECAY ** (shape[-1] + 1 - len(shape)), np.float32))
    who, where, weight = np.concatenate(who), np.concatenate(where), np.concatenate(weight)
    norm = np.bincount(who, weight.astype(float) ** 2, len(words))
    return who, where, weight, np.maximum(norm, 1e-9)


@dataclass
class Model:
    table: np.ndarray
    bias: float
    curve: np.ndarray  # weights of what ``summary`` says, and a constant

    def words(self, words: list[str]) -> np.ndarray:
        """Raw score of each word; a word with other characters than letters and digits also counts without them."""
        plain = {i: p for i, w in enumerate(words) if (p := _OTHER.sub("", w)) != bare(w) and p}
        out = self._raw([*words, *plain.values()])
        raw, again = out[: len(words)], out[len(words) :]
        for i, x in zip(plain, again, strict=True):
            raw[i] = max(raw[i], x)
        return raw

    def _raw(self, words: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(words), 1_000):
            part = words[i : i + 1_000]
            who, where, weight, norm = _maps(part)
            out.append(np.bincount(who, weight * self.table[where], len(part)) / np.sqrt(norm) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summaries @ self.curve[:-1] + self.curve[-1], -40, 40)))


def summary(raw: list[float]) -> tuple[float, ...]:
    """What the curve sees of a document's words: the loudest, the mean of the three loudest, their share of loud ones, and how many they are."""
    if not raw:
        return -2.0, -2.0, 0.0, 0.0
    top = heapq.nlargest(3, raw)
    n = len(raw)
    return max(top[0], -2.0), max(sum(top) / len(top), -2.0), math.log1p(100 * sum(x > 0 for x in raw) / n), math.log1p(n)


def document_words(text: str) -> list[str]:
    """Words in lower case, and one more for each run of three or more single characters."""
    w = text.lower().split()
    short = [i for i, x in enumerate(w) if len(x) == 1]
    if len(short) > 2:
        run: list[int] = []
        for i in [*short, -1]:
            if run and i != run[-1] + 1:
                if len(run) > 2:
                    w.append("".join(w[j] for j in run))
                run = []
            run.append(i)
    return w


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 30.0) -> tuple[np.ndarray, float]:
    """L2 support vector machine by Newton steps on the squared hinge; the bias is the last, unregularised coefficient."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    del x  # the caller has no use for it either
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(60):
        active = y * (x1 @ w) < 1
        xa, c = x1[active], 2 * cost * weight[active]
        new = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, xa.T @ (c * y[active]))
        step = np.abs(new - w).max()
        w = 0.5 * (w + new) if step > 10 else new
        del xa
        if step < 1e-8:
            break
    return w[:-1], float(w[-1])


def _variants(word: str, rnd: np.random.Generator) -> list[str]:
    """The word with one character inserted, as insults are hidden."""
    if len(word) < 4:
        return []
    i = int(rnd.integers(1, len(word)))
    return [word[:i] + c + word[i:] for c in "*-" + word[i]]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and constant of the calibration curve, with a little ridge on standardised inputs so that clean splits stay finite."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    b, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    w = b[:-1] / std
    return np.append(w, b[-1] - w @ mean)


def train(texts: list[str], toxic: np.ndarray, rate: float, landmarks: int = LANDMARKS, seed: int = 0) -> Model:
    """A model from sample documents; ``rate`` is the share of toxic ones in all labelled rows.

    The curve is fitted on documents scored by machines that have not seen them: each half by the machine of the other. The
    machine itself then learns from all. Without documents of both kinds every document scores ``rate``.
    """
    odds = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    model = _machine(texts, toxic, landmarks, seed)
    if model is None:
        return Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, np.array([0.0, 0.0, 0.0, 0.0, odds]))
    half = np.random.default_rng(seed).permutation(len(texts)) % 2
    said = np.zeros((len(texts), 4))
    for h in (0, 1):
        mine = np.flatnonzero(half != h)
        other = _machine([texts[i] for i in mine], toxic[mine], landmarks, seed) or model
        for i in np.flatnonzero(half == h):
            said[i] = document_summary(other, texts[i])
    y = toxic.astype(float)
    balance = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    model.curve = _logistic(said, y, balance)
    return model


def _machine(texts: list[str], toxic: np.ndarray, landmarks: int, seed: int) -> Model | None:
    """The machine without its curve; None where nothing tells toxic from clean documents."""
    rnd = np.random.default_rng(seed)
    if toxic.all() or not toxic.any():
        return None
    # One thing after the other, as all of it is in the driver's memory: the counts are gone before sentences are kept.
    counts = _fresh_counts(texts, toxic)
    telling = evidence(*counts) if counts[0] else {}
    del counts
    if not telling:
        return None
    clean: Counter = Counter()
    for t in (t for t, y in zip(texts, toxic, strict=True) if not y):
        clean.update({bare(w) for s in _SPLIT.split(t.lower()) for w in s.split()})
    some, toxic_sentences = _sentences((t for t, y in zip(texts, toxic, strict=True) if y), clean)
    if not some:
        return None
    ranked = sorted(telling, key=lambda w: (-telling[w], w))[:POSITIVE_WORDS]
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) > 2 and w not in telling][: landmarks * 20]
    basis = _landmarks(ranked, landmarks * 3 // 4) + list(rnd.permutation(np.array(common, object))[: landmarks // 4])
    who, where, weight, norm = _maps(basis)
    used, at = np.unique(where, return_inverse=True)  # only the landmarks' entries matter, so the table of their maps stays small
    dense = np.zeros((len(used), len(basis)), np.float32)
    np.add.at(dense, (at, who), weight / np.sqrt(norm)[who])
    place = np.full(1 << TABLE_BITS, -1, np.int64)
    place[used] = np.arange(len(used))

    def kernel(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(basis)))
        for i in range(0, len(words), 50):
            who, where, weight, norm = _maps(words[i : i + 50])
            order = np.argsort(who, kind="stable")
            order = order[place[where[order]] >= 0]
            ends = np.searchsorted(who[order], np.arange(len(norm) + 1))
            some = np.flatnonzero(np.diff(ends))
            if len(some):
                out[i + some] = np.add.reduceat(dense[place[where[order]]] * weight[order][:, None], ends[some]) / np.sqrt(norm)[some, None]
        return out

    val, vec = np.linalg.eigh(kernel(basis) + 1e-6 * np.eye(len(basis)))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-6))) @ vec.T
    clean_words = sorted(w for w in clean if w not in telling)
    hard = [clean_words[i] for i in rnd.permutation(len(clean_words))[:6000]]
    model, heard = None, Counter()
    for _ in range(2):
        # A sentence of a toxic document is learned by its loudest word: one that tells by itself, or later one that the machine takes for such.
        pos = list(dict.fromkeys([*ranked, *sorted(heard, key=lambda w: (-heard[w], w))]))[:POSITIVE_WORDS]
        odd = [v for w in ranked for v in _variants(w, rnd)]
        y = np.concatenate([np.ones(len(pos) + len(odd)), -np.ones(len(hard))])
        n, h = np.sqrt([telling.get(w, 0.0) + heard[w] for w in pos]), np.sqrt([clean[w] for w in hard])
        share = np.concatenate([n / n.sum(), np.full(len(odd), 1 / max(len(odd), 1)), 4 * h / h.sum()])
        w, bias = _svm(kernel([*pos, *odd, *hard]) @ root, y, share * 1000)
        table = np.zeros(1 << TABLE_BITS, np.float32)
        table[used] = dense @ (root @ w)
        model = Model(table, bias, np.zeros(5))
        order = np.argsort(-model.words(clean_words))
        hard = list(dict.fromkeys([clean_words[i] for i in order[:6000]] + hard[:3000]))
        heard = _loudest(model, toxic_sentences, float(np.max(model.words(hard[:1]), initial=-1.0)))
    return model


def _sentences(texts: Iterable[str], clean: Counter) -> tuple[bool, list[tuple[str, ...]]]:
    """Whether there is any word, and each sentence's words that no clean document has; sentences without such words are left out."""
    same: dict[str, str] = {}  # one object for each word
    some, out = False, []
    for t in texts:
        for s in _SPLIT.split(t.lower()):
            words = {bare(w) for w in s.split()}
            some = some or bool(words)
            if own := tuple(same.setdefault(w, w) for w in words if w not in clean):
                out.append(own)
    return some, out


def _fresh_counts(texts: list[str], toxic: np.ndarray) -> tuple[Counter, Counter]:
    """For toxic and for clean documents, in how many of them each word stands between two words with which no earlier document of the kind has it.

    Copies of a document repeat its words in the same places, so a hundred of them say hardly more about these words than one does.
    """
    number: dict[str, int] = {}
    out = []
    for kind in (True, False):
        ids, places = [], []
        for t in (t for t, y in zip(texts, toxic, strict=True) if bool(y) == kind):
            i = np.array([number.setdefault(b, len(number)) for w in t.lower().split() for b in [bare(w)]], np.uint64)
            if len(i):
                edge = np.array([1 << 40], np.uint64)
                before, after = np.concatenate([edge, i[:-1]]), np.concatenate([i[1:], edge])
                ids.append(i.astype(np.uint32))
                places.append(scramble(scramble(scramble(before) ^ i) ^ after))
        out.append(_documents_of_words(ids, places, list(number)))
    return out[0], out[1]


def _documents_of_words(ids: list[np.ndarray], places: list[np.ndarray], names: list[str], slices: int = 16) -> Counter:
    """The number of documents in which each word stands in a new place; takes the documents' arrays out of the lists."""
    if not ids:
        return Counter()
    doc = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(i) for i in ids])
    every, place = np.concatenate(ids), np.concatenate(places)
    ids.clear(), places.clear()
    count, n = np.zeros(len(names), np.int64), np.uint64(len(names))
    for k in range(slices):  # a place belongs to one word, so a part of the words can be counted alone
        at = np.flatnonzero(every % np.uint32(slices) == k)
        first = at[np.unique(place[at], return_index=True)[1]]
        both = np.unique(doc[first].astype(np.uint64) * n + every[first])
        count += np.bincount((both % n).astype(np.int64), minlength=len(names))
    return Counter({names[i]: int(count[i]) for i in np.flatnonzero(count)})


def evidence(toxic: Counter, clean: Counter) -> dict[str, float]:
    """Words that stand in toxic documents more often than chance lets any word do, with the strength of the evidence.

    That is n x KL(share, q), for a word of n documents, its toxic share, and the toxic share q of all words' documents: by Chernoff's bound the
    chance of as much is below exp(-evidence). Words are taken from log(number of words) on, so that less than one is expected by chance,
    and a few clean documents (a quotation, a wrong label) do not hide a word.
    """
    n1, n0 = sum(toxic.values()), sum(clean.values())
    q, least = n1 / (n1 + n0), math.log(len(toxic.keys() | clean.keys()))
    out = {}
    for w, k in toxic.items():
        n = k + clean[w]
        if len(w) > 2 and k > q * n:
            kl = k * math.log(k / n / q) + (clean[w] * math.log(clean[w] / n / (1 - q)) if clean[w] else 0.0)
            if kl >= least and k >= 2 * clean[w]:
                out[w] = kl
    return out


def _loudest(model: Model, sentences: list[tuple[str, ...]], above: float) -> Counter:
    """How often a word is the loudest of its sentence, and louder than ``above``."""
    words = sorted({w for s in sentences for w in s})
    raw = dict(zip(words, model.words(words).tolist(), strict=True))
    out: Counter = Counter()
    for s in sentences:
        loud = max((raw[w], w) for w in s)
        if loud[0] > max(above, 0.0):
            out[loud[1]] += 1
    return out


def _landmarks(ranked: list[str], n: int) -> list[str]:
    """The first words in rank that are not nearly the same as an earlier one."""
    out: list[str] = []
    maps: list[dict[int, float]] = []
    for w in ranked:
        _, where, weight, norm = _maps([w])
        m: dict[int, float] = {}
        for k, v in zip(where.tolist(), weight.tolist(), strict=True):
            m[k] = m.get(k, 0.0) + v / math.sqrt(norm[0])
        if all(sum(v * o.get(k, 0.0) for k, v in m.items()) < 0.8 for o in maps):
            out.append(w)
            maps.append(m)
            if len(out) == n:
                break
    return out


def document_summary(model: Model, text: str) -> tuple[float, ...]:
    w = document_words(text)
    known = dict(zip(d := list(dict.fromkeys(w)), model.words(d).tolist(), strict=True))
    return summary([known[x] for x in w])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1,
          toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> Model:
    """A model from labelled documents outside the held-out fold. Null labels and keys are left out; a key labelled
    twice counts with its larger label."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("y")).dropna().filter(fold(F.col("key"), folds) != held_out)
    known = known.groupBy("key").agg((F.max("y") == 1).alias("y"))
    order = F.xxhash64("key")
    ids = known.filter("y").orderBy(order, "key").limit(toxic_rows).unionByName(known.filter("not y").orderBy(order, "key").limit(clean_rows))
    share = known.agg(F.avg(F.col("y").cast("int"))).first()[0]
    if share is None:
        return train([], np.zeros(0, bool), 0.0)
    # The sample is bounded by two parameters, so its keys can be broadcast; a key with several rows is learned by one of its texts.
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter(F.char_length("text") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(ids), "key").groupBy("key").agg(F.min("text").alias("text"), F.first("y").alias("y")).toPandas()
    rows = rows.sort_values("key")
    texts, toxic = rows["text"].tolist(), rows["y"].to_numpy(bool)
    del rows
    return train(texts, toxic, float(share))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD, row: str | None = None) -> DataFrame:
    """key, held_out, score, predicted for every row (and ``row``, if a column of that name is asked for).

    Null, empty and wordless texts get the lowest score. A null key is not held out. Repeated rows get equal scores.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text, folds=folds, held_out=held_out))  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model.value, {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words = [document_words(t) if t else [] for t in part["text"].to_pylist()]
                got = [list(map(known.get, w)) for w in words]
                new = list({w for ws, g in zip(words, got, strict=True) if None in g for w, x in zip(ws, g, strict=True) if x is None})
                if new:
                    known.update(zip(new, m.words(new).tolist(), strict=True))
                    got = [[known[w] if x is None else x for w, x in zip(ws, g, strict=True)] if None in g else g for ws, g in zip(words, got, strict=True)]
                said = np.array([summary(g) for g in got]).reshape(-1, 4)
                if len(known) > KEPT_WORDS:
                    known.clear()
                cols = [part["key"], pa.array(m.score(said))]
                yield pa.RecordBatch.from_arrays([*cols, *([part["row"]] if row else [])], names=["key", "score", *(["row"] if row else [])])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *([F.col(row).alias("row")] if row else []))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, score double" + (", row long" if row else ""))
    held = F.coalesce(fold(F.col("key"), folds) == held_out, F.lit(False))
    return out.select(F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *([F.col("row").alias(row)] if row else []))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    row = free_name(docs)
    table = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = sized(toxicity(table, labels, key, text, row=row, **options).filter("predicted = 1").select(row))
    return table.join(gone, row, "left_anti").drop(row)
