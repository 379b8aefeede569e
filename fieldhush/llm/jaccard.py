"""Set-similarity join on word shingles by PartEnum signatures.

Sets of similar size fall into bands. Within a band two sets of Jaccard similarity t or more differ in at most k elements, with k from
their sizes. The feature domain is cut at random into n1 x n2 parts, and for each of the n1 groups all subsets of n2 - k2
of its n2 parts are enumerated; the elements that a set has in a subset make one signature. k differences can break only so many
signatures, so of any more than that at least one is common to both sets. A set therefore needs only that many of its signatures plus
one, the rarest by one order for all: the first common one in the order is among them on both sides. Signatures of empty subsets
are left out; a set with too few others also gives its k + 1 rarest elements, which finds the pairs of two such sets.

The order comes from a count sketch of fixed size over all signatures. It keeps passages that many documents share from making
large groups; any order is exact. Documents with a common signature are compared exactly: first all with one of the group, then, block by
block inside a task, those that are not connected yet. Bitmaps rule out nearly all pairs before a text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.llm.common import free_name
from fieldhush.llm.components import components
from fieldhush.llm.wordvec import mix, shingle_sets
from fieldhush.sources.scratch import materialize, sized

SKETCH_BITS = 20
SKETCH_CHUNK = 1 << 12
SKETCH_HELD = 1 << 17
SALT_ROWS = 50_000
BLOCK_ROWS = 2048
SHORT_BYTES = 128
FILTER_BITS = 24


def _edges() -> list[int]:
    e = [1]
    while e[-1] < 1 << 40:
        e.append(max(e[-1] + 1, e[-1] * 25 // 16))
    return e


#: Band j holds the sizes from BANDS[j] to BANDS[j + 1] - 1.
BANDS = _edges()
_BANDS = np.array(BANDS)


def band_of(size: int) -> int:
    return int(np.searchsorted(_BANDS, size, "right")) - 1


def most_different(a: int, b: int, pct: int) -> int:
    """Largest symmetric difference of sets of sizes a and b with 100 * intersection >= pct * union."""
    return (100 - pct) * (a + b) // (100 + pct)


def scheme(k: int) -> tuple[int, int, int]:
    """(n1, n2, k2): few differences get one group and large subsets, many get groups of two parts."""
    return (1, k + 4 if k else 1, k) if k <= 3 else (-(-3 * (k + 1) // 4), 2, 1)


def needed(k: int, n1: int, n2: int, k2: int) -> int:
    """One more than ``k`` differences can break. The d-th difference in a group breaks fewer than the one before."""
    broken = lambda d: comb(n2, k2) - (comb(n2 - d, k2 - d) if d <= k2 else 0)
    q, r = divmod(k, n1)
    return r * broken(q + 1) + (n1 - r) * broken(q) + 1


@cache
def _subsets(n2: int, k2: int) -> np.ndarray:
    s = [set(c) for c in combinations(range(n2), n2 - k2)]
    return np.array([[i in c for c in s] for i in range(n2)], np.uint64)


@cache
def _salts(band: int, count: int, weak: bool = False) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) + np.array([(band * 2 + weak) << 40], np.uint64))


def signatures(e: np.ndarray, pct: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(signatures needed, all non-empty signatures, elements as signatures if there are too few, needed too) for each band."""
    size = len(e)
    top = size * 100 // pct
    for j in range(band_of(size), band_of(top) + 1):
        hi = BANDS[j + 1] - 1
        n1, n2, k2 = scheme(most_different(hi, hi, pct))
        k = most_different(size, min(top, hi), pct)
        salt = _salts(j, n1 * comb(n2, k2))
        part = (mix(e ^ salt[0]) >> np.uint64(20)).astype(np.int64) % (n1 * n2)
        total, count = np.zeros(n1 * n2, np.uint64), np.bincount(part, minlength=n1 * n2)
        np.add.at(total, part, mix(e + np.uint64(0x632BE59BD9B4E019)))
        if (n2, k2) != (2, 1):
            s = _subsets(n2, k2)
            total, count = (total.reshape(n1, n2) @ s).ravel(), (count.reshape(n1, n2) @ s.astype(np.int64)).ravel()
        sig = mix(total ^ salt)[count > 0]
        need = needed(k, n1, n2, k2)
        weak = mix(e ^ _salts(j, 1, True)[0]) if len(sig) < need else e[:0]
        yield need, sig, weak


def chosen(e: np.ndarray, pct: int, sketch: np.ndarray) -> np.ndarray:
    out = []
    shift = np.uint64(64 - SKETCH_BITS)
    for need, sig, weak in signatures(e, pct):
        order = np.lexsort((sig, sketch[sig >> shift]))
        out.append(sig[order[:need]])
        if len(weak):
            k = most_different(len(e), len(e) * 100 // pct, pct)
            out.append(weak[np.lexsort((weak, sketch[weak >> shift]))[: k + 1]])
    return np.concatenate(out) if out else e[:0]


def may_hold(rows: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The ``rows`` whose key may be one of ``keys``: all that are, and the more others the fuller the bits.

    Spark's bitmaps of 4 KB, 2 MB in all, whatever the input. They go to the rows, so texts that a join would only drop are not shuffled.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    part, at = F.shiftright(place, 15), place % F.lit(1 << 15)
    maps = keys.groupBy(part.alias("__part")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = rows.withColumn("__part", part).join(F.broadcast(maps), "__part").filter(F.getbit(byte, (at % 8).cast("int")) == 1)
    return seen.select(*rows.columns)


def _measure(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """Rows (key, n, fa, fb) of each document's set, and rows (chunk, counts) of the sketch of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        kind, seen, held = None, [], 0
        for b in batches:
            kind = b["key"].type
            n, fa, fb = [], [], []
            for e in shingle_sets(b["text"], k):
                n.append(len(e))
                with np.errstate(over="ignore"):
                    fa.append(int(mix(e).sum(dtype=np.uint64).view(np.int64)))
                    fb.append(int(mix(e ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                for _, sig, weak in signatures(e, pct) if len(e) else ():
                    seen += [sig, weak]
                    held += len(sig) + len(weak)
                if held > SKETCH_HELD:
                    count(sketch, seen)
                    seen, held = [], 0
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), none, pa.nulls(len(n), pa.binary())], names=names)
        if kind is not None:
            count(sketch, seen)
            for c in range(0, len(sketch), SKETCH_CHUNK):
                x = sketch[c : c + SKETCH_CHUNK]
                if x.any():
                    x = x.view(np.uint8).reshape(-1, 4).T  # byte planes: the upper ones are nearly all zero and pack to nothing
                    nothing = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), nothing, nothing, nothing, pa.array([c // SKETCH_CHUNK], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=names)

    def count(sketch: np.ndarray, seen: list[np.ndarray]) -> None:
        if seen:
            np.add.at(sketch, (np.concatenate(seen) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)

    names = ["key", "n", "fa", "fb", "chunk", "counts"]
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n long, fa long, fb long, chunk int, counts binary")


def _sketch(measured: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: a table of 2 ** SKETCH_BITS counts, whatever the input."""

    def add(t: pa.Table) -> pa.Table:
        s = np.zeros(SKETCH_CHUNK, np.int64)
        for x in t["counts"]:
            s += np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        return pa.table({"chunk": t["chunk"].slice(0, 1), "counts": pa.array([s.tobytes()], pa.binary())})

    parts = measured.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in parts.toLocalIterator():
        sketch[r[0] * SKETCH_CHUNK : (r[0] + 1) * SKETCH_CHUNK] = np.frombuffer(r[1], np.int64)
    return np.minimum(sketch, np.iinfo(np.int32).max).astype(np.int32)


def _signed(docs: DataFrame, sketch: Broadcast, k: int, pct: int) -> DataFrame:
    """(sig, salt, key, n). Salts split the groups of very frequent signatures; they depend on the document alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        usual = SALT_ROWS + 8 * int(counts.mean(dtype=np.float64))
        for b in batches:
            rows, sigs, sizes = [], [], []
            held = 0
            for i, e in enumerate(shingle_sets(b["text"], k)):
                if len(e):
                    s = chosen(e, pct, counts)
                    sigs.append(s)
                    rows.append(np.full(len(s), i))
                    sizes.append(np.full(len(s), len(e), np.int32))
                    held += len(s)
                if held > 200_000:
                    yield batch(b, rows, sigs, sizes, counts, usual)
                    rows, sigs, sizes, held = [], [], [], 0
            if held:
                yield batch(b, rows, sigs, sizes, counts, usual)

    def batch(b, rows, sigs, sizes, counts, usual) -> pa.RecordBatch:
        r, s = np.concatenate(rows), np.concatenate(sigs)
        parts = np.where((c := counts[s >> np.uint64(64 - SKETCH_BITS)]) > usual, c // SALT_ROWS + 1, 1).astype(np.uint64)
        own = mix(np.array([int(x.min()) for x in sigs], np.uint64))
        salt = (np.repeat(own, [len(x) for x in sigs]) % parts).astype(np.int32)
        salt = np.where(parts > 1, salt, -1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(salt), b["key"].take(pa.array(r)), pa.array(np.concatenate(sizes))], names=["sig", "salt", "key", "n"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"sig long, salt int, key {kind}, n int")


def bitmap(e: np.ndarray) -> np.ndarray:
    """One bit per bucket, set where an odd number of elements falls; about four buckets per element, a power of two."""
    size = 1 << max(6, int(4 * len(e) - 1).bit_length())
    return (np.bincount((mix(e ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8)


def least_difference(a: bytes, b: bytes) -> int:
    """What two sets differ in at least: the bits in which their bitmaps differ. A larger bitmap folds to the smaller one's size."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        h = len(a) // 2
        a = (int.from_bytes(a[:h], "little") ^ int.from_bytes(a[h:], "little")).to_bytes(h, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def folded(bits: bytes, most: int) -> bytes:
    """A bitmap of at most ``most`` bytes: halves over each other, parity by parity."""
    return bits if len(bits) <= most else np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, most), 0).tobytes()


def _bitmaps(texts: DataFrame, k: int) -> DataFrame:
    """(key, bits, short, n): each set's bitmap, one of bounded size, and the number of its elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, n = [], []
            for e in shingle_sets(b["text"], k):
                bits.append(np.packbits(bitmap(e), bitorder="little").tobytes())
                n.append(len(e))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(bits, pa.binary()), pa.array([folded(x, SHORT_BYTES) for x in bits], pa.binary()), pa.array(n, pa.int64())], names=["key", "bits", "short", "n"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, bits binary, short binary, n long")


def _possible(pairs: DataFrame, bits: DataFrame, pct: int) -> DataFrame:
    """The pairs that their bitmaps do not rule out; a pair of similar sets never is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for at in range(0, b.num_rows, 256):  # bitmaps of long texts take kilobytes
                x, y, n, m = (b[c].slice(at, 256).to_pylist() for c in ("x", "y", "n", "m"))
                keep += [least_difference(p, q) <= most_different(i, j, pct) for p, q, i, j in zip(x, y, n, m, strict=True)]
            yield b.select(["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    left = may_hold(bits, pairs.select(F.col("a").alias("key"))).select(F.col("key").alias("a"), F.col("bits").alias("x"), "n")
    right = may_hold(bits, pairs.select(F.col("b").alias("key"))).select(F.col("key").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    kind = bits.schema["key"].dataType.simpleString()
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "x", "y", "n", "m")
    return both.mapInArrow(run, ", ".join(f"{c} {kind}" for c in ("a", "b", "ca", "cb")))


def _apart(rows: list[tuple], pct: int) -> Iterator[tuple]:
    """(a, b, ca, cb) for the members of one group, (key, n, comp, major, block, bits), that may be similar and are not connected.

    The members of the group's largest component meet only the others, never each other.
    """
    cross = len({r[4] for r in rows}) > 1
    minor = [i for i, r in enumerate(rows) if not r[3]]
    if len(minor) * len(rows) < 4000:
        for i in minor:
            a = rows[i]
            for j, b in enumerate(rows):
                if (b[3] or j > i) and a[2] != b[2] and (not cross or a[4] != b[4]) and least_difference(a[5], b[5]) <= most_different(a[1], b[1], pct):
                    if 100 * min(a[1], b[1]) >= pct * max(a[1], b[1]):
                        yield a[0], b[0], a[2], b[2]
        return
    width = min(len(r[5]) for r in rows)
    bits = np.empty((len(rows), width), np.uint8)
    for i, r in enumerate(rows):
        x = np.frombuffer(r[5], np.uint8)
        bits[i] = np.bitwise_xor.reduce(x.reshape(-1, width), 0)
    bits = bits.view(np.uint64)
    n, comp, block, major = (np.array([r[c] for r in rows]) for c in (1, 2, 4, 3))
    at = np.arange(len(rows))
    for i in minor:
        ok = (major | (at > i)) & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= pct * np.maximum(n, n[i]))
        if cross:
            ok &= block != block[i]
        j = np.flatnonzero(ok)
        d = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
        for x in j[d <= (100 - pct) * (n[j] + n[i]) // (100 + pct)].tolist():
            yield rows[i][0], rows[x][0], rows[i][2], rows[x][2]


def _across(g: DataFrame, bits: DataFrame, pct: int, block_rows: int) -> DataFrame:
    """(a, b, ca, cb): pairs of one group (sig, key, n, comp) and different components that their bitmaps do not rule out.

    A group of more than ``block_rows`` is cut into blocks, and each two blocks are a cell of their own, so a task holds two blocks
    at most. The bitmaps travel with the rows; pairs that they rule out are never rows.
    """
    in_comp = g.groupBy("sig", "comp").agg(F.count("*").alias("c"))
    apart = in_comp.groupBy("sig").agg(F.sum("c").alias("rows"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top")).filter("comps > 1")
    apart = sized(apart.select("sig", F.col("top.comp").alias("most"), F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")))
    rows = g.join(apart, "sig").join(bits.select("key", F.col("short").alias("bits")), "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))).alias("cell")
    rows = rows.select("sig", cell, "key", "n", "comp", (F.col("comp") == F.col("most")).alias("major"), "block", "bits").select("sig", "cell.lo", "cell.hi", "key", "n", "comp", "major", "block", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []
        for b in batches:
            c = [b[x].to_pylist() for x in ("sig", "lo", "hi", "key", "n", "comp", "major", "block", "bits")]
            for sig, lo, hi, *member in zip(*c, strict=True):
                if (sig, lo, hi) != now:
                    out += pairs_of(held, now)
                    held, now = [], (sig, lo, hi)
                    if len(out) > 50_000:
                        yield batch(out)
                        out = []
                held.append(tuple(member))
        out += pairs_of(held, now)
        if out:
            yield batch(out)

    def pairs_of(held: list[tuple], now: tuple | None) -> list[tuple]:
        # A cell of two blocks that holds one of them only has nothing to compare.
        if len(held) < 2 or (now[1] != now[2] and len({r[4] for r in held}) < 2):
            return []
        return list(dict.fromkeys(_apart(held, pct)))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b", "ca", "cb"])

    kind = bits.schema["key"].dataType.simpleString()
    return rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(run, ", ".join(f"{c} {kind}" for c in ("a", "b", "ca", "cb")))


def _similar(pairs: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """(a, b): the components ca and cb of those pairs (a, b, ca, cb) whose texts have similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                keep = []
                for a, x, e in zip(part["a"], part["ta"], shingle_sets(part["tb"], k), strict=True):
                    # Rows that share a key may have different texts.
                    x = x.as_py()
                    if (a, x) != last:
                        last, sets = (a, x), next(shingle_sets(pa.array([x], pa.string()), k))
                    both = len(np.intersect1d(sets, e, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= pct * (len(sets) + len(e) - both))
                part = part.select(["ca", "cb"]).filter(pa.array(keep, pa.bool_()))
                if part.num_rows:
                    yield part.rename_columns(["a", "b"])

    ta = may_hold(texts, pairs.select(F.col("a").alias("key"))).select(F.col("key").alias("a"), F.col("text").alias("ta"))
    tb = may_hold(texts, pairs.select(F.col("b").alias("key"))).select(F.col("key").alias("b"), F.col("text").alias("tb"))
    kind = texts.schema["key"].dataType.simpleString()
    return pairs.join(ta, "a").join(tb, "b").select("a", "ta", "tb", "ca", "cb").mapInArrow(run, f"a {kind}, b {kind}")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, pct: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per document: key, n_shingles, component_id (the smallest key reachable by links of ``pct`` percent similarity).

    Null and empty texts have no shingles and are linked with nothing. Rows that share a key are one node: linked with each other
    and with whatever any of them is linked with. A null key has a null component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    measured = materialize(_measure(rows, k, pct), "sets")
    sets = measured.filter("chunk is null").select("key", "n", "fa", "fb")
    sketch = spark.sparkContext.broadcast(_sketch(measured))  # 4 MB, whatever the input
    # Equal sets are linked through the smallest key, and only that one looks for others.
    equal = sets.filter("n > 0 and key is not null").groupBy("n", "fa", "fb").agg(F.min("key").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    copies = materialize(sets.join(sized(equal), ["n", "fa", "fb"]).filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")), "copies")
    # A key with several rows may be a copy in one of them only, so it keeps looking.
    several = sized(sets.filter("key is not null").groupBy("key").count().filter("count > 1").select("key"))
    silent = sized(copies.select(F.col("b").alias("key")).distinct().join(several, "key", "left_anti"))
    loud = rows.filter("key is not null and text is not null").join(silent, "key", "left_anti").select("key", "text")
    signed = _signed(loud, sketch, k, pct)
    shared = signed.select("*", F.expr("count(*) over (partition by sig, salt)").alias("c")).filter("c > 1 or salt >= 0")
    groups = materialize(shared.select("sig", "key", "n"), "groups")
    # A few texts that are in no group may come along; nothing joins them.
    texts = materialize(may_hold(loud, groups.select("key")), "candidates")
    bits = materialize(_bitmaps(texts, k), "bitmaps")
    # Copies are linked to their first key alone; only keys with several rows can link such stars to each other.
    if several.isEmpty():
        ends = [copies.select(F.col(c).alias("node"), F.col("a").alias("component")) for c in "ab"]
        comp = ends[1].unionByName(ends[0].distinct())
    else:
        comp = components(copies)
    comp = materialize(comp, "components")

    def placed() -> DataFrame:
        return groups.join(comp, groups["key"] == comp["node"], "left").select("sig", "key", "n", F.coalesce("component", "key").alias("comp"))

    def joined(pairs: DataFrame) -> DataFrame:
        """Components after the links among ``pairs``: links join whole components, so only those are solved again."""
        found = materialize(components(_similar(pairs, texts, k, pct)), "roots")
        moved = comp.join(found.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
        return materialize(moved.select("node", F.coalesce("root", "component").alias("component")).unionByName(found.join(comp, "node", "left_anti")), "components")

    # One of each group meets all others: as many pairs as rows.
    g = placed()
    one = g.groupBy("sig").agg(F.min(F.struct("key", "n", "comp")).alias("m")).select("sig", F.col("m.key").alias("a"), F.col("m.n").alias("na"), F.col("m.comp").alias("ca"))
    other = g.select("sig", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    fits = (100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")) & (F.col("ca") != F.col("cb"))
    pairs = materialize(one.join(other, "sig").filter(fits).select("a", "b", "ca", "cb").distinct(), "pairs")
    comp = joined(materialize(_possible(pairs, bits, pct), "possible"))
    # Groups that are still apart are compared in blocks by their bitmaps; only pairs that may be similar come out.
    pairs = materialize(_across(placed(), bits, pct, block_rows).distinct(), "across")
    comp = joined(materialize(_possible(pairs, bits, pct), "possible"))
    out = sets.join(comp, sets["key"] == comp["node"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest key; rows with a null key stay.

    Nodes are rows: where a key has several rows, each is linked by its own text, so rows of one key go only if they are similar
    to a row that stays. Of several rows with a component's smallest key the one with the smallest hash of its text stays.
    """
    k = F.col(f"`{key}`")
    if docs.filter(k.isNotNull()).groupBy(k).count().filter("count > 1").isEmpty():
        groups = materialize(similar_components(docs, key, text, **options), "similar")
        gone = sized(groups.filter(F.col(key) != F.col("component_id")).select(key).distinct())
        return docs.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    row = free_name(docs)
    table = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keyed = table.filter(k.isNotNull()).select(row, k.alias("key"), F.col(f"`{text}`").alias("text"))
    groups = materialize(similar_components(keyed, row, "text", **options), "similar")
    linked = groups.groupBy("component_id").count().filter("count > 1").select("component_id")
    members = groups.join(sized(linked), "component_id", "left_semi").select(row, "component_id")
    order = F.struct("key", F.xxhash64("text").alias("h"), row)
    members = materialize(members.join(keyed.select(row, order.alias("place")), row), "members")
    top = sized(members.groupBy("component_id").agg(F.min("place").alias("top")))
    gone = sized(members.join(top, "component_id").filter(F.col("place") != F.col("top")).select(row))
    return table.join(gone, row, "left_anti").drop(row)
