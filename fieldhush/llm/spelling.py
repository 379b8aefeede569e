"""Spelling variants by a bit-sliced position index.

A block of the vocabulary is indexed by one bitset for each (position, letter): bit j says that word j has this letter there. A query
word is read letter by letter, and whole bitsets carry the sets of words that agree with what was read:

    zero errors          Z' = Z & B[p]
    one replaced         S' = S & B[p]  |  Z & ~B[p]
    one more letter      I' = (I | Z) & B[p + 1]      the word is one ahead
    one letter less      D' = D & B[p - 1]  |  Z      the word is one behind

with B[p] the bitset of the letter read at position p. At the end the words of the right length among S, I and D differ
from the query by exactly one code point. All queries of one length are read together, 64 words of the block at a time.

A word of 7 or more code points that has one error keeps its first three or its last three. Words therefore meet only in groups
by their first three and, for pairs that do not share these, in groups by their last three; a group holds many such beginnings or ends. Groups are cut into
cells of a bounded number of words; each cell adds up counts and the best near word for a query, so near pairs never become rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.llm.common import lower_ascii
from fieldhush.sources.scratch import materialize, sized

#: Runs of letters, and every how many of them loses a letter.
RUN = "[A-Za-zÀ-ÿ]"
ONE_IN = 31
KEEP = 3
CELL_WORDS = 1 << 13
#: Words of up to so many code points share cells; each doubling beyond has cells of its own, with half the words.
SHORT = 48
BATCH_BITSETS = 1 << 15


def corrupted(run: Column, key: Column) -> Column:
    """``run`` without one code point where crc32 of key:run is a multiple of 31. A null key changes nothing."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % ONE_IN == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 7, min_n: int = 2) -> DataFrame:
    """(word, n): runs of letters of at least ``min_chars`` code points, after ``corrupted``, that occur ``min_n`` times or more.

    A null or empty text has none. A document counts as often as it stands in the table.
    """
    # A run may only lose a letter, so shorter ones never come back; a greedy match of this many is a whole run.
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))
    words = docs.select(F.col(f"`{key}`").alias("key"), F.explode(runs).alias("run"))
    words = words.select("key", lower_ascii(F.col("run")).alias("run"))
    words = words.select(corrupted(F.col("run"), F.col("key")).alias("word")).filter(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)


class PositionIndex:
    """Bitsets of a block of words, in the given order."""

    def __init__(self, words: list[str]):
        self.n, self.sets = len(words), (len(words) + 63) // 64
        length = np.array([len(w) for w in words], np.int64)
        code = np.array([ord(c) for w in words for c in w], np.int64)
        word = np.repeat(np.arange(self.n), length)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
        self.keys, row = np.unique((pos << 21) | code, return_inverse=True)
        # The last row is the empty set, for letters that no word has at a position.
        self.bits = self._bitsets(row, word, len(self.keys) + 1)
        self.lengths, row = np.unique(length, return_inverse=True)
        self.of_length = self._bitsets(row, np.arange(self.n), len(self.lengths) + 1)

    def _bitsets(self, row: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.sets), np.uint64)
        np.bitwise_or.at(out, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        return out

    def _find(self, table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return table[np.where(keys[at] == values, at, len(keys))]

    def letter(self, pos: int, codes: np.ndarray) -> np.ndarray:
        return self._find(self.bits, self.keys, (pos << 21) | codes)

    def near(self, codes: np.ndarray, alike: bool) -> np.ndarray:
        """Bitsets (queries x words) of the words one error away that share (``alike``) or do not share the query's first ``KEEP`` letters.

        ``codes`` holds queries of one length, a row each.
        """
        q, length = codes.shape
        zero = np.full((q, self.sets), ~np.uint64(0))
        other, more, less = (np.zeros_like(zero) for _ in range(3))
        for p in range(length):
            c = codes[:, p]
            here = self.letter(p, c)
            more = (more | zero) & self.letter(p + 1, c)
            less = (less & self.letter(p - 1, c) if p else less) | zero
            other = (other & here) | (zero & ~here)
            zero = zero & here
            if p + 1 == KEEP:
                shared = zero if alike else ~zero
        by = lambda n: self._find(self.of_length, self.lengths, np.array([n]))
        return ((other & by(length)) | ((more | zero) & by(length + 1)) | (less & by(length - 1))) & shared


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    # The most frequent words come first, ties in code-point order: a query's best near word is its lowest bit.
    index = pdf[pdf["indexed"]].sort_values(["n", "word"], ascending=[False, True])
    asked = pdf.loc[~pdf["indexed"], "word"].to_numpy(object)
    none = pd.DataFrame({"word": np.empty(0, object), "n_near": np.empty(0, np.int64), "best": np.empty(0, object), "best_n": np.empty(0, np.int64)})
    if not len(index) or not len(asked):
        return none
    words, n = index["word"].to_numpy(object), index["n"].to_numpy(np.int64)
    ix, alike, out = PositionIndex(list(words)), pdf["side"].iloc[0] == 0, [none]
    length = np.array([len(w) for w in asked])
    step = max(1, BATCH_BITSETS // ix.sets)
    for size in np.unique(length):
        same = asked[length == size]
        for at in range(0, len(same), step):
            part = same[at : at + step]
            codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(part), size)
            near = ix.near(codes, alike)
            count = np.bitwise_count(near).sum(1, dtype=np.int64)
            hit = np.flatnonzero(count)
            first = (near[hit] != 0).argmax(1)
            low = near[hit, first]
            j = first * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
            out.append(pd.DataFrame({"word": part[hit], "n_near": count[hit], "best": words[j], "best_n": n[j]}))
    return pd.concat(out)


def _length_class(length: Column) -> Column:
    return F.when(length <= SHORT, 0).otherwise(1 + F.floor(F.log2((length - 1) / float(SHORT)))).cast("int")


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) for each word of ``words`` (word, n) that has a near one. Words have 7 or more code points."""
    length = F.char_length("word")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, KEEP).alias("part")),
                              F.struct(F.lit(1).alias("side"), F.substring("word", -KEEP, KEEP).alias("part")))).alias("s")
    # A query also goes to the classes of the lengths beside its own.
    classes = F.array_distinct(F.array(_length_class(length), _length_class(length - 1), _length_class(length + 1)))
    rows = words.select("word", "n", _length_class(length).alias("own"), F.explode(classes).alias("cls"), sides).select(
        "word", "n", "s.side", "cls", (F.col("own") == F.col("cls")).alias("home"), F.xxhash64("s.part").alias("h"))
    # One row per length class; an index block of class k holds words up to SHORT << k long.
    size = F.greatest(F.lit(1), F.floor(F.lit(cell_words) / F.pow(F.lit(2.0), F.col("cls"))).cast("long"))
    total = rows.filter("home").groupBy("side", "cls").agg(F.ceil(F.count("*") / F.first(size)).cast("long").alias("groups"))
    rows = rows.join(F.broadcast(total), ["side", "cls"]).withColumn("grp", F.pmod("h", "groups"))
    rows = materialize(rows.drop("h", "groups"), "sides")
    # A group that one part of a word makes large is cut into cells: every slice of its queries meets every slice of its index.
    slices = rows.groupBy("side", "cls", "grp").agg(F.count_if("home").alias("held"), F.count("*").alias("asks"))
    slices = sized(slices.select("side", "cls", "grp", F.ceil(F.col("held") / size).cast("int").alias("across"), F.ceil(F.col("asks") / cell_words).cast("int").alias("down")))
    rows = rows.join(slices, ["side", "cls", "grp"]).filter("across > 0")
    slot = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "word"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.filter("home").select("side", "cls", "grp", slot(1, F.col("across")).alias("i"), every("down").alias("j"), "word", "n", F.lit(True).alias("indexed"))
    asks = rows.select("side", "cls", "grp", every("across").alias("i"), slot(2, F.col("down")).alias("j"), "word", "n", F.lit(False).alias("indexed"))
    found = held.unionByName(asks).groupBy("side", "cls", "grp", "i", "j").applyInPandas(_cell, "word string, n_near long, best string, best_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")).select(
        "word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the form of the form and so on, to the last. Each round doubles the step."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = sized(roots.select(F.col("word").alias("root"), F.col("root").alias("next")))
        step = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        roots = step.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 10, min_chars: int = 7, min_n: int = 2, cell_words: int = CELL_WORDS) -> DataFrame:
    """A row per word of the vocabulary: word, n, n_near, form, form_n, root.

    A word's form is its near word of the largest n if that is at least ``times`` its own n, ties the smallest in code-point order; its root is
    the last of the forms of forms, itself if it has none. ``min_chars`` is at least 7. Counts run over all rows and whole texts; a table
    without words gives an empty result.
    """
    if min_chars < 2 * KEEP + 1:
        raise ValueError("near words share their first or last letters only from 7 code points on")
    words = materialize(vocabulary(docs, key, text, min_chars, min_n), "words")
    near = near_words(words, cell_words)
    # Word and findings meet in one aggregate.
    nothing = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    both = nothing.unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best", "best_n"))
    both = both.groupBy("word").agg(*[F.max(c).alias(c) for c in ("n", "n_near", "best", "best_n")])
    formed = F.col("best_n") >= times * F.col("n")
    both = materialize(both.select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "formed")
    roots = followed(both.filter("form is not null"))
    return both.join(sized(roots), "word", "left").withColumn("root", F.coalesce("root", "word"))
