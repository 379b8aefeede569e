"""Token ids of whole texts with a public tokenizer, by way of its units.

Encoding splits at white space first, so the ids of a text are the ids of its space-separated units one after the
other. Units repeat, and a worker keeps the ids of those that it has met in a bounded table. Texts whose white space is not
single spaces and line ends are encoded whole; both ways give the same ids.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
KEPT_UNITS = 1 << 20
SLICE_BYTES = 1 << 23
#: White space other than space and line end; a text that has any is encoded whole.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    　﻿"
_ODD = re.compile(f"[\0{OTHER_SPACE}]")
WIDTH = 4
TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ids(e) -> bytes:
    return array("I", e.ids).tobytes()


class UnitEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept_units: int = KEPT_UNITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._without_normaliser(path)
        self.kept_units = kept_units
        self.known: dict[str, bytes] = {}

    def _without_normaliser(self, path: str):
        """A tokenizer for lower-case ASCII words between spaces, which normalisation and the split pattern leave as they are."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if self.tokenizer.normalizer is None:
            return None
        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = " the quick brown foxes jumpedoverit zzyxq lazily"
        same = plain.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return plain if same else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_ids(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def in_units(text: str) -> bool:
        """Whether the text can be encoded by its units; otherwise it is encoded whole."""
        return not (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD.search(text))

    def _learn_letters(self, new: list[str], between: str, tokenizer=None) -> None:
        """Units of letters only: many in one text, told apart by the tokenizer's own word numbers.

        With a space ``between`` the units have one before them, with a line end they have nothing.
        """
        groups = [new[i : i + 64] for i in range(0, len(new), 64)]
        lead, mark = (" ", "") if between == " " else ("", "\0")
        for g, e in zip(groups, (tokenizer or self.tokenizer).encode_batch([lead + between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids, of = e.ids, e.word_ids
            cuts = [0, *[i for i in range(1, len(of)) if of[i] != of[i - 1]], len(ids)]
            step = 2 if between == "\n" and len(cuts) == 2 * len(g) and len(g) > 1 else 1  # line ends may be words of their own
            if len(cuts) - 1 == step * len(g) - (step - 1):
                raw = array("I", ids).tobytes()
                self.known.update((mark + u, raw[4 * a : 4 * b]) for u, a, b in zip(g, cuts[:-1:step], cuts[1::step], strict=True))
            else:  # a letter that the tokenizer does not count as one
                self.known.update(zip([mark + u for u in g], self._whole([lead + u for u in g]), strict=True))

    def _learn(self, new: set[str]) -> None:
        """Ids of new units. A unit of letters with marks after it, or a line end before it, is put together from its parts."""
        known = self.known
        spaced, bare, rest, parts = set(), set(), set(), []
        for u in new:
            b = u.rstrip(TAIL)
            if u[0] == "\n" and b[1:].isalpha():
                parts.append((u, "\0\n", "\0" + b[1:], "\0" + u[len(b) :] if len(b) < len(u) else ""))
                bare.add(b[1:])
                rest.add("\0\n")
            elif b.isalpha():
                spaced.add(b)
                if len(b) < len(u):
                    parts.append((u, b, "\0" + u[len(b) :], ""))
            else:
                rest.add(u)
        rest.update(x for p in parts for x in p[2:] if x and not x[1:].isalpha())
        spaced, bare, rest = [u for u in spaced if u not in known], [u for u in bare if "\0" + u not in known], [u for u in rest if u not in known]
        simple = [u for u in spaced if u.isascii() and u.islower()] if self.plain else []
        self._learn_letters(simple, " ", self.plain)
        self._learn_letters([u for u in spaced if u not in known] if simple else spaced, " ")
        self._learn_letters(bare, "\n")
        known.update(zip(rest, self._whole([u[1:] if u[0] == "\0" else u if u[0] == "\n" else " " + u for u in rest]), strict=True))
        known[""] = b""
        for u, x, y, z in parts:
            known[u] = known[x] + known[y] + known[z]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.in_units(t) for t in texts]
        odd = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        cut = iter(self._by_units([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(cut) if p else next(odd) for p in plain]

    def _by_units(self, texts: list[str]) -> list[bytes]:
        """Units without the space before them; the first has a mark, as no space is before it.

        Arrow splits the texts and numbers their distinct units, so Python sees each unit once; the ids of all units in order are
        one buffer, in which a text's ids lie side by side.
        """
        if not texts:
            return []
        marked = ["\0" + t.replace("\n", " \n") for t in texts]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, units))
        if None in ids:
            self._learn({u for u, x in zip(units, ids, strict=True) if x is None})
            ids = [self.known[u] if x is None else x for u, x in zip(units, ids, strict=True)]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        index = np.asarray(coded.indices)
        size = np.diff(at)[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        # Every unit's bytes go to their place: whole ids are copied, as all lengths are multiples of four.
        source = np.frombuffer(b"".join(ids), np.uint32)
        first = at[:-1][index] // WIDTH
        step = np.ones(ends[-1] // WIDTH, np.int64)
        some = size > 0
        starts = ends[:-1][some] // WIDTH
        begin, length = first[some], size[some] // WIDTH
        if len(starts):
            step[starts[0]] = begin[0]
            step[starts[1:]] = begin[1:] - (begin[:-1] + length[:-1] - 1)
        out = source[np.cumsum(step)].tobytes() if len(starts) else b""
        bounds = ends[np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()]
        if len(self.known) > self.kept_units:
            self.known.clear()
        return [out[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One per worker process, so later tasks find the units of earlier ones."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of column ``text``, each with the end id. Smaller slices take less memory and more time."""
    enc, end = encoder(path), end_id.to_bytes(4, "little")
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            # As many texts as fit into ``slice_bytes``, one at least: the more there are, the more often a unit is met again.
            n = max(1, int(np.searchsorted(size, (size[i - 1] if i else 0) + slice_bytes, "right")) - i)
            part = batch.slice(i, n)
            yield part, [x + end for x in enc.encode([t or "" for t in part["text"].to_pylist()])]
            i += n


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, piece, start, length, ids) of every document: its ids and the end id, cut after every ``capacity`` ids.

    ``ids`` holds little-endian unsigned 32-bit integers. A null or empty text has one piece, the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in encoded(batches, tokenizer, slice_bytes=slice_bytes):
            n = [len(x) // 4 for x in ids]
            rows = [(i, p) for i, x in enumerate(n) for p in range(-(-x // capacity))]
            yield pa.RecordBatch.from_arrays([
                part["key"].take(pa.array([i for i, _ in rows], pa.int64())), pa.array([p for _, p in rows], pa.int32()),
                pa.array([p * capacity for _, p in rows], pa.int64()), pa.array([min(capacity, n[i] - p * capacity) for i, p in rows], pa.int64()),
                pa.array([ids[i][4 * p * capacity : 4 * (p + 1) * capacity] for i, p in rows], pa.binary())], names=["key", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)
