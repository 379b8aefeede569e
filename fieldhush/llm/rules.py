"""Quality rules: counts per document, and a decision list learned over them.

``text_counts`` measures whole texts. ``learn_rules`` is sequential covering on labelled counts: a rule is grown
condition by condition for the best gain of information, pruned back on rows it was not grown on, and
added to the list if it is precise enough; the rows that it covers go, and the next rule is grown. A rule is a conjunction
of thresholds. ``verdict`` states the list as one ordered conditional expression, so applying it needs no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.llm.wordvec import SPACE, slices, windows, words
from fieldhush.sources.scratch import materialize

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
#: At most so many labelled rows are used for learning, in hash order of their key.
SAMPLE_ROWS = 40_000

_SYM, _UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYM[list(SYMBOLS.encode())] = True
_UPPER[65:91] = True
_MARK[list(b"!?")] = True


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def count_texts(texts: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    parts: list[dict[str, np.ndarray]] = []
    for _, data, at in slices(texts):
        w = words(data, at, lower=False)
        n = np.diff(w.of)
        h, _ = windows(w, window)
        covered = np.zeros(len(w.hash) + 1, np.int64)
        dup = np.zeros(len(n), np.int64)
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True)):
            if b - a > window:
                x = h[a : b - window + 1]
                _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
                hit = a + np.flatnonzero(count[inverse] > 1)
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + window, -1)
            lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x and x.strip(b" \t\n\r\x0b\x0c")]
            dup[i] = len(lines) - len(set(lines))
        repeats = np.cumsum(covered)[:-1] > 0
        inside = ~SPACE[data] & ((data & 0xC0) != 0x80)
        parts.append({"n_words": n, "word_chars": _per_text(inside, at), "n_symbols": _per_text(_SYM[data], at), "n_dup_lines": dup,
                      "n_repeat_words": _per_text(repeats, w.of), "n_upper": _per_text(_UPPER[data], at), "n_marks": _per_text(_MARK[data], at),
                      "n_lines": _per_text(data == 10, at) + 1})
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and one long column per count; a row per input row. Null and empty texts count 0 (one line)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = count_texts(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(c[x], pa.int64()) for x in COUNTS]], names=[key, *COUNTS])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(measure, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(least_words: int = 10, repeat_pct: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def features() -> dict[str, Column]:
    """What a condition may test, as expressions over the counts."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "mark_share": _share("n_marks", "n_words"),
        "line_words": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in rule:
        m &= c.mask(x)
    return m


def _best_condition(x: pd.DataFrame, y: np.ndarray, cuts: int) -> Condition | None:
    p, n = int(y.sum()), int((~y).sum())
    start, best, gain = np.log2(p / (p + n)), None, 1e-9
    for f in x.columns:
        v = x[f].to_numpy()
        for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts))):
            for above in (True, False):
                m = v > t if above else v <= t
                pp, nn = int((m & y).sum()), int((m & ~y).sum())
                if pp and (g := pp * (np.log2(pp / (pp + nn)) - start)) > gain:
                    best, gain = Condition(f, above, float(t)), g
    return best


def learn_rules(x: pd.DataFrame, reject: np.ndarray, max_rules: int = 16, max_conditions: int = 4, least_precision: float = 0.9, cuts: int = 48, seed: int = 0) -> list[Rule]:
    """Ordered rules for the rows to reject, from a table of feature values and a boolean label.

    Two thirds of the rows grow rules, one third prunes them. Learning ends when no rule of ``least_precision``
    on the pruning rows is found, so rows that no rule speaks against are kept. No rows, or no rejected ones: no rules.
    """
    grow_part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    gx, gy = x[grow_part], reject[grow_part]
    px, py = x[~grow_part], reject[~grow_part]
    rules: list[Rule] = []
    while len(rules) < max_rules and gy.sum() >= 5:
        rule: Rule = ()
        m = np.ones(len(gx), bool)
        while len(rule) < max_conditions and (m & ~gy).any():
            c = _best_condition(gx[m], gy[m], cuts)
            if c is None:
                break
            rule = (*rule, c)
            m &= c.mask(gx)

        def worth(r: Rule) -> float:
            k = covers(r, px)
            p, n = int((k & py).sum()), int((k & ~py).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        k = covers(rule, px)
        if not rule or not k.any() or py[k].mean() < least_precision:
            break
        rules.append(rule)
        gone = covers(rule, gx)
        gx, gy, px, py = gx[~gone], gy[~gone], px[~k], py[~k]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False for the first rule that holds, else True, as one expression."""
    out = F.lit(True)
    for rule in reversed(rules):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, False).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[Rule]]:
    """Counts, base_failed and kept for every row of ``docs``, and the learned list.

    ``labels`` has key and label (0: reject); null labels and keys are left out, a key labelled twice counts with its
    smallest label. Without usable labels the list is empty, and only the base rules decide.
    """
    table = materialize(text_counts(docs, key, text), "counts")
    known = labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").alias("__label")).dropna().groupBy(key).agg(F.min("__label").alias("__label"))
    seen = table.join(known, key).filter(~base_failed()).select("__label", *[c.alias(n) for n, c in features().items()], F.xxhash64(key).alias("__h"), key)
    sample = seen.orderBy("__h", key).limit(sample_rows).toPandas()
    names = list(features())
    rules = learn_rules(sample[names], sample["__label"].to_numpy() == 0) if len(sample) else []
    fail = base_failed()
    return table.withColumn("base_failed", fail).withColumn("kept", ~fail & verdict(rules)), rules
