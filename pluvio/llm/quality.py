"""Quality rules as a short-circuit cascade.

A rule looks at a text's measures, which are computed only when a rule asks
for them.  The time each rule takes and the part of texts it rejects are
measured on a bounded sample; the rules then run in the order of rejections per
second, and a text leaves the cascade at its first rejection.  The verdict does
not depend on the order, only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import freed, whole_text

#: Texts the cost and selectivity estimate looks at, at most.
SAMPLE_TEXTS = 400
WINDOW = 8
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words, WINDOW)

    @cached_property
    def n_shouted(self) -> int:
        return sum(w.endswith(b"!!") for w in self.words)

    @cached_property
    def n_stuttered(self) -> int:
        return sum(a == b for a, b in zip(self.words, self.words[1:]))


def repeated_words(words: list[bytes], size: int) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    if len(np.unique(rolled)) == n:
        return 0  # windows of different hashes differ
    # exact: number the words, then pairs, fours and eights of them by their two halves
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    span, rest, parts = 1, size, []
    at = 0
    while rest:  # windows as runs of lengths that are powers of two
        if rest & 1:
            parts.append(ids[at : at + n])
            at += span
        rest >>= 1
        if rest:
            ids = np.unique(ids[: len(ids) - span] * len(words) + ids[span:], return_inverse=True)[1]
            span *= 2
    key = parts[0]
    for p in parts[1:]:
        key = np.unique(key * len(words) + p, return_inverse=True)[1]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[which] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + size, -1)
    return int((np.cumsum(cover) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: The base rules of the contract, then rules on symbols, lines, words, shouting and stutter.
BASE = (
    Rule("few_words", lambda m: m.n_words < 20),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
MORE = (
    Rule("symbols", lambda m: 100 * m.n_symbols > 25 * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 50 * len(m.lines)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("shouted", lambda m: 100 * m.n_shouted > 25 * m.n_words),
    Rule("stuttered", lambda m: 100 * m.n_stuttered > 30 * m.n_words),
)


def _trial(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """Seconds and rejections of every rule by itself over the batches' texts."""
    seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                rejected[i] += rule.rejects(Measures(text))
                seconds[i] += time.perf_counter() - began
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64()), pa.array([n] * len(rules), pa.int64())],
        ["rule", "seconds", "rejected", "n"],
    )


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample: int = SAMPLE_TEXTS) -> tuple[Rule, ...]:
    """``rules`` by rejections per second on a sample of about ``sample`` texts (at most twice that)."""
    n = docs.count()
    if not n:
        return rules
    few = docs.select(whole_text(text_col).alias("t")).sample(min(1.0, 1.2 * sample / n), seed=7).limit(2 * sample)
    trial = few.mapInArrow(lambda it: _trial(it, rules), "rule int, seconds double, rejected long, n long")
    got = {r[0]: (r[1], r[2]) for r in trial.groupBy("rule").agg(F.sum("seconds"), F.sum("rejected")).collect()}
    worth = {i: (got.get(i, (1.0, 0))[1] / max(got.get(i, (1.0, 0))[0], 1e-9)) for i in range(len(rules))}
    return tuple(rules[i] for i in sorted(worth, key=lambda i: (-worth[i], i)))


_MEASURED = "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


@freed
def _judge(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        rows = []
        for text in batch.column("_text").to_pylist():
            m = Measures(text)
            measures = [getattr(m, x) for x in names]
            failed = any(r.rejects(m) for r in BASE)
            rows.append((*measures, failed, not failed and not any(r.rejects(m) for r in rules)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.bool_()) for c in cols[5:]]],
            ["_id", *names, "base_failed", "kept"],
        )


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the five measures, base_failed, kept (no base rule and none of ``rules`` rejects).

    Null and empty texts have no words and fail the base; repeated rows are judged each; an
    empty table gives an empty report.  Other columns of ``docs`` are not read.
    """
    ordered = cascade_order(docs, rules, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(lambda it: _judge(it, ordered), _MEASURED).withColumnRenamed("_id", id_col)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    ordered = cascade_order(docs, rules, text_col)

    @F.pandas_udf("boolean")
    def keeps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return verdicts(batches)

    @freed
    def verdicts(batches):
        for texts in batches:
            yield texts.map(lambda t: not any(r.rejects(m) for m in (Measures(t),) for r in ordered)).astype(bool)

    return docs.where(keeps(whole_text(text_col)))
