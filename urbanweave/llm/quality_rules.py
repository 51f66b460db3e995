"""Quality rules as a short-circuit cascade.

Every task measures all rules on its first rows (cost and rejections), orders
them by rejections per second, and from then on stops at the first rule that
rejects a text. A text is kept when no rule rejects it, which does not depend on
the order, so tasks may order differently and may be repeated.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanweave.llm.common import ascii_space, keyed_texts, map_batches

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower()
_ASCII_OTHERS = bytes(c for c in range(0x21, 0x7F) if c not in _LETTERS)
WINDOW = 5


class Measures:
    """What the rules read of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = ascii_space(text)

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.data) - len(self.data.translate(None, b" \t\n\x0b\x0c\r")))

    def count(self, of: bytes) -> int:
        return len(self.data) - len(self.data.translate(None, of))

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        covered = reached = 0
        for start, window in enumerate(windows):
            if found[window] > 1:
                covered += start + WINDOW - max(reached, start)
                reached = start + WINDOW
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


BASE_RULES = [
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
]
MORE_RULES = [
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 3 * len(m.lines)),
    Rule("word_length", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 15 * m.n_words),
    Rule("shouting", lambda m: 2 * m.count(_UPPER) > m.count(_LETTERS)),
    Rule("few_letters", lambda m: 10 * m.count(_ASCII_OTHERS) > 4 * m.word_chars),
]
RULES = BASE_RULES + MORE_RULES


class Cascade:
    """Rules in an order learned from the first ``sample_rows`` texts."""

    def __init__(self, rules: list[Rule], sample_rows: int):
        self.rules, self.sample_rows = list(rules), sample_rows
        self.seen = 0
        self.seconds = dict.fromkeys((r.name for r in rules), 0.0)
        self.rejected = dict.fromkeys((r.name for r in rules), 0)

    def _sample(self, text: str | None) -> None:
        for rule in self.rules:
            fresh = Measures(text)  # so that a shared measure is charged to every rule that needs it
            began = time.perf_counter()
            verdict = rule.rejects(fresh)
            self.seconds[rule.name] += time.perf_counter() - began
            self.rejected[rule.name] += verdict
        self.seen += 1
        if self.seen == self.sample_rows:
            self.rules.sort(key=self._worth, reverse=True)

    def _worth(self, rule: Rule) -> float:
        return self.rejected[rule.name] / max(self.seconds[rule.name], 1e-9)

    def rejects(self, measures: Measures, text: str | None) -> bool:
        if self.seen < self.sample_rows:
            self._sample(text)
        return any(rule.rejects(measures) for rule in self.rules)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 64, measures: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept, and with ``measures`` the figures of the contract.

    A null text counts as empty: it has no words and is rejected. Rows with the
    same doc_id are judged one by one; a null doc_id stays null. Other columns of
    ``docs`` are not read. ``sample_rows`` (texts per task) bounds the sample.
    """
    chosen = RULES if rules is None else rules
    long = T.LongType()
    fields = [T.StructField("doc_id", keyed_texts(docs).schema["doc_id"].dataType), T.StructField("kept", T.BooleanType())]
    if measures:
        counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        fields += [T.StructField(name, long) for name in counted] + [T.StructField("base_failed", T.BooleanType())]

    def make():
        cascade = Cascade(chosen, sample_rows)

        def judge(batch: dict) -> dict:
            out = {f.name: [] for f in fields}
            out["doc_id"] = batch["doc_id"]
            for text in batch["text"]:
                seen = Measures(text)
                out["kept"].append(not cascade.rejects(seen, text))
                if measures:
                    for name in counted:
                        out[name].append(getattr(seen, name))
                    out["base_failed"].append(any(rule.rejects(seen) for rule in BASE_RULES))
            return out

        return judge

    return map_batches(keyed_texts(docs), fields, make)


def rule_report(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 64) -> DataFrame:
    """Per rule, over the samples of all partitions: texts, rejections and seconds, best worth first."""
    chosen = RULES if rules is None else rules

    def sample(batches):
        cascade = Cascade(chosen, sample_rows)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if cascade.seen < sample_rows:
                    cascade._sample(text)
            if cascade.seen >= sample_rows:
                break
        names = list(cascade.rejected)
        yield pa.RecordBatch.from_pydict(
            {
                "rule": pa.array(names, pa.string()),
                "texts": pa.array([cascade.seen] * len(names), pa.int64()),
                "rejected": pa.array([cascade.rejected[n] for n in names], pa.int64()),
                "seconds": pa.array([cascade.seconds[n] for n in names], pa.float64()),
            }
        )

    sampled = keyed_texts(docs).select("text").mapInArrow(sample, "rule string, texts long, rejected long, seconds double")
    summed = sampled.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("texts", "rejected", "seconds")])
    return summed.orderBy(F.desc(F.col("rejected") / F.greatest("seconds", F.lit(1e-9))), "rule")
