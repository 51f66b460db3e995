"""Collocations of two and three words, from count transducers over word n-grams.

Every word of a text is the start of one n-gram: itself and the next two words of its
piece, with empty words where the piece ends. A task collects the n-grams of a
language, sorts them and builds an acyclic automaton whose paths carry counts; tails
that are equal are one state. So f of a phrase is the sum over its prefix, and no
shorter phrase is stored beside its continuations.

The shards are written and cut at common prefixes into ranges of about equal size. The
pieces of a range are united and their weights summed, in one task per range, which
hands on frequent phrases only. The first and last prefix of a range may go on in the
next one; those are handed on whatever they weigh and summed once more. So a word pair
in every text is spread over ranges, and no range is larger than the others.

Candidates are composed with the frequent phrases at every cut: first part and rest
are looked up by joins, since no part is rarer than its phrase.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanweave.llm.common import slices
from urbanweave.operators.ordering import with_position
from urbanweave.runtime import settle

FEWEST, TOP, SHARE = 10, 2000, 50
UNKNOWN = "und"
_BREAK = b"\xff"  # in no UTF-8 text
_BITS = 21
_CODEC = "zstd"


@dataclass(frozen=True)
class Sizes:
    """What a task holds at a time; results do not depend on it."""

    #: Different n-grams of a shard, words that wait to be sorted into it, and its different words.
    grams: int = 1_500_000
    waiting: int = 750_000
    words: int = 500_000
    #: Every so many n-grams one is told as a sample; a range begins at one of so many samples.
    sample: int = 8192
    range_samples: int = 128


def _cut_table() -> bytes:
    table = bytearray(c + 32 if 65 <= c <= 90 else c for c in range(256))
    for c in (*b".,;:!?", *range(0x0A, 0x0E)):
        table[c] = _BREAK[0]
    table[9] = 32
    return bytes(table)


_CUT = _cut_table()


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, a mark where one piece ends and the next begins."""
    return [] if text is None else text.encode("utf-8").translate(_CUT).replace(_BREAK, b" \xff ").split()


def _pack(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number per n-gram, in the order of its word numbers below ``size``."""
    a, b, c = columns
    if size < 1 << _BITS:
        return (a << 2 * _BITS) | (b << _BITS) | c
    _, pair = np.unique((a << 32) | b, return_inverse=True)
    return (pair.astype(np.int64) << 32) | c


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values of sorted columns begin."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _summed(columns: list[np.ndarray], weights: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order, with the sums of their weights."""
    keys = _pack(columns, size)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = _runs(keys)
    total = np.add.reduceat(weights[order], heads) if len(heads) else weights[:0]
    return [c[order[heads]] for c in columns], total


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of runs, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Transducer:
    """Word n-grams with weights: an acyclic automaton of three steps, of which equal last steps are shared.

    ``words`` are in the order of their bytes with a space behind, so paths are in the
    order of their words joined by spaces; the empty word stands behind a piece's end.
    """

    def __init__(self, words: list[bytes], parts: list[np.ndarray]):
        self.words = words
        self.first, self.fan, self.second, self.state, self.state_size, self.third, self.weight = parts

    @staticmethod
    def build(words: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> Transducer:
        """From distinct n-grams (numbers of ``words``) in ascending order."""
        a, b, c = columns
        pairs = _runs(a, b)
        firsts = _runs(a[pairs])
        counts = np.diff(np.r_[pairs, len(a)])
        # Tails meet by a hash of their steps and are compared before one stands for the others.
        steps = _mixed(c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + weights.astype(np.uint64))
        signs = np.add.reduceat(steps, pairs) + _mixed(counts.astype(np.uint64)) if len(pairs) else steps
        _, chosen, state = np.unique(signs, return_index=True, return_inverse=True)
        stands = chosen[state]
        same = counts == counts[stands]
        at, like = _spread(pairs[same], counts[same]), _spread(pairs[stands][same], counts[same])
        differ = (c[at] != c[like]) | (weights[at] != weights[like])
        odd = np.repeat(np.flatnonzero(same), counts[same])[differ]
        same[odd] = False
        alone = np.flatnonzero(~same)
        state = state.astype(np.int64)
        state[alone] = len(chosen) + np.arange(len(alone))
        kept = np.r_[chosen, alone]
        steps_of = _spread(pairs[kept], counts[kept])
        fan = np.diff(np.r_[firsts, len(pairs)])
        return Transducer(words, [a[pairs][firsts], fan, b[pairs], state, counts[kept], c[steps_of], weights[steps_of]])

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All n-grams in order, with their weights."""
        starts = np.cumsum(self.state_size) - self.state_size
        counts = self.state_size[self.state]
        at = _spread(starts[self.state], counts)
        a = np.repeat(np.repeat(self.first, self.fan), counts)
        return [a, np.repeat(self.second, counts), self.third[at]], self.weight[at]

    def packed(self) -> bytes:
        """Bytes of the automaton: numbers by byte planes, compressed."""
        sizes = np.array([len(w) for w in self.words], np.int64)
        parts = [sizes, self.first, self.fan, self.second, self.state, self.state_size, self.third, self.weight]
        head = np.array([len(p) for p in parts], "<i8").tobytes()
        wide = [np.frombuffer(p.astype("<i8").tobytes(), np.uint8).reshape(-1, 8) for p in parts]
        used = [1 + int(np.flatnonzero(w.any(axis=0))[-1]) if w.any() else 1 for w in wide]
        body = b"".join([np.ascontiguousarray(w[:, :u].T).tobytes() for w, u in zip(wide, used, strict=True)])
        data = head + bytes(used) + body + b"".join(self.words)
        return len(data).to_bytes(8, "little") + pa.compress(data, codec=_CODEC, asbytes=True)

    @staticmethod
    def unpacked(data: bytes) -> Transducer:
        data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=_CODEC, asbytes=True)
        lengths, used, at = np.frombuffer(data[:64], "<i8").tolist(), data[64:72], 72
        parts = []
        for length, width in zip(lengths, used, strict=True):
            wide = np.zeros((length, 8), np.uint8)
            wide[:, :width] = np.frombuffer(data, np.uint8, length * width, at).reshape(width, length).T
            parts.append(wide.view("<i8").ravel())
            at += length * width
        ends = np.cumsum(parts[0])
        words = [data[at + e - n : at + e] for e, n in zip(ends.tolist(), parts[0].tolist(), strict=True)]
        return Transducer(words, parts[1:])

    @staticmethod
    def ranged(words: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> Transducer:
        """As ``build``, of n-grams that use few of ``words``."""
        used = np.zeros(len(words), bool)
        for c in columns:
            used[c] = True
        numbers = np.cumsum(used) - 1
        return Transducer.build([words[i] for i in np.flatnonzero(used).tolist()], [numbers[c] for c in columns], weights)

    @staticmethod
    def union(parts: list[bytes]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """Words, n-grams in order, and summed weights of packed automata."""
        number: dict[bytes, int] = {}
        columns, weights = [], []
        for part in parts:
            held = Transducer.unpacked(part)
            grams, weight = held.paths()
            own = np.array([number.setdefault(w, len(number)) for w in held.words], np.int64)
            columns.append([own[c] for c in grams])
            weights.append(weight)
        words, place = _in_order(list(number))
        joined = [place[np.concatenate(c)] for c in zip(*columns, strict=True)]
        return words, *_summed(joined, np.concatenate(weights), len(words))


def _in_order(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words in the order of their bytes with a space behind, and the place of each."""
    order = sorted(range(len(words)), key=lambda i: words[i] + b" ")
    place = np.zeros(len(words), np.int64)
    place[order] = np.arange(len(words))
    return [words[i] for i in order], place


class _Shard:
    """Counts the n-grams of one language in a task."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes
        self.number: dict[bytes, int] = {b"": 0, _BREAK: 0}
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0
        self.columns, self.weights = [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64)

    def add(self, words: list[bytes], tail: list[bytes]) -> bool:
        """Take words of a text, of which ``tail`` are the next two; says whether the shard is full."""
        number, all_words = self.number, [*words, *tail]
        for word in set(all_words).difference(number):
            number[word] = len(number) - 1
        ids = np.zeros(len(words) + 2, np.int64)
        ids[: len(all_words)] = np.fromiter(map(number.__getitem__, all_words), np.int64, len(all_words))
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        here = a > 0
        self.waiting.append([a[here], b[here], np.where(b > 0, c, 0)[here]])
        self.size += len(words)
        if self.size > self.sizes.waiting:
            self.settle()
        return len(self.weights) > self.sizes.grams or len(number) > self.sizes.words

    def settle(self) -> None:
        """Sort what waits into the counts."""
        columns = [np.concatenate(x) for x in zip(self.columns, *self.waiting, strict=True)]
        weights = np.concatenate((self.weights, np.ones(len(columns[0]) - len(self.weights), np.int64)))
        self.waiting, self.size = [], 0
        self.columns, self.weights = _summed(columns, weights, len(self.number))

    def described(self) -> tuple[bytes, list[bytes]] | None:
        """The shard as a packed automaton, and one n-gram of every ``sizes.sample`` or so, words joined by spaces."""
        self.settle()
        if not len(self.weights):
            return None
        words, place = _in_order([b"", *list(self.number)[2:]])
        columns, weights = _summed([place[c] for c in self.columns], self.weights, len(words))
        # Small shards tell one in proportion to their size.
        first = random.Random(len(weights) * 31 + TaskContext.get().partitionId()).randrange(self.sizes.sample)
        drawn = range(first, len(weights), self.sizes.sample)
        told = [b" ".join([words[c[i]] for c in columns]) for i in drawn]
        return Transducer.build(words, columns, weights).packed(), told


def shards(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(lang, grams, samples): packed automata of the n-grams of tasks, and n-grams drawn from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Shard] = {}

        def told(lang: str) -> Iterator[pa.RecordBatch]:
            found = held.pop(lang).described()
            if found:
                columns = [pa.array([lang]), pa.array([found[0]], pa.binary()), pa.array([[s.decode() for s in found[1]]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "grams", "samples"])

        for batch in (part for whole in batches for part in slices(whole, 100)):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                for at in range(0, len(words), sizes.waiting):
                    end = at + sizes.waiting
                    if held.setdefault(lang, _Shard(sizes)).add(words[at:end], words[end : end + 2]):
                        yield from told(lang)
            # However many languages there are, a task holds a bounded number of words.
            while sum(len(s.number) + s.size for s in held.values()) > 2 * (sizes.words + sizes.waiting):
                yield from told(max(held, key=lambda one: len(held[one].weights) + held[one].size))
        for lang in list(held):
            yield from told(lang)

    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "lang string, grams binary, samples array<string>")


def _bounds(told: DataFrame, every: int) -> list[tuple[str, bytes]]:
    """Where ranges begin: one n-gram of ``every`` samples, that is of a million n-grams or so."""
    samples = told.select("lang", F.explode("samples").alias("sample"))
    placed = with_position(samples, [F.col("lang"), F.col("sample")], "place").where(F.col("place") % every == 0)
    return [(r.lang, r["sample"].encode()) for r in placed.select("lang", "sample").distinct().orderBy("lang", "sample").collect()]


def _pieces(told: DataFrame, bounds: list[tuple[str, bytes]]) -> DataFrame:
    """(lang, number, grams): the shards cut at ``bounds``."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, bound in bounds:
        by_lang.setdefault(lang, []).append(bound)
    shared = told.sparkSession.sparkContext.broadcast(by_lang)  # one n-gram per million

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            lang, packed = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            held = Transducer.unpacked(packed)
            columns, weights = held.paths()
            starts, at = shared.value.get(lang, []), 0

            def spelled(i: int, words: list[bytes] = held.words, columns: list[np.ndarray] = columns) -> bytes:
                return b" ".join([words[c[i]] for c in columns])

            while at < len(weights):  # only ranges that the shard has n-grams in are looked at
                number = bisect_right(starts, spelled(at))
                end = len(weights) if number == len(starts) else bisect_left(range(len(weights)), starts[number], at, key=spelled)
                piece = Transducer.ranged(held.words, [c[at:end] for c in columns], weights[at:end]).packed()
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number], pa.int32()), pa.array([piece], pa.binary())], names=["lang", "number", "grams"])
                at = end

    return told.select("lang", "grams").mapInArrow(run, "lang string, number int, grams binary")


def phrase_counts(docs: DataFrame, fewest: int = FEWEST, sizes: Sizes | None = None) -> DataFrame:
    """(lang, phrase, size, f): phrases of one to three words that occur ``fewest`` times or more, and all words of a language as size 0.

    phrase joins its words by spaces; f counts contiguous occurrences within pieces,
    overlaps included. Null and empty texts have no words; a null lang is ``und``;
    repeated rows count again; columns other than lang and text are not read.
    """
    sizes = Sizes() if sizes is None else sizes
    told = settle(shards(docs, sizes))
    pieces = _pieces(told, _bounds(told, sizes.range_samples))

    def unite(table: pa.Table) -> pa.Table:
        words, columns, weights = Transducer.union(table["grams"].to_pylist())
        none = words.index(b"") if b"" in words else -1
        phrases, sizes, counts = [b""], [0], [int(weights.sum())]
        for size in (1, 2, 3):
            heads = _runs(*columns[:size])
            total = np.add.reduceat(weights, heads)
            ends = np.zeros(len(heads), bool)
            ends[[0, -1]] = True  # the prefix may go on in the next range
            whole = columns[size - 1][heads] != none
            for i in np.flatnonzero(whole & (ends | (total >= fewest))).tolist():
                phrases.append(b" ".join([words[c[heads[i]]] for c in columns[:size]]))
                sizes.append(size)
                counts.append(int(total[i]))
        texts = pa.array([p.decode() for p in phrases])
        langs = pa.array([table["lang"][0].as_py()] * len(phrases))
        return pa.table([langs, texts, pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "size", "f"])

    found = pieces.groupBy("lang", "number").applyInArrow(unite, "lang string, phrase string, size int, f long")
    summed = found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return summed.where((F.col("f") >= fewest) | (F.col("size") == 0))


def compose(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): the cut of each candidate with the lowest score, the first one of equals.

    Every cut asks for f of its first part and of the rest; both are frequent, since
    their phrase is. Products are decimals of 38 digits;
    ``div`` floors them exactly, and no score passes a million, as l and r are at least a.
    """
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    asked = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), cut.alias("k"))
    asked = asked.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    for part, name in (("left", "l"), ("rest", "r")):
        known = weights.where("size > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        asked = asked.join(known, ["lang", part])
    wide = {c: f"cast({c} as decimal(18, 0))" for c in "alr"}
    score = F.expr(f"({wide['a']} * {wide['a']} * 1000000BD) div ({wide['l']} * {wide['r']})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return asked.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def _uncovered(scored: DataFrame, share: int) -> DataFrame:
    """Without candidates of two words that lie in one of three with ``share`` percent of their occurrences or more."""
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)")))
    longer = scored.where("size = 3").select("lang", inner.alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))
    kept = scored.join(longer, ["lang", "phrase"], "left")
    return kept.where(F.col("longest_a").isNull() | (100 * F.col("longest_a") < share * F.col("a"))).drop("longest_a")


def collocations(docs: DataFrame, fewest: int = FEWEST, top: int = TOP, share: int = SHARE, sizes: Sizes | None = None) -> DataFrame:
    """Each language's first ``top`` phrases by score, a (both descending) and phrase: lang, rank, phrase, a, l, r, n, score.

    score is floor(1000000 * a * a / (l * r)) of the lowest-scoring cut; phrases mostly
    found inside a longer candidate are left out. See ``phrase_counts`` for nulls.
    """
    weights = settle(phrase_counts(docs, fewest, sizes))
    scored = settle(compose(weights.where("size > 1"), weights))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = _uncovered(scored, share)
    # Parts of a language hand on their own first ones, so its task sees few rows however many candidates there are.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = weights.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
