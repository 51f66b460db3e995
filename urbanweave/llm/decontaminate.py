"""Benchmark decontamination with one Aho-Corasick automaton over the normalised item windows.

A text is normalised once (lower-cased words with single spaces between) and
scanned once; matches are carried back to words and to code points of the
original. The automaton is built from counted windows: when they exceed
``max_windows`` they are dealt into blocks by hash, each block has an automaton
of its own and a pass of its own, and the hits are united.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanweave.llm.common import keep_rows, keyed_texts, lower_words, map_batches
from urbanweave.runtime import settle

WINDOW = 10
MAX_WINDOWS = 200_000
WINDOW_BYTES = 200  # mean size of a window above which the bytes, not the number, set the blocks
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): ``window`` words in a row of the item, or all of a shorter one; item is null where the id is."""
    chosen = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("item", T.StringType())])

    def cut(batches):
        for batch in batches:
            windows, owners = [], []
            for owner, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lower_words(body)
                last = max(1, len(words) - window + 1) if words else 0
                found = {b" ".join(words[i : i + window]) for i in range(last)}
                windows += found
                owners += [owner] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(owners, pa.string())], names=["window", "item"])

    return chosen.mapInArrow(cut, schema).distinct()


class Scanner:
    """Automaton of a block of windows, and where they occur in a text."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in windows:
            # Bytes as Latin-1 characters: one automaton step per byte, nothing is lost.
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, disjoint hit ranges of words, and items with a window in the text."""
        words = lower_words(text)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return len(words), spans, items
        joined = f" {b' '.join(words).decode('latin-1')} "
        counted = before = 0
        for end, (length, owners) in self.automaton.iter(joined):
            before += joined.count(" ", counted, end)
            counted = end
            items.update(owners)
            start = before - length
            while spans and start <= spans[-1][1]:  # ends never fall, so only the last ranges can touch
                start = min(start, spans.pop()[0])
            spans.append((start, before))
        return len(words), spans, items


def _original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges in ``text`` of ranges of words."""
    data = text.encode("utf-8")
    at = [m.span() for m in _WORD_BYTES.finditer(data)]
    found, done, points = [], 0, 0
    for start, end in spans:
        edges = []
        for byte in (at[start][0], at[end - 1][1]):
            points += len(data[done:byte].decode("utf-8"))
            done = byte
            edges.append(points)
        found.append((edges[0], edges[1]))
    return found


_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "start", "end")])


def _shared(docs: DataFrame, windows: DataFrame):
    """One block of windows with their items, for all tasks; the block was counted."""
    rows = windows.groupBy("window").agg(F.sort_array(F.collect_list("item")).alias("items")).collect()  # null ids are in no list
    return docs.sparkSession.sparkContext.broadcast([(bytes(r.window), list(r["items"])) for r in rows])


def _scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their words, hit spans and items, against one block of windows."""
    shared = _shared(docs, windows)
    fields = [docs.schema["doc_id"], T.StructField("text_id", T.LongType()), T.StructField("n_words", T.LongType())]
    fields += [T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]

    def make():
        scanner = Scanner(shared.value)

        def scan(batch: dict) -> dict:
            out = {"doc_id": batch["doc_id"], "text_id": batch["text_id"], "n_words": [], "spans": [], "items": []}
            for text in batch["text"]:
                n_words, spans, items = scanner.scan(text)
                places = _original_offsets(text, spans) if spans else []
                out["n_words"].append(n_words)
                out["spans"].append(
                    [dict(first_word=a, end_word=b, start=s, end=e) for (a, b), (s, e) in zip(spans, places, strict=True)]
                )
                out["items"].append(sorted(items))
            return out

        return scan

    return map_batches(docs, fields, make)


def _in_blocks(windows: DataFrame, max_windows: int) -> tuple[DataFrame, int]:
    """Windows with the block they are dealt into, and the number of blocks, from their count and bytes."""
    found = windows.groupBy("window").agg(F.length(F.first("window")).alias("size")).agg(F.count("*"), F.sum("size")).first()
    filled = max(found[0] / max_windows, (found[1] or 0) / (max_windows * WINDOW_BYTES))
    blocks = 1 if filled <= 1 else int(filled * 1.5) + 1  # a hash deals unevenly
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    return (dealt if blocks == 1 else settle(dealt)), blocks


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (words and code points of the original), items.

    A null or empty text has no words and no hit; an item without words has no
    window. An item without id counts as hit, but is in no list of items. Rows that
    share a doc_id keep rows of their own. Other columns of both tables are not read. ``max_windows`` bounds
    what is collected and broadcast at a time; more windows take more passes.
    """
    texts = keyed_texts(docs).withColumn("text_id", F.xxhash64("text"))
    windows = item_windows(items, window=window)
    windows, blocks = _in_blocks(windows, max_windows)
    if blocks == 1:
        return _scan(texts, windows.drop("block")).drop("text_id")
    hits, base = None, None
    for block in range(blocks):
        scanned = _scan(texts, windows.where(F.col("block") == block).drop("block"))
        base = base or scanned.select("doc_id", "text_id", "n_words")
        part = settle(scanned.where(F.size("spans") > 0).drop("n_words").dropDuplicates(["doc_id", "text_id"]))
        hits = part if hits is None else hits.unionByName(part)
    united = hits.groupBy("doc_id", "text_id").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    same = base.doc_id.eqNullSafe(united.doc_id) & base.text_id.eqNullSafe(united.text_id)
    none = [F.array().cast(T.ArrayType(_SPAN)), F.array().cast("array<string>")]
    return base.join(united, same, "left").select(
        base.doc_id, "n_words", *[F.coalesce(c, n).alias(c) for c, n in zip(("spans", "items"), none, strict=True)]
    )


def with_counts(found: DataFrame) -> DataFrame:
    """``contamination`` rows with hit words (counted once), item count and contaminated."""
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s.first_word, s.end_word - 1)))
    return found.withColumns(
        {
            "n_hit": F.size(F.array_distinct(positions)).cast("long"),
            "n_items": F.size("items").cast("long"),
            "contaminated": F.size("spans") > 0,
        }
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Rows of ``docs``, all columns, in whose text no window of an item occurs, with or without id: one pass per block of windows.

    Null and empty texts hold no window and stay, as do repeated rows of a text without one.
    """
    windows, blocks = _in_blocks(item_windows(items, window=window), max_windows)
    for block in range(blocks):
        shared = _shared(docs, windows.where(F.col("block") == block))

        def make(shared=shared):
            scanner = Scanner(shared.value)
            return lambda texts: [not scanner.scan(text)[1] for text in texts]

        docs = keep_rows(docs, "text", make)
        docs = settle(docs) if block < blocks - 1 else docs
    return docs
