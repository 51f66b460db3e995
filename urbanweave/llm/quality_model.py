"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features are single words and pairs of neighbours (runs of punctuation are words
too), hashed into buckets; a text's value for a bucket is its share of the
text's n-grams. A score is the sigmoid of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanweave.llm.common import keyed_texts, map_batches
from urbanweave.llm.language_id import in_fold, sample_per_class
from urbanweave.runtime import settle_counted, small_side

BITS = 18
#: Labelled rows per class the model may be fitted on; with more, a hash picks this share.
MOST_ROWS = 2500
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 4
SCALE = 8.0
CUT = 0.7
_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+|\n")
_WORD_CACHE = 500_000


class Hasher:
    """Buckets of a text's n-grams; hashes of words are remembered, boundedly."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint32((1 << bits) - 1)
        self.known: dict[bytes, int] = {}

    def buckets(self, text: str | None) -> np.ndarray:
        """One bucket per n-gram of the whole text; a null text has none."""
        tokens = _TOKENS.findall(text.encode("utf-8")) if text else []
        known = self.known
        try:
            codes = [known[t] for t in tokens]
        except KeyError:
            if len(known) > _WORD_CACHE:
                known.clear()
            for token in tokens:
                if token not in known:
                    known[token] = zlib.crc32(token)
            codes = [known[t] for t in tokens]
        ones = np.array(codes, np.uint32)
        both = (ones[:-1] * np.uint32(0x9E3779B1)) ^ (ones[1:] + np.uint32(0x7F4A7C15))
        both[ones[:-1] == ones[1:]] = 1  # any word twice in a row is one feature
        mixed = np.concatenate([ones, both]) * np.uint32(0x85EBCA77)
        return (mixed ^ (mixed >> np.uint32(15))) & self.mask


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        total = self.bias + (SCALE * float(self.weights[buckets].mean(dtype=np.float64)) if len(buckets) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> Model:
    """FTRL-proximal over the rows in their order, several times; classes weigh the same."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    ones = sum(label for _, label in rows)
    share = {1: len(rows) / (2 * max(1, ones)), 0: len(rows) / (2 * max(1, len(rows) - ones))}
    sparse = [(*np.unique(b, return_counts=True), len(b), label) for b, label in rows]

    def solved(zs, ns, l1):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, counts, total, label in sparse:
            values = SCALE * counts / max(1, total)
            weights = solved(z[at], n[at], L1)
            bias = float(solved(np.float64(zb), np.float64(nb), 0.0))
            p = 1 / (1 + np.exp(-np.clip(values @ weights + bias, -35, 35)))
            error = (p - label) * share[label]
            slope = error * values
            z[at] += slope - (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / ALPHA * weights
            n[at] += slope**2
            zb += error - (np.sqrt(nb + error**2) - np.sqrt(nb)) / ALPHA * bias
            nb += error**2
    return Model(solved(z, n, L1).astype(np.float32), float(solved(np.float64(zb), np.float64(nb), 0.0)))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, folds: int = 4, fold: int = 2) -> Model:
    """Fit on the labelled rows outside the held-out fold, at most ``most_rows`` per class.

    Rows with a null label, or without a document, are left out. The rows picked
    are fitted in one task, in the order of a hash of their key; without any row
    every score is one half.
    """
    judged = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    picked, counted = settle_counted(sample_per_class(judged.where(~in_fold("doc_id", folds, fold)), "quality", most_rows))
    rows = keyed_texts(docs).join(small_side(picked, counted), "doc_id").withColumn("all", F.lit(1))

    def learn(table: pa.Table) -> pa.Table:
        hasher = Hasher()
        held = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["quality"].to_pylist(), strict=True))
        held.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or "", r[2]))
        model = fit([(hasher.buckets(text), label) for _, text, label in held])
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})

    found = rows.groupBy("all").applyInArrow(learn, "weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"])


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted (1 from ``cut`` on). Null and empty texts get the model's bias.

    Only the text is read for a score; other columns of ``docs`` are not read.
    """
    texts = keyed_texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    fields = [texts.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        hasher, held = Hasher(), shared.value

        def judge(batch: dict) -> dict:
            scores = [held.score(hasher.buckets(text)) for text in batch["text"]]
            return {"doc_id": batch["doc_id"], "score": scores, "predicted": [int(s >= cut) for s in scores]}

        return judge

    return map_batches(texts, fields, make)
