"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the lower-cased letters of a text, counted
and scaled to unit length. All decisions, between families and between the
languages of a family, are linear SVMs for pairs; the winner of each step has the
most votes, then the larger sum of margins, then the first name.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanweave.llm.common import keep_rows, keyed_texts, map_batches

# Language families by code; a language without one is its own family.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi bn mr gu pa ur ne",
    "iranian": "fa ku ps",
    "semitic": "ar he am mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNDETERMINED = "und"
BUCKETS = 1 << 15
#: Rows per language the model may be fitted on; with more, a hash of doc_id and text picks this share.
MOST_ROWS = 800
EPOCHS, REGULARISATION, SHARPNESS = 6, 2e-4, 4.0


def _letters_table() -> bytes:
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for code in range(ord("a"), ord("z") + 1):
        table[code] = table[code - 32] = code
    return bytes(table)


_LETTERS = _letters_table()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, runs of other ASCII bytes being one space."""
    words = text.encode("utf-8").translate(_LETTERS).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    mixed = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(17)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, the values of unit length (empty if there is no trigram)."""
    counts = np.bincount(trigrams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at, (values / max(np.sqrt((values**2).sum()), 1e-12)).astype(np.float32)


@dataclass
class Model:
    """Classes in name order, their families, the compared pairs and their weights (buckets x pairs)."""

    languages: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def _decide(self, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, sums, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {n: [] for n in names}
        for (a, b), margin in zip(self.pairs, margins.tolist(), strict=True):
            if a in votes and b in votes:
                votes[a if margin > 0 else b] += 1
                for name, own in ((a, margin), (b, -margin)):
                    sums[name] += own
                    sure[name].append(1 / (1 + np.exp(-SHARPNESS * own)))
        best = min(names, key=lambda n: (-votes[n], -sums[n], n))
        return best, float(np.mean(sure[best]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        at, values = features(text)
        margins = values @ self.weights[at] + self.bias if len(self.pairs) else np.zeros(0)
        family, sure = self._decide(sorted({family_of(n) for n in self.languages}), margins)
        language, surer = self._decide([n for n in self.languages if family_of(n) == family], margins)
        return language, sure * surer


def family_of(language: str) -> str:
    return "family:" + _FAMILY_OF.get(language, language)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged Pegasos over the rows in their order, both classes weighing the same."""
    weights, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = sum_bias = 0.0
    shares = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (-1, 1)}
    scale, step, n_sums = 1.0, 0, 0
    for epoch in range(EPOCHS):
        for (at, values), sign in zip(rows, signs.tolist(), strict=True):
            step += 1
            rate = 1 / (REGULARISATION * (step + 1000))
            margin = sign * (scale * float(values @ weights[at]) + bias)
            scale *= 1 - rate * REGULARISATION
            if margin < 1:
                move = rate * sign * shares[sign]
                weights[at] += move / scale * values
                bias += 0.01 * move * REGULARISATION
        if epoch >= EPOCHS // 2:
            total += scale * weights
            sum_bias += bias
            n_sums += 1
    return total / max(1, n_sums), sum_bias / max(1, n_sums)


def fit(languages: list[str], texts: list[str]) -> Model:
    names = sorted(set(languages))
    rows = [features(t) for t in texts]
    order = np.random.default_rng(7).permutation(len(rows))
    rows, labels = [rows[i] for i in order], [languages[i] for i in order]
    families = sorted({family_of(n) for n in names})
    pairs = list(combinations(families, 2))
    for family in families:
        pairs += combinations([n for n in names if family_of(n) == family], 2)
    columns, bias = [], []
    for a, b in pairs:
        chosen = [i for i, n in enumerate(labels) if n in (a, b) or family_of(n) in (a, b)]
        signs = np.array([1 if a in (labels[i], family_of(labels[i])) else -1 for i in chosen])
        weights, shift = _svm([rows[i] for i in chosen], signs)
        columns.append(weights)
        bias.append(shift)
    stacked = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((BUCKETS, 0), np.float32)
    return Model(names, pairs, stacked, np.array(bias, np.float32))


def in_fold(key: str, folds: int, fold: int):
    """Whether crc32 of the key as text leaves ``fold`` by ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) == fold


def sample_per_class(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most about ``most`` rows per value of ``label``, picked by hash; all of them where there are fewer.

    The shares come to the driver, one number per class (as many as the model
    tells apart), so that rows are picked where they are read.
    """
    shares = [(r[0], min(1.0, most / r[1])) for r in rows.groupBy(label).count().collect()]
    if not shares:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for pair in shares for x in pair])[F.col(label)]
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)


def train(docs: DataFrame, most_rows: int = MOST_ROWS, folds: int = 5, fold: int = 0) -> Model:
    """Fit on text and non-null lang of the rows outside the held-out fold, at most ``most_rows`` per language.

    The rows picked are featurised and fitted in one task; what comes back is the
    model, whose size does not depend on the rows.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~in_fold("doc_id", folds, fold))
    picked = sample_per_class(known, "lang", most_rows).where(F.col("text").rlike(r"\p{L}"))
    schema = "languages array<string>, pairs array<string>, weights binary, bias binary"

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r))
        model = fit([r[1] for r in rows], [r[2] for r in rows])
        return pa.table(
            {
                "languages": pa.array([model.languages], pa.list_(pa.string())),
                "pairs": pa.array([[x for p in model.pairs for x in p]], pa.list_(pa.string())),
                "weights": pa.array([model.weights.tobytes()], pa.binary()),
                "bias": pa.array([model.bias.tobytes()], pa.binary()),
            }
        )

    found = picked.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(learn, schema).collect()
    if not found:
        return Model([], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    row = found[0]
    pairs = list(zip(row["pairs"][::2], row["pairs"][1::2], strict=True))
    weights = np.frombuffer(row["weights"], np.float32).reshape(BUCKETS, len(pairs))
    return Model(row["languages"], pairs, weights, np.frombuffer(row["bias"], np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (0 to 1, the mean certainty of the decisions won, by step, multiplied).

    ``und`` with score 0 if the text is null, has no letter, or no language was
    learned. Only the text is read for a prediction; equal texts get equal ones.
    """
    texts = keyed_texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x pairs of languages
    fields = [texts.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        held = shared.value

        def judge(batch: dict) -> dict:
            found = [held.predict(text) for text in batch["text"]]
            return {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return judge

    return map_batches(texts, fields, make)


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose text is in a learned language with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [found[1] >= least_score and found[0] != UNDETERMINED for found in map(shared.value.predict, texts)]

    return keep_rows(docs, "text", make)
