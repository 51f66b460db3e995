"""Language identification and the quality classifier: held-out accuracy, and rows of every case."""

import zlib
from collections import Counter

import numpy as np
import pytest

from urbanweave.llm import language_id as la
from urbanweave.llm import quality_model as qm
from urbanweave.llm.queries import QUERIES

from . import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def test_language_of_held_out_documents(spark, tables):
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(tables[0])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == tables[0][r.doc_id].lang for r in held) >= 0.98 * len(held) > 0


def test_language_of_every_case(spark):
    rows = [(i, cases.prose(40, i), "en", None, None) for i in range(20)] + [(100 + i, " ".join(["straße", "über", "öl", "und"] * 9), "de", "x", 1) for i in range(20)]
    model = la.train(cases.table(spark, rows))
    found = la.predict(cases.table(spark), model).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in cases.ROWS)
    for key in (1, 2, 3):
        assert by_id[key] == [("und", 0.0)]
    assert by_id[5] == by_id[6] and by_id[5][0][0] == "en"
    kept = la.keep_known(cases.table(spark), model, 0.0)
    assert kept.columns == cases.table(spark).columns and kept.where("doc_id in (1, 2, 3)").count() == 0 and kept.where("doc_id = 8").count() == 1
    nothing = la.train(cases.none(spark))
    assert {r.lang_pred for r in la.predict(cases.table(spark), nothing).collect()} == {"und"}
    assert la.predict(cases.none(spark), model).count() == 0


def test_training_reads_neither_held_out_rows_nor_null_languages(spark):
    rows = [(i, cases.prose(30, i), "en" if zlib.crc32(str(i).encode()) % 5 else "xx", None, None) for i in range(60)]
    rows += [(100 + i, cases.prose(30, i), None, None, None) for i in range(20)]
    assert la.train(cases.table(spark, rows)).languages == ["en"]


def test_family_first_then_pairs_within_it():
    model = la.fit(["en", "de", "fr", "es", "ja"] * 6, ["the thing that was", "der die und ist", "le la et est", "el los y es", "これ は 日本語 です"] * 6)
    families = {la.family_of(n) for n in model.languages}
    assert families == {"family:germanic", "family:romance", "family:ja"}
    assert ("de", "en") in model.pairs and ("es", "fr") in model.pairs and ("de", "fr") not in model.pairs
    assert [model.predict(t)[0] for t in ("that was the thing", "die und der", "la et le", "los es el", "日本語 です", "", None, "12 !")] == ["en", "de", "fr", "es", "ja", "und", "und", "und"]


def test_quality_of_held_out_documents(spark, tables):
    rows = QUERIES["op4_quality_model"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(tables[0])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in tables[1]]
    assert sum(r.predicted == tables[1][r.doc_id] for r in held) >= 0.9 * len(held) > 0
    good = [r.score for r in held if tables[1][r.doc_id] == 1]
    bad = [r.score for r in held if tables[1][r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_of_every_case(spark):
    labels = spark.createDataFrame([(5, 1), (8, 1), (9, 0), (11, 0), (11, None), (77, 1), (None, 1), (5, 1)], "doc_id long, quality int")
    model = qm.train(cases.table(spark), labels)
    found = qm.score(cases.table(spark), model).collect()
    scores = {}
    for r in found:
        scores.setdefault(r.doc_id, []).append(r.score)
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in cases.ROWS)
    assert scores[1] == scores[2] and scores[5] == scores[6]
    blank = qm.train(cases.none(spark), labels)
    assert {r.score for r in qm.score(cases.table(spark), blank).collect()} == {0.5}
    assert qm.score(cases.none(spark), model).count() == 0


def test_fit_separates_and_ignores_order_of_equal_input():
    hasher = qm.Hasher()
    rows = [(hasher.buckets(t), y) for t, y in [("good clean text", 1), ("spam spam $$$", 0)] * 30]
    model = qm.fit(rows)
    assert model.score(hasher.buckets("clean text")) > 0.7 > 0.3 > model.score(hasher.buckets("spam $$$"))
    assert (qm.fit(rows).weights == model.weights).all()


def plain_ngrams(text, bits):
    """The quality model's n-grams of a text, one bucket each, from Python integers."""
    words = [zlib.crc32(t) for t in qm._TOKENS.findall((text or "").encode())]
    pairs = [1 if a == b else (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b + 0x7F4A7C15 & 0xFFFFFFFF) for a, b in zip(words, words[1:], strict=False)]
    mixed = [c * 0x85EBCA77 & 0xFFFFFFFF for c in words + pairs]
    return [(c ^ (c >> 15)) & ((1 << bits) - 1) for c in mixed]


def plain_ftrl(rows, bits):
    """FTRL-proximal with a dense vector for each row, weight by weight."""
    size = 1 << bits
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)  # the last one is the bias
    ones = sum(label for _, label in rows)
    share = {1: len(rows) / (2 * max(1, ones)), 0: len(rows) / (2 * max(1, len(rows) - ones))}

    def weight(i):
        l1 = 0.0 if i == size else qm.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((qm.BETA + n[i] ** 0.5) / qm.ALPHA + qm.L2)

    for _ in range(qm.EPOCHS):
        for text, label in rows:
            grams = plain_ngrams(text, bits)
            x = [qm.SCALE * grams.count(i) / max(1, len(grams)) for i in range(size)] + [1.0]
            weights = [weight(i) for i in range(size + 1)]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(x, weights, strict=True))))
            for i in range(size + 1):
                slope = (p - label) * share[label] * x[i]
                z[i] += slope - ((n[i] + slope**2) ** 0.5 - n[i] ** 0.5) / qm.ALPHA * weights[i]
                n[i] += slope**2
    return [weight(i) for i in range(size)], weight(size)


def test_quality_model_against_a_dense_one():
    rows = [(cases.prose(12 + i, i) + (" !!! $$$ click click" * (i % 2)), i % 2) for i in range(30)] + [("", 1), (None, 0)]
    hasher = qm.Hasher(6)
    for text, _ in rows:
        assert sorted(hasher.buckets(text).tolist()) == sorted(plain_ngrams(text, 6))
    model = qm.fit([(hasher.buckets(t), label) for t, label in rows], bits=6)
    weights, bias = plain_ftrl(rows, 6)
    assert np.allclose(model.weights, weights, atol=1e-6) and abs(model.bias - bias) < 1e-9 and any(weights)
    for text, _ in rows:
        grams = plain_ngrams(text, 6)
        total = bias + (qm.SCALE * sum(weights[g] for g in grams) / len(grams) if grams else 0.0)
        assert abs(model.score(hasher.buckets(text)) - 1 / (1 + np.exp(-total))) < 1e-6


def plain_votes(model, names, margin):
    """Winner of the one-versus-one comparisons among ``names``, and its mean certainty."""
    if len(names) == 1:
        return names[0], 1.0
    ranked = []
    for name in names:
        met = [(p, 1 if p[0] == name else -1) for p in model.pairs if name in p and set(p) <= set(names)]
        own = [sign * margin[p] for p, sign in met]
        wins = sum(m > 0 or (m == 0 and sign < 0) for m, (_, sign) in zip(own, met, strict=True))
        ranked.append((-wins, -sum(own), name, np.mean([1 / (1 + np.exp(-la.SHARPNESS * m)) for m in own])))
    best = min(ranked)
    return best[2], best[3]


def test_language_model_against_dense_votes(tables):
    """Predictions from whole vectors of trigram counts and a plain count of votes."""
    docs = list(tables[0].values())
    model = la.fit([d.lang for d in docs[:200]], [d.text for d in docs[:200]])
    assert len(model.languages) == 4 and len(model.pairs) == 3
    for text in [*(d.text for d in docs[200:260]), *(r[1] for r in cases.ROWS)]:
        if not text or not any(c.isalpha() for c in text):
            assert model.predict(text) == ("und", 0.0)
            continue
        data = b" " + b" ".join(text.encode().translate(la._LETTERS).split()) + b" "
        x = np.zeros(la.BUCKETS)
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            mixed = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
            x[((mixed ^ (mixed >> 15)) * 0x27D4EB2F & 0xFFFFFFFF) >> 17] += 1
        x = np.sqrt(x) / max(np.sqrt(x.sum()), 1e-12)
        margin = {pair: float(x @ model.weights[:, i]) + float(model.bias[i]) for i, pair in enumerate(model.pairs)}
        family, sure = plain_votes(model, sorted({la.family_of(n) for n in model.languages}), margin)
        name, surer = plain_votes(model, [n for n in model.languages if la.family_of(n) == family], margin)
        found, score = model.predict(text)
        assert found == name and abs(score - sure * surer) < 1e-4
