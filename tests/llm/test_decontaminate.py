import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urbanweave.llm import decontaminate as de
from urbanweave.llm.queries import QUERIES

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def brute(rows, items, window=10):
    out = []
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).update(set() if item is None else {str(item)})
    for key, text in rows:
        w, hit, found = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((key, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return Counter(out)


PASSAGE = cases.prose(25, 77)
ITEMS = [
    (1, PASSAGE),
    (2, "Short: item ONE!"),
    (10, cases.prose(12, 78)),
    (11, None),
    (12, "  --- "),
    (13, "one"),
    (14, "ünï 日本語 zwölf"),
    (15, PASSAGE),
    (16, "same words " * 9),
    (None, cases.prose(11, 79)),
]
ROWS = [(r[0], r[1]) for r in cases.ROWS] + [
    (40, f"before {PASSAGE.upper().replace(' ', ', ')} after"),
    (41, " ".join(PASSAGE.split()[3:12])),
    (42, " ".join(PASSAGE.split()[3:13])),
    (43, "a short-item; one, short item two"),
    (44, "é " + PASSAGE + " ünï日本語 ünï 日本語 zwölf"),
    (45, "shortitem one xone onex"),
    (46, cases.prose(11, 79)),
    (40, PASSAGE),
]


@pytest.mark.parametrize("most", [de.MAX_WINDOWS, 4])
def test_every_case(spark, most):
    docs = cases.table(spark, [(k, t, None, None, None) for k, t in ROWS])
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit("clash"))
    found = de.with_counts(de.contamination(docs, items, max_windows=most)).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(sorted(r["items"])), r.contaminated) for r in found)
    assert got == brute(ROWS, ITEMS)
    clean = de.keep_clean(docs, items, max_windows=most)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(k) for (k, *_, hit), n in brute(ROWS, ITEMS).items() for _ in range(n) if not hit)


def test_offsets_lead_back_to_the_original(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for row in de.contamination(docs.where("doc_id in (40, 43, 44)"), items).collect():
        text = dict(ROWS[:-1])[row.doc_id] if row.n_words > 25 or row.doc_id != 40 else PASSAGE
        for span in row.spans:
            assert words_of(text[span.start : span.end]) == words_of(text)[span.first_word : span.end_word]


def test_empty_tables(spark):
    docs, items = cases.table(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    nothing = items.limit(0)
    assert de.contamination(cases.none(spark), items).count() == 0
    assert de.with_counts(de.contamination(docs, nothing)).where("contaminated").count() == 0
    assert de.keep_clean(docs, nothing).count() == docs.count()


@pytest.mark.parametrize("most", [de.MAX_WINDOWS, 4])
def test_the_pipeline_stage_counts_items_without_id(spark, tmp_path, most, monkeypatch):
    import corpus_pipeline

    keep = de.keep_clean
    monkeypatch.setattr(de, "keep_clean", lambda *given, **named: keep(*given, max_windows=most, **named))
    docs = cases.table(spark, [(k, t, None, None, None) for k, t in ROWS])
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_free(spark, docs, str(tmp_path))
    named = [(-1 if item is None else item, text) for item, text in ITEMS]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(k) for (k, *_, hit), n in brute(ROWS, named).items() for _ in range(n) if not hit)
    assert 46 not in {r.doc_id for r in clean.collect()}


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = Counter(tuple(r) for r in QUERIES["op9_decontamination"](spark, sf).collect())
    assert got == Counter((k, n, h, i, hashlib.sha256(s.encode()).hexdigest(), c) for k, n, h, i, s, c in brute(rows, items))
