import hashlib
import random
import threading
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanweave.llm import suffix_dedup as sd
from urbanweave.llm.queries import QUERIES

from . import cases


def brute(rows, length=50):
    """Per row: (doc_id, n_bytes, removed spans, kept bytes), by the letter of the contract."""
    first = {}
    keyed = [(sd._LAST if k is None else k, k, (t or "").encode()) for k, t in rows]
    for owner, _, data in keyed:
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            first[w] = min(first.get(w, owner), owner)
    out = []
    for owner, key, data in keyed:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < owner:
                gone[i : i + length] = b"\1" * length
        spans, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            at = gone.find(0, start)
            at = len(gone) if at < 0 else at
            spans.append((start, at))
        out.append((key, len(data), tuple(spans), bytes(b for b, g in zip(data, gone) if not g)))
    return Counter(out)


def found(docs, **more):
    rows = sd.dedup(docs, **more).collect()
    return Counter((r.doc_id, r.n_bytes, tuple(zip(r.starts, r.ends)), bytes(r.kept)) for r in rows)


@pytest.mark.parametrize("seed", range(40))
def test_windows_of_strings_against_brute_force(seed):
    rng = random.Random(seed)
    length = rng.choice([5, 7, 8, 12, 50])
    base = bytes(rng.choices(b"abcd"[: rng.choice([1, 2, 4])], k=200))
    strings = set()
    for _ in range(rng.randint(1, 12)):
        at = rng.randint(0, 140)
        strings.add(base[at : at + length + rng.randint(0, 30)] if rng.random() < 0.6 else bytes(rng.choices(b"ab\0\xffc", k=length + rng.randint(0, 20))))
    strings = [s for s in strings if len(s) >= length]
    owners = [rng.randint(0, 9) for _ in strings]
    lowest = {}
    for s, o in zip(strings, owners):
        for i in range(len(s) - length + 1):
            lowest[s[i : i + length]] = min(lowest.get(s[i : i + length], o), o)
    got = sd.shared_window_owners(strings, owners, length) if strings else []
    assert [g.tolist() for g in got] == [[lowest[s[i : i + length]] for i in range(len(s) - length + 1)] for s in strings]


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=3000)) + b"a" * 300 + bytes(rng.choices(range(256), k=3000)), np.uint8)
    starts, sizes = np.array([0, 1000, 1000, 1040]), np.array([1000, 0, 40, len(data) - 1040])
    runs = [sd.anchors(data, starts, sizes, chunk=c) for c in (1 << 17, 64, 500)]
    assert all((a == b).all() for other in runs[1:] for a, b in zip(runs[0], other))
    first, last, doc, keys = runs[0]
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    valid = [i for s, z in zip(starts.tolist(), sizes.tolist()) for i in range(s, s + z - 49)]
    assert covered.tolist() == valid
    by_window = {}
    for a, b, k in zip(first.tolist(), last.tolist(), keys.tolist()):
        for i in range(a, b + 1):
            assert by_window.setdefault(data[i : i + 50].tobytes(), k) == k


def test_every_case(spark):
    rows = [(r[0], r[1]) for r in cases.ROWS]
    assert found(cases.table(spark)) == brute(rows)


@pytest.mark.parametrize("most,size", [(4096, 4_000_000), (2, 3000)])
def test_passages_copies_and_runs(spark, monkeypatch, most, size):
    # Small blocks and a small split make the windows of common passages meet one by one.
    monkeypatch.setattr(sd, "MOST_STRINGS", most)
    monkeypatch.setattr(sd, "BLOCK_BYTES", size)
    rng = random.Random(7)
    passage, line = cases.prose(30, 99), "é" + cases.prose(14, 98)
    rows = []
    for i in range(60):
        text = cases.prose(rng.randint(1, 60), i)
        if i % 3 == 0:
            text += " " + passage + " " + cases.prose(5, i + 500)
        if i % 4 == 0:
            text = line + "\n" + text
        rows.append((i, text))
    rows += [(100, rows[5][1]), (101, rows[5][1] + passage[:49]), (-1, passage[10:61]), (102, "a" * 500), (103, "a" * 60 + "b" + "a" * 49), (104, "\0" * 120), (90, "\0" * 51)]
    rows += [(None, passage), (60, passage * 2), (60, passage * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == brute(rows)


def test_other_lengths(spark):
    rows = [(i, cases.prose(8, i % 4)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, length=20, mer=9) == brute(rows, 20)


def test_empty_table(spark):
    assert sd.dedup(cases.none(spark)).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_suffix_dedup"](spark, sf).collect())
    want = Counter((k, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, spans, kept in brute(rows))
    assert got == want


def test_copies_take_little_disk(spark):
    # Copies share every window, in other blocks: their strings are not sent, and no round leaves its shuffle behind.
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefghijklmnop", k=20_000)) for _ in range(100)]
    rows = [(100 * copy + i, text) for copy in range(6) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, F.floor(F.col("doc_id") / 100))
    disk = lambda: sum(f.stat().st_size for top in (*folders(spark), Path(spark.conf.get("spark.checkpoint.dir"))) for f in top.rglob("*") if f.is_file())
    before, most, over = disk(), 0, threading.Event()

    def watch():
        nonlocal most
        while not over.wait(0.02):
            try:
                most = max(most, disk())
            except FileNotFoundError:  # a file went meanwhile
                pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        kept = sd.dedup(docs).agg(F.sum(F.length("kept")).alias("n")).first().n
    finally:
        over.set()
        watcher.join()
    assert kept == sum(len(t) for t in texts)
    assert most - before < 3 * sum(len(t) for _, t in rows)


def folders(spark):
    return [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]


def test_packed_numbers():
    rng = np.random.default_rng(5)
    for values in (rng.integers(-5, 5, 40), np.array([sd._LAST, -7, 3]), np.array([4])):
        assert sd._unpack_numbers(sd._pack_numbers(values.astype(np.int64))).tolist() == values.tolist()


def test_fingerprints_depend_on_the_string_alone():
    rng = random.Random(4)
    data = bytes(rng.choices(b"ab", k=4000))
    spots = [(rng.randint(0, 3900), rng.randint(8, 76)) for _ in range(3000)] + [(4000 - n, n) for n in range(8, 77)]
    prints = sd.fingerprints(np.frombuffer(data, np.uint8), *(np.array(x) for x in zip(*spots)))
    by_string = {}
    for (a, n), h in zip(spots, prints.tolist()):
        assert by_string.setdefault(data[a : a + n], h) == h
    assert len(set(by_string.values())) == len(by_string)
