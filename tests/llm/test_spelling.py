import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from urbanweave.llm import spelling

RUN = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]]


def words_of(rows, slips, shortest=6, fewest=5):
    """Brute force: characters one by one."""
    counted = Counter()
    for key, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if c in RUN:
                run += c.lower() if c < "\x80" else c
                continue
            if run and slips:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if h % slips == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counted[run] += 1
            run = ""
    return {w: n for w, n in counted.items() if n >= fewest}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, ratio=5):
    near = {w: [u for u in counts if one_apart(w, u)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda u: (-counts[u], u), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)


def made_words(seed, number=260, letters="abcé"):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(number)}
    words |= {w[:3] + "z" + w[3:] for w in list(words)[:60]} | {w + "s" for w in list(words)[:60]} | {"x" + w for w in list(words)[:60]}
    return {w: rng.choice([5, 6, 7, 30, 160, 900, 900]) for w in sorted(words)}


@pytest.mark.parametrize(("seed", "most"), [(1, 1024), (2, 20), (3, 1)])
def test_near_words_against_all_pairs(spark, seed, most):
    """Groups whole and parted down to one free letter."""
    counts = made_words(seed)
    assert rows(spelling.variants(vocabulary(spark, counts), most=most)) == expected(counts)


def test_pairs_come_once(spark):
    counts = made_words(4, 120, "ab")
    found = spelling.near_words(vocabulary(spark, counts), most=8)
    pairs = [(r.word, r.near) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counts for b in counts if one_apart(a, b)}


def test_short_words_and_long_ones(spark):
    rng = random.Random(6)
    counts = {w: rng.randint(1, 50) for w in {"".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(60)}}
    long = "".join(rng.choices("abcdef", k=3000))
    counts |= {long: 500, long[:1500] + long[1501:]: 9, long[:-1] + "z": 8, "q" + long: 100, long[::-1]: 7}
    assert rows(spelling.variants(vocabulary(spark, counts), ratio=2, shortest=1, most=4)) == expected(counts, 2)


def test_index_of_more_than_one_lane():
    counts = made_words(7, 200, "ab")
    words = [w.encode("latin-1") for w in counts if len(w) in (7, 8)]
    a, b = spelling.PositionIndex(words, np.zeros(len(words), np.int64)).near(np.full(len(words), 7))
    found = sorted((words[i], words[j]) for i, j in zip(a, b, strict=True))
    assert len(words) > 64 and found == sorted((v, w) for v in words for w in words if one_apart(v, w) and not len(v) == len(w) == 8)


def test_words_of_all_cases(spark):
    extra = [(100 + i, "École ÉCOLE naïveté×÷naïveté STRASSENBAHN straßenbahn ŒUVRES İstanbul " + "W" * 20 * i, "fr", "s", 1) for i in range(12)]
    for slips in (None, 3, 199):
        docs = [*cases.ROWS, *extra]
        found = {r.word: r.n for r in spelling.count_words(cases.table(spark, docs), slips=slips, held_words=50).collect()}
        assert found == words_of(docs, slips) and found
    assert rows(spelling.variants(spelling.count_words(cases.table(spark, docs), slips=3))) == expected(words_of(docs, 3))
    assert rows(spelling.variants(spelling.count_words(cases.none(spark)))) == []


def test_slips_lead_back_to_their_word(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the Spellings of Watermelons vary").alias("text"))
    found = {r.word: r for r in spelling.variants(spelling.count_words(docs, slips=29), ratio=5).collect()}
    assert {w for w, r in found.items() if r.form is None} == {"spellings", "watermelons"}
    assert len(found) > 8 and all(one_apart(w, r.root) for w, r in found.items() if r.form)


def test_a_form_must_be_more_frequent(spark):
    with pytest.raises(ValueError, match="more frequent"):
        spelling.variants(vocabulary(spark, {"abcdef": 5}), ratio=1)
