import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from urbanweave.llm import collocations as co

SMALL = co.Sizes(grams=300, waiting=40, words=60, sample=7, range_samples=3)


def counted(rows):
    """Brute force: occurrences of phrases by language."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for i in range(len(words)):
                for size in (1, 2, 3):
                    if i + size <= len(words):
                        f["und" if lang is None else lang][tuple(words[i : i + size])] += 1
            n["und" if lang is None else lang] += len(words)
    return f, n


def expected(rows, fewest=10, top=2000, share=50):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= fewest}
        inside = Counter()
        for q, b in candidates.items():
            for part in {q[i : i + 2] for i in range(len(q) - 2 + 1) if len(q) > 2}:
                inside[part] = max(inside[part], b)
        for p, a in candidates.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def made(seed, documents=60, words=14):
    rng = random.Random(seed)
    vocabulary = [w for w in ("alpha", "BETA", "b\x01", "b", "été", "日本", "x-y", "'s", "Ω", "c\x1fd", "\x00", "of", "the", "of-the") for _ in range(rng.randint(1, 4))]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "!", "\r\n"]) for _ in range(rng.randint(0, words * 6)))
    return [(i, text(), rng.choice(["en", "en", "en", "de", None]), "s", 1) for i in range(documents)]


@pytest.mark.parametrize("sizes", [co.Sizes(), SMALL, co.Sizes(grams=5, waiting=3, words=4, sample=1, range_samples=1)])
def test_against_counting(spark, sizes):
    rows = made(1)
    assert rows_of(co.collocations(cases.table(spark, rows), sizes=sizes)) == expected(rows)
    assert rows_of(co.collocations(cases.table(spark, rows), fewest=4, top=5, share=90, sizes=sizes)) == expected(rows, 4, 5, 90)


def test_all_counts(spark):
    rows = made(2)
    f, n = counted(rows)
    found = {(r.lang, r.phrase, r.size): r.f for r in co.phrase_counts(cases.table(spark, rows), 1, SMALL).collect()}
    assert found == {(lang, " ".join(p), len(p)): a for lang, c in f.items() for p, a in c.items()} | {(lang, "", 0): a for lang, a in n.items()}


def test_cases(spark):
    rows = [*cases.ROWS, *[(50 + i, "Same words again and again, same words; SAME words", "en", "s", 1) for i in range(30)]]
    assert rows_of(co.collocations(cases.table(spark, rows))) == expected(rows)
    assert rows_of(co.collocations(cases.table(spark, cases.ROWS), fewest=2, sizes=co.Sizes(grams=9000, waiting=4000, words=3000, sample=50, range_samples=20))) == expected(cases.ROWS, 2)
    assert rows_of(co.collocations(cases.none(spark))) == []


def test_a_pair_in_every_text_is_spread(spark):
    rows = [(i, f"hot pair w{i % 40} and w{i % 7} hot pair", "en", "s", 1) for i in range(200)]
    told = co.shards(cases.table(spark, rows), SMALL)
    bounds = co._bounds(told, 1)
    assert sum(b.startswith(b"hot pair ") for _, b in bounds) > 1
    assert rows_of(co.collocations(cases.table(spark, rows), sizes=SMALL)) == expected(rows)


def test_counts_beyond_64_bits(spark):
    many = 5_000_000_000_000
    weights = spark.createDataFrame([("en", "a b", 2, many), ("en", "a", 1, many + 7), ("en", "b", 1, many * 3)], "lang string, phrase string, size int, f long")
    row = co.compose(weights.where("size > 1"), weights).first()
    assert (row.a, row.l, row.r, row.score) == (many, many + 7, many * 3, 1_000_000 * many * many // ((many + 7) * many * 3))


def test_automaton_keeps_paths_and_shares_tails():
    rng = np.random.default_rng(3)
    words = [b"", *(f"w{i:03}".encode() for i in range(50))]
    grams = np.unique(rng.integers(1, 51, (4000, 3)) % [51, 51, 3], axis=0)
    columns, weights = [c.copy() for c in grams.T], np.ones(len(grams), np.int64)
    built = co.Transducer.build(words, columns, weights)
    back = co.Transducer.unpacked(built.packed())
    paths, found = back.paths()
    assert back.words == words and all((a == b).all() for a, b in zip(paths, columns, strict=True)) and (found == weights).all()
    assert len(built.third) < 20 < len(built.second)
    again, summed, total = co.Transducer.union([built.packed()] * 3)
    assert again == words[: len(again)] or set(again) <= set(words)
    assert (total == 3).all() and len(total) == len(weights)


def test_large_vocabularies_are_packed_in_two_steps():
    columns = [np.array([1 << 22, 5, 5, 5]), np.array([7, 9, 1 << 23, 9]), np.array([1, 0, 3, 0])]
    grams, weights = co._summed(columns, np.array([1, 2, 3, 4]), 1 << 24)
    assert list(zip(*[c.tolist() for c in grams], weights.tolist(), strict=True)) == [(5, 9, 0, 6), (5, 1 << 23, 3, 3), (1 << 22, 7, 1, 1)]


def test_clashing_columns_are_not_read(spark):
    docs = cases.table(spark, made(3, 20)).withColumns({c: F.lit("clash") for c in ("phrase", "number", "grams", "part", "k", "f")})
    assert rows_of(co.collocations(docs)) == expected(made(3, 20))
