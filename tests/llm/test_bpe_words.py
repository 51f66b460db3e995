import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from urbanweave.llm import bpe_words as bw
from urbanweave.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bw.Encoder(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


SPECIAL = [
    None, "", " \n\t ", "'s't're'VE'm'll'd I'LL o'clock", "!!!!!!!! ????... --__--", "<|endoftext|>x<|STARTOFTEXT|> <|startoftext|>",
    "e<|endoftext|>́", "ΑΣ Σ ΑΣΑ", "İI ǅ KÅ", "\x1c\x85  \xa0x", "12 345 \xb2\xbc ٣", "a" * 500, "ab" * 900,
    "日本語 \U0001d518 \U0001f600\U0001f600", "ȺȾ ẞ", "ẹ́ x́", "가가 ౜՘", "</w> a</w>",
]


def words(rng):
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 20)))
    if kind < 0.7:
        return "".join(rng.choices("aeinrst'!", k=rng.randint(1, 30)))
    if kind < 0.9:
        return "".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x300, 0x58F)])) for _ in range(rng.randint(1, 10)))
    return "".join(chr(rng.randint(32, 0xD000)) for _ in range(rng.randint(1, 10)))


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(3)
    texts = SPECIAL + [" ".join(words(rng) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_every_token_is_proposed_or_merged_as_the_library_does(encoder, library):
    spelled = [t.removesuffix("</w>") for t in encoder.merges.tokens[512:49406]]
    levels = {s: b for b, s in enumerate(bw.byte_symbols())}
    texts = [bytes(levels[c] for c in t).decode(errors="ignore") for t in spelled]
    for text, ids, coded in zip(texts, encoder.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == coded.ids, text


def test_pair_check_agrees_with_merging(encoder):
    """Two tokens are compatible if and only if merging their symbols gives them again."""
    import numpy as np

    merges = encoder.merges
    rng, spelled = random.Random(5), {}

    def symbols(token):
        if token not in spelled:
            left, right = int(merges.left[token]), int(merges.right[token])
            spelled[token] = [token] if left < 0 else symbols(left) + symbols(right)
        return list(spelled[token])

    inner = [i for i, t in enumerate(merges.tokens) if 0 <= i < 49406 and not t.endswith("</w>") and merges.merge(symbols(i)) == [i]]
    whole = [i for i in range(49406) if merges.merge(symbols(i)) == [i]]
    pairs = [(rng.choice(inner[:3000]), rng.choice(whole[:6000])) for _ in range(5_000)]
    found = merges.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert found.any() and not found.all()
    for (a, b), good in zip(pairs, found.tolist(), strict=True):
        assert good == (merges.merge(symbols(a) + symbols(b)) == [a, b])


def test_merging_side_by_side_is_merging_alone(encoder):
    import numpy as np

    rng = random.Random(8)
    short = [encoder.merges.inner[np.frombuffer("".join(rng.choices("abeinrst", k=rng.randint(1, 64))).encode(), np.uint8)] for _ in range(2000)]
    for word, ids in zip(short, encoder.merges.merge_all(short), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == encoder.merges.merge(word.tolist())


def test_memory_of_words_is_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(bw, "REMEMBERED_WORDS", 5)
    for text in ("one two three four five six", "seven eight", "one two", "q" * 70):
        assert encoder.encode_all([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert "q" * 70 not in encoder.known


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bw.Merges(public_tokenizers.path("byte_bpe_50k.json"))


def check(spark, docs, library):
    out = bw.with_digests(bw.decode(bw.encode(docs, PATH), PATH))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((i, *expected(library, t)) for i, t in rows), key=key)


def test_cases(spark, library):
    check(spark, cases.table(spark), library)
    check(spark, cases.table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(SPECIAL)], 5), library)
    long = cases.prose(400_000, 9) + " " + "x" * 300_000
    check(spark, cases.table(spark, [(1, long, "en", "s", 1), (2, None, None, None, None)], 1), library)
    assert bw.encode(cases.none(spark), PATH).count() == 0


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_bpe_words"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {k: expected(library, t) for k, t in texts.items()} and len(rows) == len(texts)
