from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from urbanweave.llm import piece_sampling as ps
from urbanweave.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "  a\nb▁c ", "▁", "日本語 𝔘 \t x", " " * 40 + "q", "\n\n", "x" * 3000, "nul \0 nul\0", "The house of the rising sun.", "\0", "é̈ ﷺ"]


@pytest.fixture(scope="module")
def vocabulary():
    return ps.Vocabulary(PATH)


def spell(vocabulary, ids):
    return b"".join(vocabulary.spelled[i] for i in ids)[1:].decode("utf-8")


def split(ids, counts):
    bounds = np.r_[0, np.cumsum(counts)]
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def segmentations(pieces, text):
    """All ways to write ``text`` as pieces."""
    if not text:
        return [()]
    return [(text[:n], *rest) for n in range(1, len(text) + 1) if text[:n] in pieces for rest in segmentations(pieces, text[n:])]


def test_draws_follow_the_weights_of_whole_segmentations(vocabulary):
    alpha = 0.2
    sampler = ps.Sampler(vocabulary, alpha, seed=3)
    n = 40_000
    drawn = Counter(map(tuple, split(*sampler.sample([ps.row_key(i) for i in range(n)], ["then"] * n))))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    number = {model.id_to_piece(i).replace("▁", " "): i for i in range(model.vocab_size())}
    weight = {}
    for way in segmentations(vocabulary.pieces, " then"):
        ids = tuple(number[p] for p in way)
        weight[ids] = np.prod([(1 / (i + ps.OFFSET)) ** alpha for i in ids]) / sum(1 / (np.arange(32000) + ps.OFFSET)) ** (alpha * len(ids))
    total = sum(weight.values())
    assert set(drawn) <= set(weight) and len(weight) > 8
    for ids, w in weight.items():
        share = w / total
        assert abs(drawn[ids] / n - share) < 5 * np.sqrt(share / n) + 1e-4


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_lossless(vocabulary, alpha):
    sampler = ps.Sampler(vocabulary, alpha)
    for ids, text in zip(split(*sampler.sample(list(range(len(TEXTS))), TEXTS)), TEXTS):
        assert spell(vocabulary, ids) == text


def test_same_pieces_however_rows_are_batched(vocabulary):
    keys = [ps.row_key(i) for i in range(len(TEXTS))]
    whole = split(*ps.Sampler(vocabulary, 0.1, 9).sample(keys, TEXTS))
    one = ps.Sampler(vocabulary, 0.1, 9)
    back = [split(*one.sample([k], [t]))[0] for k, t in reversed(list(zip(keys, TEXTS)))][::-1]
    assert whole == back
    assert whole != split(*ps.Sampler(vocabulary, 0.1, 10).sample(keys, TEXTS))


def test_lattices_are_dropped_when_full(vocabulary, monkeypatch):
    monkeypatch.setattr(ps, "_MOST_EDGES", 5)
    sampler = ps.Sampler(vocabulary)
    for text in ("one two three", "four five", "one two three"):
        assert spell(vocabulary, split(*sampler.sample([1], [text]))[0]) == text


def test_operator_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no key", "x"), (3, None, "x"), (2, "a", "x"), (2, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    back = ps.decode(ps.encode(docs, PATH, 0.1, 1), PATH)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1]) for r in rows)
    assert back.where("text is null and ids is not null").count() == 0
    same = [tuple(r.ids) for r in back.where("doc_id = 2").collect()]
    assert len(set(same)) == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ps.decode(ps.encode(none, PATH), PATH).count() == 0


def test_query_is_lossless_and_agrees_with_single_documents(spark, vocabulary):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op6_piece_sampling"](spark, sf).collect()}
    assert found.keys() == docs.keys() and all(r.lossless for r in found.values())
    alone = [(k, split(*ps.Sampler(vocabulary).sample([ps.row_key(k)], [t]))[0]) for k, t in list(docs.items())[:20]]
    hashed = spark.createDataFrame(alone, "k long, ids array<int>").select("k", F.size("ids").alias("n"), F.xxhash64("ids").alias("h"))
    assert all((found[r.k].n_pieces, found[r.k].ids_hash) == (r.n, r.h) for r in hashed.collect())


def test_trie_has_rows_only_for_states_with_several_steps():
    ids = {piece: i for i, piece in enumerate(["a", "ab", "abc", "abd", "xyz", "xéz", "x𝄞", "é", "zzzz"])}
    trie = ps.Trie(ids)
    assert len(trie.table) == 3  # the start, "ab" and "x", of 17 states
    narrow = type("Narrow", (ps.Trie,), {"COLUMNS": 2})(ids)  # most steps are looked up in the list
    text = "abcabd xyzzzzz x𝄞xéz éq ab\U0010ffff"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    brute = sorted((i, j, ids[text[i:j]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in ids)
    for each in (trie, narrow):
        start, end, number = each.matches(codes)
        assert sorted(zip(start.tolist(), end.tolist(), number.tolist(), strict=True)) == brute
        assert (np.diff(end) >= 0).all()


def test_workers_keep_no_sampler_after_a_task(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    assert ps.encode(docs, ps.default_model(spark)).count() == 20

    def left(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ in ("Vocabulary", "Sampler") for x in gc.get_objects())]})

    assert {r.n for r in spark.range(64).repartition(32).mapInArrow(left, "n long").collect()} == {0}
