"""The pipeline against plain Python, stage by stage, and the entry point without the package."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import public_tokenizers

from urbanweave.llm import language_id, parity_join, piece_sampling
from urbanweave.llm.common import FRUGAL, documents
from urbanweave.runtime import settle

from . import cases
from .test_decontaminate import brute as contaminated
from .test_parity_join import brute as components
from .test_secret_ledger import brute as base_secrets

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "secret_scan", "piece_encoding"]
    docs = documents(spark, SF)
    columns = docs.columns
    model = language_id.train(docs)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(settle(stage(spark, steps[-1], SF)))
    given, known, single, clean, safe, coded = map(rows_of, steps)
    assert all(step.columns == columns for step in steps[:-1])

    assert set(known) == {k for k, r in given.items() if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= 0.5}
    rows = [(k, r.text) for k, r in known.items()]
    assert set(single) == {low for (_, _, low) in components(rows, parity_join.Rule(5, 80, 100))}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(k, r.text) for k, r in single.items()]
    assert set(clean) == {k for (k, *_, hit) in contaminated(rows, items) if not hit}
    assert set(safe) == set(clean)
    for key, row in clean.items():
        after = safe[key]
        assert (after.text == row.text) == (base_secrets(row.text)[0] == "") or "[SECRET]" in after.text
        assert after.n_chars == (row.n_chars if after.text == row.text else len(after.text))
        assert (after.lang, after.source) == (row.lang, row.source)
    assert set(coded) == set(safe) and all(r.lossless and r.n_pieces == len(r.ids) for r in coded.values())
    spelled = piece_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")).spelled
    assert all(b"".join(spelled[i] for i in r.ids)[1:].decode() == safe[k].text for k, r in coded.items())
    final = rows_of(corpus_pipeline.run(spark, SF))
    assert {k: r.ids for k, r in final.items()} == {k: r.ids for k, r in coded.items()}


def test_stages_take_every_case(spark):
    docs = cases.table(spark, [*cases.ROWS, *[(200 + i, f"{cases.prose(40, 300 + i)} token=abcdef{i}", "en", "s", 1) for i in range(20)]])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "piece_encoding":
            assert out.columns == docs.columns
        docs = settle(out)
        if name == "secret_scan":
            assert docs.where("text like '%token=%'").count() == 0 < docs.where("text like '% [SECRET]' and n_chars = length(text)").count()
    kept = {r.doc_id for r in docs.collect()}
    assert not kept & {1, 2, 3, 6} and {5, 7, 8, 9} <= kept
    none = cases.none(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """Text of 30 MB leaves for a worker in batches of 4 MB, unless the session has a bound of its own."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('x', 10000) as text", "'en' as lang", "'s' as source", "10000L as n_chars")
    before = {name: spark.conf.get(name, None) for name in FRUGAL}
    stages = dict(corpus_pipeline.STAGES)
    try:
        for given, most in ((None, 4 << 20), ("1m", 1 << 20)):
            for name in FRUGAL:
                spark.conf.unset(name)
            if given:
                spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", given)
            stages["secret_scan"](spark, docs.limit(1), SF)
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < most + 20_000
            assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_entry_without_the_package(tmp_path):
    """As the driver does: the two folders and the pipeline are gone, and the rest still imports."""
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, env={**os.environ, "PYTHONPATH": str(here)})
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names}


def test_statements_give_the_rows_of_their_queries(spark):
    from checks.compare import difference, open_tables
    from urbanweave.llm.oracles import ORACLES
    from urbanweave.llm.queries import QUERIES

    assert ORACLES.keys() <= QUERIES.keys()
    tables = open_tables(SF)
    for name, statement in ORACLES.items():
        assert difference(QUERIES[name](spark, SF), tables, statement) is None, name
