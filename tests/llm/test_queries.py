"""The registered corpus queries against their SQL, and the pipeline's stages against plain versions."""

import importlib.util
import os
import sys

import brute
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
spec = importlib.util.spec_from_file_location("compare", os.path.join(ROOT, "tools", "compare.py"))
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

from dawnchorus.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert compare.difference(got, compare.duck(sf_dir).execute(queries.SQL[name]).df()) is None


def test_every_row_has_a_result(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        if name not in ("op5_decontaminate", "pipeline"):
            assert query(spark, sf_dir).count() == n, name


def test_pipeline_decisions(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    good = corpus_pipeline.quality_rules_stage(spark, docs, sf_dir)
    before = [(r.doc_id, r.text) for r in good.collect()]
    assert all(not brute.quality_base(t)[-1] for _, t in before)
    single = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute.near(rows, 5, 80)})
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf_dir)
    dirty = {d for d, *_ in brute.contained(rows, items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in dirty)
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in clean.collect()} & {r.doc_id for r in rows} and 0 < len(rows) <= len(before)
    texts = dict(before)
    for r in rows:  # every kept document has its text, in which no secret is left
        assert r.text is not None and (r.text == texts[r.doc_id] or brute.base_spans(texts[r.doc_id]))
        assert not brute.base_spans(r.text)
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first) and not any(r.positions for r in rows[len(first):])
