"""The registered queries against their oracles, and the pipeline against a brute-force version of its stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerflow.llm import lang_id, toxicity
from ledgerflow.llm.common import crc_mod
from ledgerflow.llm.queries import ORACLES, QUERIES
from ledgerflow.plans.checks import compare, duck

from . import test_decontaminate, test_mixing, test_order_minhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    df = QUERIES[name](spark, SF)
    cur = duck(SF).execute(ORACLES[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_oracle_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pipeline_against_brute_force(spark):
    out = cp.run(spark, SF).collect()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = crc_mod(F.col("doc_id"), 3) != 1
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels, learn).where("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in toxic]
    left = spark.createDataFrame(rows, docs.schema)
    known = {r.doc_id for r in lang_id.predict_language(left, learn).where("lang_pred <> 'und' and score >= 0.5").collect()}
    rows = [r for r in rows if r.doc_id in known]
    first = {i for i, c in test_order_minhash.classes([(r.doc_id, r.text) for r in rows]) if i == c}
    rows = [r for r in rows if str(r.doc_id) in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in rows], items)}
    rows = [tuple(r) for r in rows if r.doc_id not in dirty]
    assert len(rows) > 100 and dirty
    taken, goal = test_mixing.check(rows, out)
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)


def test_stages_keep_the_columns(spark, clashing):
    docs = clashing
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()
