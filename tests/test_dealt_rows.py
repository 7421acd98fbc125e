"""How rows are dealt out: small files to all cores, responses once, candidates of cells only where they can count."""

import numpy as np
import pyarrow as pa

from folioscope.operators import consensus
from folioscope.operators.vector_index import _best_of_cells
from folioscope.plans import catalogue


def test_parts_go_to_all_cores(spark, sf_dir):
    assert catalogue.queries()["principle_apply"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert catalogue._part_names(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_disagreements_deal_out_a_row_a_response(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, None, 1.0), (None, "c", None)], "item long, x string, y double")
    out = consensus.disagreements(rows, ["x", "y"])
    got = {(r["item"], r["field"], r["n_values"], r["agreed"], tuple(r["values"])) for r in out.collect()}
    assert got == {(1, "x", 2, False, ("a", "b")), (1, "y", 1, True, ("2.0",)), (2, "x", 0, False, ()), (2, "y", 1, True, ("1.0",)), (None, "x", 1, True, ("c",)), (None, "y", 0, False, ())}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition")  # fields become rows after the shuffle


def test_candidates_reach_their_query(spark):
    vectors = np.random.default_rng(0).standard_normal((50, 8))
    rows = pa.table({"name": pa.array(range(50)), "vector": pa.array(vectors.tolist())})
    asked = pa.table({"query_id": pa.array([0, 1]), "query_vector": pa.array(vectors[:2].tolist()), "least": pa.array([0.9999999, -2.0])})
    out = _best_of_cells(5)(rows, asked).to_pydict()
    found = sorted(zip(out["query_id"], out["name"]))
    assert [n for q, n in found if q == 0] == [0]
    assert len([n for q, n in found if q == 1]) == 5 and (1, 1) in found
