import math
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lectern.operators import quality, rank, tune

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_weight_search_looks_candidates_up_once(spark, monkeypatch):
    """The grid values are scored over one packed table: the ranker isn't planned for each of them."""
    seen = []
    base = rank.base_scores
    monkeypatch.setattr(rank, "base_scores", lambda c: seen.append(1) or base(c))
    got = tune.coordinate_ascent(spark, DATA, rounds=1, grids={"convergence": (0.0, 0.3, 1.0), "link_penalty": (0.5, 1.0)}).collect()
    assert len(seen) == 1 and [r["parameter"] for r in got] == ["convergence", "link_penalty"]


def test_packed_scores_are_the_rankers(spark):
    c, q, e, labels = tune._prepared(spark, DATA)
    fold = quality.interleaved(q.select("query_id"))
    w = rank.Weights()
    densities = (0.05, w.link_density)
    p = tune.materialize(tune.packed(c, q, e, labels, fold, densities), "packed")
    ws = [w, replace(w, convergence=1.0, hotness=0.0, cooccurrence=0.0), replace(w, inhibition_threshold=0.0, inhibition_strength=0.9, link_penalty=0.1, link_density=0.05, cooccurrence=5.0)]
    for part, number in (("train", 0), ("held", 1)):
        on = labels.join(fold.where(F.col("fold") == number).select("query_id"), "query_id", "left_semi")
        got = tune.mean_ndcg(p, ws, densities, part)
        assert len(set(got)) > 1
        for x, y in list(zip(ws, got))[number:]:
            assert math.isclose(tune._scores(c, q, e, x, on).agg(F.avg("ndcg")).first()[0], y, abs_tol=1e-12)
