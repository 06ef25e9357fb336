"""A fit that its rounds end before it has converged goes on."""

from __future__ import annotations

import numpy as np
import pytest

from lorekeep.operators import clustering, graph


@pytest.mark.parametrize("rounds", [1, 5])
def test_no_vector_is_nearer_to_another_centre(spark, rounds):
    """after `rounds` rounds of the seeds, vectors were left nearer to another centre."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(900, 8)))] + [(1000, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, vector array<double>").repartition(3)
    fit = clustering.kmeans(df, 6, seeds=(1, 2), rounds=rounds)
    some = fit.where("id < 1000")
    assert graph.misplaced(some, 8).count() == 0 and some.select("cluster").distinct().count() == 6 and fit.count() == 901
