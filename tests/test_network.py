"""The small network's scores against a forward pass in NumPy, and its way to disk and into the total."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import cluster, decision, ml


def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (120, 74))
    return spark.createDataFrame([(i, v.tolist(), int(v[3] > 0)) for i, v in enumerate(x)], "id long, neural_vector array<double>, label int"), x


def forward(model, x):
    """Sigmoid hidden layers and a softmax; a layer's weights column by column, then its biases."""
    w, at, h = model.weights.toArray(), 0, x
    for i, (a, b) in enumerate(zip(ml.NETWORK[:-1], ml.NETWORK[1:])):
        z = h @ w[at : at + a * b].reshape(b, a, order="F").T + w[at + a * b : at + a * b + b]
        at += a * b + b
        h = 1 / (1 + np.exp(-z)) if i < len(ml.NETWORK) - 2 else np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    return h[:, 1] * 100


def test_scores_are_those_of_a_forward_pass(spark, tmp_path):
    df, x = rows(spark)
    model = ml.train_network(df, iterations=15)
    odd = spark.createDataFrame([(900, None, 1), (901, [0.0] * 73, 0), (902, [float("nan")] * 74, 0), (903, [None] * 74, 0)], df.schema)
    got = {r.id: r.neural_score for r in ml.neural_scores(df.unionAll(odd), model).collect()}
    assert np.allclose([got[i] for i in range(len(x))], forward(model, x), atol=1e-8)
    assert [got[i] for i in (900, 901, 902, 903)] == [None] * 4
    ml.save_network(model, str(tmp_path / "m"))
    again = ml.load_network(spark, str(tmp_path / "m"))
    assert {r.id: r.neural_score for r in ml.neural_scores(df, again).collect()} == {k: v for k, v in got.items() if k < 900}
    ml.save_network(None, str(tmp_path / "none"))
    assert ml.load_network(spark, str(tmp_path / "none")) is None
    assert ml.neural_scores(df, None).where("neural_score IS NOT NULL").count() == 0
    spark.createDataFrame([(True, [74, 2])], "is_trained boolean, layers array<int>").write.json(str(tmp_path / "other/contract"))
    with pytest.raises(ValueError, match="layers"):
        ml.load_network(spark, str(tmp_path / "other"))


def test_a_score_that_fails_weighs_nothing(spark):
    t = [F.lit(v) for v in (50.0, 20.0, 0.0, 0.0)]
    some, none = (spark.range(1).select(decision.total(*t, F.lit(True), F.lit(True), F.lit(n).cast("double")).alias("x")).first().x for n in (90.0, None))
    plain = spark.range(1).select(decision.total(*t, F.lit(True), F.lit(True)).alias("x")).first().x
    assert none == plain and some > plain


def test_vectors_of_other_lengths_never_meet(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [])], "seq long, vector array<double>")
    assert sorted((r.a, r.b) for r in cluster.similar_pairs(df, 0.9).collect()) == [(1, 2), (3, 4)]
