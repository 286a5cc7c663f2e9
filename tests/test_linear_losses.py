"""Losses from hidden states against whole logits in numpy, for several blocks, slabs and chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veraline.operators.checks import ContractError
from veraline.operators.linear_losses import Transform, aligned_heads, linear_cross_entropy, linear_reverse_kl, loss_of, selected_positions

RNG = np.random.default_rng(6)
N, V, D, E = 70, 53, 12, 7
H, G = RNG.standard_normal((N, D)) * 3, RNG.standard_normal((N, E))
W, U = RNG.standard_normal((V, D)), RNG.standard_normal((V, E))
B, C = RNG.standard_normal(V), RNG.standard_normal(V)
Y = RNG.integers(0, V, N)


def log_softmax(x):
    m = x.max(axis=1, keepdims=True)
    return x - m - np.log(np.exp(x - m).sum(axis=1, keepdims=True))


def logits(h, w, b, t):
    x = (h @ w.T + b) * t.scale
    return (t.cap * np.tanh(x / t.cap) if t.cap else x) / t.temperature


def head(spark, w, b):
    return spark.createDataFrame([(i, x.tolist(), None if b is None else float(b[i])) for i, x in enumerate(w)], "token int, weight array<double>, bias double")


def rows(spark, y=Y):
    return spark.createDataFrame([(i, h.tolist(), g.tolist(), int(t)) for i, (h, g, t) in enumerate(zip(H, G, y))], "name long, hidden array<double>, teacher_hidden array<double>, target int")


@pytest.mark.parametrize(("block", "slabs", "chunk"), [(8192, 1, 2048), (16, 1, 5), (9, 4, 1), (33, 7, 3)])
def test_cross_entropy(spark, block, slabs, chunk):
    t = Transform(1.5, 4.0, 0.7)
    got = {r.name: r for r in linear_cross_entropy(rows(spark), head(spark, W, B), t, block, slabs, chunk).collect()}
    lp = log_softmax(logits(H, W, B, t))
    assert sorted(got) == list(range(N)) and got[3].teacher_hidden == G[3].tolist()
    for i in range(N):
        assert np.isclose(got[i].nll, -lp[i, Y[i]], rtol=1e-11) and np.isclose(got[i].entropy, -(np.exp(lp[i]) * lp[i]).sum(), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize(("block", "slabs", "chunk"), [(8192, 1, 2048), (16, 1, 5), (9, 4, 2)])
def test_reverse_kl(spark, block, slabs, chunk):
    s, t = Transform(cap=6.0), Transform(2.0, None, 1.3)
    heads = aligned_heads(head(spark, W, B), head(spark, U, C))
    got = {r.name: r for r in linear_reverse_kl(rows(spark), heads, s, t, block, slabs, chunk).collect()}
    p, q = log_softmax(logits(H, W, B, s)), log_softmax(logits(G, U, C, t))
    for i in range(N):
        assert np.isclose(got[i].kl, (np.exp(p[i]) * (p[i] - q[i])).sum(), rtol=1e-9) and np.isclose(got[i].entropy, -(np.exp(p[i]) * p[i]).sum(), rtol=1e-8, atol=1e-12)
    same = linear_reverse_kl(rows(spark).withColumn("teacher_hidden", F.col("hidden")), aligned_heads(head(spark, W, None), head(spark, W, None)))
    assert max(abs(r.kl) for r in same.collect()) < 1e-12


def test_large_logits_keep_their_differences(spark):
    one = spark.createDataFrame([(0, [1000.0], 1)], "name int, hidden array<double>, target int")
    w = head(spark, np.array([[1.0], [1.001], [-1.0]]), None)
    for chunk in (1, 2, 3):
        got = linear_cross_entropy(one, w, chunk=chunk).first()
        assert np.isclose(got.nll, np.log1p(np.exp(-1.0)), rtol=1e-9)


def test_sums_and_normalisers(spark):
    values = linear_cross_entropy(rows(spark), head(spark, W, B))
    own = loss_of(values, "nll").first()
    assert own.token_count == N and np.isclose(own.loss, own.loss_sum / N)
    shard = loss_of(values, "nll", world=4, tokens=1000).first()
    assert np.isclose(shard.loss, own.loss_sum * 4 / 1000) and shard.normalization_count == 1000
    none = loss_of(linear_cross_entropy(rows(spark).where("name < 0"), head(spark, W, B)), "nll").first()
    assert (none.loss, none.token_count, none.loss_sum, none.entropy_sum) == (0.0, 0, 0.0, 0.0)


def test_selected_positions(spark):
    schema = "id int, hidden array<array<double>>, labels array<int>, loss_mask array<boolean>"
    make = lambda *x: spark.createDataFrame(list(x), schema)
    states = [[1.0], [2.0], [3.0]]
    got = selected_positions(make((7, states, [-100, 5, 6], [False, True, True]), (8, states[:1], [4], [False]), (9, [], [], [])), "hidden", "labels", "loss_mask", "id").collect()
    assert sorted((r.id, r.position, r.hidden[0], r.target) for r in got) == [(7, 1, 1.0, 5), (7, 2, 2.0, 6)]
    for bad in ((1, states, [1, 2, 3], [True, False, False]), (1, states, [1, -100, 3], [False, True, False]), (1, states, [1, 2], [False, True, False])):
        with pytest.raises(ContractError):
            selected_positions(make(bad))


@pytest.mark.parametrize("bad", [{"scale": 0}, {"scale": float("nan")}, {"cap": -1.0}, {"cap": float("inf")}, {"temperature": True}, {"temperature": "1"}])
def test_transforms_are_checked(bad):
    with pytest.raises(ContractError):
        Transform(**bad)


def test_what_does_not_fit_raises(spark):
    with pytest.raises(Exception, match="no token"):
        linear_cross_entropy(rows(spark, np.full(N, V)), head(spark, W, B)).collect()
    with pytest.raises(Exception, match="don't fit"):
        linear_cross_entropy(rows(spark), head(spark, U, C)).collect()
    with pytest.raises(Exception, match="finite"):
        linear_cross_entropy(rows(spark), head(spark, W * 1e200, B), Transform(1e200, 1.0)).collect()
    with pytest.raises(ContractError, match="consecutive"):
        linear_cross_entropy(rows(spark), head(spark, W, B).where("token <> 5"))
    with pytest.raises(ContractError, match="repeated"):
        linear_cross_entropy(rows(spark), head(spark, W, B).union(head(spark, W, B).where("token = 5")))
    with pytest.raises(ContractError, match="no_teacher_token"):
        aligned_heads(head(spark, W, B), head(spark, U[:-1], C))
