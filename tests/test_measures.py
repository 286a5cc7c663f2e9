"""Measures of runs against plain Python."""

import math
import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_trust import POLICY, records, tables  # noqa: F401
from veraline.operators import measures as m
from veraline.operators import trust
from veraline.operators.checks import ContractError


def test_surrogate(spark):
    rng = random.Random(4)
    rows = [(k % 3, k // 5, rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6), rng.choice([-1.5, 0.0, 2.0])) for k in range(300)]
    tokens = spark.createDataFrame(rows, "g int, c int, new double, old double, a double").withColumn("r", m.importance_ratio(F.col("new"), F.col("old")))
    got = {r.g: r for r in m.surrogate(tokens, ["g"], "c", "r", "a", longest=8, epsilon=0.3, world=2).collect()}
    for g in range(3):
        own = [(math.exp(n - o), a, c) for k, c, n, o, a in rows if k == g]
        loss = sum(-min(r * a, min(max(r, 0.7), 1.3) * a) for r, a, _ in own)
        n = len({c for *_, c in own})
        assert math.isclose(got[g].loss_sum, loss) and math.isclose(got[g].loss, loss * 2 / (n * 8)) and (got[g].token_count, got[g].completion_count) == (len(own), n)
        assert got[g].low_clipped == sum(r < 0.7 and a < 0 for r, a, _ in own) and got[g].high_clipped == sum(r > 1.3 and a > 0 for r, a, _ in own)
        assert math.isclose(got[g].ratio_sum, sum(r for r, *_ in own)) and got[g].ratio_min == min(r for r, *_ in own)
    shard = m.surrogate(tokens, [], "c", "r", "a", longest=8, completions=1000).first()
    assert math.isclose(shard.loss, shard.loss_sum / 8000)
    for bad in ({"epsilon": 0.0}, {"longest": 0}, {"world": 0}):
        with pytest.raises(ContractError):
            m.surrogate(tokens, [], "c", "r", "a", **{"longest": 8, **bad})


def test_quantiles_and_medians(spark):
    rng = random.Random(1)
    rows = [(("hot" if k % 3 else None), k % 4, rng.choice([rng.uniform(0, 9), 5.0])) for k in range(203)] + [("one", 0, 7.5), ("one", 1, None)]
    frame = spark.createDataFrame(rows, "arm string, turn int, v double")
    at = {"p50": Fraction(1, 2), "p95": Fraction(95, 100), "all": Fraction(1), "none": Fraction(0)}
    linear = {r.arm: r for r in m.quantiles(frame, ["arm"], "v", at).collect()}
    near = {r.arm: r for r in m.quantiles(frame, ["arm"], "v", at, nearest=True).collect()}
    rounds = {r.arm: r for r in m.round_medians(frame.where("arm is not null"), ["arm"], "turn", "v").collect()}
    for arm in ("hot", None, "one"):
        own = sorted(v for a, _, v in rows if a == arm and v is not None)
        for name, q in at.items():
            assert math.isclose(linear[arm][name], np.quantile(own, float(q))), (arm, name)
            assert near[arm][name] == own[int(q * (len(own) - 1))]
        if arm:
            medians = [statistics.median(x) for t in range(4) if (x := [v for a, k, v in rows if a == arm and k == t and v is not None])]
            assert math.isclose(rounds[arm].least_median, min(medians)) and math.isclose(rounds[arm].most_median, max(medians))


def test_phases_stages_parameters_differences(spark):
    rows = spark.createDataFrame([("a", 2.0, 500.0, 10, True), ("a", 4.0, 1500.0, 30, False), ("b", 1.0, 250.0, 5, True)], "arm string, sample double, total double, tokens int, updated boolean")
    got = {r.arm: r for r in m.phase_means(rows, ["arm"], ["sample"], "total", "tokens", unit=1000.0).collect()}
    assert (got["a"].sample_mean, got["a"].tokens, got["a"].tokens_per_s) == (3.0, 40, 20.0)
    assert {r.arm: (r.attempts, r.updates, r.skips, r.seconds) for r in m.stages(rows, ["arm"], F.col("updated"), "total").collect()} == {"a": (2, 1, 1, 2000.0), "b": (1, 1, 0, 250.0)}
    tied = spark.createDataFrame([("m", "embed", 1, 100), ("m", "head", 1, 100), ("m", "other", 2, 50), ("n", "x", 1, 7)], "model string, name string, storage int, size long")
    assert {r.model: r.total for r in m.parameter_totals(tied, "model", ["storage"], "size").collect()} == {"m": 150, "n": 7}
    pair = spark.createDataFrame([("k", 3.0, 0.0), ("k", 4.0, 4.0), ("z", 0.0, 0.0)], "k string, a double, b double")
    assert {r.k: (r.relative, r.most) for r in m.relative_difference(pair, ["k"], F.col("a"), F.col("b")).collect()} == {"k": (0.6, 3.0), "z": (0.0, 0.0)}
    one = spark.range(5).select(m.decayed(F.col("id") * 3, 10).alias("f"), m.cursor(F.col("id"), 1, 4, 7).alias("c")).collect()
    assert [round(r.f, 9) for r in one] == [1.0, 0.73, 0.46, 0.19, 0.1] and [r.c for r in one] == [1, 5, 2, 6, 3]


def test_split_errors_and_gates(spark, tables):  # noqa: F811
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] + [("other",)], "split string")
    errors = m.split_errors(rows, {"a": 1, "b": 1, "c": 2})
    got = {r.split: (r.n, r.target, round(r.error, 9)) for r in errors.collect()}
    assert got == {"a": (3, 0.25, 0.35), "b": (1, 0.25, -0.05), "c": (0, 0.5, -0.5), "other": (1, 0.0, 0.2)}
    assert math.isclose(m.largest_error(errors), 0.5)
    candidates = tables[0]
    first = candidates.limit(1)
    child = first.withColumn("lineage", F.col("lineage").withField("parents", F.array(F.struct(F.lit("p").alias("sample_id"), F.lit("0" * 64).alias("payload_sha256")))))
    for bad, rule in ((candidates.limit(0), "no_records"), (first.withColumn("split", F.lit("E")), "assigned_already"), (child, "not_a_root"), (first.unionByName(first), "repeated_sample_id")):
        with pytest.raises(ContractError, match=rule):
            trust.assign_splits(bad, POLICY)
