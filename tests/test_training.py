"""Training rows and the versioned budget."""

import numpy as np
from pyspark.sql import functions as F

from veraline.functions import predicates as P
from veraline.operators import budget, training
from veraline.operators.trust import canonical_sha256
from veraline.streaming.ledger import stream_ledger


def test_examples_and_batches(spark):
    made = training.copy_bit_examples(spark, 3)
    assert made.count() == 8 and training.example_violations(made, 5).count() == 0
    assert {r.rule for r in training.example_violations(made, 4).collect()} == {"prompt", "completion"}
    rows = spark.createDataFrame([("b", [5, 6], [7, 2, 9]), ("a", [5], [8])], training.EXAMPLE)
    got = training.supervised_batch(rows, 0, 2).orderBy("sample_id").collect()
    assert [r.input_ids for r in got] == [[5, 8, 0, 0, 0], [5, 6, 7, 2, 9]] and [r.group_id for r in got] == [0, 1]
    assert [r.completion_mask for r in got] == [[False, True, False, False, False], [False, False, True, True, False]]
    assert [r.attention_mask for r in got] == [[True, True, False, False, False], [True] * 5]


def test_row_functions(spark):
    frame = spark.createDataFrame([([False, True, True, False], [0.0, 2.0, 2.0], [1, 2], [1, 2])], "m array<boolean>, l array<double>, a array<int>, b array<int>")
    r = frame.select(
        training.position_ids("m").alias("p"), training.greedy_token(F.col("l")).alias("g"), training.exact_completion_reward(F.col("a"), F.col("b")).alias("same"), training.exact_completion_reward(F.col("a"), F.array(F.lit(1))).alias("other"),
        training.is_right_padded(F.array(F.lit(True), F.lit(True), F.lit(False))).alias("right"), training.is_right_padded(F.array(F.lit(True), F.lit(False), F.lit(True))).alias("hole"), P.is_causal_target(F.col("m"), F.array(*map(F.lit, (9, 1, 2, 9))), 3).alias("causal"), P.is_causal_target(F.col("m"), F.array(*map(F.lit, (0, 1, 3, 0))), 3).alias("outside"),
        P.is_log_probability(F.lit(0.1)).alias("lp"), P.is_binary_reward(F.lit(2)).alias("br"), P.is_finite(F.lit(float("nan"))).alias("fin"), P.is_count_map(F.create_map(F.lit("a"), F.lit(-1))).alias("cm"),
    ).first()
    assert (r.p, r.g, r.same, r.other) == ([0, 0, 1, 1], 1, 1, 0)
    assert (r.right, r.hole, r.causal, r.outside, r.lp, r.br, r.fin, r.cm) == (True, False, True, False, False, False, False, False)
    logits = [[0.0, 1.0], [2.0, 0.0], [0.0, 0.0]]
    got = spark.createDataFrame([(logits, [0, 1, 0], [False, True, True])], "l array<array<double>>, i array<int>, m array<boolean>").select(training.token_log_probs(F.col("l"), F.col("i"), F.col("m")).alias("x")).first().x
    soft = lambda v, k: v[k] - np.log(np.exp(v).sum())
    assert np.allclose(got, [0, soft(logits[0], 1), soft(logits[1], 0)])


def test_counts_and_shards(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", None), ("b", 1.0)], "g string, r double")
    assert sorted(map(tuple, training.reward_counts(rows, "g", "r").collect())) == [("a", 3, 1, 1, 1), ("b", 1, 1, 0, 0)]
    shards = spark.createDataFrame([(0, 6.0, 3), (1, 4.0, 2), (2, None, 0)], "s int, l double, t int")
    assert abs(training.shard_loss(shards, "l", "t").agg(F.avg("loss")).first()[0] - 10 / 5) < 1e-12
    assert tuple(training.task_means(rows, ["g"], ["r"]).where("g = 'a'").first()) == ("a", 0.5, 2)


def test_budget_rows(spark):
    states = spark.createDataFrame([(1, 10, 4, 2), (2, 5, 5, 1)], budget.STATE)
    assert budget.state_violations(states).count() == 0
    assert {r.rule for r in budget.state_violations(spark.createDataFrame([(1, 10, 11, -1), (1, 0, 0, 0)], budget.STATE)).collect()} == {"consumed_tokens", "version", "target_tokens", "repeated_stage"}
    wanted = spark.createDataFrame([(1, 9, "a" * 64), (2, 3, "b" * 64)], "stage long, candidate_tokens long, content_digest string")
    held = budget.reserve(wanted, states).cache()
    one = held.where("stage = 1").first()
    assert one.selected_tokens == 6 and one.truncated
    assert one.selection_id == canonical_sha256({"schema_version": 1, "target_tokens": 10, "consumed_tokens": 4, "counter_version": 2, "candidate_tokens": 9, "selected_tokens": 6, "content_digest": "a" * 64})
    assert budget.reservation_violations(held, states).count() == 0
    records, after = budget.committed(held, spark.createDataFrame([(1, "s1", "sft", True), (2, "s2", "sft", True)], "stage long, step_id string, objective string, executed boolean"), states)
    assert sorted(map(tuple, after.collect())) == [(1, 10, 10, 3), (2, 5, 5, 1)] and records.where("complete").count() == 2
    assert {r.rule for r in budget.reservation_violations(held.where("stage = 1"), after).collect()} == {"stale_consumed", "stale_version"}
    assert {r.rule for r in budget.reservation_violations(held.where("stage = 1").withColumn("selected_tokens", F.lit(5)), states).collect()} == {"canonical_prefix", "selection_id"}
    _, same = budget.committed(held, spark.createDataFrame([(1, "s", "sft", False)], "stage long, step_id string, objective string, executed boolean"), states)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, states.collect()))


def test_folds_agree():
    rng = np.random.default_rng(3)
    c, e = rng.integers(0, 9, 200), rng.random(200) < 0.7
    whole = budget.fold(c, e, None, 300, 5, 2)
    seen = np.concatenate([[2], whole["version"].to_numpy()[:-1]])
    assert whole.equals(budget.fold(c, e, seen, 300, 5, 2).astype(whole.dtypes.to_dict()))
    stale = budget.fold(c, e, np.where(np.arange(200) % 5 == 0, 77, -1), 300, 5, 2)
    assert (stale["status"][::5] == "stale").all() and stale["consumed_after"].iloc[-1] <= 300


def test_stream_restores_states_and_names_stale_attempts(spark, tmp_path):
    rows = [(1, 1, 5, True, 2), (1, 2, 5, True, 2), (1, 3, 9, True, 3), (2, 4, 4, False, -1), (2, 5, 4, True, -1)]
    schema = "stage long, event_id long, candidate long, executed boolean, planned_version long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 12, {1: (3, 2)})
    q = stream.writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: (r.selected, r.counted, r.consumed_before, r.consumed_after, r.version, r.status) for r in spark.table("restored").collect()}
    assert got == {1: (5, 5, 3, 8, 3, "counted"), 2: (4, 0, 8, 8, 3, "stale"), 3: (4, 4, 8, 12, 4, "counted"), 4: (4, 0, 0, 0, 0, "skipped"), 5: (4, 4, 0, 4, 1, "counted")}
