"""Loss-token accounting: masks, canonical budgets, group advantages, divergences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.functions.text import let, log_softmax
from veraline.operators.ordering import keyed_totals, running_totals


def first_eos_mask(ids: Column, eos: int, include: bool = True) -> Column:
    """1 up to the first end token (with it, if include), 0 after."""
    at = F.array_position(ids, eos)
    last = F.when(at == 0, F.size(ids)).otherwise(at if include else at - 1)
    return F.transform(ids, lambda _, i: F.when(i < last, 1).otherwise(0))


def budget_prefix(rows: DataFrame, order: list[str], tokens: str, budget: int) -> DataFrame:
    """rows and `kept`: how many of each row's tokens fall in the first `budget` of the canonical order.

    Totals before each row come from range partitions and one total per partition.
    """
    placed = running_totals(rows, order, {"tokens_before": tokens}, "budget")
    return placed.withColumn("kept", F.greatest(F.lit(0).cast("long"), F.least(F.col(tokens).cast("long"), F.lit(budget) - F.col("tokens_before")))).drop("position", "tokens_before")


def ledger(attempts: DataFrame, stage: str, order: list[str], candidate: str, executed: str, target: int) -> DataFrame:
    """attempts with consumed_after and counted: skipped attempts take nothing, the last takes what is left.

    A stage of any size is summed over range partitions, not in one window.
    """
    run = keyed_totals(attempts.withColumn("vl_c", F.when(F.col(executed), F.col(candidate)).otherwise(0).cast("long")), stage, order, {"vl_sum": "vl_c"})
    after = F.least(F.col("vl_sum") + F.col("vl_c"), F.lit(target)).cast("long")
    before = F.least(F.col("vl_sum"), F.lit(target)).cast("long")
    return run.withColumn("consumed_after", after).withColumn("counted", after - before).drop("vl_c", "vl_sum", "position")


def interpolate(points: DataFrame, curve: str, x: str, y: str, steps: int) -> DataFrame:
    """(curve, x, y) at every step of each curve's own range of whole numbers, in `steps` steps (one more where they don't divide it), linear between the points about it.

    Points are first folded into cells between grid values, of which only the ends are
    kept; the ordered look over a curve then sees its cells, not its points.  Of points
    at one x the smallest y counts.
    """
    span = points.groupBy(curve).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("step", F.greatest(F.lit(1), F.expr(f"(hi - lo) div {steps}")))
    ends = lambda f, by: F.struct(f(x).alias("x"), by.alias("y"))
    cells = points.join(span, curve).withColumn("k", F.expr(f"(`{x}` - lo) div step")).groupBy(curve, "k").agg(
        ends(F.min, F.min_by(y, F.struct(x, y))).alias("first"), ends(F.max, F.max_by(y, F.struct(F.col(x), -F.col(y)))).alias("last")
    )
    grid = span.select(curve, F.explode(F.expr("sequence(0L, (hi - lo) div step)")).alias("k"), "lo", "step").withColumn("at", F.col("lo") + F.col("k") * F.col("step"))
    w = f"over (partition by `{curve}` order by k"
    near = grid.join(cells, [curve, "k"], "left").select(
        curve, "at", F.expr(f"case when first.x = at then first else last(last, true) {w} rows between unbounded preceding and 1 preceding) end").alias("l"),
        F.expr(f"first(first, true) {w} rows between current row and unbounded following)").alias("h"),
    )
    slope = F.when(F.col("h.x") == F.col("l.x"), F.lit(0.0)).otherwise((F.col("h.y") - F.col("l.y")) * (F.col("at") - F.col("l.x")) / (F.col("h.x") - F.col("l.x")).cast("double"))
    return near.select(curve, F.col("at").alias(x), (F.col("l.y") + slope).alias(y))


def group_advantages(rows: DataFrame, group: str, reward: str, epsilon: float = 1e-4) -> DataFrame:
    """rows with advantage (reward - mean) / (sample deviation + epsilon); groups without variance get 0 and active = false.

    Group statistics are aggregated first and joined back, so a large group isn't a window of one task.
    """
    stats = rows.groupBy(group).agg(F.avg(reward).alias("vl_mean"), F.stddev_samp(reward).alias("vl_sd"), (F.min(reward) != F.max(reward)).alias("active"))
    out = rows.join(stats, group)
    return out.withColumn("advantage", F.when(F.col("active"), (F.col(reward) - F.col("vl_mean")) / (F.col("vl_sd") + epsilon)).otherwise(0.0)).drop("vl_mean", "vl_sd")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def nll(logits: Column, target: Column) -> Column:
    return let(log_softmax(logits), lambda lp: -F.element_at(lp, target + 1))


def entropy(logits: Column) -> Column:
    return let(log_softmax(logits), lambda lp: -_sum(F.transform(lp, lambda x: F.exp(x) * x)))


def kl(student: Column, teacher: Column) -> Column:
    """Divergence of log-probabilities: the student's expectation of the difference."""
    return _sum(F.zip_with(student, teacher, lambda a, b: F.exp(a) * (a - b)))


def reverse_kl(student: Column, teacher: Column) -> Column:
    """kl() of logits."""
    return let(log_softmax(student), lambda p: let(log_softmax(teacher), lambda q: kl(p, q)))
