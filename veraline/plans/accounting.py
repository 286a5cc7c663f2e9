"""Queries on loss tokens, budgets, advantages, divergences and runs."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from veraline.functions.text import let, log_softmax, softcap
from veraline.operators.accounting import budget_prefix, entropy, first_eos_mask, group_advantages, interpolate, kl, ledger, nll
from veraline.operators.linear_losses import Transform, aligned_heads, linear_cross_entropy, linear_reverse_kl
from veraline.operators.mask_budget import select
from veraline.operators.measures import cursor, decayed, importance_ratio, phase_means, quantiles, relative_difference, round_medians, stages, surrogate
from veraline.operators.ordering import keyed_totals
from veraline.plans.sql import query, run_sql, sql, table

# --- masks: completions are the letters of a benchmark text, 'e' the end token ---

_IDS = "list_transform(string_split(text, ''), lambda x: case when x = 'e' then 0 else ord(x) end)"


@query("completion_mask_first_eos", f"select item_id, case when p is null then len(ids) else p end::bigint as kept, len(ids)::bigint as n from (select item_id, ids, list_position(ids, 0) as p from (select item_id, {_IDS} as ids from benchmark) x) y")
def completion_mask_first_eos(spark, sf_dir):
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.when(c == "e", 0).otherwise(F.ascii(c)))
    rows = table(spark, sf_dir, "benchmark").select("item_id", ids.alias("ids"))
    mask = first_eos_mask(F.col("ids"), 0)
    return rows.select("item_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"), F.size("ids").cast("long").alias("n"))


sql("assistant_mask", "select conv_id, cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as target_chars, cast(sum(length(text)) as bigint) as chars from conversations group by conv_id")
sql("mask_intersection", "select l_orderkey, cast(sum(case when l_returnflag = 'N' and l_linestatus = 'O' then 1 else 0 end) as bigint) as both_masks, count(*) as n from lineitem group by l_orderkey")

# --- groups: quality labels are rewards, sources groups ---

_REWARD = "select doc_id, source, quality as reward from documents join labels using (doc_id)"


@query("group_advantages", f"""select doc_id, source, reward, active, round(case when active then (reward - mu) / (sd + 1e-4) else 0 end, 6) as advantage from (
    select *, avg(reward) over w as mu, stddev_samp(reward) over w as sd, min(reward) over w <> max(reward) over w as active from ({_REWARD}) r window w as (partition by source)) x""")  # fmt: skip
def advantages(spark, sf_dir):
    return group_advantages(run_sql(spark, sf_dir, _REWARD), "source", "reward").select("doc_id", "source", "reward", "active", F.round("advantage", 6).alias("advantage"))


sql("zero_variance_groups", f"select source, count(*) as n from ({_REWARD}) r group by source having min(reward) = max(reward)")
sql("effective_group_rate", f"select count(*) as n_groups, cast(sum(active) as bigint) as active_groups, round(cast(sum(active) as double) / count(*), 9) as rate from (select case when min(reward) <> max(reward) then 1 else 0 end as active from ({_REWARD}) r group by source) g")

# --- budgets ---

_ATTEMPTS = "select event_id, user_id % 5 as stage, ts, cast(floor(value) as bigint) as candidate, event_type <> 'error' and event_id % 4 <> 0 as executed from events"


@query("budget_ledger", f"""select event_id, stage, consumed_after, consumed_after - least(run - c, 1500)::bigint as counted from (select *, least(run, 1500)::bigint as consumed_after from (
    select event_id, stage, case when executed then candidate else 0 end as c, sum(case when executed then candidate else 0 end) over (partition by stage order by ts, event_id rows unbounded preceding) as run from ({_ATTEMPTS}) a) x) y""")  # fmt: skip
def budget_ledger(spark, sf_dir):
    return ledger(run_sql(spark, sf_dir, _ATTEMPTS), "stage", ["ts", "event_id"], "candidate", "executed", 1500).select("event_id", "stage", "consumed_after", "counted")


@query("canonical_budget_prefix", "select doc_id, n_chars, greatest(0, least(n_chars, 200000 - before))::bigint as kept from (select doc_id, n_chars, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents) x")
def canonical_budget_prefix(spark, sf_dir):
    return budget_prefix(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 200_000)


# --- distributions: an embedding times 8 is a row of logits ---

_LOGITS = "select vec_id, list_transform(embedding, lambda x: x::double * 8) as s from embeddings"
_LP = "list_transform({v}, lambda x: x - list_max({v}) - ln(list_sum(list_transform({v}, lambda y: exp(y - list_max({v}))))))"


def _distributions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("s"))


@query("log_softmax_nll", f"select vec_id, round(-lp[(vec_id % 64 + 1)::int], 6) as nll, round(-list_sum(list_transform(lp, lambda x: exp(x) * x)), 6) as entropy from (select vec_id, {_LP.format(v='s')} as lp from ({_LOGITS}) x) y")
def log_softmax_nll(spark, sf_dir):
    return _distributions(spark, sf_dir).select("vec_id", F.round(nll(F.col("s"), (F.col("vec_id") % 64).cast("int")), 6).alias("nll"), F.round(entropy(F.col("s")), 6).alias("entropy"))


@query("reverse_kl", f"""with d as materialized (select vec_id, {_LP.format(v='s')} as lp from ({_LOGITS}) x)
    select a.vec_id, round(list_sum([exp(a.lp[i::int]) * (a.lp[i::int] - b.lp[i::int]) for i in range(1, 65)]), 6) as kl from d a join d b on b.vec_id = a.vec_id + 1""")  # fmt: skip
def reverse_kl_values(spark, sf_dir):
    d = _distributions(spark, sf_dir).select("vec_id", log_softmax(F.col("s")).alias("p"))
    teacher = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return d.join(teacher, "vec_id").select("vec_id", F.round(kl(F.col("p"), F.col("q")), 6).alias("kl"))


@query("softcap_logits", "select vec_id, round(list_max(c), 6) as most, round(list_sum(c), 6) as total from (select vec_id, list_transform(embedding, lambda x: 30 * tanh(x::double * 2 / 30) / 0.7::double) as c from embeddings) y")
def softcap_logits(spark, sf_dir):
    capped = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", softcap(capped, 2.0, 30.0, 0.7).alias("c"))
    return rows.select("vec_id", F.round(let(F.col("c"), F.array_max), 6).alias("most"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


sql("masked_ce_global_mean", """select label, round(sum(loss), 6) as ce_sum, count(*) as tokens, round(sum(loss) / count(*), 6) as token_mean from (
    select label, ln(1 + exp(-cast(vec_id % 17 as double) / 7)) as loss, vec_id % 5 <> 0 as chosen from embeddings) x where chosen group by label""")  # fmt: skip

# --- masks of an update: orders are rows, their seven lines places, the customer the sample ---


@query("mask_budget_plan", """with g as (select o_custkey, o_orderkey, i::int as i, coalesce(max(l_quantity) filter (where l_linenumber = i), 0) > 20 as m from orders left join lineitem on l_orderkey = o_orderkey, range(1, 8) r(i) group by 1, 2, 3),
    c as (select *, m and sum(m::int) over (order by o_custkey, o_orderkey, i) <= 12345 as kept from g)
    select o_orderkey, sum(m::int)::int as candidates, sum(kept::int)::int as selected, string_agg(case when kept then '1' else '0' end, '' order by i) as mask from c group by 1""")  # fmt: skip
def mask_budget_plan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_linenumber"))).alias("on"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("sample_id"), F.col("o_orderkey").alias("generation_index"))
    places = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(F.exists("on", lambda n: n == i), F.lit(False)))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "sample_id", "generation_index", places.alias("mask"))
    n = lambda c: F.size(F.filter(c, lambda x: x))
    digits = F.array_join(F.transform("loss_mask", lambda x: F.when(x, "1").otherwise("0")), "")
    return select(rows, 12345).rows.select("o_orderkey", n("candidate_mask").alias("candidates"), n("loss_mask").alias("selected"), digits.alias("mask"))


# --- losses from hidden states: vectors are positions, means of vectors by vec_id % 211 the head's rows ---

_HEAD = "select token, list(w order by i) as w, list(w order by i)[1:32] as u from (select (vec_id % 211)::bigint as token, i, 4 * avg(embedding[i]::double) as w from embeddings, range(1, 65) r(i) group by 1, 2) x group by token"
_PROJECTED = "10 * tanh((list_dot_product({h}, {w}) + {b}) / 10)"


def _head(spark, sf_dir):
    places = table(spark, sf_dir, "embeddings").select(F.expr("vec_id % 211").alias("token"), F.posexplode("embedding").alias("i", "v"))
    means = places.groupBy("token", "i").agg((4 * F.avg(F.col("v").cast("double"))).alias("w"))
    return means.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("weight"))


@query("linear_cross_entropy", f"""with h as materialized ({_HEAD}), p as (select vec_id, vec_id % 211 as target, list_transform(embedding, lambda x: x::double) as e from embeddings),
    l as (select vec_id, target, token, {_PROJECTED.format(h="e", w="w", b="token / 211.0::double")} as x from p, h), t as (select vec_id, max(x) as m from l group by vec_id),
    z as (select l.vec_id, any_value(m) as m, sum(exp(x - m)) as z, sum(x * exp(x - m)) as zx, max(case when token = target then x end) as said from l join t on l.vec_id = t.vec_id group by l.vec_id)
    select vec_id, round(m + ln(z) - said, 6) as nll, round(m + ln(z) - zx / z, 6) as entropy from z""")  # fmt: skip
def linear_cross_entropy_values(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id % 211").alias("target"), F.col("embedding").alias("hidden"))
    head = _head(spark, sf_dir).select("token", "weight", (F.col("token") / 211.0).alias("bias"))
    return linear_cross_entropy(rows, head, Transform(cap=10.0)).select("vec_id", F.round("nll", 6).alias("nll"), F.round("entropy", 6).alias("entropy"))


@query("linear_reverse_kl", f"""with h as materialized ({_HEAD}), p as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    l as (select vec_id, {_PROJECTED.format(h="e", w="w", b="0")} as x, list_dot_product(e[1:32], u) / 2 + token / 211.0::double as y from p, h), t as (select vec_id, max(x) as m, max(y) as n from l group by vec_id),
    z as (select l.vec_id, any_value(m) + ln(sum(exp(x - m))) as a, any_value(n) + ln(sum(exp(y - n))) as b from l join t on l.vec_id = t.vec_id group by l.vec_id)
    select l.vec_id, round(sum(exp(x - a) * (x - a - y + b)), 6) as kl, round(-sum(exp(x - a) * (x - a)), 6) as entropy from l join z on l.vec_id = z.vec_id group by l.vec_id""")  # fmt: skip
def linear_reverse_kl_values(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("hidden"), F.slice("embedding", 1, 32).alias("teacher_hidden"))
    head = _head(spark, sf_dir).withColumn("bias", F.lit(None).cast("double"))
    teacher = head.select("token", F.slice("weight", 1, 32).alias("weight"), (2 * F.col("token") / 211.0).alias("bias"))
    found = linear_reverse_kl(rows, aligned_heads(head, teacher), Transform(cap=10.0), Transform(temperature=2.0))
    return found.select("vec_id", F.round("kl", 6).alias("kl"), F.round("entropy", 6).alias("entropy"))


# --- clipped surrogate: order lines are tokens, their orders groups ---

_TOKENS = "select l_orderkey, l_linenumber, exp((l_discount - 0.05) * 10) as r, case when l_quantity > 25 then 1.0 when l_quantity < 20 then -1.0 else 0.0 end as a from lineitem"


def _surrogate(spark, sf_dir, by: dict):
    rows = table(spark, sf_dir, "lineitem").withColumns(by)
    quantity = F.col("l_quantity")
    rows = rows.withColumns({"r": importance_ratio(F.col("l_discount") * 10, F.lit(0.5)), "a": F.when(quantity > 25, 1.0).when(quantity < 20, -1.0).otherwise(0.0)})
    return surrogate(rows, list(by), "l_orderkey", "r", "a", longest=7)


@query("importance_ratio_clip", f"select count(*) as n, count(distinct l_orderkey) as completions, cast(sum(case when r < 0.8 and a < 0 then 1 else 0 end) as bigint) as clipped_low, cast(sum(case when r > 1.2 and a > 0 then 1 else 0 end) as bigint) as clipped_high, round(sum(r), 4) as ratio_sum, round(min(r), 6) as ratio_min, round(max(r), 6) as ratio_max from ({_TOKENS}) t")
def importance_ratio_clip(spark, sf_dir):
    s = _surrogate(spark, sf_dir, {"whole": F.lit(0)})
    return s.select(F.col("token_count").alias("n"), F.col("completion_count").alias("completions"), F.col("low_clipped").alias("clipped_low"), F.col("high_clipped").alias("clipped_high"), F.round("ratio_sum", 4).alias("ratio_sum"), F.round("ratio_min", 6).alias("ratio_min"), F.round("ratio_max", 6).alias("ratio_max"))


@query("dr_grpo_loss", f"select l_orderkey % 100 as bucket, count(*) as n, round(-sum(least(r * a, greatest(least(r, 1.2), 0.8) * a)) / (count(distinct l_orderkey) * 7), 6) as loss from ({_TOKENS}) t group by l_orderkey % 100")
def dr_grpo_loss(spark, sf_dir):
    return _surrogate(spark, sf_dir, {"bucket": F.col("l_orderkey") % 100}).select("bucket", F.col("token_count").alias("n"), F.round("loss", 6).alias("loss"))


# --- runs: events are steps, event_type the arm, user_id % 3 the round ---



def _steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("stage"), "value", "user_id")


@query("stage_summary", "select event_type as arm, user_id % 3 as stage, count(*) as attempts, cast(sum(case when value > 20 then 1 else 0 end) as bigint) as updates, cast(sum(case when value > 20 then 0 else 1 end) as bigint) as skips, round(sum(value), 4) as seconds from events group by event_type, user_id % 3")
def stage_summary(spark, sf_dir):
    return stages(_steps(spark, sf_dir), ["arm", "stage"], F.col("value") > 20, "value").withColumn("seconds", F.round("seconds", 4))


@query("perf_p50_p95_rounds", "select arm, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.95), 6) as p95, round(min(m), 6) as least_median, round(max(m), 6) as most_median from (select event_type as arm, value as v, quantile_cont(value, 0.5) over (partition by event_type, user_id % 3) as m from events) x group by arm")
def perf_p50_p95_rounds(spark, sf_dir):
    rows = _steps(spark, sf_dir)
    told = quantiles(rows, ["arm"], "value", {"p50": Fraction(1, 2), "p95": Fraction(95, 100)}).join(round_medians(rows, ["arm"], "stage", "value"), "arm")
    return told.select("arm", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "least_median", "most_median")))


@query("nearest_rank_p95", "select event_type as arm, value as p95 from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events) x where r = floor(0.95 * (n - 1)) + 1")
def nearest_rank_p95(spark, sf_dir):
    return quantiles(_steps(spark, sf_dir), ["arm"], "value", {"p95": Fraction(95, 100)}, nearest=True)


@query("throughput", "select event_type as arm, round(avg(value), 6) as step_mean, round(avg(value * (user_id % 3)), 6) as update_mean, cast(sum(user_id) as bigint) as tokens, round(sum(user_id) / sum(value), 6) as tokens_per_s from events group by event_type")
def throughput(spark, sf_dir):
    rows = _steps(spark, sf_dir).select("arm", F.col("value").alias("step"), (F.col("value") * F.col("stage")).alias("update"), F.col("user_id").alias("tokens"))
    return phase_means(rows, ["arm"], ["step", "update"], "step", "tokens").select("arm", *(F.round(c, 6).alias(c) for c in ("step_mean", "update_mean", "tokens_per_s")), "tokens")


@query("lr_schedule", "select event_id, round(1 - 0.9 * least(1.0, consumed / 20000.0), 9) as lr_factor from (select event_id, cast(sum(cast(floor(value) as bigint)) over (partition by user_id % 5 order by ts, event_id rows unbounded preceding) as double) as consumed from events) x")
def lr_schedule(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "select event_id, user_id % 5 as stage, ts, cast(floor(value) as bigint) as tokens from events")
    run = keyed_totals(rows, "stage", ["ts", "event_id"], {"before": "tokens"}, "lr")
    return run.select("event_id", F.round(decayed(F.col("before") + F.col("tokens"), 20_000), 9).alias("lr_factor"))


@query("batch_cursor", "select o_orderkey, (o_orderkey * 4 + 3) % 97 as at from orders")
def batch_cursor(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", cursor(F.col("o_orderkey"), 3, 4, 97).alias("at"))


# learning curves: events are points, each arm's grid spans its own range in up to 100 steps


@query("curve_interpolation", f"""with g as (select arm, unnest(range(0, (hi - lo) // step + 1)) as k, lo, step from (select event_type as arm, min(event_id) as lo, max(event_id) as hi, greatest(1, (max(event_id) - min(event_id)) // 100) as step from events group by event_type) r),
    q as (select arm, lo + k * step as x from g), p as (select event_type as arm, event_id as x, value as y from events)
    select q.arm, q.x, round(l.y + case when h.x = l.x then 0 else (h.y - l.y) * (q.x - l.x) / (h.x - l.x)::double end, 6) as y from q asof join p l on q.arm = l.arm and q.x >= l.x asof join p h on q.arm = h.arm and q.x <= h.x""")  # fmt: skip
def curve_interpolation(spark, sf_dir):
    return interpolate(table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("x"), F.col("value").alias("y")), "arm", "x", "y", 100).withColumn("y", F.round("y", 6))


sql("teacher_student_quadrants", "select quality as teacher, toxic as student, count(*) as n from labels group by quality, toxic")
sql(
    "length_truncation_profile",
    "select lang, round(percentile(n_chars, 0.95), 4) as p95, cast(sum(case when n_chars >= 5000 then 1 else 0 end) as bigint) as at_cap, count(*) as n from documents group by lang",
    "select lang, round(quantile_cont(n_chars::double, 0.95), 4) as p95, cast(sum(case when n_chars >= 5000 then 1 else 0 end) as bigint) as at_cap, count(*) as n from documents group by lang",
)


@query("relative_l2", "select l_returnflag, round(sqrt(sum(pow(l_extendedprice - l_extendedprice * (1 - l_discount), 2))) / greatest(sqrt(sum(pow(l_extendedprice, 2))), 1e-12), 9) as relative, round(max(abs(l_extendedprice - l_extendedprice * (1 - l_discount))), 4) as most from lineitem group by l_returnflag")
def relative_l2(spark, sf_dir):
    price = F.col("l_extendedprice")
    told = relative_difference(table(spark, sf_dir, "lineitem"), ["l_returnflag"], price, price * (1 - F.col("l_discount")))
    return told.select("l_returnflag", F.round("relative", 9).alias("relative"), F.round("most", 4).alias("most"))


sql("top_ops", "select o_custkey, round(sum(o_totalprice), 2) as total from orders group by o_custkey order by total desc, o_custkey limit 12")
