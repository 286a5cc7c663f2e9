"""Queries on answers, the evaluation grid, exact metrics and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veraline.operators.backend import run_generation
from veraline.operators.evaluation import Protocol, announced, pass_at_k_ppm, plain_number
from veraline.operators.resampling import exhaustive_sign_flip, holm, resampled_totals, type7_quantile
from veraline.plans.sql import query, run_sql, sql, table

# --- verification: predictions made of part sizes ---

_SAID = """select p_partkey, p_size, case p_partkey % 6 when 0 then concat('So \\\\boxed{', cast(p_size as string), '}') when 1 then concat('Final answer: ', cast(p_size + p_partkey % 4 - 1 as string)) when 2 then concat('<answer>', cast(p_size as string), '/1</answer>')
  when 3 then 'no idea at all' when 4 then concat('\\\\boxed{', cast(p_size as string)) else concat('Answer: 7\nThe answer is ', cast(p_size * 10 as string), '/10') end as said from part"""
_KIND = "case when p_partkey % 6 = 3 then 'prediction_not_extracted' when p_partkey % 6 = 4 then 'prediction_not_extracted' when p_partkey % 6 = 1 and p_partkey % 4 <> 1 then 'mismatch' else 'match' end"


@query("verify_status_counts", f"select status, count(*) as n, sum(case when status = 'match' then 1 else 0 end)::bigint as correct from (select {_KIND} as status from part) x group by status")
def verify_status_counts(spark, sf_dir):
    v = run_sql(spark, sf_dir, _SAID).select(plain_number(F.col("p_size").cast("string"), F.col("said")).alias("v"))
    return v.groupBy(F.col("v.verification_status").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("v.verification_status") == "match").alias("correct"))


@query("audit_by_category", f"select (p_partkey % 6)::bigint as category, count(*) as total, count_if(status = 'match')::bigint as passed, count_if(status <> 'match')::bigint as failed from (select p_partkey, {_KIND} as status from part) x group by 1")
def audit_by_category(spark, sf_dir):
    v = run_sql(spark, sf_dir, _SAID).select((F.col("p_partkey") % 6).alias("category"), plain_number(F.col("p_size").cast("string"), F.col("said")).alias("v"))
    return v.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("v.verification_status") == "match").alias("passed"), F.count_if(F.col("v.verification_status") != "match").alias("failed"))


@query("extract_answers", """select p_partkey, case when p_partkey % 6 = 3 then 'no_final_answer' when p_partkey % 6 = 4 then 'malformed_final_answer' else 'extracted' end as status, case p_partkey % 6 when 0 then p_size::varchar when 1 then (p_size + p_partkey % 4 - 1)::varchar when 2 then p_size || '/1' when 5 then (p_size * 10) || '/10' end as answer,
    case p_partkey % 6 when 3 then 0 when 5 then 2 else 1 end::int as markers from part""")  # fmt: skip
def extract_answers(spark, sf_dir):
    return run_sql(spark, sf_dir, _SAID).select("p_partkey", announced(F.col("said")).alias("e")).select("p_partkey", "e.status", "e.answer", F.col("e.markers").cast("int").alias("markers"))


sql("strict_label_score", "select o_orderkey, trim(o_orderstatus) in ('F', 'O') and trim(o_orderstatus) = case when o_orderkey % 2 = 0 then 'F' else 'O' end as correct from orders")

# --- grid, bijection, metrics: events are samples, users items ---

sql(
    "request_grid",
    "select item_id, s.k as sample_index, sha2(concat_ws('|', 'run', item_id, s.k, sha2(text, 256)), 256) as request_id from benchmark lateral view explode(sequence(0L, 7L)) s as k",
    "select item_id, s.k as sample_index, sha256('run|' || item_id || '|' || s.k || '|' || sha256(text)) as request_id from benchmark, (select unnest(range(0, 8)) as k) s",
)
#: A backend that needs no model: it answers with sizes, last request first, and gives out on some.
_GRID = """select item_id, 'item:' || item_id as name, s.k as sample_index, length(text) * 7 + s.k as said, (item_id + s.k) % 11 = 5 as fails from benchmark, (select unnest(range(0, 4)) as k) s"""


def _sizes():
    def answer(asked: list[dict]) -> list[dict]:
        if any((r["item_index"] + r["sample_index"]) % 11 == 5 for r in asked):
            raise RuntimeError("out of memory")
        said = [str(len(r["prompt"]) * 7 + r["sample_index"]) for r in asked]
        return [{"request_id": r["request_id"], "status": "completed", "generated_text": t, "output_token_ids": [*t.encode(), 2], "finish_reason": "eos", "error_code": None} for r, t in zip(asked, said, strict=True)][::-1]

    return answer


@query("generation_run", f"select name as item_id, sample_index, case when fails then 'failed' else 'completed' end as status, case when not fails then said::varchar end as generated_text, case when fails then 0 else length(said::varchar) + 1 end::int as tokens, case when fails then 'backend_error' end as error_code from ({_GRID}) g")
def generation_run(spark, sf_dir):
    text = F.col("text")
    items = table(spark, sf_dir, "benchmark").select(F.lit("made").alias("benchmark_id"), F.lit("1").alias("benchmark_revision"), F.concat(F.lit("item:"), "item_id").alias("item_id"), F.col("item_id").alias("item_index"), text.alias("prompt"), F.create_map().cast("map<string,string>").alias("strata"))
    protocol = Protocol("sampling", 4, 64, "", "a" * 64, 2, (2,), (), 700_000, 950_000, 0, "queries", 1)
    return run_generation(items, protocol, "b" * 64, _sizes).select("item_id", "sample_index", "status", "generated_text", F.size("output_token_ids").alias("tokens"), "error_code")


sql("response_bijection", """
    select side, count(*) as n from (select case when q.o_orderkey is null then 'extra' when r.k is null then 'missing' when r.n > 1 then 'duplicate' else 'paired' end as side
      from (select o_orderkey from orders) q full join (select l_orderkey as k, count(*) as n from lineitem group by l_orderkey) r on q.o_orderkey = r.k) x group by side""")  # fmt: skip
_SAMPLES = "select user_id as item, event_id, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as sample_index, case when value > 50 then 1 else 0 end as correct, cast(floor(value) as bigint) as tokens, event_type from events"
sql("sample_scores", f"select item, sample_index, correct, tokens, case when event_type = 'error' then 'length' else 'eos' end as finish from ({_SAMPLES}) s")
_ITEMS = f"select item, count(*) as n, cast(sum(correct) as bigint) as c, cast(sum(tokens) as bigint) as tokens from ({_SAMPLES}) s group by item"
sql("item_scores", f"select item, n, c, tokens, cast(floor((2000000 * c + n) / (2 * n)) as bigint) as accuracy_ppm from ({_ITEMS}) i")
_KS = (1, 2, 4, 8)


def _product(first: str, k: int) -> str:
    return " * ".join(f"({first} - {i})::hugeint" for i in range(k))


# exact: right ones of n by falling products, rounded once to millionths
_PASS = ", ".join(f"case when n >= {k} then ((2000000 * ({_product('n', k)} - {_product('n - c', k)}) + {_product('n', k)}) // (2 * {_product('n', k)}))::bigint end as pass_at_{k}" for k in _KS)


@query("pass_at_k", f"select item, n, c, {_PASS} from ({_ITEMS}) i")
def pass_at_k(spark, sf_dir):
    return pass_at_k_ppm(run_sql(spark, sf_dir, _ITEMS).select("item", "n", "c"), "n", "c", _KS)


sql("eval_report", f"""select count(*) as items, cast(sum(n) as bigint) as samples, cast(sum(c) as bigint) as correct, cast(floor((2000000 * sum(c) + sum(n)) / (2 * sum(n))) as bigint) as accuracy_ppm, cast(sum(tokens) as bigint) as tokens,
    round(avg(cast(c as double) / n), 9) as mean_pass_at_1 from ({_ITEMS}) i""")  # fmt: skip
sql("status_counts", "select event_type as status, count(*) as n, count(distinct user_id) as items from events group by event_type")
sql("finish_reason_semantics", """select event_id, case when tokens = 99 then 'length' when last_id = 1 then 'eos' when last_id in (2, 3) then 'stop_token' when event_type like '%ick' then 'stop_sequence' else 'none' end as finish
    from (select event_id, event_type, cast(floor(value) as bigint) as tokens, event_id % 9 as last_id from events) e""")  # fmt: skip

# --- paired statistics: five event types are arms, user_id the item, event_id % 3 the seed ---

_LONG = """select item, seed, arm, max(correct) as correct from (select user_id as item, event_id % 3 as seed, dense_arm as arm, case when value > 60 then 1 else 0 end as correct from (select *, cast(event_id % 5 as int) as dense_arm from events) e) x group by item, seed, arm"""
_DIFF = f"select t.item, t.seed, t.correct - c.correct as d from ({_LONG}) t join ({_LONG}) c on t.item = c.item and t.seed = c.seed where t.arm = 1 and c.arm = 0"
_UNITS = f"select item, cast(sum(d) as bigint) as u, count(*) as n from ({_DIFF}) d group by item"
sql("paired_panel_pivot", f"select item, seed, " + ", ".join(f"max(case when arm = {a} then correct end) as a{a}" for a in range(5)) + f" from ({_LONG}) p group by item, seed")
sql("paired_effect", f"select cast(sum(u) as bigint) as num, cast(sum(n) as bigint) as den, cast(floor((2000000 * sum(u) + sum(n)) / (2 * sum(n))) as bigint) as ppm from ({_UNITS}) u")
sql("per_seed_effects", f"select seed, cast(sum(d) as bigint) as num, count(*) as den from ({_DIFF}) d group by seed")
sql("seed_instability", f"select max(case when num < 0 then 1 else 0 end) = 1 and max(case when num > 0 then 1 else 0 end) = 1 as unstable from (select seed, sum(d) as num from ({_DIFF}) d group by seed) s")


@query("type7_quantile_exact", "select event_type, round(quantile_cont((value * 1000000)::bigint::double, 0.025), 3) as q025, round(quantile_cont((value * 1000000)::bigint::double, 0.975), 3) as q975 from events group by event_type")
def type7(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 1_000_000).cast("long").alias("v"))
    exact = type7_quantile(rows, ["event_type"], "v", {"q025": (25, 1000), "q975": (975, 1000)})
    return exact.select("event_type", F.round("q025", 3).alias("q025"), F.round("q975", 3).alias("q975"))


# SQL has no whole numbers of any length for the patterns of so many items; tests compare with their enumeration
@query("sign_flip_exact")
def sign_flip_exact(spark, sf_dir):
    return exhaustive_sign_flip(run_sql(spark, sf_dir, _UNITS), "item", "u")


# The registered repetitions.
BOOTSTRAPS, FLIPS = 10_000, 100_000
_NUMBERED = f"select row_number() over (order by item) - 1 as pos, u, count(*) over () as m from ({_UNITS}) x"
# a digest gives five draws, or 256 signs
_DIGESTS = "(select rep, blk, sha256('{s}:' || rep || ':' || blk) as d from (select unnest(range(0, {n})) as rep) r, (select unnest(range(0, (select count(*) from ({u}) u) // {per} + 1)) as blk) b)"
_DRAWS = _DIGESTS.format(s="boot", n=BOOTSTRAPS, u=_UNITS, per=5)
_SIGNS = _DIGESTS.format(s="flip", n=FLIPS, u=_UNITS, per=256)
_BOOT = f"select rep, cast(sum(u) as bigint) as total from (select rep, ('0x' || substr(d, (12 * (i.pos % 5) + 1)::int, 12))::bigint % i.m as pick from ({_NUMBERED}) i join {_DRAWS} g on i.pos // 5 = g.blk) d join ({_NUMBERED}) k on k.pos = d.pick group by rep"
_SIGN = f"select rep, cast(sum(case when (('0x' || substr(d, (i.pos % 256 // 4 + 1)::int, 1))::int >> (3 - i.pos % 4)::int) & 1 = 1 then u else -u end) as bigint) as total from ({_NUMBERED}) i join {_SIGNS} g on i.pos // 256 = g.blk group by rep"


@query("bootstrap_hash_rng", _BOOT)
def bootstrap_hash_rng(spark, sf_dir):
    return resampled_totals(run_sql(spark, sf_dir, _UNITS), "item", "u", BOOTSTRAPS, "boot", "bootstrap")


@query("percentile_ci", f"select quantile_cont(total::double, 0.025) as lower, quantile_cont(total::double, 0.975) as upper from ({_BOOT}) x")
def percentile_ci(spark, sf_dir):
    return bootstrap_hash_rng(spark, sf_dir).select(F.expr("percentile(total, 0.025)").alias("lower"), F.expr("percentile(total, 0.975)").alias("upper"))


@query("sign_flip_hash_rng", f"select cast(sum(case when total >= seen then 1 else 0 end) + 1 as bigint) as num, count(*) + 1 as den from ({_SIGN}) x cross join (select sum(u) as seen from ({_UNITS}) u) o")
def sign_flip_hash_rng(spark, sf_dir):
    units = run_sql(spark, sf_dir, _UNITS)
    seen = units.agg(F.coalesce(F.sum("u"), F.lit(0))).first()[0]
    totals = resampled_totals(units, "item", "u", FLIPS, "flip", "signs")
    return totals.agg((F.count_if(F.col("total") >= seen) + 1).alias("num"), (F.count("*") + 1).alias("den"))


_P = "select event_type as hypothesis, round(avg(case when value > 95 then 1.0 else 0.0 end), 6) as p from events group by event_type"


@query("holm_adjust", f"select hypothesis, p, round(max(least(1.0::double, m * p)) over (order by p, hypothesis rows unbounded preceding), 9) as adjusted from (select hypothesis, p, (count(*) over () - row_number() over (order by p, hypothesis) + 1)::double as m from ({_P}) x) y")
def holm_adjust(spark, sf_dir):
    return holm(run_sql(spark, sf_dir, _P.replace("1.0", "1.0D").replace("0.0", "0.0D")), "hypothesis", "p").withColumn("adjusted", F.round("adjusted", 9))


sql("tost_classification", """select event_type, lower, upper, case when lower > 0.02 then 'superior' when lower > -0.02 and upper < 0.02 then 'practical_equivalence' when upper < -0.02 then 'inferior' else 'inconclusive' end as decision
    from (select event_type, round(avg(case when value > 50 then 1 else -1 end) - 0.05, 9) as lower, round(avg(case when value > 50 then 1 else -1 end) + 0.05, 9) as upper from events group by event_type) x""")  # fmt: skip
