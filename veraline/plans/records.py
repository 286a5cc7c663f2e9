"""Queries on registries, identities, golden comparison and the planned data funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from veraline.functions.canonical import list_digest, object_sha256, set_digest
from veraline.operators.evaluation import mean_of_fractions
from veraline.operators.measures import parameter_totals
from veraline.operators.ordering import running_totals
from veraline.operators.training import greedy_token, position_ids, reward_counts, task_means
from veraline.plans.sql import query, sql, table

sql("registry_mismatch", """
    select c_custkey, c_nationkey, case when n_nationkey is null then 'unknown' else 'revision' end as rule from customer left join nation on c_nationkey = n_nationkey
    where n_nationkey is null or n_regionkey <> c_custkey % 5""")  # fmt: skip
_REGISTRY = "select distinct o_orderstatus as f, o_orderkey % 7 + 1 as k, o_custkey as c, substr(o_orderpriority, 1, 1) as p from orders"
_LINES = "select l_linestatus, l_linenumber, l_suppkey, substr(cast(l_linenumber % 5 + 1 as varchar(1)), 1, 1) as priority, count(*) as n from lineitem"
_SAME_KEY = "l_linestatus = f and l_linenumber = k and l_suppkey = c and cast(l_linenumber % 5 + 1 as varchar(1)) = p"
sql(
    "transform_registry_anti",
    f"{_LINES} left anti join ({_REGISTRY}) r on {_SAME_KEY} group by 1, 2, 3, 4",
    f"{_LINES} where not exists (select 1 from ({_REGISTRY}) r where {_SAME_KEY}) group by 1, 2, 3, 4",
)
sql("exact_keys_predicate", "select event_id, array_sort(json_object_keys(props)) = array('k') as fine from events", "select event_id, list_sort(json_keys(props)) = ['k'] as fine from events")
sql("prompt_sha256", "select item_id, sha2(text, 256) as prompt_sha, sha2(concat('{\"field\":\"problem\",\"id\":', item_id, '}'), 256) as fragment_id from benchmark", "select item_id, sha256(text) as prompt_sha, sha256('{\"field\":\"problem\",\"id\":' || item_id || '}') as fragment_id from benchmark")


@query("item_set_sha256", "select sha256('[' || string_agg('[' || item_id || ',\"' || sha256(text) || '\"]', ',' order by item_id) || ']') as digest, count(*) as n from benchmark")
def item_set_sha256(spark, sf_dir):
    return set_digest(table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("sha")), "item_id", "sha")


@query("record_set_digest", "select sha256('[' || string_agg('[' || doc_id || ',\"' || sha256(text) || '\"]', ',' order by doc_id) || ']') as digest, count(*) as n from documents")
def record_set_digest(spark, sf_dir):
    pair = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(',"'), F.col("sha"), F.lit('"]'))  # null, and not listed, if either is
    return list_digest(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), ["doc_id"], pair)


_EXPECTED, _SEEN = "select o_orderstatus as name, count(*) as n from orders group by o_orderstatus", "select l_linestatus as name, count(distinct l_orderkey) as n from lineitem group by l_linestatus"
sql("golden_compare", f"select coalesce(e.name, o.name) as name, e.n as expected, o.n as observed, e.n is not distinct from o.n as equal from ({_EXPECTED}) e full join ({_SEEN}) o on e.name = o.name")
sql("causal_shift", "select conv_id, turn, lag(role) over (partition by conv_id order by turn) as previous_role, role from conversations")
sql("except_both_ways", "select 'missing' as side, k from (select c_nationkey as k from customer except select s_nationkey from supplier) a union all select 'extra', k from (select s_nationkey as k from supplier except select c_nationkey from customer) b")


@query("deduplicated_parameters", "select p_brand, cast(sum(p_size) as bigint) as total from (select distinct p_brand, p_type, p_size from part) x group by p_brand")
def deduplicated_parameters(spark, sf_dir):
    return parameter_totals(table(spark, sf_dir, "part"), "p_brand", ["p_type", "p_size"], "p_size")


sql("quality_map_nullable", "select doc_id, case when quality is null then null else quality = 1 end as verified, source from documents left join labels using (doc_id)")
# The funnel is planned in the reference's documents, not built there.
_FUNNEL = """select reason, count(*) as n from (select case when n_chars < 100 then 'too_short' when r > 1 then 'duplicate' when lang not in ('en', 'de') then 'language' when n_chars > 8000 then 'too_long' else 'kept' end as reason
    from (select n_chars, lang, row_number() over (partition by {sha} order by doc_id) as r from documents) x) y group by reason"""  # fmt: skip
sql("data_funnel", _FUNNEL.format(sha="sha2(text, 256)"), _FUNNEL.format(sha="sha256(text)"))
sql("length_strata", "select lang, case when n_chars < 500 then 'short' when n_chars < 3000 then 'middle' else 'long' end as stratum, count(*) as n, min(n_chars) as least, max(n_chars) as most from documents group by 1, 2")

# --- canonical JSON of a row, positions, greedy tokens, batch counts ---


@query("canonical_payload_sha256", """select conv_id, turn, sha256('{"conv_id":' || conv_id || ',"messages":[{"content":' || to_json(text)::varchar || ',"role":' || to_json(role)::varchar || '}],"turn":' || turn || '}') as payload_sha256 from conversations""")
def canonical_payload_sha256(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("messages", F.array(F.struct("role", F.col("text").alias("content"))))
    return rows.select("conv_id", "turn", object_sha256(rows, conv_id="conv_id", turn="turn", messages="messages").alias("payload_sha256"))


@query("position_ids", "select vec_id, list_transform(range(1, len(embedding) + 1), lambda i: greatest(list_sum(list_transform(embedding[1:i], lambda x: (x > -0.1)::int)) - 1, 0))[len(embedding)]::int as last_position, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: greatest(list_sum(list_transform(embedding[1:i], lambda x: (x > -0.1)::int)) - 1, 0)))::bigint as total from embeddings")
def position_ids_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", position_ids(F.transform("embedding", lambda x: x > -0.1)).alias("p"))
    return rows.select("vec_id", F.element_at("p", -1).alias("last_position"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("greedy_tokens", "select token, count(*) as n from (select (list_position(embedding, list_max(embedding)) - 1)::int as token from embeddings) x group by token")
def greedy_tokens(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(greedy_token(F.col("embedding")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("reward_batch_counts", 'select source, count(*) as n, count_if(quality = 1)::bigint as "right", count_if(quality = 0)::bigint as wrong, count_if(quality is null)::bigint as unassigned from documents left join labels using (doc_id) group by source')
def reward_batch_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return reward_counts(rows, "source", "quality")


@query("task_evaluation_means", "select role, avg(length(text))::double as chars_mean, count(text) as chars_n, avg(turn)::double as turn_mean, count(turn) as turn_n from conversations group by role")
def task_evaluation_means(spark, sf_dir):
    return task_means(table(spark, sf_dir, "conversations").withColumn("chars", F.length("text")), ["role"], ["chars", "turn"])


sql("exact_completion_reward", "select conv_id, turn, case when text = earlier then 1 else 0 end as reward from (select conv_id, turn, text from conversations) a join (select conv_id as c, turn + 1 as t, text as earlier from conversations) b on c = conv_id and t = turn")
sql("item_strata_join", "select lang, stratum, count(*) as n, cast(sum(quality) as bigint) as correct from (select doc_id, lang, case when n_chars < 1000 then 'short' else 'long' end as stratum from documents) d join (select doc_id as k, quality from labels) l on k = doc_id group by lang, stratum")


@query("canonical_grid_order", "select l_orderkey as item_index, l_linenumber as sample_index, l_quantity, row_number() over (order by l_orderkey, l_linenumber, l_quantity) - 1 as position from lineitem")
def canonical_grid_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_index"), F.col("l_linenumber").alias("sample_index"), "l_quantity")
    return running_totals(rows, ["item_index", "sample_index", "l_quantity"], {}, "grid")


sql("first_offenders", "select rule, key from (select 'negative_balance' as rule, c_custkey as key from customer where c_acctbal < 0 union all select 'large_order', o_orderkey from orders where o_totalprice > 300000) v order by rule, key limit 3")
sql("fingerprint_counts", "select source, count(*) as n, count(distinct {sha}) as distinct_n, cast(sum(case when n_chars >= 32 then 1 else 0 end) as bigint) as fuzzy_n from documents group by source".format(sha="sha2(lower(text), 256)"), "select source, count(*) as n, count(distinct sha256(lower(text))) as distinct_n, cast(sum(case when n_chars >= 32 then 1 else 0 end) as bigint) as fuzzy_n from documents group by source")
sql("match_of_unknown_record", "select s_nationkey as unknown from (select distinct s_nationkey from supplier) s left anti join (select distinct c_nationkey from customer where c_acctbal > 9900) c on s_nationkey = c_nationkey", "select s_nationkey as unknown from (select distinct s_nationkey from supplier) s where not exists (select 1 from customer c where c_acctbal > 9900 and s_nationkey = c_nationkey)")
sql("grouping_sets_counts", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql("rank_frames", "select o_custkey, o_orderkey, cast(rank() over w as bigint) as r, cast(dense_rank() over w as bigint) as d, cast(ntile(4) over w as bigint) as q, lead(o_orderkey) over w as next_key, count(*) over (partition by o_custkey order by o_orderkey range between 1000 preceding and current row) as near from orders window w as (partition by o_custkey order by o_orderkey)")
sql("event_hours", "select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")


# shares of toxic documents by source, their mean by language: all over one denominator, rounded once
@query("mean_of_exact_fractions", """with x as (select lang, source, count(*) as n, sum(toxic)::hugeint as c from documents join labels using (doc_id) group by lang, source),
    l as (select lang, list_reduce(list(n::hugeint), lambda a, b: lcm(a, b)) as l from x group by lang)
    select lang, ((2000000 * sum(c * (l // n)) + any_value(l) * count(*)) // (2 * any_value(l) * count(*)))::bigint as ppm from x join l using (lang) group by lang""")  # fmt: skip
def mean_of_exact_fractions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return mean_of_fractions(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("c")), "lang", "c", "n")
