"""Queries on constraints, hashing, splits, contamination, quarantine and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from veraline.functions.text import digest_mod, seed63, sha
from veraline.operators.contamination import best_match, family_components, fingerprints, quarantine, scan
from veraline.operators.measures import split_errors
from veraline.plans.sql import query, run_sql, spread, sql, table
from veraline.plans.store import discard, materialize

# --- constraints ---

sql("unique_violations", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
sql("fk_anti_join", "select o_orderkey, o_custkey from orders left anti join customer on o_custkey = c_custkey", "select o_orderkey, o_custkey from orders where not exists (select 1 from customer where c_custkey = o_custkey)")
sql("allowed_domain_violations", "select o_orderstatus, count(*) as n from orders where o_orderstatus not in ('F', 'O') or o_orderstatus is null group by o_orderstatus")
sql("license_allow_list", "select source, count(*) as n from documents where source not in ('src0', 'src1', 'src2', 'src3') group by source")
sql(
    "duplicate_content",
    "select sha2(text, 256) as content_sha, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "select sha256(text) as content_sha, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
)
sql("set_equality_both_ways", """
    select coalesce(c_custkey, k) as key, case when k is null then 'only_customer' else 'only_orders' end as side
    from customer full join (select distinct o_custkey as k from orders) o on c_custkey = k where c_custkey is null or k is null""")  # fmt: skip
sql("id_sets_intersection", "select count(*) as n from (select doc_id as k from documents intersect select item_id as k from benchmark) x")
sql("canonical_sorted_list_check", """
    select o_custkey, n, n_distinct from (select o_custkey, count(*) as n, count(distinct o_orderpriority) as n_distinct from orders group by o_custkey) x where n <> n_distinct""")  # fmt: skip
sql(
    "identifier_predicate",
    r"select c_custkey, c_name rlike '^[A-Za-z0-9][A-Za-z0-9._:/#-]*$' and not contains(c_name, '..') and not endswith(c_name, '/') as fine from customer",
    r"select c_custkey, regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._:/#-]*$') and not contains(c_name, '..') and not ends_with(c_name, '/') as fine from customer",
)
sql(
    "uri_predicate",
    "select page_id, lower(parse_url(url, 'PROTOCOL')) in ('https', 'hf') and parse_url(url, 'HOST') is not null as fine, parse_url(url, 'HOST') as host from pages",
    "select page_id, regexp_matches(url, '^(https|hf)://[^/]+') as fine, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') as host from pages",
)
sql("message_roles", "select conv_id, max(case when role = 'user' then 1 else 0 end) = 1 as has_user, count(*) as turns, max(turn) + 1 = count(*) and min(turn) = 0 and count(distinct turn) = count(*) as consecutive from conversations group by conv_id")
sql("benchmark_index_check", "select min(item_id) as least, max(item_id) as most, count(*) as n, count(distinct item_id) as n_distinct, min(item_id) = 0 and max(item_id) = count(*) - 1 and count(distinct item_id) = count(*) as consecutive from benchmark")
sql("json_props_extract", "select event_id, cast(get_json_object(props, '$.k') as bigint) as k from events", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")

# --- hashing ---

sql(
    "row_payload_sha256",
    """select p_partkey, sha2(concat('{"p_brand":"', p_brand, '","p_name":"', p_name, '","p_size":', p_size, '}'), 256) as payload_sha from part""",
    """select p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') as payload_sha from part""",
)
_FOLD = "list_reduce(list_prepend(0::bigint, [(strpos('0123456789abcdef', substr({d}, i::int, 1)) - 1)::bigint for i in range(1, 65)]), lambda a, x: (a * 16 + x) % {m})"


@query("hash_bucket_mod", f"select doc_id, {_FOLD.format(d='d', m=7)}::bigint as bucket from (select doc_id, sha256('ns:' || doc_id) as d from documents) x")
def hash_bucket_mod(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest_mod(sha(F.concat(F.lit("ns:"), F.col("doc_id").cast("string"))), 7).alias("bucket"))


@query("generation_seed_63", "select item_id, s.k as sample_index, (('0x' || substr(sha256('seed:' || item_id || ':' || s.k), 1, 16))::ubigint & 9223372036854775807)::bigint as seed from benchmark, (select unnest(range(0, 4)) as k) s")
def generation_seed_63(spark, sf_dir):
    grid = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("sample_index"))
    return grid.select("item_id", "sample_index", seed63(sha(F.concat_ws(":", F.lit("seed"), "item_id", "sample_index"))).alias("seed"))


# --- families and splits ---

# families are whole values: the whole text, its whole first and its whole last line, by digest
DIMENSIONS = ("body", "opening", "ending")
_FAMILIES = "select doc_id, sha2(lower(text), 256) as body, sha2(element_at(split(lower(text), '\n'), 1), 256) as opening, sha2(element_at(split(lower(text), '\n'), -1), 256) as ending from documents"
_DUCK_FAMILIES = "select doc_id, sha256(lower(text)) as body, sha256(string_split(lower(text), chr(10))[1]) as opening, sha256(string_split(lower(text), chr(10))[-1]) as ending from documents"
_COMPONENTS = f"""
  f as materialized ({_DUCK_FAMILIES}),
  e as materialized ({" union ".join(f"select doc_id, min(doc_id) over (partition by {d}) as other from f" for d in DIMENSIONS)}),
  b as materialized (select doc_id as x, other as y from e union select other, doc_id from e),
  r(doc_id, label) as (select x, x from b union select b.y, r.label from r join b on b.x = r.doc_id),
  c as materialized (select doc_id, min(label) as component from r group by doc_id)"""


def _components(spark, sf_dir):
    return family_components(run_sql(spark, sf_dir, _FAMILIES), "doc_id", [*DIMENSIONS])


@query("family_components", f"with recursive {_COMPONENTS} select doc_id, component from c")
def families(spark, sf_dir):
    return _components(spark, sf_dir)


@query("family_component_sizes", f"with recursive {_COMPONENTS} select component, count(*) as n from c group by component")
def family_component_sizes(spark, sf_dir):
    return _components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"))


#: Split names in string order with their cumulative weights.
_SPLITS = (("D_anchor", 1), ("D_core", 6), ("D_dev", 7), ("D_select", 9), ("D_teacher_gate", 10))


def _assigned(spark, sf_dir):
    """(doc_id, component, split): a component's split is drawn from the digest of its members.

    The digest is that of its parts', by the first three digits of the members' digests, so
    that no task gathers a whole component.
    """
    c = materialize(_components(spark, sf_dir), "components")
    part = F.substring(sha(F.col("doc_id").cast("string")), 1, 3)
    parts = c.groupBy("component", part.alias("part")).agg(sha(F.array_join(F.array_sort(F.collect_list("doc_id")), ",")).alias("d"))
    payload = F.concat(F.lit("ns\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ","))
    drawn = parts.groupBy("component").agg(digest_mod(sha(payload), 10).alias("bucket"))  # 4,096 parts at most
    split = F.coalesce(*(F.when(F.col("bucket") < top, name) for name, top in _SPLITS))
    told = materialize(drawn.select("component", split.alias("split")), "component-splits")
    return c.join(told, "component").select("doc_id", "component", "split")


_CASE = "case " + " ".join(f"when bucket < {top} then '{name}'" for name, top in _SPLITS) + " end"
_ASSIGNED = f"""{_COMPONENTS},
  parts as (select component, substr(sha256(doc_id::varchar), 1, 3) as part, sha256(string_agg(doc_id::varchar, ',' order by doc_id)) as part_sha from c group by 1, 2),
  d as (select component, sha256('ns' || chr(10) || string_agg(part_sha, ',' order by part)) as d from parts group by component),
  k as (select component, {_FOLD.format(d="d", m=10)} as bucket from d),
  a as (select c.doc_id, c.component, {_CASE} as split from c join k using (component))"""


@query("weighted_hash_split", f"with recursive {_ASSIGNED} select * from a")
def weighted_hash_split(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("split_distribution_error", f"""with recursive {_ASSIGNED}, t as (select * from (values ('D_anchor', 1), ('D_core', 5), ('D_dev', 1), ('D_select', 2), ('D_teacher_gate', 1)) v(split, weight))
    select t.split, count(a.doc_id) as n, weight / 10.0::double as target, round(count(a.doc_id) / (select count(*) from a)::double - weight / 10.0::double, 9) as error from t left join a using (split) group by t.split, weight""")  # fmt: skip
def split_distribution_error(spark, sf_dir):
    weights = {s: top - before for (s, top), before in zip(_SPLITS, (0, *(t for _, t in _SPLITS)), strict=False)}
    return split_errors(_assigned(spark, sf_dir), weights).withColumn("error", F.round("error", 9))


_LEAKS = "select dimension, family, count(distinct split) as splits, count(*) as n from ({x}) x group by dimension, family having count(distinct split) > 1"
_EACH = " union all ".join(f"select '{d}' as dimension, {d} as family, doc_id % 3 as split from f" for d in DIMENSIONS)
_STACK = ", ".join(f"'{d}', {d}" for d in DIMENSIONS)
sql("family_leaks", _LEAKS.format(x=f"select stack(3, {_STACK}) as (dimension, family), doc_id % 3 as split from ({_FAMILIES}) f"), f"with f as ({_DUCK_FAMILIES}) " + _LEAKS.format(x=_EACH))
sql("source_counts", "select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by source, lang")

# --- contamination ---

_WORDS = r"regexp_extract_all(lower({t}), '([\p{{L}}\p{{N}}_]+)', 1)"


def _duck_prints(name: str, key: str) -> str:
    return f"""{name}_n as materialized (select {key}, list_aggregate({_WORDS.format(t="text")}, 'string_agg', ' ') as norm from {name}),
  {name}_f as materialized (select {key}, sha256(norm) as norm_sha, length(norm) as norm_chars, replace(norm, ' ', '') as compact, string_split(norm, ' ') as toks from {name}_n where norm <> ''),
  {name}_g as materialized (select {key}, norm_sha, norm_chars,
    case when length(compact) < 5 then [compact] else list_distinct([substr(compact, i::int, 5) for i in range(1, length(compact) - 3)]) end as char_grams,
    case when len(toks) < 3 then [array_to_string(toks, chr(31))] else list_distinct([toks[i] || chr(31) || toks[i + 1] || chr(31) || toks[i + 2] for i in range(1, len(toks) - 1)]) end as token_grams from {name}_f)"""


def _duck_shared(grams: str, alias: str) -> str:
    return f"""{alias} as materialized (select a.doc_id, b.item_id, count(*) as both from (select doc_id, unnest({grams}) as g from documents_g where norm_chars >= 32) a
    join (select item_id, unnest({grams}) as g from benchmark_g where norm_chars >= 32) b using (g) group by 1, 2)"""


_PRINTS = f"{_duck_prints('documents', 'doc_id')}, {_duck_prints('benchmark', 'item_id')}"
_PPM = "case when {d} = 0 then 0 else round_even({n} * 1000000.0::double / {d}, 0)::bigint end"
_SCAN = f"""{_PRINTS}, {_duck_shared("char_grams", "ch")}, {_duck_shared("token_grams", "tk")},
  ex as (select a.doc_id, b.item_id from documents_g a join benchmark_g b using (norm_sha) where a.norm_chars >= 16),
  p as (select doc_id, item_id from ch union select doc_id, item_id from tk union select doc_id, item_id from ex),
  s as (select p.doc_id, p.item_id, ex.doc_id is not null as same, coalesce(ch.both, 0) as cb, coalesce(tk.both, 0) as tb, len(a.char_grams) as c1, len(b.char_grams) as c2, len(a.token_grams) as t1, len(b.token_grams) as t2
    from p left join ch using (doc_id, item_id) left join tk using (doc_id, item_id) left join ex using (doc_id, item_id) join documents_g a on a.doc_id = p.doc_id join benchmark_g b on b.item_id = p.item_id),
  q as (select doc_id, item_id, same, case when same then 1000000 else {_PPM.format(n="cb", d="(c1 + c2 - cb)")} end as character_jaccard_ppm, case when same then 1000000 else {_PPM.format(n="cb", d="least(c1, c2)")} end as character_containment_ppm,
    case when same then 1000000 else {_PPM.format(n="tb", d="(t1 + t2 - tb)")} end as token_jaccard_ppm, case when same then 1000000 else {_PPM.format(n="tb", d="least(t1, t2)")} end as token_containment_ppm from s),
  m as materialized (select doc_id, item_id, case when same then 'exact'
      when greatest(character_jaccard_ppm, token_jaccard_ppm) >= 820000 or greatest(character_containment_ppm, token_containment_ppm) >= 920000 then 'fuzzy'
      when greatest(character_jaccard_ppm, token_jaccard_ppm) >= 770000 or greatest(character_containment_ppm, token_containment_ppm) >= 870000 then 'review' end as kind,
    character_jaccard_ppm, character_containment_ppm, token_jaccard_ppm, token_containment_ppm from q),
  matches as materialized (select * from m where kind is not null)"""


def _matches(spark, sf_dir, normal=None):
    train = fingerprints(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", normal)
    held = fingerprints(table(spark, sf_dir, "benchmark"), "item_id", "text", normal)
    return scan(train, held, "doc_id", "item_id")


@query("contamination_pairs", f"with {_SCAN} select * from matches")
def contamination_pairs(spark, sf_dir):
    return _matches(spark, sf_dir)


@query("contamination_unicode")
def contamination_unicode(spark, sf_dir):
    """The scan on the compatibility-normal form, for which SQL has no counterpart."""
    from veraline.functions.text import normalize

    return _matches(spark, sf_dir, normalize)


@query("contamination_best_match", f"""with {_SCAN}, r as (select *, greatest(character_jaccard_ppm, token_jaccard_ppm, character_containment_ppm, token_containment_ppm) as strongest_ppm from matches)
    select doc_id, item_id, kind, strongest_ppm from (select *, row_number() over (partition by doc_id order by case kind when 'exact' then 1 when 'fuzzy' then 2 else 3 end, strongest_ppm desc, item_id) as k from r) x where k = 1""")  # fmt: skip
def contamination_best(spark, sf_dir):
    return best_match(_matches(spark, sf_dir), "doc_id", "item_id")


@query("contamination_counts_zero_filled", f"with {_SCAN} select d.kind, count(m.doc_id) as n from (values ('exact'), ('fuzzy'), ('review')) d(kind) left join matches m on m.kind = d.kind group by d.kind")
def contamination_counts(spark, sf_dir):
    domain = spark.createDataFrame([("exact",), ("fuzzy",), ("review",)], "kind string")
    counts = _matches(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return domain.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_QUARANTINE = f"with recursive {_COMPONENTS}, {_SCAN}, bad as (select doc_id, component from c where component in (select component from c join matches using (doc_id)))"


def _quarantined(spark, sf_dir):
    return quarantine(materialize(_components(spark, sf_dir), "components"), materialize(_matches(spark, sf_dir), "matches"), "doc_id")


@query("quarantine_closure", f"{_QUARANTINE} select * from bad")
def quarantine_closure(spark, sf_dir):
    return _quarantined(spark, sf_dir)


@query("keep_after_quarantine", f"{_QUARANTINE} select doc_id, source, lang from documents where doc_id not in (select doc_id from bad)")
def keep_after_quarantine(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_quarantined(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")


@query("clean_and_held_union", f"with {_SCAN} select 'train' as side, doc_id as id, source as origin from documents where doc_id not in (select doc_id from matches) union all select 'eval', item_id, 'benchmark' from benchmark")
def clean_and_held_union(spark, sf_dir):
    clean = table(spark, sf_dir, "documents").join(_matches(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")
    held = table(spark, sf_dir, "benchmark").select(F.lit("eval").alias("side"), F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    return clean.select(F.lit("train").alias("side"), F.col("doc_id").alias("id"), F.col("source").alias("origin")).unionByName(held)


sql("manifest_rows", f"select f.*, source from ({_FAMILIES}) f join (select doc_id, source from documents) d using (doc_id)", f"select f.*, source from ({_DUCK_FAMILIES}) f join documents d using (doc_id)")
# a set's digest is that of its parts', by the first three digits of the members' digests, so no task gathers a whole set
_PARTS = "select source, {sha} as sha, doc_id from documents"
sql(
    "manifest_summary",
    f"""select source, cast(sum(n) as bigint) as n, cast(sum(n_content) as bigint) as n_content, min(least) as least, max(most) as most, sha2(array_join(transform(array_sort(collect_list(struct(part, part_sha))), x -> x.part_sha), ','), 256) as set_sha from (
      select source, substr(sha, 1, 3) as part, count(*) as n, count(distinct sha) as n_content, min(doc_id) as least, max(doc_id) as most, sha2(array_join(array_sort(collect_list(sha)), ','), 256) as part_sha from ({_PARTS.format(sha="sha2(text, 256)")}) x group by 1, 2) y group by source""",
    f"""select source, sum(n)::bigint as n, sum(n_content)::bigint as n_content, min(least) as least, max(most) as most, sha256(string_agg(part_sha, ',' order by part)) as set_sha from (
      select source, substr(sha, 1, 3) as part, count(*) as n, count(distinct sha) as n_content, min(doc_id) as least, max(doc_id) as most, sha256(string_agg(sha, ',' order by sha)) as part_sha from ({_PARTS.format(sha="sha256(text)")}) x group by 1, 2) y group by source""",
)

# --- fragments ---

_GROUP = "case when role = 'assistant' then 'solution' when role = 'user' then 'prompt' else 'context' end"
sql("fragments_flatten", f"select conv_id, concat('messages.', cast(turn as string), '.', role) as field, {_GROUP} as field_group, cast(length(text) as bigint) as chars from conversations", f"select conv_id, 'messages.' || turn::varchar || '.' || role as field, {_GROUP} as field_group, cast(length(text) as bigint) as chars from conversations")
sql(
    "fragment_aggregates",
    f"select conv_id, {_GROUP} as field_group, sha2(array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), ' '), 256) as joined_sha, count(*) as parts from conversations group by conv_id, {_GROUP} having count(*) >= 2",
    f"select conv_id, {_GROUP} as field_group, sha256(string_agg(text, ' ' order by turn, text)) as joined_sha, count(*) as parts from conversations group by conv_id, {_GROUP} having count(*) >= 2",
)
sql("fragment_best", f"""select conv_id, sha, field_group, turn from (
    select conv_id, sha, field_group, turn, row_number() over (partition by conv_id, sha order by case field_group when 'prompt' then 1 when 'solution' then 2 else 3 end, turn) as k
    from (select conv_id, turn, sha2(lower(text), 256) as sha, {_GROUP} as field_group from conversations) f) x where k = 1""", f"""select conv_id, sha, field_group, turn from (
    select conv_id, sha, field_group, turn, row_number() over (partition by conv_id, sha order by case field_group when 'prompt' then 1 when 'solution' then 2 else 3 end, turn) as k
    from (select conv_id, turn, sha256(lower(text)) as sha, {_GROUP} as field_group from conversations) f) x where k = 1""")  # fmt: skip


@query("ngram_token3", f"with {_duck_prints('benchmark', 'item_id')}, g as (select item_id, unnest(token_grams) as gram from benchmark_g) select gram, count(*) as items, min(item_id) as first_item from g group by gram")
def ngram_token3(spark, sf_dir):
    rows = fingerprints(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", F.explode("token_grams").alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"))


@query("ngram_char5_sizes", f"with {_duck_prints('documents', 'doc_id')} select doc_id, len(char_grams)::int as n_char, len(token_grams)::int as n_token, norm_chars::int as norm_chars from documents_g")
def ngram_char5_sizes(spark, sf_dir):
    rows = fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.size("char_grams").alias("n_char"), F.size("token_grams").alias("n_token"), "norm_chars")


# --- lineage: an order line's parent is its order, else an outside ledger of customers ---

sql("lineage_parent_check", """
    select l_orderkey, l_linenumber, case when o_orderkey is not null then 'record' when c_custkey is not null then 'ledger' else 'missing' end as parent, coalesce(o_custkey, c_custkey) as owner, count(*) as n
    from lineitem left join (select o_orderkey, o_custkey from orders) o on l_partkey = o_orderkey left join (select c_custkey from customer) c on l_partkey = c_custkey
    group by 1, 2, 3, 4""")  # fmt: skip
sql("lineage_cross_split", """
    select l_orderkey, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_suppkey % 2 <> o_custkey % 2 group by l_orderkey""")  # fmt: skip

# every order's parent: mostly a smaller key, now and then a later one, so that some lines close
_EDGES = "select o_orderkey as child, case when o_orderkey % 11 = 0 then (o_orderkey * 7) % (select max(o_orderkey) from orders) else o_orderkey div 2 end as parent from orders"


def peel_cycles(edges, child: str = "child", parent: str = "parent"):
    """Edges whose parent is on a cycle or below one: from it parents go on for ever.

    Edges to what has no parent are taken off again and again; in the same round an edge
    to a node of one parent is moved to that parent, which ends where it ends.  So a
    chain of any length is gone after a logarithmic number of rounds.
    """
    every = materialize(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct(), "lineage")
    left, n = every, every.count()
    while n:
        nodes = materialize(left.groupBy("c").agg(F.count("*").alias("k"), F.min("p").alias("q")), "lineage-nodes")
        met = left.join(nodes.select(F.col("c").alias("p"), F.col("k"), F.col("q")), "p")
        kept = met.count()
        moved = materialize(met.select("c", F.when(F.col("k") == 1, F.col("q")).otherwise(F.col("p")).alias("p")).distinct(), "lineage")
        if left is not every:
            discard(left)
        discard(nodes)
        before, left = n, moved
        n = left.count()
        if kept == before:
            break
    return every.join(left.select(F.col("c").alias("p")).distinct(), "p", "left_semi").select(F.col("c").alias(child), F.col("p").alias(parent))


@query("lineage_cycle", f"""with recursive e as materialized (select * from ({_EDGES.replace(" div ", " // ")}) x),
    up(node, ancestor) as (select child, parent from e union select up.node, e.parent from up join e on e.child = up.ancestor),
    looped as (select distinct node from up where node = ancestor) select distinct child, parent from e where parent in (select node from looped union select u.node from up u where u.ancestor in (select node from looped))""")  # fmt: skip
def lineage_cycle(spark, sf_dir):
    return peel_cycles(run_sql(spark, sf_dir, _EDGES))


