"""Merkle fixity audit of WARC copies.

Every record is hashed where it lies; only (position, offsets, hash) rows are
dealt out.  Leaves are the records in archive order with their offset ranges; a node
is the hash of up to FANOUT ordered children and their lengths and covers their whole
range.  Two copies are compared at the root, and below it only nodes under a mismatch
are joined, so an intact copy costs one comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.operators.ordering import running_totals
from veraline.plans.store import discard, materialize

FANOUT = 16
NODE = ["position", "first_byte", "past_byte", "hash"]
FOUND = "position long, first_byte long, past_byte long, fault string, expected string, found string"


def record(url: Column, html: Column) -> Column:
    """A WARC response record as text; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, first_byte, past_byte, hash) of all pages in the order of page_id, url and content hash.

    A table in the shared folder; contents don't travel.  Null ids and urls come
    first; equal rows are records of their own.
    """
    text = record(F.col("url"), F.col("html"))
    leaf = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(text, 256).alias("hash"), F.octet_length(text).cast("long").alias("size"))
    out = running_totals(leaf, ["page_id", "url", "hash"], {"first_byte": "size"}, "archive")
    return out.select("page_id", "url", "position", "first_byte", (F.col("first_byte") + F.col("size")).alias("past_byte"), "hash")


def _parents(nodes: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("position", (F.col("past_byte") - F.col("first_byte")).alias("size"), "hash")))
    said = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["position"].cast("string"), c["size"].cast("string"), c["hash"])), "|")
    grouped = nodes.groupBy(F.floor(F.col("position") / FANOUT).alias("position"))  # FANOUT children at most
    return grouped.agg(F.min("first_byte").alias("first_byte"), F.max("past_byte").alias("past_byte"), F.sha2(said, 256).alias("hash"))


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The levels from the leaves to the root, each a table in the shared folder."""
    out = [leaves.select(NODE)]
    for level in range(levels):
        out.append(materialize(_parents(out[-1]), f"merkle-{level + 1}"))
    return out


def levels_over(records: int) -> int:
    n = 0
    while records > 1:
        records, n = -(-records // FANOUT), n + 1
    return n


def _mismatches(mine: DataFrame, other: DataFrame) -> DataFrame:
    a, b = mine.select("position", F.col("hash").alias("a")), other.select("position", F.col("hash").alias("b"))
    return a.join(b, "position", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("position")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records: position, first_byte, past_byte (null if only the replica has it), fault, expected, found.

    Both sides have NODE columns, one row per position.  Faults: missing, extra,
    length, content.  Empty copies are equal.
    """
    tall = primary.agg(F.max("position")).first()[0], replica.agg(F.max("position")).first()[0]
    levels = levels_over(1 + max((-1 if x is None else x) for x in tall))
    mine, other = tree(primary, levels), tree(replica, levels)
    bad = materialize(_mismatches(mine[levels], other[levels]), "mismatch")
    if not bad.limit(1).count():  # the roots agree: nothing below is read
        discard(bad, *mine[1:], *other[1:])
        return primary.sparkSession.createDataFrame([], FOUND)
    for level in range(levels - 1, -1, -1):
        above = bad.withColumnRenamed("position", "parent")
        under = [t[level].withColumn("parent", F.floor(F.col("position") / FANOUT)).join(above, "parent", "left_semi") for t in (mine, other)]
        below = materialize(_mismatches(*under), "mismatch")
        discard(bad, mine[level + 1], other[level + 1])
        bad = below
    a = mine[0].select("position", "first_byte", "past_byte", F.col("hash").alias("expected"))
    b = other[0].select("position", (F.col("past_byte") - F.col("first_byte")).alias("size"), F.col("hash").alias("found"))
    seen = bad.join(a, "position", "left").join(b, "position", "left")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("size") != F.col("past_byte") - F.col("first_byte"), "length").otherwise("content")
    return seen.select("position", "first_byte", "past_byte", fault.alias("fault"), "expected", "found")


def damaged_copy(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, was): a replica with known faults by page_id: a first character changed, a line added, the record gone."""
    i, html = F.col("page_id"), F.col("html")
    kept = pages.select(i.cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha2(record(F.col("url"), html), 256).alias("was"))
    changed = F.when(i % 101 == 7, F.concat(F.lit("#"), F.substring(html, 2, 2**31 - 1))).when(i % 211 == 5, F.concat(html, F.lit("\n"))).otherwise(html)
    return kept.where(~F.coalesce(i % 307 == 11, F.lit(False))).withColumn("html", changed)


def audit_copy(pages: DataFrame) -> DataFrame:
    """The audit of damaged_copy() against the pages' archive, with the page_id and url that the archive has.

    The replica's records stand where the archive's index puts them; equal rows are
    records of their own on both sides.  A null page_id is never damaged.
    """
    mine = archive(pages)
    copy = damaged_copy(pages)
    text = record(F.col("url"), F.col("html"))
    copy = copy.select("page_id", "url", "was", F.sha2(text, 256).alias("now"), F.octet_length(text).cast("long").alias("size")).dropDuplicates()
    index = mine.select("position", "first_byte", "hash", F.col("page_id").alias("p"), F.col("url").alias("u"))
    replica = copy.join(index, copy["page_id"].eqNullSafe(index["p"]) & copy["url"].eqNullSafe(index["u"]) & (copy["was"] == index["hash"]))
    replica = replica.select("position", "first_byte", (F.col("first_byte") + F.col("size")).alias("past_byte"), F.col("now").alias("hash"))
    found = audit(mine, materialize(replica, "replica"))
    return found.join(mine.select("position", "page_id", "url"), "position").select("page_id", "url", "position", "first_byte", "past_byte", "fault", "expected", "found")


AUDIT_SQL = """
with said as (
  select page_id, url, html,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' as head,
    chr(13) || chr(10) as nl,
    case when page_id % 101 = 7 then '#' || substr(html, 2) when page_id % 211 = 5 then html || chr(10) else html end as now
  from pages
), texts as (
  select *, head || strlen(coalesce(html, ''))::varchar || nl || nl || coalesce(html, '') || nl || nl as a, head || strlen(coalesce(now, ''))::varchar || nl || nl || coalesce(now, '') || nl || nl as b from said
), placed as (
  select page_id, url, a, b, row_number() over w - 1 as position, coalesce(sum(strlen(a)) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as first_byte
  from texts window w as (order by page_id nulls first, url nulls first, sha256(a))
)
select page_id, url, position, first_byte, (first_byte + strlen(a))::bigint as past_byte,
  case when page_id % 307 = 11 then 'missing' when strlen(a) <> strlen(b) then 'length' else 'content' end as fault,
  sha256(a) as expected, case when page_id % 307 = 11 then null else sha256(b) end as found
from placed where page_id % 307 = 11 or a <> b
"""
