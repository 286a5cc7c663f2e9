"""Operators on small rows whose results are known."""

import hashlib
import random
import re
from fractions import Fraction
from itertools import product
from math import comb
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.functions.text import digest_mod, is_nfc, ngrams, normal_form, normalize, ppm_half_even, ppm_half_up, seed63, sha
from veraline.functions import canonical
from veraline.functions.canonical import canonical_json, set_digest
from veraline.operators import contamination
from veraline.operators.accounting import budget_prefix, entropy, first_eos_mask, group_advantages, interpolate, ledger, nll, reverse_kl
from veraline.operators.contamination import best_match, family_components, fingerprints, hashed_grams, quarantine, scan
from veraline.operators.graph import connected_components
from veraline.operators.ordering import keyed_totals, running_totals
from veraline.operators.resampling import decimal_text, exhaustive_sign_flip, holm, resampled_totals, type7_quantile
from veraline.plans.registry import ORACLE_SQL, QUERIES
from veraline.plans.store import setting
from veraline.plans.trust import peel_cycles
from veraline.sources.jsonl import fault_of, read_records, write_records
from veraline.streaming.ledger import stream_ledger

# The family graph of the reference's fixture: two hits spread over shared source, problem and template.
FAMILIES = [
    ("train:000", "sf:exact-linked", "pf:exact-copy", "tf:arithmetic-00"), ("train:001", "sf:exact-linked", "pf:safe-relative-01", "tf:geometry-01"), ("train:002", "sf:fuzzy-02", "pf:fuzzy-linked", "tf:commerce-02"),
    ("train:003", "sf:safe-03", "pf:fuzzy-linked", "tf:fuzzy-bridge"), ("train:004", "sf:safe-04", "pf:safe-04", "tf:fuzzy-bridge"), ("train:005", "sf:trace-copy-05", "pf:trace-copy-05", "tf:inequality-05"),
    *((f"train:{k:03}", f"sf:{k}", f"pf:{k}", f"tf:{k}") for k in range(6, 15)),
]


def test_components_and_quarantine(spark):
    rows = spark.createDataFrame(FAMILIES, "id string, source string, problem string, template string")
    for shuffled in (rows, rows.orderBy(F.rand(3)).repartition(5)):
        found = family_components(shuffled, "id", ["source", "problem", "template"])
        assert found.select("component").distinct().count() == 12
        hits = spark.createDataFrame([("train:000",), ("train:002",), ("train:005",)], "id string")
        assert sorted(r.id for r in quarantine(found, hits, "id").collect()) == [f"train:{k:03}" for k in range(6)]


def test_components_of_chains_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 300), (300, 200), (None, 5)] + [(400 + rng.randrange(9), 400 + rng.randrange(9)) for _ in range(20)]
    found = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {found[i] for i in range(61)} == {0} and found[100] == 100 and found[300] == 200 and 5 in found
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_running_totals_over_partitions(spark):
    rows = spark.createDataFrame([((k * 7919) % 1000, k % 13) for k in range(1000)] + [(None, None)], "id long, w long")
    got = sorted(running_totals(rows, ["id"], {"before": "w"}).collect(), key=lambda r: r.position)
    total = 0
    assert [r.id for r in got] == [None, *range(1000)]
    for k, r in enumerate(got):
        assert (r.position, r.before) == (k, total)
        total += r.w or 0


@pytest.mark.parametrize(
    ("train", "held", "kind"),
    [
        ("Find all integers n such that n squared plus three", "FIND ALL INTEGERS N such that n squared plus three", "exact"),
        ("A shop sells twelve red pens for six dollars; find the price of one pen.", "A shop sells twelve red pens for six dollars; find the price of one pen today", "fuzzy"),
        ("We first restate it. Prove that x squared plus one is positive for all reals. Done.", "Prove that x squared plus one is positive for all reals.", "fuzzy"),
        ("An unrelated statement about triangles and their many angles.", "Prove that x squared plus one is positive for all reals.", None),
        ("short text", "short text", None),
    ],
)
def test_contamination_kinds(spark, train, held, kind):
    a, b = (fingerprints(spark.createDataFrame([(1, t)], f"{k} int, text string"), k, "text", normalize) for k, t in (("t", train), ("e", held)))
    found = scan(a, b, "t", "e").collect()
    assert [r.kind for r in found] == ([kind] if kind else [])
    assert all("text" not in r.asDict() and "norm" not in r.asDict() for r in found)


def plain_grams(norm):
    chars, tokens = norm.replace(" ", ""), norm.split(" ")
    runs = lambda x, n: {x} if len(x) < n else {x[i : i + n] for i in range(len(x) - n + 1)}
    return runs(chars, 5), runs(tuple(tokens), 3)


def plain_scan(train, held):
    """Every pair against every other in plain Python, on the compatibility-normal form."""
    out = {}
    prints = [{k: (normal_form(t), *plain_grams(normal_form(t))) for k, t in side.items() if t and normal_form(t)} for side in (train, held)]
    ppm = lambda n, d: round(Fraction(n * 1_000_000, d)) if d else 0
    for a, (na, *ga) in prints[0].items():
        for b, (nb, *gb) in prints[1].items():
            if na == nb and len(na) >= 16:
                out[a, b] = ("exact", 1_000_000, 1_000_000, 1_000_000, 1_000_000)
            elif min(len(na), len(nb)) >= 32:
                s = []
                for x, y in zip(ga, gb, strict=True):
                    s += [ppm(len(x & y), len(x | y)), ppm(len(x & y), min(len(x), len(y)))]
                jaccard, containment = max(s[0], s[2]), max(s[1], s[3])
                kind = "fuzzy" if jaccard >= 820_000 or containment >= 920_000 else "review" if jaccard >= 770_000 or containment >= 870_000 else None
                if kind:
                    out[a, b] = (kind, *s)
    return out


@pytest.mark.parametrize("held_chars", [4_000_000, 0])
def test_contamination_equals_a_plain_scan(spark, monkeypatch, held_chars):
    """Both plans, over documents that are longer and shorter than the benchmark items, and edited copies of these."""
    from veraline.operators import contamination

    monkeypatch.setattr(contamination, "HELD_CHARS", held_chars)
    rng = random.Random(4)
    folder = "/root/testdata/sf0.001"
    held = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    train = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.doc_id % 2 or len(r.text) < 500}
    for k in range(150):
        words = held[rng.choice(sorted(held))].split()
        for _ in range(rng.randrange(len(words) // 5 + 1)):
            words[rng.randrange(len(words))] = rng.choice(["other", "Ｗｉｄｅ", "1,000", "\\dfrac", ""])
        a = rng.randrange(len(words) // 3 + 1)
        train[10_000 + k] = " ".join(rng.choice(["", "before it "]) .split() + words[a : len(words) - rng.randrange(3)])
    train |= {20_000: None, 20_001: "", 20_002: " ".join(["same"] * 40)}
    held |= {9_000: " ".join(["same"] * 44), 9_001: None}
    frames = [fingerprints(spark.createDataFrame(list(x.items()), f"{k} long, text string"), k, "text", normalize) for k, x in (("t", train), ("e", held))]
    got = {(r.t, r.e): (r.kind, r.character_jaccard_ppm, r.character_containment_ppm, r.token_jaccard_ppm, r.token_containment_ppm) for r in scan(*frames, "t", "e").collect()}
    want = plain_scan(train, held)
    assert got == want and {k for k, *_ in want.values()} == {"exact", "fuzzy", "review"}


def test_best_match_prefers_kind_then_score(spark):
    rows = [(1, 5, "fuzzy", 900_000), (1, 4, "review", 999_999), (1, 3, "fuzzy", 950_000), (1, 2, "fuzzy", 950_000)]
    frame = spark.createDataFrame(rows, "t int, e int, kind string, character_jaccard_ppm long").withColumns({c: F.lit(0).cast("long") for c in ("character_containment_ppm", "token_jaccard_ppm", "token_containment_ppm")})
    assert tuple(best_match(frame, "t", "e").first()) == (1, 2, "fuzzy", 950_000)


def test_normal_form():
    assert normal_form("\\dfrac{1}{2}  − 1,234.5\\, ＡＢ Straße") == "\\frac { 1 } { 2 } - 1234.5 ab strasse"


def test_text_columns(spark):
    frame = spark.createDataFrame([("abc",)], "t string")
    digest = frame.select(sha(F.col("t")).alias("d")).first().d
    row = frame.select(digest_mod(sha(F.col("t")), 1009).alias("m"), seed63(sha(F.col("t"))).alias("s"), is_nfc("t").alias("n"), ngrams(F.split("t", ""), 2).alias("g"), ngrams(F.array(F.lit("x")), 3).alias("h"), ngrams(F.array().cast("array<string>"), 3).alias("z")).first()
    assert (row.m, row.s) == (int(digest, 16) % 1009, int(digest[:16], 16) & (2**63 - 1))
    assert row.n and row.h == ["x"] and row.z == [] and row.g[:2] == ["a\x1fb", "b\x1fc"]
    ppm = spark.range(1).select(ppm_half_up(F.lit(1), F.lit(3)).alias("a"), ppm_half_even(F.lit(1), F.lit(0)).alias("b"), ppm_half_up(F.lit(-1), F.lit(2)).alias("c")).first()
    assert tuple(ppm) == (333_333, 0, -500_000)


def test_cycles_are_what_peeling_leaves(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "g")], "child string, parent string")
    assert sorted(tuple(r) for r in peel_cycles(edges).select("child", "parent").collect()) == [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]


def test_cycles_below_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i + 1) for i in range(300)] + [(1300, 1290), (5, 1000), (7000, 7000)]
    got = {tuple(r) for r in peel_cycles(spark.createDataFrame(chain, "child long, parent long")).collect()}
    assert got == {(1000 + i, 1001 + i) for i in range(300)} | {(1300, 1290), (5, 1000), (7000, 7000)} | {(i, i + 1) for i in range(5)}
    assert peel_cycles(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_canonical_json_is_that_of_python(spark):
    import hashlib
    import json

    schema = "id long, s string, b boolean, d double, a array<string>, m map<string,boolean>, n struct<z:int,y:array<struct<q:string,p:long>>>"
    rows = [(1, "a\"\\\n\x01é\x1f/\x7f", True, 1e-05, ["x", None], {"b": None, "a": True}, (1, [("u", 2), (None, None)])), (2, None, None, 1e16, None, None, None), (3, "", False, 0.1, [], {}, (None, []))]
    frame = spark.createDataFrame(rows, schema)
    made = frame.select("id", canonical_json(F.struct(*frame.columns), frame.schema).alias("j")).collect()
    for r in made:
        own = next(x for x in frame.collect() if x.id == r.id).asDict(True)
        assert r.j == json.dumps(own, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    digest = set_digest(frame, "id", "s").first()
    want = json.dumps([[x[0], x[1]] for x in rows], ensure_ascii=False, separators=(",", ":"))
    assert (digest.digest, digest.n) == (hashlib.sha256(want.encode()).hexdigest(), 3)
    assert set_digest(frame.limit(0), "id", "s").first().digest == hashlib.sha256(b"[]").hexdigest()
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(float("nan"),)], "d double").select(canonical_json(F.col("d"), T.DoubleType())).collect()
    with pytest.raises(TypeError):
        canonical_json(F.col("x"), T.ArrayType(T.DoubleType()))


def test_record_set_digest_is_of_the_whole_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(canonical, "HELD_BYTES", 100)
    texts = [None if k == 9 else f"é{k}" for k in range(230)]
    spark.createDataFrame([((k * 77) % 230, texts[(k * 77) % 230]) for k in range(230)], "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [f'[{k},"{hashlib.sha256(t.encode()).hexdigest()}"]' for k, t in enumerate(texts) if t is not None]
    want = (hashlib.sha256(f"[{','.join(pairs)}]".encode()).hexdigest(), 230)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "7"):
        assert tuple(QUERIES["record_set_digest"](spark, str(tmp_path)).first()) == want
    with duckdb.connect() as duck:
        duck.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
        assert duck.execute(ORACLE_SQL["record_set_digest"]).fetchone() == want
    monkeypatch.setattr(canonical, "MOST_LISTED", 229)
    with pytest.raises(Exception, match="more than 229 rows"):
        QUERIES["record_set_digest"](spark, str(tmp_path))


def test_interpolation_and_keyed_totals(spark):
    points = spark.createDataFrame([("a", x, float(x * x)) for x in range(0, 1001, 7)] + [("b", 5, 1.0), ("b", 25, 3.0)], "c string, x long, y double")
    got = {(r.c, r.x): r.y for r in interpolate(points, "c", "x", "y", 10).collect()}
    xs = np.array(range(0, 1001, 7))
    assert all(abs(got["a", x] - np.interp(x, xs, xs.astype(float) ** 2)) < 1e-6 for x in range(0, 1000, 99)) and got["b", 15] == 2.0
    rows = spark.createDataFrame([("k" if i % 3 else None, i, i % 5) for i in range(300)], "k string, i long, w long")
    own = sorted(keyed_totals(rows, "k", ["i"], {"before": "w"}).collect(), key=lambda r: r.i)
    for key in ("k", None):
        total = 0
        for n, r in enumerate(x for x in own if x.k == key):
            assert (r.position, r.before) == (n, total)
            total += r.w
    with pytest.raises(ValueError, match="already"):
        running_totals(rows.withColumn("Position", F.lit(1)), ["i"], {"before": "w"})


def test_fractions_are_rounded_once(spark):
    from veraline.operators.evaluation import mean_of_fractions, pass_at_k_ppm

    # halves that doubles or billionths put on the wrong side, and denominators of many digits
    rows = [("half", 1, 2_000_000), ("half", 0, 7), ("long", 1, 2**61 - 1), ("long", 10**17, 3 * 10**17 + 1), *(("many", k, 997 + k) for k in range(400)), ("same", 1, 3), ("same", 1, 3), ("same", 2, 6)]
    got = {r.k: r.ppm for r in mean_of_fractions(spark.createDataFrame(rows, "k string, a long, b long"), "k", "a", "b").collect()}
    for key in {r[0] for r in rows}:
        own = [Fraction(a, b) for k, a, b in rows if k == key]
        mean = sum(own) / len(own) * 1_000_000
        assert got[key] == (2 * mean.numerator + mean.denominator) // (2 * mean.denominator), key
    counts = [(n, c) for n in (1, 5, 64, 1024, 4096) for c in (0, 1, n // 2, n)] + [(None, 1), (3, None)]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(counts)], "i int, n long, c long")
    for r in pass_at_k_ppm(frame, "n", "c", (1, 8, 100)).collect():
        for k in (1, 8, 100):
            if r.n is None or r.c is None or r.n < k:
                assert r[f"pass_at_{k}"] is None
            else:
                exact = (1 - Fraction(comb(r.n - r.c, k), comb(r.n, k))) * 1_000_000
                assert r[f"pass_at_{k}"] == (2 * exact.numerator + exact.denominator) // (2 * exact.denominator)


def test_resampling_is_what_plain_draws_give(spark):
    import hashlib

    units = [(7 * k) % 11 - 5 for k in range(300)]
    frame = spark.createDataFrame(list(enumerate(units)), "item long, u long")
    digest = lambda seed, rep, block: hashlib.sha256(f"{seed}:{rep}:{block}".encode()).hexdigest()
    draw = lambda seed, rep, k: int(digest(seed, rep, k // 5)[12 * (k % 5) :][:12], 16)
    sign = lambda seed, rep, k: bin(int(digest(seed, rep, k // 256), 16))[2:].zfill(256)[k % 256] == "1"
    boot = {r.rep: r.total for r in resampled_totals(frame, "item", "u", 40, "s", "bootstrap").collect()}
    assert boot == {rep: sum(units[draw("s", rep, k) % 300] for k in range(300)) for rep in range(40)}
    signs = {r.rep: r.total for r in resampled_totals(frame, "item", "u", 40, "s", "signs").collect()}
    assert signs == {rep: sum(u if sign("s", rep, k) else -u for k, u in enumerate(units)) for rep in range(40)}
    few = units[:9]
    totals = [sum(u if mask >> k & 1 else -u for k, u in enumerate(few)) for mask in range(512)]
    assert tuple(exhaustive_sign_flip(frame.where("item < 9"), "item", "u").first()) == (sum(t >= sum(few) for t in totals), 512)
    many = spark.createDataFrame([(i, 1) for i in range(70)], "item long, u long")
    assert exhaustive_sign_flip(many, "item", "u").first().flips == str(2**70)


# --- statistics ---


def test_scan_gets_small_batches_of_texts(spark):
    rows = spark.range(2000, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.format_string("text %s of some length that is long enough to be counted", "id").alias("text"))
    wide = T.StructType([T.StructField("n", T.LongType())])
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "64m"):
        matches = scan(fingerprints(rows, "id", "text", normalize), fingerprints(rows.where("id < 3").withColumnRenamed("id", "item"), "item", "text", normalize), "id", "item")
        assert {(r.id, r.item) for r in matches.where("kind = 'exact'").collect()} == {(str(k), str(k)) for k in range(3)}
        sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([{"n": b.num_rows}]) for b in batches), wide).collect()]
        assert sum(sizes) == 2000 and max(sizes) <= 500
        assert {(r.id, r.item) for r in best_match(matches, "id", "item").where("kind = 'exact'").collect()} == {(str(k), str(k)) for k in range(3)}


def test_a_worker_of_the_scan_remembers_no_long_tokens():
    known = {}
    for k in range(200):
        norm = " ".join([f"{k}x{i}" * 500 for i in range(5)] + ["short", "ones", f"k{k}"])
        kept, alone = hashed_grams(norm, known), hashed_grams(norm, {})
        assert all((a == b).all() for a, b in zip(kept, alone, strict=True))
    assert {"short", "ones", "k0", "k199"} <= set(known) and sum(map(len, known)) < 2000


def test_pairs_of_one_batch_leave_a_worker_in_pieces(spark, monkeypatch):
    def small(batch):
        if batch.num_rows > 20_100:
            raise ValueError(f"{batch.num_rows} pairs at once")
        return batch

    monkeypatch.setattr(contamination, "tidy", lambda run: lambda batches: (small(b) for b in run(batches)))
    rows = lambda key, n: fingerprints(spark.range(0, n, 1, 1).select(F.col("id").alias(key), F.lit("one text that many records on both sides share").alias("text")), key, "text")
    matches = scan(rows("id", 300), rows("item", 100), "id", "item")
    assert matches.where("kind = 'exact'").select("id", "item").distinct().count() == matches.count() == 30_000
    assert {tuple(r) for r in best_match(matches, "id", "item").select("id", "item").collect()} == {(k, 0) for k in range(300)}


def test_exact_sign_flip_and_quantile(spark):
    units = spark.createDataFrame([(k, 3) for k in range(8)], "item int, u int")
    assert tuple(exhaustive_sign_flip(units, "item", "u").first()) == (1, 256)
    rng = np.random.default_rng(1)
    values = rng.integers(-3, 4, 10)
    masks = (np.arange(1024)[:, None] >> np.arange(10)) & 1
    want = int((((1 - 2 * masks) * values).sum(axis=1) >= values.sum()).sum())
    assert exhaustive_sign_flip(spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "item int, u int"), "item", "u").first().extreme == want
    rows = spark.createDataFrame([(1, v) for v in (1, 2, 4, 10)], "g int, v long")
    assert type7_quantile(rows, ["g"], "v", {"q": (25, 1000)}).first().q == pytest.approx(float(Fraction(43, 40)))


def test_exact_sign_flip_of_many_items(spark):
    n = 15_000
    got = exhaustive_sign_flip(spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("u")), "id", "u").first()
    assert (got.extreme, got.flips) == tuple(decimal_text(x) for x in ((2**n + comb(n, n // 2)) // 2, 2**n))
    rng = random.Random(5)
    for _ in range(6):
        units = [rng.choice((-5, -2, -1, 0, 1, 3)) for _ in range(rng.randrange(1, 15))]
        totals = [sum(x) for x in product(*((-u, u) for u in units))]
        frame = spark.createDataFrame(list(enumerate(units)), "item int, u int").coalesce(1)
        assert tuple(exhaustive_sign_flip(frame, "item", "u").first()) == (sum(t >= sum(units) for t in totals), len(totals)), units
    assert decimal_text(-(10**9000) - 7) == "-1" + "7".zfill(9000)


def test_holm(spark):
    got = {r.h: r.adjusted for r in holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "h string, p double"), "h", "p").collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n), st.integers(1, n))))
def test_pass_at_k_product_form(x):
    n, c, k = x
    product = 1.0
    for i in range(n - c + 1, n + 1):
        product *= 1 - k / i
    assert (1.0 if n - c < k else 1 - product) == pytest.approx(1 - comb(n - c, k) / comb(n, k))


# --- accounting ---


def test_masks_and_losses(spark):
    row = spark.createDataFrame([([5, 6, 0, 7, 0],)], "ids array<int>").select(first_eos_mask(F.col("ids"), 0).alias("a"), first_eos_mask(F.col("ids"), 0, include=False).alias("b"), first_eos_mask(F.col("ids"), 9).alias("c")).first()
    assert (row.a, row.b, row.c) == ([1, 1, 1, 0, 0], [1, 1, 0, 0, 0], [1] * 5)
    rng = np.random.default_rng(2)
    s, t = rng.standard_normal(6) * 30, rng.standard_normal(6) * 30
    p, q = (np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in (s, t))
    got = spark.createDataFrame([(s.tolist(), t.tolist())], "s array<double>, t array<double>").select(nll(F.col("s"), F.lit(2)), entropy(F.col("s")), reverse_kl(F.col("s"), F.col("t"))).first()
    assert list(got) == pytest.approx([-np.log(p[2]), -(p * np.log(p)).sum(), (p * np.log(p / q)).sum()])


def test_advantages_and_budgets(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (2, 1)], "g int, r int")
    got = {(x.g, x.r): (x.active, x.advantage) for x in group_advantages(rows, "g", "r").collect()}
    mean, sd = 2 / 3, np.std([0, 1, 1], ddof=1)
    assert got[(1, 0)] == (True, pytest.approx(-mean / (sd + 1e-4))) and got[(2, 1)] == (False, 0.0)
    kept = {r.id: r.kept for r in budget_prefix(spark.createDataFrame([(k, 10) for k in range(6)], "id int, n long"), ["id"], "n", 35).collect()}
    assert kept == {0: 10, 1: 10, 2: 10, 3: 5, 4: 0, 5: 0}


ATTEMPTS = [(1, 1, 40, True), (1, 2, 40, False), (1, 3, 40, True), (1, 4, 40, True), (2, 5, 7, True)]


def test_ledger_batch_and_stream_agree(spark, tmp_path):
    schema = "stage long, event_id long, candidate long, executed boolean"
    batch = spark.createDataFrame(ATTEMPTS, schema)
    want = sorted((r.event_id, r.counted, r.consumed_after) for r in ledger(batch, "stage", ["event_id"], "candidate", "executed", 100).collect())
    assert want == [(1, 40, 40), (2, 0, 40), (3, 40, 80), (4, 20, 100), (5, 7, 7)]
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100)
    q = stream.writeStream.format("memory").queryName("ledger_out").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_id, r.counted, r.consumed_after) for r in spark.table("ledger_out").collect()) == want


# --- sources ---


@pytest.mark.parametrize(
    ("line", "fault"),
    [('{"a":1}', None), ('{"a":1,"a":2}', "duplicate_key"), ('{"a":NaN}', "not_finite"), ("[1]", "not_an_object"), ('{"b":1}', "wrong_keys"), ("", "blank"), ("{", "not_json"), ('{"a":"é"}', "not_nfc"), ('﻿{"a":1}', "bad_character")],
)
def test_line_faults(line, fault):
    assert fault_of(line, frozenset("a")) == fault


def test_strict_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":2}\n{"a":NaN}\n')
    records, bad = read_records(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())]), "a")
    assert sorted(r.a for r in records.collect()) == [1, 2, 2]
    assert sorted(r.rule for r in bad.collect()) == ["not_finite", "repeated_key"]
    one = write_records(records, str(tmp_path / "out1"), "a")
    assert one == write_records(records.repartition(3), str(tmp_path / "out2"), "a") and re.fullmatch("[0-9a-f]{64}", one)


def test_nothing_outside_llm_needs_it():
    root = Path(__file__).resolve().parent.parent / "veraline"
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "veraline.llm" not in p.read_text()
