"""Operators 11 to 13 against brute-force versions, and their defined results at the edges."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from veraline.llm import chunks, queries, runs, whitening
from veraline.llm.common import tokenizer_path

DOCS = "doc_id long, text string, n_words string, RUNS string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (None, " \t\n "), (4, "one"), (5, "a  b   c \n d\n\n e"), (6, LONG), (7, "x y " * 50), (7, "x y " * 50), (None, "z " * 9), (8, " a   "), (9, "ab " * 40_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], DOCS)


# --- 11: runs ---


def slow_runs(w, exponent, least):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            part = w[start : start + size]
            if size >= max(least, exponent * q) and all(any(part[k] != part[k + r] for k in range(size - r)) for r in range(1, q)):
                out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    for trial in range(400):
        texts = []
        for _ in range(rng.randrange(0, 6)):
            n, kinds = rng.randrange(0, 90), rng.choice([1, 2, 3, 8])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(2, 9)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        exponent = rng.choice([2, 3, 4])
        runs.FEW = rng.choice([0, 16])
        got = [[] for _ in texts]
        for text, *run in zip(*(x.tolist() for x in runs.runs_of(np.array(sum(texts, []), np.int64), [len(t) for t in texts], exponent, 6))):
            got[text].append(tuple(run))
        runs.FEW = 16
        assert got == [slow_runs(t, exponent, 6) for t in texts]


def contract_11(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    number = {}
    found = slow_runs([number.setdefault(x, len(number)) for x in w], 4, 6)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    milli = None if not found else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _key(row):
    return tuple((x is None, x) for x in row)


def test_runs_query_on_tables(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["la", "lo", "lu, "]) for _ in range(rng.randrange(120)))) for i in range(400)]
    rows += [(i, t) for i, t in EDGES if t not in (LONG, EDGES[-1][1])]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=_key) == sorted((contract_11(*r) for r in rows), key=_key)
    assert any(r[1] for r in got)


def test_runs_edges_and_long_texts(spark):
    got = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(docs(spark, EDGES)).collect()}
    assert got[(9, 40_000)].collapsed == "ab" and [tuple(x) for x in got[(9, 40_000)].runs] == [(0, 40_000, 1)]
    assert got[(6, 30_000)].runs == [] and got[(6, 30_000)].collapsed == LONG
    assert got[(1, 0)].collapsed == "" and got[(None, 0)].runs == []
    assert got[(None, 9)].collapsed == "z" and got[(7, 100)].collapsed == "x y"
    assert got[(8, 2)].collapsed == " a   "
    assert runs.periodic_runs(docs(spark, [])).collect() == []
    assert runs.digests(runs.periodic_runs(runs.with_planted_periods(docs(spark, [])))).collect() == []


# --- 12: whitening ---


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "mine") for i, v in rows], "vec_id long, embedding array<float>, label int, x string")


def check_whitened(rows, got, tolerance=1e-8):
    used = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, np.floor(256 * v).astype(int)) for i, v in used]
    fit = np.array(sorted({tuple(v.tolist()) for _, v in x}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    rank = min(4, int((values > 1e-9 * values[0]).sum()))
    want = {}
    for i, v in x:
        deviation = sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums))
        for k in range(rank):
            want.setdefault((i, k + 1), []).append((n, deviation, abs((v - sums / n) @ directions[:, k] / np.sqrt(values[k])), values[k] / values.sum()))
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        near = [w for w in want[(r.vec_id, r.component)] if w[:2] == (r.n, r.deviation) and abs(w[2] - abs(r.whitened)) <= tolerance and abs(w[3] - r.explained) <= 1e-10]
        assert near, (r, want[(r.vec_id, r.component)])
    assert all(r.identity_error <= 1e-9 for r in got)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 24)) * np.linspace(3, 0.1, 24) + 2
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(i + 1000, base[7].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (None, base[3].tolist()), (5, base[9].tolist())]
    check_whitened(rows, whitening.whiten(vectors(spark, rows)).collect())


def test_whitening_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    table = pq.read_table(f"{folder}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    check_whitened(rows, queries.op12_lanczos_whitening(spark, folder).collect(), 1e-7)


@pytest.mark.parametrize("rank", [1, 2, 3])
def test_whitening_of_few_directions(spark, rank):
    """The first block closes the space; directions without variance give no rows."""
    rng = np.random.default_rng(rank)
    base = (rng.integers(-5, 6, (60, rank)) @ rng.integers(-4, 5, (rank, 12))).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == set(range(1, rank + 1))
    check_whitened(rows, got)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])])).collect() == []
    two = [(1, [0.0, 1.0]), (2, [1.0, 1.0])]
    got = whitening.whiten(vectors(spark, [*two, (3, [1.0, 2.0, 3.0]), (4, [4.0, 1.0, -0.001])])).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert {r.n for r in got} == {2}
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None}


def test_lanczos_passes_and_breakdowns():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    spectrum = np.concatenate([[50, 40, 39.9999, 30], np.geomspace(10, 1e-6, 116)])
    v = q @ np.diag(spectrum) @ q.T
    values, found, passes = whitening.leading_pairs(lambda x: v @ x, 120, 4)
    assert np.allclose(values, spectrum[:4], rtol=1e-12) and np.abs(np.abs(q[:, :4].T @ found) - np.eye(4)).max() < 1e-7
    assert passes <= 15
    values, found, passes = whitening.leading_pairs(lambda x: 3 * x, 40, 4)  # every block closes the space
    assert np.allclose(values, 3) and np.allclose(found.T @ found, np.eye(4)) and passes == 1
    values, _, _ = whitening.leading_pairs(lambda x: 0 * x, 5, 4)
    assert np.allclose(values, 0)


# --- 13: chunks ---

ODD = ["a", "b", "the ", "ing", "'s", "'re", " ", "\n", "\t ", "  ", "é", "é", "́", "İ", "ß", "Σ", "1", "23", "<|endoftext|>", "<|start", "oftext|>", "!", "...", "日本", " ", " ", "\x1f", "\x0b", "\U0001f600", "'S", "'", "A", "ᄀ", "ᅡ", "²", "ͅ"]


def encoded(own, text):
    data = text.encode()
    return np.frombuffer(own.encode(data, chunks.cut_places(np.frombuffer(data, np.uint8)).tolist()), np.uint32).tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("sizes", [(4, 1, 16, 4), (16, 4, 64, 8), (512, 64, 1 << 14, 32)])
def test_chunks_agree_with_the_library(monkeypatch, name, sizes):
    for key, value in zip(("MEAN", "SHORTEST", "LONGEST", "WINDOW"), sizes):
        monkeypatch.setattr(chunks, key, value)
    own, rng = chunks.ChunkEncoder(tokenizer_path(name)), random.Random(sum(sizes))
    for trial in range(300 if sizes[0] < 512 else 40):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(0, 200 if sizes[0] < 512 else 4000)))
        if rng.random() < 0.1:
            text = rng.choice(["a", "ab ", " ", "é", "́", "1"]) * rng.randrange(500)
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoded(own, text) == want
        assert own.decode(np.array(want, np.uint32)) == own.tokenizer.decode(want, skip_special_tokens=False)


def test_a_shared_passage_is_encoded_once():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000))
    own = chunks.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    encoded(own, "one opening. " + passage)
    made = own.chunks.made
    for k in range(5):
        encoded(own, "another opening " * (3 * k + 1) + passage + " and an end")
    assert own.chunks.made - made <= 5 * 6 < made


def test_the_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(chunks, "_REMEMBERED", 5000)
    own = chunks.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    for k in range(50):
        text = " ".join(f"v{k}x{i}" for i in range(300))
        assert encoded(own, text) == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(map(len, own.chunks.young)) + sum(map(len, own.chunks.old)) < 60_000


def test_chunk_query_on_tables(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(600)))) for i in range(200)] + EDGES
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    own = chunks.ChunkEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    want = []
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(own.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in queries.op13_chunk_reuse(spark, str(tmp_path)).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert chunks.encode_and_decode(docs(spark, [])).collect() == []


def test_rolling_hash_depends_on_its_window_alone():
    data = np.random.default_rng(3).integers(0, 256, 3000, dtype=np.uint8)
    h = chunks.rolling_hash(data)
    assert (chunks.rolling_hash(data[100:])[chunks.WINDOW :] == h[100 + chunks.WINDOW :]).all()
    assert len(set(h.tolist())) > 2900
