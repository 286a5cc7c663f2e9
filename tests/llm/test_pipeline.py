"""Each stage of the pipeline against what brute force would keep of its own input."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import brute_classes, check_pieces, docs, texts_with_copies
from veraline.llm import mixing
from veraline.llm.common import tokenizer_path
from veraline.plans.store import materialize


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the rows after each stage, by name."""
    rng = np.random.default_rng(9)
    texts = texts_with_copies(rng, 150)
    for k in range(0, len(texts), 9):
        texts[k] += " vile"
    texts += ["call +1 (988) 555-2485 now please or write soon " + f"n{k}" for k in range(20)] + [None, "", "word " * 5000]
    folder = tmp_path_factory.mktemp("tables")
    frame = docs(spark, texts)
    frame.write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, int(bool(t and "vile" in t))) for i, t in enumerate(texts) if i % 2 == 0 or (t and "vile" in t)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    out = {"input": frame.collect()}
    current = spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        current = materialize(stage(spark, current, str(folder)), name)
        out[name] = current.collect()
    return out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    kept = {r.doc_id for r in stages["toxicity"]}
    toxic = {r.doc_id for r in stages["input"] if r.text and "vile" in r.text}
    clean = {r.doc_id for r in stages["input"]} - toxic
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(clean - kept) <= 0.02 * len(clean)


def test_one_document_of_each_class_stays(stages):
    before = sorted((r.doc_id, r.text) for r in stages["toxicity"])
    classes = brute_classes([t for _, t in before], [i for i, _ in before])
    assert sorted(r.doc_id for r in stages["ngram_jaccard_join"]) == sorted({c for _, c, _ in classes})


def test_values_are_replaced_and_columns_stay(stages):
    before = {r.doc_id: r for r in stages["ngram_jaccard_join"]}
    for r in stages["pii"]:
        old = before[r.doc_id]
        assert r.asDict().keys() == old.asDict().keys()
        assert ("555-2485" not in r.text) if old.text and "555-2485" in old.text else r.text == old.text
        assert (r.text or "").isascii() and len(r.text or "") == len(old.text or "")
        assert not re.search(r"555-2485", r.text or "")
    assert len(before) == len(stages["pii"])


def test_the_mix_is_a_sample(spark, stages):
    before = {r.doc_id for r in stages["pii"]}
    after = {r.doc_id for r in stages["mixing"]}
    told = mixing.calibrate(spark.createDataFrame(stages["pii"], "doc_id long, text string, lang string, source string, n_chars long")).where("sampled").select("doc_id").collect()
    assert after < before and after == {r.doc_id for r in told}


def test_pieces_hold_the_mix(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    check_pieces(stages["packing"], {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in stages["mixing"]})


def test_registration(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
