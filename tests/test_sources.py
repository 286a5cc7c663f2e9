"""JSON lines by file, line and digest, over several splits; results published whole or not at all."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.operators.checks import ContractError
from veraline.plans.store import setting
from veraline.sources import committed, documents
from veraline.sources.jsonl import Limits, file_identities, file_sha256, numbered_lines, read_records, write_records

A = T.StructType([T.StructField("a", T.LongType()), T.StructField("t", T.StringType())])


def put(path, data):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(data)
    return str(path)


FILES = {
    "plain": b'{"a":1}\n{"a":2}\n', "no_end": b'{"a":1}\n{"a":2}', "empty": b"", "blank_end": b"x\n\n", "one_lf": b"\n", "crlf": b"a\r\nb\r\n", "mark": b"\xef\xbb\xbfa\nb\n", "mark_no_end": b"\xef\xbb\xbfa\nb",
    "not_utf8": b"\xff\xfe\x00a\n\xc3", "long": b"".join(b'{"a":%d,"t":"%s"}\n' % (i, b"z" * (i % 97)) for i in range(5000)),
}


@pytest.mark.parametrize("size", ["128m", "4k"])
def test_lines_and_digests_over_splits(spark, tmp_path, size):
    for name, data in FILES.items():
        put(tmp_path / "in" / f"{name}.jsonl", data)
    folder = str(tmp_path / "in")
    with setting(spark, "spark.sql.files.maxPartitionBytes", size), setting(spark, "spark.sql.files.openCostInBytes", "1k"):
        found = {os.path.basename(r.file)[:-6]: r for r in file_identities(spark, folder).collect()}
        lines = {}
        for r in numbered_lines(spark, folder).collect():
            lines.setdefault(os.path.basename(r.file)[:-6], []).append((r.line, bytes(r.raw)))
        splits = spark.read.text(folder, lineSep="\n").select("_metadata.file_block_start").distinct().count()
    assert splits > (50 if size == "4k" else 1)
    assert set(found) == set(FILES)
    for name, data in FILES.items():
        assert found[name].sha256 == hashlib.sha256(data).hexdigest(), name
        body = data.removeprefix(b"\xef\xbb\xbf")
        want = body.split(b"\n")
        want = want[:-1] if not want[-1] else want
        assert sorted(lines.get(name, [])) == list(enumerate(want, 1)) and found[name].lines == len(want)
        assert (found[name].size, found[name].marked) == (len(data), data != body)
    assert file_sha256(spark, str(tmp_path / "in" / "long.jsonl")) == hashlib.sha256(FILES["long"]).hexdigest()
    with pytest.raises(ContractError):
        file_sha256(spark, folder)


def test_faults_by_file_and_line(spark, tmp_path):
    lines = [b'{"a":1,"t":"x"}', b"", b'{"a":2,"a":3,"t":"x"}', b'{"a":NaN,"t":"x"}', b'{"a":4}', b"[1]", b"{", b'{"a":5,"t":"e\xcc\x81"}', b'{"a":6,"t":"' + b"y" * 90 + b'"}', b'{"a":1,"t":"again"}', b'{"a":7,"t":"\xff"}', b'{"a":8,"t":"r\r"}']
    path = put(tmp_path / "one.jsonl", b"\n".join(lines))
    records, bad = read_records(spark, path, A, "a", Limits(80, 11))
    assert sorted((r.a, r.t) for r in records.collect()) == [(1, "again"), (1, "x")]
    got = sorted((r.rule, r.line) if r.line else (r.rule, r.detail) for r in bad.collect())
    want = [("blank", 2), ("duplicate_key", 3), ("not_finite", 4), ("wrong_keys", 5), ("not_an_object", 6), ("not_json", 7), ("not_nfc", 8), ("too_long", 9), ("repeated_key", 1), ("not_utf8", 11), ("bad_character", 12), ("too_many_lines", "12")]
    assert got == sorted(want, key=str) or sorted(map(str, got)) == sorted(map(str, want))
    assert all(r.file.endswith("one.jsonl") for r in bad.collect())
    _, lenient = read_records(spark, put(tmp_path / "two.jsonl", b'\n{"a":1,"t":"x"}\n \t\n'), A, "a", Limits(blank_is_fault=False))
    assert lenient.count() == 0
    _, marked = read_records(spark, put(tmp_path / "three.jsonl", b'\xef\xbb\xbf{"a":1,"t":"x"}\n'), A)
    assert [(r.rule, r.line) for r in marked.collect()] == [("byte_order_mark", None)]


def test_published_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(1000).withColumn("t", F.concat(F.lit("v"), "id"))
    target = str(tmp_path / "out")
    digest = write_records(rows, target, "id")
    told = json.loads((tmp_path / "out" / committed.MANIFEST).read_text())
    assert told == {"record_count": 1000, "tree_sha256": digest}
    assert spark.read.json(f"{target}/{committed.DATA}").count() == 1000
    assert digest == write_records(rows.repartition(7), str(tmp_path / "other"), "id")
    with pytest.raises(ContractError, match="already"):
        write_records(rows, target, "id")
    broken = rows.withColumn("t", F.when(F.col("id") == 700, F.raise_error(F.lit("a task fails"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="a task fails"):
        write_records(broken, str(tmp_path / "failed"), "id")

    def refuse(_):
        raise ContractError("no manifest")

    with pytest.raises(ContractError, match="no manifest"):
        committed.publish(rows, str(tmp_path / "refused"), refuse)
    assert sorted(os.listdir(tmp_path)) == ["other", "out"]


def test_documents_replace_others_whole(spark, tmp_path):
    path = str(tmp_path / "d.json")
    for value in ({"a": 1}, {"a": "é", "b": [2]}):
        documents.write_document(path, value)
        assert documents.read_document(spark, path) == value
    with pytest.raises(ValueError):
        documents.write_document(path, {"a": float("nan")})
    assert documents.read_document(spark, path) == {"a": "é", "b": [2]}
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["d.json"]
