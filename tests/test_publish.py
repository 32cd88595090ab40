"""Publication by manifest: broken attempts, verification, hashes of files in blocks."""

import hashlib
from pathlib import Path

import pytest

from caselake.sources import publish


def test_publication(spark, tmp_path):
    held = publish.Publication(spark, f"file://{tmp_path}/p")
    assert held.manifest() is None
    table = lambda *rows: {"a": spark.createDataFrame(list(rows), "id long, v string"), "b": spark.range(3).repartition(2)}
    order = {"a": ["id"], "b": ["id"]}
    first = held.publish(table((1, "x"), (2, None)), order, {"s": "1"})
    commit, held._commit = held._commit, lambda said: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        held.publish(table((9, "z")), order, {"s": "1"})
    held._commit = commit
    assert sorted(map(tuple, held.read("a", "id long, v string").collect())) == [(1, "x"), (2, None)] and held.manifest()["snapshot_id"] == first
    assert held.publish(table((2, None), (1, "x")), order, {"s": "1"}) == first != held.publish(table((2, None), (1, "x")), order, {"s": "2"})
    assert held.publish(table((1, "x")), order, {"s": "1"}) != first and held.manifest()["number"] == 3
    verdicts = lambda: {r["name"]: r["verdict"] for r in held.verify().collect()}
    assert set(verdicts().values()) == {"pass"}
    files = sorted(Path(tmp_path, "p/data", held.manifest()["attempt"]).rglob("part-*.parquet"))
    name = lambda f: "/".join(f.parts[-2:])
    files[0].write_bytes(files[0].read_bytes() + b"x")
    files[1].unlink()
    (files[0].parent / "part-extra.parquet").write_bytes(b"y")
    for f in Path(tmp_path).rglob(".*.crc"):
        f.unlink()
    got = verdicts()
    assert got[name(files[0])] == "changed" and got[name(files[1])] == "missing" and got[f"{files[0].parent.name}/part-extra.parquet"] == "extra"


def test_hash_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "BLOCK", 1000)
    rows = {"one": b"a" * 1000, "two": bytes(range(256)) * 40}
    for n, x in rows.items():
        (tmp_path / n).write_bytes(x)
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["size"]) for r in publish.hash_files(spark, f"file://{tmp_path}").collect()}
    assert got == {n: (hashlib.sha256(x).hexdigest(), len(x)) for n, x in rows.items()}


def test_rejects(spark, tmp_path):
    lines = ['{"id": "1", "content": "c", "page_start": 3}', '{"id": "2", "content": ', "", "   ", '{"id": " ", "content": "x"}', '{"id": "4"}', "[1]", "плохо"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("\n".join(lines))
    rows, bad, seen = publish.split_kb_raw(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert [(r["id"], r["content"], r["page_start"]) for r in rows.collect()] == [("1", "c", 3)]
    told = {r["line"]: r["reason"] for r in bad.collect()}
    assert told[lines[1]] == "not_json" and told[lines[4]] == "no_id" and told[lines[5]] == "no_content" and told["плохо"] == "not_json" and len(told) == 5
    assert seen["lines"] == 6 and sum(v for k, v in seen.items() if k != "lines") == 5
