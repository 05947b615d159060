import json
import os
import random

from loomline.operators import retrieval
from loomline.sources import files
from loomline.sources.manifest import Manifest


def test_contents_of_files_one_by_one(spark, tmp_path):
    (tmp_path / "a.ts").write_text("let a = 1")
    (tmp_path / "odd.ts").write_bytes(b"\xff")
    os.mkdir(tmp_path / "folder.ts")
    paths = spark.createDataFrame([("a.ts",), ("a.ts",), (f"{tmp_path}/odd.ts",), ("gone.ts",), ("folder.ts",), (None,)], "path string")
    got = {r.path: r for r in files.contents(paths, str(tmp_path)).collect()}
    assert set(got) == {"a.ts", f"{tmp_path}/odd.ts", "folder.ts"}
    assert (got["a.ts"].content, got["a.ts"].error, got[f"{tmp_path}/odd.ts"].content) == ("let a = 1", None, "�")
    assert got["folder.ts"].content is None and got["folder.ts"].error
    full = {r.file_path: r.full for r in retrieval.full_content(paths.dropna().withColumnRenamed("path", "file_path"), files.contents(paths, str(tmp_path))).collect()}
    assert full["gone.ts"] == "// File not found: gone.ts" and full["folder.ts"].startswith("// Error reading file: ") and full["a.ts"] == "let a = 1"


def test_index_bytes_of_folders_there_are(spark, tmp_path):
    os.makedirs(tmp_path / "m/x")
    (tmp_path / "m/x/1").write_bytes(b"12345")
    (tmp_path / "m/2").write_bytes(b"123")
    assert files.index_bytes(spark, f"{tmp_path}/m", f"{tmp_path}/none") == 8 and files.index_bytes(spark) == 0


def test_a_legacy_manifest_is_retired_once_it_is_taken_over(spark, tmp_path):
    old, m = tmp_path / "old.json", Manifest(spark, f"{tmp_path}/manifest")
    assert not m.migrate(str(old))
    old.write_text(json.dumps({"version": 2, "files": {"a": {"mtime": 1.0, "size": 2, "hash": "h"}}}))
    assert not m.migrate(str(old)) and old.exists()
    old.write_text(json.dumps({"version": 1, "files": {"a": {"mtime": 1.0, "size": 2, "hash": "h"}, "b": {"mtime": 3.5, "size": 4, "hash": "i"}}}))
    assert m.migrate(str(old)) and not old.exists()
    assert [(r.path, r.mtime, r.size) for r in m.load().collect()] == [("a", 1.0, 2), ("b", 3.5, 4)]
    old.write_text(json.dumps({"version": 1, "files": {"c": {"mtime": 1.0, "size": 2, "hash": "h"}}}))
    assert not m.migrate(str(old)) and old.exists() and m.load().count() == 2


def test_the_active_file_by_any_ending(spark):
    """Endings of paths either way, also bare names and parts of names, as comparing all pairs gives them."""
    rng = random.Random(4)
    name = lambda: "/".join(rng.choice(["a", "ba", "aba", "", "b.ts"]) for _ in range(rng.randrange(1, 4)))
    paths = [(i, name(), f"text {i}") for i in range(40)] + [(40, None, "x"), (41, "", "y"), (7, "a/b.ts", None)]
    active = [(i, name()) for i in range(40)] + [(40, None), (41, ""), (42, "s")]
    got = {(r.task_id, r.text) for r in retrieval.active_chunk(spark.createDataFrame(active, "task_id long, active_path string"), spark.createDataFrame(paths, "pos long, path string, content string")).collect()}
    want = set()
    for task, a in active:
        hits = [(pos, p, c) for pos, p, c in paths if a and p and (p.endswith(a) or a.endswith(p))]
        if hits:
            least = min(h[:2] for h in hits)
            want.add((task, f"// ACTIVE FILE: {a}\n{next(h[2] for h in hits if h[:2] == least) or ''}"))
    assert got == want and want
