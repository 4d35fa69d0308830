import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, gold


def test_scan_tree(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "src/b.go": "package b", "src/vendor/c.go": "no", "docs/deep.md": "no", "README.md": "# hi", "sub/readme.txt": "yes", "x.bin": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = files.scan_tree(spark, str(tmp_path)).collect()
    assert {r["path"]: r["text"] for r in found} == {"a.py": "x = 1\n", "src/b.go": "package b", "README.md": "# hi", "sub/readme.txt": "yes"}
    ignored = spark.createDataFrame([("a.py",)], "path string")
    assert "a.py" not in {r["path"] for r in files.scan_tree(spark, str(tmp_path), ignored).collect()}


def tree(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize("name", ["t+x", "a(b", "sp ace", "per%41cent", "br{a,b}[c]"])
def test_roots_with_signs_and_broken_bytes(spark, tmp_path, name):
    root = tmp_path / name
    tree(root, **{"a.py": b"x = '\xff'\n", "we{i}rd*.go": "package a"})
    found = {r["path"]: r["text"] for r in files.scan_tree(spark, str(root)).collect()}
    assert found == {"a.py": "x = '\ufffd'\n", "we{i}rd*.go": "package a"}


def test_ignore_rules_of_a_tree(spark, tmp_path):
    tree(tmp_path, **{".gitignore": "gen/\n*.log.py\n!keep.log.py\n", "a.py": "1", "gen/b.py": "2", "x.log.py": "3", "keep.log.py": "4", "sub/.gitignore": "/c.py\n", "sub/c.py": "5", "sub/deep/c.py": "6"})
    assert {r["path"] for r in files.scan_tree(spark, str(tmp_path)).collect()} == {"a.py", "gen/b.py", "x.log.py", "keep.log.py", "sub/c.py", "sub/deep/c.py"}
    (tmp_path / ".git").mkdir()
    assert [r["path"] for r in files.scan_tree(spark, str(tmp_path)).collect()] == ["a.py", "keep.log.py", "sub/deep/c.py"]


def test_rules_equal_those_of_git(tmp_path):
    import random
    import subprocess

    from lodestone.sources.ignore import IgnoreRules

    rng = random.Random(9)
    parts, names = ["a", "b", "tmp1", "tmp2", "x"], ["f.py", "g.log", "#h", "!i", "j k.txt", "[z].c"]
    pool = ["*.log", "/a/", "b", "!g.log", "tmp?", "**/x/", "a/**", "x/**/f.py", "\\#h", "\\!i", "*.py", "!/a/f.py", "j k.txt ", "b/*", "!b/f.py", "[f-g].*", "\\[z\\].c", "a/b/f.py", "# c", "", "/f.py", "[!f].log"]
    for turn in range(25):
        root = tmp_path / str(turn)
        root.mkdir()
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        rules = [("", "\n".join(rng.sample(pool, 4)) + "\n"), ("a", "\n".join(rng.sample(pool, 2)) + "\n")]
        paths = sorted({"/".join([*[rng.choice(parts) for _ in range(rng.randrange(0, 4))], rng.choice(names)]) for _ in range(40)})
        for folder, text in rules:
            (root / folder).mkdir(exist_ok=True)
            (root / folder / ".gitignore").write_text(text)
        for p in paths:
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_text("")
        said = subprocess.run(["git", "-C", str(root), "check-ignore", "-z", "--stdin"], input="\0".join(paths), capture_output=True, text=True)
        found = IgnoreRules(rules)
        assert {p for p in paths if found.ignored(p)} == {p for p in said.stdout.split("\0") if p}, rules


def test_corrupt_tables_read_as_empty(spark, tmp_path):
    path = tmp_path / "t"
    spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1).write.parquet(str(path))
    for f in path.glob("*.parquet"):
        f.write_bytes(b"garbage that is no table")
    for f in path.glob(".*.crc"):
        f.unlink()
    assert files.read_or_empty(spark, str(path), "a int, b string").count() == 0


def test_versions_are_published_together(spark, tmp_path):
    folder = str(tmp_path / "i")
    assert files.current_version(spark, folder) is None
    one = spark.createDataFrame([(1,)], "a int")
    first = files.write_version(spark, folder, {"x": one, "y": one})
    broken = one.withColumn("a", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        files.write_version(spark, folder, {"x": one, "y": broken})
    assert files.current_version(spark, folder) == first
    second, third = (files.write_version(spark, folder, {"x": one}) for _ in range(2))
    assert files.current_version(spark, folder) == third
    assert not (tmp_path / "i" / first.rpartition("/")[2]).exists() and (tmp_path / "i" / second.rpartition("/")[2]).exists()


def test_repository_listing(spark, tmp_path):
    repos, indexes = tmp_path / "repos", tmp_path / "indexes"
    for name in ("owner__repo__x", "plain", "file"):
        (repos / name).mkdir(parents=True)
    indexes.mkdir()
    (repos / "note.txt").write_text("")
    name = spark.range(1).select(files.collection_name(F.lit(str(repos / "plain")))).first()[0]
    files.write_version(spark, str(indexes / name), {"x": spark.range(1)})
    found = [(r["name"], r["indexed"]) for r in files.repositories(spark, str(repos), str(indexes)).collect()]
    assert found == [("file", False), ("owner/repo__x", False), ("plain", True)]


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.read_or_empty(spark, path, "a int, b string").count() == 0
    files.write_table(spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), path, "b")
    assert {tuple(r) for r in spark.read.parquet(path).select("a", "b").collect()} == {(1, "x"), (2, "y")}
    assert files.read_or_empty(spark, path, "a int, b string").count() == 2


def test_frames_and_names(spark):
    row = spark.range(1).select(files.event_frame(F.lit("token"), F.struct(F.lit("a").alias("t"))).alias("f"), files.collection_name(F.lit("Owner/Repo!")).alias("n")).first()
    assert row["f"] == 'event: token\ndata: {"t":"a"}\n\n'
    assert row["n"].startswith("repo_owner-repo_") and len(row["n"]) == len("repo_owner-repo_") + 8


def question(i, **kw):
    return {"id": f"q{i}", "repo": "r", "split": "dev", "kind": "factual", "style": "semantic", "question": "what?", "note": "", "answers": [{"file": "a.py", "symbol": "f"}]} | kw


def write(tmp_path, *questions):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"repos": [{"name": "r", "path": "p", "commit": "c"}], "questions": list(questions)}))
    return str(path)


def test_gold(spark, tmp_path):
    loaded = gold.load_gold(spark, write(tmp_path, question(1), question(2, split="test", style="lexical")))
    assert loaded.count() == 2 and gold.gold_slice(loaded, split="dev", kind=None).count() == 1
    chunks = spark.createDataFrame([("a.py", "g"), ("a.py", "h")], "file string, symbol string")
    bad = gold.unmatched_labels(gold.answers_of(loaded), chunks).collect()
    assert len(bad) == 2 and bad[0]["hints"] == ["g", "h"]


@pytest.mark.parametrize("bad", [{"id": "q1"}, {"split": "train"}, {"kind": None}, {"repo": "other"}, {"answers": []}])
def test_bad_gold(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        gold.load_gold(spark, write(tmp_path, question(1), question(2, **bad)))
