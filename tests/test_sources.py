import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codecorpus.plans import conversion
from codecorpus.sources import sinks, tree


@pytest.fixture
def root(tmp_path):
    files = {
        "one/__init__.py": b"",
        "one/_private.py": b"a = 1\r\nb = 2\r",
        "one/.hidden.py": b"x",
        "one/.dot/in.py": b"y",
        "one/bad.js": b"caf\xc3\xa9 \xff\xfe ok",
        "one/node_modules/m/skip.js": b"no",
        "one/deep/er/still/deeper/d.sql": "sel\u00e9ct".encode(),
        "two/.git/c.py": b"no",
        "two/config.json": b"{}",
        "two/readme.md": b"no",
        "two/big.py": b"x" * 5000,
        "top.py": b"t",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(tmp_path / "one", tmp_path / "two" / "loop")
    return tmp_path


def test_scan(spark, root):
    found = {r.path: r for r in tree.scan_files(spark, str(root), max_bytes=4999).collect()}
    assert set(found) == {
        "one/__init__.py", "one/_private.py", "one/.hidden.py", "one/.dot/in.py", "one/bad.js",
        "one/deep/er/still/deeper/d.sql", "top.py",
    }
    assert found["one/_private.py"].content == "a = 1\nb = 2\n" and found["one/_private.py"].size == 13
    assert found["one/bad.js"].content == "caf\u00e9  ok"
    assert found["one/__init__.py"].content == "" and found["one/__init__.py"].size == 0
    assert found["one/.dot/in.py"].repo == "one" and found["top.py"].repo == root.name
    everything = tree.scan_files(spark, str(root), extensions=None, max_bytes=None, repo_depth=0)
    assert {r.repo for r in everything.select("repo").distinct().collect()} == {root.name}
    assert everything.filter("path = 'two/big.py'").count() == 1


def test_files_that_cannot_be_read_are_left_out(spark, root):
    listing = tree.list_tree(spark, str(root)).filter("path in ('one/bad.js', 'top.py')")
    gone = listing.withColumn("location", F.when(F.col("path") == "top.py", F.lit("/nowhere")).otherwise(F.col("location")))
    assert [r.path for r in tree.read_files(gone).collect()] == ["one/bad.js"]


def test_binary_source_agrees_where_names_are_plain(spark, root):
    ours = tree.scan_files(spark, str(root), extensions=[".js", ".sql"]).select("repo", "path", "size", "content")
    spark_source = tree.scan_binary_files(spark, str(root)).filter("path in ('one/bad.js', 'one/deep/er/still/deeper/d.sql')")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, spark_source.select(ours.columns).collect()))


def test_converted_files_are_replaced_on_a_rerun(spark, tmp_path):
    rows = [("r", "r/a.py", "java/r/a.java", "Java", "java", "// x"), ("r", "r/b.py", "csharp/r/b.cs", "C#", "csharp", "// é")]
    converted = spark.createDataFrame(rows, sinks.OUTPUT_COLUMNS)
    for _ in range(2):
        sinks.write_converted(converted, str(tmp_path / "t"))
        assert sinks.export_tree(converted, str(tmp_path / "files")) == 2
    assert sorted(os.listdir(tmp_path / "t"))[-2:] == ["target_folder=csharp", "target_folder=java"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert (tmp_path / "files/csharp/r/b.cs").read_text(encoding="utf-8") == "// é"
    assert os.listdir(tmp_path / "files/java/r") == ["a.java"]


def test_whole_conversion(spark, files_of):
    files = files_of(("r/a.py", "import x\ndef f(a):\n  return x.g(a)\n"), ("r/b.py", "y = 1"), ("r/c.rb", "def f\nend\n"))
    requests = conversion.corpus_to_requests(files, "JavaScript").collect()
    assert [(r.path, r.segment_no) for r in requests] == [("r/a.py", 0)]
    assert "def f(a):\n  return x.g(a)\n### END" in requests[0].prompt and "may help:\nimport x\n" in requests[0].prompt
    classified = conversion.filter_convertible(conversion.classify(conversion.scan_corpus(files)))
    responses = spark.createDataFrame(
        [("r", "r/a.py", 0, "function f(a) { if (a) { return g(a) } }")], "repo string, path string, segment_no int, text string"
    )
    pair = classified.filter("path = 'r/a.py'").select(conversion.pair_id_of("repo", "path").alias("pair_id"))
    reviews = pair.select("pair_id", F.lit("PASS").alias("text"), F.lit(None).cast("string").alias("error"))
    timings = pair.select("pair_id", *[F.lit(0.0).alias(c) for c in ("original_s", "converted_s")],
                          *[F.lit(0).alias(c) for c in ("original_rc", "converted_rc")])
    done = conversion.responses_to_reports(classified, responses, timings, reviews, "JavaScript")
    converted = done.files.collect()
    assert [(r.output_path, r.content) for r in converted] == [
        (
            "javascript/r/a.js",
            "// This file was auto-generated by GenAI from Python → JavaScript\n\nfunction f(a) { if (a) { return g(a) } }",
        )
    ]
    assert [(r.validator, r.passed) for r in done.results.collect()] == [("review", True), ("semantic", True), ("performance", True)]
    assert [(r.overall_passed, r.is_cross_language) for r in done.reports.collect()] == [(True, True)]
    assert [r.status for r in done.promoted.collect()] == ["validated"]
    assert tuple(done.summary.first()) == (2, 1, 50.0)


def test_an_entry_that_cannot_be_read_hides_no_other(spark, tmp_path):
    for name in "abcdefgh":
        (tmp_path / f"{name}.py").write_text("x = 1\n")
    (tmp_path / "loop.py").symlink_to(tmp_path / "loop.py")
    with pytest.warns(UserWarning, match="1 entries"):
        found = tree.scan_files(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in found) == [f"{name}.py" for name in "abcdefgh"]


def test_another_target_leaves_the_first(spark, tmp_path):
    for folder in ("java", "csharp", "java"):
        row = ("r", "a.py", f"{folder}/a", folder, folder, folder)
        frame = spark.createDataFrame([row], "repo string, source_path string, output_path string, target_language string, target_folder string, content string")
        sinks.write_converted(frame, str(tmp_path / "t"))
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["csharp", "java"]


def test_the_last_complete_run_is_what_is_read(spark, tmp_path):
    base = str(tmp_path / "out")

    def run(*rows):
        return spark.createDataFrame(list(rows), "pair_id long, output_path string, content string, status string")

    with pytest.raises(ValueError, match="no run"):
        sinks.read_promoted(spark, base)
    sinks.write_promoted(run((1, "java/a", "one", "validated"), (2, "java/b", "two", "validated")), base)
    sinks.write_promoted(run((1, "java/a", "three", "with warnings")), base)
    assert [tuple(r) for r in sinks.read_promoted(spark, base).collect()] == [(1, "java/a", "three", "with warnings")]
    broken = run((1, "java/a", "four", "validated")).withColumn("content", F.raise_error(F.lit("breaks off")).cast("string"))
    with pytest.raises(Exception, match="breaks off"):
        sinks.write_promoted(broken, base)
    assert [r.content for r in sinks.read_promoted(spark, base).collect()] == ["three"]
    sinks.write_promoted(run(), base)
    assert sinks.read_promoted(spark, base).columns == ["pair_id", "output_path", "content", "status"] and sinks.read_promoted(spark, base).isEmpty()
    assert sinks.drop_old_runs(spark, base) == 2 and sinks.drop_old_runs(spark, base) == 0
    assert sinks.read_promoted(spark, base).isEmpty()


def test_two_files_of_one_path_are_an_error(spark, tmp_path):
    frame = spark.createDataFrame([("java/a.java", "1"), ("java/a.java", "2")], "output_path string, content string")
    with pytest.raises(ValueError, match="java/a.java"):
        sinks.export_tree(frame, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_limits_are_off_unless_given_and_what_they_leave_out_is_counted(spark):
    long_file = "x = 1\n" * 3_000
    rows = [("r", f"f{i}.py", len(long_file), long_file) for i in range(150)]
    files = spark.createDataFrame(rows, "repo string, path string, size long, content string")
    whole = conversion.scan_corpus(files)
    assert whole.count() == 150 and whole.where(F.length("content") < len(long_file)).isEmpty()
    left = conversion.left_out(files, max_lines=1_000, max_files=100).first()
    assert (left.files, left.left_out, left.truncated) == (150, 50, 100)


def test_scanned_trees_hold_a_part_of_the_files_and_go(spark, tmp_path, monkeypatch):
    """Never more files on disk at once than one part; all files are scanned, whatever the number of parts."""
    from codecorpus.checks import queries

    spark.sql("select id as o_orderkey, id % 7 as o_custkey from range(120)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "select id % 100 as l_orderkey, id % 13 as l_partkey, id % 11 as l_suppkey, cast(id % 5 as int) as l_linenumber from range(300)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = sorted(map(tuple, queries.scan_files(spark, str(tmp_path)).collect()))
    roots, held, export = [], [], queries.sinks.export_tree

    def exported(files, root, path):
        roots.append(root)
        held.append(export(files, root, path))
        return held[-1]

    monkeypatch.setattr(queries, "TREE_FILES", 20, raising=False)
    monkeypatch.setattr(queries.sinks, "export_tree", exported)
    assert sorted(map(tuple, queries.scan_files(spark, str(tmp_path)).collect())) == whole and len(whole) > 50
    assert sum(held) == 100 and len(held) == 5 and max(held) < 40
    assert not any(Path(root.removeprefix("file:")).exists() for root in roots)


def test_tasks_remove_the_files_of_a_tree(spark, tmp_path, monkeypatch):
    """Nothing but empty folders is left to the driver; what a link leads to stays."""
    root, outside, left = tmp_path / "tree", tmp_path / "outside", []
    outside.mkdir()
    (outside / "kept").write_text("x")
    for folder in ("a", "a/b", "c"):
        (root / folder).mkdir(parents=True)
        for i in range(3):
            (root / folder / f"_{i}.py").write_text("x")
    (root / "c" / "link").symlink_to(outside)
    place = sinks._place

    def seen(*arguments):
        left.extend(p for p in root.rglob("*") if not p.is_dir() or p.is_symlink())
        return place(*arguments)

    monkeypatch.setattr(sinks, "_place", seen)
    sinks.remove_tree(spark, str(root))
    assert left == [] and not root.exists() and (outside / "kept").exists()
    sinks.remove_tree(spark, str(root))


def test_few_folders_are_listed_by_as_many_tasks(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / "tree" / f"r{i}").mkdir(parents=True)
        (tmp_path / "tree" / f"r{i}" / "x.py").write_text("x")
    tasks, plain = [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda frame: tasks.append(frame.rdd.getNumPartitions()) or plain(frame))
    assert tree.list_tree(spark, str(tmp_path / "tree")).count() == 5
    assert tasks == [1, 5]
