import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from codecorpus.checks.queries import QUERIES
from codecorpus.functions.lexical import TOKENS
from codecorpus.functions.segments import JAVA_TOKEN
from codecorpus.operators import classify, dependencies, requests, segmentation, validation
from codecorpus.plans.conversion import corpus_to_requests

SMALL = "/root/testdata/sf0.001"


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("code"))
    queries()["scan_files"](spark, SMALL).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder), folder


def test_files_become_requests_without_a_shuffle(stored):
    plan = physical(corpus_to_requests(stored[0], "Java"))
    assert "Exchange" not in plan and "Join" not in plan
    limited = physical(corpus_to_requests(stored[0], "Java", max_bytes=5 * 1024 * 1024))
    assert "Exchange" not in limited and "LessThanOrEqual(size," in limited


@pytest.mark.parametrize(
    "operator",
    [
        segmentation.segment_code,
        dependencies.extract_imports,
        dependencies.extract_modules,
        dependencies.extract_calls,
        validation.complexity_metrics,
        validation.structural_elements,
        classify.classify,
    ],
)
def test_row_wise_operators_do_not_shuffle(stored, operator):
    assert "Exchange" not in physical(operator(stored[0]))


def test_masking_happens_once_per_file(stored):
    plan = physical(segmentation.segment_code(stored[0]))
    for pattern in TOKENS.values():
        assert plan.count(pattern) == 1
    assert plan.count(JAVA_TOKEN) == 1
    assert "Filter (size(" not in plan


def test_unused_columns_are_not_read(stored):
    plan = physical(classify.classify_language(stored[0]).groupBy("language").count())
    assert "ReadSchema: struct<path:string>" in plan


def test_row_wise_operators_run_on_a_stream(spark, stored, tmp_path):
    files, folder = stored
    stream = spark.readStream.schema(files.schema).parquet(folder)
    for name, operator in (("segments", segmentation.segment_code), ("requests", lambda f: requests.conversion_requests(f, "Java"))):
        out = operator(stream).writeStream.format("memory").queryName(name)
        running = out.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        running.awaitTermination()
        assert spark.table(name).count() == operator(files).count()


def test_entry(spark):
    assert entry(spark).count() == 8


@pytest.fixture(scope="session")
def database():
    connection = duckdb.connect()
    for table in check.TABLES.split():
        connection.execute(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_answer_in_sql(spark, database, name):
    assert name in oracle_sql()
    assert check.compare(spark, database, SMALL, name).startswith("ok")


def tiny_tables(spark, folder):
    """Two orders of two line items each; the second order comes twice."""
    orders = [(8, 1), (10, 2), (10, 2)]
    items = [(8, 1, 1, 1), (8, 2, 1, 3), (10, 3, 1, 1), (10, 4, 1, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_answers_meet_segments_that_were_found_once(spark, tmp_path, monkeypatch):
    folder, calls, find = tiny_tables(spark, str(tmp_path)), [], segmentation.segment_code
    monkeypatch.setattr(segmentation, "segment_code", lambda files: calls.append(1) or find(files))
    attached = queries()["attach_responses"](spark, folder).collect()
    assert len(calls) == 1
    left = queries()["unanswered_segments"](spark, folder).collect()
    assert len(calls) == 2
    # Each segment of the second order stands twice and meets the answers of both; names in _3 got an empty one.
    assert sorted(r.name for r in attached) == ["C_1", "C_2"] + ["C_4"] * 4 + ["f_1_1"] + ["f_3_1"] * 4
    assert all(r.response == f"// converted {r.name}" for r in attached)
    assert sorted(r.name for r in left) == ["C_3", "C_3", "f_2_3", "f_4_3", "f_4_3"]
