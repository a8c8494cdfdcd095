"""Tables that queries and tests run on, derived from the given relational tables.

``code_files`` renders one source file per order with one block per line item,
in eight languages, so that what operators find in the text is known from the
line items without reading the text.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.operators.limits import ranked

ORDER = ("l_linenumber", "l_partkey", "l_suppkey")

# One block per language; {p} part, {s} supplier, {n} line number, {m} module number.
BLOCKS = {
    ".py": "import mod_{m}\nclass C_{p}:\n    def f_{p}_{n}(self, x):\n        if x > {n}:\n"
    "            return g_{s}(x)\n        return x\n",
    ".js": 'import { a } from "mod_{m}";\nfunction f_{p}_{n}(x) {\n  if (x > {n}) {\n    return g_{s}(x);\n'
    "  }\n  return x;\n}\n",
    ".java": "import com.mod_{m};\npublic class C_{p} {\n  public int f_{p}_{n}(int x) {\n    return g_{s}(x);\n  }\n}\n",
    ".cpp": "#include <mod_{m}>\nint f_{p}_{n}(int x) {\n  return g_{s}(x);\n}\n",
    ".cs": "using Mod_{m};\nclass C_{p} { }\n",
    ".sql": "select {p} from t_{s};\n",
    ".ts": "export const f_{p} = (x) => { return x };\n",
    ".rb": "def f_{p}(x)\n  x\nend\n",
}
SUFFIXES = list(BLOCKS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(suffix: str) -> Column:
    """The blocks of an order's ``items`` one after the other, in one language."""
    parts = re.split(r"\{([psnm])\}", BLOCKS[suffix])

    def block(item: Column) -> Column:
        values = {
            "p": item["l_partkey"],
            "s": item["l_suppkey"],
            "n": item["l_linenumber"],
            "m": item["l_partkey"] % 50,
        }
        return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])

    return F.array_join(F.transform("items", block), "")


def _suffix_of_order() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("o_orderkey") % 8 + 1).cast("int"))


@cache
def _text_of_order() -> Column:
    """The text in the language of the order."""
    chain = F.when(F.col("o_orderkey") % 8 == 0, _text(SUFFIXES[0]))
    for i, s in enumerate(SUFFIXES[1:], 1):
        chain = chain.when(F.col("o_orderkey") % 8 == i, _text(s))
    return chain


@cache
def _text_in(suffix: str) -> Column:
    return _text(suffix)


def _orders_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their sorted line items.  Only keys are shuffled; text is rendered afterwards."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.array_sort(F.collect_list(F.struct(*ORDER))).alias("items"))
    )
    return orders.join(items, "o_orderkey")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, size, content of the rendered files."""
    key = F.col("o_orderkey")
    folder = (
        F.when(key % 13 == 0, F.lit("node_modules"))
        .when(key % 13 == 1, F.lit(".git"))
        .otherwise(F.concat(F.lit("pkg"), (key % 5).cast("string")))
    )
    repo = F.concat(F.lit("repo"), (F.col("o_custkey") % 20).cast("string"))
    rendered = _orders_with_items(spark, sf_dir).withColumn("content", _text_of_order())
    return rendered.select(
        repo.alias("repo"),
        F.concat(repo, F.lit("/"), folder, F.lit("/m"), key.cast("string"), _suffix_of_order()).alias("path"),
        F.octet_length("content").cast("long").alias("size"),
        "content",
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: natural text in place of code."""
    key = F.col("doc_id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".py", ".js", ".sql", ".txt")]), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.concat(F.col("source"), F.lit("/doc_"), key.cast("string"), suffix).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("text").alias("content"),
    )


def code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per order: its file, and as conversion its Java or JavaScript rendering,
    a text without any code, or the same file with a comment on top."""
    key = F.col("o_orderkey")
    suffix = _suffix_of_order()
    kind = F.floor(key / 8).cast("long") % 4
    comment = F.when(key % 8 == 0, F.lit("# note\n")).otherwise(F.lit("// note\n"))
    rendered = _orders_with_items(spark, sf_dir).withColumn("original_code", _text_of_order())
    converted = (
        F.when(kind == 0, _text_in(".java"))
        .when(kind == 1, F.lit("// nothing"))
        .when(kind == 2, _text_in(".js"))
        .otherwise(F.concat(comment, F.col("original_code")))
    )
    converted_suffix = F.when(kind < 2, F.lit(".java")).when(kind == 2, F.lit(".js")).otherwise(suffix)
    stem = F.concat(F.lit("m"), key.cast("string"))
    return rendered.select(
        key.cast("long").alias("pair_id"),
        F.concat(stem, suffix).alias("original_path"),
        "original_code",
        F.concat(stem, converted_suffix).alias("converted_path"),
        converted.alias("converted_code"),
    )


def python_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Python pairs of ``code_pairs`` in four kinds of conversion: as they are; indented twice as far and with
    argument lists over several lines; with one more statement; with a bracket that is not closed."""
    kind = F.floor(F.col("pair_id") / 32).cast("long") % 4
    code = F.col("converted_code")
    wider = F.regexp_replace(F.regexp_replace(code, r"(?m)^( +)", "$1$1"), r"\((?=\w)", "(\n  ")
    return code_pairs(spark, sf_dir).where("original_path like '%.py' and converted_path like '%.py'").withColumn(
        "converted_code",
        F.when(kind == 0, code).when(kind == 1, wider).when(kind == 2, F.concat(code, F.lit("\nadded = 1\n"))).otherwise(F.concat(code, F.lit("\n("))),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as numbered attempts at one request."""
    events = table(spark, sf_dir, "events")
    return ranked(events, "user_id", ["event_id"], "attempt_no", ("event_type", "props")).select(
        F.col("user_id").cast("long").alias("request_id"),
        "attempt_no",
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")).alias("text"),
    )


def review_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    text = (
        F.when(F.col("toxic") == 1, F.lit("Overall: FAIL"))
        .when(F.col("quality") == 1, F.lit("Overall: PASS"))
        .when(key % 3 == 0, F.lit("PASS, though parts fail"))
        .when(key % 3 == 1, F.lit(None).cast("string"))
        .otherwise(F.lit("unclear"))
    )
    return table(spark, sf_dir, "labels").select(
        key.cast("long").alias("pair_id"), text.alias("text"), F.when(key % 17 == 0, F.lit("timeout")).alias("error")
    )


def pair_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review answer for each pair, by the priority of its order; urgent ones got none."""
    key = F.col("o_orderkey")
    text = (
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("Overall: FAIL"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("FAIL: language-specific idioms are missing"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Overall: PASS"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("unclear"))
    )
    return table(spark, sf_dir, "orders").select(
        key.cast("long").alias("pair_id"), text.alias("text"), F.when(key % 17 == 0, F.lit("timeout")).alias("error")
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured pair of runs per line item."""
    quantity, discount = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        (quantity / 4).alias("original_s"),
        (quantity / 4 * (1 + 20 * discount)).alias("converted_s"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("original_rc"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7), 1).otherwise(0).alias("converted_rc"),
    )


def pair_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured pair of runs per order: the slowest of its line items, failed if one failed."""
    return (
        timings(spark, sf_dir)
        .groupBy(F.col("l_orderkey").cast("long").alias("pair_id"))
        .agg(*[F.max(c).alias(c) for c in ("original_s", "converted_s", "original_rc", "converted_rc")])
    )
