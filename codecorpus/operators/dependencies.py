"""Imports, modules, calls, identifier uses and the dependency graph.

Everything up to the rows of one file happens inside its row; only the graph of
the whole corpus shuffles, and it aggregates before it does.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dependencies as rules
from codecorpus.operators.common import FILE, language_column, masked


@cache
def _imports() -> Column:
    return rules.imports(F.col("content"), F.col("_hidden"), F.col("language"))


@cache
def _calls(exclude_keywords: bool) -> Column:
    return rules.calls(F.col("content"), F.col("_hidden"), F.col("language"), exclude_keywords)


@cache
def _uses() -> Column:
    return rules.python_uses(F.col("_hidden"))


def extract_imports(files: DataFrame) -> DataFrame:
    """One row per import: kind, text, module and position."""
    return masked(files).select(*FILE, F.explode(_imports()).alias("import")).select(
        *FILE, "import.kind", "import.text", "import.module", "import.start_char"
    )


def extract_modules(files: DataFrame) -> DataFrame:
    """The different modules each file imports."""
    modules = F.filter(F.transform(_imports(), lambda i: i["module"]), lambda m: m.isNotNull())
    return masked(files).select(*FILE, F.explode(F.array_distinct(modules)).alias("module"))


def modules_of_imports(imports: DataFrame) -> DataFrame:
    """The same from a stored table of imports."""
    return imports.filter(F.col("module").isNotNull()).select(*FILE, "module").distinct()


def extract_calls(files: DataFrame, exclude_keywords: bool = True) -> DataFrame:
    """One row per call: name, matched text, offset, and line counted from 1."""
    found = F.explode(_calls(exclude_keywords)).alias("call")
    return masked(files).select(*FILE, found).select(*FILE, "call.*")


def extract_variables(files: DataFrame) -> DataFrame:
    """One row per use of an identifier in a Python file, with its line counted from 1."""
    python = masked(files.filter(F.lower(language_column(files)) == "python"))
    return python.select(*FILE, F.explode(_uses()).alias("use")).select(*FILE, "use.name", "use.line_no")


def _nodes(modules: DataFrame, calls: DataFrame, columns: list[str]) -> DataFrame:
    def kind(rows: DataFrame, label: str, node_type: str) -> DataFrame:
        return rows.select(*columns, F.col(label).alias("id"), F.lit(node_type).alias("type"), F.col(label).alias("label"))

    return kind(modules, "module", "module").unionByName(kind(calls, "name", "function"))


def dependency_nodes(modules: DataFrame, calls: DataFrame) -> DataFrame:
    """Modules and called functions of the corpus, each once."""
    return _nodes(modules, calls, []).distinct()


def dependency_nodes_of_files(files: DataFrame) -> DataFrame:
    """The same straight from the files: one masking, and what a file repeats is merged in its row."""

    def nodes(names: Column, node_type: str) -> Column:
        named = F.filter(names, lambda n: n.isNotNull())
        return F.transform(named, lambda n: F.struct(n.alias("id"), F.lit(node_type).alias("type"), n.alias("label")))

    modules = nodes(F.transform(_imports(), lambda i: i["module"]), "module")
    called = nodes(F.transform(_calls(True), lambda c: c["name"]), "function")
    found = F.array_distinct(F.concat(modules, called))
    return masked(files).select(F.explode(found).alias("node")).select("node.*").distinct()


def dependency_nodes_by_file(modules: DataFrame, calls: DataFrame) -> DataFrame:
    """Modules and called functions of each file, repeated calls repeated."""
    return _nodes(modules, calls, FILE)


def dependency_edges(imports: DataFrame) -> DataFrame:
    """One ``imports`` edge from the file to the module per import that names one."""
    return imports.filter(F.col("module").isNotNull()).select(
        F.col("repo"), F.col("path").alias("from"), F.col("module").alias("to"), F.lit("imports").alias("type")
    )


def module_fan_in(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` modules imported by most files.

    Edges of one file to one module are merged first, so a module that every
    other file imports arrives at its task as partial counts.
    """
    files = edges.select("repo", "from", "to").distinct()
    return files.groupBy("to").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "to").limit(k)


def module_fan_in_of_files(files: DataFrame, k: int) -> DataFrame:
    """The same straight from the files: a file's modules differ within its row, so one aggregate does."""
    counted = extract_modules(files).groupBy(F.col("module").alias("to")).agg(F.count("*").alias("files"))
    return counted.orderBy(F.desc("files"), "to").limit(k)
