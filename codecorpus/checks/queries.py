"""One query per operator over the given tables, or over tables Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus import derived
from codecorpus.functions import language, text
from codecorpus.functions.prompts import verdict
from codecorpus.functions.rules import STRUCTURE_FIELDS
from codecorpus.functions.rules import structural_elements as elements_of
from codecorpus.operators import (
    assembly,
    classify,
    context,
    dependencies,
    filters,
    limits,
    lines,
    reports,
    requests,
    segmentation,
    validation,
)
from codecorpus.operators.common import FILE, SEGMENT, segmented
from codecorpus.plans import conversion, reporting
from codecorpus.session import scratch_path
from codecorpus.sources import sinks, tree

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

TARGET = "Java"
SCAN_BYTES = 20_000
TREE_FILES = 250_000
TEXT_LINES = 3


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def code(spark: SparkSession, sf: str) -> DataFrame:
    return derived.code_files(spark, sf)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.doc_files(spark, sf)


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify(code(spark, sf))


def answers_to(segments: DataFrame) -> DataFrame:
    """An answer per segment; definitions on the third line of an order got an empty one."""
    answer = F.when(F.endswith("name", F.lit("_3")), F.lit("")).otherwise(
        F.concat(F.lit("// converted "), F.col("name"))
    )
    return segments.select(*SEGMENT, answer.alias("text"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return answers_to(segmentation.segment_code(code(spark, sf)))


def named_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments and their names as a stored table, so that a query with two uses of them finds them once."""
    folder = scratch_path(spark, "segments")
    found = segmentation.segment_code(code(spark, sf)).select(*SEGMENT, "name")
    found.write.parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def judged(spark: SparkSession, sf: str, **options) -> tuple[DataFrame, DataFrame]:
    return validation.run_validators(
        derived.code_pairs(spark, sf), derived.pair_timings(spark, sf), derived.pair_reviews(spark, sf), **options
    )


# --- sources and sinks ------------------------------------------------------


@query
def scan_files(spark, sf):
    """Rendered files written as a tree of files and scanned again, a part of them at a time.

    A small file takes a whole block of a disk. So a tree holds ``TREE_FILES`` files, by the hash of their paths,
    and goes when what was scanned is in a table; the disk follows the bytes of the files and not their number.
    Files that go before the system has put them on the disk, within half a minute mostly, cost a hundredth to remove.
    """
    files = code(spark, sf)
    parts = max(1, -(-files.count() // TREE_FILES))
    dealt, scanned = scratch_path(spark, "dealt"), scratch_path(spark, "scanned")
    part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part")
    files.select("path", "content", part).write.partitionBy("part").parquet(dealt)
    stored = spark.read.schema("path string, content string, part int").parquet(dealt)
    for number in range(parts):
        root = scratch_path(spark, "tree")
        sinks.export_tree(stored.where(F.col("part") == number), root, F.col("path"))
        found = tree.scan_files(spark, root)
        found.write.mode("append").parquet(scanned)
        sinks.remove_tree(spark, root)
    return spark.read.schema(found.schema).parquet(scanned)


@query
def decode_text(spark, sf):
    """The documents as bytes with CRLF and CR line ends and an invalid byte in front."""
    ends = F.when(F.crc32("path") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r"))
    raw = F.concat(F.unhex(F.lit("ff")), F.replace("content", F.lit("\n"), ends).cast("binary"))
    return tree.decode_text(docs(spark, sf).select(*FILE, raw.alias("content")))


@query
def write_converted(spark, sf):
    folder = scratch_path(spark, "converted")
    sinks.write_converted(assembly.assemble_files(classified(spark, sf), responses(spark, sf), TARGET), folder)
    return spark.read.parquet(folder).select("source_path", "output_path", "target_folder", "content")


@query
def promote(spark, sf):
    """Reports are missing for orders of the lowest priority, as if validation had broken off."""
    _, found = judged(spark, sf)
    unreported = (
        derived.table(spark, sf, "orders")
        .filter(F.col("o_orderpriority") == "5-LOW")
        .select(F.col("o_orderkey").cast("long").alias("pair_id"))
    )
    pairs = validation.pair_languages(derived.code_pairs(spark, sf))
    chosen = assembly.promote(found.join(unreported, "pair_id", "left_anti"), pairs)
    return chosen.select("pair_id", "converted_path", "status")


@query
def write_promoted(spark, sf):
    """An earlier run that passed everything, then the run that counts; read back."""
    folder = scratch_path(spark, "promoted")
    chosen = promote(spark, sf)
    sinks.write_promoted(derived.code_pairs(spark, sf).select("pair_id", "converted_path", F.lit("validated").alias("status")), folder)
    sinks.write_promoted(chosen, folder)
    return sinks.read_promoted(spark, folder)


# --- filters ----------------------------------------------------------------


@query
def filter_extension(spark, sf):
    return filters.filter_extension(docs(spark, sf)).select(*FILE, "size")


@query
def prune_dirs(spark, sf):
    return filters.prune_dirs(code(spark, sf)).select(*FILE, "size")


@query
def filter_file_name(spark, sf):
    """Files named after the kind of event they stand for."""
    kind = F.when(F.col("event_type") == "click", F.lit("config.json")).otherwise(
        F.concat("event_type", F.lit(".json"))
    )
    events = derived.table(spark, sf, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("repo"),
        F.concat_ws("/", F.col("event_id").cast("string"), kind).alias("path"),
    )
    return filters.filter_file_name(events)


@query
def filter_max_size(spark, sf):
    return filters.filter_max_size(docs(spark, sf), 4096).select(*FILE, "size")


@query
def filter_convertible(spark, sf):
    return filters.filter_convertible(classified(spark, sf)).select(*FILE, "language")


@query
def files_without_segments(spark, sf):
    """Files in which the brace rule finds nothing."""
    return filters.files_without_segments(
        classified(spark, sf), segmentation.segment_braced(code(spark, sf))
    ).select(*FILE)


# --- limits and order -------------------------------------------------------


@query
def truncate_lines(spark, sf):
    return limits.truncate_lines(docs(spark, sf), TEXT_LINES)


@query
def admit_within_budget(spark, sf):
    return limits.admit_within_budget(code(spark, sf), SCAN_BYTES).select(*FILE, "size")


@query
def limit_files(spark, sf):
    return limits.limit_files(code(spark, sf)).select(*FILE, "size")


def _banded(spark, sf):
    """Documents with priorities by their number of lines in hundreds."""
    scaled = classify.file_metrics(docs(spark, sf)).withColumn("loc", F.col("loc") * 100)
    return classify.priority_band(scaled)


@query
def priority_queue(spark, sf):
    return limits.priority_queue(_banded(spark, sf))


@query
def next_file(spark, sf):
    return limits.next_file(_banded(spark, sf))


# --- scalar functions -------------------------------------------------------


@query
def classify_language(spark, sf):
    return classify.classify_language(code(spark, sf)).select(*FILE, "language")


@query
def file_metrics(spark, sf):
    return classify.file_metrics(docs(spark, sf)).select(*FILE, "loc", "complexity_score")


@query
def priority_band(spark, sf):
    return _banded(spark, sf).select(*FILE, "loc", "difficulty", "priority")


@query
def extension_for_language(spark, sf):
    return classified(spark, sf).select(*FILE, language.extension_for_language(F.col("language")).alias("extension"))


@query
def split_lines(spark, sf):
    found = docs(spark, sf).select(*FILE, F.posexplode(text.split_lines(F.col("content"))).alias("line_no", "line"))
    return found


@query
def output_path(spark, sf):
    return code(spark, sf).select(*FILE, language.output_path(F.col("path"), F.lit("C#")).alias("output_path"))


@query
def build_conversion_prompt(spark, sf):
    """From tables of segments and contexts, both made from one stored table of files and what they hold."""
    folder = scratch_path(spark, "segmented")
    found = segmented(classified(spark, sf)).select(*FILE, "content", "language", "_hidden", "segments")
    found.write.parquet(folder)
    files = spark.read.schema(found.schema).parquet(folder)
    found = segmentation.segment_code(files).join(files.select(*FILE, "language"), FILE)
    return requests.build_conversion_prompt(found, context.extract_context(files), TARGET)


@query
def conversion_requests(spark, sf):
    """The same requests straight from the files."""
    return requests.conversion_requests(classified(spark, sf), TARGET)


@query
def strip_code_fence(spark, sf):
    return derived.attempts(spark, sf).select(
        "request_id", "attempt_no", text.strip_code_fence(F.col("text")).alias("answer")
    )


@query
def build_review_prompt(spark, sf):
    return requests.build_review_prompt(derived.code_pairs(spark, sf))


@query
def parse_verdict(spark, sf):
    return derived.review_responses(spark, sf).select("pair_id", verdict(F.col("text")).alias("passed"))


@query
def pair_languages(spark, sf):
    return validation.pair_languages(derived.code_pairs(spark, sf)).select(
        "pair_id", "source_language", "target_language", "is_cross_language"
    )


@query
def slice_code(spark, sf):
    """By offsets for functions, by lines for classes, by the stored code for whole files."""
    found = segmentation.segment_code(code(spark, sf))
    is_class, is_file = F.col("node_type").startswith("class"), F.col("node_type") == "File"
    varied = found.withColumns(
        {
            "start_char": F.when(~is_class & ~is_file, F.col("start_char")),
            "start_line": F.when(~is_file, F.col("start_line")),
        }
    )
    return segmentation.slice_code(code(spark, sf), varied).select(*SEGMENT, "code_chunk")


@query
def preview(spark, sf):
    shown = docs(spark, sf)
    return shown.select(
        *FILE,
        text.segment_preview(F.col("content")).alias("as_segment"),
        text.context_preview(F.col("content")).alias("as_context"),
    )


@query
def count_substring(spark, sf):
    return docs(spark, sf).select(
        *FILE,
        text.count_substring(F.col("content"), "an").alias("an"),
        text.count_substring(F.col("content"), ". ").alias("sentences"),
    )


@query
def json_path(spark, sf):
    found = {"k": "k", "below_scalar": "k.x", "missing": "a.b"}
    return derived.table(spark, sf, "events").select(
        "event_id", *[text.json_path(F.col("props"), p, "default").alias(n) for n, p in found.items()]
    )


# --- lines, chunks, segments ------------------------------------------------


@query
def explode_lines(spark, sf):
    return lines.explode_lines(code(spark, sf))


@query
def explode_lines_of_text(spark, sf):
    return lines.explode_lines(docs(spark, sf)).select(*FILE, "line_no", "start_char", "indent", "text", "is_blank")


@query
def chunk_lines(spark, sf):
    return lines.chunk_lines(docs(spark, sf), TEXT_LINES)


@query
def join_chunks(spark, sf):
    return lines.join_chunks(lines.chunk_lines(docs(spark, sf), TEXT_LINES))


@query
def segment_python(spark, sf):
    return segmentation.segment_python(code(spark, sf))


@query
def segment_braced(spark, sf):
    return segmentation.segment_braced(code(spark, sf))


@query
def segment_javascript_regex(spark, sf):
    return segmentation.segment_javascript_regex(code(spark, sf))


@query
def segment_whole_file(spark, sf):
    return segmentation.segment_whole_file(code(spark, sf))


@query
def segment_code(spark, sf):
    return segmentation.segment_code(code(spark, sf))


@query
def extract_imports(spark, sf):
    return dependencies.extract_imports(code(spark, sf))


@query
def extract_modules(spark, sf):
    return dependencies.extract_modules(code(spark, sf))


@query
def modules_of_imports(spark, sf):
    return dependencies.modules_of_imports(dependencies.extract_imports(code(spark, sf)))


@query
def extract_calls(spark, sf):
    return dependencies.extract_calls(code(spark, sf))


@query
def extract_calls_with_keywords(spark, sf):
    return dependencies.extract_calls(code(spark, sf), exclude_keywords=False)


@query
def extract_variables(spark, sf):
    return dependencies.extract_variables(code(spark, sf))


@query
def structural_elements(spark, sf):
    """Of both sides of each pair, lists as comma-separated text."""
    pairs = derived.code_pairs(spark, sf)

    def side(name: str) -> list:
        found = elements_of(F.col(f"{name}_code"), language.bare_suffix(F.col(f"{name}_path")))
        return [found.alias(name)]

    both = pairs.select("pair_id", *side("original"), *side("converted"))
    return both.select(
        "pair_id",
        *[F.array_join(F.col(s)[f], ",").alias(f"{s}_{f}") for s in ("original", "converted") for f in STRUCTURE_FIELDS],
    )


# --- context and other joins ------------------------------------------------


def _flat(contexts: DataFrame) -> DataFrame:
    return contexts.select(
        *SEGMENT,
        "context_code",
        F.col("source_lines")[0].alias("first_line"),
        F.col("source_lines")[1].alias("last_line"),
    )


@query
def definition_context(spark, sf):
    """From stored tables of segments and imports of Python files."""
    python = filters.filter_extension(code(spark, sf), [".py"])
    found = segmentation.segment_python(python)
    return _flat(context.definition_context(found, found, dependencies.extract_imports(python)))


@query
def declaration_context(spark, sf):
    return _flat(context.declaration_context(code(spark, sf)))


@query
def prefix_context(spark, sf):
    return _flat(context.prefix_context(code(spark, sf)))


@query
def statement_context(spark, sf):
    return _flat(context.statement_context(code(spark, sf)))


@query
def extract_context(spark, sf):
    return _flat(context.extract_context(code(spark, sf)))


@query
def attach_responses(spark, sf):
    found = named_segments(spark, sf)
    return requests.attach_responses(found, answers_to(found)).select(*SEGMENT, "name", "response")


@query
def unanswered_segments(spark, sf):
    found = named_segments(spark, sf)
    return requests.unanswered_segments(found, answers_to(found)).select(*SEGMENT, "name")


def _converted(spark, sf):
    return assembly.assemble_files(classified(spark, sf), responses(spark, sf), TARGET)


@query
def pair_converted(spark, sf):
    return assembly.pair_converted(code(spark, sf), _converted(spark, sf), TARGET)


@query
def unconverted_files(spark, sf):
    return assembly.unconverted_files(code(spark, sf), _converted(spark, sf), TARGET).select(*FILE, "size")


# --- aggregates and reports -------------------------------------------------


@query
def language_stats(spark, sf):
    return reports.language_stats(classified(spark, sf))


@query
def language_files(spark, sf):
    return reports.language_files(classified(spark, sf))


def _details(spark, sf):
    return reports.file_details(segmentation.with_segments(classified(spark, sf)))


@query
def file_details(spark, sf):
    """From stored tables, with an error noted for files that belong to no package."""
    files = classified(spark, sf)
    errors = files.filter(~F.contains("path", F.lit("/pkg"))).select(*FILE, F.lit("not in a package").alias("error"))
    return reports.file_details(files, segmentation.segment_code(files), errors)


@query
def segment_stats(spark, sf):
    return reports.segment_stats(_details(spark, sf))


@query
def node_type_distribution(spark, sf):
    return reports.node_type_distribution(segmentation.segment_code(code(spark, sf)))


@query
def with_share(spark, sf):
    return reports.with_share(reports.language_stats(classified(spark, sf)), "files")


@query
def corpus_summary(spark, sf):
    found = reports.corpus_summary(_details(spark, sf))
    return found.withColumn("languages", F.array_join("languages", ","))


@query
def run_summary(spark, sf):
    return reports.run_summary(classified(spark, sf), _converted(spark, sf))


@query
def assemble_files(spark, sf):
    return _converted(spark, sf)


@query
def resolve_attempts(spark, sf):
    return requests.resolve_attempts(derived.attempts(spark, sf))


@query
def pass_fail_counts(spark, sf):
    return reports.pass_fail_counts(judged(spark, sf)[0])


@query
def validation_matrix(spark, sf):
    return reports.matrix_of_reports(judged(spark, sf)[1])


# --- graph ------------------------------------------------------------------


@query
def dependency_nodes(spark, sf):
    return dependencies.dependency_nodes_of_files(code(spark, sf))


@query
def dependency_nodes_by_file(spark, sf):
    files = code(spark, sf)
    return dependencies.dependency_nodes_by_file(dependencies.extract_modules(files), dependencies.extract_calls(files))


@query
def dependency_edges(spark, sf):
    return dependencies.dependency_edges(dependencies.extract_imports(code(spark, sf)))


@query
def module_fan_in(spark, sf):
    return dependencies.module_fan_in_of_files(code(spark, sf), 25)


# --- validation -------------------------------------------------------------


@query
def complexity_metrics(spark, sf):
    found = validation.complexity_metrics(code(spark, sf))
    return found.withColumn("complexity_score", F.round("complexity_score", 4))


@query
def complexity_metrics_of_text(spark, sf):
    found = validation.complexity_metrics(docs(spark, sf))
    return found.withColumn("complexity_score", F.round("complexity_score", 4))


@query
def complexity_check(spark, sf):
    return validation.complexity_check(derived.code_pairs(spark, sf))


@query
def structural_check(spark, sf):
    return validation.structural_check(derived.code_pairs(spark, sf))


@query
def normalised_source_check(spark, sf):
    return validation.normalised_source_check(derived.python_pairs(spark, sf))


@query
def runtime_check(spark, sf):
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return validation.runtime_check(derived.timings(spark, sf), keys)


@query
def verdict_check(spark, sf):
    return validation.verdict_check(derived.review_responses(spark, sf))


@query
def apply_leniency(spark, sf):
    return validation.apply_leniency(
        validation.verdict_check(derived.pair_reviews(spark, sf)), derived.code_pairs(spark, sf)
    )


@query
def overall_verdict(spark, sf):
    pairs = derived.code_pairs(spark, sf)
    stored = validation.structural_check(pairs).unionByName(validation.complexity_check(pairs))
    return validation.overall_verdict(stored, pairs)


@query
def run_validators(spark, sf):
    return judged(spark, sf)[0]


@query
def validation_reports(spark, sf):
    return judged(spark, sf)[1].select(
        "pair_id", "overall_passed", "is_cross_language", "strict_mode", F.size("matrix").alias("validators")
    )


@query
def validation_reports_strict(spark, sf):
    """Strict, and without the review."""
    return judged(spark, sf, strict=True, skip=["review"])[1].select(
        "pair_id", "overall_passed", "is_cross_language", "strict_mode", F.size("matrix").alias("validators")
    )


# --- whole flows ------------------------------------------------------------


@query
def corpus_to_requests(spark, sf):
    """Scan rules, classification, segments, contexts and requests in one map over the corpus."""
    return conversion.corpus_to_requests(code(spark, sf), TARGET)


@query
def corpus_report_languages(spark, sf):
    return reporting.corpus_report(conversion.scan_corpus(code(spark, sf))).languages


@query
def corpus_report_details(spark, sf):
    return reporting.corpus_report(conversion.scan_corpus(code(spark, sf))).details


@query
def corpus_report_summary(spark, sf):
    found = reporting.corpus_report(conversion.scan_corpus(code(spark, sf))).summary
    return found.withColumn("languages", F.array_join("languages", ","))


@query
def corpus_report_segments(spark, sf):
    return reporting.corpus_report(conversion.scan_corpus(code(spark, sf))).segments


@query
def corpus_report_node_types(spark, sf):
    return reporting.corpus_report(conversion.scan_corpus(code(spark, sf))).node_types
