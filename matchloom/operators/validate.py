"""Rules for the two result files; every rule is a query that yields findings."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tsv import exists, numbered, read_ids

FINDING = "rule string, severity string, n bigint, examples array<string>"
MATCH_HEADER, CANDIDATE_HEADER = "source1_entity_id\tmatched_entity_ids", "source1_entity_id\tcandidate_entity_ids"


def finding(items: DataFrame, rule: str, severity: str = "error") -> DataFrame:
    """One row if ``items`` (item: string) has any: distinct count and the first five.

    The five come from a bounded top-k, never from all items in one value.
    """
    distinct = items.select("item").distinct()
    top = distinct.orderBy("item").limit(5).agg(F.array_sort(F.collect_list("item")).alias("examples"))
    return distinct.agg(F.count("*").alias("n")).crossJoin(top).where("n > 0").select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def note(spark: SparkSession, rule: str, text: str, severity: str = "error") -> DataFrame:
    return spark.createDataFrame([(rule, severity, 1, [text])], FINDING)


def id_rows(lines: DataFrame) -> DataFrame:
    """Lines (value, ord) with a tab as (s1, ids, ord); ids are not trimmed."""
    has_tab = lines.where(F.contains("value", F.lit("\t")))
    rest = F.substring(F.col("value"), F.instr("value", "\t") + 1, F.length("value"))
    return has_tab.select(F.trim(F.substring_index("value", "\t", 1)).alias("s1"), X.id_list(rest, trimmed=False).alias("ids"), "ord")


def malformed(lines: DataFrame) -> DataFrame:
    """Lines that are not blank and have no tab (V6)."""
    return lines.where(~F.contains("value", F.lit("\t")) & (F.trim("value") != "")).select(F.concat(F.lit("line "), F.col("line").cast("string")).alias("item"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s1").agg(F.count("*").alias("n")).where("n > 1").select(F.col("s1").alias("item"))


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1").alias("item"))


def listed(rows: DataFrame) -> DataFrame:
    return rows.select("s1", F.explode("ids").alias("item"))


def self_matches(rows: DataFrame) -> DataFrame:
    return listed(rows).where("item like 'S1-%'").select("item")


def bad_prefixes(rows: DataFrame) -> DataFrame:
    """Ids of no known source; S1 ids have a rule of their own."""
    return listed(rows).where("not (item like 'S1-%' or item like 'S2-%' or item like 'S3-%')").select("item")


def unknown_ids(rows: DataFrame, targets: DataFrame) -> DataFrame:
    own = listed(rows).where("item like 'S2-%' or item like 'S3-%'").select("item")
    return own.join(targets.select(F.col("entity_id").alias("item")), "item", "left_anti")


def missing_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return required.select(F.col("entity_id").alias("item")).distinct().join(rows.select(F.col("s1").alias("item")), "item", "left_anti")


def extra_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return rows.select(F.col("s1").alias("item")).distinct().join(required.select(F.col("entity_id").alias("item")), "item", "left_anti")


def last_rows(rows: DataFrame) -> DataFrame:
    """The last list of each S1 id."""
    return rows.groupBy("s1").agg(F.max_by("ids", "ord").alias("ids"))


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """S1 ids with a matched id that is no candidate, by last rows."""
    m, c = listed(last_rows(matches)), listed(last_rows(candidates))
    return m.join(c, ["s1", "item"], "left_anti").select(F.col("s1").alias("item")).distinct()


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``line``, from 1, to numbered lines: the place within the split, after the lines of all splits before it."""
    split = F.shiftright("ord", 33)
    counts = lines.groupBy(split.alias("split")).agg(F.count("*").alias("n"))  # a row for each split
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("split", before.alias("before")))  # splits are few next to lines
    place = F.col("ord").bitwiseAND((1 << 33) - 1)
    return lines.withColumn("split", split).join(starts, "split").withColumn("line", F.col("before") + place + 1).drop("split", "before")


def file_findings(spark: SparkSession, path: str, expected: str, required: DataFrame, targets: DataFrame | None) -> tuple[list[DataFrame], DataFrame | None]:
    """Findings of one file, and its rows if it could be read as a table."""
    if not exists(spark, path):
        return [note(spark, "V2", f"missing: {path}")], None
    try:
        raw = spark.read.format("binaryFile").load(path).select("length").first()
        if not raw or not raw.length:
            return [note(spark, "V3", f"empty: {path}")], None
        lines = numbered(spark.read.text(path))
        # Lines are cut at bytes, so the test is on a line's own bytes; a U+FFFD that the file holds is valid.
        if not spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\n", quote="", schema="value string").where(~F.is_valid_utf8(F.encode("value", "ISO-8859-1").cast("string"))).isEmpty():
            return [note(spark, "V17", f"not UTF-8: {path}")], None
    except Py4JJavaError as error:  # the file can't be read
        return [note(spark, "V17", f"unreadable: {path}: {str(error.java_exception)[:200]}")], None
    head = lines.orderBy("ord").limit(1).collect()[0]
    first = head.value.rstrip("\r")
    if "\t" not in first and "," in first:
        return [note(spark, "V4", "comma-separated header")], None
    if [c.strip().lower() for c in first.split("\t")] != expected.split("\t"):
        return [note(spark, "V5", f"header {first!r}, expected {expected!r}")], None
    body = with_line_numbers(lines).where(F.col("ord") != F.lit(head.ord)).withColumn("value", F.rtrim(F.col("value"), F.lit("\r")))
    rows = id_rows(body)
    rules = [("V6", malformed(body)), ("V7", duplicate_rows(rows)), ("V8", repeated_ids(rows)), ("V9", self_matches(rows)), ("V10", bad_prefixes(rows)), ("V12", missing_rows(rows, required)), ("V13", extra_rows(rows, required))]
    if targets is not None:
        rules.append(("V11", unknown_ids(rows, targets)))
    return [finding(items, rule) for rule, items in rules], rows


def validate(spark: SparkSession, matching_path: str, candidate_path: str | None, test_dir: str, check_ids: bool = False) -> DataFrame:
    """All findings (rule, severity, n, examples) of a submission."""
    s1_path = f"{test_dir}/test_source1.tsv"
    if not exists(spark, s1_path):
        return note(spark, "V1", f"missing: {s1_path}")
    required, targets, out = read_ids(spark, s1_path), None, []
    if check_ids:
        paths = [f"{test_dir}/test_source{k}.tsv" for k in (2, 3)]
        there = [p for p in paths if exists(spark, p)]
        if len(there) == 2:
            targets = read_ids(spark, paths[0]).union(read_ids(spark, paths[1])).distinct()
        else:
            out.append(note(spark, "V16", "target files missing; ids not checked", "warning"))
    else:
        out.append(note(spark, "V16", "ids not checked", "warning"))
    found, matches = file_findings(spark, matching_path, MATCH_HEADER, required, targets)
    out += found
    if not candidate_path or not exists(spark, candidate_path):
        out.append(note(spark, "V14", "no candidate file; skipped", "warning"))
    else:
        found, candidates = file_findings(spark, candidate_path, CANDIDATE_HEADER, required, targets)
        out += found
        if matches is not None and candidates is not None:
            out.append(finding(not_candidates(matches, candidates), "V15", "warning"))
    return reduce(DataFrame.unionByName, out)


def report(findings: DataFrame) -> tuple[list[str], int]:
    """Numbered lines and the exit code: 1 with any error."""
    rows = findings.orderBy("severity", "rule").collect()  # a row for each rule at most
    errors = [r for r in rows if r.severity == "error"]
    text = [f"WARNING {r.rule}: {r.n} ({', '.join(r.examples)})" for r in rows if r.severity == "warning"]
    text += [f"{k}. {r.rule}: {r.n} ({', '.join(r.examples)})" for k, r in enumerate(errors, 1)]
    return text or ["PASS"], int(bool(errors))


