"""Labelled text corpora, statement files, and the file exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tavola.functions.formatting import as_text
from tavola.operators.listing import browse
from tavola.sources.tables import SENSITIVE

# Headers of the dish report, and words a statement line starts with.
REPORT_HEADERS = {"restaurant": "Ресторан", "dish": "Блюдо", "total": "Продано"}
STARTERS = "SELECT|WITH|EXPLAIN|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE"


def clean_corpus(df: DataFrame) -> DataFrame:
    """First two columns as (query, label), without NULLs and repeated rows."""
    query, label = df.columns[:2]
    named = df.withColumnsRenamed({query: "query", label: "label"})
    return named.na.drop().dropDuplicates()


def read_corpus(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A labelled corpus from CSV. `multi_line` allows line breaks in quotes; a file is then one task."""
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return clean_corpus(raw).withColumn("label", F.col("label").cast("int"))


def report_headers(report: DataFrame) -> DataFrame:
    return report.withColumnsRenamed(REPORT_HEADERS)


def write_report(report: DataFrame, path: str) -> None:
    """The dish report as CSV with its own headers."""
    report_headers(report).write.mode("overwrite").option("header", True).csv(path)


def exported(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables outside the deny-list, as text columns."""
    return {name: as_text(tables[name]) for name in sorted(set(tables) - set(SENSITIVE))}


def export_tables(
    tables: dict[str, DataFrame], path: str, fmt: str = "csv", limit: int | None = None
) -> list[str]:
    """Write every table outside the deny-list as text columns; returns the names written.

    `limit` is for a sheet-sized preview; whole tables are written without it.
    """
    kept = tables if limit is None else {n: browse(df, limit=limit) for n, df in tables.items()}
    found = exported(kept)
    for name, df in found.items():
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/{name}")
    return list(found)


# Statement files ---------------------------------------------------------------------------

# A part runs to a semicolon outside quotes; a quote after a backslash is plain.
_PART = (
    r"(?s)(?:[^;'\"]++|(?<=\\)['\"]"
    r"|'(?:[^']++|(?<=\\)')*+(?:'|\z)"
    r"|\"(?:[^\"]++|(?<=\\)\")*+(?:\"|\z))*+(?:;|\z)"
)
# A numbered line and what follows it up to the next one; what stands before the first is a section too.
_NUMBER = r"[ \t]*\d+[.)]\s"
_SECTION = rf"(?ms)(?:^{_NUMBER}|\A(?!{_NUMBER})).*?(?=^{_NUMBER}|\z)"


def _statement(lines: Column) -> Column:
    """From the last line that starts a statement to the end, joined by blanks."""
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))),
        lambda i: F.try_element_at(lines, i).rlike(rf"(?i)^({STARTERS})"),
    )
    first = F.array_max(starts)
    return F.when(first.isNotNull(), F.array_join(F.slice(lines, first, F.size(lines)), " "))


def split_statements(df: DataFrame, column: str = "sql") -> DataFrame:
    """One row per `;`-ended part outside quotes; `part` counts from 1."""
    parts = F.filter(
        F.transform(F.regexp_extract_all(column, F.lit(_PART), F.lit(0)), lambda p: F.trim(p)),
        lambda p: p != "",
    )
    others = [c for c in df.columns if c != column]
    split = df.select(*others, F.posexplode(parts).alias("part", column))
    return split.withColumn("part", F.col("part") + 1)


def statements_of(df: DataFrame, column: str = "value") -> DataFrame:
    """(section, description, part, sql) of texts holding numbered questions and statements.

    Statements before the first numbered line are section 0, with an empty description.
    """
    section = F.regexp_extract_all(column, F.lit(_SECTION), F.lit(0))
    others = [c for c in df.columns if c != column]
    titled = F.try_element_at("sections", F.lit(1)).rlike(rf"\A{_NUMBER}")
    rows = df.select(*others, section.alias("sections")).select(*others, titled.cast("int").alias("first"), F.posexplode("sections").alias("section", "body"))
    trimmed = F.transform(F.split("body", r"\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(trimmed, lambda x: x != "")
    rows = rows.select(*others, (F.col("section") + F.col("first")).alias("section"), lines.alias("lines")).where(F.size("lines") > 0)
    head = F.regexp_replace(F.try_element_at("lines", F.lit(1)), r"^\d+[.)]\s*", "")
    rows = rows.select(
        *others,
        "section",
        F.when(F.col("section") > 0, head).otherwise("").alias("description"),
        F.when(F.col("section") > 0, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines")).alias("rest"),
    )
    rows = rows.withColumn("sql", _statement(F.col("rest"))).drop("rest")
    return split_statements(rows.where(F.col("sql").isNotNull()))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    return statements_of(spark.read.text(path, wholetext=True))


def read_statements_split(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, description, part, sql) of files that many tasks share.

    Spark reads byte ranges of lines. Numbered lines are counted per range, and the counts of a file's
    earlier ranges give every line its section; only a section's lines come together in one row.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").rlike(rf"^\s*{_NUMBER}").cast("int").alias("numbered"),
    )
    in_range = W.partitionBy("file", "start").orderBy("place")
    counted = lines.withColumn("running", F.sum("numbered").over(in_range.rowsBetween(W.unboundedPreceding, 0)))
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ranges = counted.groupBy("file", "start").agg(F.max("running").alias("n"))
    before = ranges.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = counted.join(before, ["file", "start"]).withColumn("section", F.col("before") + F.col("running"))
    bodies = placed.groupBy("file", "section").agg(F.sort_array(F.collect_list(F.struct("start", "place", "value"))).alias("l"))
    texts = bodies.select("file", F.col("section").alias("number"), F.array_join("l.value", "\n").alias("value"))
    return statements_of(texts).select("file", F.col("number").alias("section"), "description", "part", "sql")
