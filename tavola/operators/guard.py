"""Batch screening of SQL text: verdict per statement, name or filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tavola.functions import sqlguard as g

_WORK = ["_clean", "_white", "_structure", "_hits", "_pattern", "_rule"]


def _staged(df: DataFrame, sql: str) -> DataFrame:
    """Intermediate findings as columns, each computed once."""
    text = F.col(sql)
    clean = F.col("_clean")
    return (
        df.withColumn("_clean", F.lower(g.normalized(text)))
        .withColumns(
            {
                "_white": g.whitelisted(text, clean),
                "_structure": g.structure_reason(text, clean),
                "_hits": g.forbidden_hits(clean),
                "_pattern": g.first_pattern(clean),
            }
        )
        .withColumn("_rule", g.rule_reason(clean, F.col("_hits"), F.col("_pattern")))
    )


def scan(df: DataFrame, sql: str = "sql", score: str | None = None) -> DataFrame:
    """Add `layer`, `allowed`, `reason`, `risk_score` and `bypass_suspect`.

    The whitelist comes first, then structure, rules and the model. `score` names
    a column with the model's probability; without it, undecided statements get
    layer `ml` and a NULL verdict. `bypass_suspect` marks statements that the
    whitelist admits although a rule would refuse them.
    """
    staged = _staged(df, sql)
    white, structure, rule = F.col("_white"), F.col("_structure"), F.col("_rule")
    layer = (
        F.when(white, "whitelist")
        .when(structure.isNotNull(), "structure_validation")
        .when(rule.isNotNull(), "rule_based")
    )
    reason = F.when(~white, F.coalesce(structure, rule))
    allowed = F.when(white, True).when(structure.isNotNull() | rule.isNotNull(), False)
    risk = F.lit(None).cast("double")
    if score is None:
        layer = layer.otherwise("ml")
    else:
        bad = F.col(score) >= threshold(F.col(sql))
        undecided = layer.isNull()
        layer = F.when(undecided & bad, "ml").otherwise(layer)
        allowed = F.when(undecided, ~bad).otherwise(allowed)
        risk = F.when(undecided & bad, F.round(F.col(score), 4))
    return staged.select(
        *df.columns,
        allowed.alias("allowed"),
        layer.alias("layer"),
        reason.alias("reason"),
        risk.alias("risk_score"),
        (white & (structure.isNotNull() | rule.isNotNull())).alias("bypass_suspect"),
    )


def threshold(sql: Column) -> Column:
    """The stricter limit for texts that look suspicious."""
    return F.when(g.suspicious(sql), g.STRICT_THRESHOLD).otherwise(g.THRESHOLD)


def undecided(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Statements no layer before the model decides.

    The filter needs a row number that only exists above the findings, so it is not
    pushed below them, where each finding would be written out again.
    """
    staged = _staged(df, sql).withColumn("_row", F.monotonically_increasing_id())
    kept = staged.where("_row >= 0 AND NOT _white AND _structure IS NULL AND _rule IS NULL")
    return kept.drop("_row", *_WORK)


def rule_findings(df: DataFrame, sql: str = "sql") -> DataFrame:
    """The rule layer on its own: every finding beside the resulting reason."""
    staged = _staged(df, sql)
    clean = F.col("_clean")
    return staged.select(
        *[c for c in df.columns if c != sql],
        clean.alias("normalized"),
        g.stacked(clean).alias("stacked"),
        g.safe_start(clean).alias("safe_start"),
        F.array_join("_hits", ",").alias("forbidden"),
        F.col("_pattern").alias("pattern"),
        F.col("_rule").isNotNull().alias("blocked"),
        F.coalesce("_rule", F.lit("")).alias("reason"),
    )


def with_features(df: DataFrame, sql: str = "sql") -> DataFrame:
    return df.withColumns(g.features(F.col(sql)))


def summary(scanned: DataFrame) -> DataFrame:
    """Statements per layer and verdict."""
    return scanned.groupBy("layer", "allowed").agg(F.count(F.lit(1)).alias("cnt"))


# Names and filters -------------------------------------------------------------------------


def _refused(scanned: DataFrame) -> Column:
    return ~F.coalesce("allowed", F.lit(True))


def screen_identifiers(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add `reason`, empty when table and column names are well formed and known.

    `df` has `table_name` and `column_name`; the catalog side has one row per column.
    """
    def well_formed(c: str) -> Column:
        return F.col(c).rlike(r"(?d)^[a-zA-Z_][a-zA-Z0-9_]*$")

    tables = catalog.select("table_name", F.lit(True).alias("_table")).distinct()
    columns = catalog.select("table_name", "column_name", F.lit(True).alias("_column"))
    reason = (
        F.when(~well_formed("table_name"), "bad table name")
        .when(F.col("_table").isNull(), "unknown table")
        .when(~well_formed("column_name"), "bad column name")
        .when(F.col("_column").isNull(), "unknown column")
        .otherwise("")
    )
    return (
        df.join(tables, "table_name", "left")
        .join(columns, ["table_name", "column_name"], "left")
        .withColumn("reason", reason)
        .drop("_table", "_column")
    )


def screen_usernames(df: DataFrame, column: str = "username") -> DataFrame:
    """Add `reason`, empty when the name is acceptable.

    A name that no layer before the model refuses is taken as acceptable here.
    """
    name = F.col(column)
    banned = F.exists(F.array(*[F.lit(b) for b in g.BANNED_IN_NAME]), lambda b: F.contains(name, b))
    statement = F.concat(F.lit("SELECT * FROM app_users WHERE username='"), name, F.lit("'"))
    scanned = scan(df.withColumn("_sql", statement), "_sql")
    reason = (
        F.when(name.isNull() | (name == ""), "empty")
        .when(F.length(name) > g.LONGEST_NAME, "too long")
        .when(banned, "banned character")
        .when(_refused(scanned), "dangerous pattern")
        .otherwise("")
    )
    return scanned.select(*df.columns, reason.alias("username_reason"))


def screen_predicates(df: DataFrame, column: str = "predicate") -> DataFrame:
    """Add `reason`, empty when a filter text is acceptable; an empty text is."""
    text = F.col(column)
    low = F.trim(F.lower(text))
    calls = [F.when(g.matches(low, rf"\b{c}\s*\(", "U"), F.lit(c)) for c in g.BANNED_CALLS]
    quotes = (g.occurrences(text, "'") > g.MOST_FILTER_QUOTES) | (
        g.occurrences(text, '"') > g.MOST_FILTER_QUOTES
    )
    scanned = scan(
        df.withColumn("_sql", F.concat(F.lit("SELECT * FROM test_table WHERE "), text)), "_sql"
    )
    reason = (
        F.when(text.isNull() | (low == ""), "")
        .when(g.matches(low, r"\bselect\b.*?\bfrom\b", "iUd"), "subquery")
        .when(F.coalesce(*calls).isNotNull(), F.concat(F.lit("call of "), F.coalesce(*calls)))
        .when(F.contains(low, F.lit("union")), "union")
        .when(F.contains(text, F.lit(";")), "several statements")
        .when(_refused(scanned), F.col("reason"))
        .when(quotes, "too many quotes")
        .otherwise("")
    )
    return scanned.select(*df.columns, reason.alias("predicate_reason"))
