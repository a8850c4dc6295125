"""Screening of the query log and of names and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tavola.functions import sqlguard as g
from tavola.operators import guard
from tavola.plans.registry import query
from tavola.session import shared_dir
from tavola.sources import corpus
from tavola.sources.tables import catalog_of


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?m)--.*?$', '', 'g'),
            '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))"""


def _hits(column: str) -> str:
    """A list of the forbidden words found, built word by word."""
    parts = []
    for word in sorted(g.FORBIDDEN):
        before = f"substr({column}, 1, instr({column}, '{word}') - 1)"
        odd = " OR ".join(
            f"(length({before}) - length(replace({before}, {q}, ''))) % 2 = 1" for q in ("''''", "'\"'")
        )
        parts.append(
            rf"CASE WHEN regexp_matches({column}, '(^|\s|;)\b{word}\b(\s|\(|;|$)', 'i') AND NOT ({odd}) THEN '{word}' END"
        )
    return (
        f"CASE WHEN contains({column}, 'information_schema') OR contains({column}, 'pg_catalog') THEN '' "
        f"ELSE concat_ws(',', {', '.join(parts)}) END"
    )


def _base(text: str, source: str, more: str = "") -> str:
    """Findings per text, as CTEs ending in `f`."""
    white = " OR ".join(f"regexp_matches(clean, {_lit(p)}, 'is')" for p in g.WHITELIST)
    pattern = "COALESCE(" + ", ".join(
        f"CASE WHEN regexp_matches(clean, {_lit(p)}, 'i') THEN {_lit(p)} END" for p in g.DANGEROUS
    ) + ")"
    return rf"""
        t AS (SELECT *, {text} AS txt FROM ({source})),
        n AS (SELECT *, lower({CLEAN.format('txt')}) AS clean FROM t),
        f0 AS (SELECT *, ({white}) AND len(list_filter(
                   list_concat(regexp_extract_all(txt, '(?m)--.*?$'), regexp_extract_all(txt, '(?s)/\*.*?\*/')),
                   lambda c: regexp_matches(c, {_lit(g.COMMENT_DANGER)}, 'i'))) = 0 AS white,
                CASE WHEN length(clean) > 10000 THEN {_lit(g.TOO_LONG)}
                     WHEN length(txt) - length(replace(txt, '''', '')) > 20
                       OR length(txt) - length(replace(txt, '"', '')) > 20 THEN {_lit(g.TOO_MANY_QUOTES)} END AS structure,
                length(clean) - length(replace(clean, ';', '')) AS ends,
                len(list_filter(string_split(clean, ';'), lambda p: trim(p) <> '')) AS parts,
                starts_with(clean, 'select') OR starts_with(clean, 'with') OR starts_with(clean, 'explain') AS safe_start,
                {_hits('clean')} AS forbidden, {pattern} AS pattern FROM n),
        f1 AS (SELECT *, (ends > 1 OR (ends = 1 AND NOT ends_with(clean, ';'))) AND parts > 1 AS stacked FROM f0),
        f AS (SELECT *, CASE WHEN clean = '' THEN {_lit(g.EMPTY)} WHEN stacked THEN {_lit(g.STACKED)}
                  WHEN NOT safe_start THEN {_lit(g.NOT_SELECT)}
                  WHEN forbidden <> '' THEN {_lit(g.KEYWORD)} || replace(forbidden, ',', ', ')
                  WHEN pattern IS NOT NULL THEN {_lit(g.PATTERN)} || pattern END AS rule {more} FROM f1)"""


LOG = _base("sql", "SELECT * FROM d_sql_log")
SCAN = """SELECT *, CASE WHEN white THEN 'whitelist' WHEN structure IS NOT NULL THEN 'structure_validation'
              WHEN rule IS NOT NULL THEN 'rule_based' ELSE 'ml' END AS layer,
              CASE WHEN white THEN true WHEN structure IS NOT NULL OR rule IS NOT NULL THEN false END AS allowed FROM f"""


def _log(c):
    return c.sql_log.select("log_id", "sql")


@query("o80_normalize", f"SELECT log_id, {CLEAN.format('sql')} AS normalized FROM d_sql_log")
def _(c):
    return c.sql_log.select("log_id", g.normalized(F.col("sql")).alias("normalized"))


@query("o81_whitelist", f"WITH {LOG} SELECT log_id, white AS whitelisted FROM f")
def _(c):
    clean = F.lower(g.normalized(F.col("sql")))
    return c.sql_log.select("log_id", g.whitelisted(F.col("sql"), clean).alias("whitelisted"))


@query(
    "o82_dangerous_comments",
    rf"""SELECT log_id, len(list_filter(list_concat(regexp_extract_all(sql, '(?m)--.*?$'),
            regexp_extract_all(sql, '(?s)/\*.*?\*/')), lambda c: regexp_matches(c, {_lit(g.COMMENT_DANGER)}, 'i'))) > 0 AS dangerous
         FROM d_sql_log""",
)
def _(c):
    return c.sql_log.select("log_id", g.dangerous_comment(F.col("sql")).alias("dangerous"))


@query("o83_structure", f"WITH {LOG} SELECT log_id, COALESCE(structure, '') AS reason FROM f")
def _(c):
    clean = g.normalized(F.col("sql"))
    reason = g.structure_reason(F.col("sql"), clean)
    return c.sql_log.select("log_id", F.coalesce(reason, F.lit("")).alias("reason"))


@query(
    "o84_o88_rules",
    f"""WITH {LOG} SELECT log_id, clean AS normalized, stacked, safe_start, forbidden, pattern,
                          rule IS NOT NULL AS blocked, COALESCE(rule, '') AS reason FROM f""",
)
def _(c):
    return guard.rule_findings(_log(c))


@query(
    "o89_cascade",
    f"""WITH {LOG} SELECT log_id, sql, allowed, layer, CASE WHEN NOT white THEN COALESCE(structure, rule) END AS reason,
               CAST(NULL AS DOUBLE) AS risk_score, white AND (structure IS NOT NULL OR rule IS NOT NULL) AS bypass_suspect
        FROM ({SCAN})""",
)
def _(c):
    return guard.scan(_log(c))


SUSPICION = " OR ".join(f"regexp_matches(lower(sql), {_lit(p)}, 'i')" for p in g.SUSPICIOUS)
SPECIALS = r"""len(regexp_extract_all(sql, '[()\[\]{}"''`;]')) > 20"""

SCORED = f"""{SCAN.replace('FROM f', '''FROM (SELECT *, (log_id * 37 % 1000) / 1000.0::DOUBLE AS score,
              CASE WHEN {s} THEN 0.65 ELSE 0.7367346938775511::DOUBLE END AS lim FROM f)''').replace(
    '{s}', f'{SUSPICION} OR {SPECIALS}')}"""


@query(
    "o89_cascade_scored",
    f"""WITH {LOG} SELECT log_id, CASE WHEN layer = 'ml' THEN score < lim ELSE allowed END AS allowed,
              CASE WHEN layer = 'ml' AND score < lim THEN NULL ELSE layer END AS layer,
              CASE WHEN layer = 'ml' AND score >= lim THEN round(score, 4) END AS risk_score FROM ({SCORED})""",
)
def _(c):
    scored = c.sql_log.select("log_id", "sql", (F.col("log_id") * 37 % 1000 / 1000.0).alias("score"))
    return guard.scan(scored, score="score").select("log_id", "allowed", "layer", "risk_score")


@query(
    "o90_features",
    rf"""SELECT log_id, length(q) AS length, 2 * length(q) - length(replace(q, '''', '')) - length(replace(q, '"', '')) AS num_quotes,
                len(regexp_extract_all(q, '--|/\*|\*/')) AS num_comments, length(q) - length(replace(q, ';', '')) AS num_semicolons,
                CAST(contains(q, 'union select') AS BIGINT) AS has_union,
                CAST(regexp_matches(q, 'or\s+1\s*=\s*1') AS BIGINT) AS has_or_true,
                {' + '.join(f"CAST(contains(q, {_lit(w)}) AS BIGINT)" for w in g.FEATURE_WORDS)} AS num_keywords,
                round(len(regexp_extract_all(q, '[''";-]')) / CAST(greatest(length(q), 1) AS DOUBLE), 9) AS special_char_ratio,
                CAST(regexp_matches(q, 'sleep|pg_sleep|benchmark') AS BIGINT) AS num_sleep,
                length(replace(q, ')', '')) - length(replace(q, '(', '')) AS num_subqueries
         FROM (SELECT log_id, lower(sql) AS q FROM d_sql_log)""",
)
def _(c):
    out = guard.with_features(_log(c)).drop("sql")
    return out.withColumn("special_char_ratio", F.round("special_char_ratio", 9))


@query("o91_suspicion", f"SELECT log_id, ({SUSPICION} OR {SPECIALS}) AS suspicious FROM d_sql_log")
def _(c):
    return c.sql_log.select("log_id", g.suspicious(F.col("sql")).alias("suspicious"))


CATALOG = ("part", "orders", "lineitem", "events")
COLUMNS = {
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
}


@query(
    "o101_identifiers",
    f"""WITH c(t, n) AS (VALUES {', '.join(f"('{t}', '{n}')" for t, ns in COLUMNS.items() for n in ns.split())})
        SELECT log_id, table_name, column_name,
               CASE WHEN NOT regexp_matches(table_name, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'bad table name'
                    WHEN table_name NOT IN (SELECT t FROM c) THEN 'unknown table'
                    WHEN NOT regexp_matches(column_name, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'bad column name'
                    WHEN NOT EXISTS (SELECT 1 FROM c WHERE t = table_name AND n = column_name) THEN 'unknown column'
                    ELSE '' END AS reason FROM d_sql_log""",
)
def _(c):
    catalog = catalog_of(c.spark, {t: c.raw(t) for t in CATALOG})
    names = c.sql_log.select("log_id", "table_name", "column_name")
    return guard.screen_identifiers(names, catalog)


_USER = _base("'SELECT * FROM app_users WHERE username=''' || username || ''''", "SELECT log_id, username FROM d_sql_log")


@query(
    "o102_usernames",
    f"""WITH {_USER} SELECT log_id, username, CASE WHEN username = '' THEN 'empty' WHEN length(username) > 100 THEN 'too long'
             WHEN {' OR '.join(f"contains(username, {_lit(b)})" for b in g.BANNED_IN_NAME[:-1])} THEN 'banned character'
             WHEN allowed = false THEN 'dangerous pattern' ELSE '' END AS username_reason FROM ({SCAN})""",
)
def _(c):
    return guard.screen_usernames(c.sql_log.select("log_id", "username"))


_FILTER = _base("'SELECT * FROM test_table WHERE ' || predicate", "SELECT log_id, predicate FROM d_sql_log")
_CALLS = "COALESCE(" + ", ".join(
    rf"CASE WHEN regexp_matches(lower(predicate), '\b{c}\s*\(') THEN '{c}' END" for c in g.BANNED_CALLS
) + ")"


@query(
    "o103_predicates",
    rf"""WITH {_FILTER} SELECT log_id, predicate, CASE WHEN trim(predicate) = '' THEN ''
             WHEN regexp_matches(lower(predicate), '\bselect\b.*?\bfrom\b') THEN 'subquery'
             WHEN {_CALLS} IS NOT NULL THEN 'call of ' || {_CALLS}
             WHEN contains(lower(predicate), 'union') THEN 'union'
             WHEN contains(predicate, ';') THEN 'several statements'
             WHEN allowed = false THEN COALESCE(structure, rule)
             WHEN length(predicate) - length(replace(predicate, '''', '')) > 10
               OR length(predicate) - length(replace(predicate, '"', '')) > 10 THEN 'too many quotes'
             ELSE '' END AS predicate_reason FROM ({SCAN})""",
)
def _(c):
    return guard.screen_predicates(c.sql_log.select("log_id", "predicate"))


@query("o105_guard_summary", f"WITH {LOG} SELECT layer, allowed, count(*) AS cnt FROM ({SCAN}) GROUP BY 1, 2")
def _(c):
    return guard.summary(guard.scan(_log(c)))


@query(
    "o104_statements",
    r"""WITH l AS (SELECT log_id, list_filter(list_transform(string_split(sql, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM d_sql_log),
        f AS (SELECT log_id, x, list_max(list_filter(range(1, len(x) + 1),
                  lambda i: regexp_matches(x[i], '(?i)^(SELECT|WITH|EXPLAIN|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE)'))) AS first FROM l),
        s AS (SELECT log_id, array_to_string(x[first:], ' ') AS sql FROM f WHERE first IS NOT NULL)
        SELECT log_id, len(list_filter(string_split(regexp_replace(sql, '''[^'']*''', '', 'g'), ';'), lambda p: trim(p) <> '')) AS parts FROM s""",
)
def _(c):
    """The log as one file of numbered statements, read by many tasks and split."""
    folder = f"{shared_dir(c.spark)}/statements-{uuid.uuid4().hex}"
    text = F.concat_ws("\n", F.concat(F.col("log_id").cast("string"), F.lit(". log "), F.col("log_id").cast("string")), "sql")
    c.sql_log.select(text.alias("value")).coalesce(1).write.text(folder)
    found = corpus.read_statements_split(c.spark, folder)
    numbered = found.withColumn("log_id", F.regexp_extract("description", r"log (\d+)", 1).cast("long"))
    return numbered.groupBy("log_id").agg(F.count(F.lit(1)).alias("parts"))
