"""Verdicts of the layers before the model."""

import pytest
from pyspark.sql import functions as F

from tavola.functions import sqlguard as g
from tavola.operators import guard
from tests.conftest import rows

ATTACKS = [
    # statement, layer that decides
    ("SELECT * FROM t WHERE id = 1 UNION SELECT * FROM secrets", "ml"),
    ("SELECT * FROM t WHERE id = 1 OR 1=1 --", "ml"),
    ("SELECT * FROM t WHERE id = 1 AND 1=1 --", "ml"),
    ("SELECT * FROM t; -- DROP TABLE t", "ml"),
    ("SELECT * FROM t /* DROP TABLE t */", "ml"),
    ("SELECT a FROM t, u UNION SELECT * FROM information_schema.tables", "ml"),
    ("SELECT * FROM t UNION ALL SELECT * FROM secrets", "rule_based"),
    ("SELECT * FROM t; DROP TABLE t;", "rule_based"),
    ("SELECT * FROM t; INSERT INTO t VALUES (1, 'x');", "rule_based"),
    ("SELECT 1; SELECT pg_sleep(9);", "rule_based"),
    ("SELECT a.x, b.y FROM a, b WHERE a.id = 1 OR sleep(9) = b.x + 1", "rule_based"),
    ("SELECT * FROM t; EXEC xp_cmdshell('ls');", "rule_based"),
    ("SELECT * FROM t WHERE id = 0x41 UNION SELECT * FROM secrets", "rule_based"),
    ("DROP TABLE t", "rule_based"),
    ("TRUNCATE TABLE t", "rule_based"),
    ("ALTER TABLE t ADD COLUMN x INT", "rule_based"),
    ("DELETE FROM t WHERE 1=1", "rule_based"),
    ("UPDATE t SET a = 'b'", "rule_based"),
    ("INSERT INTO t VALUES (1)", "rule_based"),
    ("CREATE TABLE t (id INT)", "rule_based"),
    ("GRANT ALL ON t TO public", "rule_based"),
]


def scan(spark, statements):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(statements)], "log_id int, sql string")
    return [r.asDict() for r in guard.scan(df).orderBy("log_id").collect()]


def one(spark, text, column):
    df = spark.createDataFrame([(text,)], "sql string")
    return df.select(column(F.col("sql"))).first()[0]


def test_attack_layers(spark):
    got = scan(spark, [s for s, _ in ATTACKS])
    assert [r["layer"] for r in got] == [layer for _, layer in ATTACKS]
    assert all(r["allowed"] is None for r in got if r["layer"] == "ml")
    assert all(r["allowed"] is False for r in got if r["layer"] == "rule_based")


@pytest.mark.parametrize(
    "statement, reason",
    [
        ("-- only a comment", g.EMPTY),
        ("SELECT 1; SELECT 2", g.STACKED),
        ("show tables", g.NOT_SELECT),
        ("SELECT a, (b) FROM t, u WHERE a drop b", g.KEYWORD + "drop"),
        ("SELECT a FROM t, u WHERE a update b copy c", g.KEYWORD + "copy, update"),
        ("SELECT * FROM t, u UNION ALL SELECT b FROM v", g.PATTERN + g.DANGEROUS[2]),
        ("SELECT f(1), 2 FROM t, u WHERE pg_sleep (3) = '1'", g.PATTERN + g.DANGEROUS[7]),
    ],
)
def test_rule_reasons(spark, statement, reason):
    assert scan(spark, [statement])[0]["reason"] == reason


def test_whitelist(spark):
    admitted = [
        "select * from t;",
        "SELECT a, b FROM t WHERE x = 'y' or (z > 1)",
        "select a, count(*) from t limit 5",
        "select f(a) from t order by b",
        "with x as (select 1, f(2)) select * from x, y",
        "explain analyze select f(1)",
        "select имя, цена from блюда",
    ]
    got = scan(spark, admitted)
    assert [(r["layer"], r["allowed"]) for r in got] == [("whitelist", True)] * len(admitted)
    assert not any(r["bypass_suspect"] for r in got)


def test_whitelist_admits_what_rules_refuse(spark):
    got = scan(spark, ["explain select 1; drop table t", "select a from t where id = 1"])
    assert [r["allowed"] for r in got] == [True, True]
    assert [r["bypass_suspect"] for r in got] == [True, False]


def test_comment_with_command_closes_the_whitelist(spark):
    got = scan(spark, ["select * from t -- hello", "select * from t -- or 1 = 1", "select * from t /* a\nDrop b */"])
    assert [r["layer"] for r in got] == ["whitelist", "ml", "ml"]


def test_structure(spark):
    got = scan(spark, [
        "select f('" + "x" * 10001 + "') + 1 from t, u",
        "select f('\x00') + 1 from t, u",
        "select f(1) + 1 from t, u where a = \x1a",
        "select f(" + "'" * 21 + ") from t, u",
        "select f(" + "'" * 20 + ") from t, u",
    ])
    assert [r["reason"] for r in got] == [
        g.TOO_LONG, g.BAD_CHARACTER + "'\\x00'", g.BAD_CHARACTER + "'\\x1a'", g.TOO_MANY_QUOTES, None
    ]


@pytest.mark.parametrize(
    "text, clean",
    [
        ("x -- c\ry", "x"),
        ("a\x1cb", "a b"),
        ("a -- b\nc", "a c"),
        ("a /* b\n c */ d", "a d"),
        ("  a\t\n  b  ", "a b"),
        ("a /* open", "a /* open"),
    ],
)
def test_normalized(spark, text, clean):
    assert one(spark, text, g.normalized) == clean


def test_keyword_inside_quotes_or_with_catalog_names(spark):
    def hits(text):
        return one(spark, text, g.forbidden_hits)

    assert hits("select 'please drop it' from t") == []
    assert hits("select 1 drop it") == ["drop"]
    assert hits("select created_at from t") == []
    assert hits("select 1 drop information_schema") == []
    # The first occurrence decides, wherever it is.
    assert hits("select 'drop ' drop it") == []


def test_features(spark):
    df = spark.createDataFrame([("SELECT 'a' -- x; /* y */ OR 1 = 1 UNION SELECT sleep((1)",)], "sql string")
    got = guard.with_features(df).first().asDict()
    text = got.pop("sql").lower()
    assert got == {
        "length": len(text), "num_quotes": 2, "num_comments": 3, "num_semicolons": 1, "has_union": 1,
        "has_or_true": 1, "num_keywords": 8, "special_char_ratio": 5 / len(text), "num_sleep": 1, "num_subqueries": 1,
    }


def test_features_of_empty_text(spark):
    df = spark.createDataFrame([("",)], "sql string")
    assert set(guard.with_features(df).drop("sql").first()) == {0}


def test_suspicion_and_threshold(spark):
    assert one(spark, "select 1 -- x", guard.threshold) == 0.65
    assert one(spark, "select (((((((((((((((((((((1", guard.threshold) == 0.65
    assert one(spark, "select 1", guard.threshold) == 0.7367346938775511


def test_scored_cascade(spark):
    df = spark.createDataFrame(
        [("select f(1) from t, u", 0.73), ("select f(1) from t, u", 0.74), ("select 1 from t, u /* x */", 0.66123456),
         ("select * from t", 1.0)], "sql string, p double")
    got = rows(guard.scan(df, score="p"), "p", "allowed", "layer", "risk_score")
    assert got == [(0.66123456, False, "ml", 0.6612), (0.73, True, None, None), (0.74, False, "ml", 0.74),
                   (1.0, True, "whitelist", None)]


def test_usernames(spark):
    names = ["waiter1", "", "x" * 101, "a'b", "a--b", "a\\b", "a\x00b", None]
    df = spark.createDataFrame([(n,) for n in names], "username string")
    got = {r["username"]: r["username_reason"] for r in guard.screen_usernames(df).collect()}
    assert got == {"waiter1": "", "": "empty", None: "empty", "x" * 101: "too long", "a'b": "banned character",
                   "a--b": "banned character", "a\\b": "banned character", "a\x00b": "banned character"}


def test_predicates(spark):
    texts = {
        "": "", "  ": "", "a = 1": "", "a = (select b from c)": "subquery", "EXEC (1) = 2": "call of exec",
        "a = 'reunion'": "union", "a = 1; b": "several statements", "a, b drop c": g.KEYWORD + "drop",
        "a in (" + "'x'," * 5 + "'y') and b = 1.5": "too many quotes",
    }
    df = spark.createDataFrame([(t,) for t in texts], "predicate string")
    got = {r["predicate"]: r["predicate_reason"] for r in guard.screen_predicates(df).collect()}
    assert got == texts


def test_identifiers(spark):
    catalog = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "table_name string, column_name string")
    asked = {("t", "a"): "", ("t", "c"): "unknown column", ("v", "a"): "unknown table", ("t;", "a"): "bad table name",
             ("t", "1a"): "bad column name"}
    df = spark.createDataFrame(list(asked), "table_name string, column_name string")
    got = {(r["table_name"], r["column_name"]): r["reason"] for r in guard.screen_identifiers(df, catalog).collect()}
    assert got == asked


def test_summary(spark):
    df = spark.createDataFrame([(s,) for s, _ in ATTACKS] + [("select * from t",)], "sql string")
    got = rows(guard.summary(guard.scan(df)))
    assert got == [("ml", None, 6), ("rule_based", False, 15), ("whitelist", True, 1)]


def test_undecided_is_not_unfolded(spark, data):
    from tavola.sources.chain import Chain

    log = Chain(spark, data).sql_log.select("log_id", "sql")
    plan = guard.undecided(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4
    assert rows(guard.undecided(log), "log_id") == rows(guard.scan(log).where("layer = 'ml'"), "log_id")
