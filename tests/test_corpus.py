from tavola.sources import corpus, tables
from tests.conftest import rows


def test_statements(spark):
    text = (
        "1. First question?\nSELECT a\nFROM t\n WHERE x = 'p;q';\n\n"
        "2) Two statements\nselect 1; select 'it\\'s; one' ;\n"
        "3. Inner lines restart\nWITH x AS (\nSELECT 1\n)\nSELECT 2\nFROM x\n"
        "4. Nothing here\njust words\n"
        "5. Open quote\nselect 'a; b"
    )
    df = spark.createDataFrame([("f", text)], "file string, value string")
    got = rows(corpus.statements_of(df), "section", "description", "part", "sql")
    assert got == [
        (1, "First question?", 1, "SELECT a FROM t WHERE x = 'p;q';"),
        (2, "Two statements", 1, "select 1;"),
        (2, "Two statements", 2, "select 'it\\'s; one' ;"),
        (3, "Inner lines restart", 1, "SELECT 2 FROM x"),
        (5, "Open quote", 1, "select 'a; b"),
    ]


def test_read_statements(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1. One\nSELECT 1\n2. Two\nSELECT 2\n")
    assert rows(corpus.read_statements(spark, str(tmp_path)), "description", "sql") == [("One", "SELECT 1"), ("Two", "SELECT 2")]


def test_split_long_statement(spark):
    long = "select '" + "x" * 200_000 + "';" + "select a" * 50_000
    df = spark.createDataFrame([(long,)], "sql string")
    assert [r["part"] for r in corpus.split_statements(df).collect()] == [1, 2]


def test_read_corpus(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Sentence,Label\n"a, ""b""",1\n"a, ""b""",1\nplain,0\n,1\nx,\n')
    got = corpus.read_corpus(spark, str(tmp_path / "c.csv"))
    assert rows(got) == [('a, "b"', 1), ("plain", 0)]


def test_report_file(spark, tmp_path):
    report = spark.createDataFrame([("r", "d", 3)], "restaurant string, dish string, total int")
    corpus.write_report(report, str(tmp_path / "out"))
    written = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert written.columns == ["Ресторан", "Блюдо", "Продано"]
    assert rows(written) == [("r", "d", "3")]


def test_export_leaves_out_sensitive_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, name string")
    done = corpus.export_tables({"dishes": df, "app_users": df, "purchase_requests": df}, str(tmp_path), "parquet")
    assert done == ["dishes"]
    assert rows(spark.read.parquet(str(tmp_path / "dishes"))) == [("1", ""), ("2", "x")]
    assert not (tmp_path / "app_users").exists()


def test_tables_and_catalog(spark, data, tmp_path):
    loaded = tables.load_tables(spark, data, ["region", "nation"], views=True)
    assert spark.table("nation").count() == 25
    got = rows(tables.catalog_of(spark, loaded), "table_name", "column_name", "position")
    assert got[0] == ("nation", "n_name", 2) and len(got) == 5
    assert rows(tables.row_counts(loaded)) == [(5, 25)]
    (tmp_path / "cities.csv").write_text("id,name\n1,Here\n")
    assert rows(tables.load_table(spark, str(tmp_path), "cities", "csv")) == [(1, "Here")]


def test_schemas_parse(spark):
    assert len(tables.SCHEMAS) == 21
    assert all(tables.schema_of(t).fields for t in tables.SCHEMAS)


def test_statements_without_a_number(spark):
    df = spark.createDataFrame([("SELECT 0;\n1. First\nSELECT 1;\n2) Second\nSELECT 2",), ("SELECT 9",), ("",)], "value string")
    got = rows(corpus.statements_of(df), "section", "description", "sql")
    assert got == [(0, "", "SELECT 0;"), (0, "", "SELECT 9"), (1, "First", "SELECT 1;"), (2, "Second", "SELECT 2")]
