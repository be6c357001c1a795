"""Readers on small files, and the options of the database sources."""

import pytest

from quillfen.sources import databases as db
from quillfen.sources import readers, writers


def test_missing_tokens_decimals_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;price;when;flag;note\n1;1,5;2021-01-02;true;NA\n2;?;2021-01-03;false;x y\n3;2,25;;true;nul\n")
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"), sep=";", na_values=["?", "nul"], decimal=",")
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "price": "double", "when": "timestamp_ntz", "flag": "boolean", "note": "string"}
    assert [r["price"] for r in df.orderBy("id").collect()] == [1.5, None, 2.25]
    assert [r["note"] for r in df.orderBy("id").collect()] == [None, "x y", None]
    kept = readers.read_delimited(spark, str(tmp_path / "a.csv"), sep=";", keep_default_na=False)
    assert [r["note"] for r in kept.orderBy("id").collect()] == ["NA", "x y", "nul"]


def test_skipped_lines_are_per_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"# exported\n# twice\nk,v\n{name},1\n{name}{name},2\n")
    df = readers.read_delimited(spark, str(tmp_path), skip_rows=2)
    assert sorted(tuple(r) for r in df.collect()) == [("a", 1), ("aa", 2), ("b", 1), ("bb", 2)]


def test_bad_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k\nab\xffc\n")
    assert readers.read_delimited(spark, str(tmp_path / "a.csv")).first()["k"] == "ab�c"


def test_text_fallback(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k|v\n1|x\n2|y\n")
    assert readers.read_text_auto(spark, str(tmp_path / "a.txt")).columns == ["k", "v"]
    (tmp_path / "b.txt").write_text("free text, here\nand there\n")
    assert readers.read_text_auto(spark, str(tmp_path / "b.txt")).columns == ["text"]


def test_tables_get_unique_names(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text("a\n1\n")
    tables = readers.load_tables(spark, [str(tmp_path / f / "t.csv") for f in ("x", "y")])
    assert list(tables) == ["t", "t_2"]
    assert spark.table("t_2").count() == 1
    with pytest.raises(ValueError):
        readers.load_tables(spark, ["a.xyz"])


def test_json_array_of_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2


def test_excel_is_gated(spark, tmp_path):
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            readers.read_excel(spark, str(tmp_path))


def test_report_flattens_nested_columns(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, array(1, 2) AS b")
    writers.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first()["b"] == "[1,2]"


def test_jdbc_options():
    o = db.jdbc_options("postgresql", "SELECT * FROM t;", "shop", host="h", user="u", password="p", limit=10)
    assert o["url"] == "jdbc:postgresql://h:5432/shop" and o["query"] == "SELECT * FROM t LIMIT 10"
    assert o["user"] == "u" and o["driver"] == "org.postgresql.Driver"
    o = db.jdbc_options("mysql", "SELECT id FROM t", "d", partition_column="id", lower=0, upper=99, partitions=8)
    assert o["dbtable"] == "(SELECT id FROM t) t" and o["numPartitions"] == "8" and "query" not in o
    assert db.jdbc_options("sqlserver", "select a from t", "d", limit=5)["query"] == "SELECT TOP 5 a from t"
    assert db.jdbc_options("sqlite", "SELECT 1", "/tmp/x.db")["url"] == "jdbc:sqlite:/tmp/x.db"
    assert db.jdbc_options("snowflake", "SELECT 1", "d", host="acc.example")["url"].startswith("jdbc:snowflake://acc.example/")
    with pytest.raises(ValueError):
        db.jdbc_options("oracle", "SELECT 1", "d")


def test_limits_are_not_doubled():
    assert db.limited("SELECT * FROM t limit 3", 10) == "SELECT * FROM t limit 3"
    assert db.limited("SELECT * FROM t", None) == "SELECT * FROM t"


def test_document_and_warehouse_options():
    o = db.mongodb_options("mongodb://h", "d", "c", '{"a": 1}')
    assert o["aggregation.pipeline"] == '[{"$match": {"a": 1}}]'
    assert db.bigquery_options("SELECT 1", "p", "/k.json")["credentialsFile"] == "/k.json"
