"""Documents without a line (empty, blank or only breaks) and ids below zero: no rows of their own, no failing lookup."""
import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from cuewright.plans import views as V
from tests.oracle import compare

QUERIES = ("b10_assign_buckets", "b19_reassign", "c01_parse_cast", "c04_gender_from_name", "c05_settle_gender", "c06_pick_lead", "c07_format_cast",
           "c08_choose_cast", "c09_build_brief")
TEXT = ". ".join(f"Wort{k} sagt{k} dann{k} etwas" for k in range(50))
DOCS = [(1, "", "en"), (2, "  ", "fr"), (3, ". . ", "de"), (4, None, "es"), (5, TEXT, "en"), (6, " . " + TEXT, "fr"), (-7, TEXT, "de"), (0, "", "en"), (-1, "One line", "en")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    log = [(k, k % 5, f"2024-01-0{k % 3 + 1} 10:00:00", ("click", "error", "view")[k % 3], float(k)) for k in range(60)]
    spark.createDataFrame(log, "event_id bigint, user_id bigint, ts string, event_type string, value double") \
        .selectExpr("event_id", "user_id", "cast(ts AS timestamp_ntz) AS ts", "event_type", "value").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_documents_without_lines(spark, tables, duck, name):
    assert compare(queries()[name](spark, tables), duck, oracle_sql()[name]) == ""


def test_only_documents_with_lines_have_lines(spark, tables):
    got = V.lines(spark, tables)
    assert {r.vid: r.n for r in got.groupBy("vid").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()} == {5: 50, 6: 50, -7: 50, -1: 1}
    assert got.where("id < 0 OR text IS NULL").count() == 0
