"""Every registered query of the library against its SQL in DuckDB, or at least run through."""

import ast
from datetime import datetime
from pathlib import Path

import pytest

import quern
from quern.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert same_rows(df, ORACLE_SQL[name], sf_dir) > 0
    else:
        assert df.count() > 0


def test_links_go_into_all_documents(spark, sf_dir):
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(QUERIES["wikilink_injection"](spark, sf_dir)) == ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_long_passages_are_asked_whole(spark, tmp_path):
    spark.createDataFrame([(1, "zebra", "en", "web"), (2, "other", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "of " * 10_100 + "zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.query_id, r.doc_id) for r in QUERIES["nway_rrf"](spark, str(tmp_path)).collect()] == [(7, 1)]


def odd_notes(spark, path, numbers=(*range(9), None)):
    """Turns with null and marked texts, of conversations with dates at the bounds, without a date, without an order and without a number."""
    texts = ["", None, "plain", "date: 2010-10-10\nx", "---\ndate: 2011-11-11\n---\n", " lead \t\r\n", "\U0001f600" * 310, "# Other\ncreated: 2011-01\n", "title: other"]
    days = [datetime(2000, 1, 1), datetime(1999, 12, 31), datetime(2024, 7, 1), datetime(2024, 7, 2), datetime(2001, 5, 5, 23, 59), None, datetime(2020, 2, 29)]
    turns = [(k, i, ["user", None, "system"][i % 3], t) for k in numbers for i, t in enumerate(texts)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/made/conversations")
    spark.createDataFrame([*enumerate(days), (-4, days[0]), (-3, days[1]), (-2, days[2]), (-1, days[3])], "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{path}/made/orders")
    for name in ("conversations", "orders"):
        next(Path(f"{path}/made/{name}").glob("*.parquet")).rename(f"{path}/{name}.parquet")
    return str(path)


def test_dates_of_odd_notes(spark, tmp_path):
    made = odd_notes(spark, tmp_path)
    assert same_rows(QUERIES["extracted_dates"](spark, made), ORACLE_SQL["extracted_dates"], made) == 90


def test_formats_of_odd_dates(spark, tmp_path):
    made = odd_notes(spark, tmp_path)
    assert same_rows(QUERIES["date_formats"](spark, made), ORACLE_SQL["date_formats"], made) == 3


def test_formats_of_dates_below_zero(spark, tmp_path):
    made = odd_notes(spark, tmp_path, [-4, -3, -2, -1])
    assert same_rows(QUERIES["date_formats"](spark, made), ORACLE_SQL["date_formats"], made) == 3


def test_no_function_hides_another():
    for file in Path(quern.__file__).parent.rglob("*.py"):
        names = [x.name for x in ast.parse(file.read_text()).body if isinstance(x, ast.FunctionDef)]
        assert len(names) == len(set(names)), file


def test_texts_of_near_copies_are_not_joined(spark, sf_dir):
    plan = QUERIES["canonical_of_near_copies"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :].splitlines()
    assert not any("Project" in x and "text#" in x.replace("length(text#", "") for x in joined)
