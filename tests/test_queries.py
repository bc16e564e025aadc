"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from skein import catalog_queries as C

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
SOME = ["flagship", "filter_datetime", "filter_json_eq", "hop2_self", "hop3", "similar_cosine", "matches_or", "matches_phrase", "peers_top", "delete_cascade_items", "rules_read_filter", "change_feed_filter", "converter_quarantine"]


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = C.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    mine = sorted((tuple(_value(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)
    theirs = sorted((tuple(_value(v) for v in r) for r in con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({C.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", ["matches_or", "matches_required", "matches_phrase", "matches_prefix", "matches_filtered", "matches_visible"])
def test_matches_with_close_scores(spark, tmp_path, name):
    # Scores that differ by less than what the SQL rounds to, the smallest ids with the lowest; 80 words begin with the prefix.
    rows = [(i, 1, "user", f"of the thing and for in thinge{i % 80} " + "x " * (900 - i // 3)) for i in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in C.QUERIES[name](spark, str(tmp_path)).collect())
    assert mine == sorted(con.sql(f"SELECT id, score FROM ({C.ORACLE_SQL[name]})").fetchall())


def test_every_sql_has_its_query():
    assert set(C.ORACLE_SQL) <= set(C.QUERIES)


def test_filters_reach_the_scan(spark, capsys):
    C.QUERIES["filter_eq_and"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan
    C.QUERIES["hop_inverse"](spark, FOLDER).explain("formatted")
    assert "c_nationkey" in capsys.readouterr().out
