"""Every registered engine query against its DuckDB twin, on the smallest tables."""

import difflib
import os

import duckdb
import pytest

import __spark_entry__ as entry
import bench
from attestra.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    say = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(say(r[i]) for i in order) for r in data), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    data = got.collect()
    if name in catalogue.ORACLE:
        cur = duck.execute(catalogue.ORACLE[name])
        assert rows(got.columns, data) == rows([d[0] for d in cur.description], cur.fetchall())
    else:
        assert data


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bench_takes_numbered_queries_alone():
    assert bench.numbered(["option_split", "op10_b", "op2_a", "pipeline", "open"]) == ["op2_a", "op10_b"]
    assert set(bench.HEADLINE) <= set(catalogue.QUERIES)


def test_copies_and_families_are_found_over_all_parts(spark):
    data = catalogue.near_duplicate_families(spark, SF).collect()
    assert {r["decision"] for r in data} == {"exact_duplicate", "suspected_same_family"} and any(r["part_b"] - r["part_a"] > 100 for r in data)


def test_first_similar_part_in_scan_order(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").collect()
    text = lambda r: f"{r['p_name']} {r['p_type']} {r['p_size']}"
    want = {}
    for i, r in enumerate(parts):
        for e in parts[:i]:
            if e["p_brand"] == r["p_brand"] and (ratio := difflib.SequenceMatcher(None, text(r), text(e)).ratio()) >= 0.9:
                want[r["p_partkey"]] = (e["p_partkey"], round(ratio, 6))
                break
    assert {r["p_partkey"]: (r["similar_to"], r["ratio"]) for r in catalogue.difflib_similar(spark, SF).collect()} == want and want
