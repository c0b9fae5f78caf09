"""Orders of one company whose keys end in the same six digits share an establishment's id, as keys over a million do; every query has them as its SQL does."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import cell
from tidemark.operators import diff, spans
from tidemark.plans import adapter, store
from tidemark.sources import revisions, sinks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
MONTHS = [date(2020, m, 1) for m in (1, 2, 3, 4)]
#: The findings' queries, in their order, and one on each kind of what they read.
NAMES = ["bbox_filter", "company_state", "dynamics_cnae", "event_entity_gate", "event_list", "full_recompute", "location_clusters", "map_summary_filtered", "map_summary_openings", "municipality_resolution", "opening_closing", "stock_ranking",
         "address_normalise", "address_resolution", "build_establishments", "affected_intervals", "business_rows", "cohort_hash", "capital_growth", "capital_growth_headquarters", "cohort_semi_join", "clamped_page", "company_search",
         "establishment_events", "missing_and_late", "location_details"]


@pytest.fixture(scope="module")
def con(tmp_path_factory):
    """The smallest tables with a second order for a third of the orders, of the same customer and with the lines of another order."""
    import duckdb

    con, d = duckdb.connect(), str(tmp_path_factory.mktemp("twins"))
    given = {f.removesuffix(".parquet"): f"SELECT * FROM '{SF}/{f}'" for f in os.listdir(SF)}
    twins = f"SELECT a.o_orderkey + 1000000 * (1 + a.o_orderkey % 2) AS k, a.o_custkey AS c, b.* FROM ({given['orders']}) a JOIN ({given['orders']}) b ON b.o_orderkey = (a.o_orderkey * 7 + 11) % (SELECT count(*) FROM ({given['orders']})) WHERE a.o_orderkey % 3 = 0"
    lines = f"SELECT l.* REPLACE (k AS l_orderkey, (l_partkey * 3 + 1) % 200 AS l_partkey) FROM ({given['lineitem']}) l JOIN ({twins}) ON l_orderkey = o_orderkey"
    given["orders"] += f" UNION ALL SELECT * EXCLUDE (k, c) REPLACE (k AS o_orderkey, c AS o_custkey) FROM ({twins})"
    given["lineitem"] += f" UNION ALL {lines}"
    for name, body in given.items():
        con.sql(f"COPY ({body}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return con, d


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    con, d = con
    df = entry.queries()[name](spark, d)
    columns = sorted(df.columns)
    theirs = sorted(tuple(map(cell, r)) for r in con.sql(entry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert sorted(tuple(map(cell, r)) for r in df.select(*columns).collect()) == theirs


def test_adaptive_level(spark, con):
    """Its SQL says what large tables give; of small ones each place is a group."""
    con, d = con
    wanted = con.sql(entry.oracle_sql()["location_clusters"]).fetchall()
    got = entry.queries()["adaptive_level"](spark, d).first()
    assert got.level_shown == "exact" and got.groups == len(wanted) and got.total > 0


def test_each_row_meets_each(spark):
    """Of an identity with several rows also those that stay; of others only what changed."""
    have = {"a": {"x": (0, 1, 2, 3), "y": (1, 2), "z": (2, 3)}, "b": {"x": (0, 1), "y": (2, 3)}, "c": {"x": (0, 1, 2, 3)}, "d": {"x": (0, 3), "y": (0,)}}
    rows = spark.createDataFrame([(k, h, f"of {h}", MONTHS[m]) for k, held in have.items() for h, own in held.items() for m in own], "k string, record_hash string, said string, competence date")
    at = lambda k, m: [h for h, own in have[k].items() if m in own] or [None]
    want = [(k, str(MONTHS[m + 1]), str(MONTHS[m]), p, c) for k in have for m in range(3) for p in at(k, m) for c in at(k, m + 1) if p != c]
    pairs = diff.month_pairs(rows)
    held = spans.gathered(rows)
    for found in (diff.changed(rows, pairs, ["k"]), diff.changed(rows, pairs, ["k"], together=True), spans.changed(held, pairs, ["k"], repeated=True)):
        got = [(r.k, str(r.to_month), str(r.from_month), r.p and r.p.record_hash, r.c and r.c.record_hash) for r in found.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(r.p is None or r.p.said == f"of {r.p.record_hash}" for r in found.collect())


def test_a_row_that_is_there_twice_is_refused(spark, tmp_path):
    """Several rows of an id are no offence, one content twice is."""
    rows = adapter.establishments(spark, SF)
    layout = revisions.Layout("competence", "cnpj", 2, spans=True, repeated=True)
    other = rows.filter("cnpj < '00000012'").withColumn("trade_name", F.lit("OUTRA")).drop("record_hash")
    both = rows.unionByName(other.withColumn("record_hash", adapter.keys.record_hash(other)))
    sinks.write_snapshots(both, store.ESTABLISHMENTS, str(tmp_path / "two"), layout)
    assert sinks.snapshots_at(spark, str(tmp_path / "two"), layout).count() == both.count() > rows.count()
    with pytest.raises(ValueError, match="repeated_identities"):
        sinks.write_snapshots(rows.unionByName(rows.filter("cnpj < '00000012'")), store.ESTABLISHMENTS, str(tmp_path / "twice"), layout)
    with pytest.raises(ValueError, match="repeated_identities"):
        sinks.write_snapshots(both, store.ESTABLISHMENTS, str(tmp_path / "strict"), revisions.Layout("competence", "cnpj", 2, spans=True))
