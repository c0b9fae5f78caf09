"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["establishment_snapshots", "event_counts", "company_events", "partner_events", "missing_and_late", "regional_metrics", "cnae_growth", "capital_growth", "address_resolution", "map_summary", "map_summary_filtered", "municipality_density", "dynamics_cnae", "validate_cnpj", "cohort_discovery", "package_manifest", "invalid_cohort_ids",
        "build_companies", "build_establishments", "build_partners", "partner_warnings", "company_offences", "establishment_offences", "window_problems", "normalize_code_page", "event_text", "event_keys", "middle_page", "capital_growth_headquarters", "location_details", "map_quality_gate", "changed_packages", "revision_artifacts", "dashboard", "dashboard_filtered", "dashboard_headquarters", "stored_manifest", "business_rows", "company_search", "text_filter", "watchlist"]


def cell(x):
    return "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    theirs = sorted(tuple(map(cell, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert sorted(tuple(map(cell, r)) for r in df.select(*columns).collect()) == theirs


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
