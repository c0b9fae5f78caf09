"""Packages of snapshots on shared storage: written, checked, described by a manifest and held against it."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import digest_sums, set_hash
from tidemark.operators import spans
from tidemark.operators.contracts import Contract, conform, contract_report, schema_differences
from tidemark.sources.revisions import Layout, month_folder, open_table, write_in_turn


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all of Spark is one process, and an error elsewhere."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def write_snapshots(df: DataFrame | Iterable[DataFrame], contract: Contract, path: str, layout: Layout = Layout()) -> None:  # noqa: B008
    """A package's table by month (or in spans, from either form), checked as it is read again; an error leaves it in no record.

    Slices of the table are written one after another; the check is of all of them."""
    slices = [df] if isinstance(df, DataFrame) else list(df)
    spark = slices[0].sparkSession
    if any(f.name not in x.columns for x in slices for f in contract.schema if not (f.name == layout.month and spans.MONTHS in x.columns)):
        raise ValueError(f"{contract.name} lacks columns of its contract")
    if layout.spans:
        slices = [x if spans.MONTHS in x.columns else spans.gathered(conform(x, contract)) for x in slices]
    else:
        slices = [conform(x, contract) for x in slices]
    write_in_turn([(x, 1) for x in slices], path, layout)
    back = snapshots_at(spark, path, layout)
    if layout.key and layout.month:  # rows of one identity are in one bucket, so the report needs no shuffle
        months = [r[0] for r in back.select(layout.month).distinct().collect()]  # a row for each month
        schema = spans.schema(contract) if layout.spans else contract.schema
        back = open_table(spark, contract.name, schema, layout, {m: month_folder(path, layout, m) for m in months})
        back = spans.by_month(back) if layout.spans else back
    back = conform(back, contract)
    if wrong := schema_differences(back, contract):
        raise ValueError("; ".join(wrong))
    if layout.repeated:  # but not with one content
        contract = replace(contract, identity=(*contract.identity, "record_hash"))
    report = contract_report(back, contract).first()
    if report.required_nulls or report.repeated_identities:
        raise ValueError(f"{contract.name}: {report.asDict()}")


def snapshots_at(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """The rows by month of what write_snapshots() wrote."""
    rows = spark.read.parquet(path)
    return spans.by_month(rows) if layout.spans else rows


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """competence, table_name, rows and content_hash of each table and month; the hash doesn't depend on order or partitions.

    It is of the number of rows and the sums of the record hashes' words, which combine before the shuffle in fixed space."""
    out = None
    for name, df in tables.items():
        per = df.groupBy("competence").agg(F.count(F.lit(1)).alias("rows"), digest_sums(F.col("record_hash")).alias("sums"))
        one = per.select("competence", F.lit(name).alias("table_name"), "rows", F.sha2(F.concat_ws(":", "rows", "sums"), 256).alias("content_hash"))
        out = one if out is None else out.unionByName(one)
    return out


def window_problems(offered: DataFrame, observed: DataFrame, window: dict[str, str], packages: DataFrame) -> DataFrame:
    """competence and problem of a window whose packages aren't what its manifest says; none is to be left.

    offered, observed: manifest rows, as written and as the tables read now have them. packages: competence and what each
    package says of itself in the columns that window names (window, scope, cohort and contract hashes); a row each month."""
    rows = offered.join(observed.select("competence", "table_name", F.col("rows").alias("rows_now"), F.col("content_hash").alias("hash_now")), ["competence", "table_name"], "full_outer")
    said = F.concat_ws(":", F.lit("{}"), "table_name")
    of_table = lambda name, test: rows.filter(test).select("competence", F.regexp_replace(said, r"^\{\}", name).alias("problem"))
    there = F.col("rows").isNotNull() & F.col("rows_now").isNotNull()
    out = of_table("missing_table", F.col("rows_now").isNull()).unionByName(of_table("unexpected_table", F.col("rows").isNull()))
    out = out.unionByName(of_table("row_count", there & (F.col("rows") != F.col("rows_now")))).unionByName(of_table("content_hash", there & (F.col("rows") == F.col("rows_now")) & (F.col("content_hash") != F.col("hash_now"))))
    for name, value in window.items():
        out = out.unionByName(packages.filter(~F.col(name).eqNullSafe(F.lit(value))).select("competence", F.lit(f"identity:{name}").alias("problem")))
    # a row for each month of the window
    span = packages.agg(F.min("competence").alias("first"), F.max("competence").alias("last"))
    months = span.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("competence"))
    gaps = months.join(packages, "competence", "left_anti").select("competence", F.lit("missing_month").alias("problem"))
    twice = packages.groupBy("competence").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("competence", F.lit("repeated_month").alias("problem"))
    return out.unionByName(gaps).unionByName(twice)


__all__ = ["manifest", "set_hash", "snapshots_at", "window_problems", "work_dir", "write_snapshots"]
