"""Rows of snapshots held once for each content, with the months that have it: most rows are the same from month to month."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.operators.contracts import Contract
from tidemark.operators.diff import paired

#: The column that holds a row's months, in place of the month.
MONTHS, MONTH = "months", "competence"


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """df's columns in the contract's order and types, and its months in place of the month."""
    return df.select(*[F.col(n).cast(kind.rstrip("*")).alias(n) for n, kind in contract.columns if n != MONTH], MONTHS)


def schema(contract: Contract) -> T.StructType:
    return T.StructType([*(f for f in contract.schema if f.name != MONTH), T.StructField(MONTHS, T.ArrayType(T.DateType()))])


def gathered(rows: DataFrame) -> DataFrame:
    """Rows of single months as rows of one content each; a month that has a row twice is there twice."""
    return rows.groupBy(*[c for c in rows.columns if c != MONTH]).agg(F.collect_list(MONTH).alias(MONTHS))


def by_month(spans: DataFrame) -> DataFrame:
    """A row for each month."""
    return spans.withColumn(MONTH, F.explode(MONTHS)).drop(MONTHS)


def of_months(months: Iterable[date]) -> Column:
    """A row's months that are among months."""
    some = list(months)
    return F.filter(MONTHS, lambda m: m.isin(some))


def kept(spans: DataFrame, months: Column) -> DataFrame:
    """spans with months as their months, where there are any."""
    return spans.withColumn(MONTHS, months).filter(F.size(MONTHS) > 0)


def changed(spans: DataFrame, pairs: DataFrame, identity: list[str], repeated: bool = False) -> DataFrame:
    """What diff.changed() gives of the months' rows. Only rows that begin or end within a pair are compared, and without a shuffle where rows of an identity are stored in one bucket.

    repeated: a month may have several rows of an identity; of such an identity all rows are compared."""
    # pairs has a row for each month of a window
    all_ = F.broadcast(pairs.agg(F.collect_list(F.struct("from_month", "to_month")).alias("pairs")))
    has = lambda month: F.array_contains(MONTHS, month)
    row = F.struct(*[c for c in spans.columns if c not in (*identity, MONTHS)])
    rows = spans.select(*identity, row.alias("row"), MONTHS, F.lit(False).alias("twin"))
    if repeated:
        held = F.flatten(F.collect_list(MONTHS).over(W.partitionBy(*identity)))
        rows = rows.withColumn("twin", F.size(held) > F.size(F.array_distinct(held)))
    moved = lambda here, there: F.filter("pairs", lambda p: has(p[here]) & (F.col("twin") | ~has(p[there])))
    side = lambda here, there, old: F.transform(moved(here, there), lambda p: F.struct(p["from_month"].alias("from_month"), p["to_month"].alias("to_month"), F.lit(old).alias("old")))
    sides = rows.crossJoin(all_).select(*identity, "row", F.inline(F.concat(side("from_month", "to_month", True), side("to_month", "from_month", False))))
    return paired(sides, identity)
