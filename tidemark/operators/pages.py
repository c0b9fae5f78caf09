"""Pages, limits and options."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources.sinks import work_dir


#: Rows that one task may order for a page.
NEAR = 10_000


@dataclass(frozen=True)
class Ranking:
    """Rows stored in range partitions of an order, with the number of rows of each: any page is read by its place."""

    rows: DataFrame
    order: list[tuple[str, bool]]
    sizes: list[tuple[int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of a page, as page() has them, from the partitions that hold them; no others are read."""
        pages = max(1, -(-self.total // size))
        number = min(max(1, number), pages)
        first, last = (number - 1) * size + 1, min(number * size, self.total)
        before, wanted = 0, {}
        for part, n in self.sizes:
            if before < last and before + n >= first:
                wanted[part] = before
            before += n
        offset = F.create_map(*[F.lit(x) for item in (wanted or {-1: 0}).items() for x in item])
        own = self.rows.filter(F.col("part").isin(list(wanted)))
        placed = own.withColumn("place", (F.row_number().over(W.partitionBy("part").orderBy(*_sorted(self.order))) + offset[F.col("part")]).cast("int")).drop("part")
        return placed.filter(F.col("place").between(first, last)).withColumns(_shown(number, pages, self.total))


def _sorted(order: list[tuple[str, bool]], back: bool = False) -> list[Column]:
    return [F.desc(c) if falls != back else F.asc(c) for c, falls in order]


def _shown(number: int, pages: int, total: int) -> dict[str, Column]:
    return {"page_number": F.lit(number), "pages": F.lit(pages), "total": F.lit(total)}


def ranked(rows: DataFrame, order: list[tuple[str, bool]], path: str | None = None, parts: int | None = None) -> Ranking:
    """rows stored by order (columns, each with whether it falls; they must tell all rows apart), a folder for each range: as
    many as Spark finds right, or parts."""
    path = path or f"{work_dir(rows.sparkSession)}/ranking-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*([parts] if parts else []), *_sorted(order)).sortWithinPartitions(*_sorted(order)).withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(path)
    kept = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    return Ranking(kept, order, sorted(map(tuple, kept.groupBy("part").count().collect())))  # a row for each partition


def page(rows: DataFrame, order: list[tuple[str, bool]], number: int, size: int, near: int = NEAR) -> DataFrame:
    """The rows of a page, with place (from 1), page_number, pages and total; number is clamped to the pages there are.

    order: columns, each with whether it falls; they must tell all rows apart. rows are computed once, and kept. A page near
    either end is taken from that end, so that near rows at most (or a page's) are ordered in one place. Elsewhere the rows
    are ranked(), and the partitions that hold the page are numbered."""
    path = f"{work_dir(rows.sparkSession)}/page-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    first, last = (number - 1) * size + 1, min(number * size, total)
    if last <= max(near, size):
        placed = rows.orderBy(*_sorted(order)).limit(last).withColumn("place", F.row_number().over(W.orderBy(*_sorted(order))))
    elif total - first < max(near, size):
        kept = rows.orderBy(*_sorted(order, True)).limit(total - first + 1)
        placed = kept.withColumn("place", (F.lit(total + 1) - F.row_number().over(W.orderBy(*_sorted(order, True)))).cast("int"))
    else:
        return ranked(rows, order).page(number, size)
    return placed.filter(F.col("place").between(first, last)).withColumns(_shown(number, pages, total))


def at_most(rows: DataFrame, limit: int) -> DataFrame | None:
    """rows, or nothing if they are more than limit: results are never cut short."""
    return None if rows.limit(limit + 1).count() > limit else rows


def options(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def set_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """side (missing or unexpected) and the rows that only one of both has."""
    missing = expected.exceptAll(observed).withColumn("side", F.lit("missing"))
    return missing.unionByName(observed.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def upsert(stored: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """Offered rows, and the stored ones whose key isn't offered."""
    return stored.join(offered.select(*key), key, "left_anti").unionByName(offered)


def conflicts(stored: DataFrame, offered: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """Keys that both have with other values in fixed columns."""
    o = offered.select(*key, *[F.col(c).alias(f"new_{c}") for c in fixed]).distinct()
    differs = F.lit(False)
    for c in fixed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return stored.join(o, key).filter(differs)
