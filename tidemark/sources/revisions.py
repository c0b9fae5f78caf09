"""Tables by month that are published in revisions.

A registry is a folder. A table's months are written below it, each revision to a folder of its own, and count from the
moment that the commit record names them: one file of a row for each table and month, written last, by one rename. What
a stopped build leaves behind is in no record, so readers go on with the revision before. A later revision names only the
months that it replaces; of each month the highest revision is active, and the others' files stay where they are.

A month's row says what it was made from, by hash: a month is stale when that is no longer what its sources are. So a
refresh is told by the record alone which months to make again, also if the last one stopped between two tables.

Tables that are bucketed by a key keep each month in as many buckets, sorted by the key: months meet each other without a
shuffle, and a lookup by key reads one bucket. Tables in spans hold a row that several months of a revision have once,
with these months. Tables in the order of a place are skipped by file and row group. Readers
get them as tables of the session's catalog, whose partitions lie wherever their active revision does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import digest_sums
from tidemark.operators import spans
from tidemark.operators.diff import active_revisions

#: A row of the commit record; folder is empty where a month has no rows, competence null for a table that isn't by month.
RECORD = "table_name string, competence date, revision_number int, status string, folder string, rows long, content_hash string, made_from string"
PUBLISHED = "PUBLISHED"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The partition column of tables in spans: a number for each folder.
PART = "part"


@dataclass(frozen=True)
class Layout:
    """How a table is stored: its month column (none for a table in one piece), and the key and number of its buckets; or, in
    order of a number that a row has, in as many files a month, each a range of it. In spans months aren't folders. Placed rows
    come in the parts of their buckets already, and are not shuffled. Repeated: a month may have several rows of one identity."""

    month: str | None = "competence"
    key: str | None = None
    buckets: int = 0
    order: Column | None = None
    spans: bool = False
    placed: bool = False
    repeated: bool = False


def create(spark: SparkSession, root: str) -> None:
    """A registry without tables, where there is none."""
    spark.createDataFrame([], RECORD).coalesce(1).write.mode("ignore").json(f"{root}/commits")


def record(spark: SparkSession, root: str) -> DataFrame:
    """All commits."""
    return spark.read.schema(RECORD).json(f"{root}/commits")


def active(spark: SparkSession, root: str) -> dict[tuple[str, object], Row]:
    """The active row of each table and month: a table of months, however many commits there were."""
    rows = active_revisions(record(spark, root), ["table_name", "competence"]).filter("active").collect()
    # two writers can't tell of each other; of one number the folder that sorts last counts, for all readers alike
    return {(r.table_name, r.competence): r for r in sorted(rows, key=lambda r: r.folder)}


def commit(spark: SparkSession, root: str, rows: Iterable[tuple]) -> None:
    """Publish rows of RECORD without their status, all at once."""
    made = [(*r[:3], PUBLISHED, *r[3:]) for r in rows]
    spark.createDataFrame(made, RECORD).coalesce(1).write.mode("append").json(f"{root}/commits")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Of the files at paths: how many, and a hash of their names, sizes and times. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    return files.agg(F.concat_ws(":", F.count(F.lit(1)), digest_sums(F.sha2(F.concat_ws("|", "path", "length", F.col("modificationTime").cast("double")), 256)))).first()[0]


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What writes within have shuffled is gone from the disks when each ends, not when the driver next collects garbage."""
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if had is None else spark.conf.set(CLEANUP, had)


def write(df: DataFrame, folder: str, layout: Layout, months: int = 1) -> None:
    """df (of so many months) as Parquet below folder, by month and bucket; no table of the catalog is left."""
    write_in_turn([(df, months)], folder, layout)


def write_in_turn(slices: Iterable[tuple[DataFrame, int]], folder: str, layout: Layout) -> None:
    """Slices of a table, each with its number of months, one after another, so that only one has its shuffles on disk."""
    name, spark = f"tidemark_{uuid.uuid4().hex}", None
    for df, months in slices:
        spark = df.sparkSession
        if layout.order is not None:
            place = "tidemark_place"
            out = df.withColumn(place, layout.order).repartitionByRange(months * layout.buckets, layout.month, place).sortWithinPartitions(layout.month, place).drop(place)
        else:
            out = df if layout.placed else df.repartition(layout.buckets, layout.key) if layout.key else df.hint("rebalance", layout.month) if layout.month else df
        writer = out.write.mode("append").format("parquet").option("compression", "zstd")
        if layout.month and not layout.spans:
            writer = writer.partitionBy(layout.month)
        if layout.key:
            writer.bucketBy(layout.buckets, layout.key).sortBy(layout.key).option("path", folder).saveAsTable(name)
        else:
            writer.save(folder)
    if layout.key and spark:
        spark.sql(f"DROP TABLE {name}")  # its files stay, as it has a path of its own


def month_folder(folder: str, layout: Layout, month) -> str:
    return f"{folder}/{layout.month}={month}" if layout.month and not layout.spans else folder


def open_table(spark: SparkSession, name: str, schema: T.StructType, layout: Layout, folders: Mapping[object, str]) -> DataFrame:
    """The table whose months lie in folders, with the columns of schema in order."""
    if not folders:
        return spark.createDataFrame([], schema)
    if not layout.month:
        return spark.read.schema(schema).parquet(*folders.values())
    # months that share a folder are one partition
    part, named = (PART, T.StructType([*schema, T.StructField(PART, T.StringType())])) if layout.spans else (layout.month, schema)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named)
    buckets = f"CLUSTERED BY (`{layout.key}`) SORTED BY (`{layout.key}`) INTO {layout.buckets} BUCKETS" if layout.key else ""
    own = f"tidemark_{name}_{uuid.uuid4().hex}"
    nowhere = next(iter(folders.values())).rsplit("/", 3)[0] + "/none"
    spark.sql(f"CREATE TABLE {own} ({columns}) USING parquet PARTITIONED BY (`{part}`) {buckets} LOCATION '{nowhere}'")
    if not layout.spans:
        parts = " ".join(f"PARTITION (`{part}` = DATE'{m}') LOCATION '{f}'" for m, f in sorted(folders.items()))
        spark.sql(f"ALTER TABLE {own} ADD {parts}")
        return spark.table(own).select(*schema.names)
    months = {f: [m for m in sorted(folders) if folders[m] == f] for f in sorted(set(folders.values()))}
    spark.sql(f"ALTER TABLE {own} ADD " + " ".join(f"PARTITION (`{part}` = '{i}') LOCATION '{f}'" for i, f in enumerate(months)))
    # of a folder only the months count that it is the active one of
    active = F.coalesce(*[F.when(F.col(part) == str(i), spans.of_months(own_months)) for i, own_months in enumerate(months.values())])
    return spans.kept(spark.table(own), active).select(*schema.names)
