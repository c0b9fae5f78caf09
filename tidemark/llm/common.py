"""What the corpus operators share: table access, results kept in the shared folder, text as Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import work_dir as shared_dir

#: The bytes that separate words, and what bytes.split() and bytes.strip() take as white space.
WHITE = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and lost executors cost nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*settled: DataFrame) -> None:
    """Empty settled tables that nothing still to be computed reads."""
    for df in settled:
        for file in df.inputFiles()[:1]:
            df.sparkSession.range(0).write.mode("overwrite").parquet(file.rsplit("/", 1)[0])


def fresh(taken: Iterable[str], name: str) -> str:
    """name, with as many underscores as it takes to clash with no taken column."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply f to each Arrow batch of df; f returns a batch or several."""

    def run(batches):
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def row_key(*columns: str) -> Column:
    """The same number for repeated rows and only for those: ids may be null or repeat."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def with_key(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("row_key", row_key(*columns))


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about most bytes together, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column in UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
