"""Ingestion to clustered Parquet, and a report of what the files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.tables import open_table


def as_text(df: DataFrame) -> DataFrame:
    """Binary columns read as UTF-8 text; other types stay as they are."""
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)})


def convert(spark: SparkSession, source: str, target: str, *, cluster_by: list[str] | None = None, rows_per_file: int = 0, block_bytes: int = 128 << 20, mode: str = "error") -> None:
    """Write ``source`` (Parquet, ORC, CSV or JSON) as zstd Parquet.

    ``cluster_by`` sorts the files by ranges of these columns, so that filters on them skip row groups;
    the ranges are sampled by Spark, and a value that fills several ranges is split over several files by
    the remaining columns named. ``rows_per_file`` splits larger files.
    """
    df = as_text(open_table(spark, source).df)
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode(mode).option("compression", "zstd").option("parquet.block.size", block_bytes)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(target)


def schema_report(df: DataFrame, at_most: int = 32) -> list[str]:
    """``name: type`` per column, the rest as a count."""
    fields = df.schema.fields
    lines = [f"{f.name}: {f.dataType.simpleString()}" + ("" if f.nullable else " not null") for f in fields[:at_most]]
    return lines + ([f"… +{len(fields) - at_most} more"] if len(fields) > at_most else [])


def storage_report(df: DataFrame) -> DataFrame:
    """``(file, row_group, column, rows, raw_bytes, stored_bytes, low, high)`` from the Parquet footers.

    Overlapping bounds across row groups show why a filter prunes nothing. Files are read by the executors.
    """
    import pyarrow as pa

    def split(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                meta = pq.ParquetFile(path.removeprefix("file://").removeprefix("file:")).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(meta.num_columns):
                        chunk = group.column(c)
                        stats = chunk.statistics
                        known = stats is not None and stats.has_min_max
                        out.append((path, g, chunk.path_in_schema, group.num_rows, chunk.total_uncompressed_size, chunk.total_compressed_size, str(stats.min) if known else None, str(stats.max) if known else None))
            names = ["file", "row_group", "column", "rows", "raw_bytes", "stored_bytes", "low", "high"]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    spark = df.sparkSession
    files = spark.createDataFrame([(f,) for f in sorted(df.inputFiles())], "file string")
    return files.repartition(max(1, min(200, len(df.inputFiles())))).mapInArrow(
        split, "file string, row_group int, column string, rows long, raw_bytes long, stored_bytes long, low string, high string"
    )


def column_storage(report: DataFrame) -> DataFrame:
    """Bytes per column, raw and stored, and their ratio."""
    sums = report.groupBy("column").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("stored_bytes").alias("stored_bytes"))
    return sums.withColumn("ratio", F.round(F.col("stored_bytes") / F.greatest(F.col("raw_bytes"), F.lit(1)), 4)).orderBy("column")
