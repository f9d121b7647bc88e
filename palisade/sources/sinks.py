"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def append_rows(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Append to a parquet table folder."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 1000, properties: dict | None = None) -> None:
    """Append through JDBC in batches, one connection per partition."""
    df.write.option("batchsize", batch_rows).jdbc(url, table, mode="append", properties=properties or {})
