"""Writing scene tables and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = ("dataset_id", "dataset_version")


def write_tables(df: DataFrame, path: str, by: Sequence[str] = VERSION) -> None:
    """Parquet partitioned by dataset version; only the partitions that ``df`` has are replaced, so a rerun is safe."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_documents(df: DataFrame, path: str, by: Sequence[str] = VERSION) -> None:
    """JSON documents with camelCase names, partitioned by dataset version."""
    camel = lambda c: c.split("_")[0] + "".join(w.title() for w in c.split("_")[1:])
    body = F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns]))
    df.select(*by, body.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(path)


def reset_version(df: DataFrame, path: str, dataset_id: str, dataset_version: str) -> None:
    """Replace one dataset version by its rows in ``df``, which may be none; other versions stay."""
    own = df.where((F.col("dataset_id") == dataset_id) & (F.col("dataset_version") == dataset_version)).drop(*VERSION)
    own.write.mode("overwrite").parquet(f"{path}/dataset_id={dataset_id}/dataset_version={dataset_version}")
