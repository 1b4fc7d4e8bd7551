"""Results written once to the shared folder, so that iterative operators don't grow their plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet under ``spark.checkpoint.dir`` (a folder of our own where it is unset) and read back."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
        root = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
