"""Cutting the lineage of tables that rounds build on, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: it is computed once, and a lost executor costs no recomputation.

    Where that folder is unset a local master gets one, and any other an error. The tables stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="meetspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/meetspark/rounds/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
