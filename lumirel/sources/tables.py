"""Tables that cut lineage: what is read more than once is written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The frame's rows, written as Parquet under spark.checkpoint.dir and read again.

    Where that is unset, a session of one machine gets a temporary folder; on a cluster, where such a folder would be
    one machine's own, it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/lumirel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
