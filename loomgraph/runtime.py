"""Session plumbing: tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it names none, a temporary folder of a local session, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; cuts the lineage of loops."""
    path = f"{_own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def read_all(frames: list[DataFrame]) -> DataFrame:
    """The union of tables of ``materialize`` of one schema, as one scan: its plan does not grow with their number."""
    first = frames[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[f._loomgraph_path for f in frames])


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many partitions as the session shuffles to: adaptive execution, which goes by compressed bytes, joins none of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` whose readers have all run."""
    path = getattr(df, "_loomgraph_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written with ``materialize``, once its results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
