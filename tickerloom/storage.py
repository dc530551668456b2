"""Tables written to the folder that driver and executors share: they cut lineage, and a lost executor costs a re-read only."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the folder set on the context. Where neither is set: on a single machine a temporary folder, on a
    cluster one in the warehouse; checkpoints go there too."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        single = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tickerloom-") if single else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{app}"
    spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(back)] = (weakref.ref(back), path)
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables, once their last reader is done."""
    for df in tables:
        ref, path = _WRITTEN.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
