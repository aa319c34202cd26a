"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "panelkit", **conf: str) -> SparkSession:
    """A session with the settings the package expects.

    On a cluster pass nothing: master, shuffle partitions and memory come from
    the submit configuration. ``conf`` keys use ``__`` for ``.``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), str(v))
    return b.getOrCreate()


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local session without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="panelkit-")
    return _local_roots[sc.applicationId]


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder when the driver ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jpath)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once, as Parquet in the shared folder, and read them back.

    The result survives executor loss and does not change when a stage is run
    again. The files go when the driver ends, or earlier by ``drop_table``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/panelkit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_table(*written: DataFrame) -> None:
    """Delete the files of tables that ``cut_lineage`` wrote, once all that reads them has been written itself."""
    for df in written:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


class Scratch:
    """Tables written on the way to a result, deleted together once it has been written itself."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(cut_lineage(df))
        return self.tables[-1]

    def drop(self, *but: DataFrame) -> None:
        drop_table(*[t for t in self.tables if all(t is not b for b in but)])
        self.tables = list(but)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
