"""Session settings and the cutting of lineage.

Nothing here keeps data in one executor only: lineage is cut by tables written to the shared folder that the cluster
names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []
_at_exit: list = []


def session(app: str = "weftgraph", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the session is made by spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, one of our own, in local mode only: on a
    cluster every executor would write to its own disk, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="weftgraph-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def release(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` and the streams wrote so far. Call it when a query's result has been read or stored;
    what is left goes at the end of the process."""
    while _written:
        path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  no gateway any more: only a folder of this machine can be reached
            shutil.rmtree(path.removeprefix("file://"), True)


def own_table(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder that ``release`` or the end of the process deletes."""
    path = f"{shared_folder(spark)}/weftgraph-{kind}/{uuid.uuid4().hex}"
    if not _at_exit:
        _at_exit.append(atexit.register(release, spark))
    _written.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read from there.

    Later reads survive lost executors, the plan starts anew (iterations would otherwise carry every earlier round's
    constraints along), and sizes are exact for the planner. The schema is not inferred. See ``release`` for the end of the table.
    """
    spark = df.sparkSession
    path = own_table(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
