"""Session helpers: the shared folder, written tables that cut lineage, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.moltide.shared.dir", None)
    if not found:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="moltide-")
        spark.conf.set("spark.moltide.shared.dir", found)
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Whether all tasks run in the driver's own process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def _path(spark: SparkSession, name: str):
    """(file system, path) of a file for the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, name: str) -> bool:
    fs, p = _path(spark, name)
    return fs.exists(p)


def listed(spark: SparkSession, name: str) -> list[str] | None:
    """The sorted paths in a folder of any storage that Spark reaches; None if it is none."""
    fs, p = _path(spark, name)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return None
    return sorted(f"{name.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(p))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table kept as Parquet at a path; made by make() and written if it is not there yet."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path, compression="zstd")
    return spark.read.parquet(path)


def written(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage and survives lost executors; later stages read only the columns they need.
    With keys, rows are clustered by them first. The table is removed by drop_written(), else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    (df.repartition(*keys) if keys else df).write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files behind a table made by written()."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, p = _path(df.sparkSession, f)
        fs.delete(p, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> tuple[DataFrame, bool]:
    """A dimension table ready to be broadcast, if its rows stay below the limit; else df as it is, for a shuffle join.

    At most limit_bytes / row_bytes + 1 rows come to the driver, once: plans that use the table several times hold
    its rows instead of several copies of the plan that makes it.
    """
    most = limit_bytes // row_bytes
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True
