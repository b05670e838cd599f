"""Session defaults. Every setting can be overridden by the cluster's own."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "paperloom", cores: str | int = "*", shuffle: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one you are given."""
    cpus = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    return builder.getOrCreate()


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it. Only a session whose tasks run in this
    very process may do without: it gets a fresh local folder. Elsewhere a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="paperloom-"))
        folder = _OWN_FOLDER[0]
    return folder.rstrip("/")


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


#: Stored bytes of a text table in one task, about.
TEXT_TASK_BYTES = 8 << 20


def text_partitions(spark: SparkSession, files: list[str]) -> int:
    """Tasks that text tables are dealt to right after the scan: as the session asks for
    (`spark.paperloom.textPartitions`), else by the size of the files, and one per core at least. So what a
    task holds does not grow with the table, however large its row groups are."""
    asked = spark.conf.get("spark.paperloom.textPartitions", None)
    if asked:
        return int(asked)
    jvm, conf, size = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-size // TEXT_TASK_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of an executor, unlike a local one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession) + "/rdd")
    return df.checkpoint()


def dealt_by(df: DataFrame, key: str) -> bool:
    """Whether rows with equal keys already lie together (a bucketed table, read as such)."""
    return df._jdf.queryExecution().sparkPlan().outputPartitioning().toString().startswith(f"hashpartitioning({key}#")


def partitions(df: DataFrame) -> int:
    """How many parts a table is dealt to, before any of its work is done."""
    return df._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, where all executors reach it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written to a fresh work folder and read from there: made once, however many branches read it."""
    at = work_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, *folders: str) -> None:
    """Remove written intermediate tables that nothing reads any more, and with them the shuffle files of the jobs that made
    them: Spark clears these once the driver has collected what refers to them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    jvm.System.gc()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def finished_parts(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of the subfolders `name=n` whose writing was completed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(conf)
    if not system.exists(path):
        return []
    inside = [s.getPath() for s in system.listStatus(path)]
    return [int(p.getName().partition("=")[2]) for p in inside
            if p.getName().startswith(f"{name}=") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    home = shared_folder(spark)
    plain = home.removeprefix("file://").removeprefix("file:")
    # An object store cannot be written with plain files: build beside the driver, Spark serves it.
    target = Path(tempfile.mkdtemp(prefix="paperloom-pkg-")) if "://" in plain else Path(plain)
    target.mkdir(parents=True, exist_ok=True)
    archive = target / f"paperloom-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
