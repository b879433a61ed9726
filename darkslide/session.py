"""Session helpers: a tuned local session for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "darkslide", cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with UTC pinned; on a cluster the caller brings its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session.

    Only where that is unset (tests, a single machine) a temporary folder of this machine is made.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach; a folder of the driver's machine will not do on a cluster")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="darkslide-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df once as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _remember(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_forget, spark)
    _written.append(path)


def _forget(spark: SparkSession) -> None:
    try:
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        for p in _written:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session may be gone already; the shared folder is then cleaned by its owner
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package where they cannot import it by themselves; done once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="darkslide-ship-"))
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    with zipfile.ZipFile(at / "darkslide.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(at / "darkslide.zip"))
