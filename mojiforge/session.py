"""Session settings and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mojiforge")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MOJIFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset
    (local tests) a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the executors")
        root = "file://" + os.path.join(tempfile.gettempdir(), "mojiforge-shared")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean, spark)
    _written.append(path)
    return path


def _clean(spark: SparkSession) -> None:
    """Deletes this driver's intermediate tables when it ends."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for p in _written:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session has ended before; the folder's owner cleans up
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts lineage and makes a result that is used several times survive the
    loss of executors.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application.

    The driver's file server hands it out, so no path needs to exist on the
    executors.
    """
    import io
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    out = Path(tempfile.mkdtemp(prefix="mojiforge-")) / "mojiforge_package.zip"
    out.write_bytes(data.getvalue())
    context.addPyFile(str(out))
    _shipped.add(context.applicationId)
