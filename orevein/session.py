"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "orevein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine, where that is unset (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own_dirs:
            _own_dirs[application] = "file://" + tempfile.mkdtemp(prefix="orevein-")
        folder = _own_dirs[application]
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str = "t", tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    ``tidy`` has Spark drop the shuffle files of that at once, for tables as large as the input.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orevein/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if tidy:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._orevein_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that nothing reads any more, and shuffle files left by finished jobs.

    Spark drops shuffle files once the driver's collector has found their plans gone, which may take long by itself.
    """
    for df in frames:
        path = getattr(df, "_orevein_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    if spark.conf.get(BATCH_BYTES, None) is None:  # texts are long: bound what a Python worker holds at once
        spark.conf.set(BATCH_BYTES, "8m")
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="orevein-code-")) / "orevein.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, Path(top.name) / file.relative_to(top))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The named Parquet tables under ``sf_dir``; one name gives a DataFrame, several a tuple."""
    ship(spark)
    frames = tuple(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name in names)
    return frames if len(frames) > 1 else frames[0]
