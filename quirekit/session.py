"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go at its end.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts an Arrow batch holds.
TEXT_ROWS = 500
_ROOT = Path(__file__).resolve().parent
#: Folders of the tables that this thread's run has written so far, in order.
_PATHS: ContextVar[tuple[str, ...]] = ContextVar("quirekit-written", default=())


def shipped(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a Spark context: they need no installation and no shared path."""
    context = spark.sparkContext
    if getattr(context, "_quirekit_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quirekit-code-")
    path = f"{folder}/quirekit_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_ROOT.rglob("*.py")):
            out.write(file, f"{_ROOT.name}/{file.relative_to(_ROOT)}")
    context.addPyFile(path)
    context._quirekit_shipped = True


def batched(spark: SparkSession) -> None:
    """Ships the code and keeps Arrow batches of whole texts small, unless the session sets its own: a batch's bytes are held by each Python worker."""
    shipped(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master gets a temporary one where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quirekit-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, folder: str | None = None, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, or in ``folder``: cuts lineage, survives the loss of executors.

    ``files`` bounds the files of a table that is small beside what it was made from. Shuffle files of the write go with it, not when the driver
    next happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    had = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        (df.coalesce(files) if files else df).write.parquet(path)
    finally:
        spark.conf.unset(_FREED) if had is None else spark.conf.set(_FREED, had)
    _PATHS.set((*_PATHS.get(), path))
    return spark.read.schema(df.schema).parquet(path)


def marked() -> int:
    """A mark: what this thread writes from here on can be swept; other threads' runs have marks of their own."""
    return len(_PATHS.get())


def swept(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes the tables this thread has written since a mark, but for those that ``keep`` reads."""
    needed = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in keep for f in df.inputFiles()}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    left = []
    for path in _PATHS.get()[mark:]:
        if path.rsplit("/", 1)[1] in needed:
            left.append(path)
        else:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
    _PATHS.set((*_PATHS.get()[:mark], *left))
