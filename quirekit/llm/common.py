"""Shared pieces of the training-data operators: shared-folder tables, let-bindings, table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import marked, shared_dir, shipped, swept, written

__all__ = ["ARROW_ROWS", "WORD", "buckets", "built", "column", "crc_mod", "dropped", "free", "let", "marked", "once", "shared_dir", "swept", "table", "tuned", "written"]

#: Words are runs of anything but these six ASCII whitespace characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Records an Arrow batch holds; whole texts travel in batches, so few rows bound the memory.
ARROW_ROWS = 1000

#: Characters of a query's plan that are kept for display.
PLAN_CHARS = 1 << 16


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that no pending result reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base.removeprefix("file:").lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def tuned(spark: SparkSession) -> None:
    """Ships the code to the executors and keeps Arrow batches small, unless the session sets its own: texts may be long."""
    shipped(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.maxPlanStringLength").startswith("2147483632"):  # unless the session sets its own
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))  # the driver keeps each query's; long expressions make megabytes


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(columns: list[str], name: str) -> str:
    """``name``, or one like it that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body`` of ``value`` computed once: a lambda variable is never expanded again by the optimizer."""
    return F.transform(F.array(value), body)[0]


_BUILT: dict[tuple, object] = {}


def built(spark: SparkSession, key: tuple, make):
    """What ``make`` builds of Columns, kept for the application: they name columns, not tables, and large ones take seconds to build."""
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _BUILT:
        _BUILT[whole] = make()
    return _BUILT[whole]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the struct or array ``value`` as a column computed once a row, however often it is used later."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def buckets(df: DataFrame, bytes_each: int = 3 << 20, spread: int = 2) -> int:
    """Hash buckets for a stage over ``df``: in proportion to its stored size, and enough for every shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * spread
    return max(least, 8, min(1 << 22, -(-size // bytes_each)))
