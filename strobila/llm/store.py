"""Where the operators read tables and keep intermediate results.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which every executor can reach. Without that
setting only a local master has a folder that all tasks share, a temporary one; a cluster without it is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Makes Spark delete a finished query's shuffle files at once.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="strobila-"))
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/strobila-{label}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, fs = _hadoop(spark, path)
        fs.delete(p, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, with its path: lineage ends there.

    The shuffle files behind it are not read again, so they go as soon as the table is whole.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str) -> DataFrame:
    return written(df, label)[0]


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side table as a literal relation, so that no Python runs on the executors."""

    def lit(x) -> str:
        if isinstance(x, (list, tuple)):
            return "array(" + ",".join(map(lit, x)) + ")" if x else "array()"
        return f"{x}L" if isinstance(x, int) else repr(x)

    names, kinds = zip(*(c.split(" ", 1) for c in schema.split(", ")))
    if not rows:
        return spark.createDataFrame([], schema)
    body = ",".join("(" + ",".join(map(lit, r)) + ")" for r in rows)
    out = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return out.selectExpr(*[f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds)])
