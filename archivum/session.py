"""Session settings, shared scratch tables and bounded reference lists.

Everything that has to outlive a stage is written to the folder the cluster
names in ``spark.checkpoint.dir``.  That folder is shared by all executors, so
a lost executor costs a re-read, never a re-run from the sources, and plans of
iterative operators stay short.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(app: str = "archivum", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, map keys last-wins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _configured(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or spark.sparkContext.getConf().get(key, None)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared scratch folder; only a local session may fall back to a temporary one."""
    root = _configured(spark, "spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="archivum-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written once and read many times; stale ones can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base = spark, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        _live.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of the written table (same schema, no lineage)."""
        path = f"{self.base}/{name}-{len(self._paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self._paths[path] = name
        return self.spark.read.schema(df.schema).parquet(path)

    def save_parts(self, df: DataFrame, by: str, name: str) -> DataFrame:
        """``save`` into one folder per value of ``by``, so that readers of a value read nothing else."""
        path = f"{self.base}/{name}-{len(self._paths)}"
        df.write.option("compression", "zstd").partitionBy(by).parquet(path)
        self._paths[path] = name
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the tables saved under ``name``; nothing may read them any more."""
        for path in [p for p, n in self._paths.items() if n == name]:
            _delete(self.spark, path)
            self._paths[path] = ""

    def drop_part(self, name: str, part: str) -> None:
        """Delete one folder (``column=value``) of tables saved by ``save_parts``."""
        for path in [p for p, n in self._paths.items() if n == name]:
            _delete(self.spark, f"{path}/{part}")

    def close(self) -> None:
        _delete(self.spark, self.base)


_live: list[Scratch] = []


@atexit.register
def _close_all() -> None:
    for scratch in _live:
        try:
            scratch.close()
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, unless they see it already; once per application."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    inherited = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _shipped or (context.master.startswith("local") and os.path.dirname(package) in inherited):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="archivum-"), "archivum.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns_free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``, in the order asked for."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def collect_bounded(df: DataFrame, limit_rows: int, what: str) -> list:
    """Rows of a reference list whose size must be bounded; a larger one is an error, not a truncation."""
    rows = df.limit(limit_rows + 1).collect()
    if len(rows) > limit_rows:
        raise ValueError(f"{what} has more than {limit_rows} rows, the bound up to which it is sent to every task")
    return rows


def column(name: str):
    """A column by its exact name, dots and all."""
    return F.col(f"`{name}`")
