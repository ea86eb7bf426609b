"""What the operators share: reading tables, tables written between jobs, worker caches."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIRS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one of our own where it is unset and all runs on one machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _OWN_DIRS:
        own = tempfile.mkdtemp(prefix="siltstone-")
        _OWN_DIRS.append(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + _OWN_DIRS[0]


class Written:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/siltstone-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them when no name is given."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session may be gone at exit
            return


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches that long texts cannot blow up: by rows and by bytes.  These bounds of the session are only ever lowered;
    no result depends on them."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        now = int(now) if now.isdigit() else 0  # 0 and less: no bound, else maybe with a unit
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def without_clash(df: DataFrame, reserved: Iterable[str]) -> DataFrame:
    """Input columns whose name the result needs get the suffix ``_src`` (repeated until free)."""
    reserved = {r.lower() for r in reserved}
    taken = {c.lower() for c in df.columns} | reserved
    out = []
    for c in df.columns:
        new = c
        if c.lower() in reserved:
            while new.lower() in taken:
                new += "_src"
            taken.add(new.lower())
        out.append(new)
    return df.toDF(*out)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the input doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a row by id and text: null-safe, equal for repeated rows."""
    return F.xxhash64(F.coalesce(col(id_col).cast("string"), F.lit("\u0000")), F.coalesce(col(text_col), F.lit("\u0000")))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks it runs."""
    home = sys.modules.setdefault("_siltstone_worker", types.ModuleType("_siltstone_worker"))
    return home.__dict__.setdefault(name, {})


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])
