"""What the operators of this folder share: work tables, column names that cannot clash, row keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        at = Path(tempfile.mkdtemp(prefix="assaykit-")) / "assaykit.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(at))
        _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="assaykit-")
        at = _OWN[app]
    return at.rstrip("/")


class Workspace:
    """Written tables that cut lineage: a lost executor costs a re-read, not a recomputation.

    They lie in a folder of their own under the shared one and go when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


_HELD: dict[str, Callable[[], None]] = {}


def take_worker(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Said by an operator's tasks as they begin: what other operators' tasks remembered in this worker process is let go.

    Python workers serve one stage after another, so tables of known words would otherwise add up.
    """
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: its freed memory stays with the process
    if forget:
        _HELD[owner] = forget


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of those taken, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name in which nulls equal each other; keeps the left ones. Other columns must differ in name."""
    names = fresh([*left.columns, *right.columns], *(f"right_{k}" for k in keys))
    cond = F.lit(True)
    for k, n in zip(keys, names):
        right = right.withColumnRenamed(k, n)
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, cond, how).drop(*names)


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id and text only; null text is empty. th tells rows apart that share a doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
