"""Tables, the shared folder for intermediate results, and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a Spark context, so that their
    Python workers have it wherever they run."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_strandline_shipped", False) or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="strandline-package-")) / "strandline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(target))
    sc._strandline_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; the package is with the executors from then on."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or the
    checkpoint folder set on the context.  Only where neither is set, and the master is
    local, a temporary folder of this machine is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it: lineage ends there and
    a lost executor costs nothing.  ``release`` deletes the table; what nobody releases,
    because a result still reads it, goes with the application (``release_all``)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(release_all)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


#: Tables in the shared folder that this process has made and not deleted.
_made: dict[str, SparkSession] = {}


def release(df: DataFrame | None) -> None:
    path = getattr(df, "_strandline_path", None)
    if path and path in _made:
        _delete(_made.pop(path), path)


def release_all() -> None:
    """Deletes every table made by ``materialize``; also done when the process ends."""
    while _made:
        path, spark = _made.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the context has ended: what lies on this machine can still go
            if path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes up to which ``attach`` broadcasts its small side.
BROADCAST_BYTES = 32 << 20


def size_in_memory(df: DataFrame) -> int:
    """About how many bytes the rows take: texts as long as they are, other values as wide
    as their type.  One pass, so ``df`` should be a written table."""
    text = [F.coalesce(F.sum(F.length(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    other = sum(16 for f in df.schema if not isinstance(f.dataType, T.StringType))
    row = df.agg(F.count("*").alias("n"), sum(text, F.lit(0)).alias("b")).first()
    return row["n"] * (other + 24 * len(text)) + row["b"]


def attach(rows: DataFrame, small: DataFrame, on: list[str], salts: int = 64, how: str = "inner") -> DataFrame:
    """Joins ``small`` (a written table, unique in ``on``) to ``rows``.  It is broadcast up
    to ``BROADCAST_BYTES``, measured first; beyond, both sides are shuffled with a salt, so
    that a key holding most of ``rows`` is spread over ``salts`` tasks."""
    if size_in_memory(small) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(many, [*on, "_salt"], how).drop("_salt")


def usable(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Not null, not NaN, finite and within the bounds."""
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    if low is not None:
        ok &= v >= low
    if high is not None:
        ok &= v <= high
    return F.coalesce(ok, F.lit(False))
