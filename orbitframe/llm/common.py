"""Table access, shared materialisation and small helpers used by every operator here."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers: texts go to them in small batches.

    Settings of the session are only ever lowered to ``BATCH_ROWS`` and
    ``BATCH_BYTES``; they are read when a result is computed, so they stay.
    """
    for name, ours in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        digits = re.fullmatch(r"(\d+)b?", spark.conf.get(name).lower())
        if not digits or not 0 < int(digits[1]) <= ours:
            spark.conf.set(name, str(ours))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return base.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    held = getattr(_own_dir, "path", None)
    if held is None:
        held = tempfile.mkdtemp(prefix="orbitframe-")
        atexit.register(shutil.rmtree, held, ignore_errors=True)
        _own_dir.path = held
    return f"file://{held}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    planner the written size, so that it broadcasts only what it has measured.
    Whatever ``release`` has not deleted before is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._orbit_path = path
    if not _left:
        atexit.register(_clean)
    _left[path] = spark.sparkContext
    return back


#: Folders written and not yet deleted.
_left: dict[str, object] = {}


def _delete(path: str, context) -> None:
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration() if context._jsc is None else context._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, context in _left.items():
        try:
            _delete(path, context)
        except Exception:  # noqa: BLE001 - the driver is going down and Java may have gone before
            return


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_orbit_path", None)
    if path:
        _delete(path, df.sparkSession.sparkContext)
        _left.pop(path, None)


#: A key of more rows than both this and a ``HOT_KEYS``-th of all is hot: so there are at most ``HOT_KEYS`` of them.
HOT_ROWS, HOT_KEYS = 10_000, 10_000


def hot_join(rows: DataFrame, one: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined to ``one``, which has every key once and in ``n`` how many of ``rows`` have it.

    Hot keys, ``HOT_KEYS`` at most, are broadcast, so that their rows stay where
    they are; all others meet in a join that no single key can overload.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(one.where(F.col("n") > limit).drop("n"))
    cold = one.where(F.col("n") <= limit).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; 0 where the id is null."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitively)."""
    names = {c.lower() for c in df.columns}
    name = base
    while name.lower() in names:
        name += "_"
    return name


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-int(rows) // per_block))
