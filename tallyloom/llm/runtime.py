"""Scratch tables and session helpers shared by the operators of this subpackage.

Lineage is cut by writing a table under the shared folder the cluster names in
``spark.checkpoint.dir``; every executor and the driver see that folder, so a
lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the setting is missing (local tests)."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for path in [df.scratch_path for df in tables]:
        for entry in [x for x in _WRITTEN if x[1] == path]:
            _WRITTEN.remove(entry)
            _delete(*entry)


def mark() -> int:
    """Where the list of scratch tables stands now; for ``drop_since``."""
    return len(_WRITTEN)


def drop_since(since: int) -> None:
    """Delete the scratch tables written after ``mark`` gave ``since``, but for the last one (a stage's own result)."""
    for entry in _WRITTEN[since:-1]:
        _WRITTEN.remove(entry)
        _delete(*entry)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs whose results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _drop_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; nothing is left to clean
            return


#: Bits of a bitmap (2 MB, whatever the table holds) and of the pages in which it reaches the driver.
FILTER_BITS, PAGE_BITS = 24, 17


def _page(rows: pa.Table) -> pa.Table:
    """(kind, page, bits): the slots of one page of a bitmap."""
    bits = np.zeros(1 << PAGE_BITS, np.uint8)
    bits[rows.column("slot").to_numpy() & ((1 << PAGE_BITS) - 1)] = 1
    return pa.table({"kind": rows.column("kind")[:1], "page": rows.column("page")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bitmaps(slots: DataFrame, kinds: int, filter_bits: int = FILTER_BITS) -> dict[int, bytes]:
    """Bitmaps of ``slots`` (kind int, slot long under 2^filter_bits), built by executors: ``kinds`` times 2^(filter_bits - 3) bytes (2 MB) at most reach the driver, whatever the table holds."""
    slots = slots.distinct().withColumn("page", F.shiftright("slot", PAGE_BITS).cast("int"))
    size = 1 << (PAGE_BITS - 3)
    maps = {kind: bytearray(1 << (filter_bits - 3)) for kind in range(kinds)}
    for r in slots.groupBy("kind", "page").applyInArrow(_page, "kind int, page int, bits binary").collect():
        maps[r["kind"]][r["page"] * size : (r["page"] + 1) * size] = r["bits"]
    return {k: bytes(x) for k, x in maps.items()}


def holds(bits: bytes, slots: np.ndarray) -> np.ndarray:
    """Whether a bitmap has the slots. The bitmap stays packed: unpacked it would take eight times the memory in every worker."""
    return (np.frombuffer(bits, np.uint8)[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the whole table; sizes partitions and buckets."""
    row = docs.select(F.octet_length(F.col(text)).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
    return int(row["c"]), int(row["s"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> list:
    """(d, t): identifies a row's content even where doc_id is null or repeated."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text"))).alias("d"),
        F.hash(F.col("text")).alias("t"),
    ]
