"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Characters that one vectorised step handles at a time; bounds the memory of the Python workers.
CHUNK_CHARS = 1_000_000
#: Bytes of an Arrow batch at most (or one row).
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where none is set and one
    machine runs all, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = getattr(spark, "_llm_shared", None) or "file://" + tempfile.mkdtemp(prefix="llm-")
        spark._llm_shared = found
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the JVM deletes it when the session's process ends."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return re.sub("^file:/+", "file:///", fs.makeQualified(at).toString())


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a context; Spark's file server sends it.

    Also bounds the Arrow batches of this session by bytes, as ten thousand long texts would be gigabytes.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not getattr(sc, "_llm_shipped", False):
        package = Path(__file__).resolve().parent.parent
        to = Path(tempfile.mkdtemp(prefix="llm-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(to))
        sc._llm_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/data"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only for tables that no pending plan reads."""
    if path := getattr(df, "_llm_path", None):
        delete(df.sparkSession, path.rsplit("/", 1)[0])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; 2 marks the held-out rows. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def batches(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows with about ``most`` characters each; a row is never left out."""
    a = n = 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= most:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free(taken: list[str], names: list[str]) -> list[str]:
    """Names for result columns: one that a kept column already has (in any case) gets underscores at its end."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def tidy(run):
    """``run``, a generator over batches, that gives what it freed back to the system at its end: Python workers live on from task
    to task, and what their allocators keep for later counts against the executor's memory meanwhile."""

    def tidied(it):
        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return tidied


def arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """mapInArrow with a generator of dicts of columns, by name, for each batch."""
    ship(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)

    def mapped(it):
        for cols in run(it):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(tidy(mapped), kind)


def per_text(docs: DataFrame, keep: list[str], results: str, work) -> DataFrame:
    """``keep`` columns of every row with the columns ``results`` (DDL) that ``work(texts)`` gives, in that order.

    work sees bounded runs of whole texts. Result names that clash with kept ones get underscores, see ``free``.
    """
    ship(docs.sparkSession)
    kept = docs.select(*map(quoted, keep))
    wanted = StructType.fromDDL(results)
    names = free(keep, wanted.names)
    kind = StructType([*kept.schema.fields, *(StructField(n, f.dataType) for n, f in zip(names, wanted))])
    fields = to_arrow_schema(kind)

    def mapped(it):
        for batch in it:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in batches(texts):
                part = batch.slice(a, b - a)
                own = [part.column(i) for i in range(len(keep))]
                new = [pa.array(x, f.type) for x, f in zip(work(texts[a:b]), list(fields)[len(keep) :])]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(own + new, fields)], schema=fields)

    return docs.select(*map(quoted, keep), F.col("text").alias(free(keep, ["text_in"])[0])).mapInArrow(tidy(mapped), kind)
