"""What the operators of this subpackage share: inputs, written intermediate tables, word and text rules."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
BLANKS = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are written inside leave no shuffle files: what is written is all that stays of them."""
    clean = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, clean)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, there after an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later query reads."""
    for df in tables:
        _delete(df.sparkSession, df.__dict__["_scratch"])


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: the measure from which partition and block counts follow."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces(amount: int, each: int, least: int = 1) -> int:
    return max(least, -(-amount // each))


def mapped(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], Iterable[tuple]], rows: int = 512) -> DataFrame:
    """fn over slices of at most `rows` rows (columns as lists), its tuples as rows of schema; bounded memory."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = [*fn(batch.slice(at, rows).to_pydict())]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), out.types)], schema=out)

    return df.mapInArrow(run, schema)


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode().lower().decode()


def words_of(text: str | Column) -> Column:
    """The words of a text as an array, JVM-side; null gives none."""
    flat = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(flat, " "), "")
