"""Shared pieces of the training-data operators.

Words are maximal runs of characters other than the space and U+0009..U+000D;
in Python that is exactly ``bytes.split()`` of the UTF-8 text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the session's checkpoint folder.

    Only where a local session has neither (tests), one is made on the machine that all of it runs on.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = conf or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelyard-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_folder: ContextVar[str | None] = ContextVar("folder", default=None)  # where saved tables go inside scratch


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    return f"{(None if keep else _folder.get()) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables saved inside, but those saved to keep, are removed at the end; what is kept must not read them."""
    path = fresh_path(spark, name)
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        remove(spark, path)


def saved_at(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path there."""
    path = fresh_path(df.sparkSession, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and no later stage recomputes it."""
    return saved_at(df, name, keep)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that saved_at wrote and that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def words(text: str | Column) -> Column:
    """The words of a text as an array (null: empty)."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.trim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def word_count(text: str | Column) -> Column:
    """Number of words of a text as long (null: 0)."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.trim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, BLANK_RUN)).cast("long")).otherwise(F.lit(0).cast("long"))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def unused(name: str, columns: list[str]) -> str:
    """name, or name with as many underscores at its end as make it differ from all columns in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; the check that goes before every broadcast."""
    return df.limit(rows + 1).count() <= rows
