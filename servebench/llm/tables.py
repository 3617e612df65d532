"""Reading the supplied tables and the column conventions all operators share.

* Inputs may carry any further columns; an operator reads the columns it names
  and nothing else, so clashing names cannot reach its output.
* ``doc_id`` NULL: the row keeps its own result, but takes no part in anything
  that compares documents (see each operator).
* ``text`` NULL counts as the empty text unless an operator says otherwise.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

# The word of the contracts: a run of characters other than the six ASCII blanks.
# ``bytes.split()`` cuts at exactly these characters.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id`` as a long and ``text`` as UTF-8 bytes (NULL: empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as a long and ``text`` as a string (NULL: empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n`` (the fold rule of the contracts)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def prepare(spark: SparkSession) -> None:
    """Make the package importable in tasks and the shared folder known."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of finished steps: it does
    so once the driver has collected the objects that stood for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    free(df.sparkSession)
    return df.checkpoint(eager=True)
