"""What the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrun.sources.shared import folder, written

#: Documents whose ids a task remembers.
REMEMBERED = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    return written(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: smaller than a checkpoint, and read
    by columns. drop_stored() deletes it."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that stored() wrote; nothing may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for rows whose label must not be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Seen(set):
    """Documents that a task met before. Forgets all when it has become too large, so a repeat may pass."""

    def again(self, document: tuple) -> bool:
        if document in self:
            return True
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(document)
        return False
