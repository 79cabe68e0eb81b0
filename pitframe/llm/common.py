"""Helpers that the operators share: reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that Spark hands to Python at once, at most (a row is handed over whole).
BATCH_ROWS = 1_000
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands whole texts to Python in batches of ``BATCH_ROWS`` and ``BATCH_BYTES``.

    By default a batch has 10,000 rows or 64 MB, which an executor holds
    several times over for each core: as rows that wait for their results, as
    Arrow buffers and as Python strings, and neither allocator gives all of it
    back.  Results do not depend on it.  Smaller limits of the session stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.match(r"(-?\d+)([kmgt]?)", spark.conf.get(key).lower()).groups()
        now = int(number) << 10 * " kmgt".index(unit or " ")
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs inside one machine, a temporary
    folder takes its place; on a cluster the setting is required, since
    executors do not see each other's folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pitframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: without its lineage, and with the size of its files.

    A checkpoint keeps the plan's own estimate of its size; where results are
    joined with each other round after round, such estimates grow without end.
    """
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.parquet(path)


def without_ids(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``ids``.

    The ids are broadcast where a count shows them to be few enough; else both
    sides are shuffled.  A row with a null doc_id stays.
    """
    few = ids.count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")
