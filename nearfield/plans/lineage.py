"""Where iterations cut their lineage: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.vector import sound_unions


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine that names none gets its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that its machines share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="nearfield-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Runs df once and keeps its rows in the shared folder, so no executor's loss loses them."""
    sound_unions(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """Rows of a round as files of the shared folder.

    A checkpoint keeps the size that Spark guessed for its plan.  Each round joins the last one, so
    guesses multiply to numbers of millions of digits that fill the driver; files have their own size.
    """
    spark = df.sparkSession
    sound_unions(spark)
    path = f"{checkpoint_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
