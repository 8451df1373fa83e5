"""Stage boundaries: a result that several branches read is computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from there.

    The folder is the shared one that the cluster names in ``spark.checkpoint.dir``, so
    the rows survive the loss of executors.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark) -> str:
    """The checkpoint folder; a local session without one gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith(("local[", "local,")) and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pactlens-"))
    return context.getCheckpointDir()


def scratch_folder(spark) -> str:
    """A new folder next to the checkpoints, for data that is written and read again."""
    import uuid

    return f"{_shared_folder(spark)}/tables/{uuid.uuid4().hex}"
