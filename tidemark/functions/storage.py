"""Materialised frames: computed once, written to the shared checkpoint folder, read from there ever after."""

from __future__ import annotations

import tempfile
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

#: Spark takes this setting when a frame is made; ``_CLEANING`` keeps two threads from restoring each other's.
CLEAN_SHUFFLES, _CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", Lock()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once through ``checkpoint()``: lineage is cut, and every later use reads the same rows.

    The folder is the one that the session names in ``spark.checkpoint.dir``. A session on one machine (``local``) that
    names none gets a fresh temporary one; a cluster must name a folder that all executors share.

    The shuffle files of the plan go as soon as the rows are written, not when the driver next collects its garbage: in a query
    of many such steps they would add up, and each costs at least some blocks of disk a task.
    """
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return _without_shuffles(session, df).checkpoint()


def _without_shuffles(session: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows, whose shuffle files Spark removes at the end of an action on this frame. The session's setting stays."""
    with _CLEANING:
        before = session.conf.get(CLEAN_SHUFFLES, None)
        session.conf.set(CLEAN_SHUFFLES, "true")
        try:
            return df.select("*")
        finally:
            if before is None:
                session.conf.unset(CLEAN_SHUFFLES)
            else:
                session.conf.set(CLEAN_SHUFFLES, before)


def shared_folder(df: DataFrame) -> str:
    """The session's checkpoint folder, which driver and executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        keep(df.limit(0))
    return context.getCheckpointDir()
