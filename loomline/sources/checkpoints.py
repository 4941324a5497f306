"""Checkpoints of a tree of texts, kept as tables: what a path held before a checkpoint first changed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshots(edits: DataFrame) -> DataFrame:
    """(checkpoint, path, before, existed): of the edits (checkpoint, path, seq, before, existed) of a path within one
    checkpoint the first counts, as later ones have already changed it."""
    first = F.min_by(F.struct("before", "existed"), "seq")
    return edits.groupBy("checkpoint", "path").agg(first.alias("s")).select("checkpoint", "path", "s.before", "s.existed")


def listed(saved: DataFrame, limit: int = 20) -> DataFrame:
    """The last checkpoints, with how many paths each holds."""
    return saved.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("paths")).orderBy(F.desc("checkpoint")).limit(limit)


def rollback(state: DataFrame, saved: DataFrame, checkpoint=None) -> tuple[DataFrame, DataFrame]:
    """The state (path, content) as it was before a checkpoint (the last one, if none is named), and what was done (path,
    action: restored, or deleted for a path that the checkpoint made). Without such a checkpoint nothing is done."""
    if checkpoint is None:
        checkpoint = saved.agg(F.max("checkpoint")).first()[0]
    own = saved.where(F.col("checkpoint") == F.lit(checkpoint)).select("path", "before", F.coalesce("existed", F.lit(False)).alias("existed"))
    kept = state.join(own.select("path"), "path", "left_anti").select("path", "content")
    back = own.where("existed").select("path", F.coalesce("before", F.lit("")).alias("content"))
    gone = own.where("not existed").join(state.select("path"), "path", "left_semi")
    actions = back.select("path", F.lit("restored").alias("action")).unionByName(gone.select("path", F.lit("deleted").alias("action")))
    return kept.unionByName(back), actions
