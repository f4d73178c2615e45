"""Assigning a stream of names to existing groups by their normal form, as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text


def assign(names: DataFrame, leaders: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``names`` (name, ...; batch or stream) with norm, group_id and canonical_name of ``leaders`` (norm, group_id, canonical_name).

    A stream-static equi-join: no state; names of unknown forms get nulls and can be collected for the next full run.
    """
    normed = names.withColumn("norm", text.normalize(F.col("name"), cfg.suffixes))
    known = leaders.select("norm", "group_id", "canonical_name")
    return normed.join(known, "norm", "left")


def new_forms(names: DataFrame, at: str, lateness: str, window: str, cfg: Config = Config()) -> DataFrame:
    """Counts of normal forms per tumbling window of event time ``at``; rows later than ``lateness`` are dropped."""
    normed = names.withColumn("norm", text.normalize(F.col("name"), cfg.suffixes)).withWatermark(at, lateness)
    return normed.groupBy(F.window(at, window).alias("w"), "norm").agg(F.count("*").alias("n")).select("w.start", "w.end", "norm", "n")
