"""Chat formatting: logged snapshots collapse into their longest conversation, which is rendered.

Logs often hold a conversation once per turn, each a prefix of the next.  A
rolling 128-bit hash over (role, text) names every turn prefix; a conversation
whose whole hash is a proper prefix of another is dropped by an anti-join, and
of equal conversations the smallest conv_id stays.  Both sides of the anti-join
are distinct hashes, so a first turn or conversation that many share is one row.

Turns are ordered by turn, then role and text (null first); null role or text
counts as empty; rows with a null conv_id are one conversation; an empty table
gives none; very long texts are hashed and rendered whole; of equal conversations
the smallest conv_id stands (null first); extra columns are not read.  Markers of the chat format inside a
text are broken up, so a text cannot forge a turn.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

START, END, MARK, BROKEN = "<|im_start|>", "<|im_end|>", "<|", "< |"


def _prefixes(batches):
    """A stream sorted by conversation and turn: (conv_id, prefix hash, turns so far, whether it is the whole)."""
    held, state, at, n = None, b"", None, 0
    for b in batches:
        out = []
        for i in range(b.num_rows):
            conv, role, text = (b.column(c)[i].as_py() for c in range(3))
            if held is None or conv != at:
                if held is not None:
                    out.append((*held, True))
                state, at, n = b"", conv, 0
            elif held is not None:
                out.append((*held, False))
            parts = (role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass"))
            state = xxhash.xxh3_128_digest(state + len(parts[0]).to_bytes(8, "big") + b"".join(parts))
            n += 1
            held = (conv, state.hex(), n)
        yield _batch(out)
    if held is not None:
        yield _batch([(*held, True)])


def _batch(rows):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "prefix", "n_turns", "whole"])


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), text("role"), text("text"), F.col("turn").cast("long").alias("turn"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal) of the conversations that no longer one begins with; n_equal counts its copies."""
    ordered = _turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    hashed = materialize(
        ordered.select("conv_id", "role", "text").mapInArrow(_prefixes, "conv_id long, prefix string, n_turns long, whole boolean"), "chat-prefixes"
    )
    wholes = hashed.where("whole").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.count("*").alias("n_equal"))
    proper = hashed.where("not whole").select("prefix").distinct()
    return wholes.join(proper, "prefix", "left_anti").select("conv_id", "n_turns", "n_equal")


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, text): each kept conversation in the chat format."""
    clean = lambda c: F.replace(c, F.lit(MARK), F.lit(BROKEN))
    chosen = kept.withColumnRenamed("conv_id", "_kept")
    wanted = _turns(conversations).join(chosen.select("_kept"), F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi")
    turns = wanted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(START), clean(t["role"]), F.lit("\n"), clean(t["text"]), F.lit(END), F.lit("\n"))
    joined = turns.join(chosen, F.col("conv_id").eqNullSafe(F.col("_kept")))
    return joined.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("turns", line), "").alias("text"))
