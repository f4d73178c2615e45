"""Shared pieces: word rules, tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"

#: Sides of at most this many rows (of a few longs each) may be broadcast; larger ones shuffle.
BROADCAST_ROWS = 500_000

_local_base: list[str] = []
_written: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()
_held: "weakref.WeakKeyDictionary[SparkSession, list]" = weakref.WeakKeyDictionary()


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not _local_base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local_base.append(tempfile.mkdtemp(prefix="namelink-"))
    return f"file://{_local_base[0]}"


def materialize(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors lose nothing.

    few: a task writes up to four partitions, one after the other, into one file, as
    far as two tasks a core are left.  On local paths without Hadoop's native library
    each file that is created starts three ``chmod`` children of the executor, and a
    child counts as much memory as the JVM until it runs its own program.
    """
    spark = df.sparkSession
    path = os.path.join(shared_base(spark), "namelink", f"{tag}-{uuid.uuid4().hex}")
    if few:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-partitions // 4)))
    df.write.parquet(path)
    _written.setdefault(spark, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Compute a small ``df`` now and keep it in disk blocks of the executors: no files; lost blocks are computed again.

    The shuffle files it came from stay as long, so large tables are written instead.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    _held.setdefault(df.sparkSession, []).append(held._jdf)
    held.count()
    return held


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    paths = {os.path.dirname(f) for f in df.inputFiles()}
    for path in paths:
        known = [p for p in _written.get(spark, []) if path.endswith(p.split("://")[-1])]
        for p in known:
            _delete(spark, p)
            _written[spark].remove(p)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this session."""
    for held in _held.pop(spark, []):
        held.unpersist()
    for path in _written.pop(spark, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _release_all() -> None:
    for spark in {*_written, *_held}:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already; the folder then stays for the cluster's cleaner
            break


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, which is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row: later filters and lambdas refer to the value, never to its expression."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs."""
    return df.limit(rows + 1).count() <= rows


def hint_by_size(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted size allows it; otherwise leave the join to shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: The column that ``keyed`` adds.
KEY = "_namelink_key"
#: Keys from here on are not doc_ids.
OWN_KEYS = 1 << 62


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``KEY``, one per distinct document: its doc_id, if no other row has it (doc_ids are below 2^62).

    Rows without a doc_id, or whose doc_id other rows have too, get a hash of id
    and text above all doc_ids; so what one row holds never changes another's key.
    """
    id_ = F.col(doc_id).cast("long")
    own = F.xxhash64(id_.cast("string"), F.coalesce(F.col(text).cast("string"), F.lit(""))).bitwiseAND(F.lit(OWN_KEYS - 1)).bitwiseOR(F.lit(OWN_KEYS))
    shared = docs.where(id_.isNotNull()).groupBy(id_.alias("_shared")).agg(F.count("*").alias("_n")).where("_n > 1").select("_shared")
    if shared.isEmpty():
        return docs.withColumn(KEY, F.coalesce(id_, own))
    shared = materialize(shared, "shared-ids")
    return docs.join(hint_by_size(shared), id_ == F.col("_shared"), "left").withColumn(KEY, F.when(F.col("_shared").isNull(), F.coalesce(id_, own)).otherwise(own)).drop("_shared")


def own_keys(key: str) -> Column:
    """Whether a key is not a doc_id."""
    return F.col(key) >= OWN_KEYS


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a long, b long), any order, loops and repeats allowed.

    Alternating large-star and small-star steps; each is two joins on keys, every
    round is written to the shared folder.  Returns (node, root), root being the
    smallest node of the component; nodes without an edge to another are absent.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )
    before = _state(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialize(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after_small = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), tag)
        drop_table(current)
        drop_table(large)
        current, after = after_small, _state(after_small)
        if after == before:
            break
        before = after
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
