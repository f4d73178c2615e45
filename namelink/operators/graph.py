"""Connected components and leader assignment over an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, component) for ``nodes`` (ord) over ``edges`` (a, b): the smallest ord reachable.

    Each round takes the least label among neighbours and then follows labels
    (pointer jumping), so long chains end in logarithmically many rounds.
    """
    links = written(both_ways(edges.where("a <> b")).distinct(), "links")
    labels = written(nodes.select("ord", F.col("ord").alias("component")), "labels")
    while True:
        near = links.join(labels, links["b"] == labels["ord"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["ord"] == near["a"], "left").select("ord", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = hooked.select(F.col("ord").alias("to"), F.col("component").alias("next"))
        moved = written(
            hooked.join(jump, F.col("component") == F.col("to")).select("ord", F.least("component", "next").alias("component"), "old"), "labels"
        )
        labels = moved.select("ord", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, leader): the greedy clustering that scans nodes by ord, as rounds over all undecided nodes.

    A node leads if no leader before it is its neighbour, and otherwise joins the
    first leader that is: the lexicographically first maximal independent set.
    A round settles every node whose earlier neighbours are all settled or none.
    """
    before = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("earlier")).distinct(), "earlier"
    )
    state = written(nodes.select("ord", F.lit(None).cast("boolean").alias("leads")), "state")
    while True:
        known = before.join(state.select(F.col("ord").alias("earlier"), "leads"), "earlier")
        seen = known.groupBy("node").agg(
            F.max(F.coalesce("leads", F.lit(False))).alias("has_leader"), F.max(F.col("leads").isNull()).alias("waits")
        )
        state_now = state.join(seen, state["ord"] == seen["node"], "left").select(
            "ord",
            F.when(F.col("leads").isNotNull(), F.col("leads"))
            .when(F.coalesce("has_leader", F.lit(False)), False)
            .when(~F.coalesce("waits", F.lit(False)), True)
            .alias("leads"),
        )
        state = written(state_now, "state")
        if state.where("leads is null").isEmpty():
            break
    first = (
        before.join(state.where("leads").select(F.col("ord").alias("earlier")), "earlier").groupBy("node").agg(F.min("earlier").alias("leader"))
    )
    return state.join(first, state["ord"] == first["node"], "left").select(
        "ord", F.when(F.col("leads"), F.col("ord")).otherwise(F.col("leader")).alias("leader")
    )


def numbered(groups: DataFrame, key: str) -> DataFrame:
    """``groups`` with group_id: 0, 1, ... in order of ``key``'s smallest ord.

    Keys are ranked on their own small table: ranges of the order are numbered
    locally and shifted by the sizes of the ranges before, so no task sees all keys.
    """
    firsts = groups.groupBy(key).agg(F.min("ord").alias("first"))
    ranged = written(firsts.repartitionByRange("first").withColumn("part", F.spark_partition_id()), "groups")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    shift, total = {}, 0
    for part in sorted(sizes):
        shift[part] = total
        total += sizes[part]
    from pyspark.sql import Window

    local = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    offsets = F.create_map(*[F.lit(v) for kv in shift.items() for v in kv]) if shift else F.create_map(F.lit(0), F.lit(0))
    ids = ranged.select(F.col(key).alias("_key"), (local + F.element_at(offsets, F.col("part"))).cast("int").alias("group_id"))
    return groups.join(ids, groups[key] == ids["_key"]).drop("_key")
