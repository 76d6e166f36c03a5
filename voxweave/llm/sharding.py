"""Balanced label propagation over documents of equal text, in DataFrame operations only.

Documents of equal text are linked, and linked documents of one shard are alike, so the state is one row
for each (text, shard) with its number of documents: at most one row a shard for the largest group.
Each round, rows move to the shard that holds most of their neighbours and has room, by exact quotas
taken from prefix sums. Then groups are settled within counts at most one apart: what is still cut, or over a
shard's count, moves whole to where room is, and documents without links fill the rest, so that
only groups are cut which exceed a shard or find no shard with room for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.common import buckets, cut, prefix_sum

KEY = ["h", "text_crc32", "size"]


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    return [got.get(s, 0) for s in range(shards)]


def _propose(state: DataFrame, shards: int, free: list[int]) -> DataFrame:
    """Rows that would move: their shard, the open shard with most neighbours (then the lowest), how many."""
    counts = state.groupBy(*KEY).agg(*(F.sum(F.when(F.col("label") == s, F.col("n")).otherwise(0)).alias(f"c{s}") for s in range(shards)))
    options = F.array(*(F.struct(F.col(f"c{s}").alias("near"), F.lit(-s).alias("to")) for s in range(shards) if free[s] > 0))
    top = counts.select(*KEY, F.array_max(options).alias("top"))
    moves = state.join(top, KEY).select(*KEY, "label", "n", (-F.col("top.to")).cast("int").alias("to"), F.col("top.near").alias("near"))
    return moves.where((F.col("to") != F.col("label")) & ((F.col("near") > F.col("n")) | ((F.col("near") == F.col("n")) & (F.col("to") < F.col("label")))))


def propagate(state: DataFrame, shards: int, most: int, rounds: int = 6, spread: int = 997) -> DataFrame:
    """state: KEY, label, n. Moves rows towards their neighbours; no shard gets over `most` documents by moves."""
    for _ in range(rounds):
        load = _loads(state, shards)
        free = [max(0, most - x) for x in load]
        if not any(free):
            break
        moves = cut(_propose(state, shards, free).withColumn("bucket", F.pmod("h", F.lit(spread)).cast("int")), "moves")
        if moves.isEmpty():
            break
        moves = prefix_sum(moves, ["to"], "bucket", [*KEY, "label"], "n", "before")
        room = F.element_at(F.array(*(F.lit(x) for x in free)), F.col("to") + 1)
        whole = F.col("n") + F.col("before") <= room
        part = F.when(whole, F.col("n")).when(F.col("n") > max(1, most // 64), F.greatest(F.lit(0), room - F.col("before"))).otherwise(0)
        moves = moves.select(*KEY, "label", "to", part.cast("long").alias("moved")).where("moved > 0")
        gone = moves.select(*KEY, "label", (-F.col("moved")).alias("n"))
        came = moves.select(*KEY, F.col("to").alias("label"), F.col("moved").alias("n"))
        state = cut(state.select(*KEY, "label", "n").union(gone).union(came).groupBy(*KEY, "label").agg(F.sum("n").alias("n")).where("n > 0"), "state")
    return state


def _spread(groups: list, free: list[int]) -> list[tuple]:
    """Places (KEY, label, n) rows for groups (KEY, {label: n}), the largest first; takes their room from free.

    A group goes to the shard that holds most of it, else to the one with most room; if none has room for all, it is cut.
    """
    out = []
    for key, held in sorted(groups, key=lambda g: (-sum(g[1].values()), g[0])):
        rest = sum(held.values())
        order = sorted(range(len(free)), key=lambda s: (-held.get(s, 0), -free[s], s))
        whole = [s for s in order if free[s] >= rest]
        if whole and whole[0] not in held:
            whole.sort(key=lambda s: (-free[s], s))
        for s in whole[:1] or order:
            n = min(rest, free[s])
            if n > 0:
                out.append((*key, s, n))
                free[s] -= n
                rest -= n
    return out


def settle(state: DataFrame, goal: list[int], spread: int = 997) -> DataFrame:
    """state: KEY, label, n. No shard holds more than its goal, and groups that fit are whole.

    Groups over a 64th of a shard are few (64 a shard at most) and placed on the driver. Smaller ones stay where they are whole
    and have room; the others are laid along the room that is left, by prefix sums. At most one a shard
    lies across an end; these are placed on the driver.
    """
    spark, shards = state.sparkSession, len(goal)
    limit = max(1, max(goal) // 64)
    groups = state.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("label").alias("label"), F.max("label").alias("last"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("held"))
    groups = cut(groups.withColumn("bucket", F.pmod("h", F.lit(spread)).cast("int")), "groups")
    given = "h long, text_crc32 long, size long, label int, n long"

    def placed(rows: DataFrame, free: list[int]) -> DataFrame:
        own = [(tuple(r[k] for k in KEY), r["held"]) for r in rows.select(*KEY, "held").collect()]
        return spark.createDataFrame(_spread(own, free), given)

    free = list(goal)
    large = placed(groups.where(F.col("n") > limit), free)
    small = groups.where(F.col("n") <= limit)
    room = F.element_at(F.array(*(F.lit(x) for x in free)), F.col("label") + 1)
    calm = prefix_sum(small.where("label = last"), ["label"], "bucket", KEY, "n", "before").withColumn("stays", F.col("before") + F.col("n") <= room)
    calm = cut(calm.drop("before").unionByName(small.where("label < last").withColumn("stays", F.lit(False))), "calm")
    stay = calm.where("stays").select(*KEY, "label", "n")
    free = [f - x for f, x in zip(free, _loads(stay, shards))]
    ends = [sum(free[: s + 1]) for s in range(shards)]
    laid = prefix_sum(calm.where("not stays"), [], "bucket", KEY, "n", "before")
    to = F.lit(None).cast("int")
    for s in reversed(range(shards)):
        inside = (F.col("before") >= ends[s] - free[s]) & (F.col("before") + F.col("n") <= ends[s])
        to = F.when(inside, F.lit(s)).otherwise(to)
    laid = cut(laid.withColumn("to", to), "laid")
    fits = laid.where("to is not null").select(*KEY, F.col("to").alias("label"), "n")
    free = [f - x for f, x in zip(free, _loads(fits, shards))]
    across = placed(laid.where("to is null"), free)
    return cut(large.union(stay).union(fits).union(across), "settled")


def shard(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is `rows`: the shards' row counts are at most one apart. size: UTF-8 bytes of the text and 1; null
    text counts as none. Repeated rows count each; an empty table gives no rows. grown_shard is null. Very long texts
    count with their whole size; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    base = cut(base.withColumn("mix", F.xxhash64("doc_id", "h")), "sizes")
    total = base.count()
    state0 = base.groupBy(*KEY, F.pmod("mix", F.lit(shards)).cast("int").alias("label")).agg(F.count("*").alias("n"))
    sizes = state0.groupBy(*KEY).agg(F.sum("n").alias("total"))
    state = cut(state0.join(sizes.where("total > 1").drop("total"), KEY), "state")
    spread = max(997, buckets(total))  # of prefix sums over groups; grows with the table
    state = propagate(state, shards, -(-total // shards), rounds, spread)

    # The unlinked documents fill the rest in order.
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    final = settle(state, goal, spread)
    load = _loads(final, shards)
    gaps, at = [], 0
    for s in range(shards):
        gaps.append((at, at := at + goal[s] - load[s]))
    final = final.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("parts"), F.sum("n").alias("total"))

    rows = cut(base.join(final, KEY, "left").withColumn("bucket", F.pmod("mix", F.floor(F.coalesce(F.col("total"), F.lit(total)) / 20_000) + 1)), "linked")
    linked = prefix_sum(rows.where("parts is not null").withColumn("one", F.lit(1)), KEY, "bucket", ["mix", "doc_id"], "one", "rank")
    upto = F.aggregate("parts", F.struct(F.lit(-1).alias("label"), F.lit(0).cast("long").alias("end")), lambda a, p: F.when(a["end"] > F.col("rank"), a).otherwise(F.struct(p["label"].alias("label"), (a["end"] + p["n"]).alias("end"))))
    linked = linked.select("doc_id", "size", "text_crc32", "mix", upto["label"].alias("shard"))
    alone = prefix_sum(rows.where("parts is null").withColumn("one", F.lit(1)), [], "bucket", ["mix", "doc_id"], "one", "rank")
    pick = F.lit(0)
    for s, (lo, hi) in enumerate(gaps):
        pick = F.when((F.col("rank") >= lo) & (F.col("rank") < hi), s).otherwise(pick)
    alone = alone.select("doc_id", "size", "text_crc32", "mix", pick.alias("shard"))
    placed = cut(linked.union(alone).withColumn("one", F.lit(1)).withColumn("bucket", F.pmod("mix", F.lit(buckets(total)))), "placed")
    out = prefix_sum(placed, ["shard"], "bucket", ["mix", "doc_id"], "one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
