"""Sharding by balanced label propagation: documents with equal texts move towards one shard while shards keep equal counts.

The law is ``rows``: after placing, the counts of any two shards differ by one at most. Documents start in a shard drawn from their
id. Documents of one text are linked with each other; as they are interchangeable, the state is the number of a text's documents in a
shard, one row for each text and shard that meet, however many copies there are. In each round a text's label is the shard that holds
most of its documents, at first among those with room, later in turns among all and among those with room; its documents elsewhere want to move there. A shard admits movers up to its quota and, in
exchange, as many as leave it (``circulation``), in order of the size of the group that attracts them. Rounds end when neither kind admits any. Moves go from smaller to larger holdings only, so every move lowers the number of
cut links. Then the documents without links fill all shards to their exact quota.

Every prefix sum is distributed (``ranks``). The shards' loads, one number each, are all that reaches the driver.

Defined cases: a null text has size 8, checksum 0 and no links; empty texts are linked as equal texts; a null doc_id is placed like any other; repeated rows
are documents of their own; a group too large for one shard fills several; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle
from .ranks import bases, running_total, salt


@dataclass(frozen=True)
class Sharding:
    shards: int = 24


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _loads(state: DataFrame, shards: int) -> list[int]:
    loads = [0] * shards
    for row in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # at most one row a shard
        loads[row["shard"]] = row["n"]
    return loads


def _together(state: DataFrame) -> tuple[int | None, int]:
    """Twice the links that are not cut, and the documents; and the rows of the state."""
    return tuple(state.agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")), F.count(F.lit(1))).first())


def circulation(wants: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many of the moves wanted from a shard (row) to another one are admitted: chains of moves that end where they began or in a free place.

    The last node stands for free places: a shard with some gives them, and any shard may take them. Every cycle uses a want up, so the loop ends.
    """
    count = len(free)
    left = [[*row, n] for row, n in zip(wants, free, strict=True)] + [[1 << 60] * count + [0]]
    out = [[0] * count for _ in range(count)]

    def cycle() -> list[int] | None:
        seen: set[int] = set()
        for start in range(count):
            path, at = [start], [0]
            while path:
                if path[-1] in seen or at[-1] > count:
                    seen.add(path.pop())
                    at.pop()
                    continue
                to = at[-1]
                at[-1] += 1
                if left[path[-1]][to] > 0 and to not in seen:
                    if to in path:
                        found = path[path.index(to) :]
                        if any(x < count and y < count for x, y in zip(found, [*found[1:], found[0]], strict=True)):
                            return found
                        continue
                    path.append(to)
                    at.append(0)
        return None

    while found := cycle():
        steps = list(zip(found, [*found[1:], found[0]], strict=True))
        n = min(left[x][y] for x, y in steps)
        for x, y in steps:
            left[x][y] -= n
            if x < count and y < count:
                out[x][y] += n
    return out


def propagate(state: DataFrame, quotas: list[int]) -> DataFrame:
    """state: text, shard, n. Rounds of moves until none is admitted.

    Of two kinds, free places come first, then they take turns: texts move to their largest holding with free places, or to their largest one in exchange.
    """
    count, still, turn, exchange = len(quotas), 0, 0, False
    together, rows = _together(state)
    while still < 2:
        loads = _loads(state, count)
        free = [max(0, q - n) for q, n in zip(quotas, loads, strict=True)]
        mine = Window.partitionBy("text")
        # More documents first, then a shard drawn from the text, so that ties do not all go to one shard.
        rank = F.struct("n", F.xxhash64("text", "shard").alias("draw"), "shard")
        open_ = F.lit(True) if exchange else F.element_at(_numbers(free), F.col("shard") + 1) > 0
        seen = state.withColumn("rank", rank).withColumn("label", F.max(F.when(open_, rank)).over(mine))
        moving = seen.where((F.col("label.shard") != F.col("shard")) & (F.col("rank") < F.col("label")))
        moving = moving.select("text", "shard", F.col("label.shard").alias("to"), "n", (-F.floor(F.log2("label.n"))).cast("int").alias("first"), salt("text", "shard").alias("salt"))
        if exchange:
            wants = [[0] * count for _ in quotas]
            for row in moving.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # at most one row for two shards
                wants[row["shard"]][row["to"]] = row["n"]
            admits, keys, place = [n for row in circulation(wants, free) for n in row], ["shard", "to"], F.col("shard") * count + F.col("to")
        else:
            admits, keys, place = free, ["to"], F.col("to")
        moving = running_total(moving, keys, ["first", "salt"], [F.col("text"), F.col("shard")], F.col("n"))
        left = F.element_at(_numbers(admits), place + 1) - F.col("before")
        admitted = moving.select("text", "shard", "to", F.greatest(F.lit(0).cast("long"), F.least("n", left)).alias("n")).where(F.col("n") > 0)
        change = admitted.select("text", F.explode(F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n"))).alias("c"))
        following = state.unionByName(change.select("text", "c.shard", "c.n")).groupBy("text", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
        following = settle(following, rows)
        discard(state)
        state, before = following, together
        together, rows = _together(state)
        still = still + 1 if together == before else 0  # every move raises this sum
        turn += 1
        exchange = exchange != (still > 0 or turn >= 6)  # few free places come up late, one after the other; exchanges do not wait for them
    return state


def shard(docs: DataFrame, options: Sharding = Sharding()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    text = F.col("text").cast("binary")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text"),
    )
    base = settle(base)
    total = base.count()
    quotas = [total // options.shards + (s < total % options.shards) for s in range(options.shards)]
    begin = F.pmod(F.xxhash64("doc_id", "size"), F.lit(options.shards)).cast("int")
    held = base.where(F.col("text").isNotNull()).groupBy("text", begin.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("all", F.sum("n").over(Window.partitionBy("text"))).where(F.col("all") > 1).drop("all")
    state = propagate(settle(held), quotas)

    # What a shard holds beyond its quota is freed; the rest are stretches of each text's documents, in order.
    kept = running_total(state.withColumn("salt", salt("text")), ["shard"], ["salt"], [F.col("text")], F.col("n"))
    room = F.element_at(_numbers(quotas), F.col("shard") + 1)
    kept = kept.select("text", "shard", F.greatest(F.lit(0).cast("long"), F.least("n", room - F.col("before"))).alias("n")).where(F.col("n") > 0)
    ends = F.sum("n").over(Window.partitionBy("text").orderBy("shard"))
    kept = settle(kept.select("text", "shard", (ends - F.col("n")).alias("from"), ends.alias("until"), "n"))
    loads = _loads(kept, options.shards)

    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    # A text's stretches join the buckets of its documents, a row each; the documents join their bucket, so that no text is one key of a join of documents.
    linked = base.withColumn("salt", salt(*order))
    stretches = kept.groupBy("text").agg(F.collect_list(F.struct("from", "until", "shard")).alias("stretches"))  # one a shard at most
    totals = linked.where(F.col("text").isNotNull()).groupBy("text", "salt").agg(F.count(F.lit(1)).alias("__amount")).join(stretches, "text")
    bucket = settle(bases(totals, ["text"], ["salt"], "__amount"))
    inside = F.row_number().over(Window.partitionBy("text", "salt").orderBy(*order)) - 1
    known = linked.join(bucket, ["text", "salt"])
    known = known.withColumn("place", F.col("__base") + inside)
    own = F.filter("stretches", lambda x: (F.col("place") >= x["from"]) & (F.col("place") < x["until"]))
    placed = known.select("doc_id", "size", "text_crc32", F.get(own, F.lit(0))["shard"].alias("shard"))
    alone = linked.join(bucket.select("text", "salt"), ["text", "salt"], "left_anti").select("doc_id", "size", "text_crc32", F.lit(None).cast("int").alias("shard"))
    placed = settle(placed.unionByName(alone))

    free = placed.where(F.col("shard").isNull()).drop("shard").withColumn("one", F.lit(0)).withColumn("salt", salt(*order)).withColumn("fine", salt(F.lit(1), *order))
    free = running_total(free, ["one"], ["salt", "fine"], order, into="place")
    filled, so_far = [], 0
    for quota, load in zip(quotas, loads, strict=True):
        so_far += quota - load
        filled.append(so_far)
    chosen = F.size(F.filter(_numbers(filled), lambda end: end <= F.col("place"))).cast("int")
    whole = placed.where(F.col("shard").isNotNull()).unionByName(free.select("doc_id", "size", "text_crc32", chosen.alias("shard")))
    slots = running_total(whole.withColumn("salt", salt(*order)), ["shard"], ["salt"], order, into="slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
