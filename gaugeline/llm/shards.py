"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. Every document starts in the shard of its id's hash. In each round a group's
documents move to its goals: a large group has as many shards as it fills, planned once; a small one the shard that has
most of it, of those that large groups leave room in. Moves into a shard are accepted up to its room, and rows that
leave make room; small groups move whole. It ends when the count of cut pairs falls no more. Counts by (group, shard)
are partial aggregates and come back by a join, so a group may hold any share of all rows. At the end shards are
brought to counts at most one apart (law ``rows``): documents beyond a shard's quota, unlinked ones first, fill the
gaps of others.

Slots and overflow numbers are offsets of small buckets plus a row number inside a bucket, so no shard is
sorted in one task.

Null text is size 8, CRC 0 and linked to nothing; null and repeated ids are rows like any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LAW = "rows"


def _part(column: Column, salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(n)).cast("int")


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _plan(large: list, shards: int, capacity: int) -> list[tuple[bytes, int, int]]:
    """(group, shard, most rows) for large groups, the largest first: whole shards, those that have most of it."""
    free, out = [capacity] * shards, []
    held: dict = {}
    for r in large:
        held.setdefault(bytes(r["group"]), {})[r["shard"]] = r["k"]
    for group, k in sorted(held.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        left = sum(k.values())
        while left and any(free):
            # an empty shard while a whole one is needed, else the one it fits best
            s = max(range(shards), key=lambda t: (min(free[t], left), -free[t], k.get(t, 0), -t))
            take = min(free[s], left)
            out.append((group, s, take))
            free[s], left = free[s] - take, left - take
    return out


def _shares(flows: dict, load: list[int], capacity: int, steps: int = 100) -> list[float]:
    """What share of the rows that ask for each shard it takes, if rows that leave make room."""
    n = len(load)
    asked = [sum(k for (_, t), k in flows.items() if t == s) for s in range(n)]
    share = [1.0] * n
    for _ in range(steps):
        gone = [0.0] * n
        for (s, t), k in flows.items():
            gone[s] += k * share[t]
        share = [min(share[s], max(0.0, capacity - load[s] + gone[s]) / asked[s]) if asked[s] else 1.0 for s in range(n)]
    return share


def _cut(at: DataFrame) -> int:
    """Pairs of equal rows in different shards."""
    square = lambda c: (F.col(c).cast("decimal(18,0)") * F.col(c).cast("decimal(18,0)")).cast("decimal(38,0)")
    sums = at.groupBy("group").agg(F.sum("k").alias("m"), F.sum(square("k")).alias("same")).agg(F.sum(square("m") - F.col("same")).alias("cut"))
    return int(sums.head()["cut"] or 0)


def propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(uid, group, shard) once the count of cut pairs falls no more; no shard gets more than about ``capacity`` linked
    rows."""
    spark, step, before, last = linked.sparkSession, 0, None, linked
    plan = None
    while True:
        at = materialize(linked.groupBy("group", "shard").agg(F.count("*").alias("k")), "shard-counts")
        cut = _cut(at)
        if before is not None and cut >= before:
            return last
        if not cut:
            return linked
        before, last = cut, linked
        if plan is None:  # groups of over a quarter of a shard: at most four a shard, so their counts fit the driver
            big = at.groupBy("group").agg(F.sum("k").alias("m")).filter(F.col("m") * 4 > max(capacity, 4 * shards)).select("group")
            large = [r.asDict() for r in at.join(big, "group").collect()]
            rows = _plan(large, shards, capacity)
            plan = spark.createDataFrame(rows, "group binary, goal int, most long")
            taken = [sum(m for _, s, m in rows if s == t) for t in range(shards)]
            spare = spark.createDataFrame([(s, capacity - taken[s]) for s in range(shards)], "shard int, spare long")
        goals = at.join(F.broadcast(plan.withColumnRenamed("goal", "shard")), ["group", "shard"], "right")
        # rows of a large group go where it lacks most of what was planned, dealt by hash over those shards
        lacks = goals.select("group", F.struct(F.col("shard").alias("goal"), F.greatest(F.lit(0), F.col("most") - F.coalesce("k", F.lit(0))).alias("lack")).alias("g"))
        lacks = F.broadcast(lacks.groupBy("group").agg(F.array_sort(F.collect_list("g")).alias("goals")))
        of_large = at.join(lacks, "group").filter(~F.exists("goals", lambda g: g["goal"] == F.col("shard"))).withColumn("total", F.aggregate("goals", F.lit(0).cast("long"), lambda a, g: a + g["lack"]))
        of_large = of_large.filter("total > 0").select("group", "shard", F.explode("goals").alias("g"), "k", "total")
        upto = F.sum("g.lack").over(Window.partitionBy("group", "shard").orderBy("g.goal"))
        of_large = of_large.select("group", "shard", F.col("g.goal").alias("goal"), (F.col("k") * F.col("g.lack") / F.col("total")).alias("k"), ((upto - F.col("g.lack")) / F.col("total")).alias("low"), (upto / F.col("total")).alias("high"))
        # a small group goes to the one that has most of it, of those that large groups leave room in
        small = at.join(F.broadcast(plan.select("group").distinct()), "group", "left_anti").join(F.broadcast(spare), "shard")
        rank = F.col("k") + _unit(F.lit(step), F.col("group"), F.col("shard")) / 2 + F.when(F.col("spare") > 0, 0).otherwise(-(1 << 40))
        goal = small.withColumn("rank", rank).groupBy("group").agg(F.max_by("shard", "rank").alias("goal"), F.max("rank").alias("best"))
        roomy = [s for s in range(shards) if taken[s] < capacity]
        if roomy:  # a group that is in shards of large groups only makes room there
            elsewhere = F.array(*map(F.lit, roomy))[F.pmod(F.xxhash64("group"), F.lit(len(roomy))).cast("int")]
            goal = goal.withColumn("goal", F.when(F.col("best") < 0, elsewhere).otherwise(F.col("goal")))
        of_small = small.join(goal, "group").filter("shard <> goal").select("group", "shard", "goal", F.col("k").cast("double").alias("k"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
        movers = materialize(of_large.union(of_small), "shard-goals")
        flows = {(r["shard"], r["goal"]): r["k"] for r in movers.groupBy("shard", "goal").agg(F.sum("k").alias("k")).collect()}
        loads = {r["shard"]: r["load"] for r in at.groupBy("shard").agg(F.sum("k").alias("load")).collect()}
        share = F.array(*map(F.lit, _shares(flows, [loads.get(s, 0) for s in range(shards)], capacity)))[F.col("goal")]
        # one row a group and shard, so that no row is met twice
        moves = movers.groupBy("group", "shard").agg(F.array_sort(F.collect_list(F.struct("low", "high", "goal"))).alias("to"))
        at_unit = _unit(F.lit(step), F.col("uid"), F.lit(9))
        found = linked.join(moves, ["group", "shard"], "left").withColumn("goal", F.get(F.filter("to", lambda t: t["low"].isNull() | ((t["low"] <= at_unit) & (at_unit < t["high"]))), F.lit(0)))
        by = F.when(F.col("goal.low").isNull(), _unit(F.lit(step), F.col("group"), F.lit(7))).otherwise(_unit(F.lit(step), F.col("uid"), F.lit(7)))
        chance = found.select("uid", "group", "shard", F.col("goal.goal").alias("goal"), by.alias("by"))
        linked = materialize(chance.select("uid", "group", F.when(F.col("goal").isNotNull() & (F.col("by") < share), F.col("goal")).otherwise(F.col("shard")).alias("shard")), "shard-labels")
        step += 1


def assign(docs: DataFrame, shards: int = 24, bucket_rows: int = 4000) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law has none)."""
    text = F.col("text").cast("string")
    body = F.coalesce(F.encode(text, "utf-8"), F.lit(b""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.when(text.isNull(), None).otherwise(F.unhex(F.md5(body))).alias("group"))
    base = materialize(base, "shard-base")
    rows = base.select("doc_id", "size", "text_crc32", "group").withColumn("uid", F.xxhash64("doc_id", "size", "text_crc32"))
    n = base.count()
    quota, more = divmod(n, shards)
    # written, so that the join below deals out both sides itself and a large group's rows can be split
    groups = materialize(base.filter("group is not null").groupBy("group").agg(F.count("*").alias("m")).filter("m > 1").select("group"), "shard-groups")
    linked = rows.join(groups, "group", "left_semi").select("uid", "group", _part(F.col("doc_id"), 1, shards).alias("shard"))
    labels = propagate(materialize(linked, "shard-linked"), shards, max(1, quota))
    labels = labels.groupBy("uid").agg(F.min("shard").alias("label"))  # repeated rows share one
    placed = rows.join(labels, "uid", "left").withColumn("single", F.col("label").isNull().cast("int"))
    buckets = max(1, n // (shards * bucket_rows))
    placed = placed.withColumn("label", F.coalesce("label", _part(F.col("doc_id"), 1, shards))).withColumn("bucket", _part(F.col("uid"), 2, buckets))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "uid", "label", "single", "bucket"), "shard-placed")

    order = Window.partitionBy("label").orderBy("single", "bucket")
    sizes = placed.groupBy("label", "single", "bucket").agg(F.count("*").alias("c"))
    offsets = sizes.withColumn("offset", F.sum("c").over(order) - F.col("c")).drop("c")
    offsets = materialize(offsets, "shard-offsets")
    # one row a shard comes to the driver: what each has, may have, and where its surplus goes
    load = dict.fromkeys(range(shards), 0) | {r["label"]: r["load"] for r in sizes.groupBy("label").agg(F.sum("c").alias("load")).collect()}
    surplus, gap_from, over_from, gaps = 0, 0, [], []
    quotas = [quota + (s < more) for s in range(shards)]
    for s in range(shards):
        over_from.append(surplus)
        surplus += max(0, load[s] - quotas[s])
        if load[s] < quotas[s]:
            gaps.append((gap_from, quotas[s] - load[s], s, load[s]))
            gap_from += quotas[s] - load[s]
    of_shard = lambda values: F.array(*map(F.lit, values))[F.col("label")].cast("long")

    inner = Window.partitionBy("label", "single", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("row", F.row_number().over(inner) - 1).join(F.broadcast(offsets) if buckets * shards * 2 <= 200_000 else offsets, ["label", "single", "bucket"]).withColumn("p", F.col("offset") + F.col("row"))
    numbered = numbered.withColumn("extra", F.when(F.col("p") >= of_shard(quotas), of_shard(over_from) + F.col("p") - of_shard(quotas)))
    target = F.lit(None).cast("struct<start:bigint,to:int,load:bigint>")
    for start, width, to, held in gaps:
        inside = (F.col("extra") >= start) & (F.col("extra") < start + width)
        target = F.when(inside, F.struct(F.lit(start).cast("long").alias("start"), F.lit(to).alias("to"), F.lit(held).cast("long").alias("load"))).otherwise(target)
    out = numbered.withColumn("__to", target)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.coalesce("__to.to", "label").alias("shard"), F.coalesce(F.col("__to.load") + F.col("extra") - F.col("__to.start"), "p").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
