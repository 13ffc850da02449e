"""Sharding by balanced label propagation, in DataFrame functions only.

Documents that are linked (in the query: equal texts) should share a shard, while the
counts of any two shards differ by one at most (law ``rows``). Links are a bipartite
table of documents and hubs, so a group of n copies has n links, not n squared. A
hub of more documents than a shard's quota is split first by a hash of the document,
so that no hub needs more room than a shard has. Large hubs, or their parts, are
placed first, whole and in order of size, each in the shard with the most room.

Each round, a hub counts its documents by shard and asks those elsewhere to come to
its most frequent shard. A shard takes requests up to its quota: hubs are put into
buckets by hash, bucket sizes are summed up in order, and the buckets that fit move.
When the rounds are over, documents without links, and those of overfull shards,
fill the free places by their rank. Ranks come from counts by bucket and a rank
within the bucket, never from one task that sees a whole shard.

Defined results: a null text has size 1, crc32 of the empty text and is linked with
other null or empty texts. Repeated rows are documents of their own, told apart by
their place among equal ones. A null doc_id is a value like others. Empty tables give
empty results. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, sized, table

SHARDS, ROUNDS, BUCKETS = 16, 3, 256
#: A hub of more than this share of a shard's quota is large. There are at most SHARDS / HUB_SHARE of them.
HUB_SHARE = 0.05
#: A hub of more than one in so many documents is common; there are fewer than that.
COMMON = 1024


def ranked(df: DataFrame, group: str, rows: int, *order: str) -> DataFrame:
    """``df`` with rank (0 and up within group), by buckets of a hash of ``order`` and the order within them."""
    buckets = max(BUCKETS, rows // 20_000)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    placed = df.withColumn("_rank", inner).join(sized(starts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return placed.withColumn("rank", F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_rank", "_g", "_b", "_start")


def quotas(rows: int, shards: int) -> dict[int, int]:
    return {s: rows // shards + (s < rows % shards) for s in range(shards)}


def _quota(shard, rows: int, shards: int):
    return F.lit(rows // shards) + (shard < rows % shards).cast("int")


def propagate(nodes: DataFrame, rows: int, scratch: Scratch, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, hub, shard) of nodes(node, hub), linked documents only; no shard above its quota is asked for more."""
    sizes = scratch.save(nodes.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    most = max(1, rows // shards)
    # the documents of common hubs meet them where they are; no other hub has many
    common = F.broadcast(sizes.where(F.col("n") > rows / COMMON))  # fewer than COMMON rows, as the hubs' documents add up to ``rows``
    others = nodes.join(common.select("hub"), "hub", "left_anti").join(sizes.where(F.col("n") <= rows / COMMON), "hub")
    split = nodes.join(common, "hub").unionByName(others).withColumn("part", F.pmod(F.xxhash64("node", F.lit(8)), F.ceil(F.col("n") / most)))
    split = scratch.save(split.select("node", F.concat_ws("/", "hub", "part").alias("hub")), "hubs")
    room, placed = quotas(rows, shards), []
    large = split.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > most * HUB_SHARE).collect()
    for r in sorted(large, key=lambda r: (-r["n"], r["hub"])):
        to = max(room, key=lambda s: (room[s], -s))
        room[to] -= r["n"]
        placed.append((r["hub"], to))
    large = F.broadcast(nodes.sparkSession.createDataFrame(placed, "hub string, shard int"))
    fixed = scratch.save(split.join(large, "hub").select("node", "hub", "shard"), "linked_large")
    # the others start by hash, in proportion to the room that is left
    free = [max(0, n) for n in room.values()]
    at, start = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, sum(free)))), F.lit(shards - 1)
    for s in reversed(range(shards)):
        start = F.when(at < sum(free[: s + 1]), F.lit(s)).otherwise(start)
    state = scratch.save(split.join(large, "hub", "left_anti").select("node", "hub", start.cast("int").alias("shard")), "linked_0")
    for step in range(rounds):
        votes = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        best = votes.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "shard").alias("h"), "shard")).alias("m"), F.sum("n").alias("all"))
        wish = scratch.save(best.select("hub", F.col("m.shard").alias("to"), (F.col("all") - F.col("m.n")).alias("moving"), F.col("all"), F.pmod(F.xxhash64("hub", F.lit(2)), F.lit(BUCKETS)).alias("bucket")), f"wish_{step}")
        load = state.select("shard").unionByName(fixed.select("shard")).groupBy("shard").agg(F.count("*").alias("load"))
        per = wish.groupBy("to", "bucket").agg(F.sum("moving").alias("moving"))
        upto = Window.partitionBy("to").orderBy("bucket")  # at most BUCKETS rows for each shard
        fits = per.withColumn("sum", F.sum("moving").over(upto)).join(F.broadcast(load), F.col("to") == F.col("shard"), "left")  # load has a row for each shard
        taken = fits.where(F.col("sum") + F.coalesce("load", F.lit(0)) <= _quota(F.col("to"), rows, shards)).select("to", "bucket")
        moves = wish.join(F.broadcast(taken), ["to", "bucket"]).select("hub", "to")  # at most shards * BUCKETS rows
        state = scratch.save(state.join(moves, "hub", "left").select("node", "hub", F.coalesce("to", "shard").alias("shard")), f"linked_{step + 1}")
        scratch.drop(f"linked_{step}")
    return state.unionByName(fixed)


def shard(docs: DataFrame, scratch: Scratch, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("hub"))
    twin = F.row_number().over(Window.partitionBy("doc_id", "hub").orderBy("size")) if docs.groupBy("doc_id").count().where("count > 1").limit(1).count() else F.lit(1)
    base = scratch.save(base.withColumn("twin", twin).withColumn("node", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "hub", "twin")), "base")
    rows = base.count()
    linked = propagate(base.select("node", "hub"), rows, scratch, shards)
    # linked documents first, up to the quota; the others and what is over fill the free places
    over = ranked(linked, "shard", rows, "hub", "node").withColumn("stays", F.col("rank") < _quota(F.col("shard"), rows, shards))
    over = scratch.save(over.select("node", "shard", "stays"), "over")
    staying = over.where("stays").select("node", "shard")
    used = {r["shard"]: r["n"] for r in staying.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    free = base.select("node").join(staying, "node", "left_anti").withColumn("all", F.lit(0))
    filled, at = F.lit(None).cast("int"), 0
    bounds = []
    for s, quota in quotas(rows, shards).items():
        at += quota - used.get(s, 0)
        bounds.append((at, s))
    for end, s in reversed(bounds):
        filled = F.when(F.col("rank") < end, F.lit(s)).otherwise(filled)
    placed = staying.unionByName(ranked(free, "all", rows, "node").select("node", filled.alias("shard")))
    placed = scratch.save(base.join(placed, "node").select("node", "doc_id", "size", "text_crc32", "shard"), "placed")
    out = ranked(placed, "shard", rows, "node")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), Scratch(spark, "sharding"))
