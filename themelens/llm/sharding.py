"""Balanced label propagation: shards of equal row counts that keep linked documents together.

Documents that share a link key (here: equal texts) are linked. A shard is a label. In every round each
linked document looks at the labels of its neighbours, which arrive by a join with the counts of labels per
key, and wants the label with the highest count; moves into a shard are admitted, largest gain first, only
up to the shard's quota. Rounds go on until nothing moves. Documents without links are placed last and fill
every shard to its exact size.

Law: ``rows``. With N documents, shards 0 to ``N mod shards - 1`` hold one document more than the others.

Native: joins, grouped counts and windows over bounded groups. Counts per key have at most one row per shard.
Ranks are found in two steps (counts per hash bucket, then inside a bucket), so neither a hot key nor a
shard's rows meet in one task. Every round is written to the folder of ``spark.checkpoint.dir``.

Defined cases: null text has size 1, checksum of the empty text, and no links. Repeated rows are separate
documents that share their text. Null ids are allowed. A group of copies larger than a shard fills one shard
after another. Extra columns are ignored. An empty table gives an empty result; with fewer documents than
shards the last shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from themelens.session import stage

SHARDS = 8
MAX_ROUNDS = 12             # the result is valid after any round; a fixed point comes in a few
ROWS_PER_BUCKET = 20_000    # rows ranked in one group


def dense_rank_within(rows: DataFrame, group: list[str], order: Column, n_rows: int, name: str) -> DataFrame:
    """``rows`` plus ``name``: 0, 1, 2 ... inside each group, by ``order`` (a uniform double in [0, 1), ties
    by row id ``rid``). Rows are cut into ranges of the order; a range starts where the counts of those
    before it end, so each window sorts one range of one group only."""
    buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    cut = rows.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") * buckets).cast("int"))
    counts = cut.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Win.partitionBy(*group).orderBy("_b").rowsBetween(Win.unboundedPreceding, -1)
    starts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Win.partitionBy(*group, "_b").orderBy("_o", "rid")
    return (cut.withColumn("_k", F.row_number().over(inside)).join(F.broadcast(starts) if buckets <= 4096 else starts, [*group, "_b"])
            .withColumn(name, F.col("_from") + F.col("_k") - 1).drop("_o", "_b", "_k", "_from"))


def _unit(*cols: str | Column) -> Column:
    """A uniform double in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


def propagate(linked: DataFrame, quotas: list[int], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Labels of linked documents: ``linked`` is ``(rid, key)``, result ``(rid, key, label)``. No label gets
    more documents than its quota."""
    k = len(quotas)
    n = linked.count()
    if not n:
        return linked.withColumn("label", F.lit(0))
    shares = [0]
    for q in quotas:
        shares.append(shares[-1] + q)
    # start: ranked by hash and dealt out in proportion to the quotas, so none is exceeded
    start = dense_rank_within(linked.withColumn("_all", F.lit(0)), ["_all"], _unit("rid", F.lit(1)), n, "_r").drop("_all")
    at = F.floor(F.col("_r") * F.lit(shares[-1]) / F.lit(n))
    label = F.lit(k - 1)
    for s in range(k - 2, -1, -1):
        label = F.when(at < shares[s + 1], F.lit(s)).otherwise(label)
    now = stage(start.select("rid", "key", label.alias("label")), "labels")
    for _ in range(max_rounds):
        counts = now.groupBy("key", "label").agg(F.count("*").alias("n"))
        used = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}   # one per shard
        room = [max(0, quotas[s] - used.get(s, 0)) for s in range(k)]
        # neighbours by label, one row per key: an array of as many structs as there are shards
        near = counts.groupBy("key").agg(F.collect_list(F.struct("label", "n")).alias("near"))
        has_room = F.array(*[F.lit(r > 0) for r in room])
        # most neighbours; among equals a shard with room, then the lower one (all members agree on it)
        wish = F.array_max(F.transform(
            F.filter("near", lambda x: (x["label"] == F.col("label")) | has_room[x["label"]]),
            lambda x: F.struct(x["n"].alias("n"), has_room[x["label"]].alias("room"), (-x["label"]).alias("to"))))
        wants = now.join(near, "key").withColumn("_own", F.filter("near", lambda x: x["label"] == F.col("label"))[0]["n"])
        wants = wants.withColumn("_wish", wish).select(
            "rid", "key", "label", (-F.col("_wish.to")).alias("to"), (F.col("_wish.n") - F.col("_own")).alias("gain"))
        movers = wants.where(F.col("to") != F.col("label"))
        movers = stage(movers.select("rid", "key", "label", "to", "gain"), "movers")
        moved = movers.count()
        if not moved:
            break
        # largest groups first: the order is the gain, then the key, so copies are admitted together
        first = (F.lit(1.0) / (F.col("gain") + 1) + _unit("key", F.lit(2)) * 1e-7) / 1.01
        ranked = dense_rank_within(movers, ["to"], first, moved, "_rank")
        free = F.array(*[F.lit(r) for r in room])[F.col("to")]
        admitted = ranked.where(F.col("_rank") < free).select("rid", "to")
        now = stage(now.join(admitted, "rid", "left").select("rid", "key", F.coalesce("to", "label").alias("label")), "labels")
    return now


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.sha2(text, 256)).alias("key")), "rows")
    n = rows.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    many = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    linked = stage(rows.select("rid", "key").join(many, "key"), "linked")
    labels = propagate(linked, quotas)
    used = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}      # one per shard
    left = [quotas[s] - used.get(s, 0) for s in range(shards)]
    # the rest fills the shards to their exact sizes
    rest = rows.join(labels.select("rid", "label"), "rid", "left")
    free = dense_rank_within(rest.where("label is null").withColumn("_all", F.lit(0)), ["_all"], _unit("rid", F.lit(3)), n, "_r")
    place, upto = F.lit(shards - 1), sum(left)
    for s in range(shards - 1, -1, -1):
        place = F.when(F.col("_r") < upto, F.lit(s)).otherwise(place)
        upto -= left[s]
    placed = rest.where("label is not null").withColumn("shard", F.col("label")).drop("label").unionByName(
        free.withColumn("shard", place).drop("_all", "_r", "label"))
    placed = stage(placed.drop("key"), "placed")
    slots = dense_rank_within(placed, ["shard"], _unit("rid", F.lit(4)), n, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
