"""Exact duplicates through an extendible-hash index on shared files.

1. Every normalised text (A-Z folded, nothing else) gets a 64-bit key; keys and text sizes are written.
2. The directory. One bucket holds everything; while a bucket is overfull (more than ``BUCKET_BYTES`` of text
   and more than one key) the directory doubles and the bucket is split by the next bit of the key. The sizes
   of all prefixes come from one grouped roll-up, so a bucket's depth is the first at which it is not overfull.
   A bucket is a range of keys. A single key that alone overfills a bucket cannot be split: it gets overflow
   pages, over which its rows are dealt.
3. Owner tasks. Every row goes once, with its text, to the owner of its bucket and page. The owner chains the
   texts that share a key and compares their bytes (a grouped aggregate on key and text, without another
   shuffle). Pages of one key are merged by comparing bytes again, one text a page. The entries (key, digest,
   copies, row that stays) are written to the shared folder: that is the index.
4. Every row looks its entry up by key and digest, spread over the pages of a large group.

Native: DataFrame operations and SQL functions only. Capacity grows with the input beyond ``MAX_BUCKETS``, so the
directory has at most 8 * ``MAX_BUCKETS`` slots and the page table at most ``MAX_BUCKETS`` rows; both are broadcast.

Defined cases: null text counts as empty. Of equal texts the row with the largest id stays; null ids lose to any
id. Rows that repeat text and id are one row said twice: all are marked ``kept`` if their id is, and
``drop_exact_duplicates`` leaves one of them. Texts of any length are compared whole. Extra columns are ignored
(or kept, by ``drop_exact_duplicates``). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET_BYTES = 1 << 18      # text bytes of a bucket, for inputs of up to MAX_BUCKETS of them
MAX_BUCKETS = 1 << 16
SLACK = 3                   # the directory may double so often beyond even buckets


def folded(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """The 64-bit key of a normalised text."""
    return F.xxhash64(text)


def directory(per_key: DataFrame, capacity: int, depth: int) -> DataFrame:
    """``(slot, bucket, local_depth)`` for the slots, the first ``depth`` bits of a key. ``per_key`` is ``(key, bytes)``
    with one row per key. A prefix that is split has split prefixes before it, so the buckets are the children
    of split prefixes that are not split themselves."""
    slots = stage(per_key.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("slot")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("keys")), "slots")
    each = slots.select("bytes", "keys", F.posexplode(F.array(*[F.shiftright("slot", depth - d) for d in range(depth + 1)])).alias("d", "prefix"))
    sums = stage(each.groupBy("d", "prefix").agg(F.sum("bytes").alias("b"), F.sum("keys").alias("k")), "prefixes")
    full = (F.col("b") > capacity) & (F.col("k") > 1) & (F.col("d") < depth)
    split = sums.where(full).select((F.col("d") + 1).alias("d"), F.col("prefix").alias("parent"))
    buckets = sums.where(~full).withColumn("parent", F.shiftright("prefix", 1))
    buckets = buckets.where("d = 0").unionByName(buckets.join(split, ["d", "parent"], "left_semi").select(*buckets.columns))
    first = F.expr(f"shiftleft(prefix, {depth} - d)")
    covered = F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - d)") - 1)
    return stage(buckets.select(F.explode(covered).alias("slot"), first.alias("bucket"), F.col("d").alias("local_depth")), "directory")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``(rid, doc_id, keep_id, group_size, kept, text_sha256, bucket)``. ``rid`` numbers the rows of
    the written key table."""
    text = folded(F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", text_key(F.col("text")))
    size = (F.octet_length("text") + 1).cast("long")
    keys = stage(rows.select("rid", "doc_id", "key", size.alias("bytes"), F.sha2("text", 256).alias("text_sha256")), "keys")
    per_key = stage(keys.groupBy("key").agg(F.sum("bytes").alias("bytes")), "per-key")
    total = per_key.agg(F.sum("bytes")).first()[0] or 0
    capacity = max(BUCKET_BYTES, -(-total // MAX_BUCKETS))
    depth = (total // capacity).bit_length() + SLACK
    slots = F.broadcast(directory(per_key, capacity, depth))
    over = stage(per_key.where(F.col("bytes") > capacity).select(
        "key", F.ceil(F.col("bytes") / F.lit(capacity)).cast("int").alias("pages")), "pages")
    paged = F.broadcast(over)

    def page(df: DataFrame) -> DataFrame:
        pages = F.coalesce("pages", F.lit(1))
        return df.join(paged, "key", "left").withColumn("page", F.pmod(F.xxhash64("rid"), pages).cast("int")).withColumn("pages", pages)

    slot = F.shiftrightunsigned("key", 64 - depth)
    dealt = page(rows).withColumn("slot", slot).join(slots, "slot").select("bucket", "page", "pages", "key", "text", "doc_id")
    chained = dealt.repartition("bucket", "page").groupBy("bucket", "page", "pages", "key", "text").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    split = F.col("pages") > 1
    parts = stage(chained.select("bucket", "pages", "key", F.sha2("text", 256).alias("text_sha256"), "n", "keep_id",
                                 F.when(split, F.col("text")).alias("text")), "index-pages")
    merged = parts.where(split).groupBy("bucket", "pages", "key", "text", "text_sha256").agg(
        F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"))
    index = parts.where(~split).drop("text").unionByName(merged.drop("text"))
    entries = index.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).drop("pages")
    found = page(keys).drop("pages", "bytes").join(entries, ["key", "text_sha256", "page"])
    return found.select("rid", "doc_id", "keep_id", F.col("n").alias("group_size"),
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    tag = "_row"
    while tag in docs.columns:
        tag += "_"
    rows = stage(docs.withColumn(tag, F.monotonically_increasing_id()), "rows")
    groups = exact_duplicates(rows.select(F.struct(F.col(id_col).alias("id"), F.col(tag).alias("row")).alias("doc_id"),
                                          F.col(text_col).alias("text")))
    stay = groups.where("kept").select(F.col("doc_id.row").alias(tag))
    return rows.join(stay, tag, "left_semi").drop(tag)


def exact_duplicates_digest(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")
