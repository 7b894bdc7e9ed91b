"""MinHash near-duplicate detection with b-bit signatures.

1. Every text becomes a set of five-word shingles (64-bit hashes). Of 128 minima per set, 125 give 25 band
   keys of five full minima each; of every minimum only the low ``BITS`` bits are kept, packed.
2. Texts with equal sets are one node. Nodes that share a band key are candidates: two sets of similarity
   0.85 miss all 25 bands with probability (1 - 0.85 ** 5) ** 25, about 4e-7; two of 0.8 with 5e-5.
3. Inside a bucket the packed signatures are compared by bit counts. Two unequal minima agree in their low
   bits with probability 2 ** -BITS, so the similarity estimate is corrected for that. Pairs far below the
   threshold (by ``MARGIN`` standard deviations) are not looked at further.
4. First round: a bucket proposes few pairs, as many as it has nodes: each node with the most central node
   of its part of the bucket. Proposed pairs are confirmed on the full shingle sets.
5. Confirmed links give components. Second round: buckets whose nodes are still in different components are
   dealt out in blocks together with the full sets; all pairs across components are confirmed inside the
   block pair, and only true links leave it, at most one per pair of components. So no link between
   components is lost, and no list of pairs is ever written.

Blocks are bounded by nodes and by bytes, so a task holds two blocks at most, whatever share of the rows a
bucket has. Intermediate tables are written to the folder of ``spark.checkpoint.dir``.

Defined cases: null text and texts without words have an empty set, are linked with nothing and are their
own component. A text of one to four words has one shingle, its whole sequence. Repeated rows and ids: the
component id of a text is the smallest non-null doc_id of its component (its own id for an empty set); every
input row is returned. An empty table gives an empty result. ``drop_near_duplicates`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.llm import words as W
from themelens.llm.components import connected_components
from themelens.session import drop_staged, free_name, stage

SHINGLE = 5
HASHES, BANDS, ROWS, BITS = 128, 25, 5, 4
SIMILAR = 85                # per cent
MARGIN = 5.0                # standard deviations of the estimate
BLOCK = 512                 # nodes of a block
BLOCK_BYTES = 16 << 20      # bytes of sets of a block
CENTRES = 64                # nodes sampled to find the central one of a bucket

_A = W.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_B = W.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA5A3564E27F8862B))


_KEY = W.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """For each text of a column, its sorted distinct shingle hashes."""
    words, first = W.hashed_words(col, W.SPACED_LOWER)
    every = W.window_hashes(words, SHINGLE)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= SHINGLE:
            out.append(np.unique(every[a:z - SHINGLE + 1]))
        else:
            out.append(W.window_hashes(words[a:z], z - a, salt=z - a) if z > a else words[:0])
    return out


def node_of(sets: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    two = (W.mix(sets).sum(dtype=np.uint64), W.mix(sets + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64))
    return np.array([*two], np.uint64).tobytes()


def minima(sets: np.ndarray) -> np.ndarray:
    """128 minima of a non-empty set: the hashes are permuted by odd multipliers and an offset."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(sets), 512):       # blocks that stay in cache
        np.minimum(out, (sets[a:a + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def signatures(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima (one row each), packed into 64-bit words."""
    per = 64 // BITS
    bits = (W.mix(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), HASHES // per, per)
    return np.bitwise_or.reduce(bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band from its full minima; the band is part of the key."""
    parts = low[:, :BANDS * ROWS].reshape(len(low), BANDS, ROWS)
    return W.mix((parts * _KEY).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


_LOW = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates of all rows of ``a`` against all rows of ``b`` (packed signatures)."""
    unequal = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(1)      # the lowest bit of each four: whether any of them differs
        x |= x >> np.uint64(2)
        unequal += np.bitwise_count(x & _LOW)
    same, chance = 1.0 - unequal / HASHES, 2.0 ** -BITS
    return (same - chance) / (1 - chance)


def lowest_estimate(similar: int = SIMILAR) -> float:
    """Estimates below this are dropped: the threshold less ``MARGIN`` standard deviations."""
    j, chance = similar / 100, 2.0 ** -BITS
    p = j + (1 - j) * chance
    return j - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


# -- step 1: one row per document ------------------------------------------------------------------

SKETCH = "tkey long, node binary, n_shingles long, signature binary, bands array<long>, doc_id {id}"
_SKETCH = [("tkey", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.binary()),
           ("bands", pa.list_(pa.int64()))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            sets = shingle_sets(part.column(1))
            full = [i for i, s in enumerate(sets) if len(s)]
            low = np.array([minima(sets[i]) for i in full], np.uint64).reshape(len(full), HASHES)
            packed, keys = signatures(low), band_keys(low).view(np.int64).tolist()
            at = dict(zip(full, range(len(full))))
            cols = [part.column(0), [node_of(s) if len(s) else None for s in sets], [len(s) for s in sets],
                    [packed[at[i]].tobytes() if i in at else None for i in range(len(sets))],
                    [keys[at[i]] if i in at else None for i in range(len(sets))]]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, _SKETCH)]
            yield pa.RecordBatch.from_arrays([*arrays, part.column(2)], [*[n for n, _ in _SKETCH], "doc_id"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: a key of its text, its node (equal sets share it), signature and band keys."""
    rows = docs.select(F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_sketch, SKETCH.format(id=kind))


# -- step 2: proposals of the first round ------------------------------------------------------------

def _propose_group(nodes: np.ndarray, packed: np.ndarray, lo: float) -> list[tuple[bytes, bytes]]:
    """Pairs of one bucket (or block): every node with the most central node of those like it."""
    out, left = [], np.arange(len(nodes))
    while len(left) > 1:
        sample = left[:: max(1, len(left) // CENTRES)]
        near = similarity(packed[left], packed[sample])
        centre = left[int(np.argmax(near.sum(axis=1)))]
        to = similarity(packed[centre][None, :], packed[left])[0]
        close = (to >= lo) & (left != centre)
        out += [(nodes[centre], nodes[i]) for i in left[close].tolist()]
        left = left[~close & (left != centre)]
    return out


def _propose(lo: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None    # the last bucket of a batch may go on in the next one

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            key, block = rows["key"].to_numpy(), rows["block"].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            nodes = rows["node"].to_numpy()
            packed = np.frombuffer(b"".join(rows["signature"]), np.uint64).reshape(len(rows), -1)
            pairs: set[tuple[bytes, bytes]] = set()
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                pairs.update(_propose_group(nodes[a:z], packed[a:z], lo))
            return pd.DataFrame(sorted({(min(p), max(p)) for p in pairs}), columns=["a", "b"])

        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if not len(rows):
                continue
            tail = (rows["key"] == rows["key"].iloc[-1]) & (rows["block"] == rows["block"].iloc[-1])
            rest = rows[tail].reset_index(drop=True)
            if not tail.all():
                yield done(rows[~tail].reset_index(drop=True))
        if rest is not None and len(rest):
            yield done(rest)

    return run


def _spread(rows: DataFrame, n: int, *cols: str | Column) -> DataFrame:
    return rows.repartition(n, *cols)


# -- step 3: full sets, confirmation -------------------------------------------------------------------

def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            want = part.column(1).to_pylist()
            sets = shingle_sets(part.column(0))
            keep = [i for i, s in enumerate(sets) if len(s) and node_of(s) == want[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([want[i] for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                ["node", "items"])


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(node, items)``: the full sets of the wanted ``(tkey, node)``, once each."""
    rows = docs.select(F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    found = rows.join(wanted, "tkey").select("text", "node").mapInArrow(_with_sets, "node binary, items binary")
    return found.dropDuplicates(["node"])


def _similar(x: bytes, y: bytes, similar: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < similar * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similar * (len(a) + len(b) - both)


def _confirm(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = pa.array([_similar(p.as_buffer(), q.as_buffer(), similar) for p, q in zip(x, y)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    return run


# -- step 4: the second round ----------------------------------------------------------------------------

def _links_of_blocks(similar: int, lo: float):
    """True links between components inside one pair of blocks, at most one per pair of components."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        packed = np.frombuffer(b"".join(rows["signature"]), np.uint64).reshape(len(rows), -1)
        names, nodes = rows["component"].to_numpy(), rows["node"].to_numpy()
        _, comp = np.unique(names.astype("S16"), return_inverse=True)
        parent = np.arange(comp.max() + 1)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        items = [np.frombuffer(b, np.uint64) for b in rows["items"]]
        sizes = np.array([len(s) for s in items])
        _, ids = np.unique(np.concatenate(items), return_inverse=True)
        part = np.concatenate([[0], np.cumsum(sizes)])
        theirs = np.concatenate([ids[part[k]:part[k + 1]] for k in right]) if len(right) else ids[:0]
        at = np.concatenate([[0], np.cumsum(sizes[right])[:-1]]).astype(np.int64)
        flag, out = np.zeros(len(ids) + 1, np.int32), []
        for x in left.tolist():
            near = similarity(packed[x][None, :], packed[right])[0] >= lo
            near &= comp[right] != comp[x]
            if i == j:
                near &= right > x
            if not near.any():
                continue
            mine = ids[part[x]:part[x + 1]]
            flag[mine] = 1
            both = np.add.reduceat(flag[theirs], at)
            flag[mine] = 0
            true = near & (100 * both >= similar * (sizes[x] + sizes[right] - both))
            for y in right[true].tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    parent[p] = q
                    out.append((nodes[x], nodes[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def open_pairs(named: DataFrame, signatures: DataFrame, sets: DataFrame, block: int = BLOCK,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of buckets that hold several components, dealt to pairs of blocks ``i`` <= ``j``.

    ``named``: ``key``, ``node``, ``component``. Two members of one component need no comparison, so only the rows
    outside a bucket's largest component meet all of it: they make the first blocks, and a row of the largest
    component goes to each of those once. A bucket of m copies and a few others sends about m rows."""
    counts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("k"))
    main = main.where("k > 1").select("key", F.col("top.component").alias("main"))
    rows = named.join(main, "key").withColumn("minor", F.col("component") != F.col("main"))
    rows = rows.join(signatures, "node").join(sets, "node")
    weight = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.length("items")) / block_bytes)).alias("blocks")
    per_side = rows.groupBy("key", "minor").agg(weight)
    sides = per_side.groupBy("key").agg(F.max(F.when(F.col("minor"), F.col("blocks"))).cast("int").alias("few"),
                                        F.max(F.when(~F.col("minor"), F.col("blocks"))).cast("int").alias("many"))
    own = F.xxhash64("node")
    rows = rows.join(sides, "key").withColumn("block", F.when(F.col("minor"), F.pmod(own, F.col("few"))).otherwise(
        F.col("few") + F.pmod(own, F.col("many"))).cast("int"))
    last = F.col("few") + F.when(F.col("minor"), F.col("many")).otherwise(0) - 1
    return rows.select("key", "node", "component", "signature", "items", "block", F.explode(
        F.sequence(F.lit(0), last.cast("int"))).alias("other")).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "component", "signature", "items")


# -- the operator ------------------------------------------------------------------------------------------

def node_components(docs: DataFrame, staged: DataFrame, text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """``(node, component)`` of all nodes that have a confirmed link."""
    lo = lowest_estimate(similar)
    n = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = staged.where("node is not null").groupBy("node").agg(
        F.min("tkey").alias("tkey"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    nodes = stage(nodes, "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = stage(rows.join(shared, "key"), "buckets")

    # first round
    blocks = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)).cast("int")
    signed = buckets.join(nodes.select("node", "signature"), "node").withColumn("block", blocks)
    dealt = _spread(signed.select("key", "block", "node", "signature"), n, "key", "block").sortWithinPartitions("key", "block")
    pairs = stage(dealt.mapInPandas(_propose(lo), "a binary, b binary").distinct(), "pairs")
    ends = (pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
            .unionByName(buckets.where("m > 2").select("node")).distinct())
    sets = stage(_sets(docs, text_col, nodes.select("tkey", "node").join(ends, "node", "left_semi")), "sets")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y"))
    links = stage(both.mapInArrow(_confirm(similar), "a binary, b binary"), "links")
    known = stage(connected_components(links), "components")

    # second round: buckets of three or more nodes in several components (of two, the pair was proposed)
    named = buckets.where("m > 2").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = open_pairs(named, nodes.select("node", "signature"), sets, BLOCK, BLOCK_BYTES)
    late = dealt.groupBy("key", "i", "j").applyInPandas(_links_of_blocks(similar, lo), "a binary, b binary")
    late = stage(late, "late-links")
    drop_staged(staged.sparkSession, nodes, buckets, pairs, sets, links)
    late = late.join(known.select(F.col("node").alias("a"), F.col("component").alias("p")), "a", "left").join(
        known.select(F.col("node").alias("b"), F.col("component").alias("q")), "b", "left").select(
        F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")).distinct()
    joined = stage(connected_components(late).select(F.col("node").alias("component"), F.col("component").alias("root")), "merged")
    singles = joined.join(known.select("component").distinct(), "component", "left_anti").select(
        F.col("component").alias("node"), F.col("root").alias("component"))
    return known.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component")) \
        .unionByName(singles)


def _labelled(docs: DataFrame, id_col: str, text_col: str, similar: int) -> DataFrame:
    """For every row: text key, doc_id, set size and ``best``, the first document of its component."""
    staged = stage(sketches(docs, id_col, text_col), "sketches")
    comps = node_components(docs, staged, text_col, similar)
    # smallest id first, null ids last; then the text key: grouped minima of small rows
    own = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id"), F.col("tkey"))
    rows = staged.select("node", "tkey", "doc_id", "n_shingles", own.alias("own"))
    least = rows.where("node is not null").groupBy("node").agg(F.min("own").alias("least"))
    least = least.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = least.groupBy("component").agg(F.min("least").alias("best"))
    best = stage(least.join(best, "component").select("node", "best"), "component-ids")
    return rows.join(best, "node", "left").withColumn("best", F.coalesce("best", "own"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``."""
    return _labelled(docs, id_col, text_col, similar).select(
        "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("best.doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one document of each component: the smallest id. Rows that repeat both id and text are
    one document."""
    found = _labelled(docs, id_col, text_col, similar).where("own = best")
    name = free_name(docs, "_own")
    keep = found.select(F.struct("own.no_id", "doc_id", "tkey").alias(name)).distinct()
    own = F.struct(F.isnull(id_col).alias("no_id"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tkey"))
    return docs.withColumn(name, own).join(keep, name, "left_semi").dropDuplicates([name]).drop(name)
