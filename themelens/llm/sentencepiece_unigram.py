"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a SentencePiece model file. A text gets one space in front, and spaces are the
whitespace marker. Pieces hold the marker only at their beginning, so the best segmentation of a text is the
best segmentation of its units (some spaces and the characters up to the next space), and every distinct unit
of a chunk is segmented once: all units in lock-step, one position at a time, over the trie's two arrays.
Characters that no piece covers cost ``unknown`` and are written as byte pieces.

Decoding joins the bytes of the pieces and removes the space in front; it restores every text exactly, a
marker character in the text included (it is encoded as bytes).

Scores: a unigram file's own log scores, or, for a file of another kind (whose scores are ranks), the log of
a Zipf distribution over the ranks (``scores="zipf"``).

Each document is handled in one task without a shuffle; the trie (a few MB, fixed by the vocabulary) is
broadcast. Defined cases: null text has null ids and decodes to null; empty text has no ids. Very long texts
and units are handled whole. Repeated rows, null ids and extra columns pass through. Empty tables give empty
results. Ids of control pieces decode to nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from themelens.llm import words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
LONG_UNIT = 512             # bytes; longer units are segmented one by one
CHUNK_BYTES = 2 << 20
_UNITS = W.WordClass(set(), lower=False, seed=3)


class Trie:
    """Double-array trie over bytes: the child of node s by byte c is ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values):
            s = 0
            for c in key:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    value.append(-1)
                s = children[s][c]
            value[s] = v
        # single children fill the gaps from the left; the others are placed from a moving start, because
        # trying every gap for them would cost the square of the trie
        size = 8 * len(children) + 4096
        base, check, values_ = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        place, queue, free, start = {0: 0}, [0], 1, 1
        while queue:
            node = queue.pop()
            s = place[node]
            values_[s] = value[node]
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:
                while taken[free] or free <= codes[0]:
                    free += 1
                b = free - codes[0]
            else:
                b = start
                while any(taken[b + c] for c in codes):
                    b += 1
                start = b
            base[s] = b
            for c in codes:
                taken[b + c] = 1
                check[b + c] = s
                place[children[node][c]] = b + c
                queue.append(children[node][c])
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, values_))
        self.depth = max((len(k) for k in keys), default=0)


class Vocabulary:
    """Trie, scores, bytes of every id, and the ids of the byte pieces."""

    def __init__(self, path: str = MODEL, scores: str = "zipf"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        self.score = np.zeros(n)
        keys, ids = [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unused(i) or model.is_unknown(i)):
                self.bytes[i] = piece.replace(MARKER, " ").encode()
                self.score[i] = model.get_score(i)
                if MARKER in piece.lstrip(MARKER):
                    raise ValueError("a piece holds the whitespace marker after other characters")
                keys.append(self.bytes[i])
                ids.append(i)
        if scores == "zipf":
            ranked = sorted(ids, key=lambda i: (-self.score[i], i))
            total = sum(1 / (r + 2.7) for r in range(len(ranked)))
            for r, i in enumerate(ranked):
                self.score[i] = -math.log((r + 2.7) * total)
        self.unknown = float(self.score[ids].min()) - 10.0
        self.trie = Trie(keys, ids)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])


def _lengths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins with each byte."""
    return np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def segment(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of the units ``data[starts:ends]``: flat ids and unit offsets. All units go forward
    together; at every position the trie is walked from all units that are still that long."""
    n, t = len(starts), v.trie
    order = np.argsort(starts - ends, kind="stable")            # longest first, so the live ones are a prefix
    begin, size = starts[order], (ends - starts)[order]
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]     # each unit's cells in the lattice
    best = np.full(int((size + 1).sum()), -np.inf)
    piece, back = np.full(len(best), -1, np.int32), np.zeros(len(best), np.int32)
    best[first] = 0.0
    for i in range(int(size.max(initial=0))):
        live = np.searchsorted(-size, -i, "left")               # units longer than i bytes
        unit = np.flatnonzero(best[first[:live] + i] > -np.inf)
        here = best[first[unit] + i]
        width = _lengths(data[begin[unit] + i])
        single = np.zeros(len(unit), bool)                      # a piece of just this character exists
        node, at, who = np.zeros(len(unit), np.int64), unit, np.arange(len(unit))
        for j in range(t.depth):
            inside = size[at] > i + j
            node, at, who = node[inside], at[inside], who[inside]
            step = t.base[node] + data[begin[at] + i + j]
            step = np.where(step < len(t.check), step, 0)
            ok = t.check[step] == node
            ok &= t.base[node] > 0
            node, at, who = step[ok].astype(np.int64), at[ok], who[ok]
            if not len(node):
                break
            full = np.flatnonzero(t.value[node] >= 0)
            if len(full):
                ids, cell = t.value[node[full]], first[at[full]] + i + j + 1
                new = here[who[full]] + v.score[ids]
                better = new > best[cell]
                cell = cell[better]
                best[cell], piece[cell], back[cell] = new[better], ids[better], i
                single[who[full]] |= width[who[full]] == j + 1
        lone = np.flatnonzero(~single)
        if len(lone):
            cell = first[unit[lone]] + np.minimum(i + width[lone], size[unit[lone]])
            new = here[lone] + v.unknown
            better = new > best[cell]
            cell = cell[better]
            best[cell], piece[cell], back[cell] = new[better], -1, i
    # walk back, all units together; ids of unit k are written from the right
    pos, out_n = size.copy(), np.zeros(n, np.int64)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        on = np.flatnonzero(pos > 0)
        if not len(on):
            break
        cell = first[on] + pos[on]
        steps.append((on, piece[cell], back[cell].astype(np.int64), pos[on].copy()))
        out_n[on] += np.where(piece[cell] >= 0, 1, pos[on] - back[cell])
        pos[on] = back[cell]
    count = np.zeros(n, np.int64)
    count[order] = out_n
    offsets = np.concatenate([[0], np.cumsum(count)])
    right = offsets[1:][order].copy()
    flat = np.zeros(int(offsets[-1]), np.int32)
    for on, ids, a, z in steps:
        known = ids >= 0
        right[on[known]] -= 1
        flat[right[on[known]]] = ids[known]
        for k in range(4):          # bytes of an unknown character, last one first
            some = np.flatnonzero(~known & (z - a > k))
            u = on[some]
            right[u] -= 1
            flat[right[u]] = v.byte_id[data[begin[u] + z[some] - 1 - k]]
    return flat, offsets


def segment_one(unit: bytes, v: Vocabulary) -> list[int]:
    """The same for one long unit, byte by byte."""
    t, n, score = v.trie, len(unit), v.score
    best, piece, back = [-math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == -math.inf:
            continue
        lead = unit[i]
        width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        node, single = 0, False
        for j in range(i, min(n, i + t.depth)):
            b = int(t.base[node])
            step = b + unit[j]
            if not b or step >= len(t.check) or t.check[step] != node:
                break
            node = step
            found = int(t.value[node])
            if found >= 0:
                if here + score[found] > best[j + 1]:
                    best[j + 1], piece[j + 1], back[j + 1] = here + float(score[found]), found, i
                single |= j + 1 - i == width
        if not single and here + v.unknown > best[min(n, i + width)]:
            z = min(n, i + width)
            best[z], piece[z], back[z] = here + v.unknown, -1, i
    out: list[int] = []
    while n:
        a = back[n]
        out += [piece[n]] if piece[n] >= 0 else [int(v.byte_id[c]) for c in reversed(unit[a:n])]
        n = a
    return out[::-1]


def segment_all(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``segment`` for short units, ``segment_one`` for the rest, in the order of the units."""
    long = np.flatnonzero(ends - starts > LONG_UNIT)
    if not len(long):
        return segment(data, starts, ends, v)
    short = np.flatnonzero(ends - starts <= LONG_UNIT)
    flat, at = segment(data, starts[short], ends[short], v)
    more = [segment_one(data[starts[k]:ends[k]].tobytes(), v) for k in long.tolist()]
    begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    begin[short], count[short] = at[:-1], np.diff(at)
    count[long] = [len(m) for m in more]
    begin[long] = len(flat) + np.concatenate([[0], np.cumsum(count[long])[:-1]])
    pool = np.concatenate([flat, *[np.array(m, np.int32) for m in more]])
    place = np.concatenate([[0], np.cumsum(count)])
    return pool[np.arange(int(place[-1])) - np.repeat(place[:-1] - begin, count)], place


def encode(col: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (flat) and row offsets."""
    raw, cut = W.text_bytes(col)
    rows = len(cut) - 1
    some = (np.diff(cut) > 0).astype(np.int64)
    offsets = cut + np.concatenate([[0], np.cumsum(some)])      # one space in front of each text
    data = np.full(int(offsets[-1]), 0x20, np.uint8)
    fill = np.ones(len(data), bool)
    fill[offsets[:-1][some > 0]] = False
    data[fill] = raw
    space = data == 0x20
    edge = space.copy()
    edge[1:] &= ~space[:-1]
    edge[offsets[:-1][some > 0]] = True                         # a unit begins at a text or a run of spaces
    starts = np.flatnonzero(edge)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    ends = np.append(starts[1:], len(data))
    names = W.word_hashes(data, starts, ends, _UNITS)
    _, one, which = np.unique(names, return_index=True, return_inverse=True)
    flat, at = segment_all(data, starts[one], ends[one], v)
    count = np.diff(at)[which]
    place = np.concatenate([[0], np.cumsum(count)])
    index = np.arange(int(place[-1])) - np.repeat(place[:-1] - at[which], count)
    return flat[index], place[np.searchsorted(starts, offsets)]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[str]:
    """The texts of rows of ids."""
    size = np.diff(v.at)[ids]
    place = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(int(place[-1])) - np.repeat(place[:-1] - v.at[ids], size)
    data, cut = v.flat[index].tobytes(), place[offsets].tolist()
    return [data[a:z].decode("utf-8", "replace")[1:] if data[a:a + 1] == b" " and z > a
            else data[a:z].decode("utf-8", "replace") for a, z in zip(cut[:-1], cut[1:])]


def _encode(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, batch.schema.names[at], CHUNK_BYTES):
                ids, offsets = encode(part.column(at), shared.value)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()),
                                                 mask=part.column(at).is_null() if part.column(at).null_count else None)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "_sp_ids"])

    return run


def _decode(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                lists = part.column(at)
                sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode(ids, np.concatenate([[0], np.cumsum(sizes)]), shared.value)
                null = lists.is_null().to_pylist()
                texts = pa.array([None if x else t for t, x in zip(texts, null)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "_sp_text"])

    return run


def _round_trip(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in W.slices(batch, "text", CHUNK_BYTES):
                ids, offsets = encode(part.column(1), v)
                null = part.column(1).is_null()
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()),
                                                 mask=null if part.column(1).null_count else None)
                digests, same = [], []
                for k, (text, gone) in enumerate(zip(part.column(1), null.to_pylist())):
                    back = None if gone else decode(ids[offsets[k]:offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), v)[0]
                    same.append(back == text.as_py())
                    digests.append(None if gone else hashlib.sha256(back.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "decoded_sha256", "round_trip"])

    return run


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded_sha256, round_trip)``: every text encoded, its ids decoded again, and whether
    that restores the text. One pass, one Python worker per task, and the decoded text stays in it."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_round_trip(shared), f"doc_id {kind}, ids array<int>, decoded_sha256 string, round_trip boolean")


def _map(docs: DataFrame, run, name: str, kind: T.DataType, alias: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    out = docs.mapInArrow(run, schema)
    return out.withColumnRenamed(name, alias)


def encode_column(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` plus the ids of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return _map(docs, _encode(shared, docs.columns.index(text_col)), "_sp_ids", T.ArrayType(T.IntegerType()), out_col)


def decode_column(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` plus the text of an ids column."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return _map(docs, _decode(shared, docs.columns.index(ids_col)), "_sp_text", T.StringType(), out_col)
