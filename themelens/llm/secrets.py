"""Secret scans by grammar inference.

1. Base rules find assignments, access keys and long hex runs, with positions. They are always reported.
2. The values they find are labelled credentials. Every distinct value of a kind, whole, is counted in a prefix tree
   of character classes. Prefixes of up to ``DEPTH`` classes that one in ``SHARE`` values
   has are states; what follows others is counted at the root, where their few values would be merged. States whose
   transition and ending rates, and those of all tree states behind them, agree within the Hoeffding bound are merged
   (ALERGIA). That gives one probabilistic automaton per kind, whose rates are those of all its values, walked whole. A background automaton is learnt the same way from all
   occurrences of runs outside base spans.
3. Every maximal run of ``FLOOR`` or more credential characters (the floor and the characters of the assign
   rule) in every text, outside base spans, is a candidate. Its score is the best automaton's log likelihood per
   character, less the background's. Candidates that score above the weakest ``QUANTILE`` of all labelled
   credentials, above all but ``FALSE_RATE`` of all background runs, and above zero are added as kind
   ``inferred``. So where credentials look like words, words are left alone.

The base scan and the positions are Spark SQL functions. Texts are read three times, in Arrow batches: runs are
counted, scored for the least score, and scored again for the result; all candidates of a slice step through the
automata together, one character at a time. Spark adds up the counts, and the scores by their value to three digits. The automata are broadcast; ``SHARE`` and ``DEPTH`` bound their size, whatever the number of values. The
shuffles are those of the distinct values, the counts and the scores.

Defined cases: null text is empty. Kinds without labelled values have no automaton; without any automaton
nothing is added. Ids, repeated rows and extra columns are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.llm import spans as S
from themelens.llm import words as W
from themelens.session import stage

# The base rules. Letters of the keywords in either case (ASCII).
PATTERNS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{24,}+",
}
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
KINDS = ("assign", "access", "hex")
FLOOR = 6                   # characters of a candidate, as of an assigned value
DEPTH = 18                  # classes of the longest prefix that is a state; 3 bits each
SHARE = 500                 # a prefix is a state if one in so many values has it
ALPHA = 0.05                # of the Hoeffding test
QUANTILE = 0.02
FALSE_RATE = 0.01           # of background runs, some of which are credentials that nobody labelled
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/", "-_", "=", ".")
_CLASS = {c: k for k, cs in enumerate(CLASSES) for c in cs}
END = -1
_END = 8                    # END in packed counts


class Automaton:
    """A probabilistic automaton over character classes, inferred by merging states of a prefix tree."""

    def __init__(self, values: Iterable[str] = (), counts: Iterable[tuple[int, int, int]] | None = None):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [defaultdict(int)]
        if counts is not None:
            self._read(counts)
        for value in values:
            s = 0
            for c in value:
                a = _CLASS.get(c, len(CLASSES))
                self.count[s][a] += 1
                if a not in self.next[s]:
                    self.next[s][a] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                s = self.next[s][a]
            self.count[s][END] += 1
        self._merge_states()

    def _read(self, counts: Iterable[tuple[int, int, int]]) -> None:
        """The prefix tree of ``state_counts``. A class that leaves the tree leads back to the root."""
        counts = sorted(counts)
        at = {state: i for i, state in enumerate(dict.fromkeys(s for s, _, _ in counts))}      # the root, 1, is the first
        self.next, self.count = [{} for _ in at], [defaultdict(int) for _ in at]
        for state, a, n in counts:
            self.count[at[state]][END if a == _END else a] += n
            if a != _END:
                self.next[at[state]][a] = at.get((state << 3) | a, 0)

    def _alike(self, p: int, q: int) -> bool:
        """Whether two states, and the tree states behind them, agree within the Hoeffding bound."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = sum(self.count[p].values()), sum(self.count[q].values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for a in {*self.count[p], *self.count[q]}:
                if abs(self.count[p].get(a, 0) / n - self.count[q].get(a, 0) / m) > bound:
                    return False
                # the tree below q ends, or leads back to the root, so this does
                if a in self.next[p] and a in self.next[q] and self.next[q][a]:
                    todo.append((self.next[p][a], self.next[q][a]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red``."""
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            for a, n in self.count[q].items():
                self.count[p][a] += n
            for a, child in self.next[q].items():
                if a in self.next[p]:
                    if child:
                        todo.append((self.next[p][a], child))
                else:
                    self.next[p][a] = child

    def _merge_states(self) -> None:
        red, known = [0], {0}
        while True:
            edge = next(((r, b) for r in red for b in sorted(self.next[r]) if self.next[r][b] not in known), None)
            if edge is None:
                break
            p, a = edge
            q = self.next[p][a]
            for r in red:
                if self._alike(r, q):
                    self.next[p][a] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
                known.add(q)
        self.states = red
        self._tabulate()

    def _tabulate(self) -> None:
        """Arrays of the next state and of log probabilities by state and class; the last state is that of
        characters never seen."""
        at, k = {s: i for i, s in enumerate(self.states)}, len(CLASSES)
        sink = len(at)
        self.step = np.full((sink + 1, k), sink, np.int32)
        for s, i in at.items():
            for a, q in self.next[s].items():
                self.step[i, a] = at[q]
        self.weigh(np.array([[self.count[s].get(a, 0) if s is not None else 0 for a in (*range(k), END)] for s in [*at, None]]))

    def weigh(self, seen: np.ndarray) -> None:
        """Log probabilities from the counts of classes and ends by state."""
        width = np.array([len(c) for c in CLASSES] + [1])
        self.log = np.log((seen + 0.1) / (seen.sum(axis=1, keepdims=True) + 0.1 * (len(CLASSES) + 2)) / width)

    def walk(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How often runs, in any order, meet each class or end in each state."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, width = starts[order], sizes[order], len(CLASSES) + 1
        state, seen = np.zeros(len(starts), np.int64), np.zeros(len(self.log) * width, np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -t, side="left"))
            c = classes[starts[:m] + t]
            seen += np.bincount(state[:m] * width + c, minlength=len(seen))
            state[:m] = self.step[state[:m], c]
        seen += np.bincount(state * width + len(CLASSES), minlength=len(seen))
        return seen.reshape(-1, width)

    def score_all(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``per_character`` of many runs of a class array; ``sizes`` fall, so those still running come first."""
        state, total = np.zeros(len(starts), np.int32), np.zeros(len(starts))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -t, side="left"))          # runs longer than t
            c = classes[starts[:m] + t]
            total[:m] += self.log[state[:m], c]
            state[:m] = self.step[state[:m], c]
        return (total + self.log[state, -1]) / (sizes + 1)

    def per_character(self, value: str) -> float:
        """Mean log likelihood of the characters and the end, characters of a class being equally likely."""
        classes = np.array([_CLASS[c] for c in value], np.int64)
        return float(self.score_all(classes, np.zeros(1, np.int64), np.array([len(value)]))[0])


class Grammar:
    """Automata by kind, the background, and the least score of a credential."""

    def __init__(self, automata: dict[str, Automaton], background: Automaton | None, least: float = 0.0):
        self.automata, self.background, self.least = automata, background or None, least

    def score_all(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of runs in any order."""
        order = np.argsort(-sizes, kind="stable")
        out = np.full(len(starts), -math.inf)
        for automaton in self.automata.values():
            out[order] = np.maximum(out[order], automaton.score_all(classes, starts[order], sizes[order]))
        if self.background is None:
            return out + math.log(64)
        out[order] -= self.background.score_all(classes, starts[order], sizes[order])
        return out

    def score(self, value: str) -> float:
        classes = np.array([_CLASS[c] for c in value], np.int64)
        return float(self.score_all(classes, np.zeros(1, np.int64), np.array([len(value)]))[0])


def base_spans(text: Column, kind: str) -> Column:
    """Confirmed base spans of one kind."""
    need = "AKIA" if kind == "access" else None
    text = F.when(F.contains(text, F.lit(need)), text).otherwise("") if need else text
    found = S.find(text, PATTERNS[kind])
    if kind == "assign":
        return F.filter(found, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= 6)
    return F.filter(found, lambda s: F.length(s["match"]) >= {"access": 20, "hex": 24}[kind])


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, assign, access, hex)``: base spans by kind as ``array<struct<start, match, end>>``."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def spans(kind: str) -> Column:
        return F.transform(base_spans(text, kind), lambda s: F.struct(
            s["start"].alias("start"), s["match"].alias("match"), (s["start"] + F.length(s["match"])).alias("end")))

    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[spans(k).alias(k) for k in KINDS])


_CHARS = {ord(c) for cs in CLASSES for c in cs}
RUNS = W.WordClass(set(range(256)) - _CHARS, lower=False)
_BYTE_CLASS = np.array([_CLASS.get(chr(b), 0) for b in range(256)], np.int8)


def candidate_runs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a slice of ``find_base``: its bytes, the byte starts and ends of the candidates, their rows, and the code
    point in its row at which each starts."""
    data, offsets = W.text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, _ = W.word_spans(data, offsets, RUNS)
    long = ends - starts >= FLOOR
    starts, ends = starts[long], ends[long]
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])        # code points before each byte
    covered = np.zeros(int(point[-1]) + 2, np.int64)
    for kind in KINDS:
        column = batch.column(batch.schema.get_field_index(kind))
        first = point[offsets[:-1]].repeat(np.diff(column.offsets.to_numpy()))
        flat = column.flatten()
        np.add.at(covered, first + flat.field("start").to_numpy(), 1)
        np.add.at(covered, first + flat.field("end").to_numpy(), -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
    free = inside[point[ends]] == inside[point[starts]]
    starts, ends = starts[free], ends[free]
    row = np.searchsorted(offsets, starts, side="right") - 1
    return data, starts, ends, row, point[starts] - point[offsets[row]]


def packed_counts(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a class, or the end, follows a prefix in some runs: ``(prefix << 4 | class)`` for prefixes of up to
    ``DEPTH`` classes (3 bits a class behind a leading 1; 0 for later places), and the counts."""
    classes = np.append(classes, 0).astype(np.int64)
    code, lengths = np.ones(len(starts), np.int64), np.minimum(sizes, DEPTH + 1)
    for d in range(DEPTH + 1):
        more = lengths > d
        code[more] = (code[more] << 3) | classes[starts[more] + d]
    heads, first, n = np.unique(code, return_index=True, return_counts=True)
    lengths, keys, weights = lengths[first], [], []
    for d in range(DEPTH + 1):
        here = lengths >= d
        h, left = heads[here], 3 * (lengths[here] - d)
        follows = np.where(left > 0, (h >> np.maximum(left - 3, 0)) & 7, _END)
        keys.append(((h >> left) << 4) | follows)
        weights.append(n[here])
    long = sizes > DEPTH
    places = sizes[long] - DEPTH                                        # from DEPTH + 1 to the end
    ends = np.cumsum(places)
    at = np.arange(int(places.sum())) - np.repeat(ends - places - starts[long] - DEPTH - 1, places)
    follows = classes[at]
    follows[ends - 1] = _END
    late = np.bincount(follows, minlength=1)
    keys.append(np.flatnonzero(late))
    weights.append(late[late > 0])
    out, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return out, np.bincount(inverse, np.concatenate(weights), len(out)).astype(np.int64)


_COUNTED = "kind string, value string, key long, n long"


def _count_rows(kind: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(keys), pa.string()), pa.nulls(len(keys), pa.string()),
         pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["kind", "value", "key", "n"])


def _counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled values, and the packed counts of the other runs."""
    for batch in batches:
        for piece in W.slices(batch, "text", 2 << 20):
            kinds, values = [], []
            for kind in KINDS:
                for match in piece.column(piece.schema.get_field_index(kind)).flatten().field("match").to_pylist():
                    kinds.append(kind)
                    values.append(re.match(ASSIGN_VALUE, match)[1] if kind == "assign" else match)
            none = pa.nulls(len(kinds), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), none, none],
                                             ["kind", "value", "key", "n"])
            data, starts, ends, _, _ = candidate_runs(piece)
            yield _count_rows("word", *packed_counts(_BYTE_CLASS[data], starts, ends - starts))


def _value_runs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Classes, starts and sizes of whole values."""
    data, offsets = W.text_bytes(batch.column(batch.schema.get_field_index("value")))
    return _BYTE_CLASS[data], offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def _counted_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of labelled values."""
    for batch in batches:
        for piece in W.slices(batch, "value", 2 << 20):
            classes, starts, sizes = _value_runs(piece)
            kinds = np.array(piece.column(piece.schema.get_field_index("kind")).to_pylist())
            for kind in KINDS:
                yield _count_rows(kind, *packed_counts(classes, starts[kinds == kind], sizes[kinds == kind]))


def state_counts(packed: DataFrame) -> DataFrame:
    """``(kind, state, follows, n)`` from packed counts: prefixes that one in ``SHARE`` values has are states, what follows
    others adds to the root, 1."""
    packed = packed.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(
        "kind", F.shiftright("key", 4).alias("state"), F.col("key").bitwiseAND(15).alias("follows"), "n")
    states = stage(packed.groupBy("kind", "state").agg(
        F.sum("n").alias("seen"), F.collect_list(F.struct("follows", "n")).alias("f")), "secret-states")    # at most nine each
    totals = states.where("state = 1").select("kind", F.col("seen").alias("total"))     # one row a kind
    own = (F.col("state") > 0) & (F.col("seen") * SHARE >= F.col("total"))
    return (states.join(F.broadcast(totals), "kind").select("kind", F.when(own, F.col("state")).otherwise(1).alias("state"), F.inline("f"))
            .groupBy("kind", "state", "follows").agg(F.sum("n").alias("n")))


def _walks(shared: Broadcast):
    """How often the labelled values of a kind meet a class or the end in each state of its automaton."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        for batch in batches:
            for piece in W.slices(batch, "value", 2 << 20):
                classes, starts, sizes = _value_runs(piece)
                kinds = np.array(piece.column(piece.schema.get_field_index("kind")).to_pylist())
                for kind, automaton in automata.items():
                    seen = automaton.walk(classes, starts[kinds == kind], sizes[kinds == kind])
                    state, follows = np.nonzero(seen)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(state), pa.string()), pa.array(state, pa.int64()), pa.array(follows, pa.int64()),
                                                      pa.array(seen[state, follows], pa.int64())], ["kind", "state", "follows", "n"])

    return run


def _histogram(kind: str, score: np.ndarray) -> pa.RecordBatch:
    bins, n = np.unique(np.round(score * 1000).astype(np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(bins), pa.string()), pa.array(bins, pa.int64()), pa.array(n, pa.int64())],
                                      ["kind", "score", "n"])


def _scores(shared: Broadcast, values: bool):
    """How often labelled values, or other runs, get each score in thousandths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            for piece in W.slices(batch, "value" if values else "text", 2 << 20):
                if values:
                    yield _histogram("value", grammar.score_all(*_value_runs(piece)))
                else:
                    data, starts, ends, _, _ = candidate_runs(piece)
                    yield _histogram("word", grammar.score_all(_BYTE_CLASS[data], starts, ends - starts))

    return run


def weighted_quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    """``np.quantile`` of sorted ``values``, each repeated ``n`` times."""
    upto = np.cumsum(n)
    place = q * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, i, side="right")] for i in (math.floor(place), math.ceil(place)))
    return float(low + (high - low) * (place - math.floor(place)))


def infer(base: DataFrame) -> Grammar:
    """The automata and the least score, from all labelled values and all other runs."""
    spark, base = base.sparkSession, base.drop("doc_id")
    rows = stage(base.mapInArrow(_counted_runs, _COUNTED), "secret-counts")
    values = stage(rows.where(F.col("value").isNotNull()).select("kind", "value").distinct(), "secret-values")
    packed = rows.where(F.col("value").isNull()).unionByName(values.mapInArrow(_counted_values, _COUNTED))
    counts: dict[str, list] = defaultdict(list)
    for r in state_counts(packed.drop("value")).collect():      # at most SHARE states for each length
        counts[r["kind"]].append((r["state"], r["follows"], r["n"]))
    automata = {k: Automaton(counts=counts[k]) for k in KINDS if k in counts}
    shared = spark.sparkContext.broadcast(automata)
    walked = values.mapInArrow(_walks(shared), "kind string, state long, follows long, n long").groupBy(
        "kind", "state", "follows").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    for kind, automaton in automata.items():
        seen = np.zeros_like(automaton.log)
        for r in walked:
            if r["kind"] == kind:
                seen[r["state"], r["follows"]] = r["n"]
        automaton.weigh(seen)
    grammar = Grammar(automata, Automaton(counts=counts["word"]) if "word" in counts else None)
    if not automata:
        return grammar
    shared = spark.sparkContext.broadcast(grammar)
    schema = "kind string, score long, n long"
    scores = (values.select("value").distinct().mapInArrow(_scores(shared, True), schema)
              .unionByName(base.mapInArrow(_scores(shared, False), schema))
              .groupBy("kind", "score").agg(F.sum("n").alias("n")).orderBy("score").collect())   # thousandths of a bounded range
    shared.unpersist()
    for kind, q in (("value", QUANTILE), ("word", 1 - FALSE_RATE)):
        of = [(r["score"], r["n"]) for r in scores if r["kind"] == kind]
        if of:
            x, n = np.array(of).T
            grammar.least = max(grammar.least, weighted_quantile(x / 1000, n, q))
    return grammar


def _scored(shared: Broadcast):
    """``find_base`` without the text, and the candidates above the least score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            for piece in W.slices(batch, "text", 2 << 20):
                data, starts, ends, row, at = candidate_runs(piece)
                if grammar.automata:
                    score = np.round(grammar.score_all(_BYTE_CLASS[data], starts, ends - starts), 4)
                    hit = np.flatnonzero(score > grammar.least)
                else:
                    score, hit = np.zeros(0), np.zeros(0, np.int64)
                found = pa.StructArray.from_arrays(
                    [pa.array(at[hit], pa.int32()), pa.array([data[starts[i]:ends[i]].tobytes().decode() for i in hit], pa.string()),
                     pa.array(score[hit], pa.float64())], ["start", "match", "score"])
                cuts = pa.array(np.searchsorted(row[hit], np.arange(len(piece) + 1)), pa.int32())
                keep = [i for i, name in enumerate(piece.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in keep], pa.ListArray.from_arrays(cuts, found)],
                                                 [*[piece.schema.names[i] for i in keep], "inferred"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base spans by kind, and ``inferred``: ``array<struct<start, match, score>>``."""
    base = find_base(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(infer(base))
    kinds = dict(base.dtypes)
    return base.mapInArrow(_scored(shared), f"doc_id {kinds['doc_id']}, " + ", ".join(f"{k} {kinds[k]}" for k in KINDS)
                           + ", inferred array<struct<start:int,match:string,score:double>>")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans, by start, then kind as listed."""
    found = scan_secrets(docs)

    def ordered(kinds: tuple[str, ...]) -> Column:
        every = F.concat(*[_tagged(k, i) for i, k in enumerate(kinds)])
        return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(ordered(KINDS), 256).alias("base_sha256"), ordered((*KINDS, "inferred")).alias("spans"),
                        F.size("inferred").cast("long").alias("n_inferred"))


def _tagged(kind: str, rank: int) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + F.length(s["match"])).alias("end"),
        F.lit(kind).alias("kind")))
