"""N-gram Jaccard join (operator 1).

Texts become sets of distinct five-word shingles, and equal sets one node. Shingles are
ordered rare first by a count sketch over all documents, whose size follows the input up to
a bound (any common order is right; a rare-first one makes short posting lists). Nodes meet on the shingles of their
prefixes; the length, positional and suffix filters drop what can't reach the
similarity; what is left is verified once on the whole sets.

A group of near copies is not expanded into its pairs: each node is first verified
against the leader that it meets most often, the verified links are joined to components,
and only then pairs that meet but lie in different components are verified, all of them.
Within a component no further pair can change the result, so no link is lost.

Defined cases: null text, or one without words, has an empty set that links with nothing
and is its own component; fewer than five words are one shingle; repeated rows fall in
one node; a null id can't name a component; an empty table gives an empty result; other
columns are ignored. Nodes are 64-bit digests of sets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textbuf
from spanloom.llm.components import components
from spanloom.llm.shared import SLICE, Workspace, documents, merged_array

#: Least and most counters of the count sketch; between them one for SHARE bytes of input.
SKETCH, MOST, SHARE = 1 << 18, 1 << 22, 1 << 10
BLOOM = 1 << 22
LEADERS = 8
_ONE = np.uint64(1)


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    total = np.add.reduce(textbuf.mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A))) + np.uint64(len(shingles))
    return int(textbuf.mix(np.array([total], np.uint64)).view(np.int64)[0])


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return (percent * n + 99) // 100


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, off = textbuf.buffer(column)
    for _, _, part, at in textbuf.slabs(data, off):
        yield from textbuf.shingle_sets(part, at, k)


def parity(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls in each bucket; about two and a half to five buckets a shingle."""
    size = 64
    while size < 5 * len(shingles) // 2:
        size *= 2
    return np.packbits(np.bincount((shingles >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def parity_bound(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference: buckets of unequal parity. The longer one is folded to the other."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketch_size(docs: DataFrame) -> int:
    """A power of two from the planner's estimate of the input's bytes; it bears on speed only."""
    size, want = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), SKETCH
    while want < MOST and want * SHARE < size:
        want *= 2
    return want


def summarise(docs: DataFrame, k: int, size: int = SKETCH) -> DataFrame:
    """(doc_id, n, node) of each row, and each task's counts by shingle bucket as (slice, part) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int32)
        names = ["doc_id", "n", "node", "parity", "slice", "part"]
        for batch in batches:
            n, nodes, marks = [], [], []
            for x in sets_of(batch.column(1), k):
                n.append(len(x))
                nodes.append(node_of(x) if len(x) else None)
                marks.append(parity(x))
                np.add.at(counts, (x & np.uint64(size - 1)).astype(np.int64), 1)
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        used = [i for i in range(size // SLICE) if counts[i * SLICE : (i + 1) * SLICE].any()]
        parts = [counts[i * SLICE : (i + 1) * SLICE].tobytes() for i in used]
        empty = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, node long, parity binary, slice int, part binary")


def with_nodes(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs with the node of each row's text, null without words."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(x) if len(x) else None for x in sets_of(batch.column(at), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*batch.schema.names, "node"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", node long")


def merged_counts(parts: DataFrame, size: int = SKETCH) -> np.ndarray:
    def fill(batches: Iterator[pa.RecordBatch], into: np.ndarray) -> None:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                into[i * SLICE : (i + 1) * SLICE] += np.frombuffer(raw, np.int32)

    return merged_array(parts, fill, size, "int64")


def prefixes(docs: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """(token, node, n, pos) of each node's prefix, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            tokens, nodes, sizes, at = [], [], [], []
            for x in sets_of(batch.column(0), k):
                n = len(x)
                if not n:
                    continue
                node = node_of(x)
                if node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                p = n - needed(n, percent) + 1
                rank = np.argsort(order[(x & np.uint64(len(order) - 1)).astype(np.int64)], kind="stable")[:p]
                tokens.append(x[rank])
                nodes.append(node)
                sizes.append(n)
                at.append(p)
            if not nodes:
                continue
            repeat = np.array(at)
            pos = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            cols = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(nodes, np.int64), repeat), np.repeat(np.array(sizes, np.int32), repeat), pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "node", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, node long, n int, pos int")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """The distinct rows whose token stands in the prefixes of two nodes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        before = None  # the token of the distinct row before the held one
        names = ["token", "node", "n", "pos"]

        def out(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)

        for batch in batches:
            cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns)]
            t, node = cols[0], cols[1]
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])
            cols = [c[new] for c in cols]
            t = cols[0]
            same = t[1:] == t[:-1]
            keep = np.append(same, False)
            keep[1:] |= same
            keep[0] |= before is not None and before == t[0]
            if len(t) > 1:
                yield out([c[:-1] for c in cols], keep[:-1])
                before = t[-2]
            held = [c[-1:] for c in cols]
        if len(held[0]):
            yield out(held, np.array([before is not None and before == held[0][0]]))

    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long, n int, pos int")


def may_link(n1: int, p1: int, n2: int, p2: int, percent: int) -> bool:
    """Length and positional filters, for a pair whose first common token stands at p1 and p2.

    At a later common token they may say no; the first one's block speaks for the pair.
    """
    if 100 * min(n1, n2) < percent * max(n1, n2):
        return False
    least = -(-percent * (n1 + n2) // (100 + percent))
    return 1 + min(n1 - p1 - 1, n2 - p2 - 1) >= least


def met_with_leaders(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b, c) pairs that meet with a leader of a `token, node, n, pos` block; c: how often.

    The first leader is the node in which the token stands first: the one with the fewest tokens of its
    own, as the original of a group of near copies is. A node that no leader may link with becomes one,
    up to LEADERS. Rows come in that order, so no block is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, leads, pairs = None, [], Counter()
        for batch in batches:
            for t, node, n, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if t != token:
                    token, leads = t, []
                lead = next((x for x in leads if may_link(x[1], x[2], n, pos, percent)), None)
                if lead is not None:
                    pairs[lead[0], node] += 1
                elif len(leads) < LEADERS:
                    leads.append((node, n, pos))
            if len(pairs) > 200_000:
                yield pair_rows(pairs)
        yield pair_rows(pairs)

    dealt = blocks.select("token", "node", "n", "pos").repartition("token").sortWithinPartitions("token", "pos", "n", "node")
    return dealt.mapInArrow(run, "a long, b long, c long")


def pair_rows(pairs: Counter) -> pa.RecordBatch:
    """The counted pairs, which are let go."""
    rows = [(*k, c) for k, c in pairs.items()]
    pairs.clear()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "c"])


def crossing(node: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of a block's pairs in different components that the length and positional filters let pass; n ascends."""
    if (comp == comp[0]).all():
        return
    first = np.searchsorted(100 * n, percent * n)  # of the nodes that are long enough for each
    for i in range(1, len(node)):
        j = np.arange(first[i], i)
        j = j[comp[j] != comp[i]]
        if len(j):
            least = -(-percent * (n[j] + n[i]) // (100 + percent))
            j = j[1 + np.minimum(n[j] - pos[j] - 1, n[i] - pos[i] - 1) >= least]
            if len(j):
                yield np.minimum(node[j], node[i]), np.maximum(node[j], node[i])


def met_across(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs, maybe repeated, that meet in `token, node, n, pos, comp` blocks and lie in different components.

    Tokens of a single component, as a group of near copies mostly has, are left out before any pair
    is formed. A block is held as arrays, 32 bytes a node.
    """
    several = blocks.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5

        def out(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found)) if found else held[:2]
            both = np.unique(np.stack([a, b], 1), axis=0) if found else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        def judged(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.diff(cols[0])) + 1
            found, size = [], 0
            for x in zip(*(np.split(c, edges) for c in cols[1:])):
                for pair in crossing(*x, percent):
                    found.append(pair)
                    size += len(pair[0])
                    if size > 500_000:
                        yield out(found)
                        found, size = [], 0
            if found:
                yield out(found)

        for batch in batches:
            cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False).astype(np.int64))) for h, c in zip(held, batch.columns)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last token may go on
            held = [c[last:] for c in cols]
            if last:
                yield from judged([c[:last] for c in cols])
        if len(held[0]):
            yield from judged(held)

    dealt = blocks.join(several, "token", "left_semi").select("token", "node", "n", "pos", "comp").repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the nodes in `wanted` (node, doc_id): by a Bloom filter of fixed size, then exactly."""

    def fill(batches: Iterator[pa.RecordBatch], into: np.ndarray) -> None:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for h in bits(x):
                np.bitwise_or.at(into, h >> 3, np.left_shift(1, h & 7).astype(np.uint8))

    def bits(x: np.ndarray) -> Iterator[np.ndarray]:
        for salt in (1, 2, 3):
            yield (textbuf.mix(x * np.uint64(2 * salt + 1) + np.uint64(salt)) & np.uint64(8 * BLOOM - 1)).astype(np.int64)

    bloom = docs.sparkSession.sparkContext.broadcast(merged_array(wanted.select("node"), fill, BLOOM, "uint8", "or"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, seen = bloom.value, set()
        for batch in batches:
            nodes, tokens, held = [], [], 0
            for x in sets_of(batch.column(0), k):
                node = node_of(x) if len(x) else None
                if node is None or node in seen:
                    continue
                if not all((has[h >> 3] >> (h & 7) & 1)[0] for h in bits(np.array([node], np.int64).view(np.uint64))):
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                nodes.append(node)
                tokens.append(x.astype("<u8").tobytes())
                held += len(tokens[-1])
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], ["node", "tokens"])
                    nodes, tokens, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], ["node", "tokens"])

    found = docs.select("text").mapInArrow(run, "node long, tokens binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def suffix_filtered(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs that the suffix filter lets pass: the parities of their whole sets bound the
    difference of what follows the shared token, in a few hundredths of the sets' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            ok = [i for i in range(len(a)) if parity_bound(np.frombuffer(x[i], np.uint8), np.frombuffer(y[i], np.uint8)) <= n[i] + m[i] + 2 * (-percent * (n[i] + m[i]) // (100 + percent))]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], ["a", "b"])

    left = marks.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("parity").alias("x"))
    right = marks.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    total = len(x) + len(y)
    both = np.concatenate((x, y))
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (total - inter)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            ok = [i for i in range(len(a)) if linked(np.frombuffer(x[i], "<u8"), np.frombuffer(y[i], "<u8"), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], ["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def labelled(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    return blocks.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, node, comp (the smallest node reachable), component_id (the smallest doc_id)."""
    ws = Workspace(docs.sparkSession)
    size = sketch_size(docs.select("text"))
    summary = ws.table(summarise(docs, k, size), "summary")
    counts = merged_counts(summary.where("part is not null").select("slice", "part"), size)
    rows = summary.where("part is null").select("doc_id", "n", "node")
    blocks = ws.table(shared_tokens(prefixes(docs, counts, k, percent)), "blocks")
    ws.free()
    met = blocks.select("node").distinct()
    marks = ws.table(summary.where("node is not null").select("node", "n", "parity").join(met, "node", "left_semi").dropDuplicates(["node"]), "marks")

    def links(pairs: DataFrame) -> DataFrame:
        left = ws.table(suffix_filtered(pairs, marks, percent), "pairs")
        nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        out = ws.table(verified(left, whole_sets(docs, nodes, k), percent), "links")
        ws.free()
        return out

    met = met_with_leaders(blocks, percent).groupBy("a", "b").agg(F.sum("c").alias("c"))
    near = met.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m"))
    tried = ws.table(near.select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct(), "star")
    edges = links(tried)
    labels = components(ws, edges)
    rest = met_across(labelled(blocks, labels), percent).distinct().join(tried, ["a", "b"], "left_anti")
    labels = components(ws, edges.unionByName(links(rest)))
    ws.drop(blocks, marks)
    ws.free()

    own = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(labels, "node", "left")
    own = own.select("node", "first", F.coalesce("comp", "node").alias("comp"))
    least = own.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = own.join(least, "comp").select("node", "comp", "component_id")
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))
                      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w
), e as (select doc_id, len(sh) as n, unnest(sh) as g from s
), met as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (select a, b from met where 100 * c >= 75 * (n + m - c)
), ways as (select a, b from links union all select b, a from links
), reach as (select doc_id, doc_id as r from s union select ways.b, reach.r from reach join ways on ways.a = reach.doc_id)
select s.doc_id, len(sh) as n_shingles, min(r) as component_id from s left join reach using (doc_id) group by s.doc_id, len(sh)
"""
