"""N-gram Jaccard join: a MinHash LSH forest, completed by an exact prefix index, with exact verification.

1. Texts are grouped by digest; everything else works on distinct texts ("nodes").
2. A node's set of word shingles gives ``TREES * DEPTH`` minima; each tree's minima, in order, are
   the node's path in that tree's prefix trie.  Paths are sorted over ranges, so every subtrie is a run
   of rows, which may cross ranges: a prefix that a third of all nodes share is no single task's.
   From the full depth upwards a node meets the first node of each subtrie it belongs to: matched
   prefixes get shorter until ``depth_for`` says that a pair at the least similarity meets in some
   tree with the target recall.  A run is cut every ``HEAD`` rows, and where a range ends; the first of each piece (its
   least node) meets that of the piece before, so none meets more than ``HEAD`` nodes of a tree.
3. A meeting whose one-byte sketches put the similarity far below the bound is dropped, and the
   node meets its neighbours in that tree's sorted trie instead, those of the longest common
   prefixes.  What is left makes groups (connected components), so no pair of a group is spelled out.
4. What the forest did not bring together is completed exactly.  Shingles have one order for all nodes (commonest last,
   then by hash); two sets of size n and m at ``least`` or more share one of their first n - ceil(least * n) + 1 and
   m - ceil(least * m) + 1 shingles.  Nodes of different groups that meet there, and that neither sizes, places nor parity
   bitmaps rule out (all three bounds hold for every link), join their groups: no link is left between two groups.
5. Within a group all pairs are verified exactly.  Each text is shuffled once, to its block of the group,
   where its shingle set becomes the difference from that of the group's first node; only differences meet:
   |A & B| = |R| - |R - A| - |R - B| + |(A ^ R) & (B ^ R)|.  A group of m nodes has about sqrt(m) / ``SPREAD``
   blocks, so a difference is copied as often.  Blocks report each node's number of links and one
   tree edge per node.
6. Components of the verified edges are the classes.

Documents of fewer than ``words`` words have one shingle, all their words.  Texts without words
have no shingle and only equal texts as partners.  Null texts count as empty, repeated rows as
copies; the class id is the least doc_id of the class (null ids are ignored unless there is no
other).  Texts are whole, however long.  Empty tables give no rows.  Only doc_id and text are read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm import shared, text as tx
from tidewheel.llm.components import components

TREES, DEPTH = 24, 8
RECALL = 0.9995
SLACK = 0.15  # five standard errors of the sketch's estimate
HEAD = 4096
SPREAD = 6
BLOCK_BYTES = 1 << 26  # of texts, whose differences one block holds
TILE = 1024
HOT, FEW = 1 << 16, 100_000
COMMON, MOST_COMMON = 16, 200_000  # repeats that make a shingle common, and how many of these are told to every task
RUN = 1024
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def depth_for(least: float, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of similarity ``least`` still meets with probability ``recall``."""
    for d in range(DEPTH, 1, -1):
        if 1 - (1 - least**d) ** TREES >= recall:
            return d
    return 1


def shingles(raw: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every document's shingles, index of each document's first; n + 1)."""
    h, first = tx.word_hashes(raw, offs)
    size = np.diff(first)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    length = np.repeat(np.minimum(size, words), count)
    out = np.zeros(at[-1], np.uint64)
    for k in range(words):
        live = length > k
        out[live] = out[live] * np.uint64(0x9E3779B97F4A7C15) + h[begin[live] + k] * np.uint64(2 * k + 1)
    return tx.mix(out + length.astype(np.uint64)), at


def signatures(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents x minima) of the documents that have shingles; others get zeros."""
    n = len(at) - 1
    out = np.zeros((n, TREES * DEPTH), np.uint32)
    have = np.flatnonzero(np.diff(at) > 0)
    if len(have):
        x = (sh >> np.uint64(32)).astype(np.uint32)
        starts = at[:-1][have]
        for i in range(TREES * DEPTH):
            out[have, i] = np.minimum.reduceat(x * _MUL[i] + _ADD[i], starts)
    return out


def paths(sig: np.ndarray, least_depth: int) -> np.ndarray:
    """(documents x trees x (DEPTH - least_depth + 1)) hashes of the prefixes, shortest first."""
    n = len(sig)
    s = sig.reshape(n, TREES, DEPTH).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (n, TREES)).copy()
    out = []
    for d in range(DEPTH):
        h = tx.mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, d] + np.uint64(1))
        if d + 1 >= least_depth:
            out.append(h.copy())
    return np.stack(out, axis=2)


def repeats(sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values that ``sh`` has more than once, how often each), in order; ``sh`` is sorted in place, since copies of millions would fill a worker."""
    sh.sort()
    same = np.zeros(len(sh) + 1, bool)  # as the one before
    same[1:-1] = sh[1:] == sh[:-1]
    first = np.flatnonzero(same[1:] & ~same[:-1])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    return sh[first], last - first + 1


def common(docs: DataFrame, words: int) -> np.ndarray:
    """The commonest shingles, sorted by hash: they come last in the order of prefixes, which decides its cost and not its result.

    Counted are repeats within a task's texts, of all texts.
    """
    shared.prepare(docs.sparkSession)

    def count(batches):
        def told(held):
            sh = np.concatenate(held)
            held.clear()
            sh, n = repeats(sh)
            return pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(n)], names=["sh", "n"])

        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for _, _, raw, offs in tx.chunks(batch.column(0)):
                held.append(shingles(raw, offs, words)[0])
                size += len(held[-1])
            if size > 1 << 22:
                yield told(held)
                held, size = [np.zeros(0, np.uint64)], 0
        yield told(held)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "sh long, n long")
    top = rows.groupBy("sh").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "sh").limit(MOST_COMMON)
    return np.sort(top.select("sh").toArrow()["sh"].to_numpy().view(np.uint64))


def prefixes(sh: np.ndarray, at: np.ndarray, last: np.ndarray, least: float) -> tuple[list, list, list]:
    """(set size, first shingles in the common order, parity bitmap) of every document; ``last`` are the sorted common ones."""
    n = len(at) - 1
    who = np.repeat(np.arange(n), np.diff(at))
    rank = np.zeros(len(sh), bool)
    if len(last):
        rank = last[np.minimum(np.searchsorted(last, sh), len(last) - 1)] == sh
    order = np.lexsort((sh, rank, who))
    sh, who = sh[order], who[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (who[1:] != who[:-1])
    sh, who = sh[new], who[new]
    to = np.searchsorted(who, np.arange(n + 1))
    sizes, first, bits = np.diff(to).tolist(), [], []
    for i, size in enumerate(sizes):
        own = sh[to[i] : to[i + 1]]
        first.append(own[: size - int(np.ceil(least * size - 1e-9)) + 1].tobytes() if size else None)
        width = 256
        while width < 4 * size:
            width *= 2
        odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
        bits.append(np.packbits(odd.astype(np.uint8)).tobytes() if size else None)
    return sizes, first, bits


def nodes(docs: DataFrame, words: int, least_depth: int, least: float = 0.8) -> DataFrame:
    """Distinct texts: (nid, key, doc_id, copies, bytes, sketch, labels, size, first, bits); all but size are null without shingles."""
    shared.prepare(docs.sparkSession)
    last = docs.sparkSession.sparkContext.broadcast(common(docs, words))  # 200,000 numbers at most

    def look(batches):
        for batch in batches:
            sketch, label, size, first, bits = [], [], [], [], []
            for _, _, raw, offs in tx.chunks(batch.column(2)):
                sh, at = shingles(raw, offs, words)
                for out, own in zip((size, first, bits), prefixes(sh, at, last.value, least)):
                    out += own
                sig = signatures(sh, at)
                p = paths(sig, least_depth)
                some = np.diff(at) > 0
                low = (sig & 255).astype(np.uint8)
                sketch += [low[i].tobytes() if some[i] else None for i in range(len(some))]
                label += [p[i].tobytes() if some[i] else None for i in range(len(some))]
            cols = [pa.array(sketch, pa.binary()), pa.array(label, pa.binary()), pa.array(size, pa.int64()), pa.array(first, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *cols], names=["doc_id", "key", "bytes", *held])

    rows = keyed(docs).select("doc_id", "key", "text", F.octet_length("text").cast("long").alias("bytes"))
    held = ["sketch", "labels", "size", "first", "bits"]
    rows = rows.mapInArrow(look, "doc_id long, key binary, bytes long, sketch binary, labels binary, size long, first binary, bits binary")
    one = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), *[F.first(c).alias(c) for c in held])
    return shared.materialise(one.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))


class _Walk:
    """Goes through the sorted paths of one range, in blocks of ``HEAD`` rows, and names each node's firsts and neighbours.

    A subtrie's first in a block is its least node there: the trees of like nodes then agree on few firsts.
    """

    def __init__(self, part: int, levels: int):
        self.part, self.levels = part, levels
        self.before = None  # (path, nid, firsts) of the last row given out
        self.held = [np.zeros((0, levels), np.int64)], [np.zeros(0, np.int64)]
        self.edges: list[bytes] = []  # first and last row: part, which, nid, path, firsts

    def _edge(self, last: int, nid: int, path: np.ndarray, firsts: np.ndarray) -> None:
        self.edges.append(np.concatenate([[self.part, last, nid], path, firsts]).astype(np.int64).tobytes())

    def step(self, path: np.ndarray, nid: np.ndarray, end: bool = False):
        """Yields (nid, what it meets, before, after) of the rows that meet some, whole blocks at a time."""
        self.held[0].append(path)
        self.held[1].append(nid)
        if not end and sum(map(len, self.held[1])) <= HEAD:
            return
        path, nid = np.concatenate(self.held[0]), np.concatenate(self.held[1])
        at = 0
        while len(nid) - at > HEAD or end and at < len(nid):
            to = min(at + HEAD, len(nid))
            yield self._block(path[at:to], nid[at:to], path[to : to + 1], nid[to : to + 1])
            at = to
        self.held = [path[at:]], [nid[at:]]
        if end and self.before is not None:
            path, nid, firsts = self.before
            self._edge(1, nid, path, firsts)

    def _block(self, path: np.ndarray, nid: np.ndarray, next_path: np.ndarray, next_nid: np.ndarray):
        n = len(nid)
        new = np.ones((n, self.levels), bool)  # a new subtrie at this level
        new[1:] = np.logical_or.accumulate(path[1:] != path[:-1], axis=1)
        firsts = np.stack([np.minimum.reduceat(nid, np.flatnonzero(new[:, i]))[np.cumsum(new[:, i]) - 1] for i in range(self.levels)], axis=1)
        old_path, old_nid, old_firsts = self.before or (path[0] + 1, 0, firsts[0])
        goes_on = np.logical_and.accumulate(path[0] == old_path)
        before, after = np.append(old_nid, nid[:-1]), np.append(nid[1:], next_nid if len(next_nid) else 0)
        no_before = np.append(not goes_on[0], new[1:, 0])
        no_after = np.append(new[1:, 0], not (len(next_nid) and next_path[0, 0] == path[-1, 0]))
        if not self.edges:
            self._edge(0, int(nid[0]), path[0], firsts[0])
        self.before = path[-1], int(nid[-1]), firsts[-1]
        some = np.flatnonzero((firsts != nid[:, None]).any(axis=1))
        rows = [sorted(set(m) - {a}) for m, a in zip(firsts[some].tolist(), nid[some].tolist())]
        links = [(int(x), int(y)) for x, y, go in zip(firsts[0], old_firsts, goes_on) if go and x != y]  # a run that goes on from the block before
        who = np.append(nid[some], np.array([x for x, _ in links], np.int64))
        alone = np.ones(len(links), bool)
        return who, rows + [[y] for _, y in links], *(
            pa.array(np.append(v[some], np.zeros(len(links), np.int64)), pa.int64(), mask=np.append(no[some], alone)) for v, no in ((before, no_before), (after, no_after)))


def tries(node: DataFrame, least_depth: int) -> DataFrame:
    """A row per node and tree it shares a prefix in: (nid, firsts of its subtries, nids before and after it in the trie).

    The rows with an ``edge`` tell the first and the last row of each range.
    """
    levels = DEPTH - least_depth + 1

    def deal(batches):
        for batch in batches:
            nid = batch.column(0).to_numpy()
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, levels).view(np.int64)
            cols = [pa.array(np.repeat(nid, TREES)), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(levels))]
            yield pa.RecordBatch.from_arrays(cols, names=["nid", *(f"h{i}" for i in range(levels))])

    schema = "nid long, " + ", ".join(f"h{i} long" for i in range(levels))
    rows = node.filter("labels IS NOT NULL").select("nid", "labels").mapInArrow(deal, schema)
    names = [f"h{i}" for i in range(levels)]
    n = int(node.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *names, "nid").sortWithinPartitions(*names, "nid").select("nid", *names)

    def walk(batches):
        w = _Walk(TaskContext.get().partitionId(), levels)

        def batch_of(found):
            nid, firsts, before, after = found
            cols = [pa.array(nid, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), before, after, pa.nulls(len(nid), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["nid", "firsts", "before", "after", "edge"])

        for batch in batches:
            path = np.stack([batch.column(i + 1).to_numpy() for i in range(levels)], axis=1)
            yield from map(batch_of, w.step(path, batch.column(0).to_numpy()))
        yield from map(batch_of, w.step(np.zeros((0, levels), np.int64), np.zeros(0, np.int64), True))
        k = len(w.edges)
        cols = [pa.array([0] * k, pa.int64()), pa.array([[]] * k, pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(w.edges, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["nid", "firsts", "before", "after", "edge"])

    return shared.materialise(rows.mapInArrow(walk, "nid long, firsts array<long>, before long, after long, edge binary"), "tries")


def across(rows: DataFrame, levels: int) -> DataFrame:
    """(a, b) that a run's first row in a range meets in the range before; two rows of each range reach the driver."""
    edges = sorted(np.frombuffer(r.edge, np.int64).tolist() for r in rows.filter("edge IS NOT NULL").select("edge").collect())
    pairs = set()
    for (_, _, end, *last), (_, _, nid, *first) in zip(edges[1::2], edges[2::2]):
        for i in range(levels):
            if first[: i + 1] == last[: i + 1]:
                pairs.add((first[levels + i], last[levels + i]))
        if first[0] == last[0]:
            pairs.add((nid, end))
    both = np.array(sorted(p for p in pairs if p[0] != p[1]), np.int64).reshape(-1, 2)
    # from Arrow: rows of a Python list would go through other Python workers, as functions of RDDs do
    return rows.sparkSession.createDataFrame(pa.table({"a": both[:, 0], "b": both[:, 1]}), "a long, b long")


def meetings(node: DataFrame, least_depth: int, least: float) -> DataFrame:
    """Distinct likely (a, b): nodes and the firsts of their subtries; where a first is unlike a node, its neighbours in the trie."""
    rows = tries(node, least_depth)
    own = rows.filter("edge IS NULL").drop("edge")
    each = own.select(F.col("nid").alias("a"), F.explode("firsts").alias("b"), "before", "after")
    met = each.select("a", "b").unionByName(across(rows, DEPTH - least_depth + 1)).distinct()
    near = shared.materialise(likely(node, met, least), "near")
    # a first that is unlike a node may stand before others that are like it
    alone = each.join(near, ["a", "b"], "left_anti")
    beside = alone.select("a", F.explode(F.array("before", "after")).alias("b")).filter("b IS NOT NULL AND a <> b")
    beside = beside.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct()
    found = shared.materialise(near.union(likely(node, beside, least)), "meetings")
    shared.drop_table(rows)
    shared.drop_table(near)
    return found


def likely(node: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches do not rule out ``least``."""
    sketches = node.filter("sketch IS NOT NULL").select("nid", "sketch")
    rows = pairs.join(sketches.select(F.col("nid").alias("a"), F.col("sketch").alias("sa")), "a")
    rows = rows.join(sketches.select(F.col("nid").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")
    width = TREES * DEPTH

    def keep(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, width) for i in (2, 3))
            same = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same >= least - SLACK))

    return rows.mapInArrow(keep, "a long, b long")


class _Runs:
    """Goes through rows (shingle, size, nid, cluster, place) sorted in this order and pairs nodes of different clusters.

    Held is one shingle's rows of sizes that still matter: at least ``least`` times the size at hand.
    """

    def __init__(self, least: float):
        self.least = least
        self.last = np.zeros((0, 5), np.int64)  # a run that may go on
        self.paired = 0  # how many of its rows have been paired with each other

    def step(self, rows: np.ndarray):
        """Yields (n x 2) pairs, the smaller nid first; pass no rows at the end."""
        old = len(self.last)
        end = not len(rows)
        rows = np.concatenate([self.last, rows])
        if not len(rows):
            return
        start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        stop = np.append(start[1:], len(rows))
        for s, e in zip(start[stop - start > 1].tolist(), stop[stop - start > 1].tolist()):
            own = rows[s:e]
            if e <= old or (own[:, 3] == own[0, 3]).all():
                continue
            yield from self._pairs(own, self.paired if s == 0 else 0)
        s = start[-1]
        self.paired = 0
        self.last = rows[:0]
        if not end:
            own = rows[s:]
            self.last = own[own[:, 1] >= self.least * own[-1, 1] - 1e-6]
            if not (self.last[:, 3] == self.last[0, 3]).all():
                self.paired = len(self.last)

    def _pairs(self, own: np.ndarray, paired: int):
        size, nid, cluster, place = own[:, 1:].T
        for i in range(paired, len(own), RUN):
            me = slice(i, min(i + RUN, len(own)))
            low = int(np.searchsorted(size, self.least * size[i] - 1e-6))
            for j in range(low, me.stop, RUN):
                to = slice(j, min(j + RUN, me.stop))
                total = size[me, None] + size[None, to]
                most = np.minimum((size - place)[me, None], (size - place)[None, to])
                ok = (cluster[me, None] != cluster[None, to]) & (size[None, to] >= self.least * size[me, None] - 1e-6)
                ok &= (most >= self.least / (1 + self.least) * total - 1e-6) & (np.arange(to.start, to.stop)[None] < np.arange(me.start, me.stop)[:, None])
                x, y = np.nonzero(ok)
                if len(x):
                    both = np.stack([nid[me][x], nid[to][y]], axis=1)
                    yield np.sort(both, axis=1)


def unmet(node: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(a, b) of nodes in different groups, every link between groups among them: prefixes that meet, within the bounds of sizes, places and bitmaps."""
    spark = node.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = node.filter("size > 0").select("nid", "size", "first").join(groups.select(F.col("node").alias("nid"), "label"), "nid", "left")
    placed = placed.select("nid", F.coalesce("label", "nid").alias("cluster"), "size", "first")

    def deal(batches):
        for batch in batches:
            first = batch.column(3).to_pylist()
            count = np.array([len(f) // 8 for f in first], np.int64)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            cols = [np.frombuffer(b"".join(first), np.int64), *(np.repeat(batch.column(i).to_numpy(), count) for i in (1, 0, 2)), place]
            sh, cluster, nid, size, place = cols
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (sh, size, nid, cluster, place)], names=names)

    names = ["sh", "size", "nid", "cluster", "place"]
    rows = placed.mapInArrow(deal, ", ".join(f"{c} long" for c in names)).repartition(n, "sh").sortWithinPartitions("sh", "size", "nid")

    def meet(batches):
        def batch_of(p):
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        runs = _Runs(least)
        for batch in batches:
            yield from map(batch_of, runs.step(np.stack([c.to_numpy() for c in batch.columns], axis=1)))
        yield from map(batch_of, runs.step(np.zeros((0, 5), np.int64)))

    pairs = rows.mapInArrow(meet, "a long, b long").distinct()
    own = node.filter("size > 0").select("nid", "size", "bits")
    pairs = pairs.join(own.select(F.col("nid").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x")), "a")
    pairs = pairs.join(own.select(F.col("nid").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y")), "b").select("a", "b", "n", "m", "x", "y")

    def keep(batches):
        for batch in batches:
            most = (1 - least) / (1 + least) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-6
            apart = [differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= most))

    return shared.materialise(pairs.mapInArrow(keep, "a long, b long"), "unmet")


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, at most the size of the sets' difference; the wider one is folded."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, all of ``a`` with all of ``b``, by products of incidence matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    parts = []
    for sets in (a, b):
        parts.append((np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    both = np.intersect1d(parts[0][0], parts[1][0])
    cells = []
    for flat, who in parts:
        col = np.searchsorted(both, flat)
        live = both[np.minimum(col, len(both) - 1)] == flat if len(both) else np.zeros(len(flat), bool)
        col, who = col[live], who[live]
        order = np.argsort(col, kind="stable")
        cells.append((col[order], who[order]))
    step = 2048
    for s in range(0, len(both), step):
        x = []
        for (col, who), sets in zip(cells, (a, b)):
            i, j = np.searchsorted(col, [s, s + step])
            m = np.zeros((len(sets), min(step, len(both) - s)), np.float32)
            m[who[i:j], col[i:j] - s] = 1
            x.append(m)
        out += x[0] @ x[1].T
    return np.rint(out).astype(np.int64)


@dataclass
class Side:
    """The nodes of one block: ids, set sizes, how many shingles of the group's first they lack, differences from it."""

    nid: np.ndarray
    size: np.ndarray
    lacks: np.ndarray
    diff: list[np.ndarray]

    def part(self, i: int, j: int) -> Side:
        return Side(self.nid[i:j], self.size[i:j], self.lacks[i:j], self.diff[i:j])


def links_between(a: Side, b: Side, first_size: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nid, links, root) of the nodes with links between ``a`` and ``b``, or within ``a`` if that is ``b`` too."""
    same, n = a is b, len(a.nid)
    nid = a.nid if same else np.concatenate([a.nid, b.nid])
    links, root = np.zeros(len(nid), np.int64), np.arange(len(nid))
    at = 0 if same else n
    for s in range(0, n, TILE):
        rows = a.part(s, s + TILE)
        inter = first_size - rows.lacks[:, None] - b.lacks[None] + shared_counts(rows.diff, b.diff)
        linked = inter >= least * (rows.size[:, None] + b.size[None] - inter) - 1e-9
        if same:
            linked[np.arange(len(rows.nid)), s + np.arange(len(rows.nid))] = False
        else:
            links[at:] += linked.sum(axis=0)
        links[s : s + len(rows.nid)] += linked.sum(axis=1)
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            near = root[at + np.flatnonzero(linked[i])]
            mine = root[s + i]
            if (near != mine).any():
                joined = np.unique(np.append(near, mine))
                root[np.isin(root, joined[1:])] = joined[0]
    some = links > 0
    return nid[some], links[some], nid[root[some]]


def grouped(docs: DataFrame, node: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (cluster, at, is_member, nid, nb, text): each member at its block, the group's first at every block, before the members."""
    about = groups.join(node.select(F.col("nid").alias("node"), "key", F.col("doc_id").alias("rep"), "bytes"), "node")
    about = shared.materialise(about, "members")
    size = about.groupBy("label").agg(F.count("*").alias("m"), F.sum("bytes").alias("total"))
    nb = F.greatest(F.ceil(F.sqrt("m") / F.lit(SPREAD)), F.ceil(F.col("total") / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    size = shared.materialise(size.select("label", nb.alias("nb"), "m"), "groups")
    hot = size.filter(F.col("m") > HOT)
    if 0 < hot.count() <= FEW:  # the rows of a hot group stay where they are
        member = about.join(F.broadcast(hot), "label").unionByName(about.join(F.broadcast(hot), "label", "left_anti").join(size, "label"))
    else:
        member = about.join(size, "label")
    member = member.select(F.col("key").alias("k"), "rep", F.col("node").alias("nid"), F.col("label").alias("cluster"), "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("block"))
    rows = keyed(docs)
    rows = rows.join(member, (rows["key"] == member["k"]) & rows["doc_id"].eqNullSafe(member["rep"])).select("nid", "cluster", "nb", "block", "text")
    own = F.array(F.struct(F.col("block").alias("at"), F.lit(True).alias("is_member")))
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(x.cast("int").alias("at"), F.lit(False).alias("is_member")))
    places = F.when(F.col("nid") == F.col("cluster"), F.concat(own, all_blocks)).otherwise(own)
    rows = rows.withColumn("p", F.explode(places)).select("cluster", "p.at", "p.is_member", "nid", "nb", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cluster", "at").sortWithinPartitions("cluster", "at", "is_member", "nid")


def differences(rows: DataFrame, words: int) -> DataFrame:
    """(cluster, block, nb, nid, first_size, size, lacks, diff) of every member."""
    names = ["cluster", "block", "nb", "nid", "first_size", "size", "lacks", "diff"]

    def run(batches):
        key, first, last = None, None, None
        for batch in batches:
            cluster, at, member, nid, nb = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for i, j, raw, offs in tx.chunks(batch.column(5)):
                sh, to = shingles(raw, offs, words)
                for r in range(i, j):
                    own = np.unique(sh[to[r - i] : to[r - i + 1]])
                    if not member[r]:
                        key, first = (cluster[r], at[r]), own
                        continue
                    assert key == (cluster[r], at[r])  # a group's first stands at each of its blocks
                    if last == (key, nid[r]):  # a repeated row
                        continue
                    last = key, nid[r]
                    diff = np.setxor1d(first, own, assume_unique=True)
                    lacks = len(first) - (len(first) + len(own) - len(diff)) // 2
                    out.append((cluster[r], at[r], nb[r], nid[r], len(first), len(own), lacks, diff.tobytes()))
            cols = list(zip(*out)) or [()] * 8
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.mapInArrow(run, "cluster long, block int, nb int, nid long, first_size long, size long, lacks long, diff binary")


def verified(docs: DataFrame, node: DataFrame, groups: DataFrame, words: int, least: float) -> DataFrame:
    """(nid, links, root) from every pair of blocks of every group, all pairs verified on their shingle sets."""
    rows = differences(grouped(docs, node, groups), words)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "nid", "first_size", "size", "lacks", "diff")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "block", "nid")

    def verify(batches):
        def judge(key, held):
            sides = []
            for block in dict.fromkeys(key[1:]):
                own = [h for h in held if h[0] == block]
                sides.append(Side(np.array([h[1] for h in own], np.int64), np.array([h[3] for h in own], np.int64), np.array([h[4] for h in own], np.int64), [np.frombuffer(h[5], np.uint64) for h in own]))
            a, b = sides[0], sides[-1]
            if not len(a.nid) or not len(b.nid) or (a is b and len(a.nid) < 2):
                return None
            nid, links, root = links_between(a, b, held[0][2], least)
            return pa.RecordBatch.from_arrays([pa.array(nid), pa.array(links), pa.array(root)], names=["nid", "links", "root"]) if len(nid) else None

        key, held = None, []
        for batch in batches:
            for cluster, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, lo, hi) != key:
                    if held and (out := judge(key, held)) is not None:
                        yield out
                    key, held = (cluster, lo, hi), []
                held.append(row)
        if held and (out := judge(key, held)) is not None:
            yield out

    return rows.mapInArrow(verify, "nid long, links long, root long")


def classes(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per distinct text: key, doc_id (its least), label (its class), class_id, n_links, n_copies."""
    depth = depth_for(least)
    node = nodes(docs, words, depth, least)
    met = meetings(node, depth, least)
    groups = components(met)
    more = unmet(node, groups, least)
    if more.limit(1).count():
        first, groups = groups, components(groups.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
        shared.drop_table(first)
    proof = shared.materialise(verified(docs, node, groups, words, least), "links")
    links = proof.groupBy("nid").agg(F.sum("links").alias("n_links"))
    found = components(proof.select(F.col("nid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "nid")
    placed = node.select("nid", "key", "doc_id", "copies").join(found, "nid", "left").join(links, "nid", "left")
    placed = placed.select("key", "doc_id", F.coalesce("label", "nid").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"))
    named = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    out = shared.materialise(placed.join(named, "label"), "classes")
    for t in (met, more, groups, proof, found, node):
        shared.drop_table(t)
    return out


def join(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links (other texts at ``least`` or more), n_copies (of its own text)."""
    placed = classes(docs, words, least).select("key", "class_id", "n_links", "n_copies")
    return keyed(docs).select("doc_id", "key").join(placed, "key").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs``, all columns, with one row of each class: the least doc_id's (a null id's only if there is no other)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stay = classes(docs, words, least).groupBy("label").agg(F.min_by(F.struct("key", "doc_id"), order).alias("k")).select("k.key", "k.doc_id")
    # a document that repeats row by row stays once; such rows are counted without their texts
    named = keyed(docs).select("key", F.col("doc_id").alias("own"))
    stay = stay.join(named, "key").filter(F.col("doc_id").eqNullSafe(F.col("own"))).groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    key, own, n = (shared.fresh(docs, c) for c in ("text_key", "kept_id", "kept_n"))
    stay = shared.materialise(stay.select(F.col("key").alias(key), F.col("doc_id").alias(own), F.col("n").alias(n)), "stay")
    text = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = docs.withColumn(key, text).join(stay, key).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    once = kept.filter(F.col(n) == 1).select(*docs.columns)
    if stay.filter(F.col(n) > 1).limit(1).count():
        once = once.unionByName(kept.filter(F.col(n) > 1).dropDuplicates([key]).select(*docs.columns))
    return once
