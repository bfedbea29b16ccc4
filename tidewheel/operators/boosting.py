"""Boosted regression trees by distributed histograms, with Poisson loss under a log link or squared loss.

Features become bin numbers of one byte (at most 255 bins, the last number for missing values), rows become blocks of
bytes that stay cached where they are.  A pass over the blocks adds up gradients, hessians and counts by (model, node, feature, bin);
partial sums of a task are shuffled by (model, node) and the reducer answers with the node's best split, so the driver sees
some hundred bytes a node and never a row.  Trees grow best-first, as far as ``max_leaf_nodes`` goes: a pass serves every
node that could still be reached.  A node of at most ``SMALL`` rows is not asked level by level: its rows (bin numbers, gradient, hessian) are shuffled to
one reducer, which answers with the splits of everything below it, so a tree takes as many passes as its large nodes are deep, and one.
Where a caller allows it, a model of few rows in all is grown to its last tree by one task: its rows are shuffled once, not in every round.
Several models (settings, targets) grow in the same passes.  Passes are RDD jobs over the cached blocks: as DataFrame plans, hundreds of small jobs took 0.3 s
each on this box, most of it planning.

A split sends a set of bins to the left: a numeric one all up to a bin, with missing values on the side that gains more; a categorical one
the first categories in the order of G / (H + 10), those of fewer than 10 rows stay right.  A value that is missing, or a category not seen, where
training saw none goes with the larger side.  With more than ``stop_from`` rows a tenth of them is put aside and a
model stops when ten trees did not lower its loss there.

Defined results: rows with a null target are not learnt from; without rows the model predicts 0; equal gains go to the first feature,
then the first bin, equal nodes to the left one.  Sums of floats may differ in the last places between clusters of other partitions.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tidewheel.session import at_once, cut, prepare_workers

BINS = 256
MISSING = BINS - 1
BLOCK = 1 << 16
FEW_ROWS, MANY_ROWS = 16_384, 500_000  # of a task: less is not worth one, more make another
LEAST_CATEGORY = 10
LEAST_HESSIAN = 1e-3
KEPT_ROUNDS = 16  # rounds between written states
SMALL = MANY_ROWS  # rows of a node whose subtree is grown by one reducer, no more than a task holds anyway (27 bytes a row with 11 features)
ALONE = 4 * MANY_ROWS  # rows of a model that one task may fit (see Boost.fit); larger ones are fitted by passes


@dataclass(frozen=True)
class Setting:
    max_iter: int = 100
    learning_rate: float = 0.1
    max_depth: int | None = None
    max_leaf_nodes: int = 31
    min_samples_leaf: int = 20
    l2: float = 0.0
    patience: int = 10
    tolerance: float = 1e-7
    stop_from: int = 10_000


@dataclass(frozen=True)
class Job:
    """One model to fit: target column (by number), loss, setting, and whether the recent rows are learnt from too."""

    target: int
    loss: str
    setting: Setting
    recent: bool


@dataclass
class Bins:
    """Edges of numeric features, categories of the others; columns in this order."""

    numeric: dict[str, list[float]]
    classes: dict[str, list[str]]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.classes]

    def categorical(self, f: int) -> bool:
        return f >= len(self.numeric)

    def number(self, f: int, values: pa.Array) -> np.ndarray:
        """Bin numbers of a column of feature ``f``: how many edges lie below a value, or the place of a category."""
        name = self.columns[f]
        if not self.categorical(f):
            v = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            return np.where(np.isnan(v), MISSING, np.searchsorted(self.numeric[name], v, side="left")).astype(np.uint8)
        own = self.classes[name]
        places = pa.compute.index_in(values.cast(pa.string()), pa.array(own, pa.string()))
        return pa.compute.fill_null(places, MISSING).to_numpy(zero_copy_only=False).astype(np.uint8)


def find_bins(train: DataFrame, numeric: list[str], classes: list[str], most: int = MISSING) -> Bins:
    """Edges between neighbouring values where a feature has at most ``most`` of them, else at its quantiles (a mergeable sketch)."""
    def edges(c: str) -> list[float]:
        own = train.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
        some = sorted(r.v for r in own.distinct().limit(most + 1).collect())
        if len(some) > most:
            cuts = [i / most for i in range(1, most)]
            return sorted(set(own.agg(F.percentile_approx("v", cuts, 100_000)).first()[0]))
        return [(a + b) / 2 for a, b in zip(some, some[1:])]

    def kinds(c: str) -> list[str]:
        found = sorted(r.v for r in train.select(F.col(c).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(most + 1).collect())
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} categories")
        return found

    found = at_once([lambda c=c: edges(c) for c in numeric] + [lambda c=c: kinds(c) for c in classes])
    return Bins(dict(zip(numeric, found)), dict(zip(classes, found[len(numeric):])))


# --- trees -----------------------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """Sums of a node and, once a pass has answered, its best split (gain 0: none)."""

    g: float
    h: float
    n: float
    gain: float | None = None
    feature: int = -1
    left: np.ndarray | None = None  # which of the 256 bins go left
    left_sums: tuple = ()


@dataclass
class Tree:
    """Arrays over nodes in breadth-first order; leaves point to themselves."""

    feature: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def __getstate__(self) -> dict:
        return self.__dict__ | {"goes_left": np.packbits(self.goes_left, axis=1)}  # plans hold the trees of some rounds

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, goes_left=np.unpackbits(state["goes_left"], axis=1).astype(bool))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row of ``x`` (features x rows)."""
        at, todo = np.zeros(x.shape[1], np.int64), [(0, np.arange(x.shape[1]))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] == node:
                at[rows] = node
            elif len(rows):
                goes = self.goes_left[node].take(x[self.feature[node]].take(rows))
                todo += [(self.left[node], rows[goes]), (self.right[node], rows[~goes])]
        return at


def _tree(splits: dict[str, Node], values: dict[str, float]) -> tuple[Tree, list[str]]:
    """The tree whose inner nodes are ``splits`` (by path); ``values`` of its leaves, 0 where there is none."""
    paths, depth = [""], 0
    for p in paths:
        if p in splits:
            paths += [p + "L", p + "R"]
            depth = max(depth, len(p) + 1)
    at = {p: i for i, p in enumerate(paths)}
    own = np.arange(len(paths))
    goes = np.zeros((len(paths), BINS), bool)
    feature = np.zeros(len(paths), np.int64)
    for p, i in at.items():
        if p in splits:
            goes[i], feature[i] = splits[p].left, splits[p].feature
    left = np.array([at.get(p + "L", i) for p, i in at.items()])
    right = np.array([at.get(p + "R", i) for p, i in at.items()])
    return Tree(feature, goes, np.where(left == own, own, left), right, np.array([values.get(p, 0.0) for p in paths]), depth), paths


class Grower:
    """A tree while it grows, at the driver: sums and best splits by path ('' is the root, 'LR' the right child of its left one)."""

    def __init__(self, setting: Setting):
        self.s, self.nodes = setting, {}

    def _may_split(self, path: str) -> bool:
        return self.nodes[path].n >= 2 * self.s.min_samples_leaf and (self.s.max_depth is None or len(path) < self.s.max_depth)

    def tell(self, path: str, node: Node) -> None:
        """A pass's answer; the children's sums follow from it."""
        self.nodes[path] = node
        if node.gain > 0:
            g, h, n = node.left_sums
            self.nodes[path + "L"] = Node(g, h, n)
            self.nodes[path + "R"] = Node(node.g - g, node.h - h, node.n - n)

    def wanted(self) -> list[str]:
        """Nodes without an answer that could belong to the tree; none when the tree is complete.

        Best-first never splits a node before all whose least gain on the path from the root is larger, so only the
        ``max_leaf_nodes`` - 1 best by that measure can have children.
        """
        if not self.nodes:
            return [""]
        if self._splits() is not None:
            return []
        reach, out = {}, []
        for p in sorted(self.nodes, key=len):
            if self.nodes[p].gain:
                reach[p] = min(self.nodes[p].gain, reach.get(p[:-1], np.inf) if p else np.inf)
        best = sorted(reach.values(), reverse=True)[: self.s.max_leaf_nodes - 1]
        for p in reach:
            if reach[p] >= best[-1]:
                out += [c for c in (p + "L", p + "R") if self.nodes[c].gain is None and self._may_split(c)]
        return sorted(out)

    def _splits(self) -> dict[str, Node] | None:
        """Inner nodes of the best-first tree, or None if an answer is lacking."""
        done, leaves, heap = {}, 1, []

        def offer(path: str) -> bool:
            node = self.nodes[path]
            if node.gain is None and self._may_split(path):
                return False
            if node.gain:
                heapq.heappush(heap, (-node.gain, path))
            return True

        if not offer(""):
            return None
        while heap and leaves < self.s.max_leaf_nodes:
            _, p = heapq.heappop(heap)
            done[p] = self.nodes[p]
            leaves += 1
            if leaves < self.s.max_leaf_nodes and not (offer(p + "L") and offer(p + "R")):
                return None
        return done

    def finish(self) -> Tree:
        splits = self._splits()
        ends = [p + c for p in splits for c in "LR" if p + c not in splits] or [""]
        values = {p: -self.s.learning_rate * self.nodes[p].g / (self.nodes[p].h + self.s.l2 + 1e-15) for p in ends}
        return _tree(splits, values)[0]


def best_split(hist: np.ndarray, categorical: int, least_rows: int, l2: float) -> Node:
    """The best split of a node from its sums ``hist`` (features x bins x (gradient, hessian, rows)); features from ``categorical`` on are classes."""
    total = hist[0].sum(axis=0)
    g, h, n = (float(v) for v in total)
    node = Node(g, h, n, 0.0)
    if n < 2 * least_rows:
        return node
    base = g * g / (h + l2 + 1e-15)

    def gains(left: np.ndarray) -> np.ndarray:
        """Gains of sums to the left, -inf where a side is too small."""
        right = total - left
        ok = (np.minimum(left[..., 2], right[..., 2]) >= least_rows) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN)
        found = left[..., 0] ** 2 / (left[..., 1] + l2 + 1e-15) + right[..., 0] ** 2 / (right[..., 1] + l2 + 1e-15) - base
        return np.where(ok, found, -np.inf)

    upto = np.cumsum(hist[:categorical, :MISSING], axis=1)
    tries = {(f, False): v for f, v in enumerate(gains(upto))}
    gaps = [f for f in range(categorical) if hist[f, MISSING, 2]]
    with_gap = upto[gaps] + hist[gaps, MISSING][:, None]
    tries |= {(f, True): v for f, v in zip(gaps, gains(with_gap))}
    for f, bins in enumerate(hist):
        gap = bins[MISSING]
        if f >= categorical:
            some = np.flatnonzero(bins[:, 2] >= LEAST_CATEGORY)
            order = some[np.argsort(bins[some, 0] / (bins[some, 1] + LEAST_CATEGORY), kind="stable")]
            classes = np.cumsum(bins[order], axis=0)
            tries[f, False] = gains(classes)
        for missing_left in (False, True):
            gain = tries.get((f, missing_left))
            if gain is None or not len(gain):
                continue
            i = int(gain.argmax())
            if gain[i] > node.gain + 1e-12 * abs(node.gain) and gain[i] > 1e-12:
                mask = np.zeros(BINS, bool)
                if f < categorical:
                    mask[: i + 1] = True
                    left = with_gap[gaps.index(f), i] if missing_left else upto[f, i]
                else:
                    mask[order[: i + 1]] = True
                    left = classes[i]
                if gap[2] == 0:
                    unseen = np.flatnonzero(bins[:, 2] == 0) if f >= categorical else np.array([MISSING])
                    mask[unseen] = left[2] > n - left[2]  # with the larger side
                elif f < categorical:
                    mask[MISSING] = missing_left
                node = Node(g, h, n, float(gain[i]), f, mask, tuple(float(v) for v in left))
    return node


def _sums(at: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, slot=0) -> np.ndarray:
    """(features x slots x bins x (gradient, hessian, rows)) of rows with bins ``at`` (features x rows) in the slots ``slot``."""
    size = slots * BINS
    out = np.empty((len(at), size, 3))
    for f, own in enumerate(at):
        own = own.astype(np.intp) + slot * BINS if slots > 1 else own.astype(np.intp)
        out[f, :, 0], out[f, :, 1], out[f, :, 2] = np.bincount(own, g, size), np.bincount(own, h, size), np.bincount(own, minlength=size)
    return out.reshape(len(at), slots, BINS, 3)


def subtree(path: str, x: np.ndarray, g: np.ndarray, h: np.ndarray, categorical: int, s: Setting) -> list[tuple[str, Node]]:
    """(path, answer) of the node ``path`` and of those below it that a best-first tree could reach, parents first.

    What a tree takes below a node is the start of the node's own best-first order, at most one split less for each node above.
    The sums of a larger child are its parent's less the smaller one's; bins without rows are 0 then too.
    """
    found, heap, splits = [], [], s.max_leaf_nodes - 1 - len(path)

    def offer(p: str, rows: np.ndarray, hist: np.ndarray) -> None:
        node = best_split(hist, categorical, s.min_samples_leaf, s.l2)
        found.append((p, node))
        if node.gain:
            heapq.heappush(heap, (-node.gain, p, rows, node, hist))

    offer(path, np.arange(len(g)), _sums(x, g, h, 1)[:, 0])
    while heap and splits > 0:
        _, p, rows, node, hist = heapq.heappop(heap)
        splits -= 1
        if splits and len(rows) >= 2 * s.min_samples_leaf and (s.max_depth is None or len(p) + 1 < s.max_depth):
            goes = node.left.take(x[node.feature].take(rows))
            few, many = sorted(((p + "L", rows[goes]), (p + "R", rows[~goes])), key=lambda c: len(c[1]))
            if len(many[1]) >= 2 * s.min_samples_leaf:
                own = _sums(x.take(few[1], axis=1), g.take(few[1]), h.take(few[1]), 1)[:, 0]
                rest = hist - own
                rest[rest[..., 2] == 0] = 0
                for c, sums in sorted([(few, own), (many, rest)], key=lambda c: c[0][0]):
                    if len(c[1]) >= 2 * s.min_samples_leaf:
                        offer(*c, sums)
    return found


def grown(x: np.ndarray, y: np.ndarray, flags: np.ndarray, job: Job, stops: bool, start: float, categorical: int) -> tuple[list[Tree], np.ndarray]:
    """All trees of a model whose rows are at hand (bins as features x rows), and (summed absolute error, rows) of the recent ones: what passes find round by round."""
    s, trees, losses = job.setting, [], []
    used, aside = (np.flatnonzero(rows) for rows in _used(job, stops, flags, y))
    recent = np.flatnonzero(((flags & RECENT) != 0) & ~np.isnan(y))
    raw, own = np.full(len(y), start), np.ascontiguousarray(x[:, used])
    while len(used) and len(trees) < s.max_iter and (not trees or trees[-1].depth > 0):
        if stops:
            losses.append(-_loss(job.loss, raw[aside], y[aside]) / max(len(aside), 1.0))
            if _settled(losses, s):
                break
        grower = Grower(s)
        for path, node in subtree("", own, *_derivatives(job.loss, raw[used], y[used]), categorical, s):
            grower.tell(path, node)
        trees.append(grower.finish())
        raw += trees[-1].value[trees[-1].leaves(x)]
    mean = np.exp(raw[recent]) if job.loss == "poisson" else raw[recent]
    return trees, np.array([np.abs(mean - y[recent]).sum(), len(recent)], float)


# --- blocks and passes ---------------------------------------------------------------------------------------------------------

_STATE = "x binary, y binary, part binary, raw binary"
RECENT, ASIDE = 1, 2


def _blocks(train: DataFrame, bins: Bins, targets: list[str], recent, aside) -> DataFrame:
    """Rows as blocks of bytes: bin numbers (features x rows), targets (targets x rows) and flags."""
    named = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(bins.numeric)]
    named += [F.col(c).cast("string").alias(f"f{i + len(named)}") for i, c in enumerate(bins.classes)]
    k = len(named)
    rows = train.select(*named, *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)], (F.when(recent, RECENT).otherwise(0) + F.when(aside, ASIDE).otherwise(0)).cast("tinyint").alias("part"))

    def pack(batches):
        held, size = [], 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            for i in range(0, len(table), BLOCK):
                part = table.slice(i, BLOCK)
                col = lambda j: part.column(j).combine_chunks()
                x = np.stack([bins.number(f, col(f)) for f in range(k)])
                y = np.stack([col(k + t).to_numpy(zero_copy_only=False).astype(float) for t in range(len(targets))])
                flags = col(k + len(targets)).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "y": [y.tobytes()], "part": [flags.tobytes()], "raw": [b""]}, schema=pa.schema([(c, pa.binary()) for c in ("x", "y", "part", "raw")]))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                yield from block()
                held, size = [], 0
        if size:
            yield from block()

    return rows.mapInArrow(pack, _STATE)


def tasks_of(spark, n: int) -> int:
    """Partitions for ``n`` rows."""
    return max(min(n // FEW_ROWS, spark.sparkContext.defaultParallelism), n // MANY_ROWS, 1)


def _open(r: tuple, features: int, targets: int, models: int):
    x, y, part, raw = r
    flags = np.frombuffer(part, np.uint8)
    n = len(flags)
    raw = np.frombuffer(raw, float).reshape(models, n) if raw else np.zeros((models, n))
    return np.frombuffer(x, np.uint8).reshape(features, n), np.frombuffer(y, float).reshape(targets, n), flags, raw


def _used(job: Job, stops: bool, flags: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows learnt from, rows that only judge when to stop)."""
    there = ~np.isnan(y) & (True if job.recent else (flags & RECENT) == 0)
    aside = there & ((flags & ASIDE) != 0) & stops
    return there & ~aside, aside


def _derivatives(loss: str, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.exp(raw) if loss == "poisson" else raw
    return mean - y, mean if loss == "poisson" else np.ones_like(raw)


def _loss(loss: str, raw: np.ndarray, y: np.ndarray) -> float:
    return float((np.exp(raw) - y * raw).sum() if loss == "poisson" else ((raw - y) ** 2).sum() / 2)


@dataclass
class Model:
    bins: Bins
    loss: str
    start: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(x.shape[1], self.start)
        for t in self.trees:
            raw += t.value[t.leaves(x)]
        return np.exp(raw) if self.loss == "poisson" else raw

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the prediction as column ``out``."""
        spark, k = df.sparkSession, len(self.bins.columns)
        prepare_workers(spark)
        sent = spark.sparkContext.broadcast(self)  # trees x nodes x 300 bytes

        @F.pandas_udf("double")
        def score(*columns):
            import pandas as pd

            m = sent.value
            return pd.Series(m.predict(np.stack([m.bins.number(f, pa.array(columns[f], from_pandas=True)) for f in range(k)])) if len(columns[0]) else [], dtype=float)

        return df.withColumn(out, score(*[F.col(c).cast("double") for c in self.bins.numeric], *[F.col(c).cast("string") for c in self.bins.classes]))


class Boost:
    """Blocks of one training table, and the fits that share their passes."""

    def __init__(self, train: DataFrame, numeric: list[str], classes: list[str], targets: list[str], recent=None, aside=None):
        prepare_workers(train.sparkSession)
        self.spark, self.targets = train.sparkSession, targets
        self.bins = find_bins(train, numeric, classes)
        n = train.count()
        tasks = tasks_of(self.spark, n)
        self.rows = cut(_blocks(train.repartition(tasks), self.bins, targets, F.lit(False) if recent is None else recent, F.lit(False) if aside is None else aside)).rdd.map(tuple)

    def _summed(self, state, run, jobs: list[Job], weights: dict[tuple, float]) -> list[tuple]:
        """(model, node, answer): tasks' sums added up by (model, node), or splits; ``run`` gives what a block adds.

        ``weights`` has the keys (model, node) with their rows: they are dealt to the reducers by these.  Nodes are 'n' and a path where sums
        come, 'r' and a path where rows do.
        """
        categorical, features, keep = len(self.bins.numeric), len(self.bins.columns), self._keep()
        load = [0.0] * max(1, min(len(weights), max(self.spark.sparkContext.defaultParallelism, int(sum(weights.values()) // MANY_ROWS))))
        place = {}
        for key, rows in sorted(weights.items(), key=lambda kv: (-kv[1], kv[0])):
            place[key] = load.index(min(load))
            load[place[key]] += rows + 1

        def tasks(number, blocks):
            total = {}
            for i, block in enumerate(blocks):
                for key, v in run(block):
                    if key[1][0] == "r":
                        total.setdefault(key, []).append((number, i, v))
                    elif key in total:
                        total[key] = [(number, 0, total[key][0][2] + v)]
                    else:
                        total[key] = [(number, 0, v)]
            return list(total.items())

        def answer(pair):
            (model, node), parts = pair[0], [v for *_, v in sorted(pair[1], key=lambda p: p[:2])]
            if node[0] == "r":
                x, g, h = (np.concatenate(c, axis=-1) for c in zip(*parts))
                return model, node, subtree(node[1:], x, g, h, categorical, jobs[model].setting)
            if node[0] == "n":
                hist = np.zeros((features * BINS, 3))
                hist[keep] = sum(parts)
                return model, node, [(node[1:], best_split(hist.reshape(features, BINS, 3), categorical, jobs[model].setting.min_samples_leaf, jobs[model].setting.l2))]
            return model, node, sum(parts)

        # at most a task's sums for each of these keys meet in a list, or SMALL rows; equal order of addition, so equal sums in every run
        met = state.mapPartitionsWithIndex(tasks).reduceByKey(lambda a, b: _few(a + b), len(load), lambda key: place.get(key, 0))
        return met.map(answer).collect()  # some hundred bytes for each node asked about

    def _keep(self) -> np.ndarray:
        """Places, among features x BINS, of the bins that rows can have."""
        used = [len(v) + (not self.bins.categorical(f)) for f, v in enumerate([*self.bins.numeric.values(), *self.bins.classes.values()])]
        return np.concatenate([f * BINS + np.append(np.arange(min(n, MISSING)), MISSING) for f, n in enumerate(used)])

    def _alone(self, jobs: list[Job], some: list[int], stops: list[bool], start: list[float]) -> dict[int, tuple[list[Tree], np.ndarray]]:
        """Trees and errors (see :func:`grown`) of the models ``some``, each fitted by a task that its rows are sent to."""
        k, t, m, categorical = len(self.bins.columns), len(self.targets), len(jobs), len(self.bins.numeric)
        place = {j: i for i, j in enumerate(some)}

        def send(number, blocks):
            for i, block in enumerate(blocks):
                x, y, flags, _ = _open(block, k, t, m)
                for j in some:
                    own = y[jobs[j].target]
                    there = ~np.isnan(own)
                    yield j, (number, i, x[:, there], own[there], flags[there])

        def grow(pairs):
            parts = {}
            for j, part in pairs:
                parts.setdefault(j, []).append(part)
            while parts:
                j, own = parts.popitem()
                rows = [np.concatenate(c, axis=-1) for c in list(zip(*sorted(own, key=lambda p: p[:2])))[2:]]
                yield j, grown(*rows, jobs[j], stops[j], start[j], categorical)

        # trees x nodes x 300 bytes a model
        return dict(self.rows.mapPartitionsWithIndex(send).partitionBy(len(some), place.get).mapPartitions(grow).collect())

    def fit(self, jobs: list[Job], alone: int = 0) -> tuple[list[Model], list[float | None]]:
        """Models of all jobs and their mean absolute errors on the recent rows (None without such rows).

        A model whose target is known in at most ``alone`` rows is fitted by one task, others by passes.
        """
        k, t, m = len(self.bins.columns), len(self.targets), len(jobs)
        one = lambda kind: {(j, kind): 1 for j in range(m)}

        def counts(r):
            _, y, flags, _ = _open(r, k, t, m)
            for j, job in enumerate(jobs):
                rows, recent = _used(job, False, flags, y[job.target])[0], (flags & RECENT) != 0
                learnt = rows & ((flags & ASIDE) == 0)
                own = y[job.target]
                yield (j, "counts"), np.array([rows.sum(), own[rows].sum(), learnt.sum(), own[learnt].sum(), (recent & ~np.isnan(own)).sum()], float)

        known = {j: v for j, _, v in self._summed(self.rows, counts, jobs, one("counts"))}
        known = [known.get(j, np.zeros(5)) for j in range(m)]
        stops = [c[0] > job.setting.stop_from and c[0] > c[2] > 0 for c, job in zip(known, jobs)]
        models = []
        for c, stop, job in zip(known, stops, jobs):
            n, total = (c[2], c[3]) if stop else (c[0], c[1])
            mean = total / n if n else 0.0
            models.append(Model(self.bins, job.loss, float(np.log(max(mean, 1e-15))) if job.loss == "poisson" else float(mean)))
        start = [x.start for x in models]
        live = {j for j in range(m) if known[j][0] > 0 and jobs[j].setting.max_iter > 0}
        judged = {}
        if few := [j for j in sorted(live) if known[j][0] + (0 if jobs[j].recent else known[j][4]) <= alone]:
            done = self._alone(jobs, few, stops, start)
            for j in few:
                models[j].trees, judged[j] = done[j]
            live -= set(few)
            if len(few) == m:
                return models, [_mean(judged.get(j)) for j in range(m)]
        losses: list[list[float]] = [[] for _ in jobs]
        state, held, fresh, rounds = self.rows, None, {}, 0
        while True:
            # the finished trees are added to the blocks' raw values, and the next trees' roots are summed in the same pass
            state = state.map(_add(k, t, m, start if held is None else None, dict(fresh))).persist(StorageLevel.MEMORY_AND_DISK)
            if rounds and rounds % KEPT_ROUNDS == 0:
                state.checkpoint()  # written by the pass below: lineage is this many rounds at most
            growers = {j: Grower(jobs[j].setting) for j in live}
            learnt = {j: known[j][2 if stops[j] else 0] for j in live}
            ask, first, left_out = {j: [""] for j in live}, True, set()
            while ask:
                plans, weights = {}, {(j, "loss"): 1 for j in live if first and stops[j]}
                for j, paths in ask.items():
                    nodes = growers[j].nodes
                    rows = {p: nodes[p].n if p in nodes else learnt[j] for p in paths}
                    above = {p[:i]: (nodes[p[:i]].feature, nodes[p[:i]].left) for p in paths for i in range(len(p))}
                    plans[j] = ({p: ("r" if n <= SMALL else "n") + p for p, n in rows.items()}, above)
                    weights |= {(j, plans[j][0][p]): n if n <= SMALL else 0 for p, n in rows.items()}
                for j, node, found in self._summed(state, _asked(jobs, stops, plans, k, t, m, first, self._keep()), jobs, weights):
                    if node == "loss":
                        losses[j].append(-found[0] / max(found[1], 1.0))
                    else:
                        for path, split in found:
                            growers[j].tell(path, split)
                if first:
                    left_out = {j for j in live if stops[j] and _settled(losses[j], jobs[j].setting)}
                first = False
                ask = {j: w for j in live - left_out if (w := growers[j].wanted())}
            if held is not None:
                held.unpersist()
            held, live, rounds = state, live - left_out, rounds + 1
            fresh = {j: growers[j].finish() for j in live}
            for j, tree in fresh.items():
                models[j].trees.append(tree)
            live = {j for j in live if len(models[j].trees) < jobs[j].setting.max_iter and fresh[j].depth > 0}
            if not fresh:
                break
            if not live:
                state = state.map(_add(k, t, m, None, dict(fresh)))
                break

        def errors(r):
            _, y, flags, raw = _open(r, k, t, m)
            for j, job in enumerate(jobs):
                rows = ((flags & RECENT) != 0) & ~np.isnan(y[job.target])
                mean = np.exp(raw[j][rows]) if job.loss == "poisson" else raw[j][rows]
                yield (j, "error"), np.array([np.abs(mean - y[job.target][rows]).sum(), rows.sum()], float)

        judged = {j: v for j, _, v in self._summed(state, errors, jobs, one("error"))} | judged
        if held is not None:
            held.unpersist()
        return models, [_mean(judged.get(j)) for j in range(m)]


def _mean(sums: np.ndarray | None) -> float | None:
    return float(sums[0] / sums[1]) if sums is not None and sums[1] else None


def _add(features: int, targets: int, models: int, start: list[float] | None, trees: dict[int, Tree]):
    """Blocks with the values of finished trees added (and the start values, in the first round)."""
    def run(r):
        x, _, _, raw = _open(r, features, targets, models)
        raw = raw.copy()
        if start is not None:
            raw += np.array(start)[:, None]
        for j, tree in trees.items():
            raw[j] += tree.value[tree.leaves(x)]
        return *r[:3], raw.tobytes()

    return run


def _few(parts: list[tuple]) -> list[tuple]:
    """Tasks' sums by number, neighbours added once there are many: memory of a key stays that of some sums.  Rows stay as they are."""
    if len(parts) <= 64 or isinstance(parts[0][2], tuple):
        return parts
    parts = sorted(parts, key=lambda p: p[:2])
    return [(*parts[i][:2], sum(v for *_, v in parts[i : i + 8])) for i in range(0, len(parts), 8)]


def _reached(x: np.ndarray, rows: np.ndarray, paths, above: dict) -> dict[str, np.ndarray]:
    """Which of ``rows`` are in each node of ``paths``; ``above`` has (feature, bins that go left) of the nodes above them."""
    out, open_ = {}, [("", rows)]
    while open_:
        p, own = open_.pop()
        if p in paths:
            out[p] = own
        elif p in above:
            feature, left = above[p]
            goes = left[x[feature][own]]
            open_ += [(p + "L", own[goes]), (p + "R", own[~goes])]
    return out


def _asked(jobs: list[Job], stops: list[bool], plans: dict, features: int, targets: int, models: int, first: bool, keep: np.ndarray):
    """A block's sums for the large asked nodes of each model, its rows in the small ones, and in a round's first pass its loss on the rows put aside."""
    def run(r):
        x, y, flags, raw = _open(r, features, targets, models)
        for j, (paths, above) in plans.items():
            job, own = jobs[j], y[jobs[j].target]
            used, aside = _used(job, stops[j], flags, own)
            if first and stops[j]:
                yield (j, "loss"), np.array([_loss(job.loss, raw[j][aside], own[aside]), aside.sum()], float)
            reached = {p: rows for p, rows in _reached(x, np.flatnonzero(used), paths, above).items() if len(rows)}
            large = [p for p in reached if paths[p][0] == "n"]
            for p in reached:
                if paths[p][0] == "r":
                    rows = reached[p]
                    yield (j, paths[p]), (x[:, rows], *_derivatives(job.loss, raw[j][rows], own[rows]))
            if large:
                rows, slot = np.concatenate([reached[p] for p in large]), np.repeat(np.arange(len(large)), [len(reached[p]) for p in large])
                sums = _sums(x[:, rows], *_derivatives(job.loss, raw[j][rows], own[rows]), len(large), slot)
                for i, p in enumerate(large):
                    yield (j, paths[p]), sums[:, i].reshape(-1, 3)[keep]

    return run


def _settled(scores: list[float], s: Setting) -> bool:
    """No score of the last ``patience`` rounds beats the one before them."""
    if len(scores) <= s.patience:
        return False
    return not any(v > scores[-s.patience - 1] + s.tolerance for v in scores[-s.patience:])
