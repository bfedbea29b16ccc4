"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of two learnt vectors, picked by the hash of the lower-cased word and by the
hash of its first bytes (inflected insults share a stem).  Filters one, two and three words
wide slide over the whole text, each keeps its largest response, and a logistic layer turns
these into the score.  The first channel of the vectors starts at the evidence of the training
rows (log-likelihood ratio beyond chance), the rest at small random values; everything is then trained by Adagrad.

Training reads every labelled row that is not held out: rows are dealt into shards of about ``SHARD`` by a hash of the id, each
shard is passed once in a task from the common weights, and the changes are averaged (of a vector: over the shards that moved it) after every epoch.
Counts of the starting evidence and of the thresholds are sums over all these rows.  ``most_rows`` and ``most_bytes`` bound them only if they are
given.  Scoring reads every whole text.  Language, source, id and labels
are no inputs of a score.  A decision threshold is calibrated per language on a fifth of the
training rows, on which the weights of a second model were not fitted (``least`` positives needed, else the default).

Null and empty texts get the score of a text without words.  Without labels of both kinds the
score is the share of positive labels (0 if there are none).  Repeated labels of an id count as
toxic if one of them is.  Repeated rows get equal scores; clashing column names do not matter.
"""
from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewheel.llm import shared, text as tx

BITS = 15
STEM = 4
DIM = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
SHARD, SHARD_BYTES = 8192, 1 << 27  # rows and bytes of text of a shard
SLICE = 1 << 14  # numbers of a sum that travel in one row


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((words + padding) x 2 table rows, first position of each document; n + 1).  The last row of a table is zero."""
    low, starts, ends, first = tx.words(raw, offs)
    n = len(offs) - 1
    at = first + PAD * np.arange(n + 1)
    out = np.full((at[-1], 2), 1 << BITS, np.int32)
    if len(starts):
        to = np.arange(len(starts)) + PAD * np.repeat(np.arange(n), np.diff(first))
        shift = np.uint64(64 - BITS)
        out[to, 0] = tx.span_hashes(low, starts, ends) >> shift
        out[to, 1] = tx.span_hashes(low, starts, np.minimum(ends, starts + STEM)) >> shift
    return out, at


@dataclass
class Model:
    """Weights; picklable, about 2 MB."""

    prior: float = 0.0
    trained: bool = False
    tables: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    biases: list = field(default_factory=list)
    top: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    top_bias: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def vectors(self, idx: np.ndarray) -> np.ndarray:
        return self.tables[0][idx[:, 0]] + self.tables[1][idx[:, 1]]

    def responses(self, x: np.ndarray, k: int) -> np.ndarray:
        n = len(x)
        z = x @ self.filters[k][0]
        for j in range(1, WIDTHS[k]):
            z[: n - j] += x[j:] @ self.filters[k][j]
        return z

    def logits(self, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = self.vectors(idx)
        pooled = [np.maximum(np.maximum.reduceat(self.responses(x, k), at[:-1], axis=0) + self.biases[k], 0) for k in range(len(WIDTHS))]
        return np.concatenate(pooled, axis=1) @ self.top + self.top_bias

    def score(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if not self.trained:
            return np.full(n, self.prior)
        idx, at = features(raw, offs)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.logits(idx, at).astype(np.float64)))


def _evidence(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """(column, label, table row): documents that have it."""
    counts = np.zeros((2, 2, (1 << BITS) + 1))
    for d, label in zip(docs, y):
        for c in range(2):
            counts[c, int(label), np.unique(d[:, c])] += 1
    return counts


def _initial(told: np.ndarray, neg: float, pos: float, rng, evidence: bool = True) -> Model:
    m = Model(prior=float(pos / (pos + neg)), trained=True)
    for counts in told:
        expected = counts.sum(axis=0) * np.array([[neg], [pos]]) / (pos + neg)
        with np.errstate(divide="ignore", invalid="ignore"):
            proof = 2 * np.where(counts > 0, counts * np.log(counts / expected), 0).sum(axis=0)
        proof[counts[1] < expected[1]] *= -1
        table = rng.normal(0, 0.02 if evidence else 0.3, ((1 << BITS) + 1, DIM)).astype(np.float32)
        table[:, 0] += evidence * np.clip(np.sign(proof) * np.maximum(np.abs(proof) - 8, 0) / 12, -0.5, 1)
        table[-1] = 0
        m.tables.append(table)
    for w in WIDTHS:
        f = rng.normal(0, 0.2 if evidence else (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32)
        if evidence:
            f[0, 0] = np.abs(f[0, 0]) + 0.5
        m.filters.append(f)
        m.biases.append(np.full(FILTERS, -0.5 if evidence else 0.0, np.float32))
    m.top = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
    m.top_bias = -1.0
    return m


class Fit:
    """Weights while they are trained, with Adagrad's sums; passed between driver and tasks after each epoch."""

    def __init__(self, told: np.ndarray, neg: float, pos: float, evidence: bool, seed: int = 5):
        self.m = _initial(told, neg, pos, np.random.default_rng(seed), evidence)
        self.seen = [np.full_like(p, 1e-2) for p in self._dense()]
        self.rows_seen = [np.full_like(t, 1e-2) for t in self.m.tables]
        self.bias_seen = 1e-2
        self.heavy = min(4.0, max(1.0, neg / max(1, pos) / 2))

    def _dense(self) -> list[np.ndarray]:
        return [*self.m.filters, *self.m.biases, self.m.top]

    def _flat(self) -> list[np.ndarray]:
        return [np.asarray(v, np.float64) for v in (*self._dense(), *self.seen, self.m.top_bias, self.bias_seen)]

    def epoch(self, docs: list[np.ndarray], y: np.ndarray, rng, batch: int = 32, rate: float = 0.05) -> tuple:
        """One pass over a shard, from these weights (which move); the changes, to be summed: rows, dense, and for each table [values, their sums, shards that moved them]."""
        was, tables, sums = self._flat(), [t.copy() for t in self.m.tables], [r.copy() for r in self.rows_seen]
        m, dense, seen, rows_seen, bias_seen = self.m, self._dense(), self.seen, self.rows_seen, self.bias_seen
        y = np.asarray(y, np.float32)
        weight = np.where(y > 0, self.heavy, 1.0)
        order = rng.permutation(len(docs))
        for b in range(0, len(order), batch):
            own = order[b : b + batch]
            sizes = np.array([len(docs[i]) for i in own])
            at = np.concatenate([[0], np.cumsum(sizes)])
            idx = np.concatenate([docs[i] for i in own]).astype(np.int32)
            x = m.vectors(idx)
            best, pooled = [], []
            for k in range(len(WIDTHS)):
                z = m.responses(x, k)
                arg = np.stack([z[s:e].argmax(axis=0) + s for s, e in zip(at, at[1:])])
                best.append(arg)
                pooled.append(np.take_along_axis(z, arg, axis=0) + m.biases[k])
            act = np.maximum(np.concatenate(pooled, axis=1), 0)
            p = 1 / (1 + np.exp(-(act @ m.top + m.top_bias)))
            g = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
            back = g[:, None] * m.top[None] * (act > 0)
            grads = [np.zeros_like(q) for q in dense]
            grads[-1] = act.T @ g + 1e-4 * m.top
            touched, moves = [], []
            for k, w in enumerate(WIDTHS):
                gk = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[len(WIDTHS) + k] = gk.sum(axis=0)
                for j in range(w):
                    pos = np.minimum(best[k] + j, len(x) - 1)
                    grads[k][j] = np.einsum("bfd,bf->df", x[pos], gk)
                    touched.append(pos.reshape(-1))
                    moves.append((gk[:, :, None] * m.filters[k][j].T[None]).reshape(-1, DIM))
            touched, moves = np.concatenate(touched), np.concatenate(moves)
            live = np.abs(moves).max(axis=1) > 0
            for c in range(2):
                rows, back_to = np.unique(idx[touched[live], c], return_inverse=True)
                step = np.zeros((len(rows), DIM), np.float32)
                np.add.at(step, back_to.reshape(-1), moves[live])
                step[rows == 1 << BITS] = 0
                rows_seen[c][rows] += step**2
                m.tables[c][rows] -= rate * step / np.sqrt(rows_seen[c][rows])
            for q, s, d in zip(dense, seen, grads):
                s += d**2
                q -= rate * d / np.sqrt(s)
            bias_seen += float(g.sum()) ** 2
            m.top_bias -= rate * float(g.sum()) / bias_seen**0.5
        self.bias_seen = bias_seen
        moved = [[t - a, r - b, ((t != a) | (r != b)).any(axis=1).astype(np.float32)] for t, a, r, b in zip(m.tables, tables, rows_seen, sums)]
        n = len(docs)
        return n, [n * (v - w) for v, w in zip(self._flat(), was)], *moved

    def move(self, change: list) -> None:
        """Take in the summed changes of all shards: means by rows, of table rows over the shards that moved them."""
        n, dense, *tables = change
        parts = [*self._dense(), *self.seen]
        for p, d in zip(parts, dense):
            p += (d / n).astype(np.float32)
        self.m.top_bias += float(dense[-2]) / n
        self.bias_seen += float(dense[-1]) / n
        for t, r, (dt, dr, k) in zip(self.m.tables, self.rows_seen, tables):
            k = np.maximum(k, 1)[:, None]
            t += (dt / k).astype(np.float32)
            r += (dr / k).astype(np.float32)


def _flattened(change: tuple) -> list[np.ndarray]:
    """The changes of :meth:`Fit.epoch` as flat arrays, which may be added up shard by shard."""
    n, dense, *tables = change
    return [np.array([n], np.float64), np.concatenate([np.ravel(d) for d in dense]), *(np.ravel(v) for t in tables for v in t)]


def _unflattened(flat: list[np.ndarray], fit: Fit) -> list:
    """Sums of flat arrays in the form that :meth:`Fit.move` takes."""
    shapes = [np.shape(v) for v in fit._flat()]
    to = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    dense = [v.reshape(s) for v, s in zip(np.split(flat[1], to), shapes)]
    tables = [[flat[i].reshape(-1, DIM), flat[i + 1].reshape(-1, DIM), flat[i + 2]] for i in (2, 5)]
    return [float(flat[0][0]), dense, *tables]


def opened(batches) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(table rows of each text, toxic, aside) of a shard; the first are views of the batches, not copies."""
    x, y, aside = [], [np.zeros(0, np.float32)], [np.zeros(0, bool)]
    for batch in batches:
        col = batch.column(2)
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1].tolist()
        x += [np.frombuffer(data, np.uint16, (e - s) // 2, s).reshape(-1, 2) for s, e in zip(offs, offs[1:])]
        y.append(batch.column(0).to_numpy().astype(np.float32))
        aside.append(batch.column(1).to_numpy(zero_copy_only=False))
    return x, np.concatenate(y), np.concatenate(aside)


def summed(dealt: DataFrame, each) -> dict:
    """Sums by key, over all shards, of the flat arrays that ``each(shard, x, toxic, aside)`` yields as (key, array).

    Arrays travel in slices, and a slice is added up shard by shard, so a task holds one of them and the driver one shard's worth
    of numbers, however many shards there are.  All is done in Arrow, as elsewhere: executors keep other Python workers, and their
    memory, for functions of RDDs.
    """
    names = ["key", "at", "shard", "wide", "part"]

    def tell(batches):
        shard = TaskContext.get().partitionId()
        held = opened(batches)
        for key, v in each(shard, *held) if held[0] else ():
            at = range(0, len(v), SLICE)
            cols = [[key] * len(at), list(at), [shard] * len(at), [v.dtype == np.float64] * len(at), [v[s : s + SLICE].tobytes() for s in at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=names)

    def add(batches):
        def told(last, total):
            cols = [[last[0]], [last[1]], [total.dtype == np.float64], [total.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["key", "at", "wide", "part"])

        last, total = None, None
        for batch in batches:
            for key, at, wide, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                v = np.frombuffer(part, np.float64 if wide else np.float32)
                if (key, at) == last:
                    total += v
                    continue
                if last is not None:
                    yield told(last, total)
                last, total = (key, at), v.copy()
        if last is not None:
            yield told(last, total)

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.mapInArrow(tell, "key int, at int, shard int, wide boolean, part binary").repartition(n, "key", "at").sortWithinPartitions("key", "at", "shard")
    found: dict = {}
    for r in sorted(rows.mapInArrow(add, "key int, at int, wide boolean, part binary").toArrow().to_pylist(), key=lambda r: (r["key"], r["at"])):
        found.setdefault(r["key"], []).append(np.frombuffer(r["part"], np.float64 if r["wide"] else np.float32))
    return {k: np.concatenate(v) for k, v in found.items()}


def held_out(doc_id):
    """True for the third of the ids that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


CUTS = sorted({*np.round(np.linspace(0.3, 0.9, 25), 3).tolist()})


def fit(docs: DataFrame, labels: DataFrame, most_rows: int | None = None, least: int = 25, default: float = 0.7, most_bytes: int | None = None, epochs: int = 4, evidence: bool = True) -> Model:
    """Train on all labelled rows that are not held out and calibrate thresholds; of repeated ids one row, the one of the least text hash.

    Only if they are given: half of ``most_rows`` ids of each label, the least by a hash; then, in the order of the hash, rows until
    ``most_bytes`` of text, none of more than a sixteenth of it.  The driver holds weights and sums, about 10 MB a model, and no row.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    told = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    told = told.filter(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id", F.lit(3)))
    if most_rows is not None:
        half = told.filter("toxic = 1").orderBy("draw", "doc_id").limit(most_rows // 2)
        told = half.unionByName(told.filter("toxic <> 1").orderBy("draw", "doc_id").limit(most_rows // 2))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).join(told, "doc_id")
    if most_bytes is not None:
        found = found.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 16)
    one = found.groupBy("doc_id", "draw", "toxic").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("text"), "lang")).alias("t"))
    rows = one.select("doc_id", "draw", "toxic", "t.lang", "t.text")
    if most_bytes is not None:
        rows = shared.materialise(rows, "labelled")
        order = W.orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, 0)  # a row for each of the sample, without texts
        upto = rows.select("doc_id", "draw", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).withColumn("upto", F.sum("bytes").over(order))
        rows = rows.join(upto.filter(F.col("upto") <= most_bytes).select("doc_id"), "doc_id")

    def look(batches):
        for batch in batches:
            out = []
            for _, _, raw, offs in tx.chunks(batch.column(4)):
                idx, at = features(raw, offs)
                out += [idx[s:e].astype(np.uint16).tobytes() for s, e in zip(at, at[1:])]
            aside = tx.mix(batch.column(0).to_numpy().astype(np.uint64) + np.uint64(11)) % np.uint64(5) == 0
            cols = [batch.column(0), batch.column(1), pa.array([int(v > 0) for v in batch.column(2).to_pylist()], pa.int32()), batch.column(3), pa.array(aside), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "draw", "toxic", "lang", "aside", "x"])

    rows = rows.select("doc_id", "draw", "toxic", "lang", "text").mapInArrow(look, "doc_id long, draw long, toxic int, lang string, aside boolean, x binary")
    table = shared.materialise(rows, "labelled")
    got = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("x").cast("long")).alias("size"), F.sum("toxic").alias("pos"), F.count_if("aside").alias("a"), F.sum(F.when(F.col("aside"), F.col("toxic")).otherwise(0)).alias("ap")).first()
    pos, left, left_pos = got.pos or 0, got.n - got.a, (got.pos or 0) - (got.ap or 0)
    kinds = [(got.n, pos, False), (left, left_pos, True)]  # all rows, and those that are not aside
    if not got.n or pos in (0, got.n):
        shared.drop_table(table)
        return Model(prior=pos / got.n if got.n else 0.0, thresholds={None: default})
    shards = max(1, got.n // SHARD, got.size // SHARD_BYTES)
    dealt = table.repartition(shards, "draw").sortWithinPartitions("doc_id").select("toxic", "aside", "x").persist()

    def counted(_, x, y, aside):
        for i, own in enumerate((np.arange(len(x)), np.flatnonzero(~aside))):
            yield i, _evidence([x[j] for j in own], y[own]).ravel()

    first = summed(dealt, counted)
    fits = [Fit(first[i].reshape(2, 2, -1), n - p, p, evidence) if 0 < p < n else None for i, (n, p, _) in enumerate(kinds)]
    for k in range(epochs):
        sent = spark.sparkContext.broadcast(fits)  # fixed size

        def one_epoch(shard, x, y, aside):
            for i, (f, (_, _, without)) in enumerate(zip(sent.value, kinds)):
                own = np.flatnonzero(~aside) if without else np.arange(len(x))
                if f is not None and len(own):
                    # a worker's broadcast may serve other shards too
                    change = copy.deepcopy(f).epoch([x[j] for j in own], y[own], np.random.default_rng([5, k, shard]))
                    yield from ((8 * i + j, v) for j, v in enumerate(_flattened(change)))

        change = summed(dealt, one_epoch)
        for i, f in enumerate(fits):
            if f is not None:
                f.move(_unflattened([change[8 * i + j] for j in range(8)], f))
        del change
        sent.destroy()
    dealt.unpersist()
    model = fits[0].m
    if fits[1] is not None:
        model.thresholds |= _thresholds(table, fits[1].m, least, default)
    model.thresholds[None] = default
    shared.drop_table(table)
    return model


def _thresholds(table: DataFrame, probe: Model, least: int, default: float) -> dict:
    """The cut of each language with ``least`` positives: the best F1 over its rows put aside, nearest to the default among equals."""
    cuts = sorted({default, *CUTS})
    sent = table.sparkSession.sparkContext.broadcast(probe)

    def judge(batches):
        for batch in batches:
            s = []
            with np.errstate(over="ignore"):
                for b in batch.column(2).to_pylist():
                    d = np.frombuffer(b, np.uint16).reshape(-1, 2).astype(np.int32)
                    s.append(1 / (1 + np.exp(-float(sent.value.logits(d, np.array([0, len(d)]))[0]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["lang", "toxic", "s"])

    rows = table.filter("aside AND lang IS NOT NULL").select("lang", "toxic", "x").mapInArrow(judge, "lang string, toxic int, s double")
    hits = [F.count_if(F.col("s") >= c).alias(f"h{i}") for i, c in enumerate(cuts)] + [F.count_if((F.col("s") >= c) & (F.col("toxic") > 0)).alias(f"t{i}") for i, c in enumerate(cuts)]
    out = {}
    for r in rows.groupBy("lang").agg(F.sum("toxic").alias("pos"), *hits).filter(F.col("pos") >= least).collect():
        best, cut = -1.0, default
        for i in sorted(range(len(cuts)), key=lambda i: abs(cuts[i] - default)):
            f1 = 2 * r[f"t{i}"] / max(1, r[f"h{i}"] + r.pos)
            if f1 > best + 1e-9:
                best, cut = f1, float(cuts[i])
        out[r.lang] = cut
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) and flagged (the language's threshold)."""
    spark = docs.sparkSession
    shared.prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # fixed size, about 2 MB
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))

    def apply(batches):
        m = sent.value
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for i, j, raw, offs in tx.chunks(batch.column(1), 1 << 18):
                s[i:j] = m.score(raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s)], names=["doc_id", "lang", "score"])

    cuts = {k: v for k, v in model.thresholds.items() if k is not None}
    cut = F.lit(model.thresholds.get(None, 0.7))
    for k, v in cuts.items():
        cut = F.when(F.col("lang") == k, F.lit(v)).otherwise(cut)
    return rows.mapInArrow(apply, "doc_id long, lang string, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"),
    )


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not flag under their language's threshold."""
    spark = docs.sparkSession
    shared.prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # fixed size, about 2 MB
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def keep(batches):
        m = sent.value
        default = m.thresholds.get(None, 0.7)
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for i, j, raw, offs in tx.chunks(batch.column(at), 1 << 18):
                s[i:j] = m.score(raw, offs)
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
            cut = np.array([m.thresholds.get(v, default) for v in langs])
            yield batch.filter(pa.array(s < cut, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
