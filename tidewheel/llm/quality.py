"""Quality: a regularised quadratic discriminant over document statistics.

Every document is described by some twenty statistics of its whole text (:data:`STATISTICS`): shares of kinds of characters, word
lengths, and how much of it repeats (words, neighbouring words, lines).  Shares are taken to logits, counts to logarithms, all are
centred, scaled and held within ``REACH`` deviations.  Each class has a mean and a covariance, shrunk towards the
pooled one and towards a sphere by amounts that cross-validation picks; a score is the difference of the two log densities, whose
Mahalanobis terms use each covariance's Cholesky factor, kept inverted in the model.  A logistic curve, fitted on
the cross-validated differences, turns that into 0 to 1.

Statistics are computed once for every document and kept as a small table; fitting reads those of labelled documents that are not
held out, at most ``most_rows`` of them (half of either label, the least by a hash of the id), about 200 bytes each at the driver.
Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts get the score of a text of no words.  Without labels of both kinds (two rows of each at least) the score is
the share of good labels (0 without any).  Repeated labels of an id count as good only if all are; of repeated ids each row is
described, one (of the least statistics) is learnt from.  Equal texts get equal scores; very long texts are read whole; an empty table gives
no rows; columns of other names do not matter.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm import shared, text as tx

# name: how it is brought near a normal distribution
STATISTICS = {
    "chars": "log", "words": "log", "word_length": "log", "word_spread": "log", "line_words": "log", "sentence_words": "log",
    "upper": "share", "capitalised": "share", "digits": "share", "spaces": "share", "stops": "share", "marks": "share", "beyond_ascii": "share",
    "long_words": "share", "distinct_words": "power", "distinct_pairs": "power", "repeats": "share", "commonest": "share", "copied_lines": "share", "marked_words": "share",
}
EPS = 0.004  # what a share of 0 counts as
REACH = 6.0
SHRINK = (0.0, 0.05, 0.2, 0.5, 0.9)
SPHERE = (0.003, 0.03, 0.2)
FOLDS = 5

_STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:?'\"()-", np.uint8))
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_FOLLOWS = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
_LEADS = np.arange(256) >= 0xC0
_MARK = (np.arange(256) > 32) & (np.arange(256) < 127) & ~_STOPS & ~tx.IS_WORD & ~_UPPER


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set flags of each document."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offs[1:]] - upto[offs[:-1]]


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, occurrences of the commonest one) of each document."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(k))))
    return np.bincount(d[at], minlength=n), most


def describe(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Transformed statistics (documents x STATISTICS) of whole texts."""
    n = len(offs) - 1
    low, starts, ends, first = tx.words(raw, offs)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    chars = np.diff(offs) - _sums(_FOLLOWS[raw], offs)
    some, letters = np.maximum(words, 1), np.maximum(_sums(_UPPER[raw] | _LEADS[raw] | ((raw >= 97) & (raw <= 122)), offs), 1)
    lead = np.concatenate([[0], np.cumsum(~_FOLLOWS[low], dtype=np.int64)])
    size = lead[ends] - lead[starts]
    total, squares = np.bincount(doc, size, n), np.bincount(doc, size.astype(float) ** 2, n)
    spread = np.sqrt(np.maximum(squares / some - (total / some) ** 2, 0))
    key = tx.span_hashes(low, starts, ends)
    kinds, most = _distinct(key, doc, n)
    same_doc = doc[1:] == doc[:-1]
    pairs, _ = _distinct(tx.mix(key[:-1])[same_doc] ^ key[1:][same_doc], doc[:-1][same_doc], n) if len(key) > 1 else (np.zeros(n, np.int64), None)
    again = np.bincount(doc[1:][same_doc & (key[1:] == key[:-1])], minlength=n)

    # lines: ends at \n and at a document's end; those of blanks alone do not count
    inner = np.flatnonzero(raw == 10)
    line_at = np.unique(np.concatenate([offs[:-1], inner + 1]))
    line_at = line_at[line_at < len(raw)]
    line_end = np.append(line_at[1:], len(raw))
    line_end = line_end - ((line_end > line_at) & (raw[line_end - 1] == 10)) if len(line_at) else line_end
    full = line_end > line_at
    line_at, line_end = line_at[full], line_end[full]
    line_doc = np.searchsorted(offs, line_at, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)
    own_lines, _ = _distinct(tx.span_hashes(low, line_at, line_end), line_doc, n)

    marked = (np.append(raw, 32)[ends] < 128) & _MARK[np.append(raw, 32)[ends]] & (np.searchsorted(offs, ends, side="right") - 1 == doc) if len(ends) else np.zeros(0, bool)
    part = lambda flags: _sums(flags[raw], offs) / np.maximum(chars, 1)
    per_word = lambda flag: np.bincount(doc, flag, n) / some
    x = {
        "chars": chars, "words": words, "word_length": total / some, "word_spread": spread, "line_words": words / np.maximum(lines, 1),
        "sentence_words": words / (1 + _sums(_ENDS[raw], offs)), "upper": _sums(_UPPER[raw], offs) / letters, "capitalised": per_word(_UPPER[raw[starts]] if len(starts) else np.zeros(0)),
        "digits": part(_DIGIT), "spaces": part(_SPACE), "stops": part(_STOPS), "marks": part(_MARK), "beyond_ascii": part(_LEADS), "long_words": per_word(size > 12),
        # Herdan's exponents: of 1 for no repeats, whatever the length
        "distinct_words": np.log1p(kinds) / np.log1p(some), "distinct_pairs": np.log1p(pairs) / np.log1p(np.maximum(words - 1, 1)),
        "repeats": again / np.maximum(words - 1, 1), "commonest": np.maximum(most - 1, 0) / some, "copied_lines": 1 - own_lines / np.maximum(lines, 1), "marked_words": per_word(marked),
    }
    out = np.empty((n, len(STATISTICS)))
    for i, (name, how) in enumerate(STATISTICS.items()):
        v = np.asarray(x[name], float)
        out[:, i] = np.log1p(v) if how == "log" else np.log((v + EPS) / (1 - np.minimum(v, 1) + EPS)) if how == "share" else v
    return out


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the transformed statistics of every whole text, computed lazily."""
    shared.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, raw, offs in tx.chunks(batch.column(1)):
                x = describe(raw, offs)
                at = pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], names=["doc_id", "x"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Two Gaussians with inverted Cholesky factors; picklable, some kilobytes."""

    prior: float = 0.0
    trained: bool = False
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    means: list = field(default_factory=list)
    factors: list = field(default_factory=list)  # inverse of the lower Cholesky factor
    logdets: list = field(default_factory=list)
    curve: tuple = (1.0, 0.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -REACH, REACH)

    def difference(self, z: np.ndarray) -> np.ndarray:
        """log density of a good text less that of a bad one, of scaled statistics."""
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return _logistic(self.curve, _calm(self.difference(self.scaled(x))))


def _calm(d: np.ndarray) -> np.ndarray:
    """Differences of hundreds, brought together without losing their order."""
    return np.arcsinh(d)


def _logistic(curve: tuple, d: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(curve[0] * d + curve[1])))


def _gaussians(z: np.ndarray, y: np.ndarray, shrink: float, sphere: float) -> tuple[list, list, list]:
    d = z.shape[1]
    means = [z[y == c].mean(axis=0) for c in (0, 1)]
    own = [np.cov(z[y == c].T, bias=True).reshape(d, d) for c in (0, 1)]
    pooled = sum((y == c).mean() * s for c, s in enumerate(own))
    factors, logdets = [], []
    for s in own:
        s = (1 - shrink) * s + shrink * pooled
        s = (1 - sphere) * s + sphere * max(np.trace(s) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(low.diagonal()).sum())
    return means, factors, logdets


def _curve(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never below a small positive one) and intercept of the logistic curve of least loss, by Newton steps with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = np.clip(_logistic((a, b), d), 1e-9, 1 - 1e-9)
        w = p * (1 - p)
        ga, gb = ((p - y) * d).sum() + (a - 1), (p - y).sum() + 1e-3 * b
        haa, hab, hbb = (w * d * d).sum() + 1, (w * d).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if max(abs(da), abs(db)) < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
    """Fit on statistics, labels (0, 1) and a fold number of each row; shrinkage of the least cross-validated logistic loss."""
    y = np.asarray(y, int)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    m = Model(prior=float(y.mean()), trained=True, centre=x.mean(axis=0), scale=np.maximum(x.std(axis=0), 1e-3))
    z = m.scaled(x)
    best = (np.inf, SHRINK[-1], SPHERE[-1], (1.0, 0.0))
    for shrink in SHRINK:
        for sphere in SPHERE:
            d, seen = np.zeros(len(y)), np.zeros(len(y), bool)
            for k in range(FOLDS):
                past, now = fold != k, fold == k
                if now.any() and min((y[past] == 0).sum(), (y[past] == 1).sum()) >= 2:
                    part = Model(trained=True)
                    part.means, part.factors, part.logdets = _gaussians(z[past], y[past], shrink, sphere)
                    d[now], seen[now] = _calm(part.difference(z[now])), True
            if not seen.any():
                continue
            curve = _curve(d[seen], y[seen])
            p = np.clip(_logistic(curve, d[seen]), 1e-12, 1 - 1e-12)
            loss = -np.where(y[seen] == 1, np.log(p), np.log(1 - p)).mean()
            if loss < best[0] - 1e-12:
                best = (loss, shrink, sphere, curve)
    m.means, m.factors, m.logdets = _gaussians(z, y, best[1], best[2])
    m.curve = best[3]
    return m


def held_out(doc_id):
    """True for the fifth of the ids that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, most_rows: int = 40_000) -> Model:
    """Train on labelled rows of :func:`statistics` that are not held out."""
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    told = told.filter(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    half = told.filter("quality >= 1").orderBy("draw", "doc_id").limit(most_rows // 2)
    half = half.unionByName(told.filter("quality < 1").orderBy("draw", "doc_id").limit(most_rows // 2))
    rows = stats.join(F.broadcast(half), "doc_id").groupBy("doc_id", "draw").agg(F.min("x").alias("x"), F.first("quality").alias("quality"))  # at most most_rows ids
    got = sorted(rows.collect(), key=lambda r: (r["draw"], r["doc_id"]))  # at most most_rows rows of some twenty numbers
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(STATISTICS))
    fold = np.array([r["draw"] for r in got], np.int64).view(np.uint64) % np.uint64(FOLDS) if got else np.zeros(0, np.uint64)
    return train(x, np.array([int(r["quality"] >= 1) for r in got], int), fold.astype(int))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of rows of :func:`statistics`."""
    sent = stats.sparkSession.sparkContext.broadcast(model)  # fixed size, some kilobytes

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    scored = stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
