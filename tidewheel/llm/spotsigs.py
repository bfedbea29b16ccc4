"""Document fingerprints: SpotSigs.

A spot signature is a common word (the anchor) with the chain of content words that follow it; a
word signature is any word with the words that follow it.  A text's fingerprint is the sorted set
of both, 32 bits each, in hexadecimal, whatever its length, so an edit of few words changes few
signatures; likeness is the Jaccard coefficient of two such sets.  Anchors carry prose, so prose
weighs more than boilerplate and lists.  A chain that the text's end cuts short is as long as it can
be; texts without words have the empty fingerprint, and two empty fingerprints are alike (1.0), one
empty and one not are not (0.0).

The successor of each document in ascending id order is found without sorting everything in
one place: id ranges are sorted each by itself, and the first document of a range also goes to the
range before it (the very first one to the last range).

Null texts are empty.  Null ids come first.  Rows with equal ids are ordered by text hash.  A
single document is its own successor.  Only doc_id and text are read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm import shared, text as tx

# Very common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that it for was on as with be by this are from at an or not have he they which you "
    "der die das und ist von den mit ein eine nicht im zu auf sich des dem fur es auch "
    "le la les de du et un une que qui dans pour par sur est pas au avec ce il "
    "el los las y en del se con una por su para como mas lo al"
).split()
CHAIN, GAP = 2, 1
KEYS = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _anchor_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(ANCHORS).encode(), np.uint8)
    ends = np.cumsum([len(a) for a in ANCHORS])
    return np.unique(tx.span_hashes(raw, np.concatenate([[0], ends[:-1]]), ends))


def _signatures(words: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    first = np.searchsorted(content, anchor, side="right")
    chain = np.concatenate([words[content], np.zeros(1, np.uint64)])  # zero is no word
    sig = words[anchor] * KEYS[0]
    for c in range(CHAIN):
        sig = sig * KEYS[1] + chain[np.minimum(first + c * GAP, len(content))] * KEYS[c + 2]
    return (tx.mix(sig) >> np.uint64(32)).astype(np.uint32)


def signature_sets(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted signatures of each document of a chunk."""
    hashes, first = tx.word_hashes(raw, offs)
    common = np.isin(hashes, _anchor_hashes())
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        w, is_anchor = hashes[a:b], common[a:b]
        every = np.arange(len(w))
        out.append(np.unique(np.concatenate([_signatures(w, np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)), _signatures(w, every, every)])))
    return out


def to_hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without comparing where lengths alone rule out ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sets(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, raw, offs in tx.chunks(pa.array(texts, pa.large_string())):
        out += signature_sets(raw, offs)
    return out


def with_successors(docs: DataFrame, ranges_per_partition: int = 4) -> DataFrame:
    """Rows (box, extra, key, tie, doc_id, text), sorted in each partition so that a row's successor is the next one of its box.

    The driver holds the first id of each range, ``ranges_per_partition`` times as many as shuffle partitions.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", key).withColumn("tie", F.xxhash64("text"))
    ranges = rows.select("key", "tie").repartitionByRange(n * ranges_per_partition, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "tie")).alias("f"))
    firsts = sorted((r.f.key, r.f.tie) for r in ranges.collect())
    keys = np.array([k for k, _ in firsts], np.int64)
    ties = np.array([t for _, t in firsts], np.int64)

    @F.pandas_udf("array<int>")
    def boxes(k, t):
        import pandas as pd

        at = np.searchsorted(keys, k.to_numpy(), side="right") - 1
        first = (keys[at] == k.to_numpy()) & (ties[at] == t.to_numpy())
        last = len(keys) - 1
        return pd.Series([[int(b)] + ([-1 - (int(b) - 1 if b else last)] if f else []) for b, f in zip(at, first)])

    if not firsts:
        return rows.withColumns({"box": F.lit(0), "extra": F.lit(False)})
    rows = rows.withColumn("b", F.explode(boxes("key", "tie")))
    rows = rows.withColumns({"extra": F.col("b") < 0, "box": F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b"))})
    return rows.repartition(n, "box").sortWithinPartitions("box", "extra", "key", "tie")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and how alike they and the successor's are."""
    shared.prepare(docs.sparkSession)

    def run(batches):
        last = None  # (box, doc_id, text) that still waits for its successor
        for batch in batches:
            box, extra, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            pairs, size = [], 0

            def flush(pairs):
                own = [t for _, t, _ in pairs]
                n = [len(t) for t in own]
                edited = [t[: k - k // 4] + s[: k // 4] for (_, t, s), k in zip(pairs, n)]
                a, e, s = _sets(own), _sets(edited), _sets([s for _, _, s in pairs])
                cols = [
                    pa.array([i for i, _, _ in pairs], pa.int64()), pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([to_hex(x) for x in a], pa.string()), pa.array([to_hex(x) for x in e], pa.string()),
                    pa.array([likeness(x, y) for x, y in zip(a, e)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(a, s)], pa.float64()),
                ]
                return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

            for b, x, i, t in zip(box, extra, ids, texts):
                if last is not None and last[0] == b:
                    pairs.append((last[1], last[2], t))
                    size += len(last[2])
                    if size > tx.CHUNK:
                        yield flush(pairs)
                        pairs, size = [], 0
                last = None if x else (b, i, t)
            if pairs:
                yield flush(pairs)

    rows = with_successors(docs).select("box", "extra", "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def signature_table(docs: DataFrame) -> DataFrame:
    """(fingerprint, docs, sigs): distinct fingerprints with their documents' count, least id and signatures."""
    shared.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = _sets([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64).tolist() for s in sets], pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, sigs array<long>")
    return rows.groupBy("sigs").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"))


def similar_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of distinct fingerprints with Jaccard ``least`` or more; a, b are their least ids (null if they have none).

    Sets are partitioned by the logarithm of their length, so a partner stands in the same or the
    next partition; within one, sets meet on the rarest signatures that any partner must share.
    """
    base = float(np.log(1 / least))
    sets = signature_table(docs).filter(F.size("sigs") > 0).withColumns({"n": F.size("sigs"), "sid": F.monotonically_increasing_id()})
    sets = shared.materialise(sets, "spots")
    each = sets.select("sid", "n", F.explode("sigs").alias("sig"))
    freq = each.groupBy("sig").agg(F.count("*").alias("f")).filter("f > 1")
    need = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    rare = each.join(freq, "sig", "left").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "sig"))).alias("s"))
    rare = rare.select("sid", "n", F.explode(F.slice("s", F.lit(1), need.cast("int"))).alias("s")).filter("s.f > 1")
    part = F.floor(F.log("n") / F.lit(base)).cast("int")
    left = rare.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("s.sig").alias("sig"), part.alias("part"))
    right = rare.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("s.sig").alias("sig"), F.explode(F.array(part, part - 1)).alias("part"))
    fits = (F.col("nb") >= F.col("na")) & (F.col("na") >= F.lit(least) * F.col("nb")) & (F.col("a") != F.col("b")) & ((F.col("nb") > F.col("na")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["part", "sig"]).filter(fits).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("doc_id").alias(f"id_{x}"), F.col("sigs").alias(f"s{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.withColumn("likeness", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("likeness") >= least)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "likeness")
