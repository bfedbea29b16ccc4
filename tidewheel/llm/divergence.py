"""Source divergence audit: how far the word shares of each source lie from its peers' and from its language's.

Terms are counted once for every (language, source) group; a language keeps the terms that stand in ``least`` of its
documents.  A group's vector over the kept terms is cut into segments of about ``SEGMENT`` terms and stays in one partition
with some neighbours (a block); compressed copies of it travel through the other blocks in the order of a
round-robin tournament (circle method: of B blocks each meets each other one once, in B - 1 rounds).  A meeting gives the
distance for both directions, so half of the trips suffice.  The language's own vector visits every block before the
first round; a heap for each group then keeps its best terms of the segment.  Segments add up: distances by
a sum, terms by ranking the heaps' rests.

A task holds one block of one segment (about the root of the number of sources, times ``SEGMENT`` numbers) and one visitor at a time,
whatever the number of documents, terms or sources.  All arithmetic is on integers and exact.  Work on pairs
grows with the square of a language's number of sources, as the result does; never with documents.

Defined results: null text, language and source count as ''.  A group whose documents hold no kept term
has counts of 0, one of a language without kept terms distance 0 to its peers and no terms; a language of one source has no pairs.  Ties are
ranked by the item's UTF-8 bytes.  Repeated rows are documents of their own, ids are not read, other columns and
their names do not matter; very long texts are counted piece by piece; an empty table gives no rows.
"""
from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewheel.llm import shared

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # in UTF-8 every byte of a character beyond ASCII is 0x80 or more
SEGMENT = 1024
LANGUAGE, RESIDENT = -2, -1  # what comes to a block before round 0
HELD = 300_000  # counters of a task before they are passed on
PIECE = 1 << 16

_COUNTS = "lang string, source string, term string, n long, docs long"


def _words(text: bytes) -> Counter:
    low = text.lower()  # of bytes: A-Z alone
    if len(low) < 1 << 20:
        return Counter(TERM.findall(low))
    found, out = (m.group() for m in TERM.finditer(low)), Counter()
    while piece := list(islice(found, PIECE)):
        out.update(piece)
    return out


def _count(batches):
    held, size = {}, 0

    def passed_on():
        rows = [(g, t, *v) for g, terms in held.items() for t, v in terms.items()]
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0][0] for r in part], pa.string()), pa.array([r[0][1] for r in part], pa.string()),
                pa.array([None if r[1] is None else r[1].decode() for r in part], pa.string()),
                pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            terms = held.setdefault((lang, source), {None: (0, 0)})  # a group stands there without terms too
            before = len(terms)
            for t, n in _words(text.as_py()).items():
                old = terms.get(t)
                terms[t] = (n, 1) if old is None else (old[0] + n, old[1] + 1)
            size += len(terms) - before
            if size > HELD:
                yield from passed_on()
                held, size = {}, 0
    yield from passed_on()


def term_counts(docs: DataFrame, least: int = 30, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, total, first): occurrences of each kept term in each group that has it and in its language.

    ``first`` marks one row of each (lang, term).  A row with a null term stands for each group.  Tasks add up what they read;
    one shuffle by (lang, term) then serves the groups' sums, the documents' number and the language's sum.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, _COUNTS).repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = W.partitionBy("lang", "term")
    counts = counts.withColumns({"total": F.sum("n").over(own), "docs": F.sum("docs").over(own), "place": F.row_number().over(own.orderBy("source"))})
    kept = counts.filter(F.col("term").isNull() | (F.col("docs") >= least))
    return kept.select("lang", "source", "term", "n", "total", (F.col("term").isNotNull() & (F.col("place") == 1)).alias("first"))


def share(n: np.ndarray, total: int, kept: int, smooth: int) -> np.ndarray:
    """1 + floor(10^9 (n + smooth) / (total + smooth kept)), by long division in base 1000, so that no step overflows."""
    whole = total + smooth * kept
    left = np.asarray(n) + smooth
    if whole >= (1 << 63) // 1000:
        left = left.astype(object)
    out, left = left // whole, left % whole
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return (out + 1).astype(np.int64)


def squeeze(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: its length, gaps between places, counts; compressed."""
    return zlib.compress(np.int32(len(places)).tobytes() + np.diff(places, prepend=0).astype("<u2").tobytes() + counts.astype("<i8").tobytes(), 1)


def spread(packed: bytes | None, size: int) -> np.ndarray:
    """The dense vector of ``size`` counts; nothing packed is all zeros."""
    out = np.zeros(size, np.int64)
    if packed:
        raw = zlib.decompress(packed)
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        out[np.cumsum(np.frombuffer(raw, "<u2", n, 4), dtype=np.int64)] = np.frombuffer(raw, "<i8", n, 4 + 2 * n)
    return out


def _squeeze(batches):
    for batch in batches:
        out = []
        for terms in batch.column(3).to_pylist():
            terms.sort(key=lambda t: t["at"])
            out.append(squeeze(np.array([t["at"] for t in terms], np.int64), np.array([t["n"] for t in terms], np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["lang", "seg", "source", "packed"])


def _best(p: np.ndarray, q: np.ndarray, n: np.ndarray, top: int) -> list[tuple[int, int]]:
    """(place, p - q) of the ``top`` largest differences of terms that occur, the least place first among equals."""
    over = np.flatnonzero((n > 0) & (p > q))
    heap = heapq.nsmallest(top, zip((q - p)[over].tolist(), over.tolist()))
    return [(at, -f) for f, at in heap]


def _meetings(smooth: int, top: int):
    """Rows come by (lang, seg, block), in a block the language's vector, the residents, then visitors by round."""

    def run(batches):
        key, size, names, q, residents, matrix = None, 0, [], None, [], None
        out = {k: [] for k in ("lang", "source", "part", "item", "value")}

        def say(*row):
            for c, v in zip(out.values(), row):
                c.append(v)

        def settle(lang):
            """All residents are there: they meet each other and the language."""
            nonlocal matrix
            matrix = np.array([p for _, p, _ in residents], np.int64).reshape(len(residents), size)
            for i, (name, p, n) in enumerate(residents):
                for (other, *_), f in zip(residents[:i], np.abs(matrix[:i] - p).sum(axis=1).tolist()):
                    say(lang, name, "pair", other, f)
                    say(lang, other, "pair", name, f)
                for at, f in _best(p, q, n, top) if size else []:
                    say(lang, name, "term", names[at], f)

        def ready():
            batch = pa.RecordBatch.from_pydict(dict(out), schema=pa.schema([(k, pa.int64() if k == "value" else pa.string()) for k in out]))
            for c in out:
                out[c] = []
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                at = (r["lang"], r["seg"], r["block"])
                if at != key:
                    if key is not None and matrix is None:
                        settle(key[0])
                    key, size, names, q, residents, matrix = at, 0, [], None, [], None
                if r["round"] == LANGUAGE:
                    names = r["terms"]
                    size = len(names)
                    q = share(spread(r["packed"], size), r["occurrences"], r["kept"], smooth)
                    continue
                n = spread(r["packed"], size)
                p = share(n, r["occurrences"], r["kept"], smooth) if size else n
                if r["round"] == RESIDENT:
                    residents.append((r["source"], p, n))
                    continue
                if matrix is None:
                    settle(key[0])
                for (name, *_), f in zip(residents, np.abs(matrix - p).sum(axis=1).tolist()):
                    say(key[0], name, "pair", r["source"], f)
                    say(key[0], r["source"], "pair", name, f)
                if len(out["lang"]) >= 20_000:
                    yield ready()
        if key is not None and matrix is None:
            settle(key[0])
        yield ready()

    return run


def host(a, b):
    """Which of two different blocks the other one visits; columns or numbers alike: half of a block's meetings are at home."""
    low, high = (F.least(a, b), F.greatest(a, b)) if not isinstance(a, int) else (min(a, b), max(a, b))
    odd = (high - low) % 2
    return F.when(odd == 1, low).otherwise(high) if not isinstance(a, int) else (low if odd else high)


def round_of(a, b, blocks):
    """The round in which blocks ``a`` and ``b`` of an even number of blocks meet (circle method; the last block stands still).

    ``blocks`` / 2 is the inverse of 2 modulo ``blocks`` - 1, so a + b = 2 round; the last block meets a in round a.
    """
    if isinstance(a, int):
        last = blocks - 1
        return min(a, b) if max(a, b) == last else (a + b) * (blocks // 2) % last
    last = F.col(blocks) - 1
    return F.when(F.greatest(a, b) == last, F.least(a, b)).otherwise((a + b) * (F.col(blocks) / 2).cast("int") % last)


def divergence(docs: DataFrame, least: int = 30, smooth: int = 5, top: int = 50, segment: int = SEGMENT, width: int | None = None, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: distances to all peers (`pair`) and the ``top`` over-represented terms (`term`).

    ``width`` sources share a block; unless given, the root of the language's number of sources, 4 at least.
    """
    kept = shared.materialise(term_counts(docs, least, lang, source, text), "term-counts")
    of_term = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("occurrences")).withColumn("number", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_occurrences"), F.count_if("first").alias("kept"), F.count_if(~of_term).alias("sources"))
    wide = F.lit(width) if width else F.greatest(F.lit(4), F.ceil(F.sqrt("sources")))
    count = F.ceil(F.col("sources") / wide).cast("int")
    langs = shared.materialise(langs.select(
        "lang", "lang_occurrences", "kept", F.greatest(F.lit(1), F.ceil(F.col("kept") / segment)).cast("int").alias("segs"), wide.cast("int").alias("width"),
        F.when(count == 1, 1).otherwise(count + count % 2).cast("int").alias("blocks")), "languages")

    # places in a segment follow the terms' bytes, so that ties of terms are ties of places
    seg = F.pmod(F.xxhash64("term"), F.col("segs")).cast("int")
    placed = kept.filter(of_term).join(langs.select("lang", "segs"), "lang").withColumn("seg", seg)
    placed = placed.withColumn("at", F.dense_rank().over(W.partitionBy("lang", "seg").orderBy("term")) - 1)
    one = F.struct("at", "n")
    vectors = placed.groupBy("lang", "seg", "source").agg(F.collect_list(one).alias("terms")).mapInArrow(_squeeze, "lang string, seg int, source string, packed binary")
    names = placed.filter("first").groupBy("lang", "seg").agg(F.sort_array(F.collect_list(F.struct("at", "total", "term"))).alias("t"))
    whole = names.select("lang", "seg", F.lit("").alias("source"), F.expr("transform(t, x -> struct(x.at AS at, x.total AS n))").alias("terms")).mapInArrow(_squeeze, "lang string, seg int, source string, packed binary")
    whole = whole.select("lang", "seg", "packed").join(names.select("lang", "seg", F.col("t.term").alias("terms")), ["lang", "seg"])

    segs = F.explode(F.sequence(F.lit(0), F.col("segs") - 1)).alias("seg")
    residents = groups.join(langs, "lang").select("lang", "source", segs, (F.col("number") / F.col("width")).cast("int").alias("own"), "blocks", "occurrences", "kept").join(vectors, ["lang", "seg", "source"], "left")
    other = residents.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    stays = F.col("block") == F.col("own")
    trips = other.filter(stays | (host(F.col("own"), F.col("block")) == F.col("block")))
    trips = trips.withColumn("round", F.when(stays, RESIDENT).otherwise(round_of(F.col("own"), F.col("block"), "blocks")).cast("int"))
    none = F.lit(None).cast("array<string>").alias("terms")
    columns = ["lang", "seg", "block", "round", "source", "occurrences", "kept", "packed"]
    first = whole.join(langs, "lang").select("lang", "seg", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(LANGUAGE).alias("round"), F.lit("").alias("source"), F.col("lang_occurrences").alias("occurrences"), "kept", "packed", "terms")
    all_rows = trips.select(*columns, none).unionByName(first).repartition("lang", "seg", "block").sortWithinPartitions("lang", "seg", "block", "round", "source")
    met = all_rows.mapInArrow(_meetings(smooth, top), "lang string, source string, part string, item string, value long")
    met = met.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term stands in one segment
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter(f"part = 'pair' OR rank <= {int(top)}").select("lang", "source", "part", "item", "value", "rank")
