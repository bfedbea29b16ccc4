"""Benchmark decontamination: a distributed positional inverted index over the training texts.

1. Index.  Texts are split into words on the JVM and exploded to postings (row, position,
   term); terms no benchmark item uses cannot match and are left out.  A last posting per row
   (term -1, position = number of words) carries the row's name.  The postings are written to
   the shared folder in document order.
2. Lists by term.  Terms are counted over all postings (that column alone is read); the lists of every
   window's ``LOOKUPS`` rarest terms are written apart, sorted by term in each file.  Only these
   are looked up, so frequent terms' postings are read once for verification and never for search.
3. Rarest terms first.  Each window of benchmark words (exact phrase) looks up its rarest term,
   shifts the positions found by the term's offset in the window, and intersects them with the
   list of its next rarest term, shifted alike.
4. Verification.  The remaining starts are intersected with the lists of all terms of their
   windows; a place counts if every word of the window stands there.  Terms and windows are numbered,
   not hashed.

:func:`proximity` answers looser questions from the same index: windows of which at least a
given number of distinct terms occur within a span of words.

Joins against terms, windows and window-item pairs are broadcast only where their counts are at most
``BROADCAST_TERMS``, ``BROADCAST_WINDOWS`` and ``BROADCAST_WINDOWS``, else shuffled.  Null texts have no words; texts
and items without words match nothing; items of fewer than ``window`` words are one window; null item
ids count as an empty id; repeated rows are separate rows; texts are whole, however long.  Empty tables give no hits.  Only doc_id/text and
item_id/text are read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewheel.llm import shared

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words, before lower-casing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOOKUPS = 2  # the two rarest terms of a window leave few false starts
BROADCAST_TERMS = 200_000
BROADCAST_WINDOWS = 100_000
BROADCAST_ROWS = 1_000_000
END = -1


def lower_ascii(c: Column) -> Column:
    """a-z for A-Z and nothing else; the fast built-in where a word is pure ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column) -> Column:
    """Words in order, still cased; an empty string may stand first or last."""
    return F.split(F.coalesce(c, F.lit("")), SPLIT)


def item_words(items: DataFrame) -> DataFrame:
    words = F.filter(split_words(F.col("text").cast("string")), lambda w: w != "")
    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(words, lower_ascii).alias("words")).filter(F.size("words") > 0)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows (words) with the items that hold them."""
    n = F.size("words")
    at = F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))))
    rows = item_words(items).select("item", "words", at.alias("at")).select("item", F.slice("words", F.col("at"), window).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


def index(docs: DataFrame, name: Column, terms: DataFrame, small: bool) -> DataFrame:
    """Postings (rid, name, pos, term) of the given terms (word, term), plus each row's end posting, which has its name."""
    words = split_words(F.col("text").cast("string"))
    rows = docs.select(name.alias("name"), words.alias("w")).withColumn("rid", F.monotonically_increasing_id())
    # without a first empty string, positions count from it; the last element is replaced by the end mark
    lead = F.when((F.element_at("w", 1) == "") & (F.size("w") > 1), 1).otherwise(0)
    last = F.when(F.element_at("w", -1) == "", 1).otherwise(0)
    whole = F.when(last == 1, F.col("w")).otherwise(F.array_append("w", F.lit("")))
    rows = rows.select("rid", "name", lead.alias("lead"), F.posexplode(whole).alias("at", "cased"))
    rows = rows.select("rid", "name", (F.col("at") - F.col("lead")).alias("pos"), lower_ascii(F.col("cased")).alias("word")).filter("pos >= 0")
    known = F.broadcast(terms) if small else terms
    found = rows.join(known, "word")
    return found.select("rid", F.when(F.col("term") == END, F.col("name")).alias("name"), F.col("pos"), "term")


@dataclass
class Index:
    """Postings (rid, name, pos, term), windows (win, terms, items), and which sides may be broadcast."""

    postings: DataFrame
    windows: DataFrame
    few_terms: bool
    few_windows: bool
    few_items: bool

    def lists(self) -> DataFrame:
        return self.postings.filter(F.col("term") != END).select("rid", "pos", "term")

    def names(self) -> DataFrame:
        return self.postings.filter(F.col("term") == END).select("rid", "name", "pos")


def _hint(few: bool):
    return F.broadcast if few else (lambda x: x)


def matches(ix: Index) -> DataFrame:
    """Verified (rid, win, start, size): every place where a window's words stand one after another."""
    hint = _hint(ix.few_windows)
    windows, lists = ix.windows, ix.lists()
    counts = lists.groupBy("term").agg(F.count("*").alias("n"))
    each = windows.select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(_hint(ix.few_terms)(counts), "term")
    # a window with a term that occurs nowhere cannot match
    rare = each.groupBy("win", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by")).filter(F.size("by") == F.col("size"))
    rare = shared.materialise(rare, "rarest")
    asked = rare.select(F.explode(F.slice("by", 1, LOOKUPS)).alias("b")).select("b.term").distinct()
    by_term = shared.materialise(lists.join(_hint(ix.few_terms)(asked), "term", "left_semi").select("rid", "pos", "term").sortWithinPartitions("term", "rid", "pos"), "lists")

    def probe(k: int) -> DataFrame:
        by = F.col("by")[k]
        return rare.filter(F.size("by") > k).select("win", by["term"].alias("term"), by["offset"].alias("offset"))

    starts = by_term.join(hint(probe(0)), "term").select("rid", "win", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")
    for k in range(1, LOOKUPS):
        short = rare.filter(F.size("by") <= k).select("win")
        done = starts.join(hint(short), "win", "left_semi")
        need = starts.join(hint(probe(k)), "win").withColumn("pos", (F.col("start") + F.col("offset")).cast("int"))
        listed = by_term.join(hint(probe(k).select("term").distinct()), "term", "left_semi")
        starts = need.join(listed, ["rid", "pos", "term"], "left_semi").select("rid", "win", "start").unionByName(done)
    starts = shared.materialise(starts, "starts")
    rids = shared.materialise(starts.select("rid").distinct(), "rids")
    own = lists.join(_hint(rids.count() <= BROADCAST_ROWS)(rids), "rid", "left_semi")
    near = starts.join(hint(windows.select("win", "terms")), "win").select("rid", "win", "start", F.posexplode("terms").alias("i", "term"))
    near = near.withColumn("pos", (F.col("start") + F.col("i")).cast("int"))
    exact = near.join(own, ["rid", "pos", "term"]).groupBy("rid", "win", "start").agg(F.count("*").alias("n"))
    return exact.join(hint(windows.select("win", F.size("terms").alias("size"))), "win").filter("n = size").select("rid", "win", "start", "size")


def proximity(ix: Index, least: int, span: int) -> DataFrame:
    """(rid, win, have, start): windows of which ``least`` distinct terms occur within ``span`` words of a row.

    ``start`` is the first place of the stretch with the most terms, ``have``.
    """
    each = ix.windows.select("win", F.explode(F.array_distinct("terms")).alias("term"))
    rows = ix.lists().join(_hint(ix.few_windows)(each), "term")
    here = W.partitionBy("rid", "win").orderBy("pos").rangeBetween(0, span - 1)
    rows = rows.withColumn("have", F.size(F.collect_set("term").over(here)))
    return rows.groupBy("rid", "win").agg(F.max("have").cast("int").alias("have"), F.max_by("pos", F.struct("have", -F.col("pos"))).alias("start")).filter(F.col("have") >= least)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item.

    Rows are named by id and text digest, so the index never carries texts; rows alike in both are alike in what they hold.
    """
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    ix = build(docs, name, items, window)
    rids = matches(ix).select("rid").distinct()
    key = shared.fresh(docs, "text_key")
    bad = shared.materialise(ix.names().join(rids, "rid", "left_semi").select(F.col("name").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, name).join(_hint(bad.count() <= BROADCAST_ROWS)(bad), key, "left_anti").select(*docs.columns)


def build(docs: DataFrame, name: Column, items: DataFrame, window: int) -> Index:
    """The index of ``docs`` (text; rows named by ``name``) for the windows of ``items``."""
    wins = shared.materialise(item_windows(items, window).withColumn("win", F.monotonically_increasing_id()), "windows")
    words = item_words(items).select(F.explode("words").alias("word")).distinct()
    end = docs.sparkSession.createDataFrame([("", END)], "word string, term long")
    vocab = shared.materialise(words.withColumn("term", F.monotonically_increasing_id()).unionByName(end), "terms")
    few_terms = vocab.count() <= BROADCAST_TERMS
    size = wins.agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items")).first()
    few_windows, few_items = size["n"] <= BROADCAST_WINDOWS, (size["items"] or 0) <= BROADCAST_WINDOWS
    numbered = wins.select("win", F.posexplode("words").alias("i", "word")).join(_hint(few_terms)(vocab), "word")
    numbered = numbered.groupBy("win").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]).alias("terms"))
    wins = shared.materialise(numbered.join(wins.select("win", "items"), "win"), "item-windows")
    return Index(shared.materialise(index(docs, name, vocab, few_terms), "postings"), wins, few_terms, few_windows, few_items)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs``: words, words inside occurring windows, and the items these belong to."""
    ix = build(docs, F.col("doc_id").cast("long"), items, window)
    hit = shared.materialise(matches(ix), "hits")
    ends = F.col("start") + F.col("size")
    order = W.partitionBy("rid").orderBy("start", "size")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = hit.select("rid", "start", "size", ends.alias("end")).distinct()
    spans = spans.withColumn("before", F.coalesce(before, F.lit(0)))
    covered = spans.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    named = hit.select("rid", "win").distinct().join(_hint(ix.few_windows and ix.few_items)(ix.windows.select("win", "items")), "win")
    named = named.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = ix.names().select("rid", F.col("name").alias("doc_id"), F.col("pos").cast("long").alias("n_words"))
    found = covered.join(named, "rid")
    return rows.join(found, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
