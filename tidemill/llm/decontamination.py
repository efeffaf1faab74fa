"""Benchmark decontamination with a distributed positional inverted index, in DataFrame
operations only.

The index holds postings (term, row, position) of the corpus for the terms that select: of
each benchmark window, its rarest words by corpus count. A window's rarest list, shifted by the
word's offset, gives places where the window could start; the next rarest lists, shifted
likewise, are intersected with them. What is left is compared word for word with the
document, so matches are exact. Proximity matches hold all distinct words of a window within a
given span, in any order: the same lists choose places where they may be, the words decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.session import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lists of a window that are intersected before the comparison.
LISTS = 3


def body(text: Column) -> Column:
    """The words of a text, lower-cased (A-Z only) and joined by one space; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.trim(F.regexp_replace(low, BREAKS, " "))


def words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " ", -1))


def windows(bench: DataFrame, size: int) -> DataFrame:
    """(win, seq, len, items): the distinct windows of the benchmark and the items that hold them."""
    split = bench.select(F.col("item_id").cast("string").alias("item"), words(body(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))
    each = split.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, size).alias("seq"))
    distinct = each.groupBy("seq").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return distinct.select(F.xxhash64(F.array_join("seq", " ")).alias("win"), "seq", F.size("seq").alias("len"), "items")


class PositionalIndex:
    """Tokenised documents and the postings of the terms that select benchmark windows."""

    def __init__(self, docs: DataFrame, bench: DataFrame, size: int = 10, keep: tuple[str, ...] = ()):
        if size < 1:
            raise ValueError("a window has one word at least")
        self.size = size
        self.tokens = table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", body(F.col("text")).alias("body"), *keep), "tokens")
        self.windows = table(windows(bench, size), "windows")
        terms = self.windows.select(F.explode("seq").alias("term")).distinct()
        vocabulary = table(terms, "vocabulary")
        occurrences = self.tokens.filter("body <> ''").select("row", F.posexplode(F.split("body", " ", -1)).alias("pos", "term"))
        self.counts = table(occurrences.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
        spread = self.windows.select("win", "len", F.posexplode("seq").alias("off", "term")).join(self.counts, "term", "left")
        known = spread.withColumn("absent", F.max(F.col("n").isNull()).over(W.partitionBy("win"))).filter("not absent")
        # Lists are of different terms where the window has as many, else of its other places.
        again = F.row_number().over(W.partitionBy("win", "term").orderBy("off"))
        order = F.row_number().over(W.partitionBy("win").orderBy("again", "n", "term", "off"))
        self.lists = table(known.withColumn("again", again).withColumn("list", order).filter(F.col("list") <= LISTS).select("win", "len", "list", "term", "off", "n"), "lists")
        chosen = table(self.lists.select("term").distinct(), "chosen")
        self.postings = table(occurrences.join(chosen, "term", "left_semi").select("term", "row", "pos"), "postings")

    def _starts(self, k: int) -> DataFrame:
        """(win, row, start): where the k-th rarest list of a window puts it."""
        mine = self.lists.filter(F.col("list") == k).select("win", "term", "off")
        return self.postings.join(mine, "term").select("win", "row", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")

    def _candidates(self) -> DataFrame:
        """(win, row, start): the intersection of the lists of each window."""
        found = self._starts(1)
        for k in range(2, LISTS + 1):
            mine = self.lists.filter(F.col("list") == k).select("win", "term", "off")
            wanted = found.join(mine, "win", "left").withColumn("pos", F.col("start") + F.col("off"))
            held = self.postings.withColumn("held", F.lit(True))
            found = wanted.join(held, ["term", "row", "pos"], "left").filter("held or term is null").select("win", "row", "start")
        return found

    def phrases(self) -> DataFrame:
        """(row, win, start, len): each place where a document holds a window word for word."""
        found = table(self._candidates(), "candidates")
        rows = table(found.select("row").distinct(), "candidate_rows")
        texts = self.tokens.join(rows, "row", "left_semi").select("row", F.split("body", " ", -1).alias("w"))
        seqs = self.windows.select("win", "len", F.array_join("seq", " ").alias("phrase"))
        found = found.join(seqs, "win")
        # One row of starts per (document, window): the document's words are joined to few rows.
        per = found.groupBy("row", "win", "len", "phrase").agg(F.collect_list("start").alias("starts"))
        at = F.filter("starts", lambda s: F.array_join(F.slice(F.col("w"), s + 1, F.col("len")), " ") == F.col("phrase"))
        return table(per.join(texts, "row").select("row", "win", "len", F.explode(at).alias("start")), "phrases")

    def near(self, span: int) -> DataFrame:
        """(row, win, start, end): each least stretch of a document that holds all distinct words of
        a window, in any order, within ``span`` words, or the window's own length if that is more."""
        most = max(span, self.size)
        own = self.lists.filter("list = 1").select("win", "term", F.greatest(F.lit(span), F.col("len")).alias("most"))
        anchor = own.join(self.postings, "term").select("win", "row", "most", F.col("pos").alias("at"))
        for k in range(2, LISTS + 1):  # only places that have each listed word near enough, on either side
            other = self.lists.filter(F.col("list") == k).select("win", F.col("term").alias("t"))
            held = self.postings.select(F.col("term").alias("t"), "row", "pos", F.floor(F.col("pos") / most).alias("cell"))
            cells = F.explode(F.sequence(F.floor(F.col("at") / most) - 1, F.floor(F.col("at") / most) + 1)).alias("cell")
            wide = anchor.join(other, "win", "left")
            some = wide.filter("t is not null").select("*", cells).alias("a")
            close = some.join(held.alias("h"), F.expr("a.t = h.t and a.row = h.row and a.cell = h.cell and abs(h.pos - a.at) < a.most"), "left_semi")
            anchor = wide.filter("t is null").select("win", "row", "most", "at").union(close.select("win", "row", "most", "at").distinct())
        found = table(anchor, "anchors")
        rows = table(found.select("row").distinct(), "anchor_rows")
        texts = self.tokens.join(rows, "row", "left_semi").select("row", F.split("body", " ", -1).alias("w"))
        terms = self.windows.select("win", F.array_distinct("seq").alias("terms"))
        per = found.groupBy("row", "win", "most").agg(F.collect_set("at").alias("ats")).join(terms, "win").join(texts, "row")
        low = lambda at: F.greatest(F.lit(0), at - F.col("most") + 1)
        parts = F.transform("ats", lambda at: F.struct(low(at).alias("low"), at.alias("at"), F.slice(F.col("w"), low(at) + 1, at - low(at) + F.col("most")).alias("words")))
        part = per.select("row", "win", "most", "terms", F.explode(parts).alias("p")).filter("size(array_except(terms, p.words)) = 0")
        each = part.select("row", "win", "most", "terms", "p.low", "p.words", F.explode(F.sequence(F.lit(0), F.col("p.at") - F.col("p.low"))).alias("s"))
        each = each.select("row", "win", "terms", (F.col("low") + F.col("s")).alias("start"), F.slice("words", F.col("s") + 1, F.col("most")).alias("r"))
        each = each.filter("array_contains(terms, r[0]) and size(array_except(terms, r)) = 0")
        each = each.withColumn("n", F.expr("cast(array_max(transform(terms, t -> array_position(r, t))) as int)"))
        least = each.filter("not array_contains(slice(r, 2, n - 1), r[0])")
        return table(least.select("row", "win", "start", (F.col("start") + F.col("n")).alias("end")).distinct(), "near")

    def proximity(self, span: int) -> DataFrame:
        """(doc_id, win, start, end): the stretches of ``near`` with the doc_id of their row."""
        return self.near(span).join(self.tokens.select("row", "doc_id"), "row").select("doc_id", "win", "start", "end")


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = 10, keep: tuple[str, ...] = (), span: int | None = 20) -> DataFrame:
    """Finds the windows of ``bench`` (item_id, text) in ``docs`` (doc_id, text).

    A window is ``size`` consecutive words of an item, or all words of a shorter item. Returns
    doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256 (of the sorted,
    comma-joined item_ids whose windows occur), contaminated (by such an
    occurrence), n_near (least stretches that hold all distinct words of a window within ``span``
    words, in any order), near_items (their item_ids, sorted) and the columns of ``keep``. Without
    a span proximity is not looked for, and its two columns are left out. Null and empty texts have no
    words: as documents they are never hit, as items they have no window. Repeated rows, also
    of one doc_id, are judged one by one. Empty tables are allowed; other columns are ignored.
    """
    index = PositionalIndex(docs, bench, size, keep)
    found = index.phrases()
    reached = F.max(F.col("start") + F.col("len")).over(W.partitionBy("row").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", F.coalesce(reached, F.lit(0))))
    hits = found.select("row", "start", "len").withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    held = found.select("row", "win").distinct().join(index.windows.select("win", F.explode("items").alias("item")), "win").select("row", "item").distinct()
    items = held.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_row = table(hits.join(items, "row"), "hits")
    tokens, proximity = index.tokens, []
    if span is not None:
        near = index.near(span)
        count_near = near.groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
        held = near.select("row", "win").distinct().join(index.windows.select("win", F.explode("items").alias("item")), "win").select("row", "item").distinct()
        near_items = held.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("near_items"))
        tokens = tokens.join(table(count_near.join(near_items, "row"), "near_hits"), "row", "left")
        proximity = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items")]
    count = F.when(F.col("body") == "", F.lit(0)).otherwise(F.size(F.split("body", " ", -1)))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return tokens.join(per_row, "row", "left").select(
        "doc_id",
        count.cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *proximity,
        *keep,
    )
