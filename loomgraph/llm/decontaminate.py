"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is 8 consecutive words of an item (or the whole of a shorter item) and has a set of positioned shingles of up
to 4 words. All of them must occur, so a prefix of one shingle is enough to find every occurrence: the rarest, by
counts over the whole corpus. Documents are read once into positioned shingle hashes, of which only those that
some item has are kept; the join with the prefixes, bounded by position (the window must begin at a word of the
document) and by length (it must end in it), gives candidates, and each candidate is verified word by word against an
item-sized window of its document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item shingles are broadcast up to this many rows (about 40 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts in ASCII take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _words_once(text: Column) -> Column:
    """words() through a generator: the optimiser would otherwise move the expression into lambdas that use it, which
    evaluate it again for every element."""
    return F.explode(F.array(words(text)))


def _hash_of(width: int, of: str, at: str) -> str:
    """SQL for the hash of width words of array `of` from position `at`, counted from 0."""
    return f"xxhash64({width}, " + ", ".join(f"{of}[{at} + {k}]" for k in range(width)) + ")"


def item_windows(items: DataFrame, item_id: str = "item_id", text_col: str = "text", size: int = 8) -> DataFrame:
    """(window_id, window, items): the distinct windows and the items that have them."""
    each = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), _words_once(F.col(text_col)).alias("w")).where("size(w) > 0")
    cut = F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))")
    rows = each.select("item", F.explode(cut).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))
    return rows.select(F.sha2(F.concat_ws(" ", "window"), 256).alias("window_id"), "window", "items")


def _shingles(windows: DataFrame, width: int) -> DataFrame:
    """(h, width, window_id, size, at): the shingles of each window, as wide as width or as the whole window."""

    def of(k: int) -> DataFrame:
        fitting = windows.where(F.size("window") >= k if k == width else F.size("window") == k)
        cut = F.expr(f"transform(sequence(0, size(window) - {k}), i -> {_hash_of(k, 'window', 'i')})")
        return fitting.select("window_id", F.size("window").alias("size"), F.posexplode(cut).alias("at", "h"), F.lit(k).alias("width"))

    return reduce(DataFrame.unionByName, [of(k) for k in range(1, width + 1)])


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _met(docs: DataFrame, shingles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, n_words, at, h): where a document has a shingle that some window has, and for each document a row with
    at = -1 that carries its number of words."""
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # four numbers at most
    run_of = [f"if(size(w) < {k}, array(), transform(sequence(0, size(w) - {k}), i -> {_hash_of(k, 'w', 'i')}))" for k in widths]
    at, before = F.col("place") - 1, F.lit(0)
    for k in widths:  # a document's shingles lie one width after another
        here = F.col("place") - 1 - before
        at = F.when(here >= 0, here).otherwise(at)
        before = before + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    rows = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc"), _words_once(F.col(text_col)).alias("w"))
        .select("doc", F.size("w").alias("n_words"), F.expr(f"concat(array(0L), {', '.join(run_of)})" if run_of else "array(0L)").alias("hashes"))
        .select("doc", "n_words", F.posexplode("hashes").alias("place", "h"))
        .select("doc", "n_words", at.alias("at"), "h")
    )
    keys = scratch.cut(shingles.select("h").unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"))).distinct(), "keys")
    return scratch.cut(rows.join(_small(keys), "h"), "met")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 8, width: int = 4) -> DataFrame:
    """(id_col, n_words, hits, items): for every document with an id.

    hits are the structs (start, size) of word positions where a window occurs, items the ids whose windows occur, both
    sorted and empty if there are none. Null and wordless texts have no words and no hits; items without words have no
    window. Rows that repeat an id count as one document: n_words is that of the longest, hits and items are those of
    any. Rows with a null id, and items with one, are left out. Other columns are ignored.
    """
    docs, items = docs.select(id_col, text_col), items.select(item_id, item_text)
    windows = scratch.cut(item_windows(items, item_id, item_text, size), "windows")
    shingles = scratch.cut(_shingles(windows, width), "shingles")
    met = _met(docs, shingles, id_col, text_col)
    heads = met.where("at = -1").groupBy("doc").agg(F.max("n_words").alias("n_words"))

    often = met.where("at >= 0").groupBy("h").agg(F.count("*").alias("n"))
    ranked = shingles.join(often, "h", "left").groupBy("window_id").agg(F.min_by(F.struct("h", "at", "size"), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("p"))
    prefix = scratch.cut(ranked.select("window_id", F.col("p.h").alias("h"), F.col("p.at").alias("skip"), F.col("p.size").alias("size")), "prefix")

    begun = met.where("at >= 0").join(_small(prefix), "h").select("doc", (F.col("at") - F.col("skip")).alias("start"), "size", "window_id", "n_words")
    bounded = begun.where("start >= 0 and start + size <= n_words")
    wanted = bounded.groupBy("doc").agg(F.collect_list(F.struct("start", "size", "window_id")).alias("wanted"))
    seen = wanted.join(docs, wanted.doc == docs[id_col]).select("doc", "wanted", _words_once(F.col(text_col)).alias("w")).select("doc", F.explode(F.expr("transform(wanted, x -> struct(x.start, x.size, x.window_id, slice(w, x.start + 1, x.size) as found))")).alias("x"))
    verified = seen.select("doc", "x.*").join(_small(windows), "window_id").where("found = window")
    hit = verified.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = heads.join(hit, "doc", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n_words").cast("long").alias("n_words"), *[F.coalesce(F.col(c), F.array().cast(hit.schema[c].dataType)).alias(c) for c in ("hits", "items")])


def n_hit(hits: str = "hits") -> Column:
    """The number of words inside any hit."""
    return F.size(F.expr(f"array_distinct(flatten(transform({hits}, x -> sequence(x.start, x.start + x.size - 1))))")).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2, **how) -> DataFrame:
    """docs without the rows of documents in which windows of least_items items or more occur."""
    bad = contamination(docs, items, id_col, text_col, **how).where(F.size("items") >= least_items).select(id_col)
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
