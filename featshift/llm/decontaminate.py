"""Benchmark decontamination: exact occurrences of item windows in documents, DataFrame operations only.

A prefix-filtered join for full containment: the words of a window are ordered by rarity in
the documents, and as all of them must be present, the rarest one alone is the necessary
prefix. Words of documents meet windows on that word; its position fixes where the window
would begin, which must leave room for all words (length and position), and the words there
are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featshift.storage import materialize

#: ASCII characters between words: all but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows that take up to so many bytes in memory are sent to every executor, more of them are shuffled.
BROADCAST_BYTES = 64 << 20


def lower_ascii(word: Column) -> Column:
    """A-Z as a-z, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Words in their own case: runs of ASCII letters, digits and characters beyond ASCII."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), lambda w: w != "")


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """``(window, item)``: each run of ``size`` words of an item; a shorter item is one window."""
    words = items.select(F.col(item_id).cast("string").alias("item"), F.transform(words_of(F.col(text)), lower_ascii).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        words.filter("item is not null and size(words) > 0")
        .select("item", "words", F.explode(starts).alias("at"))
        .select(F.slice("words", F.col("at"), F.lit(size)).alias("window"), "item").distinct()
    )


def _fits(windows: DataFrame) -> bool:
    """Whether the windows with their items, and so any table made from them, may be broadcast."""
    row = F.octet_length(F.array_join("window", " ")) + 24 * F.size("window") + F.octet_length("item") + 64
    return (windows.agg(F.sum(row.cast("double"))).first()[0] or 0.0) <= BROADCAST_BYTES


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Which words of which documents lie inside item windows.

    Returns the summary ``(doc_id, n_words, n_hit, n_items, item_ids, contaminated)`` with a
    row per row of ``docs``, and the spans ``(doc_id, first, last, item)`` of all occurrences.
    Null and empty texts have no words. Rows that repeat a ``doc_id`` get the union of their
    hits; rows without one are summed up together. Items without an id or words match nothing.
    Windows beyond ``BROADCAST_BYTES`` are joined by shuffling; a document word then takes along
    the ``2 * size - 1`` words around it, in which every window that it can meet lies.
    """
    windows = materialize(item_windows(items, item_id, item_text, size), "windows")
    distinct = windows.select("window").distinct()
    vocabulary = distinct.select(F.explode("window").alias("word")).distinct()
    fits = _fits(windows)

    def beside(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if fits else df.hint("merge")

    split = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    seen = split.select(F.explode("words").alias("w")).select(lower_ascii(F.col("w")).alias("word"))
    counts = seen.join(beside(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    # Windows with a word that no document has match nothing and drop out here.
    placed = distinct.select("window", F.posexplode("window").alias("offset", "word")).join(materialize(counts, "words"), "word", "left")
    prefix = placed.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "word")).alias("p")).filter("p.n > 0")
    prefix = materialize(prefix.select("window", "p.offset", "p.word"), "prefixes")

    at = split.select("doc_id", "words", F.posexplode("words").alias("position", "w"))
    # Where nothing is shuffled, the array of the whole document is only referred to.
    begin = F.lit(0) if fits else F.greatest(F.col("position") - (size - 1), F.lit(0))
    near = F.col("words") if fits else F.slice("words", begin + 1, F.lit(2 * size - 1))
    at = at.select("doc_id", near.alias("near"), begin.alias("begin"), F.size("words").alias("n"), "position", lower_ascii(F.col("w")).alias("word"))
    start = F.col("position") - F.col("offset")
    length = F.size("window")
    met = at.join(beside(prefix), "word").filter((start >= 0) & (start + length <= F.col("n")))
    met = met.select("doc_id", start.alias("first"), "window", F.slice("near", start - F.col("begin") + 1, length).alias("there"))
    # Compared as joined text: a lambda here would break the fused stage, and every word would carry its whole document.
    met = met.filter(lower_ascii(F.array_join("there", " ")) == F.array_join("window", " "))
    found = materialize(met.select("doc_id", "first", "window"), "hits")
    spans = found.join(beside(windows), "window").select("doc_id", "first", (F.col("first") + F.size("window") - 1).alias("last"), "item").distinct()

    positions = found.select("doc_id", F.explode(F.sequence("first", F.col("first") + F.size("window") - 1)).alias("position")).distinct()
    hits = positions.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    named = spans.select("doc_id", "item").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    both = hits.join(named, hits.doc_id.eqNullSafe(named.doc_id)).select(hits.doc_id.alias("hit_id"), "n_hit", "item_ids")
    summary = split.select("doc_id", F.size("words").cast("long").alias("n_words"))
    summary = summary.join(both, summary.doc_id.eqNullSafe(both.hit_id), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
    return summary, spans
