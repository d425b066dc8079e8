"""Benchmark decontamination: documents that repeat windows of benchmark items.

Items become windows of ``size`` consecutive words (one window where an item has fewer); their hashes form the set that is
broadcast when the written table has at most ``BROADCAST_WINDOWS`` rows, and joined by shuffle beyond that. Every
window of every document is hashed in one pass over its word array and looked up; a hit counts only if its words equal the item's.
The pass that looks windows up also emits one row per document, so texts are read once and never shuffled: only hits and
word counts are. Rows are told apart by their place in the input, so ``docs`` must be a table scan (or another frame
that yields the same partitions each time it is read).

Defined cases: null and empty texts have no words; null or wordless items have no windows; items without id are left out;
an item id that occurs twice is one item with both texts' windows; repeated documents are judged one by one; extra columns
are ignored by ``find_leaks`` and kept by ``remove_leaks``; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import LETTERS, SEPARATORS, fresh, words
from veilframe.storage import materialize_counted

BROADCAST_WINDOWS = 1_000_000


def item_windows(benchmark: DataFrame, size: int = 10, key: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """(len, hash, win, items) per distinct window, and how many there are; written once."""
    items = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    sized = items.withColumn("len", F.least(F.size("w"), F.lit(size)))
    starts = sized.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    wins = starts.select("item", "len", F.slice("w", F.col("s"), F.col("len")).alias("win"))
    table = wins.groupBy("len", "win").agg(F.collect_set("item").alias("items")).select("len", F.xxhash64("win").alias("hash"), "win", "items")
    return materialize_counted(table, "windows")


def _hashes(w: str, size: int) -> Column:
    """Hash of the window at every place of the word array."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<long>"))


def _covered(spans: Column) -> Column:
    """Words covered by sorted spans (s, len) that may overlap."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["s"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, state, add, lambda acc: acc["n"])


def _leaks(rows: DataFrame, benchmark: DataFrame, size: int, broadcast_windows: int, text: str, keep: list[str]) -> DataFrame:
    """Per row of ``rows`` (u and ``keep``): n_words, spans (s, len) of its hits in order, items (sorted ids)."""
    wins, n = item_windows(benchmark, size)
    lens = sorted(r[0] for r in wins.select("len").distinct().collect()) or [size]  # at most ``size`` values
    w = rows.select("u", *keep, words(F.col(text)).alias("w"))
    base = [*keep, F.size("w").cast("long").alias("n_words")]
    parts = []
    for i, length in enumerate(lens):
        own = wins.where(F.col("len") == length).select(F.col("hash").alias("h"), "win", "items")
        hit = F.when(F.col("win").isNotNull(), F.slice("w", F.col("s"), length) == F.col("win")).otherwise(False)
        out = ["u", *base, F.when(hit, F.struct("s", F.lit(length).alias("len"))).alias("span"), F.when(hit, F.col("items")).alias("items")]
        if n <= broadcast_windows:
            # place 0 has no hash: it stands for the document itself, once
            first = F.array(F.lit(None).cast("long"))
            at = w.select("*", F.posexplode_outer(F.concat(first, _hashes("w", length))).alias("s", "h"))
            parts.append(at.join(F.broadcast(own), "h", "left").where(hit | (F.col("s") == 0) & F.lit(i == 0)).select(*out))
        else:
            at = w.select("*", F.posexplode_outer(_hashes("w", length)).alias("s", "h")).withColumn("s", F.col("s") + 1)
            at = at.select("u", *keep, "w", "s", "h").where("h is not null")
            found = at.withColumn("w", F.slice("w", F.col("s"), length)).join(own, "h").where(F.col("w") == F.col("win"))
            parts.append(found.select("u", *keep, F.lit(None).cast("long").alias("n_words"), F.struct("s", F.lit(length).alias("len")).alias("span"), "items"))
            if i == 0:
                none = own.schema["items"].dataType
                parts.append(w.select("u", *base, F.lit(None).cast("struct<s:int,len:int>").alias("span"), F.lit(None).cast(none).alias("items")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    firsts = [F.max(c).alias(c) for c in ["n_words"]] + [F.first(c, ignorenulls=True).alias(c) for c in keep]
    found = rows.groupBy("u").agg(*firsts, F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items (their ids, sorted), contaminated."""
    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = _leaks(rows, benchmark, size, broadcast_windows, "text", ["doc_id"]).withColumn("n_hit", _covered(F.col("spans")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", max_share: float = 0.0, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Documents without benchmark passages, with all their columns.

    A document goes when more than ``max_share`` of its words are hit; in one that stays the hit words and the
    separators after them are cut out (a line end takes the place of each passage). ``max_share`` 0 removes whole documents only.
    """
    u, spans, gone = fresh(docs, "_u", "_spans", "_gone")
    rows = docs.withColumn(u, F.monotonically_increasing_id())
    found = _leaks(rows.select(F.col(u).alias("u"), F.col(text).alias("text")), benchmark, size, broadcast_windows, "text", [])
    hits = found.where(F.size("spans") > 0).select(F.col("u").alias(u), F.col("spans").alias(spans), (_covered(F.col("spans")) / F.col("n_words") > max_share).alias(gone))
    if max_share <= 0:
        return rows.join(hits.select(u), u, "left_anti").drop(u)
    marked = rows.join(hits, u, "left").where(~F.coalesce(gone, F.lit(False)))
    pieces = F.filter(F.split(F.col(text), SEPARATORS), lambda x: x != "")
    gaps = F.split(F.col(text), LETTERS)  # the separators before, between and after the words
    inside = lambda i: F.exists(spans, lambda x: (i + 1 >= x["s"]) & (i + 1 < x["s"] + x["len"]))
    cut = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(pieces, lambda p, i: F.when(inside(i), F.when(~inside(i - 1), "\n").otherwise("")).otherwise(F.concat(p, F.get(gaps, i + 1)))), ""))
    return marked.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut)).drop(u, spans, gone)
