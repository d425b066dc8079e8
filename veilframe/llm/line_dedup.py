"""Repeated runs of lines, found with a suffix array over line ids and removed but for their first copy.

The corpus is one sequence of line ids (blank lines do not count); a suffix starts at every line and ends with its document. The
array is built by prefix doubling: the rank of a suffix by its first 2h lines follows from the pair (rank by h lines here, rank by h
lines h further on). Pairs are aggregated first, sorted by range and numbered in that order, so ranks keep the order
of the suffixes without a global sort of positions. Suffixes of equal rank lie next to each other: they are the interval whose longest common prefix
is 2h lines or more. A suffix whose first 2h lines occur once, or whose document ends before, leaves the rounds; these go on until none is left.

Per position the deepest interval that has an earlier member tells how long an earlier text is repeated from here on.
A later copy is deleted where it spans ``MIN_LINES`` lines, or is a single line of at least ``LONG_LINE`` characters. First means the smallest
(doc_id, place, line). Every line of a maximal repeated run is inside some such window, so whole runs go.

Line ids are 128-bit hashes, counted before the shuffle; only lines that occur twice enter the rounds. Texts are read twice,
and shuffled once in the end together with their deleted line numbers. Rounds are written to the shared folder. Rows are told
apart by their place in the input, so ``docs`` must be a table scan (or another frame that yields the same partitions each time
it is read).

Defined cases: null texts stay null; empty and blank texts have no line and stay; a text all of whose lines are copies becomes
empty; of repeated rows the first stays whole; null doc_ids come first; extra columns are kept; no documents give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.llm.text import fresh, let
from veilframe.storage import materialize, materialize_counted

MIN_LINES, LONG_LINE = 2, 20


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(u, id, j, h1, h2, chars): the non-blank lines, numbered by ``j``."""
    filled = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    # the place must be taken before the explode, which would number lines
    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col(key).alias("id"), filled.alias("filled"))
    rows = rows.select("u", "id", F.posexplode("filled").alias("j", "line"))
    return rows.select("u", "id", "j", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("chars"))


def _ranked(suffixes: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Keys that occur twice or more, with their rank in the order of the keys and the first place they occur at."""
    place = F.min(F.struct("id", "u", "j")).alias("first")
    groups = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), place).where("n > 1").drop("n")
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize_counted(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_prefixes(docs: DataFrame, key: str = "doc_id", text: str = "text", long_line: int = LONG_LINE) -> DataFrame:
    """One row per round and later copy: u, j, lines (2 to the round), long, first (id, u, j of the earliest copy)."""
    lines = materialize(_lines(docs, key, text), "lines")
    ranks, n = _ranked(lines, ["h1", "h2"])
    now = lines.join(ranks, ["h1", "h2"]).select("u", "id", "j", "rank", "first", (F.col("chars") >= long_line).alias("long"))
    found, span = [], 1
    while n or not found:
        now = materialize(now, "suffixes")
        later = (F.col("first.u") != F.col("u")) | (F.col("first.j") != F.col("j"))
        found.append(now.where(later).select("u", "j", F.lit(span).alias("lines"), "long", "first"))
        ahead = W.partitionBy("u").orderBy("j").rangeBetween(span, span)
        pairs = now.select("u", "id", "j", "long", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b")).where("b is not null")
        ranks, n = _ranked(pairs, ["a", "b"])
        now = pairs.join(ranks, ["a", "b"]).select("u", "id", "j", "rank", "first", "long")
        span *= 2
    return reduce(DataFrame.unionByName, found)


def later_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """Per document with repeated lines: u, gone (the non-blank lines to delete, by number), longest (lines of its longest repeat found).

    ``min_lines`` must be a power of two, as the windows of the rounds are.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    found = repeated_prefixes(docs, key, text, long_line)
    single = (F.col("lines") == 1) & (F.col("long") | F.lit(min_lines == 1))
    window = F.when(F.col("lines") == min_lines, F.sequence(F.col("j"), F.col("j") + (min_lines - 1))).when(single, F.array("j"))
    return found.select("u", "lines", F.explode_outer(window).alias("j")).groupBy("u").agg(F.collect_set("j").alias("gone"), F.max("lines").alias("longest"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, long_line: int = LONG_LINE, report: bool = False) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut out of the text.

    ``report`` adds n_lines (non-blank lines before), n_deleted and longest_repeat: the longest power of two of lines that
    repeats an earlier text, 0 if none does.
    """
    u, cuts, longest = fresh(docs, "_u", "_gone", "_longest")
    copies = later_copies(docs, key, text, min_lines, long_line).toDF(u, cuts, longest)
    rows = docs.withColumn(u, F.monotonically_increasing_id()).join(copies, u, "left")

    def cut(every):
        filled = F.filter(F.transform(every, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
        gone = let(filled, lambda places: F.transform(cuts, lambda j: F.get(places, j)))
        left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n")

    shorter = F.when(F.size(cuts) > 0, let(F.split(F.col(text), "\n"), cut)).otherwise(F.col(text))
    extra = {}
    if report:
        n_lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != ""))
        deleted = F.coalesce(F.size(cuts), F.lit(0))
        extra = {"n_lines": n_lines, "n_deleted": deleted, "longest_repeat": F.coalesce(longest, F.lit(0))}
    return rows.withColumns({**extra, text: shorter}).drop(u, cuts, longest)
