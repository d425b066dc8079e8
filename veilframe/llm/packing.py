"""Batches of similar length: bucket boundaries that minimise padding, and token-budget batches inside each bucket.

The histogram of all lengths is one aggregated table. Dynamic programming over it picks at most ``BUCKETS`` boundaries: with the lengths l_1 < l_2 < ...
and C_j documents up to l_j, the padded size of the best b buckets up to l_j is

    best(b, j) = min over i < j of best(b - 1, i) + l_j (C_j - C_i)

whose inner part is a set of lines in l_j with falling slopes, so each layer is one sweep along their lower hull. A document goes
to the first bucket whose boundary holds it; a batch takes as many documents as fit the budget at the bucket's padded length (one if
even one is too long). Documents are numbered per bucket by counting (bucket, slice) and a window inside each slice of about
``SLICE`` documents, so no task holds a bucket. Only the histogram comes to the driver, every length as it is: a corpus of T tokens has at
most sqrt(2 T) distinct lengths, some 100,000 for 30 GB, and the sweeps are linear in them. Boundaries are optimal, and lengths that occur.

Defined cases: null and empty texts have length 0 and are packed with the shortest; null ids and repeated rows are packed row by row;
no documents give no rows; extra columns are ignored. Rows are told apart by their place in the written table of lengths.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.text import LETTERS
from veilframe.storage import materialize

BUCKETS, BUDGET, SLICE = 16, 65_536, 10_000
EXACT = (1 << 63) - 1  # lengths up to it go into the histogram as they are: all


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(LETTERS)).cast("long")


def boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Ascending boundaries, at most ``buckets``, of least total padding; the last is the longest length."""
    rows = sorted(histogram)
    if not rows:
        return []
    lengths, total = [l for l, _ in rows], [0]
    for _, c in rows:
        total.append(total[-1] + c)
    n = len(rows)
    best, cuts = [None] + [l * total[j + 1] for j, l in enumerate(lengths)], []
    best[0] = 0
    for _ in range(min(buckets, n) - 1):
        # lines y = -total[i] x + best[i] for i buckets' ends, asked at growing x: a queue of the lower hull
        hull, start, now, cut = [], 0, [0], array("q", [0])
        for j in range(1, n + 1):
            i = j - 1
            m, q = -total[i], best[i]
            while len(hull) - start >= 2:
                (m1, q1, _), (m2, q2, _) = hull[-2], hull[-1]
                if (q - q1) * (m1 - m2) > (q2 - q1) * (m1 - m):
                    break
                hull.pop()
            hull.append((m, q, i))
            x = lengths[j - 1]
            while len(hull) - start >= 2 and hull[start + 1][0] * x + hull[start + 1][1] <= hull[start][0] * x + hull[start][1]:
                start += 1
            m, q, i = hull[start]
            now.append(m * x + q + x * total[j])
            cut.append(i)
        best = now
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = cut[j]
    if j:
        out.append(lengths[j - 1])
    return sorted(out)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, slice_rows: int = SLICE) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), slot (place in the batch), padding.

    ``length`` is the number of tokens, as ``token_shards.count_tokens`` gives it; by default the number of words.
    """
    size = word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(key).alias("doc_id"), size.alias("n_tokens")), "lengths")
    histogram = [tuple(r) for r in sized.groupBy("n_tokens").count().collect()]
    ends = boundaries(histogram, buckets) or [0]
    slices = max(1, -(-sum(c for _, c in histogram) // slice_rows))
    limits = F.array(*[F.lit(x).cast("long") for x in ends])
    rows = sized.withColumn("u", F.monotonically_increasing_id())
    rows = rows.select("*", F.size(F.filter(limits, lambda x: x < F.col("n_tokens"))).alias("bucket"), F.pmod(F.xxhash64("u"), F.lit(slices)).alias("slice"))
    before = W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    counts = rows.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("nr", F.row_number().over(W.partitionBy("bucket", "slice").orderBy("u")) - 1).join(starts, ["bucket", "slice"])
    end = F.get(limits, F.col("bucket"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(end, F.lit(1)))).cast("long")
    place = F.col("start") + F.col("nr")
    return numbered.select("doc_id", "n_tokens", "bucket", end.alias("bucket_len"), F.floor(place / fits).alias("batch"), F.pmod(place, fits).alias("slot"), (end - F.col("n_tokens")).alias("padding"))
