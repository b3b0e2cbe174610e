"""Packing into batches by length buckets that are chosen to leave the least padding.

Documents are cut into sequences of at most ``most`` tokens. The histogram of sequence lengths,
at most ``most`` rows whatever the corpus holds, decides the buckets: dynamic programming finds
the bucket lengths that minimise the total padding exactly. A bucket's sequences, in order of
document and place, fill batches of as many rows as the token budget allows at that length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import numbered

MOST = 2048
BUCKETS = 8
BUDGET = 65_536
WORDS = r"[^\x20\x09-\x0D]+"


def word_tokens(text_col: str = "text") -> Column:
    """The words of a text plus one for the end sign; a null text has the end sign alone."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long") + 1


def choose_buckets(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Ascending bucket lengths, at most ``buckets``, that minimise the padding of the histogram.

    ``best[i]`` is the least padding of the i shortest lengths with the buckets used so far; the
    next bucket ends at a longer length. Among equal choices the shorter prefix wins.
    """
    lengths = sorted(k for k, n in histogram.items() if n > 0)
    if not lengths:
        return []
    at = np.array([0, *lengths], np.int64)
    rows = np.concatenate(([0], np.cumsum([histogram[k] for k in lengths]))).astype(np.int64)
    tokens = np.concatenate(([0], np.cumsum([histogram[k] * k for k in lengths]))).astype(np.int64)
    best, backs = [0] + [None] * len(lengths), []
    for _ in range(min(buckets, len(lengths))):
        known = np.array([j for j, b in enumerate(best) if b is not None])
        cost = np.array([best[j] for j in known], dtype=np.int64)
        then, back = [None] * len(best), [0] * len(best)
        for i in range(1, len(best)):
            m = int(np.searchsorted(known, i))
            if m:
                j = known[:m]
                total = cost[:m] + at[i] * (rows[i] - rows[j]) - (tokens[i] - tokens[j])
                k = int(total.argmin())
                then[i], back[i] = int(total[k]), int(j[k])
        best = then
        backs.append(back)
    ends, i = [], len(lengths)
    for back in reversed(backs):
        ends.append(int(at[i]))
        i = back[i]
    return ends[::-1]


def sequences(docs: DataFrame, length: str, most: int = MOST, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, sequence, start, n_tokens): each document in stretches of ``most`` tokens, the last one shorter.

    Rows without a length, or of length 0, have one sequence of 0 tokens.
    """
    whole = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole.alias("whole"))
    last = F.greatest(F.lit(0), F.expr(f"(whole - 1) div {most}"))
    rows = rows.select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("sequence"))
    start = F.col("sequence") * most
    return rows.select("doc_id", "sequence", start.alias("start"), F.least(F.lit(most), F.col("whole") - start).alias("n_tokens"))


def pack(docs: DataFrame, length: str, most: int = MOST, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, sequence, start, n_tokens, bucket, bucket_tokens, batch, slot) of every sequence.

    ``bucket`` counts from 0 by length, ``batch`` and ``slot`` from 0 in their bucket. Sequences
    of 0 tokens are in no bucket. Repeated rows are packed as often as they come.
    """
    cut = sequences(docs, length, most, id_col)
    counts = {r.n_tokens: r["count"] for r in cut.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    ends = choose_buckets(counts, buckets)
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in reversed(range(len(ends))):
        fits = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= ends[k])
        bucket, padded = F.when(fits, F.lit(k)).otherwise(bucket), F.when(fits, F.lit(ends[k]).cast("long")).otherwise(padded)
    placed = numbered(cut.withColumns({"bucket": bucket, "bucket_tokens": padded}), ["doc_id", "sequence"], ["bucket"], "place")
    rows = F.greatest(F.lit(1), F.expr(f"{budget} div bucket_tokens"))
    return placed.select(
        "doc_id", "sequence", "start", "n_tokens", "bucket", "bucket_tokens",
        F.when(F.col("bucket").isNotNull(), F.floor(F.col("place") / rows).cast("long")).alias("batch"),
        F.when(F.col("bucket").isNotNull(), F.col("place") % rows).alias("slot"),
    )


def oracle(most: int = MOST, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same in SQL, one step of the dynamic programme for each bucket; for at least ``buckets`` different lengths."""
    steps = ["b0 AS (SELECT 0 AS i, CAST(0 AS HUGEINT) AS cost, 0 AS j)"]
    for k in range(1, buckets + 1):
        steps.append(
            f"""b{k} AS (SELECT i, min(total) AS cost, arg_min(j, (total, j)) AS j FROM (SELECT c.i, p.i AS j, p.cost + c.len * (c.n - q.n) - (c.s - q.s) AS total
  FROM b{k - 1} p JOIN c q ON q.i = p.i JOIN c ON c.i > p.i) GROUP BY i)"""
        )
    cuts = [f"e{buckets} AS (SELECT max(i) AS i FROM c)"]
    cuts += [f"e{k - 1} AS (SELECT j AS i FROM b{k} WHERE i = (SELECT i FROM e{k}))" for k in range(buckets, 1, -1)]
    ends = " UNION ALL ".join(f"SELECT {k - 1} AS bucket, len AS bucket_tokens FROM c WHERE i = (SELECT i FROM e{k})" for k in range(1, buckets + 1))
    return f"""WITH w AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) + 1 AS BIGINT) AS whole FROM documents),
s AS (SELECT doc_id, whole, unnest(range((whole - 1) // {most} + 1)) AS sequence FROM w),
r AS (SELECT doc_id, sequence, sequence * {most} AS start, least({most}, whole - sequence * {most}) AS n_tokens FROM s),
h AS (SELECT n_tokens AS len, CAST(count(*) AS HUGEINT) AS n FROM r GROUP BY n_tokens),
c AS (SELECT 0 AS i, 0 AS len, CAST(0 AS HUGEINT) AS n, CAST(0 AS HUGEINT) AS s UNION ALL
  SELECT row_number() OVER (ORDER BY len), len, sum(n) OVER (ORDER BY len), sum(n * len) OVER (ORDER BY len) FROM h),
{', '.join(steps)}, {', '.join(cuts)}, e AS ({ends}),
p AS (SELECT r.*, (SELECT min(bucket) FROM e WHERE bucket_tokens >= r.n_tokens) AS bucket FROM r),
o AS (SELECT p.*, e.bucket_tokens, row_number() OVER (PARTITION BY p.bucket ORDER BY doc_id, sequence) - 1 AS place FROM p JOIN e ON e.bucket = p.bucket)
SELECT doc_id, CAST(sequence AS BIGINT) AS sequence, CAST(start AS BIGINT) AS start, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket,
  CAST(bucket_tokens AS BIGINT) AS bucket_tokens, CAST(place // ({budget} // bucket_tokens) AS BIGINT) AS batch, CAST(place % ({budget} // bucket_tokens) AS BIGINT) AS slot FROM o"""
