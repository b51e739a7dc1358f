"""Exact top-k by inner product with norm buckets, local thresholds and verified products.

Vectors are sorted into buckets by length (norm), queries into blocks. A first round scores
every query block against the buckets of the longest vectors, which gives each query a bound
on its k-th best score. In the second round a (block, bucket) cell survives only if the
longest query of the block times the longest vector of the bucket can still reach the
block's lowest bound. Within a cell each query has a local cosine threshold, its bound over
the two norms: above one the query skips the bucket; where the threshold is high, candidates
are pruned by coordinates (on the query's largest coordinate a candidate's unit value must
lie within the range that the threshold allows); where it is low, only by their own length.
What is left is verified by whole inner products, and the best k of all cells are kept.

Cells have a bounded number of queries and candidates, so no task holds more than one cell;
neither queries nor vectors pass through the driver. Components are floor(scale * x), scores
exact integers, ties go to the smaller id. Components and scores beyond a long count as its
nearest end (and then tie). Ids keep their type.

Vectors that are null or hold a null or non-finite component take no part; shorter vectors
count as padded with zeros. Null ids take no part. Repeated rows each count (a query's own
row is excluded by id). Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from durata.llm.common import checkpoint, small

CELL = 4096
LONGEST = 2**63 - 1


def integer_vectors(table: DataFrame, id_col: str, vec: str, scale: int) -> DataFrame:
    """(id, v: array<bigint>, n2: squared norm) of the vectors that take part."""
    fine = table.where(
        F.col(vec).isNotNull() & F.col(id_col).isNotNull()
        & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    )
    v = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return fine.select(F.col(id_col).alias("id"), v.alias("v")).withColumn(
        "n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )


def bucketed(vectors: DataFrame, cell: int, out: str) -> DataFrame:
    """Adds ``out``: 0 for the longest vectors, about ``cell`` of them per bucket.

    Ranges of (norm, hash of the id) from approximate quantiles; vectors of one norm that
    overfill a range are dealt to further buckets by their hash.
    """
    n = vectors.count()
    k = max(1, -(-n // cell))
    probs = [i / k for i in range(1, k)]
    cuts = vectors.approxQuantile("n2", probs, 0.2 / k) if probs else []
    edges = sorted(set(cuts), reverse=True)
    rank = (
        F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in edges)}), c -> n2 < c))")
        if edges else F.lit(0)
    )
    ranged = vectors.withColumn("__r", rank)
    sizes = ranged.groupBy("__r").agg(F.count("*").alias("__n")).select(
        "__r", F.ceil(F.col("__n") / cell).cast("long").alias("__parts")
    )
    first = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__parts").over(first), F.lit(0)))
    part = F.expr("pmod(xxhash64(id, v), __parts)")
    return ranged.join(small(checkpoint(sizes)), "__r").withColumn(
        out, F.col("__base") + part
    ).drop("__r", "__parts", "__base")


def matrix(column: pd.Series, width: int) -> np.ndarray:
    if all(len(x) == width for x in column):
        return np.stack(column.to_numpy()).astype(np.float64)
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def score_cell(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k candidates per query of one cell that reach the query's bound."""
    empty = pd.DataFrame(
        {"query_id": q["id"].iloc[:0], "vec_id": c["id"].iloc[:0], "score": np.empty(0, np.int64)}
    )
    if not len(q) or not len(c):
        return empty
    width = max(max(map(len, q["v"])), max(map(len, c["v"])), 1)
    c = c.sort_values("id", kind="stable")
    a, b = matrix(q["v"], width), matrix(c["v"], width)
    ids, own = c["id"].to_numpy(), q["id"].to_numpy()
    bound = q["bound"].to_numpy(dtype=np.float64, na_value=-np.inf)
    qn, cn = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    exact = float(qn.max(initial=0)) * float(cn.max(initial=0)) < 2.0**53
    unit = b / np.where(cn > 0, cn, 1)[:, None]
    longest = float(cn.max())
    found = []
    for i in range(len(a)):
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = bound[i] / (qn[i] * longest) if qn[i] * longest > 0 else (0.0 if bound[i] <= 0 else 2.0)
        if cosine > 1 + 1e-9:
            continue
        if cosine > 0.3 and qn[i] > 0:
            # coordinate pruning: with f the query's unit value there, x the candidate's,
            # the rest contributes at most sqrt(1 - f*f) * sqrt(1 - x*x)
            j = int(np.argmax(np.abs(a[i])))
            f = a[i, j] / qn[i]
            local = bound[i] / (qn[i] * np.where(cn > 0, cn, np.inf))
            reach = f * unit[:, j] + np.sqrt(max(0.0, 1 - f * f)) * np.sqrt(np.clip(1 - unit[:, j] ** 2, 0, 1))
            pick = np.flatnonzero(reach >= local - 1e-9)
        else:
            pick = np.flatnonzero(qn[i] * cn >= bound[i] - 1e-6 - 1e-9 * abs(bound[i]))
        if not len(pick):
            continue
        if exact:
            score = np.rint(b[pick] @ a[i])
        else:
            x = [int(v) for v in q["v"].iloc[i]]
            score = np.array(
                [sum(s * int(t) for s, t in zip(x, c["v"].iloc[p], strict=False)) for p in pick], object
            )
            score = np.array([min(max(s, -LONGEST - 1), LONGEST) for s in score], np.int64)
        ok = (ids[pick] != own[i]) & (score >= bound[i])
        pick, score = pick[ok], score[ok]
        if len(pick) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            above, tied = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
            take = np.concatenate([above, tied[: k - len(above)]])  # candidates are in id order
            pick, score = pick[take], score[take]
        found.append((np.full(len(pick), own[i]), ids[pick], score.astype(np.int64)))
    if not found:
        return empty
    return pd.DataFrame(
        dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True))
    )


def best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def grid(blocks: DataFrame, buckets: DataFrame, last: int) -> DataFrame:
    """A row per block and bucket: numbers and bounds only, no vectors."""
    numbered = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    return numbered.join(small(buckets), "bucket")


def cells(queries: DataFrame, vectors: DataFrame, which: DataFrame, k: int) -> DataFrame:
    """Scores of the (block, bucket) cells in ``which``."""
    which = small(checkpoint(which))
    q = queries.join(which, "block").selectExpr("block as qb", "bucket as qc", "id", "v", "bound")
    c = vectors.join(which, "bucket").selectExpr("block as cb", "bucket as cc", "id", "v")
    kind = [df.schema["id"].dataType.simpleString() for df in (queries, vectors)]
    return q.groupBy("qb", "qc").cogroup(c.groupBy("cb", "cc")).applyInPandas(
        lambda x, y: score_cell(x, y, k), f"query_id {kind[0]}, vec_id {kind[1]}, score long"
    )


def top_k(
    table: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding",
    scale: int = 64, cell: int = CELL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``table`` other than the query."""
    vectors = checkpoint(bucketed(integer_vectors(table, id_col, vec, scale), cell, "bucket"))
    blocked = checkpoint(
        bucketed(integer_vectors(queries, id_col, vec, scale), cell, "block").withColumn(
            "bound", F.lit(None).cast("double")
        )
    )
    sizes = vectors.groupBy("bucket").agg(F.count("*").alias("n"), F.max("n2").alias("b2"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpoint(sizes.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0))))
    every = blocked.groupBy("block").agg(F.max("n2").alias("q2"))
    # enough of the longest vectors for k candidates beside the query itself
    last = sizes.agg(F.max("bucket")).first()[0] or 0
    start = grid(every, sizes, last).where(f"above < {k + 1}").select("block", "bucket")
    one = checkpoint(best(cells(blocked, vectors, start, k), k))
    # a double may lie above the long that it stands for; a lower bound loses nothing
    near = "if(abs(cast(score as double)) < 9e15D, 0D, 1e-15D * abs(cast(score as double)))"
    bound = one.where(f"rank = {k}").selectExpr("query_id as id", f"score - {near} as b")
    bounded = checkpoint(
        blocked.drop("bound").join(bound, "id", "left").withColumnRenamed("b", "bound")
    )
    limits = bounded.groupBy("block").agg(
        F.max("n2").alias("q2"), F.min(F.coalesce("bound", F.lit(float("-inf")))).alias("low")
    )
    rest = grid(limits, sizes, last).where(
        f"above >= {k + 1} and sqrt(q2) * sqrt(b2) * (1 + 1e-9D) >= low - 1e-6D"
    ).select("block", "bucket")
    two = cells(bounded, vectors, rest, k)
    return best(one.drop("rank").unionByName(two), k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(embeddings: DataFrame) -> DataFrame:
    found = top_k(embeddings, embeddings.where("vec_id % 20 = 0"), 20)
    return found.withColumns({c: F.col(c).cast("long") for c in ("query_id", "vec_id")})
