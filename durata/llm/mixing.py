"""Mixing sources to target weights: random order, prefix sums, exact cuts.

Each document gets a hash-random key. Keys are cut into ranges per source; the token counts
of the ranges give the distributed prefix sums, and only the range in which a source's
budget ends is sorted row by row. A source's target above its size repeats whole epochs.
So a source of any size is spread over many ranges, no task holds more than one range, and
the decision is a small row per source that every document compares its own key with.

Null sources are a source of their own, ordered last; null texts have size zero. Rows equal
in source, id and size are one unit that shares a partial take evenly. Empty tables give
empty results; other columns of any name pass through, but those called like a result
(size, source_size, target, taken) are replaced. The key is the start of the id's MD5 digest, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from durata.llm.common import anonymous, checkpoint, small

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key range at most, about.
RANGE_ROWS = 4_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_key(id_col: str) -> Column:
    """60 bits of the id's digest, which every engine computes alike."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, text: str, source: str, id_col: str) -> DataFrame:
    """Id, source, size in words, and the random order key ``r`` of every document."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("src"),
        n_words(text).alias("size"), random_key(id_col).alias("r"),
    )


def source_ranks(sources: DataFrame) -> DataFrame:
    """0-based position of each source by code point, null last; no one-task sort."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpoint(
        sources.repartitionByRange(min(parts, 64), F.col("src").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").asc_nulls_last()))
    return cut.join(F.broadcast(starts), "part").withColumn("rank", inside - 1 + F.col("start")).drop("part", "start")


def targets(totals: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """Adds ``target``: the sum of all sizes shared by weights 1..cycle along the ranks.

    A share stops at ``most`` times its source's size; the excess is shared again by weight
    until none is above. Only sums cross the driver.
    """
    t = checkpoint(
        source_ranks(totals).selectExpr(
            "src", "source_size", "docs", f"cast(rank % {cycle} + 1 as double) as weight",
            f"{most} * source_size as cap",
        )
    )
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, closed = -1.0, -1
    while True:
        capped = "(false)" if level < 0 else f"(weight * {level!r}D >= cap)"
        used, weight, shut = t.selectExpr(
            f"sum(if({capped}, cap, 0))", f"sum(if({capped}, 0D, weight))",
            f"sum(if({capped}, 1, 0))",
        ).first()
        if not weight or shut == closed:
            break
        level, closed = max(level, (total - used) / weight), shut
    share = f"weight * {max(level, 0.0)!r}D"
    return t.selectExpr("src", "source_size", "docs", f"least({share}, cast(cap as double)) as target")


def cuts(rows: DataFrame, most: int = 3) -> DataFrame:
    """One row per source: whole epochs, and the key, id and words at which the last one ends."""
    totals = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = checkpoint(
        targets(totals, most).selectExpr(
            "src", "source_size", "target", f"cast(ceil(docs / {RANGE_ROWS}D) as long) as ranges",
            "if(source_size = 0, 0, cast(round(target) as long) div source_size) as epochs",
            "if(source_size = 0, 0, cast(round(target) as long) % source_size) as rest",
        )
    )
    narrow = small(goal.select("src", "ranges", "rest"))
    # the top 32 bits of the key, as a fraction of its range
    spot = "cast(floor(shiftright(r, 28) / 4294967296D * ranges) as long)"
    ranged = rows.join(narrow, rows.src.eqNullSafe(narrow.src)).select(
        rows.src, "id", "size", "r", "rest", F.expr(spot).alias("range")
    )
    sums = ranged.groupBy("src", "range", "rest").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    ends = checkpoint(ends.where("rest > 0 and before < rest and before + words >= rest"))
    last = small(ends.selectExpr("src as s", "range as g", "before"))
    inside = ranged.join(last, ranged.src.eqNullSafe(last.s) & (ranged.range == last.g))
    units = inside.groupBy("src", "range", "rest", "before", "r", "id", "size").agg(F.count("*").alias("copies"))
    up_to = Window.partitionBy("src", "range").orderBy("r", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    at = units.withColumn("done", F.col("before") + F.coalesce(F.sum(F.expr("size * copies")).over(up_to), F.lit(0)))
    at = at.where("done < rest and done + size * copies >= rest").selectExpr(
        "src as s", "r as cut_r", "id as cut_id", "size as cut_size",
        "cast(floor((rest - done) / copies) as long) as part",
    )
    return goal.join(at, goal.src.eqNullSafe(at.s), "left").drop("s", "ranges", "rest")


def taken(key: str, size: str) -> str:
    """Words taken of a document: whole epochs, and the last one up to the source's cut."""
    cut = "struct(cut_r, cut_id, cut_size)"
    return (
        f"cast(epochs * {size} + case when cut_r is null then 0 when {key} < {cut} then {size} "
        f"when {key} <=> {cut} then part else 0 end as long) as taken"
    )


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", most: int = 3
) -> DataFrame:
    """The columns of ``docs`` with size, source_size, target and taken (words taken).

    The texts are read twice and never shuffled: once for sizes, once beside the cuts.
    """
    rows, at = anonymous(docs)
    names = at[text], at[source], at[id_col]
    plan = small(checkpoint(cuts(checkpoint(sizes(rows, *names)), most)))
    own = [
        F.col(n).alias(c) for c, n in zip(docs.columns, rows.columns, strict=True)
        if c.lower() not in ("size", "source_size", "target", "taken")
    ]
    sized = rows.select(
        "*", F.col(at[source]).cast("string").alias("__src"), random_key(at[id_col]).alias("__r"),
        n_words(at[text]).alias("__size"),
    )
    return sized.join(plan, F.col("__src").eqNullSafe(F.col("src"))).select(
        *own, F.col("__size").alias("size"), "source_size", "target",
        F.expr(taken(f"struct(__r, {at[id_col]}, __size)", "__size")),
    )


def op8_mixing(docs: DataFrame) -> DataFrame:
    rows = checkpoint(sizes(docs, "text", "source", "doc_id"))
    plan = small(checkpoint(cuts(rows)).withColumnRenamed("src", "plan_src"))
    return rows.join(plan, rows.src.eqNullSafe(plan.plan_src)).selectExpr(
        "id as doc_id", "size", "source_size", "target", taken("struct(r, id, size)", "size")
    )
