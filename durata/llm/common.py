"""Helpers shared by the operators: reliable checkpoints, components, Arrow row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest row count that is ever broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    A folder of its own is chosen only in a plain local session that names none.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith(("local[", "local*")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="durata-llm-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def spent_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query are deleted when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, *more: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: smaller than a checkpoint.

    ``more`` frames of the same columns are added to that table, one after the other, so that
    only one frame's shuffle files lie on disk at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with spent_shuffles_go(spark):
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def in_turns(df: DataFrame, turns: int) -> list[DataFrame]:
    """``df`` in ``turns`` parts by its ``key``; a key lies in one of them."""
    return [df.where(f"pmod(key, {turns}) = {i}") for i in range(turns)] if turns > 1 else [df]


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once all that was made of them is written too."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted), else as it is.

    Give it a checkpointed frame: the count then reads only that.
    """
    return F.broadcast(df) if df.count() <= rows else df


def anonymous(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by position, and what each is called there.

    Operators join under these names, so no column of a table clashes with one of theirs.
    """
    names = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` at a time: only the texts of a slice are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_map(
    df: DataFrame,
    fn: Callable[[list[bytes]], list[pa.Array]],
    text: str,
    keep: list[str],
    added: str,
) -> DataFrame:
    """Add columns computed from whole texts, batch by batch.

    ``fn`` takes the texts of a slice of an Arrow batch as UTF-8 bytes (null: empty) and returns one
    array per column named in the DDL ``added``.
    """
    kept = df.select(*[f"`{c}`" for c in keep], F.col(text).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    names = [*keep, *[x.split()[0] for x in added.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            new = fn([x or b"" for x in raw])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    return kept.mapInArrow(run, ", ".join([*fields, added]))


def _signature(edges: DataFrame) -> tuple:
    """Edges, nodes that hang on exactly one root, and a digest of the edges."""
    sides = edges.selectExpr("u as x", "1 as low", "0 as high", "xxhash64(u, v) as h").unionAll(
        edges.selectExpr("v", "0", "1", "0L")
    )
    nodes = sides.groupBy("x").agg(
        F.sum("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")
    )
    row = nodes.selectExpr(
        "coalesce(sum(low), 0)", "coalesce(sum(if(low = 1 and high = 0, 1, 0)), 0)", "sum(h)"
    ).first()
    return row[2], row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Large-star and small-star rounds: edges are re-hung on ever smaller neighbours until
    they form stars, in a number of rounds that grows with the logarithm of the longest
    path. Only joins and aggregates; nothing but two numbers a round reaches the driver.
    """
    e = checkpoint(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    seen = _signature(e)
    while seen[1] and seen[1] != seen[2]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").selectExpr("v as u", "m as v")
        e = checkpoint(hung.unionByName(low.selectExpr("u", "m as v")).distinct())
        now = _signature(e)
        if now == seen or now[1] == now[2]:
            break
        seen = now
    return e.selectExpr("u as node", "v as component").unionByName(
        e.selectExpr("v as node", "v as component").distinct()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def near_pairs(probes: DataFrame, entries: DataFrame, near: str, more: str = "true") -> DataFrame:
    """(a, b), a < b, of every probe and entry with the same key that ``near`` holds for."""
    both = probes.join(entries, "key").where(f"a <> b and ({near}) and ({more})")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_components(
    probes: DataFrame,
    entries: DataFrame,
    near: str,
    verify: Callable[[DataFrame], DataFrame],
    hot: int = 256,
    rounds: int = 4,
    budget: int = 32,
    mirrored: bool = False,
    found: DataFrame | None = None,
) -> DataFrame:
    """Components over all verified pairs of a probe and an entry with the same key.

    ``probes`` has (key, a, pa), ``entries`` (key, b, pb): ids and what the cheap test
    ``near`` (SQL over a, b, pa, pb) needs. ``verify`` takes distinct pairs (a, b) and
    returns those that are linked, or as many of them as connect the same. Every linked pair ends up in one component, yet a key
    shared by n entries does not cost n * n pairs: beyond ``hot`` entries a key first links
    everything to one leader; after that only pairs of different components can matter,
    and they are few once most of the key's entries are in the leader's component. While
    they are more than ``budget`` times the rows, up to ``rounds`` further leaders are taken;
    then all pairs that are left are verified, so nothing is dropped. ``mirrored`` says that
    probes and entries are the same rows, so cold pairs need one order only. ``found`` has pairs
    (a, b), a < b, of further keys, to be verified with the first ones.
    """
    stat = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("b", "pb")).alias("l"))
    hot_keys = stored(stat.where(f"n > {hot}").selectExpr("key", "l.b as b", "l.pb as pb"))

    def pairs(p: DataFrame, e: DataFrame, more: str = "true") -> DataFrame:
        return near_pairs(p, e, near, more)

    def verified(p: DataFrame) -> DataFrame:
        p = stored(p.distinct())
        out = stored(verify(p))
        discard(p)
        return out

    once = "a < b" if mirrored else "true"
    some_hot = not hot_keys.isEmpty()
    cold = entries.join(hot_keys.select("key"), "key", "left_anti") if some_hot else entries
    first = pairs(probes, cold, once)
    if some_hot:
        first = first.unionByName(pairs(probes, hot_keys))
    if found is not None:
        first = first.unionByName(found)
    edges = verified(first)
    if not some_hot:
        return connected_components(edges)
    hot_p = stored(probes.join(hot_keys.select("key"), "key", "left_semi"))
    hot_e = stored(entries.join(hot_keys.select("key"), "key", "left_semi"))
    leaders = hot_keys
    for turn in range(rounds + 1):
        parts = stored(connected_components(edges))

        def named(df: DataFrame, col: str, out: str, parts: DataFrame = parts) -> DataFrame:
            return df.join(parts.withColumnRenamed("node", col), col, "left").withColumn(
                out, F.coalesce("component", col)
            ).drop("component")

        heads = named(leaders.selectExpr("key", "b as head"), "head", "ch").select("key", "ch")
        p = named(hot_p, "a", "ca").join(heads, "key").withColumn("odd", F.expr("ca <> ch"))
        e = named(hot_e, "b", "cb").join(heads, "key").withColumn("odd", F.expr("cb <> ch"))
        p, e = stored(p.drop("ch")), stored(e.drop("ch"))
        odd_p, odd_e = p.where("odd"), e.where("odd")
        count_p = p.groupBy("key").agg(F.count("*").alias("np"), F.sum(F.col("odd").cast("long")).alias("op"))
        count_e = e.groupBy("key").agg(F.count("*").alias("ne"), F.sum(F.col("odd").cast("long")).alias("oe"))
        cost, rows = count_p.join(count_e, "key").selectExpr(
            "sum(np * oe + op * ne)", "sum(np + ne)"
        ).first()
        if not cost:
            return parts
        if cost <= budget * rows or turn == rounds:
            left = pairs(p.drop("odd"), odd_e.drop("odd"), "ca <> cb").unionByName(
                pairs(odd_p.drop("odd"), e.drop("odd"), "ca <> cb")
            )
            return connected_components(stars(parts).unionByName(verified(left)))
        leaders = (
            odd_e.groupBy("key").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)), "b", "pb")).alias("l"))
            .selectExpr("key", "l.b as b", "l.pb as pb")
        )
        extra = pairs(p.drop("odd"), named(leaders, "b", "cb"), "ca <> cb")
        edges = stored(stars(parts).unionByName(verified(extra)))
        done = leaders.select("key")
        leaders = stored(leaders.unionByName(heads_of(hot_keys, done)))
    raise AssertionError("unreachable")


def stars(parts: DataFrame) -> DataFrame:
    """(a, b): an edge a node, which connect the same nodes as all links that ``parts`` came from."""
    return parts.selectExpr("node as a", "component as b")


def heads_of(keys: DataFrame, done: DataFrame) -> DataFrame:
    return keys.join(done, "key", "left_anti")
