"""SimHash near-duplicates by multi-index hashing, with exact distances.

A fingerprint of 64 bits summarises the word shingles of a text. Two fingerprints at most
three bits apart differ by at most one bit in one of two 32-bit segments, so it is enough to
enumerate, per segment, the Hamming ball of radius one, to fetch the segment table's matches
and to verify the distance of the whole fingerprints.

* Copies: equal fingerprints are one row before anything is joined.
* Half balls: of two segments one bit apart exactly one has that bit set, so each
  fingerprint probes only its own segment and the ones with a set bit cleared.
* Hot segment values: pairs in a bucket of more than ``hot_bucket`` fingerprints are not
  enumerated. Everything that probes such a bucket goes another exact way: x and y are
  within three bits if and only if some z is within one bit of x and within two of y. All
  that share such a z are connected as soon as one of them is within one bit of it, so a
  star per z is enough, and rows stay proportional to the fingerprints.

Null text counts as empty; texts without a word have fingerprint zero and are linked like
any others. Further columns may have any name. A null id keeps its row and never becomes a component id (a component of null
ids only has a null component id). Repeated rows stay. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.common import (
    anonymous,
    checkpoint,
    connected_components,
    linked_components,
    small,
    texts_map,
)

SEED = 42
DISTANCE = 3
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a text, A-Z lower-cased, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    rows = map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False))
    return np.fromiter((digest(s, SEED) for s in rows), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes (unsigned).

    Eight counters of one byte share a word, so 255 hashes are added at a time.
    """
    n = len(hashes)
    if n == 0:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    out = 0
    for k in range(8):
        lanes = ((padded >> np.uint64(k)) & _ONES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for j in np.flatnonzero(2 * counts > n):
            out |= 1 << (k + 8 * int(j))
    return out


def with_fingerprints(
    docs: DataFrame, shingle: int = 5, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (default: every other column) and ``fingerprint`` (long, two's complement)."""

    def fn(texts: list[bytes]) -> list[pa.Array]:
        out = [fingerprint(shingle_hashes(t, shingle)) for t in texts]
        return [pa.array(np.array(out, np.uint64).view(np.int64))]

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    return texts_map(docs, fn, text, keep, "fingerprint long")


def _segments() -> str:
    return (
        "stack(2, 0, fp & 4294967295L, fp, 1, shiftrightunsigned(fp, 32), fp) as (seg, key, fp)"
    )


def _bits(values: list[int]) -> str:
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    return "array(" + ", ".join("(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"{v}L" for v in signed) + ")"


def links(fps: DataFrame, hot_bucket: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at most three bits apart.

    ``fps`` has distinct values in ``fp``. Every returned edge is such a link or a path of
    two; every link is an edge or, in hot buckets, lies inside a connected star.
    """
    entries = fps.selectExpr(_segments())
    probes = entries.selectExpr(
        "seg", "fp",
        "explode(concat(array(struct(key, true as same)), transform(filter(sequence(0, 31), "
        "b -> shiftrightunsigned(key, b) & 1L = 1L), "
        "b -> struct(key - shiftleft(1L, b) as key, false as same)))) as p",
    ).selectExpr("seg", "p.key as key", "p.same as same", "fp as a")
    hot = checkpoint(
        entries.groupBy("seg", "key").agg(F.count("*").alias("n")).where(f"n > {hot_bucket}")
        .select("seg", "key")
    )
    some_hot = not hot.isEmpty()
    held = entries.join(hot, ["seg", "key"], "left_anti") if some_hot else entries
    pairs = (
        probes.join(held.withColumnRenamed("fp", "b"), ["seg", "key"])
        .where(f"(a < b or not same) and bit_count(a ^ b) <= {DISTANCE}")
        .select("a", "b")
        .distinct()
    )
    if not some_hot:
        return pairs
    reach = checkpoint(
        probes.join(hot, ["seg", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
    )
    one = [1 << i for i in range(64)]
    two = [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    members = reach.selectExpr("fp", "true as near", f"explode(concat(array(0L), {_bits(one)})) as d")
    members = members.unionByName(
        reach.selectExpr("fp", "false as near", f"explode({_bits(two)}) as d")
    ).selectExpr("fp", "near", "fp ^ d as z")
    centres = members.groupBy("z").agg(
        F.min(F.expr("case when near then fp end")).alias("a"), F.count("*").alias("n")
    ).where("a is not null and n > 1")
    stars = members.join(centres, "z").where("fp <> a").selectExpr("a", "fp as b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    id_col: str = "doc_id",
    text: str = "text",
    hot_bucket: int = 4096,
    extra: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, ``extra`` columns, ``fingerprint`` and ``component_id``.

    The component id is the smallest id reachable over links of at most three bits. An extra
    column called like a result is replaced by it.
    """
    extra = extra or []
    held, at = anonymous(docs)
    kept = list(dict.fromkeys([id_col, *extra]))
    rows = checkpoint(
        with_fingerprints(held, shingle, at[text], [at[c] for c in kept]).withColumnRenamed(
            "fingerprint", "fp"
        )
    )
    by_fp = checkpoint(rows.groupBy("fp").agg(F.min(at[id_col]).alias("first")))
    parts = connected_components(links(by_fp.select("fp"), hot_bucket))
    rooted = by_fp.join(
        parts.withColumnRenamed("node", "fp"), "fp", "left"
    ).selectExpr("fp", "first", "coalesce(component, fp) as root")
    rooted = checkpoint(rooted)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = checkpoint(rooted.join(lowest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        *[F.col(at[c]).alias(c) for c in kept if c not in ("fingerprint", "component_id")],
        F.col("fp").alias("fingerprint"), "component_id",
    )


#: Words of a wide fingerprint, and the widths of its segments.
WIDE, SEGMENT = 4, 21
#: Bits of a chunk; three chunks, each from a word of its own, make a segment of the second set.
CHUNK = SEGMENT // 3
_MIX = [np.uint64(c) for c in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """Four fingerprints of 64 bits from independent mixes of the shingle hashes."""
    out = []
    for c in _MIX:
        h = hashes * c
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out.append(fingerprint(h))
    return out


def _close(similarity: float, spread: float = 3.0) -> tuple[int, int]:
    """Bits in which one word, and the whole, of texts that similar may differ.

    The expected share is the angle between the shingle counts over pi; ``spread`` standard
    deviations are allowed on top, since the similarity itself is verified afterwards.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return tuple(int(n * p + spread * (n * p * (1 - p)) ** 0.5) for n in (64, 64 * WIDE))


def wide_segments() -> list[tuple[str, int]]:
    """SQL of each segment of a wide fingerprint, and the word that serves as its cheap test.

    The first twelve are runs of 21 bits of one word. The other twelve take seven bits from
    each of three words, so each shares at most seven bits with one of the first set, and a
    pair that the first set misses has nearly as good a chance again.
    """
    out = [
        (f"(shiftrightunsigned(f{w}, {SEGMENT * s}) & {(1 << SEGMENT) - 1}L)", (w + 1) % WIDE)
        for w in range(WIDE)
        for s in range(3)
    ]
    part = (1 << CHUNK) - 1
    for left in range(WIDE):
        words = [w for w in range(WIDE) if w != left]
        for turn in range(3):
            # over the words, every chunk of 7 bits is used once
            at = [(3 * turn + (left - w) % WIDE - 1) * CHUNK for w in words]
            bits = [
                f"shiftleft(shiftrightunsigned(f{w}, {a}) & {part}L, {CHUNK * i})"
                for i, (w, a) in enumerate(zip(words, at, strict=True))
            ]
            out.append(("(" + " | ".join(bits) + ")", left))
    return out


def drop_similar(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
    text: str = "text", hot: int = 256,
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates.

    For a similarity below what three bits of 64 can tell, fingerprints have 256 bits, cut
    into segments in two ways (``wide_segments``); again the Hamming balls of radius one around each segment are probed,
    the complete distances are verified, and last the Jaccard similarity of the shingle sets.
    Equal texts are one before that, and hot segment values go through leaders. The document
    with the smallest id stays (null ids last, then by text hash); of repeated rows one.
    Texts are never shuffled unless the dropped ids are too many to broadcast.
    """
    one, whole = _close(similarity)

    def fn(texts: list[bytes]) -> list[pa.Array]:
        made = np.array(
            [wide_fingerprint(shingle_hashes(t, shingle)) for t in texts], np.uint64
        ).reshape(-1, WIDE)
        return [pa.array(made[:, i].view(np.int64) if made.size else [], pa.int64()) for i in range(WIDE)]

    words = [f"f{i}" for i in range(WIDE)]
    named, at = anonymous(docs)
    id_col, text = at[id_col], at[text]
    base = named.select(
        F.col(id_col).alias("id"), F.col(text), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")
    )
    rows = checkpoint(texts_map(base, fn, text, ["id", "th"], ", ".join(f"{w} long" for w in words)))
    distinct = checkpoint(
        rows.groupBy("th").agg(F.min("id").alias("first"), *[F.any_value(w).alias(w) for w in words])
    )
    segments = ", ".join(
        f"struct({n << SEGMENT}L as seg, {v} as v, f{p} as p)" for n, (v, p) in enumerate(wide_segments())
    )
    table = distinct.selectExpr("th", f"inline(array({segments}))")
    entries = table.selectExpr("seg + v as key", "th as b", "p as pb")
    probes = table.selectExpr(
        "th as a", "p as pa",
        f"explode(concat(array(seg + v), transform(filter(sequence(0, {SEGMENT - 1}), i -> "
        "shiftrightunsigned(v, i) & 1L = 1L), i -> seg + v - shiftleft(1L, i)))) as key",
    )

    def verify(pairs: DataFrame) -> DataFrame:
        side = {
            c: distinct.selectExpr(f"th as {c}", *[f"{w} as {c}{w}" for w in words]) for c in "ab"
        }
        apart = " + ".join(f"bit_count(a{w} ^ b{w})" for w in words)
        near = checkpoint(
            pairs.join(side["a"], "a").join(side["b"], "b").where(f"{apart} <= {whole}").select("a", "b")
        )
        wanted = near.select(F.col("a").alias("th")).union(near.select("b")).distinct()
        homes = small(checkpoint(distinct.join(wanted, "th").select("th", F.col("first").alias("id"))))
        held = base.join(
            homes.withColumnsRenamed({"id": "hi", "th": "ht"}),
            (F.col("th") == F.col("ht")) & F.col("id").eqNullSafe(F.col("hi")), "left_semi",
        )

        def sets(texts: list[bytes]) -> list[pa.Array]:
            made = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
            return [pa.array(made, pa.list_(pa.int64()))]

        found = texts_map(held, sets, text, ["th"], "s array<long>")
        found = checkpoint(found.groupBy("th").agg(F.any_value("s").alias("s")))
        both = near.join(found.withColumnsRenamed({"th": "a", "s": "sa"}), "a").join(
            found.withColumnsRenamed({"th": "b", "s": "sb"}), "b"
        ).withColumn("n", F.size(F.array_intersect("sa", "sb")))
        return both.where(f"n >= {similarity}D * (size(sa) + size(sb) - n)").select("a", "b")

    parts = linked_components(probes, entries, f"bit_count(pa ^ pb) <= {one}", verify, hot)
    rooted = distinct.select("th", "first").join(
        parts.withColumnRenamed("node", "th"), "th", "left"
    ).withColumn("root", F.coalesce("component", "th"))
    order = F.struct(F.col("first").isNull().alias("n"), F.col("first").alias("id"), F.col("th").alias("th"))
    kept = rooted.groupBy("root").agg(F.min(order).alias("k"))
    kept = checkpoint(rooted.join(kept, "root").selectExpr("th", "k.id as kid", "k.th as kth"))
    gone = rows.join(kept, "th").where("not (th = kth and id <=> kid)").select("id", "th").distinct()
    gone = small(checkpoint(gone))
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    left = named.join(gone, F.col(id_col).eqNullSafe(F.col("id")) & (hashed == F.col("th")), "left_anti")
    again = rows.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        left = left.withColumn("th", hashed).dropDuplicates([id_col, "th"]).drop("th")
    return left.toDF(*docs.columns)


def op2_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, shingle=3)
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
