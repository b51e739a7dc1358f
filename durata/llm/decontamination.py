"""Benchmark decontamination by spaced seeds, with substitution-tolerant verification.

Tokens are lower-case words without ASCII punctuation. A seed is a fixed mask over a window
of tokens: the positions it ignores may differ, the others are hashed together. Seeds of the
documents are joined with those of the benchmark; around each hit the two token sequences are
compared along the same alignment (diagonal), and any segment is an overlap that has
at least ``min_overlap`` tokens (or the whole of a shorter item of at least a window) of which
``similarity`` match. Of several the one with the most matches above that share is reported.

How it scales: benchmark items are distinct texts before they are hashed, in tasks, and never
pass through the driver. The only thing of theirs that every task holds is a bit table of at
most ``FILTER_BITS`` bits: a document seed without its three bits set is in no item and is not
written. A fuller table lets more seeds through and loses none. What is left is joined with
the benchmark's seeds; hits are reduced to distinct (text, item, diagonal), so copies of a
document count once, and only texts with a hit are read again to cut out the tokens that lie
opposite an item. Sides of the joins are broadcast only if their counted bytes are at most
``BROADCAST_BYTES``; beyond it, a seed, item or text with over ``hot`` rows is split over
copies of the other side's row. Tokens and texts are compared as 64-bit hashes.

Null texts count as empty and are clean; items shorter than a window are matched only whole
and only if they have at least ``shortest`` tokens; null ids, repeated rows and items stay
as they are; ids of documents and items may have any type. An empty benchmark leaves every
document clean; other columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.common import anonymous, discard, stored

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: 1: hashed, 0: ignored (may differ).
MASKS = ("11111111", "110110110011", "101100111011", "111001011011", "110111000111")
_RNG = np.random.default_rng(20240229)
_FACTORS = (_RNG.integers(1, 2**63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)
#: Bits of the table of benchmark seeds: per seed, in all, and set by a seed.
BITS_PER_SEED, FILTER_BITS, PROBES = 64, 1 << 27, 3
#: The largest side of a join that is broadcast, in counted bytes.
BROADCAST_BYTES = 16 << 20
#: Tokens in a worker's cache of hashes; tokens (of several texts, or one) hashed at once.
CACHE, BATCH = 300_000, 100_000


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split()


class TokenHashes(dict):
    """64-bit hashes of tokens, eight bytes each, computed once per worker (bounded)."""

    def __missing__(self, token: bytes) -> bytes:
        h = self[token] = xxhash.xxh64_digest(token)
        return h

    def of(self, text: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, tokens(text)))


def seed_hashes(held: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """The hash of every window of these token hashes, ``BATCH`` windows at a time.

    Per slice and mask: the first window, the mask's width, and the hashes.
    """
    ids = np.frombuffer(held, np.uint64)
    widest = max(map(len, MASKS))
    for low in range(0, len(ids), BATCH):
        part = ids[low : low + BATCH + widest - 1]
        # token hashes are spread evenly, and so are their sums with odd factors
        scaled = [part * f for f in _FACTORS[:widest]]
        for mask in MASKS:
            n = max(0, min(BATCH, len(part) - len(mask) + 1))
            h = np.full(n, int(mask, 2), np.uint64)
            for i, c in enumerate(mask):
                if c == "1":
                    h += scaled[i][i : i + n]
            yield low, len(mask), h


def probe(h: np.ndarray, size: int, k: int) -> np.ndarray:
    """The ``k``-th place of each hash in a table of ``size`` bits (a power of two)."""
    return ((h * _FACTORS[-1 - k]) >> np.uint64(20)) & np.uint64(size - 1)


def best_segment(match: np.ndarray, similarity: float, least: int) -> tuple[int, int] | None:
    """[start, stop) of the best segment of at least ``least`` tokens of which ``similarity`` match.

    The best one has the most matches above its share (highest sum of 1 - similarity per match,
    -similarity otherwise); of ties the longest. None if no segment meets the rule. The sums
    are in whole billionths, so a segment exactly at the similarity counts.
    """
    least = max(1, least)
    if len(match) < least:
        return None
    share = int(np.floor(similarity * 1e9 + 1e-3))
    total = np.concatenate([[0], np.cumsum(np.where(match, 10**9 - share, -share))])
    lowest = np.minimum.accumulate(total[: len(total) - least])
    above = total[least:] - lowest
    if above.max() < 0:
        return None
    at = np.flatnonzero(above == above.max())
    starts = np.searchsorted(-lowest, -lowest[at], "left")
    k = int(np.argmax(at - starts))
    return int(starts[k]), int(at[k]) + least


def _rows(names: list[str], columns: list[np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def items_of(benchmark: DataFrame, text: str) -> DataFrame:
    """(ih, n, held): hash, token count and token hashes of every distinct benchmark text."""
    texts = benchmark.select(F.col(text).cast("string").alias("x")).where("x is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                held = hashes.of(raw)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([len(held) // 8], pa.int64()), pa.array([held], pa.binary())],
                    names=["ih", "n", "held"],
                )

    return texts.selectExpr("xxhash64(x) as ih", "cast(x as binary) as x").mapInArrow(run, "ih long, n long, held binary")


def seeds_of(items: DataFrame) -> DataFrame:
    """(ih, n, h, pos): every seed of every item; ``h`` is the hash as a signed number."""
    names = ["ih", "n", "h", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ih, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for low, _, h in seed_hashes(held):
                    same = [np.full(len(h), x, np.int64) for x in (ih, len(held) // 8)]
                    yield _rows(names, [*same, h.view(np.int64), np.arange(low, low + len(h))])

    return items.select("ih", "held").mapInArrow(run, "ih long, n long, h long, pos long")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The bit table of all seeds, in 64-bit words; at most ``FILTER_BITS`` bits."""
    n = seeds.count()
    size = 64
    while size < min(FILTER_BITS, BITS_PER_SEED * n):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield _rows(["bit"], [np.concatenate([probe(h, size, k).view(np.int64) for k in range(PROBES)])])

    bits = seeds.select("h").mapInArrow(run, "bit long")
    words = bits.groupBy(F.expr("shiftright(bit, 6) as w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v")
    ).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return table.view(np.uint64)


def hits_of(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """(th, h, at): the seeds of ``texts`` (th, x) whose bits are set in the table."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    names = ["th", "h", "at"]

    def found(ths: list[int], held: list[bytes]) -> pa.RecordBatch:
        """The hits of some texts, whose tokens are hashed as one sequence."""
        words = shared.value
        ends = np.cumsum([len(x) // 8 for x in held])
        home = np.repeat(np.arange(len(held)), np.diff(ends, prepend=0))
        rows = [(np.empty(0, np.int64),) * 3]
        for low, width, h in seed_hashes(b"".join(held)):
            at = np.arange(len(h))
            for k in range(PROBES):
                bit = probe(h[at], 64 * len(words), k)
                at = at[(words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
            at = at[home[low + at] == home[low + at + width - 1]]
            rows.append((home[low + at], h[at].view(np.int64), low + at))
        doc, h, at = (np.concatenate(c) for c in zip(*rows, strict=True))
        starts = ends - [len(x) // 8 for x in held]
        return _rows(names, [np.array(ths, np.int64)[doc], h, at - starts[doc]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            ths: list[int] = []
            held: list[bytes] = []
            size = 0
            for th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ths.append(th)
                held.append(hashes.of(raw))
                size += len(held[-1])
                if size > 8 * BATCH:
                    yield found(ths, held)
                    ths, held, size = [], [], 0
            if ths:
                yield found(ths, held)

    return texts.selectExpr("th", "cast(x as binary) as x").mapInArrow(run, "th long, h long, at long")


def spread(big: DataFrame, other: DataFrame, key: str, hot: int, weight: str = "64L") -> DataFrame:
    """Inner join on ``key``. ``other`` is broadcast if its bytes, the sum of ``weight``, are few;
    else rows of ``big`` with a key that has over ``hot`` of them meet one of several copies."""
    if (other.agg(F.sum(F.expr(weight))).first()[0] or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(other), key)
    counts = big.groupBy(key).agg(F.count("*").alias("c")).where(f"c > {hot}")
    copies = stored(counts.selectExpr(key, f"cast(c div {hot} + 1 as int) as copies"))
    salt = F.expr(f"pmod(xxhash64({', '.join(big.columns)}), coalesce(copies, 1))").alias("salt")
    left = big.join(copies, key, "left").select(*big.columns, salt)
    right = other.join(copies, key, "left").select(
        *other.columns, F.explode(F.expr("sequence(0L, coalesce(copies, 1) - 1L)")).alias("salt")
    )
    return left.join(right, [key, "salt"]).drop("salt")


def segments_of(texts: DataFrame, diagonals: DataFrame) -> DataFrame:
    """(th, ih, start, seg): the tokens of a text opposite an item from its token ``start`` on."""
    count = diagonals.groupBy("th").agg(F.count("*").alias("c"))
    lists = diagonals.join(count, "th").groupBy("th", F.expr("pmod(xxhash64(ih, shift), c div 1024 + 1) as part")).agg(
        *[F.collect_list(F.struct("ih", "n", "shift")).alias("d")]
    )
    one = texts.join(count.select("th"), "th", "left_semi").groupBy("th").agg(F.min("x").alias("x"))
    names = ["th", "ih", "start", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                held = hashes.of(raw)
                ih, start, seg = [], [], []
                for d in batch.column(2)[i].as_py():
                    ih.append(d["ih"])
                    start.append(max(0, -d["shift"]))
                    seg.append(held[8 * max(0, d["shift"]) : 8 * (d["shift"] + d["n"])])
                th = pa.array(np.full(len(ih), batch.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [th, pa.array(ih, pa.int64()), pa.array(start, pa.int64()), pa.array(seg, pa.binary())], names=names
                )

    rows = one.join(lists, "th").selectExpr("th", "cast(x as binary) as x", "d")
    return rows.mapInArrow(run, "th long, ih long, start long, seg binary")


def verified(pairs: DataFrame, min_overlap: int, similarity: float, shortest: int) -> DataFrame:
    """(th, ih, overlap, matching) of the diagonals in ``pairs`` with an overlap."""
    names = ["th", "ih", "overlap", "matching"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, same = [], [], []
            for i in range(batch.num_rows):
                start, seg, item = (batch.column(k)[i].as_py() for k in (2, 3, 4))
                seg, item = np.frombuffer(seg, np.uint64), np.frombuffer(item, np.uint64)
                match = item[start : start + len(seg)] == seg
                got = best_segment(match, similarity, max(min(min_overlap, len(item)), shortest))
                if got:
                    rows.append(i)
                    sizes.append(got[1] - got[0])
                    same.append(int(match[got[0] : got[1]].sum()))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int64()), pa.array(same, pa.int64())],
                names=names,
            )

    return pairs.select("th", "ih", "start", "seg", "held").mapInArrow(
        run, "th long, ih long, overlap long, matching long"
    )


def overlaps(
    texts: DataFrame, benchmark: DataFrame, item_text: str, min_overlap: int, similarity: float, shortest: int, hot: int
) -> DataFrame:
    """(th, ih, overlap, matching) over distinct texts ``texts`` (th, x) and benchmark texts."""
    items = stored(items_of(benchmark, item_text))
    seeds = stored(seeds_of(items))
    hits = stored(hits_of(texts, seed_filter(seeds)))
    met = spread(hits, seeds, "h", hot).selectExpr("th", "ih", "n", "at - pos as shift")
    diagonals = stored(met.distinct())
    segments = stored(segments_of(texts, diagonals))
    pairs = spread(segments, items.select("ih", "held"), "ih", hot, "length(held) + 64")
    best = verified(pairs, min_overlap, similarity, shortest).groupBy("th", "ih").agg(
        F.max(F.struct("overlap", "matching")).alias("b")
    )
    out = stored(best.selectExpr("th", "ih", "b.overlap as overlap", "b.matching as matching"))
    discard(items, seeds, hits, diagonals, segments)
    return out


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(th, x): hash and text of the documents that have one."""
    return docs.select(F.col(text).cast("string").alias("x")).where("x <> ''").selectExpr("xxhash64(x) as th", "x")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
    item_col: str = "item_id", item_text: str = "text", min_overlap: int = 10,
    similarity: float = 0.8, shortest: int = 8, hot: int = 100_000,
) -> DataFrame:
    """(id, item_id, overlap, matching) for every document and item with an overlap."""
    found = overlaps(_texts(docs, text), benchmark, item_text, min_overlap, similarity, shortest, hot)
    ids = docs.select(F.col(id_col).alias("id"), F.expr(f"xxhash64(cast(`{text}` as string)) as th"))
    names = benchmark.select(F.col(item_col).alias("item"), F.expr(f"xxhash64(cast(`{item_text}` as string)) as ih"))
    rows = spread(ids, spread(found, names, "ih", hot), "th", hot)
    return rows.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "overlap", "matching")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id",
    item_text: str = "text", min_overlap: int = 10, similarity: float = 0.8, shortest: int = 8,
    hot: int = 100_000,
) -> DataFrame:
    """The documents without an overlap, all columns as they are."""
    rows, at = anonymous(docs)
    found = overlaps(_texts(docs, text), benchmark, item_text, min_overlap, similarity, shortest, hot)
    bad = stored(found.select("th").distinct())
    if bad.count() * 64 <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    hashed = F.xxhash64(F.col(at[text]).cast("string"))
    return rows.join(bad, hashed == F.col("th"), "left_anti").toDF(*docs.columns)


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
