"""Fill-in-middle transformation by secondary sort, with digests of output and restoration.

Each text is cut into n code points; two hashes of the id give the ends of prefix and
middle, two more the form: plain (as it is), psm ``<P>prefix<S>suffix<M>middle`` or spm
``<S>suffix<P>prefix<M>middle``. A text that holds a sentinel stays plain, so sentinels in
an output are always the operator's own and the text can be rebuilt from output and form.

A map task emits pieces of at most ``UNITS`` code points keyed by document and output
position. One shuffle repartitions them by document and sorts within partitions; a stream
over the sorted pieces feeds an incremental digest, one piece in memory at a time. The same
stream finds the sentinels in the output's bytes and re-keys what lies between them by
original position; sorting within the partition again (documents are together already, so
without a shuffle) restores the text for the second digest. No task ever holds a document's
output, and rows that share an id are told apart by a row key, so a hot id is many documents.

The row key is the row's place in the scan, so ``docs`` should be a table (or anything whose
recomputation gives the same rows in the same order). Null texts count as empty; a null id
hashes as an empty number and stays null in the result. Bytes that are not UTF-8 count as
one unit each and are kept. Repeated rows give one result each, empty tables none; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = 16_384
#: Bytes of an Arrow batch that a task emits, about.
BATCH = 4 << 20
#: Original place of what follows a sentinel.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
ORDER = {"plain": [], "psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}

META = "n long, form string, prefix_chars long, middle_chars long"
Plan = tuple[str, int, int]


def hash_plan(doc_id: int | None, text: str, plain: int = 90, spm: int = 20) -> Plan:
    """Form and the ends of prefix and middle; ``plain`` and up of 100 stay plain."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plain:
        return "plain", 0, 0
    ends = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    return ("spm" if h[3] % 100 < spm else "psm"), ends[0], ends[1]


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


class _Batches:
    """Collects rows and yields them as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> bool:
        self.rows.append(row)
        self.size += size + 64
        return self.size >= BATCH

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema
        )


def _fields(id_type: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    meta = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    return pa.schema([("key", pa.int64()), ("place", pa.int32()), ("at", pa.int64()), ("doc_id", id_type), *meta, *more])


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", plan: Callable[..., Plan] = hash_plan) -> DataFrame:
    """(key, place 0, at: output position, doc_id, meta on the first piece, data)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = TaskContext.get().partitionId() << 40, None
        for b in batches:
            out = out or _Batches(_fields(b.column(0).type, ("data", pa.binary())))
            for doc_id, raw in zip(b.column(0), b.column(1), strict=True):
                whole = (raw.as_py() or b"").decode("utf-8", "surrogateescape")
                form, a, z = plan(doc_id.as_py(), whole)
                span = {PREFIX: (0, a), MIDDLE: (a, z), SUFFIX: (z, len(whole))}
                parts = [(s, *span[s]) for s in ORDER[form]] or [("", 0, len(whole))]
                meta = (len(whole), form, *((None, None) if form == "plain" else (a, z - a)))
                at = 0
                for sentinel, start, stop in parts:
                    for i in range(start, max(stop, start + 1), UNITS):
                        data = _encode((sentinel if i == start else "") + whole[i : min(i + UNITS, stop)])
                        if out.add((key, 0, at, doc_id.as_py(), *(meta if at == 0 else (None,) * 4), data), len(data)):
                            yield out.take()
                        at += 1
                key += 1
        if out and out.rows:
            yield out.take()

    return docs.select(id_col, F.col(text).cast("string").cast("binary").alias("data")).mapInArrow(
        run, f"key long, place int, at long, doc_id {kind}, {META}, data binary"
    )


def assembled(parts: DataFrame) -> DataFrame:
    """Pieces of a document together and in output order."""
    return parts.repartition("key").sortWithinPartitions("key", "place", "at")


def restoring(sorted_parts: DataFrame) -> DataFrame:
    """From sorted output pieces: a head row per document with the output's digest, and the
    bytes between sentinels keyed by their original place."""
    kind = sorted_parts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, meta = None, None, ()
        digest, ahead, carry, place, at = hashlib.sha256(), [], b"", 0, 0

        def piece(data: bytes) -> bool:
            nonlocal at
            at += 1
            return out.add((key, place, at, None, *(None,) * 4, None, data), len(data))

        def close() -> Iterator[pa.RecordBatch]:
            if key is not None:
                full = bool(carry) and piece(carry)
                if out.add((key, -1, 0, *meta, digest.hexdigest(), None)) or full:
                    yield out.take()

        for b in batches:
            out = out or _Batches(
                _fields(b.column(3).type, ("output_sha256", pa.string()), ("data", pa.binary()))
            )
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = row[-1]
                if row[0] != key:
                    yield from close()
                    key, meta = row[0], row[3:8]
                    digest, carry, place, at = hashlib.sha256(), b"", 0, 0
                    ahead = [s.encode() for s in ORDER[meta[2]]]
                digest.update(data)
                data = carry + data
                while ahead and (i := data.find(ahead[0])) >= 0:
                    if i and piece(data[:i]):
                        yield out.take()
                    place, data = PLACE[ahead[0].decode()], data[i + len(ahead[0]) :]
                    ahead.pop(0)
                # the next sentinel may begin in the last two bytes
                keep = 2 if ahead else 0
                cut = max(len(data) - keep, 0)
                carry = data[cut:]
                if cut and piece(data[:cut]):
                    yield out.take()
        yield from close()
        if out and out.rows:
            yield out.take()

    return sorted_parts.mapInArrow(
        run, f"key long, place int, at long, doc_id {kind}, {META}, output_sha256 string, data binary"
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", plan: Callable[..., Plan] = hash_plan) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per row."""
    back = restoring(assembled(pieces(docs, id_col, text, plan))).sortWithinPartitions("key", "place", "at")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, head, digest = None, [], None, hashlib.sha256()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for b in batches:
            if schema is None:
                fields = list(_fields(b.column(3).type))[3:]
                schema = pa.schema([*fields, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[1] < 0:
                    if head is not None:
                        rows.append((*head, digest.hexdigest()))
                    head, digest = row[3:9], hashlib.sha256()
                else:
                    digest.update(row[-1])
            if len(rows) >= 10_000:
                yield flush()
        if head is not None:
            rows.append((*head, digest.hexdigest()))
        if rows:
            yield flush()

    return back.mapInArrow(run, f"doc_id {kind}, {META}, output_sha256 string, restored_sha256 string")


def outputs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", plan: Callable[..., Plan] = hash_plan) -> DataFrame:
    """(doc_id, form, output) with whole output texts; a document has to fit one string."""
    parts = pieces(docs, id_col, text, plan).groupBy("key").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("form").alias("form"),
        F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"),
    )
    whole = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.data))
    return parts.select("doc_id", "form", whole.cast("string").alias("output"))


def op12_fill_in_middle(documents: DataFrame) -> DataFrame:
    return digests(documents)


SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n,
         sha256('1:' || doc_id::varchar) as h from documents
), e as (
  select *, ('0x' || h[1:8])::bigint % (n + 1) as x, ('0x' || h[9:16])::bigint % (n + 1) as y,
         text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
           or ('0x' || h[17:24])::bigint % 100 >= 90 as plain,
         ('0x' || h[25:32])::bigint % 100 < 20 as spm
  from d
), f as (
  select doc_id, n, text, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
         least(x, y) as a, greatest(x, y) as z,
         substring(text, 1, a) as prefix, substring(text, a + 1, z - a) as middle, substring(text, z + 1) as suffix
  from e
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
       case when form <> 'plain' then z - a end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from f
"""
