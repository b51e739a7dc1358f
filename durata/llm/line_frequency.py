"""Quality rules with cross-document line frequency, in built-in functions only.

Every text gets counts of its own (words, symbols, repeated lines, words in repeated
three-word windows) and the hashes of its normalised lines (lower case, words joined by one
space) with their word counts; these narrow rows are written once and all else reads them.
Texts that are equal within a host count as one document, so copies alone make no line
frequent. A line is cut where more distinct documents of its host hold it than the host's
limit, ``max(MIN_DOCS, SHARE * documents of the host)``; a document is rejected as depleted
when cut lines take more than half of its words, or when its base rules failed.

Hot rows: copies collapse with a map-side combine before their lines are spread out; lines
are counted with a map-side combine; only lines above ``MIN_DOCS`` meet the hosts' limits;
the cut lines are broadcast only if counted small, else joined with salted keys. Per text all
work is n log n in its length (sorts, no lookups), so very long texts are fine.

Null texts have no words and fail the base rules; null hosts are a host of their own. Rows
are told apart by a row key, so repeated ids and rows give one result each. Lines without a
word take no part in line counts. The row key is the row's place in the scan, so ``docs`` of
``cleaned``, which reads them twice, should be a table. Empty tables give empty results; other columns are not
read. Hashes of lines, texts and windows have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from durata.llm.common import small, stored

BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Repeated words of a hundred above which the base rules fail.
REPEATED = 50
MIN_DOCS, SHARE = 10, 0.01
#: Share of the words that has to be left.
LEFT = 0.5
SALTS = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none: an empty array."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed != "", F.split(trimmed, BLANK)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Windows are sorted by hash; those with an equal neighbour are repeated; their starts,
    sorted again, each add the words that the window before did not cover.
    """
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(words[i - 1], words[i], words[i + 1]).alias("h"), i.alias("i"))

    def starts(s: Column) -> Column:
        twin = lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))].h == x.h)) | (
            (j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)].h == x.h)
        )
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x.i))

    def covered(p: Column) -> Column:
        before = lambda j: F.when(j > 0, p[F.greatest(j - 1, F.lit(0))]).otherwise(F.lit(-9))
        new = F.transform(p, lambda x, j: F.least(F.lit(3), x - before(j)))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    windows = F.transform(F.sequence(F.lit(1), n - 2), window)
    found = let(F.sort_array(windows), lambda s: let(starts(s), covered))
    return F.when(n >= 3, found).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """Stored rows: key, id, host, hash of the text, counts, (hash, words) of each line with a word."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"),
        # a null host is its own, unlike any named one
        F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")).alias("host"),
        body.alias("body"),
    )
    lines = F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # stored before the fields of ``w`` are taken apart, so that each is computed once
    rows = stored(plain.select(
        "key", "doc_id", "host", F.xxhash64("body").alias("text_hash"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(words_of(F.col("body")), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_words(w).alias("repeated"),
        )).alias("w"),
        let(lines, lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"),
            F.transform(ls, lambda x: let(words_of(x), lambda w: F.struct(
                F.xxhash64(F.lower(F.array_join(w, " "))).alias("h"), F.size(w).alias("w")
            ))).alias("each"),
        )).alias("l"),
    ))
    return rows.select(
        "key", "doc_id", "host", "text_hash", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"),
        "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"),
        F.col("l.each").alias("lines"),
    )


def hot_join(big: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with keys that may be hot in ``big``: broadcast if counted small, else salted."""
    hinted = small(few)
    if hinted is not few:
        return big.join(hinted, keys)
    spread = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = big.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*keys, "__salt"]).drop("__salt")


def frequent(rows: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, h) of the lines that more distinct documents of the host hold than its limit."""
    texts = rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    texts = stored(texts)
    limits = texts.groupBy("host").agg(
        F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(share)).alias("limit")
    )
    lines = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    counts = stored(counts.withColumn("key", F.col("h")))
    return hot_join(counts, stored(limits), ["host"]).where("docs > limit").select("host", "h")


def with_verdict(
    rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, left: float = LEFT,
    min_words: int = MIN_WORDS, repeated: int = REPEATED,
) -> DataFrame:
    """Adds cut_words, base_failed and kept to stored ``measured`` rows."""
    cut = stored(frequent(rows, min_docs, share))
    each = rows.select("key", "host", F.explode("lines").alias("l")).select("key", "host", "l.h", "l.w")
    gone = hot_join(each, cut, ["host", "h"]).groupBy("key").agg(F.sum("w").alias("cut_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeated * F.col("n_words"))
    enough = F.col("n_words") - F.col("cut_words") >= F.lit(left) * F.col("n_words")
    return (
        rows.drop("lines").join(gone, "key", "left").withColumn("cut_words", F.coalesce("cut_words", F.lit(0)))
        .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **rules: float
) -> DataFrame:
    """(doc_id, host, counts, cut_words, base_failed, kept) of every row."""
    return with_verdict(measured(docs, id_col, text, host), **rules).drop("key", "text_hash")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **rules: float) -> DataFrame:
    """(doc_id, text) of the kept rows without their cut lines."""
    rows = measured(docs, id_col, text, host)
    names = {"min_docs": MIN_DOCS, "share": SHARE} | {k: v for k, v in rules.items() if k in ("min_docs", "share")}
    cut = stored(frequent(rows, **names).withColumn("cut", F.lit(True)))
    kept = with_verdict(rows, **rules).where("kept").select("key", "host")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), body.alias("body"))
    lines = keyed.join(kept, "key").select("key", "doc_id", "host", F.posexplode(F.split("body", "\n")))
    hashed = lines.withColumn("h", F.xxhash64(F.lower(F.array_join(words_of(F.col("col")), " "))))
    left = hashed.join(small(cut), ["host", "h"], "left").where("cut is null")
    return left.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "col"))), lambda x: x.col), "\n").alias("text"),
    ).drop("key")


def op13_quality_rules(documents: DataFrame) -> DataFrame:
    return quality_rules(documents).drop("host", "cut_words")


SQL = """
with d as (
  select row_number() over () as key, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d
), l as (
  select key, host, text, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as words
  from (select key, host, text, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), n as (
  select key, host, text, line, len(words) as n, lower(array_to_string(words, ' ')) as norm from l
), docs_of as (
  select host, count(distinct text) as docs from d group by host
), hot as (
  select n.host, norm from n join docs_of using (host) group by n.host, norm, docs
  having count(distinct text) > greatest(10.0, docs * 0.01)
), cut as (
  select key, sum(n.n) as cut_words from n join hot on n.host = hot.host and n.norm = hot.norm group by key
), dup as (
  select key, count(*) - count(distinct line) as n_dup_lines from n group by key
), win as (
  select key, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win
  from (select key, words, unnest(range(1, len(words) - 1)) as i from w)
), rep as (
  select key, count(distinct i + o) as n_repeat_words
  from (select key, i, count(*) over (partition by key, win) as c from win) cross join (values (0), (1), (2)) t(o)
  where c >= 2 group by key
), m as (
  select doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(cut_words, 0) as cut_words
  from w left join dup using (key) left join rep using (key) left join cut using (key)
), v as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - cut_words >= 0.5 * n_words as kept
from v
"""
