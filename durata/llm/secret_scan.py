r"""Secret scans: findings with exact spans, and multipart credentials linked by scope.

Three strong kinds are always reported: ``assign`` (a keyword, a separator and a value),
``access`` (an access identifier) and ``hex`` (a long lower-case hexadecimal run). Three weak
kinds are reported only when a complementary part stands within ``reach`` characters in the
same scope (a block of text between blank lines): ``ident`` (a user or client name),
``value`` (a shorter secret-like value) and ``endpoint`` (a URL, host or address). A weak
value needs an identifier or an endpoint; an identifier or endpoint needs a secret.

Spans are in code points, end exclusive. A pattern's gaps and matches come from one split
and one extract of the text, as lengths; positions are running sums over them in a window
per text, so a text with very many findings stays linear. Linking is an interval join: weak
parts are put into every cell, of width ``reach``, that they touch, their partners into those
and the two beside them, so no task sees more than neighbouring cells. Built-in functions only.

Null texts count as empty, every row gives one row, also repeated rows, null ids and texts
without any finding; empty tables give empty results. Rows equal in id and text are scanned
once. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from durata.llm.common import checkpoint

#: Kind, pattern, a cheap test that holds for every text with a match, the group whose length
#: counts, the length it needs. The order of the kinds breaks ties of equal starts.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     r"(?i:passw|secret|token|api_?key)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", "AKIA", 0, 18),
    ("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 0, 16),
    ("ident", r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""",
     r"(?i:user|login|client_?id|account)", 1, 3),
    ("value", r"""(?i:pass|pwd|key|auth|credential|private|signature|token|secret)[a-zA-Z_]*["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=-]+)""",
     r"(?i:pass|pwd|key|auth|credential|private|signature|token|secret)", 1, 6),
    ("endpoint", r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|s3)://[^\s"'<>]+|(?i:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]+""",
     r"://|(?i:host|server|endpoint)", 0, 5),
]
STRONG = ("assign", "access", "hex")
#: What a kind is in a credential.
ROLE = {"assign": "secret", "hex": "secret", "value": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}


def _pieces(pattern: str, test: str, group: int) -> Column:
    """Per match: the gap before it, its length, and the length of the group that counts."""
    t = F.col("__text")
    gaps = F.split(t, pattern, -1)
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("g"), whole.alias("m"), counted.alias("c")
    )
    short = F.transform(
        zipped,
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["c"]).alias("got")
        ),
    )
    return F.when(t.rlike(test), short).otherwise(F.array().cast(
        "array<struct<gap:int,len:int,got:int>>"
    ))


def _blocks() -> Column:
    """Lengths of the scopes: what stands between blank lines."""
    gaps = F.split(F.col("__text"), r"\n[ \t]*\n", -1)
    breaks = F.regexp_extract_all(F.col("__text"), F.lit(r"\n[ \t]*\n"), F.lit(0))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("g"), breaks.alias("m"))
    return F.transform(
        zipped,
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.lit(0).alias("got")
        ),
    )


def parts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, th, copies, kind, start, stop, scope, ok), and a row without a kind per text."""
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("__text")
    )
    found = [
        F.struct(F.lit(i).alias("kind"), _pieces(p, test, g).alias("pieces"))
        for i, (_, p, test, g, _) in enumerate(KINDS)
    ]
    kinds = F.filter(F.array(*found), lambda x: F.size(x["pieces"]) > 0)
    scanned = base.select("id", F.xxhash64("__text").alias("th"), "__text", kinds.alias("kinds"))
    weak = F.exists("kinds", lambda x: x["kind"] >= len(STRONG))
    scanned = scanned.select(
        "id", "th", F.concat(
            F.col("kinds"),
            F.when(weak, F.array(F.struct(F.lit(-1).alias("kind"), _blocks().alias("pieces")))).otherwise(
                F.array().cast("array<struct<kind:int,pieces:array<struct<gap:int,len:int,got:int>>>>")
            ),
        ).alias("kinds"),
    )
    once = scanned.groupBy("id", "th").agg(F.count("*").alias("copies"), F.any_value("kinds").alias("kinds"))
    each = once.select("id", "th", "copies", F.explode_outer("kinds").alias("k")).select(
        "id", "th", "copies", "k.kind", F.posexplode_outer("k.pieces").alias("pos", "p")
    )
    before = Window.partitionBy("id", "th", "kind").orderBy("pos")
    stop = F.sum(F.col("p.gap") + F.col("p.len")).over(before)
    placed = each.select(
        "id", "th", "copies", "kind", (stop - F.col("p.len")).alias("start"), stop.alias("stop"),
        F.col("p.got").alias("got"),
    )
    # the scope is named by the end of the last blank line before the part
    line = Window.partitionBy("id", "th").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.expr("if(kind = -1, stop, start)")).withColumn(
        "scope", F.coalesce(F.max(F.expr("if(kind = -1, stop, null)")).over(line), F.lit(0))
    )
    needs = F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("kind") + 1)
    return placed.where("kind is null or kind >= 0").withColumn(
        "ok", F.when(F.col("kind").isNotNull(), F.col("got") >= needs).otherwise(F.lit(True))
    ).where("ok").select("id", "th", "copies", "kind", "start", "stop", "scope")


def linked(found: DataFrame, reach: int = 200) -> DataFrame:
    """The weak parts with a complementary part in reach: an interval join within scopes."""
    role = F.element_at(F.array(*[F.lit(ROLE[k[0]]) for k in KINDS]), F.col("kind") + 1)
    p = found.where("kind is not null").withColumn("role", role)
    # from start to stop: a partner is in reach of either end; pairs that meet twice are grouped
    weak = p.where(f"kind >= {len(STRONG)}").withColumn(
        "cell", F.explode(F.expr(f"sequence(start div {reach}, stop div {reach})"))
    )
    # a weak value that lies inside a strong secret is that secret
    other = p.select(
        F.col("id").alias("id2"), F.col("th").alias("th2"), F.col("scope").alias("scope2"),
        F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("stop").alias("stop2"),
        F.col("role").alias("role2"),
        F.explode(F.expr(f"sequence(start div {reach} - 1, stop div {reach} + 1)")).alias("cell2"),
    )
    near = weak.join(
        other,
        F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
        & (F.col("scope") == F.col("scope2")) & (F.col("cell") == F.col("cell2")),
    )
    apart = f"greatest(start2 - stop, start - stop2) <= {reach}"
    joins = near.where(apart).groupBy("id", "th", "copies", "kind", "start", "stop").agg(
        F.max(F.expr("role2 <> role and (role = 'secret' or role2 = 'secret')")).alias("completes"),
        F.max(F.expr(f"kind2 < {len(STRONG)} and start2 < stop and start < stop2")).alias("inside"),
    )
    return joins.where("completes and not inside").select("id", "th", "copies", "kind", "start", "stop")


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", reach: int = 200) -> DataFrame:
    """One row per document: id and ``findings``, an array of (start, kind, stop) in order."""
    found = checkpoint(parts(docs, text, id_col))
    strong = found.where(f"kind is null or kind < {len(STRONG)}").drop("scope")
    rest = found.where(f"kind >= {len(STRONG)}").selectExpr(
        "id", "th", "copies", "cast(null as int) as kind", "cast(null as bigint) as start",
        "cast(null as bigint) as stop",
    )
    every = strong.unionByName(rest).unionByName(linked(found, reach))
    rows = every.groupBy("id", "th").agg(
        F.max("copies").alias("copies"),
        F.array_sort(
            F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "stop")))
        ).alias("findings"),
    )
    return rows.select(
        F.col("id").alias(id_col), "findings", F.explode(F.expr("sequence(1, copies)")).alias("__copy")
    ).drop("__copy")


def _joined(findings: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(
        F.transform(
            findings,
            lambda x: F.concat_ws(
                ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string")
            ),
        ),
        ",",
    )


def op1_secret_scan(docs: DataFrame) -> DataFrame:
    rows = scan(docs)
    base = F.filter("findings", lambda x: x["kind"] < len(STRONG))

    def count(kind: int) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
    )
