"""Hard negatives, fill-in-middle and line frequency against brute force, with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from durata.llm import fill_in_middle as fim
from durata.llm import hard_negatives as hn
from durata.llm import line_frequency as lf

CLASH = ("id", "v", "aid", "w", "c1", "part", "key", "place", "at", "data", "form", "host", "body", "lines", "h", "docs")


def clashing(df, *keep):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in keep})


# --- hard negatives ---

ROWS = "vec_id long, embedding array<double>, label int"


def brute_negatives(rows, scale=256, most=5, take=3):
    def fine(r):
        return None not in r and all(x is not None and np.isfinite(x) for x in r[1])

    def whole(x):
        return max(-(2**63), min(2**63 - 1, int(np.floor(x * scale))))

    kept = [(i, [whole(x) for x in v], lab) for i, v, lab in filter(fine, rows)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, v, lab in kept:
        if i % 50:
            continue
        others = sorted(((-dot(v, u), j, m) for j, u, m in kept if j != i))
        for p, j, _ in [o for o in others if o[2] == lab][:most]:
            window = [o for o in others if o[2] != lab and 50 * -p <= 100 * -o[0] <= 95 * -p][:take]
            out += [(i, j, n + 1, k, -p, -q) for n, (q, k, _) in enumerate(window)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 50 == 0, **kw).collect())


@pytest.mark.parametrize("dims,labels", [(8, 3), (3, 40)])
def test_hard_negatives_brute_force(spark, dims, labels):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)], rng.randrange(labels)) for i in range(400)]
    rows += [(1000 + i, [0.5] * dims, i % 2) for i in range(120)]  # one common vector: ties
    rows += [
        (None, [1.0] * dims, 1), (3000, None, 1), (3050, [1.0] * dims, None), (3100, [float("nan")] * dims, 1),
        (3150, [None] + [1.0] * (dims - 1), 1), (3200, [1.0, 2.0], 1), (3250, [], 2), (3300, [-1.0] * dims, 77),
    ]
    df = clashing(spark.createDataFrame(rows, ROWS))
    assert mined(df, codewords=6) == brute_negatives(rows)


def test_hard_negatives_certify_early(spark, monkeypatch):
    """On clustered data most cells are never scored, and results stay exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 10
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.2).tolist(), (i // 12) % 3) for i in range(1200)]
    monkeypatch.setattr(hn, "FIRST", 60)
    visited = []
    plan = hn.planned

    def counting(open_, index, room):
        out = plan(open_, index, room)
        mask = out.select(F.explode("cells").alias("c")).select("c.*").collect()
        visited.append(sum(
            int((np.unpackbits(np.frombuffer(bytes(r["mask"]), np.uint8))[: index.rows.shape[1]] * index.rows[r["c1"]]).sum())
            for r in mask
        ))
        return out

    monkeypatch.setattr(hn, "planned", counting)
    assert mined(spark.createDataFrame(rows, ROWS), codewords=12) == brute_negatives(rows)
    assert sum(visited) < 0.7 * 2 * 24 * 1200


def test_hard_negatives_wide_scores_and_empty(spark):
    rows = [(i, [1e10 * (1 + i % 7), -1e9 * i], i % 2) for i in range(60)] + [(100, [1e300, 1.0], 0)]
    df = spark.createDataFrame(rows, ROWS)
    assert mined(df) == brute_negatives(rows)
    assert mined(df.where("false")) == []
    text = spark.createDataFrame(rows[:60], ROWS).withColumn("label", F.concat(F.lit("c"), "label"))
    assert mined(text) == brute_negatives(rows[:60])


def test_hard_negatives_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    got = hn.op11_hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


# --- fill in middle ---


def brute_fim(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, z - a, sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return doc_id, n, "psm", a, z - a, sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def fim_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice("<PSM>aé漢😀 \n") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["<P", "<", "<S", "x<M>y", "<P<S<M", "é" * 20, None, ""]
    return texts + ["<P" * 40_000, "漢😀<" * 30_000, "ab" * 16_384, "b" * 16_384, "c" * 49_153]


def test_fim_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(fim_texts())] + [(None, "no id"), (5, "same id"), (5, "same id"), (5, "other")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, fim.digests(df).collect()), key=repr)
    assert got == sorted((brute_fim(*r) for r in rows), key=repr)


def test_fim_outputs_and_empty(spark):
    rows = [(i, t) for i, t in enumerate(fim_texts()[:320])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: brute_fim(*r) for r in rows}
    for r in fim.outputs(df).collect():
        assert hashlib.sha256(r["output"].encode()).hexdigest() == want[r["doc_id"]][5]
        assert r["form"] == want[r["doc_id"]][2]
    assert fim.digests(df.where("false")).count() == 0
    strings = fim.digests(df.selectExpr("concat('d', doc_id) as doc_id", "text"))
    assert dict(strings.dtypes)["doc_id"] == "string"
    assert strings.where("restored_sha256 is null").count() == 0


def test_fim_small_pieces(spark, monkeypatch):
    """Sentinels that lie across pieces are found."""
    rows = [(i, t) for i, t in enumerate(fim_texts()[:308])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fim.pieces(df)
    # cut every piece into single bytes
    cut = parts.select(
        "key", "place", F.posexplode(F.when(F.length("data") > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("data"), F.lit(1))), lambda i: F.substring("data", i, F.lit(1))
        )).otherwise(F.array("data"))), "at", "doc_id", "n", "form", "prefix_chars", "middle_chars",
    ).select(
        "key", "place", (F.col("at") * 100_000 + F.col("pos")).alias("at"), "doc_id",
        *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.col("col").alias("data"),
    )
    back = fim.restoring(fim.assembled(cut)).groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("output_sha256").alias("sha"),
        F.sort_array(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "at", "data")))).alias("p"),
    )
    want = dict(rows)
    for r in back.collect():
        assert b"".join(bytes(x["data"]) for x in r["p"]).decode() == (want[r["doc_id"]] or "")
        assert r["sha"] == brute_fim(r["doc_id"], want[r["doc_id"]])[5]


# --- quality rules ---

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(rows, min_docs=10, share=0.01, left=0.5):
    texts = [(r[0], r[1] or "", r[2]) for r in rows]
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    holders, hosts = {}, {}
    for _, t, host in texts:
        hosts.setdefault(host, set()).add(t)
        for line in t.split("\n"):
            if norm(line):
                holders.setdefault((host, norm(line)), set()).add(t)
    out = []
    for i, t, host in texts:
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = {}
        for k in range(len(words) - 2):
            at.setdefault(tuple(words[k : k + 3]), []).append(k)
        rep = {k + o for ks in at.values() if len(ks) > 1 for k in ks for o in range(3)}
        limit = max(min_docs, share * len(hosts[host]))
        cut = sum(len(WORD.findall(x)) for x in lines if len(holders[host, norm(x)]) > limit)
        failed = len(words) < 50 or 100 * len(rep) > 50 * len(words)
        kept = not failed and len(words) - cut >= left * len(words)
        symbols = sum(c in "#*$%&|<>" for c in t)
        out.append((i, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(rep), failed, kept))
    return sorted(out, key=repr)


def rule_rows():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice("äxyz#*|") * rng.randrange(3)
    common = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = []
    for i in range(160):
        lines = [" ".join(word() for _ in range(rng.randrange(14))) for _ in range(rng.randrange(12))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), common[0].upper() if i % 2 else "  " + common[0].replace(" ", "\t "))
        if i % 5 == 0:
            lines += common[1:] * rng.randrange(3)
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "a", "b", None])))
    rows += [(500 + i, rows[0][1], "a") for i in range(40)]  # copies count once
    rows += [(None, None, None), (600, "", "a"), (601, " \n\t\x0b\r\n", None), (601, " \n\t\x0b\r\n", None), (602, "h", "")]
    rows += [(700, " ".join(f"w{i % 9000}" for i in range(40_000)), "b"), (701, "x " * 100_000, "b")]
    return rows


def ruled(df):
    return sorted(map(tuple, lf.op13_quality_rules(df).collect()), key=repr)


def test_quality_rules_brute_force(spark, monkeypatch):
    rows = rule_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"), "host")
    want = brute_rules(rows)
    assert {False, True} == {r[-1] for r in want if not r[-2]}
    assert ruled(df) == want
    # joins with salted keys give the same
    monkeypatch.setattr(lf, "small", lambda x: x)
    assert ruled(df) == want
    assert ruled(df.where("false")) == []


def test_quality_rules_cleaned(spark):
    rows = rule_rows()[:160]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lf.cleaned(df).collect()}
    kept = {r[0] for r in brute_rules(rows) if r[-1]}
    assert set(got) == kept
    before = {r[0]: r[1] for r in rows}
    counts = {r["doc_id"]: r["cut_words"] for r in lf.quality_rules(df).collect()}
    for i, t in got.items():
        assert len(WORD.findall(before[i])) - len(WORD.findall(t)) == counts[i]
