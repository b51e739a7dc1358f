"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

A logistic classifier over a text's shape (symbols, capitals, separators, repetition, word
lengths) gives each document evidence. Hosts and paths (a path lies in a host) get posterior
means from grouped sums of the evidence: a path is shrunk to the path or host above it, a
host to the global mean, with strengths estimated from the spread between sites (method of moments), so sparse
sites follow the prior and large ones their own record. A document's score combines its log
odds with its path's posterior, from which its own share is taken out.

Sums are aggregated before they are shuffled, so a host with a third of all documents is a
few partial sums; posteriors join back by broadcast while they are few (checked), else by a
plain join. Scoring is a second pass over the texts instead of a shuffle of them. The
classifier is fitted on at most ``sample`` labelled rows of each class (a documented bound).

Null texts count as empty; null hosts and paths are sites of their own; null ids, repeated
rows and other columns of any name pass through (those called like a result are replaced);
URLs without a host or a directory are sites of their own. Without labels of both classes the evidence is constant.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from durata.llm.common import anonymous, checkpoint, slices, small, texts_map
from durata.llm.toxicity import training_rows

SAMPLE = 6000
THRESHOLD = 0.5
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = bytes(c for c in range(33, 127) if chr(c) not in ".,;:'\"()-?!" and not chr(c).isalnum())
_LONE = re.compile(rb"(?<!\S)[^\sA-Za-z0-9\x80-\xff]+(?!\S)")
N_SHAPE = 14


def shape(text: bytes) -> list[float]:
    """Ratios that tell prose from menus, symbol noise, shouting and repetition."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * N_SHAPE
    k = len(words)
    low = text.lower()
    uniq = len(set(low.split()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    gone = lambda chars: n - len(text.translate(None, chars))
    letters = gone(_LETTERS)
    return [
        gone(_SYMBOLS) / k, text.count(b"!") / k, text.count(b"|") / k, gone(_UPPER) / max(1, letters),
        gone(_DIGITS) / n, letters / n, np.log1p(k), uniq / k, uniq / k**0.7,
        1 - len(set(lines)) / len(lines), np.log1p(n / k), len(lines) / k,
        (text.count(b".") + text.count(b",")) / k, gone(_SPACE) / n,
    ]


@dataclass
class Evidence:
    """Logistic regression over standardised shapes and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.clip(np.concatenate([z, z * z], axis=1) @ self.weights + self.bias, -12, 12)


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> Evidence:
    """Newton steps on the ridge-penalised log loss."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Evidence(np.zeros(N_SHAPE), np.ones(N_SHAPE), np.zeros(2 * N_SHAPE), float(np.log(rate / (1 - rate))))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.clip((x - mean) / scale, -6, 6)
    a = np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move * min(1.0, 4.0 / max(1e-12, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-7:
            break
    return Evidence(mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int) -> Evidence:
    rows = training_rows(docs, labels, id_col, text, label, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shape(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"]
            )

    got = rows.mapInArrow(run, "x array<double>, y int").orderBy(F.xxhash64("x"), "y").limit(4 * sample).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, N_SHAPE)
    y = got.column("y").to_numpy().astype(float)
    # the classes were taken evenly; put the intercept back to the labels' own rate
    model = fit_evidence(x, y)
    counts = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(counts) == 2 and len(y) and 0 < y.mean() < 1:
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean())))
    return model


def evidence(docs: DataFrame, model: Evidence, keep: list[str], text: str) -> DataFrame:
    """``keep`` and ``evidence``: the log odds of good quality from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: list[bytes]) -> list[pa.Array]:
        x = np.array([shape(t) for t in texts], float).reshape(-1, N_SHAPE)
        return [pa.array(np.round(held.value.logits(x), 9))]

    return texts_map(docs, fn, text, keep, "evidence double")


def _strength(between: float, within: float) -> float:
    """Pseudo-counts of a prior: observation noise over spread between sites."""
    return float(min(1e6, max(1.0, within / between))) if between > 1e-9 else 1e6


def sites(scored: DataFrame, levels: Sequence[str] = ("host", "path")) -> DataFrame:
    """Per site of the lowest level: n, s (sum of the evidence's probabilities) and its prior.

    ``scored`` has the levels, widest first, and evidence. A level is shrunk to the one above
    it, the first to the global mean (``base``); ``host_mean`` is the posterior mean of the level
    above the lowest, to which sites are shrunk with ``strength`` pseudo-counts.
    """
    p = F.expr("1 / (1 + exp(-evidence))")
    leaves = checkpoint(
        scored.groupBy(*levels).agg(
            F.count("*").alias("n"), F.sum(F.round(p, 9)).alias("s"), F.sum(F.round(p * p, 9)).alias("q")
        )
    )
    n, s, q = leaves.selectExpr("sum(n)", "sum(s)", "sum(q)").first()
    if not n:
        return leaves.selectExpr(*levels, "n", "s", "0D as host_mean", "1D as strength", "0.5D as base")
    mean = min(max(s / n, 1e-6), 1 - 1e-6)
    noise = max(q / n - mean * mean, 1e-9)

    def strength(df: DataFrame) -> float:
        """Between-site variance: weighted variance of the means less what noise explains."""
        row = df.selectExpr(
            "sum(n * pow(s / n - host_mean, 2)) / sum(n)", "count(*) / sum(n)"
        ).first()
        return _strength(max(0.0, (row[0] or 0.0) - noise * (row[1] or 0.0)), noise)

    above = None
    for depth in range(1, len(levels) + 1):
        at = levels[:depth]
        here = leaves.groupBy(*at).agg(F.sum("n").alias("n"), F.sum("s").alias("s")) if depth < len(levels) else leaves.drop("q")
        if above is None:
            here = here.withColumn("host_mean", F.lit(mean))
        else:
            on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in at[:-1]]
            here = here.join(above, reduce(Column.__and__, on)).drop(*[f"__{c}" for c in at[:-1]])
        pull = strength(here)
        if depth < len(levels):
            above = small(
                checkpoint(
                    here.select(
                        *[F.col(c).alias(f"__{c}") for c in at],
                        F.expr(f"(s + {pull!r}D * host_mean) / (n + {pull!r}D)").alias("host_mean"),
                    )
                )
            )
    return here.withColumn("strength", F.lit(pull)).withColumn("base", F.lit(mean))


def site_levels(url: Column, depth: int = 2) -> list[Column]:
    """Host of a URL and its first 1 to ``depth`` directories; null for a null URL, '' for none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)/", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return [host, *[F.array_join(F.slice(parts, 1, i), "/") for i in range(1, depth + 1)]]


def _logit(p: str) -> str:
    c = f"least(greatest({p}, 1e-6D), 1 - 1e-6D)"
    return f"ln({c} / (1 - {c}))"


def with_quality(
    docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang",
    id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
    url: Column | str | None = None, depth: int = 2,
) -> DataFrame:
    """``docs`` with evidence, host_mean, path_mean and quality (the posterior probability).

    The sites are host and path, or with ``url`` the host and the first ``depth`` directories,
    each level shrunk to the one above; host_mean is then the mean of the last but one level.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    places = [as_column(c) for c in (host, path)] if url is None else site_levels(as_column(url), depth)
    levels = [f"__l{i}" for i in range(len(places))]
    model = fit(docs, labels, id_col, text, label, sample)
    named, at = anonymous(docs)
    keyed = docs.select("*", *[c.cast("string") for c in places]).toDF(*named.columns, *levels)
    found = small(checkpoint(sites(evidence(keyed, model, levels, at[text]), levels)))
    found = found.withColumnsRenamed({c: f"{c}s" for c in levels})
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(keyed.schema.fields)).add("evidence", "double")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            x = np.array([shape(t or b"") for t in texts], float).reshape(-1, N_SHAPE)
            e = np.round(held.value.logits(x), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(e)], names=schema.names)

    on = [F.col(c).eqNullSafe(F.col(f"{c}s")) for c in levels]
    both = keyed.mapInArrow(run, schema).join(found, reduce(Column.__and__, on))
    # the document's own share is taken out of its path
    rest = "(s - 1 / (1 + exp(-evidence)) + strength * host_mean) / (n - 1 + strength)"
    posterior = f"evidence + {_logit(rest)} - {_logit('base')}"
    made = {
        "evidence": F.col("evidence"), "host_mean": F.col("host_mean"), "path_mean": F.expr(rest),
        "quality": F.expr(f"1 / (1 + exp(-({posterior})))"),
    }
    own = [
        F.col(n).alias(c) for c, n in zip(docs.columns, named.columns, strict=True) if c.lower() not in made
    ]
    return both.select(*own, *[v.alias(c) for c, v in made.items()])


def op4_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return with_quality(docs, labels).selectExpr(
        "doc_id", "evidence", "host_mean", "path_mean", "quality", f"quality >= {THRESHOLD} as kept"
    )
