"""Toxicity: a counterfactual-regularised linear classifier over word and stem features.

Features of a text are the presence of its lower-case words and of their first four and five
characters, hashed. The classifier is a sparse logistic regression fitted on labelled rows.
For each training text with an identity term (a word for a group of people) the terms are
swapped for their counterparts, and the squared change of score is penalised, so neutral
mentions of a group carry no weight of their own and false positives on them fall.

Fitting uses at most ``sample`` labelled rows of each class, in hash order of their id (a
documented bound; all others are only scored); if that takes unequal shares of the classes,
the intercept is moved back to the rate of all labels given. The model is a few weights, so scoring is one
pass over whole texts. Labels, language, source and id are never inputs of a score.

Null texts count as empty and are scored too (by the intercept); rows without a label, null
labels and labels without a text take no part in fitting; repeated rows are scored alike.
Without labels of both classes every score is the positive rate (one half without any).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.common import texts_map
from durata.llm.linear import fit_logistic

DIM = 1 << 20
SAMPLE = 6000
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
#: Words for groups of people, and the words that they are swapped for.
IDENTITY = {
    "women": "men", "woman": "man", "female": "male", "girl": "boy", "girls": "boys",
    "gay": "straight", "lesbian": "straight", "homosexual": "heterosexual", "trans": "cis",
    "transgender": "cisgender", "muslim": "christian", "muslims": "christians",
    "jewish": "christian", "jews": "christians", "jew": "christian", "hindu": "christian",
    "black": "white", "african": "european", "asian": "european", "mexican": "american",
    "immigrant": "citizen", "immigrants": "citizens", "refugee": "resident",
    "refugees": "residents", "deaf": "hearing", "blind": "sighted", "disabled": "abled",
    "old": "young", "elderly": "young", "frauen": "männer", "frau": "mann",
    "juden": "christen", "muslime": "christen", "ausländer": "einheimische",
    "femmes": "hommes", "femme": "homme", "juifs": "chrétiens", "musulmans": "chrétiens",
    "mujeres": "hombres", "mujer": "hombre", "judíos": "cristianos", "musulmanes": "cristianos",
}
SWAP = {**{b: a for a, b in reversed(IDENTITY.items())}, **IDENTITY}


def word_features(word: str) -> tuple[int, ...]:
    made = [word, *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) > n)]
    return tuple(zlib.crc32(x.encode()) % DIM for x in made)


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(found: set[str]) -> set[int]:
    return {f for w in found for f in word_features(w)}


def swapped(found: set[str], swap: dict[str, str]) -> set[str] | None:
    """The words with identity terms swapped, or None if there is none."""
    return {swap.get(w, w) for w in found} if any(w in swap for w in found) else None


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities; words without any weight are remembered as such, within a bound."""
        known: dict[str, tuple[int, ...]] = self.__dict__.setdefault("_known", {})
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            active: set[int] = set()
            for w in words(text):
                f = known.get(w)
                if f is None:
                    if len(known) > 500_000:
                        known.clear()
                    f = known[w] = tuple(x for x in word_features(w) if x in self.weights)
                if f:
                    active.update(f)
            out[i] = self.bias + sum(self.weights[x] for x in sorted(active))
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def usable(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    return labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("y"))


def sampling_shift(labels: DataFrame, id_col: str, label: str, sample: int) -> float:
    """What undoes, in log odds, that at most ``sample`` rows of each class were taken."""
    counts = {r["y"]: r["n"] for r in usable(labels, id_col, label).groupBy("y").agg(F.count("*").alias("n")).collect()}
    left_out = [np.log(max(1.0, counts.get(y, 0) / max(1, sample))) for y in (0, 1)]
    return float(left_out[1] - left_out[0])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int):
    """(text, y) of at most ``sample`` labelled rows of each class, in hash order."""
    fit = usable(labels, id_col, label)
    chosen = None
    for y in (0, 1):
        part = fit.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample ids
    return docs.select(id_col, text).join(F.broadcast(chosen), id_col).select(text, "y").where(F.col(text).isNotNull())


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
    label: str = "toxic", sample: int = SAMPLE, pull: float = 1.0, l1: float = 1e-4,
    swap: dict[str, str] | None = None,
) -> Model:
    swap = SWAP if swap is None else swap
    rows = training_rows(docs, labels, id_col, text, label, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, gained, lost = [], [], []
            for t in batch.column(0).to_pylist():
                found = words(t)
                f = features(found)
                other = swapped(found, swap)
                g = features(other) if other is not None else f
                plain.append(sorted(f))
                gained.append(sorted(g - f))
                lost.append(sorted(f - g))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(plain, kind), pa.array(gained, kind), pa.array(lost, kind), batch.column(1)],
                names=["f", "gained", "lost", "y"],
            )

    made = rows.mapInArrow(run, "f array<int>, gained array<int>, lost array<int>, y int")
    got = made.orderBy(F.xxhash64("f"), "y").limit(4 * sample).toArrow()
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))

    def lists(name: str) -> list[np.ndarray]:
        column = got.column(name).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        values, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
        ends = ends - ends[0]
        return np.split(values, ends[1:-1])

    f, gained, lost = lists("f"), lists("gained"), lists("lost")
    flat = np.concatenate(f)
    seen = np.bincount(flat, minlength=DIM)
    hits = np.bincount(flat, weights=np.repeat(y, [len(x) for x in f]), minlength=DIM)
    rate = y.mean()
    # features too rare or too even to matter get no weight
    far = np.abs(hits - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    use = np.flatnonzero((seen >= 4) & (far > 2.5))
    place = np.full(DIM, -1, np.int64)
    place[use] = np.arange(len(use))

    def narrow(xs: list[np.ndarray]) -> list[np.ndarray]:
        return [p[p >= 0] for p in (place[x] for x in xs)]

    pairs = list(zip(narrow(gained), narrow(lost), strict=True))
    w, b = fit_logistic(narrow(f), y, len(use), l1, pairs, pull)
    b += sampling_shift(labels, id_col, label, sample)
    return Model({int(use[i]): float(w[i]) for i in np.flatnonzero(w)}, b)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(held.value.scores([t.decode("utf-8") for t in texts]))]

    return texts_map(docs, fn, text, keep, "score double")


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = "pmod(crc32(cast(doc_id as string)), 4) = 2"
    model = fit(docs, labels.where(f"not ({out})"))
    return score(docs, model, ["doc_id"]).selectExpr(
        "doc_id", f"{out} as held_out", "score", f"cast(score >= {THRESHOLD} as int) as predicted"
    )
