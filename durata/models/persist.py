"""Saving and loading fitted models as Parquet tables.

Parameters are one JSON row; the trees of forests and boosted models are a table of their
own with one row per node, written and read tree by tree, so no value grows with a model.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from durata.models.aft import AFTModel
from durata.models.base import HorizonModel
from durata.models.boosting import BoostedHorizons, BoostedSurvival
from durata.models.cox import CoxModel
from durata.models.forest import SurvivalForest
from durata.models.marginal import KaplanMeierModel
from durata.models.seeds import SeedEnsemble
from durata.models.trees import Tree

KINDS = {
    k.__name__: k
    for k in (AFTModel, BoostedHorizons, BoostedSurvival, CoxModel, SurvivalForest, KaplanMeierModel)
}


NODES = (
    "path string, slot int, tree int, node int, feature int, cut int, left int, right int, "
    "depth int, value array<double>"
)
NODE_ROWS = 200_000  # rows of the node table that are written at once


def _slots(model: HorizonModel) -> list[list[Tree]]:
    """Trees per horizon, or one list."""
    trees = model.trees
    return trees if trees and isinstance(trees[0], list) else [trees]


def to_payload(model: HorizonModel, path: str = "0") -> tuple[dict, list[tuple[str, HorizonModel]]]:
    """Parameters without trees, and the tree models below ``path``."""
    if isinstance(model, SeedEnsemble):
        parts = [to_payload(m, f"{path}.{i}") for i, m in enumerate(model.models)]
        body = {"kind": "SeedEnsemble", "seeds": list(model.seeds), "features": model.features,
                "models": [p for p, _ in parts]}
        return body, [x for _, more in parts for x in more]
    if isinstance(model, KaplanMeierModel):
        return {"kind": "KaplanMeierModel", "body": json.dumps({"probs": model.probs})}, []
    kind = type(model).__name__
    if isinstance(model, (BoostedHorizons, BoostedSurvival, SurvivalForest)):
        nested = isinstance(model, BoostedHorizons)
        bare = replace(model, trees=[[] for _ in model.trees] if nested else [])
        return {"kind": kind, "body": bare.to_json(), "path": path}, [(path, model)]
    return {"kind": kind, "body": model.to_json()}, []


def from_payload(d: dict, trees: dict[str, dict[int, list[Tree]]]) -> HorizonModel:
    if d["kind"] == "SeedEnsemble":
        models = [from_payload(m, trees) for m in d["models"]]
        return SeedEnsemble(None, tuple(d["seeds"]), d["features"], models)
    if d["kind"] == "KaplanMeierModel":
        return KaplanMeierModel(probs=json.loads(d["body"])["probs"])
    model = KINDS[d["kind"]].from_json(d["body"])
    if "path" in d:
        slots = trees.get(d["path"], {})
        if isinstance(model, BoostedHorizons):
            model.trees = [slots.get(i, []) for i in range(len(model.trees))]
        else:
            model.trees = slots.get(0, [])
    return model


def node_rows(path: str, model: HorizonModel) -> Iterator[tuple]:
    for s, trees in enumerate(_slots(model)):
        for t, tree in enumerate(trees):
            for n, f in enumerate(tree.feature):
                value = np.atleast_1d(np.asarray(tree.value[n], dtype=float)).tolist()
                fields = (f, tree.cut[n], tree.left[n], tree.right[n], tree.depth[n])
                yield path, s, t, n, *map(int, fields), value


def read_trees(nodes: DataFrame) -> dict[str, dict[int, list[Tree]]]:
    """The trees of a node table, by model path and slot."""
    out: dict[str, dict[int, list[Tree]]] = {}
    rows = nodes.orderBy("path", "slot", "tree", "node").toLocalIterator()
    for path, slot, number, node, feature, cut, left, right, depth, value in rows:
        trees = out.setdefault(path, {}).setdefault(slot, [])
        if number == len(trees):
            trees.append(Tree([], [], [], [], [], [], [], []))
        tree = trees[number]
        if node != len(tree.feature):
            raise ValueError(f"node {node} of tree {number} is missing or repeated")
        tree.feature.append(feature)
        tree.cut.append(cut)
        tree.left.append(left)
        tree.right.append(right)
        tree.depth.append(depth)
        tree.value.append(value[0] if len(value) == 1 else np.array(value))
    return out


def save_model(spark: SparkSession, model: HorizonModel, path: str) -> str:
    """Parameter models as JSON text; built-in classifiers in their own ML format."""
    from durata.models.classifiers import HorizonClassifiers

    if isinstance(model, HorizonClassifiers):
        body = {
            "kind": "HorizonClassifiers", "features": model.features, "medians": model.imputer.medians,
            "mean": model.scaler.mean, "scale": model.scaler.scale,
            "parts": [m if isinstance(m, float) else type(m).__name__ for m in model.models],
        }
        for i, m in enumerate(model.models):
            if not isinstance(m, float):
                m.write().overwrite().save(f"{path}/horizon_{i}")
        spark.createDataFrame([(json.dumps(body),)], "payload string").write.mode("overwrite").parquet(
            f"{path}/model"
        )
        return path
    body, tree_models = to_payload(model)
    spark.createDataFrame([(json.dumps(body),)], "payload string").write.mode("overwrite").parquet(
        f"{path}/model"
    )
    rows = chain.from_iterable(node_rows(*x) for x in tree_models)
    mode = "overwrite"
    while tree_models and (part := list(islice(rows, NODE_ROWS))):
        spark.createDataFrame(part, NODES).coalesce(1).write.mode(mode).parquet(f"{path}/nodes")
        mode = "append"
    return path


def load_model(spark: SparkSession, path: str) -> HorizonModel:
    from pyspark.ml import classification

    from durata.functions.impute import MedianImputer, Standardizer
    from durata.models.classifiers import HorizonClassifiers

    d = json.loads(spark.read.parquet(f"{path}/model").first()[0])
    if d["kind"] != "HorizonClassifiers":
        has_trees = '"path"' in json.dumps(d)
        return from_payload(d, read_trees(spark.read.schema(NODES).parquet(f"{path}/nodes")) if has_trees else {})
    parts = [
        p if isinstance(p, float) else getattr(classification, p).load(f"{path}/horizon_{i}")
        for i, p in enumerate(d["parts"])
    ]
    return HorizonClassifiers(
        None, 42, d["features"], MedianImputer(d["features"], d["medians"]),
        Standardizer(d["features"], d["mean"], d["scale"]), parts,
    )
