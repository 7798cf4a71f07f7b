"""Trees of all locations at once: binned blocks, one aggregate per tree level, flattened trees, one scoring expression.

Features are binned once, at quantiles of all rows. The rows of a group (a location's fit rows, its train rows, the pooled rows) lie in
blocks of bounded size. A level of all trees of all groups is one job: tasks walk the trees over their blocks and count bins per open
node, Spark adds the counts up per (group, tree, node, feature, bin, code), and per tree the best splits are chosen from its counts.
The number of jobs follows the depth (and, for boosting, the rounds), never the number of groups, and no group is one task.

Forests count bootstrapped rows (Poisson weights that depend on block and tree only) with balanced class weights and split by Gini
impurity over a random choice of features per node. Boosting grows one regression tree per class and round on the gradients of the
softmax over a group's classes, with row and column sampling; its probabilities sum to 1 as they are.

A model is a row of arrays: features, cuts, left children, leaf values of each tree. Rows to score are packed by group and time, so
that a model meets a pack once, and are walked by a higher-order expression: the plan has the same size for any number of models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.models.components import SEED, BoostParams, ForestParams
from fogbank.operators.segments import time_segment
from fogbank.session import materialise, new_table_path

BINS = 64
BLOCK_ROWS = 1 << 15
#: Trees of a group that meet a block in one row.
CHUNK = 16
CODES = K.CODE_SLOTS
#: Weight of the square of leaf values.
RIDGE = 1.0
BLOCKS = "grp string, block long, n long, weights array<double>, bins binary, codes binary, scores binary"
TREES = "grp string, tree int, open int, body binary"
FLAT = "grp string, tree int, cls int, depth int, feature array<int>, cut array<double>, left array<int>, value array<double>"
KINDS = (("feature", np.int32), ("cut", np.int32), ("left", np.int32), ("value", np.float64), ("active", np.int32))


def pack_tree(tree: dict) -> bytes:
    arrays = [np.asarray(tree[k]).astype(kind).ravel() for k, kind in KINDS]
    return np.array([len(a) for a in arrays], dtype=np.int32).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack_tree(body: bytes) -> dict:
    sizes = np.frombuffer(body, dtype=np.int32, count=len(KINDS))
    out, at = {}, 4 * len(KINDS)
    for (k, kind), n in zip(KINDS, sizes):
        out[k] = np.frombuffer(body, dtype=kind, count=n, offset=at)
        at += n * np.dtype(kind).itemsize
    return out


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Distinct quantiles per feature; a few dozen numbers each."""
    shares = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), F.lit(shares).cast("array<double>"), 10_000).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in got]


def group_weights(rows: DataFrame) -> DataFrame:
    """``grp, n, weights``: rows and balanced weights n / (classes * n_class) by code, from at most eleven counts a group."""
    counts = rows.groupBy("grp", "code").agg(F.count(F.lit(1)).alias("k"))
    held = counts.groupBy("grp").agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("code", "k"))).alias("of"))
    weight = lambda i: F.coalesce(F.col("n") / (F.size("of") * F.try_element_at("of", i)), F.lit(0.0))
    return held.select("grp", "n", F.transform(F.sequence(F.lit(0), F.lit(CODES - 1)), weight).alias("weights"))


def blocks(rows: DataFrame, features: Sequence[str], cuts: list[list[float]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows (grp, code, features) as stored blocks of bins."""
    names = list(features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def flush(grp: str) -> pd.DataFrame:
            nonlocal made
            part = pd.concat(held.pop(grp))
            bins = np.column_stack([np.searchsorted(c, part[f].to_numpy(np.float64), side="left") for f, c in zip(names, cuts)]).astype(np.uint8)
            made += 1
            return pd.DataFrame([(grp, base + made, len(part), part["weights"].iloc[0], bins.tobytes(), part["code"].to_numpy(np.uint8).tobytes(),
                                  np.zeros((len(part), CODES)).tobytes())], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for frame in frames:
            for grp, part in frame.groupby("grp", sort=False):
                held.setdefault(grp, []).append(part)
                if sum(map(len, held[grp])) >= block_rows:
                    yield flush(grp)
        for grp in list(held):
            yield flush(grp)

    sized = rows.select("grp", "code", *[F.col(f).cast("double").alias(f) for f in names]).join(group_weights(rows), "grp")
    dealt = sized.repartition("grp", F.pmod(F.xxhash64(*names), F.ceil(F.col("n") / F.lit(block_rows))))
    return materialise(dealt.drop("n").mapInPandas(run, BLOCKS), "tree-blocks")


def walk(bins: np.ndarray, tree: dict) -> np.ndarray:
    """Leaf, or open node, of every row."""
    node = np.zeros(len(bins), dtype=np.int64)
    todo = np.arange(len(bins))
    while len(todo):
        left = tree["left"][node[todo]]
        todo, left = todo[left >= 0], left[left >= 0]
        at = node[todo]
        node[todo] = left + (bins[todo, tree["feature"][at]] > tree["cut"][at])
    return node


def chosen_features(tree: int, nodes: np.ndarray, n: int, m: int) -> np.ndarray:
    """``m`` of ``n`` features for every node, the same in all tasks."""
    key = (np.uint64(tree) << np.uint64(40)) + (nodes.astype(np.uint64)[:, None] << np.uint64(8)) + np.arange(n, dtype=np.uint64)
    for _ in range(2):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.argsort(key, axis=1, kind="stable")[:, :m]


def draw(*key: int) -> np.random.Generator:
    return np.random.default_rng([SEED, *key])


def forest_counts(bins, codes, block: int, number: int, tree: dict, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (node, feature, bin, code) of the open nodes and bootstrapped rows of each."""
    n, width = bins.shape
    bag = draw(number, block).poisson(1.0, n)
    place = np.full(len(tree["left"]), -1)
    place[tree["active"]] = np.arange(len(tree["active"]))
    node = walk(bins, tree)
    some = np.flatnonzero((place[node] >= 0) & (bag > 0))
    f = chosen_features(number, tree["active"], width, m)[place[node[some]]]
    key = ((node[some][:, None] * width + f) * 256 + bins[some[:, None], f]) * 16 + codes[some][:, None]
    keys, which = np.unique(key, return_inverse=True)
    return keys, np.bincount(which.ravel(), np.repeat(bag[some], f.shape[1]), minlength=len(keys)).astype(np.int64)


def split_forest(keys: np.ndarray, counts: np.ndarray, tree: dict, weights: np.ndarray, width: int, min_leaf: int) -> dict:
    """The tree with its open nodes split where that lowers the Gini impurity."""
    pairs, p = np.unique(keys >> 12, return_inverse=True)
    held = np.zeros((len(pairs), BINS, CODES))
    held[p, keys >> 4 & 255, keys & 15] = counts
    left = held.cumsum(axis=1)
    total = left[:, -1]
    left = left[:, :-1]
    right = total[:, None] - left
    enough = (left.sum(axis=2) >= min_leaf) & (right.sum(axis=2) >= min_leaf)
    pure = lambda x: (x * x).sum(axis=-1) / np.maximum(x.sum(axis=-1), 1e-300)
    gain = np.where(enough, pure(left * weights) + pure(right * weights) - pure(total * weights)[:, None], -1.0)
    value = tree["value"].reshape(-1, CODES)
    if len(value) == 1:
        value = (total[:1] * weights).reshape(1, CODES)
    return grown(pairs, gain, tree, value, width, lambda i, b: (left[i, b] * weights, right[i, b] * weights),
                 lambda i, b: ((left[i, b] > 0).sum(axis=1) > 1, (right[i, b] > 0).sum(axis=1) > 1), 1e-9)


def grown(pairs, gain, tree: dict, value, width: int, sides: Callable, goes_on: Callable, least: float) -> dict:
    """Append the children of every node whose best gain passes ``least``."""
    cut = gain.argmax(axis=1)
    best = gain[np.arange(len(gain)), cut]
    order = np.lexsort((pairs, -best, pairs // width))
    node = pairs[order] // width
    lead = order[np.append(True, node[1:] != node[:-1])] if len(order) else order
    lead = lead[best[lead] > least]
    nodes, at = pairs[lead] // width, len(tree["left"]) + 2 * np.arange(len(lead))
    feature, cuts, left = (np.concatenate([tree[k], np.full(2 * len(lead), fill)]) for k, fill in (("feature", 0), ("cut", 0), ("left", -1)))
    feature[nodes], cuts[nodes], left[nodes] = pairs[lead] % width, cut[lead], at
    one, two = sides(lead, cut[lead])
    children = np.empty((2 * len(lead), value.shape[1]))
    children[0::2], children[1::2] = one, two
    on = np.empty(2 * len(lead), dtype=bool)
    on[0::2], on[1::2] = goes_on(lead, cut[lead])
    return {"feature": feature, "cut": cuts, "left": left, "value": np.concatenate([value, children]), "active": np.flatnonzero(on) + len(tree["left"])}


def softmax(scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probabilities over the codes a group has."""
    e = np.where(weights > 0, np.exp(scores - scores.max(axis=1, keepdims=True)), 0.0)
    return e / e.sum(axis=1, keepdims=True)


def boosted_sums(bins, codes, scores, weights, block: int, number: int, tree: dict, params: BoostParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (node, feature, bin) of the open nodes with sums of gradients and curvatures; ``number``: round * 16 + class."""
    n, width = bins.shape
    cls = number % 16
    p = softmax(scores, weights)[:, cls]
    w = weights[codes]
    place = np.full(len(tree["left"]), -1)
    place[tree["active"]] = np.arange(len(tree["active"]))
    node = walk(bins, tree)
    some = np.flatnonzero((place[node] >= 0) & (draw(number // 16, block).random(n) < params.subsample))
    share = 1.0 if params.features == "all" else float(params.features)
    f = np.sort(chosen_features(number, np.zeros(1), width, max(1, ceil(share * width)))[0])
    key = (node[some][:, None] * width + f) * 256 + bins[some][:, f]
    keys, which = np.unique(key, return_inverse=True)
    add = lambda v: np.bincount(which.ravel(), np.repeat(v[some], len(f)), minlength=len(keys))
    return keys, add(w * (p - (codes == cls))), add(np.maximum(w * p * (1 - p), 1e-16))


def split_boosted(keys, g, h, tree: dict, width: int, params: BoostParams) -> dict:
    """The tree with its open nodes split by the gain of a second-order step."""
    pairs, p = np.unique(keys >> 8, return_inverse=True)
    held = np.zeros((2, len(pairs), BINS))
    held[0, p, keys & 255], held[1, p, keys & 255] = g, h
    left = held.cumsum(axis=2)
    total = left[:, :, -1]
    left = left[:, :, :-1]
    right = total[:, :, None] - left
    worth = lambda x: x[0] ** 2 / (x[1] + RIDGE)
    step = lambda x: -params.rate * x[0] / (x[1] + RIDGE)
    enough = (left[1] >= params.min_leaf) & (right[1] >= params.min_leaf)
    gain = np.where(enough, worth(left) + worth(right) - worth(total)[:, None], -1.0)
    value = tree["value"].reshape(-1, 1)
    if len(value) == 1:
        value = step(total[:, :1]).reshape(1, 1)
    return grown(pairs, gain, tree, value, width, lambda i, b: (step(left[:, i, b])[:, None], step(right[:, i, b])[:, None]),
                 lambda i, b: (np.ones(len(i), bool), np.ones(len(i), bool)), 1e-9)


def first_nodes(groups: DataFrame, numbers: Column, width: int) -> DataFrame:
    """Trees of one open node for every group and number."""
    body = pack_tree({"feature": [0], "cut": [0], "left": [-1], "value": [0.0] * width, "active": [0]})
    return groups.select("grp", F.explode(numbers).alias("tree"), F.lit(1).alias("open"), F.lit(body).alias("body"))


def in_chunks(trees: DataFrame) -> DataFrame:
    """Open trees, a row per group and chunk."""
    return (trees.where("open > 0").groupBy("grp", F.expr(f"tree div {CHUNK}").alias("chunk"))
            .agg(F.collect_list(F.struct("tree", "body")).alias("t"))
            .select("grp", F.col("t.tree").alias("trees"), F.col("t.body").alias("bodies")))


def next_level(stored: DataFrame, groups: DataFrame, trees: DataFrame, width: int, sums: Callable, split: Callable, name: str) -> DataFrame:
    """All trees one level deeper: sums of the blocks, added up by key, then the best splits of every tree."""

    def partial(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, width)
                codes = np.frombuffer(row["codes"], np.uint8)
                scores = np.frombuffer(row["scores"], np.float64).reshape(-1, CODES)
                for number, body in zip(row["trees"], row["bodies"]):
                    keys, a, b = sums(bins, codes, scores, np.array(row["weights"]), row["block"], int(number), unpack_tree(body))
                    yield pd.DataFrame({"grp": row["grp"], "tree": number, "key": keys, "a": a, "b": b})

    def choose(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        tree = unpack_tree(row["body"])
        if len(found) and row["open"]:
            found = found.sort_values("key")
            tree = split(found["key"].to_numpy(), found["a"].to_numpy(), found["b"].to_numpy(), tree, np.array(row["weights"]))
        elif row["open"]:
            tree = {**tree, "active": np.zeros(0, np.int32)}
        return pd.DataFrame([(row["grp"], row["tree"], len(tree["active"]), pack_tree(tree))], columns=["grp", "tree", "open", "body"])

    found = (stored.join(in_chunks(trees), "grp").mapInPandas(partial, "grp string, tree int, key long, a double, b double")
             .groupBy("grp", "tree", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    return materialise(found.groupBy("grp", "tree").cogroup(trees.join(groups, "grp").groupBy("grp", "tree")).applyInPandas(choose, TREES), name)


def flattened(trees: DataFrame, cuts: list[list[float]], forest: bool) -> DataFrame:
    """Trees as arrays: a row goes right where its feature is above the cut; leaf values are probabilities or steps."""
    edges = [np.array(c or [0.0]) for c in cuts]

    def run(frames):
        for frame in frames:
            out = []
            for grp, number, body in zip(frame["grp"], frame["tree"], frame["body"]):
                t = unpack_tree(body)
                inner = t["left"] >= 0
                cut = [float(edges[f][min(c, len(edges[f]) - 1)]) if i else 0.0 for f, c, i in zip(t["feature"], t["cut"], inner)]
                value = t["value"]
                if forest:
                    value = value.reshape(-1, CODES)
                    value = (value / np.maximum(value.sum(axis=1, keepdims=True), 1e-300)).ravel()
                depth, at = 0, np.zeros(1, dtype=np.int64)
                while len(at := at[t["left"][at] >= 0]):
                    at, depth = np.concatenate([t["left"][at], t["left"][at] + 1]), depth + 1
                out.append((grp, number, -1 if forest else number % 16, depth, t["feature"].tolist(), cut, t["left"].tolist(), value.tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FLAT.split(", ")])

    return trees.mapInPandas(run, FLAT)


def features_per_node(strategy: str, n: int) -> int:
    share = {"sqrt": sqrt(n), "log2": log2(max(n, 2)), "all": n}
    return max(1, int(share[strategy] if strategy in share else float(strategy) * n))


def groups_of(stored: DataFrame) -> DataFrame:
    """``grp, weights``, stored: every level needs them."""
    return materialise(stored.groupBy("grp").agg(F.first("weights").alias("weights")), "tree-groups")


def grow_forests(stored: DataFrame, width: int, params: ForestParams) -> DataFrame:
    """Trees of the forests of all groups; as many jobs as levels."""
    m = features_per_node(params.features, width)

    def sums(bins, codes, scores, weights, block, number, tree):
        keys, n = forest_counts(bins, codes, block, number, tree, m)
        return keys, n.astype(float), np.zeros(len(keys))

    def split(keys, a, b, tree, weights):
        return split_forest(keys, a, tree, weights, width, params.min_leaf)

    groups = groups_of(stored)
    trees = first_nodes(groups, F.sequence(F.lit(0), F.lit(params.trees - 1)), CODES)
    for _ in range(params.depth):
        trees = next_level(stored, groups, trees, width, sums, split, "forest-level")
    return trees


def grow_boosted(stored: DataFrame, width: int, params: BoostParams) -> DataFrame:
    """Trees of the boosted models of all groups; as many jobs as rounds times levels."""
    spark = stored.sparkSession
    path = new_table_path(spark, "boosted-trees")
    present = F.filter(F.sequence(F.lit(0), F.lit(CODES - 1)), lambda c: F.get("weights", c) > 0)
    groups = groups_of(stored)

    def sums(bins, codes, scores, weights, block, number, tree):
        return boosted_sums(bins, codes, scores, weights, block, number, tree, params)

    def split(keys, a, b, tree, weights):
        return split_boosted(keys, a, b, tree, width, params)

    def moved(frames):
        for frame in frames:
            rows = frame.to_dict("records")
            for row in rows:
                bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, width)
                scores = np.frombuffer(row["scores"], np.float64).reshape(-1, CODES).copy()
                for number, body in zip(row["trees"], row["bodies"]):
                    tree = unpack_tree(body)
                    scores[:, number % 16] += tree["value"][walk(bins, tree)]
                row["scores"] = scores.tobytes()
            yield pd.DataFrame(rows)[[c.split()[0] for c in BLOCKS.split(", ")]]

    for r in range(params.rounds):
        trees = first_nodes(groups, F.transform(present, lambda c: c + 16 * r), 1)
        for _ in range(params.depth):
            trees = next_level(stored, groups, trees, width, sums, split, "boosted-level")
        trees.write.parquet(f"{path}/round={r}")
        done = trees.groupBy("grp").agg(F.collect_list(F.struct("tree", "body")).alias("t")).select("grp", F.col("t.tree").alias("trees"), F.col("t.body").alias("bodies"))
        stored = materialise(stored.join(done, "grp").mapInPandas(moved, BLOCKS), "tree-blocks")
    return spark.read.schema(TREES).parquet(f"{path}/*")


# --- scoring -------------------------------------------------------------------------------

def model_rows(trees: DataFrame, name: str) -> DataFrame:
    """One row per group: its trees, and the depth of the deepest."""
    return trees.groupBy("grp").agg(F.max("depth").alias(f"{name}_depth"), F.collect_list(F.struct("cls", "feature", "cut", "left", "value")).alias(f"{name}_trees"))


def leaf(tree: Column, x: Column, depth: str) -> Column:
    """Leaf of the values ``x``."""
    return F.aggregate(F.sequence(F.lit(0), F.col(depth)), F.lit(0), lambda node, _: F.when(
        F.get(tree["left"], node) >= 0, F.get(tree["left"], node) + (F.get(x, F.get(tree["feature"], node)) > F.get(tree["cut"], node)).cast("int")).otherwise(node))


def zeros() -> Column:
    return F.array_repeat(F.lit(0.0), CODES)


def forest_slots(x: Column) -> Column:
    total = F.aggregate("forest_trees", zeros(), lambda acc, t: F.zip_with(
        acc, F.slice(t["value"], leaf(t, x, "forest_depth") * CODES + 1, CODES), lambda a, b: a + b))
    return F.transform(total, lambda v: v / F.size("forest_trees"))


def boosted_slots(x: Column) -> Column:
    score = F.aggregate("boosted_trees", zeros(), lambda acc, t: F.transform(
        acc, lambda v, c: F.when(c == t["cls"], v + F.get(t["value"], leaf(t, x, "boosted_depth"))).otherwise(v)))
    # Codes without a tree are none of the group's.
    raised = F.transform(score, lambda v, c: F.when(F.exists("boosted_trees", lambda t: t["cls"] == c), F.exp(v)).otherwise(0.0))
    return F.aggregate(F.array(F.lit(0)), raised, lambda e, _: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def slots(rows: DataFrame, models: DataFrame, features: Sequence[str], keep: Sequence[str], ts: str = "ts") -> DataFrame:
    """``grp``, ``keep`` and the slot arrays ``forest`` and ``boosted`` (those that the models have) of rows (grp, ts, keep, features).

    ``models``: one row per group, with ``medians`` for features a row lacks.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    packed = rows.groupBy("grp", time_segment(ts).alias("_seg")).agg(F.collect_list(F.struct(*keep, x.alias("_x"))).alias("_rows"))
    filled = packed.join(models, "grp").withColumn("_rows", F.transform("_rows", lambda r: r.withField(
        "_x", F.zip_with(r["_x"], "medians", lambda v, m: F.coalesce(v, m)))))
    parts = [(n, f) for n, f in (("forest", forest_slots), ("boosted", boosted_slots)) if f"{n}_trees" in models.columns]
    scored = F.transform("_rows", lambda r: F.struct(*[r[k].alias(k) for k in keep], *[f(r["_x"]).alias(n) for n, f in parts]))
    return filled.select("grp", F.inline(scored))


def grow(rows: DataFrame, features: Sequence[str], kind: str, forest: ForestParams, boosted: BoostParams) -> DataFrame:
    """Models of all groups of complete rows (grp, code, features).

    One row per group: grp, medians, forest_depth, forest_trees, boosted_depth, boosted_trees (as the kind has them).
    """
    cuts = cut_points(rows, features)
    stored = blocks(rows, features, cuts)
    medians = F.array(*[F.percentile_approx(F.col(f).cast("double"), 0.5) for f in features])
    models = rows.groupBy("grp").agg(medians.alias("medians"))
    if kind != "gbt":
        models = models.join(model_rows(flattened(grow_forests(stored, len(cuts), forest), cuts, True), "forest"), "grp")
    if kind != "rf":
        models = models.join(model_rows(flattened(grow_boosted(stored, len(cuts), boosted), cuts, False), "boosted"), "grp")
    return materialise(models, "grown-models")


def importances(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """``grp, position, feature, forest, boosted``: a feature's share of the splits of each part."""
    names = F.array(*map(F.lit, features))
    out = models.select("grp", F.posexplode(names).alias("position", "feature"))
    for part in ("forest", "boosted"):
        if f"{part}_trees" not in models.columns:
            out = out.withColumn(part, F.lit(0.0))
            continue
        splits = (models.select("grp", F.explode(f"{part}_trees").alias("t")).select("grp", F.inline(F.arrays_zip("t.feature", "t.left")))
                  .where("left >= 0").groupBy("grp", F.col("feature").alias("position")).agg(F.count(F.lit(1)).alias("n")))
        total = splits.groupBy("grp").agg(F.sum("n").alias("of"))
        share = splits.join(total, "grp").select("grp", "position", (F.col("n") / F.col("of")).alias(part))
        out = out.join(share, ["grp", "position"], "left").fillna(0.0, [part])
    return out
