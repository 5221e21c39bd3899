"""Near-duplicate vectors by a forest of random-projection trees (operator 9).

In each tree a node cuts its vectors by a random projection at a threshold near the middle where few of them
lie; vectors near the cut spill to both sides. A node that no cut parts well, as a large tight group, stays whole.
The cuts are fitted on a bounded sample; every vector is routed through all trees. Vectors that share a leaf
are compared in double precision. A pair that meets in several leaves counts in the first of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.common import stage
from feederflow.llm.components import connected_components
from feederflow.llm.topk import usable

LEVELS = 24


def directions(dim: int, tree: int, seed: int) -> np.ndarray:
    """The random unit directions of a tree, one for each level."""
    d = np.random.default_rng([seed, tree, dim]).standard_normal((LEVELS, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components lie between 1/2 and 1: an exact step, after which
    no product overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, leaf_sample: int, spill: float) -> list[tuple]:
    """A tree for the projections ``sample`` (rows x levels): nodes ``(cut, left, right)``, a leaf is ``(None, number, 0)``."""
    nodes: list = []
    leaves = 0

    def grow(p: np.ndarray, level: int) -> int:
        nonlocal leaves
        me = len(nodes)
        nodes.append(None)
        if len(p) > leaf_sample and level < LEVELS:
            x = np.sort(p[:, level])
            cuts = np.linspace(*np.quantile(x, (0.3, 0.7)), 33)
            near = np.searchsorted(x, cuts + spill, "right") - np.searchsorted(x, cuts - spill)
            cut = cuts[int(near.argmin())]
            left, right = p[p[:, level] <= cut + spill], p[p[:, level] > cut - spill]
            if max(len(left), len(right)) <= 0.8 * len(p):
                nodes[me] = (float(cut), grow(left, level + 1), grow(right, level + 1))
                return me
            if level + 1 < LEVELS:  # another direction may part them
                nodes[me] = (None, -1, grow(p, level + 1))
                return me
        nodes[me] = (None, leaves, 0)
        leaves += 1
        return me

    grow(sample, 0)
    return nodes


def route(nodes: list[tuple], p: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, leaf)`` of every leaf that a row belongs to."""
    rows, leaves = [], []
    work = [(0, np.arange(len(p)), 0)]
    while work:
        at, mine, level = work.pop()
        cut, a, b = nodes[at]
        if not len(mine):
            continue
        if cut is None and a == -1:
            work.append((b, mine, level + 1))
        elif cut is None:
            rows.append(mine)
            leaves.append(np.full(len(mine), a))
        else:
            x = p[mine, level]
            work += [(a, mine[x <= cut + spill], level + 1), (b, mine[x > cut - spill], level + 1)]
    return np.concatenate(rows), np.concatenate(leaves)


def links_in_leaf(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, leaves: list, leaf: int, least: float, tile: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """``(links, root)``: for each vector its links that are counted in this leaf, and the first vector it reaches there.

    ``leaves`` lists each vector's leaves in ascending order; a pair is counted here if no smaller leaf holds both.
    """
    x = scaled(x)
    norm = np.linalg.norm(x, axis=1)
    wide = max(map(len, leaves))
    before = np.full((len(ids), wide), -1, np.int64)
    for k, mine in enumerate(leaves):
        early = [m for m in mine if m < leaf]
        before[k, : len(early)] = early
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    step = max(1, tile // max(1, len(ids)))
    for at in range(0, len(ids), step):
        cos = (x[at : at + step] @ x.T) / (norm[at : at + step, None] * norm[None, :])
        i, j = np.nonzero(cos >= least)
        i = i + at
        i, j = i[i != j], j[i != j]
        met = np.zeros(len(i), bool)
        for a in range(wide):
            for b in range(wide):
                met |= (before[i, a] >= 0) & (before[i, a] == before[j, b])
        np.add.at(links, i[~met], copies[j[~met]])
        while len(i):
            while (label[label] != label).any():
                label = label[label]
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    while (label[label] != label).any():
        label = label[label]
    return links, label


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, trees: int = 4, leaf_rows: int = 512, spill: float = 0.02, sample_rows: int = 40_000, seed: int = 9) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Only vectors with equal labels and lengths are compared. Null labels, vectors that are null, empty or zero or
    hold null or non-finite components, and rows without an id link with nothing: no links, their own id as
    component, kept (a row without an id has none and is not kept). Equal vectors are folded into one before
    the trees and count as linked with each other; rows that repeat an id each count, with the links of their own
    vector. ``sample_rows`` bounds the sample on which the cuts are fitted; every vector is routed and compared.
    Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = F.coalesce(usable("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    key = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(seed), "v", "label").alias("h2")]
    classes = stage(rows.where(ok).select(*key, "id", "label", "v").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")  # the table fixes the numbers
    n = classes.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = classes.where(F.pmod("h1", F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "v").limit(4 * sample_rows).toArrow().to_pandas()
    sample["dim"] = sample["v"].map(len)
    planted: dict[tuple, list] = {}
    numbers = 0
    starts: dict[tuple, int] = {}
    for (label, dim), part in sample.groupby(["label", "dim"], sort=True):
        x = unit(np.stack(part["v"].to_numpy()))
        for t in range(trees):
            nodes = fit(x @ directions(dim, t, seed).T, max(4, int(leaf_rows * share)), spill)
            planted[label, dim, t], starts[label, dim, t] = nodes, numbers
            numbers += sum(1 for c, a, _ in nodes if c is None and a >= 0)
    sent = spark.sparkContext.broadcast((planted, starts))

    def deal(batches):
        planted, starts = sent.value
        for pdf in batches:
            pdf["dim"] = pdf["v"].map(len)
            for (label, dim), part in pdf.groupby(["label", "dim"]):
                if (label, dim, 0) not in planted:  # a label so rare that the sample has none: one leaf of its own
                    yield pd.DataFrame({"label": part["label"], "dim": part["dim"], "leaf": -1, "class": part["class"], "copies": part["copies"], "v": part["v"], "leaves": [[-1]] * len(part)})
                    continue
                x = unit(np.stack(part["v"].to_numpy()))
                met = []
                for t in range(trees):
                    r, leaf = route(planted[label, dim, t], x @ directions(dim, t, seed).T, spill)
                    met.append((r, leaf + starts[label, dim, t]))
                r, leaf = (np.concatenate([m[k] for m in met]) for k in (0, 1))
                order = np.lexsort((leaf, r))
                r, leaf = r[order], leaf[order]
                of = np.split(leaf, np.flatnonzero(np.diff(r)) + 1)
                took = part.iloc[r]
                yield pd.DataFrame({"label": took["label"].to_numpy(), "dim": took["dim"].to_numpy(), "leaf": leaf, "class": took["class"].to_numpy(), "copies": took["copies"].to_numpy(), "v": took["v"].to_numpy(), "leaves": [of[k] for k in r]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        ids = pdf["class"].to_numpy(np.int64)
        links, label = links_in_leaf(ids, pdf["copies"].to_numpy(np.int64), x, list(pdf["leaves"]), int(pdf["leaf"].iloc[0]), least)
        some = (links > 0) | (label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[some], "b": ids[label[some]], "links": links[some]})

    kind = dict(classes.dtypes)["label"]
    dealt = classes.select("label", "class", "copies", "v").mapInPandas(deal, f"label {kind}, dim int, leaf bigint, class bigint, copies bigint, v array<double>, leaves array<bigint>")
    met = stage(dealt.groupBy("label", "dim", "leaf").applyInPandas(meet, "a bigint, b bigint, links bigint"), "vector-links")
    counted = met.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("others"))
    groups = connected_components(met).select(F.col("node").alias("class"), F.col("label").alias("group"))
    found = classes.select("h1", "h2", "class", "rep", "copies").join(counted, "class", "left").join(groups, "class", "left")
    found = stage(found.select("h1", "h2", "rep", F.coalesce("group", "class").alias("group"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-groups")
    lowest = found.groupBy("group").agg(F.min("rep").alias("component_id"))
    found = stage(found.join(lowest, "group").select("h1", "h2", "n_links", "component_id"), "vector-components")
    keyed = rows.select("id", *[F.when(ok, k).alias(f"h{at + 1}") for at, k in enumerate(key)])
    out = keyed.join(found, ["h1", "h2"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
