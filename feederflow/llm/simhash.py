"""Near-duplicates by SimHash fingerprints and vantage-point trees (operator 10).

A pair within ``radius`` bits is within ``radius // bands`` bits in at least one of ``bands`` disjoint
groups of bits. For each group a vantage-point tree partitions the fingerprints by their Hamming distance
in that group, which obeys the triangle inequality like the whole distance. A fingerprint belongs to one
leaf (its shard) and also visits the shards that its ball of ``radius // bands`` may reach; the bounds
``d - r <= median`` and ``d + r > median`` prune all others. Inside a shard, whole fingerprints are
compared, so the pairs are exact and none is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.common import row_keys, slices, small_batches, stage
from feederflow.llm.components import connected_components

CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text in UTF-8, unsigned.

    ASCII letters are lower-cased, words are runs without ASCII white space. A null or a text without words
    has fingerprint 0; fewer words than a shingle are one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        runs = zip(*(words[at + k : upto + k] for k in range(shingle)), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in map(b" ".join, runs)), "<u8", upto - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, keys=()) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed BIGINT. ``keys``: BIGINT columns to pass on."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *keys, F.col(text_col).cast("binary").alias("text"))
    names = rows.columns[:-1]

    def run(batches):
        for b in batches:
            for at, texts in slices(b.column(len(names))):
                fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(texts)) for k in range(len(names))), pa.array(fps.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in [*names, "fp"]))


# The trees


def band_masks(bands: int) -> list[int]:
    """Disjoint groups of neighbouring bits that cover all 64."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]


def plant(sample: np.ndarray, mask: int, leaves: int, rng: np.random.Generator) -> list[tuple]:
    """A tree as a list of nodes ``(vantage, median, inner, outer)``; a leaf is ``(None, shard, 0, 0)``.

    ``sample`` sets only where the cuts lie: any tree gives the same pairs.
    """
    least = max(1, len(sample) // max(1, leaves))
    nodes: list = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        me = len(nodes)
        nodes.append(None)
        if len(points) >= 2 * least:
            for _ in range(4):
                v = points[rng.integers(len(points))] ^ np.uint64(rng.integers(0, 2**63, dtype=np.int64)) & np.uint64(mask)
                d = np.bitwise_count((points ^ v) & np.uint64(mask))
                m = int(np.median(d))
                m -= int((d <= m).all())
                inner = d <= m
                if inner.any() and not inner.all():
                    nodes[me] = (int(v), m, grow(points[inner]), grow(points[~inner]))
                    return me
        nodes[me] = (None, shards, 0, 0)
        shards += 1
        return me

    grow(sample)
    return nodes


def route(nodes: list[tuple], mask: int, r: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, shard, owned)`` of every visit: a row's own shard, and each later shard that its ball may reach."""
    own = np.zeros(len(x), np.int32)
    visits: list[tuple[np.ndarray, int]] = []
    work = [(0, np.arange(len(x)), np.ones(len(x), bool))]
    while work:
        at, rows, mine = work.pop()
        v, m, inner, outer = nodes[at]
        if v is None:
            own[rows[mine]] = m
            visits.append((rows, m))
            continue
        d = np.bitwise_count((x[rows] ^ np.uint64(v)) & np.uint64(mask)).astype(np.int16)
        near, far = d - r <= m, d + r > m
        if near.any():
            work.append((inner, rows[near], mine[near] & (d[near] <= m)))
        if far.any():
            work.append((outer, rows[far], mine[far] & (d[far] > m)))
    rows = np.concatenate([v[0] for v in visits])
    shard = np.concatenate([np.full(len(v[0]), v[1], np.int32) for v in visits])
    keep = shard >= own[rows]
    rows, shard = rows[keep], shard[keep]
    return rows, shard, own[rows] == shard


WIDE = 2048  # points in a shard from which its pairs are looked for among equal groups of bits


def pair_blocks(points: np.ndarray, owned: int, radius: int, wide: int = WIDE):
    """``(rows, columns)``: places in ``points`` that hold every pair within ``radius`` bits whose first is among the ``owned``.

    A small shard is one block. In a large one a pair agrees in one of ``radius + 1`` groups of bits at least, so
    the points that share the bits of a group are a block, and the cost grows with the shard, not with its square.
    """
    if len(points) <= wide:
        yield np.arange(owned), np.arange(len(points))
        return
    for mask in band_masks(radius + 1):
        part = points & np.uint64(mask)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for block in np.split(order, cuts):
            if len(block) > 1 and (block < owned).any():
                yield block[block < owned], block


def stars(owned: np.ndarray, guests: np.ndarray, radius: int, tile: int = 1 << 22, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within a shard: each point with the smallest point it reaches there.

    All owned points are compared with each other and with the guests, in tiles of bounded memory. The links
    of a tile are folded into labels at once, so a dense group never leaves a list of all its pairs.
    """
    points = np.concatenate([owned, guests])
    label = np.arange(len(points))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if (up == x).all():
                return x
            x = up

    for rows, columns in pair_blocks(points, len(owned), radius, wide):
        step = max(1, tile // max(1, len(columns)))
        for at in range(0, len(rows), step):
            i, j = np.nonzero(np.bitwise_count(points[rows[at : at + step], None] ^ points[None, columns]) <= radius)
            i, j = rows[at + i], columns[j]
            i, j = i[i != j], j[i != j]
            while len(i):
                a, b = root(i), root(j)
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                if len(i):
                    np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    top = root(np.arange(len(points)))
    linked = np.flatnonzero(top != np.arange(len(points)))
    return points[linked], points[top[linked]]


def linked_fingerprints(classes: DataFrame, radius: int = 4, bands: int = 3, shard_rows: int = 1024, sample_rows: int = 65536, seed: int = 42) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) whose components are those of all links.

    ``sample_rows`` bounds the sample on which the trees are planted; every fingerprint is routed and compared.
    """
    n = classes.count()
    spark = classes.sparkSession
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    share = min(1.0, sample_rows / n)
    line = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = np.array(sorted(r[0] for r in classes.where(line).limit(4 * sample_rows).collect()), np.int64).view(np.uint64)
    rng = np.random.default_rng(seed)
    masks, r = band_masks(bands), radius // bands
    trees = [plant(sample, m, max(1, n // shard_rows), rng) for m in masks]
    sent = spark.sparkContext.broadcast(trees)

    def deal(batches):
        for pdf in batches:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, nodes in enumerate(sent.value):
                rows, shard, owned = route(nodes, masks[k], r, x)
                yield pd.DataFrame({"band": np.full(len(rows), k, np.int32), "shard": shard, "fp": x[rows].view(np.int64), "owned": owned})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, mine = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["owned"].to_numpy(bool)
        a, b = stars(np.sort(x[mine]), np.sort(x[~mine]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = classes.select("fp").mapInPandas(deal, "band int, shard int, fp bigint, owned boolean")
    return dealt.groupBy("band", "shard").applyInPandas(meet, "a bigint, b bigint").distinct()


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42, bands: int = 3, keys=()) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: the fingerprint of every row, and ``(fp, rep, label)`` for every fingerprint, ``rep`` the
    smallest id that has it, ``label`` one fingerprint of its group."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle, seed, keys), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    groups = connected_components(linked_fingerprints(classes, radius, bands, seed=seed))
    return fps, classes.join(groups.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``kept``.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach, itself included;
    ``kept`` marks the rows whose id it is. Null and empty texts have fingerprint zero and link like any other.
    A row without an id gets its group's component (null if no row of the group has an id) and is not kept.
    Rows that repeat an id are all returned. Other columns are not read; an empty table gives no rows.
    """
    fps, groups = labelled(docs, id_col, text_col, **options)
    lowest = groups.where("label <> fp or rep is not null").groupBy("label").agg(F.min("rep").alias("component_id"))
    of = groups.join(lowest, "label", "left").select("fp", "component_id")
    out = fps.join(of, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of near-duplicates: the one of smallest id, among equal
    ids that of smallest hash, a row without an id only where no other has one. Rows equal in all columns are one.

    A repeated id does not make two texts copies: each stays if its group is its own. All columns are passed on.
    """
    fps, groups = labelled(docs, id_col, text_col, keys=row_keys(docs.columns), **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row1", "row2"))
    # By fingerprint before by group: a hot fingerprint is combined before it meets its group's label.
    best = fps.groupBy("fp").agg(first.alias("best")).join(groups.select("fp", "label"), "fp")
    stay = best.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row1").alias("row1"), F.col("best.row2").alias("row2"))
    names = [f"_{k}_" + "_".join(docs.columns) for k in (1, 2)]
    rows = docs.select("*", *(k.alias(n) for k, n in zip(row_keys(docs.columns), names, strict=True)))
    kept = rows.join(stage(stay.toDF(*names), "stay"), names, "left_semi")
    return kept.dropDuplicates(names).select(*docs.columns)
