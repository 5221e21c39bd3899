"""Quality by the perplexity of an interpolated modified Kneser-Ney model (operator 6).

The model is of characters, order ``ORDER``: a symbol is a UTF-16 code unit, so that ``ORDER`` symbols fit a 64-bit
key and every script is modelled. It counts all of the trusted text.

Documents are read in blocks of neighbouring rows of a file. A first pass gives, for each block, its distinct
n-grams with their counts in the trusted documents. All that follows are joins of count tables that Spark shards by
hash: counts and continuation counts, discounts, contexts' totals and interpolated probabilities of every n-gram of
the corpus, order by order, and at last the probabilities of each block's n-grams. Those are a table partitioned by
block in the shared folder; a second pass over the documents looks up its own block there and adds up. So texts
never cross a shuffle, no table is gathered on the driver or broadcast, and what a task reads is as large as its
block. A document is kept if its perplexity is at most its language's quantile of the trusted documents'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.common import drop_stage, open_shared, slices, small_batches, stage, stage_path

ORDER = 4
BITS = 16
START = (1 << BITS) - 1  # stands before a text; U+FFFF is no character
HELD = 4_000_000  # n-grams that a task holds before it passes them on


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every symbol of the texts, as one number, and each text's number of symbols."""
    raw = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    pad = np.full(ORDER - 1, START, np.uint16)
    x = np.concatenate([y for r in raw for y in (pad, r)] or [pad]).astype(np.uint64)
    g = np.zeros(max(0, len(x) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        g = g << np.uint64(BITS) | x[k : len(x) - ORDER + 1 + k]
    keep = np.ones(len(g), bool)
    for e in np.cumsum(size + ORDER - 1)[:-1].tolist():  # windows that reach into the next text
        keep[e - ORDER + 1 : e] = False
    return g[keep].view(np.int64), size


def located(docs: DataFrame, block_rows: int) -> DataFrame:
    """``docs`` with ``block`` and ``place``: neighbouring rows of a file have a block in common, in every scan.

    A table that isn't a scan of Parquet files is written to the shared folder first.
    """
    at = [F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / block_rows)).alias("block"), (F.col("_metadata.row_index") % block_rows).cast("int").alias("place")]
    try:
        return docs.select("*", *at)
    except AnalysisException:
        return stage(docs, "documents").select("*", *at)


def _side_table(folder: str, block: int) -> pa.Table | None:
    """The rows of one block of a table that is partitioned by block; none if it has none."""
    fs, root = open_shared(f"{folder}/block={block}")
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(p, filesystem=fs, partitioning=None) for p in sorted(found)]) if found else None


def _runs(block: np.ndarray):
    """``(start, end)`` of the runs of rows with one block."""
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    return zip(cuts, cuts[1:], strict=False) if len(block) else ()


def _trusted_places(folder: str, block: int) -> np.ndarray:
    t = _side_table(folder, block)
    return np.unique(t["place"].to_numpy()) if t is not None else np.zeros(0, np.int32)


def block_grams(docs: DataFrame, places: str) -> DataFrame:
    """``(block, g, c)``: the distinct n-grams of each block of ``docs(block, place, text)`` with their counts in its trusted rows.

    A block that several tasks read has rows from each of them.
    """

    def rows_of(held):
        for block, (g, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(g), pa.array(c)], ["block", "g", "c"])

    def run(batches):
        held: dict[int, tuple] = {}
        last, trusted = None, None
        for b in batches:
            blocks, place = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi in _runs(blocks):
                block = int(blocks[lo])
                if block != last:
                    last, trusted = block, _trusted_places(places, block)
                good = np.isin(place[lo:hi], trusted)
                for at, texts in slices(b.column(2).slice(lo, hi - lo)):
                    g, size = grams_of(texts)
                    mine = np.repeat(good[at : at + len(texts)], size)
                    old, count = held.get(block, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    keys, inverse = np.unique(np.concatenate([old, g]), return_inverse=True)
                    held[block] = keys, np.bincount(inverse, np.concatenate([count, mine]), len(keys)).astype(np.int64)
                if sum(len(g) for g, _ in held.values()) > HELD:
                    yield from rows_of(held)
                    held.clear()
        yield from rows_of(held)

    return docs.select("block", "place", "text").mapInArrow(run, "block bigint, g bigint, c bigint")


def interpolate(grams: DataFrame) -> DataFrame:
    """``(g, p)``: the interpolated probability of the last symbol of every n-gram of ``grams(g, c)`` after the others.

    ``c`` is its count in the trusted text, 0 for one that is only looked up. Order by order, a table holds all
    ends of the n-grams; a context that the trusted text lacks leaves all to the next lower order.
    """
    tables = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND((1 << BITS * k) - 1)
        tables[k] = stage(tables[k + 1].groupBy(low.alias("g")).agg(F.count_if(F.col("c") > 0).alias("c")), f"continuations-{k}")
    lower = None
    for k in range(1, ORDER + 1):
        t, c = tables[k], F.col("c")
        n1, n2, n3, n4 = t.agg(*[F.count_if(c == i) for i in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        cut = [max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(c == 1, cut[0]).when(c == 2, cut[1]).when(c >= 3, cut[2]).otherwise(0.0)
        t = t.withColumn("h", F.shiftrightunsigned("g", BITS)).withColumn("off", off)
        contexts = t.where(c > 0).groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("left"))
        t = t.join(contexts, "h", "left")
        if lower is None:
            t = t.withColumn("p0", F.lit(1.0 / (1 << BITS)))
        else:
            t = t.withColumn("low", F.col("g").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(lower.select(F.col("g").alias("low"), F.col("p").alias("p0")), "low")
        p = F.when(F.col("total").isNull(), F.col("p0")).otherwise((c - F.col("off") + F.col("left") * F.col("p0")) / F.col("total"))
        before, lower = lower, stage(t.select("g", p.alias("p")), f"order-{k}")
        for done in (before, tables[k] if k < ORDER else None):
            if done is not None:
                drop_stage(done)
    return lower


def score(docs: DataFrame, places: str, answers: str) -> DataFrame:
    """``(doc_id, lang, perplexity, trusted)`` for each row; ``answers`` holds the log-probabilities of each block's n-grams."""

    def run(batches):
        last, trusted, keys, logs = None, None, None, None
        for b in batches:
            blocks, place = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi in _runs(blocks):
                block = int(blocks[lo])
                if block != last:
                    last, trusted = block, _trusted_places(places, block)
                    t = _side_table(answers, block)
                    keys = np.zeros(0, np.int64)
                    if t is not None:
                        keys, first = np.unique(t["g"].to_numpy(), return_index=True)
                        logs = t["logp"].to_numpy()[first]
                for at, texts in slices(b.column(4).slice(lo, hi - lo)):
                    g, size = grams_of(texts)
                    worth = np.full(len(texts), np.nan)
                    if len(g):
                        where = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
                        if not len(keys) or (keys[where] != g).any():
                            raise RuntimeError("the documents changed between the two passes")
                        sums = np.concatenate([[0.0], np.cumsum(logs[where], dtype=np.float64)])
                        ends = np.cumsum(size)
                        some = size > 0
                        worth[some] = np.exp((sums[ends - size] - sums[ends])[some] / size[some])
                    a, e = lo + at, lo + at + len(texts)
                    good = np.isin(place[a:e], trusted)
                    yield pa.RecordBatch.from_arrays([b.column(2).slice(a, e - a), b.column(3).slice(a, e - a), pa.array(worth, mask=np.isnan(worth)), pa.array(good)], ["doc_id", "lang", "perplexity", "trusted"])

    return docs.select("block", "place", "doc_id", "lang", "text").mapInArrow(run, "doc_id bigint, lang string, perplexity double, trusted boolean")


def filter_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995, block_rows: int = 16_384) -> DataFrame:
    """One row per input row: ``doc_id``, ``lang``, ``perplexity``, ``threshold``, ``kept``.

    ``trusted`` has the ids of trusted documents in a column ``id``. A language's threshold is the ``quantile`` of
    its trusted documents' perplexities; null is a language of its own, and a language without trusted documents
    takes the quantile of all of them. A null or empty text has no perplexity and is not kept. Without trusted
    text there is no perplexity and no threshold, and every text that isn't empty is kept. Rows that repeat an id
    are judged like any other, trusted if the id is; rows without an id are never trusted. Other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = located(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), block_rows)
    good = trusted.select(F.col("id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    places, answers = stage_path(spark, "trusted-places"), stage_path(spark, "answers")
    mine = rows.select("block", "place", "doc_id").join(good, "doc_id", "left_semi").select("block", "place")
    mine.repartition("block").write.partitionBy("block").parquet(places)
    found = stage(block_grams(rows, places), "block-grams")
    grams = stage(found.groupBy("g").agg(F.sum("c").alias("c")), "grams")
    if grams.where("c > 0").isEmpty():
        answers = None
    else:
        p = interpolate(grams)
        reply = found.select("block", "g").join(p, "g").select("block", "g", F.log("p").cast("float").alias("logp"))
        reply.repartition("block").write.partitionBy("block").parquet(answers)
        drop_stage(p)
    drop_stage(grams)
    drop_stage(found)
    if answers is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", none.alias("perplexity"), none.alias("threshold"), (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("kept"))
    scored = stage(score(rows, places, answers), "scored")
    known = scored.where("trusted and perplexity is not null")
    per_lang = known.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"))
    overall = known.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    out = scored.join(per_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
