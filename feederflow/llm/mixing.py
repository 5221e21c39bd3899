"""Mixing sources to target weights (operator 7), with DataFrame functions only.

Each source's words, its documents in a fixed order, form one stream that is packed into blocks of ``block``
words. The mix is a row of slots, one block each, dealt out in shards. A shard's source counts are a
multinomial draw; slots beyond a source's quota go to the sources that the draws left short, so that every
source ends at its target, to the word: a source's quota is the least number of slots that hold its target, and the
last of them takes only the words that are still wanted. The j-th slot of a source takes the block to which a
pseudorandom permutation of the source's block indices maps ``j`` (another permutation for each pass over the
source), and is joined to it by index.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederflow.llm.common import stage



def _is_prime(n: int) -> bool:
    """Miller-Rabin with the bases that decide every number below 2 ** 64."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


#: The 64 greatest primes below 2 ** 61: beyond any number of blocks, so that each multiplies to a permutation.
PRIMES = list(itertools.islice((n for n in range(2**61 - 1, 2**60, -2) if _is_prime(n)), 64))
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    sized: DataFrame  # a row per document: doc_id, source_id, size, start (first word's place in the source's stream)
    sources: DataFrame  # source, source_id, source_size, weight, target, want (words), blocks, quota (slots)
    slots: DataFrame  # shard, source_id, j, block, words (that a last slot takes; null: the whole block)


def targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with ``source_id``, ``weight`` and ``target``.

    Sources stand by code point, null last, and weigh ``weights`` in turn. The targets share the total size by
    weight; none exceeds ``most`` times its source's size, and what is above is shared again by weight. In order
    of size for weight, the full sources come first; the level of the first that isn't full holds for the rest.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_id"), F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("source_id", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    filling = Window.orderBy("ratio", "source_id")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level).withColumn("open", (F.col("ratio") > F.col("level")).cast("int"))
    df = df.withColumn("opened", F.max("open").over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min_by(F.when(F.col("open") == 1, F.col("level")), F.when(F.col("open") == 1, F.struct("ratio", "source_id"))).over(everything)
    df = df.withColumn("target", F.when(F.col("opened") == 1, F.least(F.col("weight") * first, F.col("cap"))).otherwise(F.col("cap")))
    return df.select("source", "source_id", "source_size", "weight", "target")


def _located(df: DataFrame, value: Column, total: int, pieces: DataFrame, cells: int = 1024) -> DataFrame:
    """Join each row with the piece ``[lo, hi)`` of ``[0, total)`` that holds ``value``: an equal join on a cell of the range."""
    cell = lambda c: F.floor(c.cast("double") / F.lit(float(max(1, total))) * cells)
    spread = pieces.where("hi > lo").withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    return df.withColumn("_at", value).withColumn("_cell", cell(F.col("_at"))).join(spread, "_cell").where("_at >= lo and _at < hi").drop("_cell")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, shard_slots: int = 4096, weights=(5, 2, 1), most: int = 3, seed: int = 7, bucket_rows: int = 1024, bucket_run: int = 4096, keep=()) -> Mix:
    """The mix of ``docs`` as tables; see :func:`mixture` for the rules on nulls. ``keep``: columns that ``sized`` passes on."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("_hash"), *keep]
    sized = stage(docs.select(*columns), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage(_quotas(targets(totals, weights, most), block, most, seed), "mix-sources")
    got = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("slots")).first()["slots"]
    buckets = max(1, -(-sized.count() // bucket_rows))

    # Each document's place in its source's stream: sums within a bucket of the source, before them the sums of whole
    # buckets within a run of buckets, and before those the sums of whole runs. No window grows with the source.
    bucket = F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(buckets)).alias("bucket")
    keyed = sized.join(sources.select(F.col("source").alias("_source"), "source_id"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source_id", "size", "_hash", bucket, *keep)
    full = keyed.where("size > 0")
    before = lambda *keys: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = full.groupBy("source_id", "bucket").agg(F.sum("size").alias("_sum")).withColumn("run", F.floor(F.col("bucket") / bucket_run))
    runs = sums.groupBy("source_id", "run").agg(F.sum("_sum").alias("_sum")).select("source_id", "run", before("source_id", "run").alias("_ahead"))
    base = sums.select("source_id", "run", "bucket", before("source_id", "run", "bucket").alias("_in")).join(runs, ["source_id", "run"]).select("source_id", "bucket", (F.col("_in") + F.col("_ahead")).alias("_base"))
    within = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "_hash", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = full.withColumn("_upto", F.sum("size").over(within)).join(base, ["source_id", "bucket"]).select("doc_id", "source_id", "size", (F.col("_base") + F.col("_upto") - F.col("size")).alias("start"), *keep)
    placed = placed.unionByName(keyed.where("size = 0").select("doc_id", "source_id", "size", F.lit(None).cast("bigint").alias("start"), *keep))

    # Multinomial counts per shard: every slot draws a source with probability in proportion to the quotas.
    running = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = sources.select("source_id", (F.sum("quota").over(running) - F.col("quota")).alias("lo"), F.sum("quota").over(running).alias("hi"))
    spark = docs.sparkSession
    slots = spark.range(got).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, got))).alias("draw"))
    counts = _located(slots, F.col("draw"), got, pieces).groupBy("shard", "source_id").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "shard-counts")
    drawn = counts.groupBy("source_id").agg(F.sum("n").alias("drawn"))
    settled = sources.join(drawn, "source_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    settled = settled.withColumn("over_from", F.sum("over").over(running) - F.col("over")).withColumn("lo", F.sum("short").over(running) - F.col("short")).withColumn("hi", F.sum("short").over(running))
    settled = stage(settled, "mix-settled")
    each = counts.select("shard", "source_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j")).join(settled.select("source_id", "quota", "over_from", "blocks", "tail"), "source_id")
    direct = each.where("j < quota").select("shard", "source_id", "j", "blocks", "quota", "tail")
    extra = each.where("j >= quota").select("shard", (F.col("over_from") + F.col("j") - F.col("quota")).alias("k"))
    n_extra = settled.agg(F.coalesce(F.sum("short"), F.lit(0)).alias("n")).first()["n"]
    passed = _located(extra, F.col("k"), n_extra, settled.select("source_id", "drawn", "blocks", "quota", "tail", "lo", "hi")).select("shard", "source_id", (F.col("drawn") + F.col("k") - F.col("lo")).alias("j"), "blocks", "quota", "tail")
    every = direct.unionByName(passed)

    # A source's last block, which may be short, stands at a slot of each pass that a hash tells; the whole blocks
    # before it take the other slots by the permutation i -> (a * i + b) mod n, with a prime to n.
    epoch, i, n = F.floor(F.col("j") / F.col("blocks")), F.pmod("j", "blocks"), F.col("blocks") - 1
    at = _short_slot(F.col("source_id"), epoch, F.col("blocks"), seed)
    key = F.xxhash64(F.lit(seed), "source_id", epoch)
    a = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(key, F.lit(len(PRIMES))) + 1).cast("int"))
    big = lambda c: c.cast("decimal(19,0)")
    index = F.when(i < at, i).otherwise(i - 1)
    full = F.greatest(n, F.lit(1))
    whole = ((big(F.pmod(a, full)) * big(index) + big(F.pmod(F.shiftright(key, 8), full))) % big(full)).cast("bigint")
    taken = F.when(i == at, n).otherwise(whole)
    words = F.when(F.col("j") == F.col("quota") - 1, F.col("tail"))
    return Mix(placed, sources, every.select("shard", "source_id", "j", taken.alias("block"), words.alias("words")))


def _short_slot(source_id: Column, epoch: Column, blocks: Column, seed: int) -> Column:
    """The slot of a pass in which a source's last block stands."""
    return F.pmod(F.xxhash64(F.lit(seed + 1), source_id, epoch.cast("bigint")), F.greatest(blocks, F.lit(1)))


def _quotas(sources: DataFrame, block: int, most: int, seed: int) -> DataFrame:
    """``sources`` with ``want`` (the target in whole words), ``blocks``, ``quota`` and ``tail``.

    Whole passes over a source come first. Of the last pass the fewest slots that hold the ``rest`` of the words are
    taken; ``tail`` is what the last of them gives (null if the rest is nothing: the last slot is whole).
    """
    size, blocks, rest, at = F.col("source_size"), F.col("blocks"), F.col("_rest"), F.col("_at")
    df = sources.withColumn("want", F.least(F.round("target").cast("bigint"), size * most)).withColumn("blocks", F.ceil(size / block))
    df = df.withColumn("_passes", F.when(size > 0, F.floor(F.col("want") / size)).otherwise(F.lit(0)).cast("bigint"))
    df = df.withColumn("_rest", F.col("want") - F.col("_passes") * size).withColumn("_last", size - (blocks - 1) * block)
    df = df.withColumn("_at", F.coalesce(_short_slot(F.col("source_id"), F.col("_passes"), blocks, seed), F.lit(0)))
    plain = F.ceil(rest / block)
    after = F.greatest(at + 1, F.ceil((rest - F.col("_last")) / block) + 1)  # with the short block among them
    df = df.withColumn("_slots", F.when(rest <= 0, F.lit(0)).when(at >= plain, plain).otherwise(after).cast("bigint"))
    before = (F.col("_slots") - 1) * block
    tail = F.when(rest > 0, rest - F.when(at < F.col("_slots") - 1, before - block + F.col("_last")).otherwise(before))
    df = df.withColumn("tail", tail.cast("bigint")).withColumn("quota", F.col("_passes") * blocks + F.col("_slots"))
    return df.drop("_passes", "_rest", "_last", "_at", "_slots")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, keep=(), **options) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, and the columns ``keep``.

    ``size`` counts the words of a text (null: 0), ``taken`` the words that the mix takes from it, repeats
    counted; a source's taken words are its target, rounded. Null is a source of its own, the last. Rows without
    an id or with the same id are documents of their own. A document without words is never taken; a source
    without words has target 0. An empty table gives no rows; columns not named are not read. A block is taken
    once in a pass over its source and there are at most ``most`` passes, so no document is taken more than
    ``most`` times.
    """
    mix = plan(docs, id_col, text_col, source_col, block, keep=keep, **options)
    times = mix.slots.groupBy("source_id", "block").agg(F.count_if(F.col("words").isNull()).alias("times"), F.max("words").alias("words"))
    start, end, first = F.col("start"), F.col("start") + F.col("size"), F.col("block") * block
    spread = mix.sized.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))))
    share = lambda upto: F.greatest(F.least(end, upto) - F.greatest(start, first), F.lit(0))
    took = share(first + block) * F.coalesce("times", F.lit(0)) + F.when(F.col("words").isNotNull(), share(first + F.col("words"))).otherwise(0)
    per_doc = spread.join(times, ["source_id", "block"], "left").groupBy("source_id", "start", "doc_id", "size", *keep).agg(F.sum(took).cast("bigint").alias("taken"))
    none = mix.sized.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    every = per_doc.unionByName(none.select(*per_doc.columns))
    return every.join(mix.sources.select("source_id", "source_size", "target"), "source_id").select("doc_id", "size", "source_size", "target", "taken", *keep)
