"""URL filter by rules and by the ratio of two character language models (operator 3).

URLs that the rules allow or block teach two Markov models of characters, of order 0 to ``ORDER``, smoothed from
the short contexts up (Witten-Bell: a context that was followed by many different symbols leaves more to the
shorter one). A URL without a rule is judged by the difference of its log-likelihoods, divided by its length,
against a threshold calibrated on labelled URLs that the models did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feederflow.llm.common import ascii_lower

#: Fixed values of the contract: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 3
ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#%:"
SIZE = len(ALPHABET) + 2  # 0: the start, 1: any other byte
_CODE = np.ones(256, np.int64)
_CODE[list(ALPHABET)] = np.arange(2, SIZE)
_CODE[list(range(65, 91))] = _CODE[list(range(97, 123))]
BINS, WIDEST = 4000, 8.0


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: the host up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path up to ``?``, ``#`` or the end; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``, else null: its host or a subdomain, and its path in front."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def codes(url: bytes) -> np.ndarray:
    """For each byte of a URL, its context of ``ORDER`` symbols and itself, as one number."""
    x = np.concatenate([np.zeros(ORDER, np.int64), _CODE[np.frombuffer(url, np.uint8)]])
    out = np.zeros(len(x) - ORDER, np.int64)
    for k in range(ORDER + 1):
        out = out * SIZE + x[k : len(x) - ORDER + k]
    return out


@dataclass
class Ratio:
    gain: np.ndarray  # log P(symbol | context) of the allowed less that of the blocked, by code
    threshold: float = 0.0

    def score(self, url: bytes | None) -> float:
        """The mean over the URL's bytes; 0 for null or empty."""
        return float(self.gain[codes(url)].mean()) if url else 0.0


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """``log P(symbol | context)`` for every context of ``ORDER`` symbols from the counts of longest codes."""
    p = np.full(SIZE, 1.0 / SIZE)
    table = counts.reshape((SIZE,) * (ORDER + 1)).astype(np.float64)
    for k in range(ORDER + 1):
        c = table.sum(axis=tuple(range(ORDER - k))) if k < ORDER else table
        total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p).reshape(-1)


def _count(batches):
    size = SIZE ** (ORDER + 1)
    total = {}
    for b in batches:
        verdicts = b.column(0).to_pylist()
        for verdict in set(verdicts):
            urls = [u for u, v in zip(b.column(1).to_pylist(), verdicts, strict=True) if v == verdict]
            found = np.bincount(np.concatenate([codes(u) for u in urls]), minlength=size)
            total[verdict] = total.get(verdict, 0) + found
    for verdict, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(at)), pa.array(at), pa.array(c[at])], ["verdict", "code", "n"])


def learn(labelled: DataFrame, folds: int = 5) -> Ratio:
    """``labelled(url, verdict)``: all rows count; one in ``folds`` (by a hash of the URL) sets the threshold, the rest the models.

    What reaches the driver has a fixed bound: a count for each code, ``SIZE ** (ORDER + 1)`` at most, and a
    histogram of the calibration scores. The threshold halves the sum of the two error rates' best bin.
    """
    labelled = labelled.where(F.length("url") > 0).select("verdict", F.col("url").cast("binary").alias("url"))
    fold = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(folds)) == 0
    summed = labelled.where(~fold).mapInArrow(_count, "verdict string, code bigint, n bigint").groupBy("verdict", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    logs = []
    for verdict in ("allow", "block"):
        c = np.zeros(SIZE ** (ORDER + 1), np.int64)
        part = summed[summed["verdict"] == verdict]
        c[part["code"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
        logs.append(log_likelihoods(c))
    model = Ratio((logs[0] - logs[1]).astype(np.float32))
    low = F.floor((F.least(F.greatest(F.col("score"), F.lit(-WIDEST)), F.lit(WIDEST)) + WIDEST) / (2 * WIDEST) * BINS)
    bins = annotate(labelled.where(fold), model).groupBy("verdict", low.alias("bin")).agg(F.count("*").alias("n")).toArrow().to_pandas()
    hist = {v: np.bincount(p["bin"].to_numpy(np.int64), p["n"], BINS + 1) for v, p in bins.groupby("verdict")}
    if len(hist) == 2:
        wrong = np.concatenate([[0], np.cumsum(hist["allow"]) / hist["allow"].sum()]) + np.concatenate([np.cumsum(hist["block"][::-1])[::-1] / hist["block"].sum(), [0]])
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        model.threshold = float(best[len(best) // 2] / BINS * 2 * WIDEST - WIDEST)
    return model


def annotate(urls: DataFrame, model: Ratio, url_col: str = "url", score: str = "score") -> DataFrame:
    """``urls`` with ``score``, the length-normalised log-likelihood difference."""
    from pyspark.sql import types as T

    sent = urls.sparkSession.sparkContext.broadcast(model)
    at, names = urls.columns.index(url_col), urls.columns

    def run(batches):
        model = sent.value
        for b in batches:
            texts = [u.encode() if isinstance(u, str) else u for u in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array([model.score(u) for u in texts], pa.float64())], [*names, score])

    return urls.mapInArrow(run, T.StructType([*urls.schema.fields, T.StructField(score, T.DoubleType())]))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``, ``threshold``.

    A rule's verdict holds; without one, a URL is allowed if its score is above the threshold. Null and empty
    URLs score 0. Where no labelled URL teaches a class, all scores of unlabelled URLs come from the other class and a
    flat model; with no labels at all every score is 0 and nothing is allowed. Repeated rows and rows without an
    id are judged like any other; only the id and the URL are read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    model = learn(rows.where("found is not null").select("url", "found.verdict"))
    scored = annotate(rows, model)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") > model.threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score", F.lit(model.threshold).alias("threshold"))
