"""Secret scans with an incremental blob ledger (operator 8).

Every version of a text is addressed by the SHA-256 of its content. The ledger is a table with a row for each
scan of a blob: ``(blob, rules, spans)``, the rule versions applied and what each of them found. A run scans only
the pairs of blob and rule version that the ledger lacks, appends them, and joins the findings of the present
versions back to every path (row) that holds the blob.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.common import exists, slices, small_batches, stage, stage_path

#: The base rules in the order in which ties are listed, then the rules that this operator adds.
#: kind -> (version, pattern, group whose length is tested or 0, least length)
RULES = {
    "assign": (1, r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (1, r"[0-9a-f]+", 0, 24),
    "pem": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 1),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, rules array<string>, spans array<struct<start:int,end:int,rule:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_HEX = np.zeros(256, np.uint8)
_HEX[list(b"0123456789abcdef")] = 1


def rule_ids(rules=RULES) -> list[str]:
    """Each rule with its version, as the ledger names it."""
    return [f"{k}@{r[0]}" for k, r in rules.items()]


def _long_hex(b: bytes) -> bool:
    """Whether 8 aligned bytes are all hex digits, as within any run of 24."""
    n = len(b) // 8 * 8
    return n > 0 and bool((_HEX[np.frombuffer(b, np.uint8, n)].view(np.uint64) == 0x0101010101010101).any())


#: Searches much cheaper than the patterns, for kinds whose matches all have something simple in common.
HINTS = {
    "assign": lambda b: any(x in b.lower() for x in _NAMES),
    "access": lambda b: b"AKIA" in b,
    "hex": _long_hex,
    "pem": lambda b: b"-----BEGIN " in b,
    "jwt": lambda b: b"eyJ" in b,
}


def scan_text(b: bytes, rules: dict) -> list[tuple[int, int, str]]:
    """``(start, end, rule)`` in code points; per kind the matches are leftmost and don't overlap.

    ``rules``: rule id -> (kind, compiled pattern, group whose length is tested, least length).
    """
    rules = {k: r for k, r in rules.items() if r[0] not in HINTS or HINTS[r[0]](b)}
    if not rules:
        return []
    text = b.decode("utf-8", "replace")
    return [(m.start(), m.end(), k) for k, (_, pattern, group, least) in rules.items() for m in pattern.finditer(text) if len(m[group]) >= least]


def _scan(rules: dict):
    def run(batches):
        known = {f"{k}@{r[0]}": (k, re.compile(r[1].replace("(?ai:", "(?i:"), re.ASCII), r[2], r[3]) for k, r in rules.items()}
        for b in batches:
            for at, texts in slices(b.column(1)):
                todo = b.column(2).slice(at, len(texts))
                spans = [scan_text(t, {x: known[x] for x in want}) for t, want in zip(texts, todo.to_pylist(), strict=True)]
                rows = [[dict(zip(("start", "end", "rule"), s, strict=True)) for s in x] for x in spans]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), todo, pa.array(rows, _SPANS)], ["blob", "rules", "spans"])

    return run


def blob_of(text_col: str):
    """The content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def update_ledger(docs: DataFrame, ledger: str | None = None, text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """Scan the unseen pairs of blob and rule version of ``docs`` and return what the ledger holds for ``rules``.

    ``ledger``: the folder that keeps the ledger between runs; none starts an empty one in the shared folder.
    Copies are folded before the shuffle, so a text crosses it at most once from each task that reads it.
    Returned, one row per blob: ``blob``, ``spans`` (``start``, ``rank``, ``end``, ``kind``), in order, found by
    the present versions of the rules; what older versions found stays in the ledger but does not count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = ledger or stage_path(spark, "ledger")
    wanted = rule_ids(rules)
    want = F.array(*map(F.lit, wanted))
    blobs = docs.select(blob_of(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger and exists(spark, path):
        seen = spark.read.schema(LEDGER).parquet(path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        blobs = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(want, F.coalesce("known", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", want)
    blobs.mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(path)
    rows = spark.read.schema(LEDGER).parquet(path).where(F.arrays_overlap("rules", want))
    present = F.array_distinct(F.flatten(F.collect_list(F.filter("spans", lambda s: F.array_contains(want, s["rule"])))))
    ranked = lambda s: F.struct(s["start"].alias("start"), F.array_position(want, s["rule"]).cast("int").alias("rank"), s["end"].alias("end"), F.substring_index(s["rule"], "@", 1).alias("kind"))
    return rows.groupBy("blob").agg(present.alias("spans")).select("blob", F.array_sort(F.transform("spans", ranked)).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: dict = RULES) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    A null or empty text has no spans; rows that share a text share its findings; rows without an id are
    returned like the others. Columns besides the id and the text are not read; an empty table gives no rows. The
    findings of a blob are a table of their own before they meet the paths, so that the paths of a text that
    many rows hold can be split over tasks.
    """
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob"))
    found = update_ledger(docs, ledger, text_col, rules)
    count = {k: F.size(F.filter("spans", _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE}
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    per_blob = stage(found.select("blob", *count.values(), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")), "findings")
    return paths.join(per_blob, "blob", "left").drop("blob")


def redact(docs: DataFrame, text_col: str = "text", ledger: str | None = None, mark: str = "[secret]", rules: dict = RULES) -> DataFrame:
    """``docs`` with each span of a secret replaced by ``mark``; overlapping spans are replaced as one.

    All rows stay, repeated ones and those with a null or empty text too; other columns are passed through.
    """
    found = update_ledger(docs, ledger, text_col, rules).where(F.size("spans") > 0)
    names = [f"_{k}_" + "_".join(docs.columns) for k in ("blob", "spans")]
    found = stage(found.select(F.col("blob").alias(names[0]), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(names[1])), "secret-spans")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_blank(t, m, mark) if m else t for t, m in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    joined = docs.withColumn(names[0], blob_of(text_col)).join(found, names[0], "left")
    text = F.when(F.col(names[1]).isNull(), F.col(text_col)).otherwise(cut(F.when(F.col(names[1]).isNotNull(), F.col(text_col)), F.col(names[1])))
    return joined.select(*[text.alias(c) if c == text_col else c for c in docs.columns])


def _blank(text: str, spans: list[dict], mark: str) -> str:
    out, upto = [], 0
    for s in spans:
        lo, hi = s["start"], s["end"]
        if hi <= upto:
            continue
        if lo >= upto:
            out += [text[upto:lo], mark]
        upto = hi
    return "".join(out) + text[upto:]
