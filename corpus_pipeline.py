"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

In every stage a null or empty text, an id that is null or repeated, rows that are equal in all columns, and an
empty table are allowed; a stage's docstring says what becomes of them. Columns of ``documents`` that a table lacks
are null, others than those do not pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederflow.llm import bpe, langid, mixing, secrets, simhash
from feederflow.llm.common import documents, row_keys, stage
from feederflow.llm.queries import tokenizer

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def conform(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, null where ``docs`` lacks them."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (null or empty text, no letter) or with one less likely than not go.

    All others stay, whatever their id, repeated rows as often as they are there.
    """
    docs = conform(docs)
    found = docs.withColumn("_judged", langid.judged(F.col("text"), langid.learn(docs), spark))
    return found.where((F.col("_judged.pred") != langid.UNDETERMINED) & (F.col("_judged.score") >= 0.5)).select(*COLUMNS)


def first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest id stays, a document without an id only where
    no other is in the group. Rows equal in all columns are one document; a repeated id with another text is not a
    copy. Null and empty texts have one fingerprint and are one group."""
    return simhash.one_of_each(conform(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every row stays, the spans of secrets are masked and ``n_chars`` follows; a null text stays null."""
    docs = conform(docs)
    clean = secrets.redact(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(length, F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document stands as often as the mix takes it, 0 to 3 times.

    The mix takes parts of documents; the part of a time is rounded up with its own probability, by a hash of the
    row. Null is a source of its own. Documents without words (null, empty) are never taken. Rows equal in all
    columns are documents of their own for the mix, which here stand together as often as they were taken.
    """
    docs = conform(docs)
    keys = ("_row1", "_row2")
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(row_keys(docs.columns), keys, strict=True)))
    mix = mixing.mixture(keyed, keep=keys).where("taken > 0")
    times = F.col("taken") / F.col("size")
    whole = F.floor(times)
    luck = F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = mix.select(*keys, (whole + (luck < times - whole).cast("int")).cast("int").alias("_copies")).groupBy(*keys).agg(F.sum("_copies").alias("_copies")).where("_copies > 0")
    once = keyed.dropDuplicates(list(keys)).join(copies, list(keys))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding, a row for every row: ``doc_id``, the number and hash of its ids, and the hash of the
    text that they decode to. A null or empty text has no ids."""
    return bpe.round_trip(docs, tokenizer())


STAGES = [("language_id", known_language), ("near_copies", first_of_copies), ("secret_scan", without_secrets), ("mixing", mixed), ("bpe", encoded)]

#: SQL cannot express these stages; tests/llm compares each of them with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages before the last leave a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
