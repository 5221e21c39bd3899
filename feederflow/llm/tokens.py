"""Token counts from flat token files without an index (operator 1).

A token file is nothing but token ids, a separator after each document. Files are read in blocks that know
nothing of documents: each block searches for the separators at once and reports the documents that lie within it,
and the tokens before its first and after its last separator. A prefix scan over a file's blocks stitches the
documents that cross block ends and numbers them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.llm.bpe import encoder_of, load_vocabulary, publish_encoder
from feederflow.llm.common import open_shared, slices, stage, stage_path


def width_of(tokenizer: str, separator: int | None = None) -> tuple[int, str]:
    """The separator's id and the narrowest unsigned type that holds it and every id of the vocabulary.

    Without a ``separator``, the vocabulary's ``<|endoftext|>`` serves, or else the first id beyond it.
    """
    v = load_vocabulary(tokenizer)
    if separator is None:
        separator = v.special.get("<|endoftext|>", len(v.tokens))
    return separator, "<u2" if max(separator, len(v.tokens) - 1) < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, separator: int, width: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts into flat files in ``folder``, one for each partition of ``docs``.

    Returned, as a table: ``(file, n_bytes, ordinal, doc_id)``, where each document went. A file appears under its
    name only when complete, so a task that is run again leaves the same file. Null and empty texts are a
    separator alone. The separator's own string in a text is ordinary text, so no document holds a separator.
    """
    name = publish_encoder(docs, tokenizer, most=0)

    def run(batches):
        fs, root = open_shared(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        file = f"tokens-{task.partitionId():06d}.bin"
        part = f"{root}/_{file}.{task.taskAttemptId()}"
        encoder = encoder_of(name, literal_special=True)
        went = []
        with fs.open_output_stream(part) as out:
            for b in batches:
                for _, texts in slices(b.column(1)):
                    ids, ends = encoder.encode_all(texts)
                    out.write(np.insert(ids.astype(width), ends[1:], separator).astype(width).tobytes())
                went.append(b.column(0))
        fs.move(part, f"{root}/{file}")
        n, size = sum(map(len, went)), fs.get_file_info(f"{root}/{file}").size
        yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array(np.arange(n)), pa.concat_arrays(went) if went else pa.array([], pa.int64())], ["file", "n_bytes", "ordinal", "doc_id"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(run, "file string, n_bytes bigint, ordinal bigint, doc_id bigint"), "token-files")


def summarise(block: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """``(separators, head, tail, inner)``: tokens before the first and after the last separator, and those of each
    document between two; a block without a separator is all tail."""
    at = np.flatnonzero(block == separator)
    if not len(at):
        return 0, 0, len(block), at
    return len(at), int(at[0]), len(block) - 1 - int(at[-1]), np.diff(at) - 1


def count_tokens(files: DataFrame, folder: str, separator: int, width: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """``(file, ordinal, n_tokens)`` of each document in the flat token files ``files(file, n_bytes)``.

    Blocks of ``block_tokens`` are read and searched independently. Tokens after a file's last separator are no
    document. Documents without tokens count 0; a file without tokens has no documents; bytes beyond the last
    whole token are ignored. Files named more than once are counted once.
    """
    step = block_tokens * np.dtype(width).itemsize
    blocks = files.select("file", "n_bytes").distinct().where("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_bytes") - 1) / step))).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def run(batches):
        fs, root = open_shared(folder)
        for b in batches:
            for name, size, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(min(step, size - k * step), k * step)
                found, head, tail, inner = summarise(np.frombuffer(raw[: len(raw) // np.dtype(width).itemsize * np.dtype(width).itemsize], width), separator)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([found]), pa.array([head]), pa.array([tail]), pa.array([inner], pa.list_(pa.int64()))], ["file", "block", "found", "head", "tail", "inner"])

    seen = blocks.mapInArrow(run, "file string, block bigint, found bigint, head bigint, tail bigint, inner array<bigint>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # What a block's first document has from the blocks before: all tails since the last block with a separator.
    seen = seen.withColumn("run", F.coalesce(F.sum((F.col("found") > 0).cast("int")).over(before), F.lit(0)))
    carry = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.lag(F.when(F.col("found") > 0, F.col("tail"))).over(order)
    seen = seen.withColumn("last_tail", first).withColumn("ordinal", F.coalesce(F.sum("found").over(before), F.lit(0)))
    opened = F.coalesce(F.sum(F.when(F.col("found") == 0, F.col("tail"))).over(carry), F.lit(0)) + F.coalesce(F.max("last_tail").over(Window.partitionBy("file", "run")), F.lit(0))
    seen = seen.withColumn("carry", opened).where("found > 0")
    sizes = F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))
    return seen.select("file", "ordinal", F.posexplode(sizes).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")


def document_tokens(docs: DataFrame, tokenizer: str, separator: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``; the texts go through flat token files in the shared folder.

    Null and empty texts count 0 tokens; rows without an id or with a repeated one count like any other; other
    columns are not read; an empty table gives no rows. Tokens take two bytes, or four where an id needs them.
    """
    folder = stage_path(docs.sparkSession, "flat-tokens")
    separator, width = width_of(tokenizer, separator)
    went = write_token_files(docs, folder, tokenizer, separator, width, id_col, text_col)
    counted = count_tokens(went, folder, separator, width, block_tokens).hint("merge")  # as long as the corpus, whatever the planner expects
    return went.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
