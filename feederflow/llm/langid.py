"""Language identification by words first, then character n-grams (operator 4).

For each language the model holds ``-log10`` of the relative frequency of its words and of its character
n-grams. A word that any language knows is scored by its frequencies, with ``penalty`` for the languages that
lack it. An unseen word falls back to the longest n-grams of which any language knows one, and takes the mean
over its known n-grams of that length. A text's value in a language is the mean over its words; the least wins.

The whole vocabulary of the labelled sample is kept: 64-bit hashes of words and n-grams in order, with the
languages and values of each, in a flat file that the workers of an executor map into memory.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.common import kept, publish, published, slices, small_batches

_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
MOST_LANGUAGES = 1 << 16
MEMO_BYTES = 48_000_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def key_of(n: int, gram: str) -> int:
    """The model's key of a word (``n`` 0) or of an n-gram. Two of a billion words collide once in some tens of models."""
    return xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), n)


@dataclass
class Model:
    """``keys`` ascend; the languages and values of ``keys[i]`` stand from ``starts[i]`` to ``starts[i + 1]``."""

    langs: list[str]
    keys: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    value: np.ndarray
    penalty: float
    longest: int
    memo: dict[str, int] = field(default_factory=dict)  # word -> row of values
    rows: np.ndarray | None = None

    def _find(self, wanted: list[int]) -> np.ndarray:
        """The place of each key, -1 where the model lacks it."""
        wanted = np.array(wanted, np.uint64)
        if not len(self.keys) or not len(wanted):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def _dense(self, at: np.ndarray) -> np.ndarray:
        """The values in every language of known keys."""
        out = np.full((len(at), len(self.langs)), self.penalty, np.float32)
        size = (self.starts[at + 1] - self.starts[at]).astype(np.int64)
        row = np.repeat(np.arange(len(at)), size)
        flat = np.repeat(self.starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[row, self.lang[flat]] = self.value[flat]
        return out

    def values_of(self, words: list[str]) -> np.ndarray:
        """``words x languages``: a known word's own values, else the mean over its longest known n-grams."""
        out = np.full((len(words), len(self.langs)), self.penalty, np.float32)
        at = self._find([key_of(0, w) for w in words])
        known = np.flatnonzero(at >= 0)
        out[known] = self._dense(at[known])
        todo = np.flatnonzero(at < 0).tolist()
        for n in range(self.longest, 0, -1):
            if not todo:
                break
            grams = [[key_of(n, p[i : i + n]) for i in range(len(p) - n + 1)] for p in (f" {words[k]} " for k in todo)]
            of = np.repeat(np.arange(len(todo)), [len(g) for g in grams])
            at = self._find([x for g in grams for x in g])
            hit = at >= 0
            found = np.bincount(of[hit], minlength=len(todo))
            place = np.flatnonzero(hit)
            total = np.zeros((len(todo), len(self.langs)))
            for a in range(0, len(place), 65536):
                part = place[a : a + 65536]
                np.add.at(total, of[part], self._dense(at[part]))
            done = np.flatnonzero(found)
            out[np.array(todo)[done]] = total[done] / found[done, None]
            todo = [k for k, f in zip(todo, found.tolist(), strict=True) if not f]
        return out

    def learn_words(self, words: set[str]) -> None:
        """Remember the values of new words, in bounded memory."""
        wide = len(self.langs)
        if self.rows is None or len(self.memo) * (4 * wide + 150) > MEMO_BYTES:
            self.memo, self.rows = {}, np.empty((4096, wide), np.float32)
        new = sorted(words.difference(self.memo))
        upto = len(self.memo) + len(new)
        if upto > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty((max(upto - len(self.rows), len(self.rows) // 2), wide), np.float32)])
        for a in range(0, len(new), 16384):
            part = new[a : a + 16384]
            self.rows[len(self.memo) : len(self.memo) + len(part)] = self.values_of(part)
            self.memo.update(zip(part, range(len(self.memo), len(self.memo) + len(part)), strict=True))

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        split = [words_of(t) if t else [] for t in texts]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        self.learn_words(set().union(*split))
        for k, words in enumerate(split):
            if not words or not any(c.isalpha() for w in words for c in w):
                continue
            mean = self.rows[list(map(self.memo.__getitem__, words))].sum(axis=0, dtype=np.float64) / len(words)
            best = int(mean.argmin())
            odds = np.exp(-np.log(10) * min(len(words), 10) * (mean - mean[best]))
            langs[k], scores[k] = self.langs[best], float(1 / odds.sum())
        return langs, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.predict_all([text])
        return langs[0], scores[0]

    def publish(self, spark) -> str:
        about = np.frombuffer(json.dumps([self.langs, self.penalty, self.longest]).encode(), np.uint8)
        return publish(spark, "languages", {"about": about, "keys": self.keys, "starts": self.starts, "lang": self.lang, "value": self.value})


def model_of(name: str) -> Model:
    """A worker's model for a published file."""

    def make() -> Model:
        x = published(name)
        langs, penalty, longest = json.loads(bytes(x["about"]))
        return Model(langs, x["keys"], x["starts"], x["lang"], x["value"], penalty, longest)

    return kept("languages", name, make)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: ``crc32`` of its id as text leaves 2 when divided by 4. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _count(longest: int, most: int = 400_000):
    """Count words and n-grams by language and key; what is held is passed on when it grows beyond ``most`` words."""

    def rows_of(found):
        for lang, words in found.items():
            for n in range(longest + 1):
                grams = words
                if n:
                    grams = Counter()
                    for w, c in words.items():
                        padded = f" {w} "
                        for i in range(len(padded) - n + 1):
                            grams[padded[i : i + n]] += c
                if grams:
                    keys = np.array([key_of(n, g) for g in grams], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()), pa.array(keys), pa.array(list(grams.values()), pa.int64())], ["lang", "n", "key", "c"])

    def run(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for at, texts in slices(b.column(1)):
                for lang, text in zip(b.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    found[lang].update(words_of(text))
                if sum(map(len, found.values())) > most:
                    yield from rows_of(found)
                    found.clear()
        yield from rows_of(found)

    return run


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 5000, longest: int = 5, penalty: float = 7.0) -> Model:
    """A model from the rows that aren't held out and have an id, a text and a language.

    ``docs_per_lang`` bounds the sample of labelled rows that is learned from (by a hash of the id, so it is the
    same in every run), and with it the model, which holds every word and n-gram of the sample. All languages
    count; more than ``MOST_LANGUAGES`` raise a ``ValueError``.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    there = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(there)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds {MOST_LANGUAGES} at most")
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.float32), penalty, longest)
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.lit(4), id_col), F.lit(1 << 30)).alias("draw"))
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, docs_per_lang / n) * (1 << 30))) for k, n in there.items()], "lang string, share bigint")
    sample = rows.join(F.broadcast(shares), "lang").where("draw < share")  # a row for each language: MOST_LANGUAGES at most
    counts = sample.select("lang", "text").mapInArrow(_count(longest), "lang string, n int, key bigint, c bigint")
    table = counts.groupBy("lang", "n", "key").agg(F.sum("c").alias("c")).toArrow()
    lang = np.searchsorted(np.array(langs, object), table["lang"].to_numpy()).astype(np.uint16)
    n, key, c = (table[x].to_numpy() for x in ("n", "key", "c"))
    total = np.zeros((len(langs), longest + 1))
    np.add.at(total, (lang, n), c)
    value = (np.log10(total[lang, n]) - np.log10(c)).astype(np.float32)
    order = np.lexsort((lang, key.view(np.uint64)))
    keys, starts = np.unique(key.view(np.uint64)[order], return_index=True)
    return Model(langs, keys, np.append(starts, len(order)).astype(np.int64), lang[order], value[order], penalty, longest)


def judged(text, model: Model, spark):
    """A column ``struct(pred, score)`` of a text column: only the text goes to a worker, in slices of bounded size."""
    small_batches(spark)
    name = model.publish(spark)

    @F.arrow_udf("pred string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        m = model_of(name)
        pred, score = [], []
        for _, part in slices(texts):
            p, s = m.predict_all(part)
            pred += p
            score += s
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["pred", "score"])

    return judge.asNondeterministic()(text)  # else a filter on it would run it twice


def annotate(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score``; a column of such a name is replaced."""
    found = "_" + "_".join(docs.columns)
    rest = [c for c in docs.columns if c not in (pred, score)]
    both = docs.withColumn(found, judged(F.col(text_col).cast("string"), model, docs.sparkSession))
    return both.select(*rest, F.col(found)["pred"].alias(pred), F.col(found)["score"].alias(score))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    ``lang_pred`` is ``und`` with score 0 for a text that is null or has no letter, and where nothing could be
    learned. Languages that tie go to the first by name. The score is the softmax of the languages' values over
    at most ten words' evidence. Whole texts count; rows without an id or with a repeated one are judged like any
    other; other columns are not read; an empty table gives no rows.
    """
    model = learn(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return annotate(rows, model).select("doc_id", "held_out", "lang_pred", "score")
