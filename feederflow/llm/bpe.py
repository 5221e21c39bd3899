"""Byte-level BPE encoding and decoding with a word lexicon (operator 2).

The corpus's most frequent words (what stands between single spaces, with the space before) are encoded once and
compiled into a minimal acyclic transducer: words that end alike share states, each arc carries a number, and
the sum along a word's path is its place in the table of id sequences. The transducer is a flat file in the shared
folder that Spark copies to each executor, where every Python worker maps it into memory. Words that it lacks are
merged exactly, pair by pair in order of rank. Texts pass through a worker in slices of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feederflow.llm.common import drop_stage, kept, publish, published, slices, small_batches, stage

#: Fixed value: how byte-level BPE cuts a text into pieces before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(PATTERN)
_BLANK = regex.compile(r"\s")
SLOTS = 1 << 19
LONG_PIECE = 96  # bytes from which a piece is merged with a heap
MERGED_BYTES = 1 << 19  # bytes of pieces that are merged at once
MEMO_BYTES = 48_000_000  # what a worker remembers at most


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary as flat arrays, which may lie in a file that is mapped into memory."""

    byte_table: np.ndarray  # ids of the 256 single bytes
    slot_key: np.ndarray  # pairs ``left << 32 | right`` in an open-addressed table, -1 where empty
    slot_rank: np.ndarray
    pair_new: np.ndarray  # merged id by rank
    token_bytes: np.ndarray  # the tokens' bytes one after another
    token_ends: np.ndarray
    special_ids: np.ndarray

    @cached_property
    def probes(self) -> int:
        """How many slots a search looks at, at most."""
        used = np.flatnonzero(self.slot_key >= 0)
        return int((used - slot_of(self.slot_key[used])).max(initial=0)) + 1

    @cached_property
    def ranks(self) -> dict[int, int]:
        used = np.flatnonzero(self.slot_key >= 0)
        return dict(zip(self.slot_key[used].tolist(), self.slot_rank[used].tolist(), strict=True))

    @cached_property
    def tokens(self) -> pa.Array:
        """The bytes of each token, by id."""
        return _binary(self.token_bytes, self.token_ends)

    @cached_property
    def decimals(self) -> pa.Array:
        """Each id as decimal digits after a comma."""
        texts = [b",%d" % i for i in range(len(self.tokens))]
        return _binary(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    @cached_property
    def special(self) -> dict[str, int]:
        return {self.tokens[i].as_py().decode(): i for i in self.special_ids.tolist()}


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(flat)])


def slot_of(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)).astype(np.int64)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: printable ones for themselves, the rest from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, ids = _byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (1 + max([*ids.values(), *special.values()]))
    for t, i in ids.items():
        tokens[i] = bytes(letters[c] for c in t)
    for t, i in special.items():
        tokens[i] = t.encode()
    pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
    pair_new = np.array([ids[a + b] for a, b in pairs] or [0], np.int64)
    slot_key, slot_rank = np.full(SLOTS + 64, -1, np.int64), np.zeros(SLOTS + 64, np.int64)
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
    for rank, (key, at) in enumerate(zip(keys.tolist(), slot_of(keys).tolist(), strict=True)):
        while slot_key[at] >= 0:  # taken: the next one
            at += 1
        slot_key[at], slot_rank[at] = key, rank
    by_byte = {b: ids[c] for c, b in letters.items()}
    return Vocabulary(np.array([by_byte[b] for b in range(256)], np.int64), slot_key, slot_rank, pair_new, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)], dtype=np.int64), np.array(sorted(special.values()), np.int64))


def merge(word: bytes, v: Vocabulary) -> list[int]:
    """The ids of one piece: of all neighbouring pairs the one of least rank is merged, leftmost first, until none is
    left. A heap of pairs over a linked list, so that a piece of any length takes little more than its length."""
    ranks, new = v.ranks, v.pair_new
    ids = v.byte_table[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    ahead, behind, version = [*range(1, n), -1], [-1, *range(n - 1)], [0] * n
    heap = [(r, i, 0, 0) for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, vi, vj = heapq.heappop(heap)
        j = ahead[i]
        if version[i] != vi or j < 0 or version[j] != vj:
            continue
        ids[i], version[i], version[j] = int(new[rank]), vi + 1, -1
        ahead[i] = ahead[j]
        if ahead[i] >= 0:
            behind[ahead[i]] = i
        for a, b in ((behind[i], i), (i, ahead[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (r, a, version[a], version[b]))
    out, i = [], 0
    while 0 <= i < n:
        out.append(ids[i])
        i = ahead[i]
    return out


def merge_many(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` of many pieces at once: their ids one after another, and how many each has.

    In each round every piece merges its own pair of least rank, wherever it stands; pieces without a pair leave.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    ids = v.byte_table[np.frombuffer(b"".join(words), np.uint8)]
    of = np.repeat(np.arange(len(words)), size)
    done_ids, done_of = [], []
    none = len(v.pair_new)
    while len(ids):
        rank = np.full(len(ids), none, np.int64)
        inside = np.flatnonzero(of[:-1] == of[1:])
        key = ids[inside] << 32 | ids[inside + 1]
        at = slot_of(key)
        for probe in range(v.probes):
            found = v.slot_key[at]
            hit = found == key
            rank[inside[hit]] = v.slot_rank[at[hit]]
            more = (found >= 0) & ~hit
            if probe + 1 == v.probes or not more.any():
                break
            inside, key, at = inside[more], key[more], at[more] + 1
        first = np.flatnonzero(np.diff(of, prepend=-1))
        least = np.minimum.reduceat(rank, first)
        least = np.repeat(least, np.diff(first, append=len(of)))
        live = least < none
        if not live.all():
            done_ids.append(ids[~live])
            done_of.append(of[~live])
            ids, of, rank, least = ids[live], of[live], rank[live], least[live]
            if not len(ids):
                break
        take = rank == least
        both = take[1:] & take[:-1]
        if both.any():  # a run of one letter: of pairs that overlap every second one merges
            place = np.arange(len(take))
            begin = np.maximum.accumulate(np.where(take & ~np.concatenate([[False], take[:-1]]), place, -1))
            take &= (place - begin) % 2 == 0
        ids[take] = v.pair_new[rank[take]]
        keep = np.ones(len(ids), bool)
        keep[np.flatnonzero(take) + 1] = False
        ids, of = ids[keep], of[keep]
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    ids, of = np.concatenate(done_ids), np.concatenate(done_of)
    order = np.argsort(of, kind="stable")
    return ids[order], np.bincount(of, minlength=len(words))


# The transducer


def compile_lexicon(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of ``entries`` as flat arrays.

    Words are added in order; when the next word leaves a branch, its states are final and each is replaced by
    an equal one if there is one, so that suffixes are shared. Numbers on the arcs count the words before.
    """
    words = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    branch: list[int] = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(branch) - 1 > depth:
            child = branch.pop()
            key = (final[child], tuple(arcs[child].items()))
            arcs[branch[-1]][last[len(branch) - 1]] = register.setdefault(key, child)

    for w in words:
        same = len(os.path.commonprefix([w, last]))
        settle(same)
        for b in w[same:]:
            arcs.append({})
            final.append(False)
            arcs[branch[-1]][b] = len(arcs) - 1
            branch.append(len(arcs) - 1)
        final[branch[-1]] = True
        last = w
    settle(0)

    count: dict[int, int] = {}
    order, work = [], [(0, False)]
    while work:
        s, done = work.pop()
        if done:
            if s not in count:
                count[s] = final[s] + sum(count[t] for t in arcs[s].values())
                order.append(s)
        elif s not in count:
            work.append((s, True))
            work += [(t, False) for t in arcs[s].values()]
    number = {s: k for k, s in enumerate(reversed(order))}
    table = []
    for s in order:
        before = int(final[s])
        for b, t in sorted(arcs[s].items()):
            table.append((number[s] << 8 | b, number[t], before))
            before += count[t]
    table.sort()
    ends = np.zeros(len(order), np.int64)
    for s in order:
        ends[number[s]] = final[s]
    ids = [entries[w] for w in words]
    return {
        "keys": np.array([t[0] for t in table], np.int64),
        "to": np.array([t[1] for t in table], np.int64),
        "out": np.array([t[2] for t in table], np.int64),
        "final": ends,
        "starts": np.cumsum([0, *map(len, ids)], dtype=np.int64),
        "ids": np.array([i for x in ids for i in x], np.int64),
    }


@dataclass
class Lexicon:
    """A compiled transducer: arcs ``state << 8 | byte`` in order, where they lead and what they count, final states,
    and the id sequences by the sum along a word's path."""

    keys: np.ndarray
    to: np.ndarray
    out: np.ndarray
    final: np.ndarray
    starts: np.ndarray
    ids: np.ndarray

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each word, or none: all words walk the automaton together, a byte at a time."""
        if not len(self.keys) or not words:
            return [None] * len(words)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, place, live = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for k in range(int(size.max())):
            on = live[size[live] > k]
            key = state[on] << 8 | text[start[on] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[on[~hit]] = -1
            state[on[hit]], place[on[hit]] = self.to[at[hit]], place[on[hit]] + self.out[at[hit]]
            live = live[state[live] >= 0]
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] == 1) & (size > 0)
        return [self.ids[self.starts[p] : self.starts[p + 1]] if y else None for p, y in zip(place.tolist(), ok.tolist(), strict=True)]


@dataclass
class Encoder:
    vocabulary: Vocabulary
    lexicon: Lexicon | None = None
    literal_special: bool = False  # the special tokens' strings count as ordinary text
    memo_bytes: int = MEMO_BYTES
    words: dict[str, bytes] = field(default_factory=dict)  # a word after a space -> its ids
    pieces: dict[str, bytes] = field(default_factory=dict)
    held: int = 0

    def _remember(self, memo: dict[str, bytes], keys: list[str], values: list[bytes]) -> None:
        memo.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, values)) + 200 * len(keys)

    def _merge_lists(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of lists of pieces, merged many at a time within bounded memory."""
        out: list[bytes] = []
        at = 0
        while at < len(lists):
            upto, size = at, 0
            while upto < len(lists) and size < MERGED_BYTES:
                size += sum(map(len, lists[upto]))
                upto += 1
            part = [p.encode() for x in lists[at:upto] for p in x]
            long = [k for k, p in enumerate(part) if len(p) > LONG_PIECE]
            ids, n = merge_many([b"" if len(p) > LONG_PIECE else p for p in part], self.vocabulary)
            ends = np.concatenate([[0], np.cumsum(n)])
            raw = ids.astype("<i4").tobytes()
            found = [raw[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            for k in long:
                found[k] = np.array(merge(part[k], self.vocabulary), "<i4").tobytes()
            k = 0
            for x in lists[at:upto]:
                out.append(found[k] if len(x) == 1 else b"".join(found[k : k + len(x)]))
                k += len(x)
            at = upto
        return out

    def _learn_words(self, words: set[str]) -> None:
        """Words that follow a space: from the lexicon, or else merged."""
        new = sorted(words)
        known = self.lexicon.lookup([b" " + w.encode() for w in new]) if self.lexicon else [None] * len(new)
        seen = [(w, x.astype("<i4").tobytes()) for w, x in zip(new, known, strict=True) if x is not None]
        self._remember(self.words, [w for w, _ in seen], [x for _, x in seen])
        unseen = [w for w, x in zip(new, known, strict=True) if x is None]
        self._remember(self.words, unseen, self._merge_lists([_CUT.findall(" " + w) for w in unseen]))

    def _learn_pieces(self, pieces: list[str]) -> None:
        new = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        if new:
            self._remember(self.pieces, new, self._merge_lists([[p] for p in new]))

    def _cut(self, text: str) -> list[bytes]:
        """The ids of each piece of a text."""
        pieces = _CUT.findall(text)
        self._learn_pieces(pieces)
        return list(map(self.pieces.__getitem__, pieces))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        cells = list(map(self.words.get, rest))
        if None in cells:
            new = {w for w, c in zip(rest, cells, strict=True) if c is None}
            if any(not w or _BLANK.match(w) for w in new):  # a space before a space: the cuts depend on what follows
                return b"".join(self._cut(text))
            self._learn_words(new)
            cells = list(map(self.words.get, rest))
        return b"".join([*self._cut(head), *cells])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        runs = [(text, False)]
        for mark in () if self.literal_special else self.vocabulary.special:
            if mark in text:
                runs = [x for run, is_mark in runs for x in ([(run, True)] if is_mark else _parted(run, mark))]
        return b"".join(np.array([self.vocabulary.special[r]], "<i4").tobytes() if is_mark else self._plain(r) for r, is_mark in runs)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and where each text's end (from 0). New words are looked up together."""
        if self.held > self.memo_bytes:
            self.words.clear()
            self.pieces.clear()
            self.held = 0
        texts = [t or "" for t in texts]
        new: set[str] = set()
        for t in texts:
            new.update(set(t.split(" ")[1:]).difference(self.words))
        self._learn_words({w for w in new if w and not _BLANK.match(w)})
        self._learn_pieces([p for t in texts for p in _CUT.findall(t.split(" ", 1)[0])])
        ids = list(map(self.encode, texts))
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
        return np.frombuffer(b"".join(ids), "<i4"), ends


def _parted(run: str, mark: str) -> list[tuple[str, bool]]:
    parts = run.split(mark)
    return [(parts[0], False)] + [x for p in parts[1:] for x in ((mark, True), (p, False))]


def joined(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each list of ids the concatenation of their entries in ``table``."""
    took = table.take(pa.array(ids))
    if not len(took):
        return [b""] * (len(ends) - 1)
    _, offsets, data = took.buffers()
    at = np.frombuffer(offsets, np.int64)[ends]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(view[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = 65536, longest: int = 64) -> list[str]:
    """Up to ``most`` of the words after a space that occur most often in all of ``docs``, counted before and after the shuffle.

    The cut comes from a histogram of the counts on a fine logarithmic scale, so the driver gets a few hundred
    rows and then the words above the cut, never a list from each task. Words at the cut's own step stay out.
    """
    words = docs.select(F.explode(F.split(F.col(text_col), " ")).alias("w")).where(F.length("w").between(1, longest) & ~F.col("w").rlike(r"^\s"))
    step = F.floor(F.log2("n") * 32).alias("step")
    counts = stage(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w", step), "word-counts")
    cut, held = None, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        held += r["words"]
        if held > most:
            break
        cut = r["step"]
    words = [] if cut is None else [r["w"] for r in counts.where(F.col("step") >= cut).select("w").collect()]
    drop_stage(counts)
    return words


VOCABULARY = ("byte_table", "slot_key", "slot_rank", "pair_new", "token_bytes", "token_ends", "special_ids")


def publish_encoder(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = 65536) -> str:
    """Put the vocabulary and the lexicon of ``docs`` (``most`` words at most, 0: none) into one file that every
    executor gets; the name for :func:`encoder_of`."""
    small_batches(docs.sparkSession)
    vocabulary = load_vocabulary(tokenizer)
    arrays = {k: getattr(vocabulary, k) for k in VOCABULARY}
    if most:
        helper = Encoder(vocabulary)
        words = frequent_words(docs, text_col, most)
        ids = helper._merge_lists([_CUT.findall(" " + w) for w in words])
        arrays |= compile_lexicon({(" " + w).encode(): np.frombuffer(x, "<i4").tolist() for w, x in zip(words, ids, strict=True)})
    return publish(docs.sparkSession, "lexicon", arrays)


def encoder_of(name: str, literal_special: bool = False) -> Encoder:
    """A worker's encoder for a published file: its tasks share the mapped file and what they have learned."""

    def make() -> Encoder:
        x = published(name)
        return Encoder(Vocabulary(*(x.pop(k) for k in VOCABULARY)), Lexicon(**x) if x else None, literal_special)

    return kept(f"encoder-{literal_special}", name, make)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65536, literal_special: bool = False) -> DataFrame:
    """One row per input row: ``doc_id`` and ``ids``, the ids of the whole text (null and empty: none).

    ``tokenizer`` is the path of a byte-level BPE vocabulary file on the driver. Strings of special tokens give
    their ids unless ``literal_special``. Rows without an id or with a repeated one are encoded like any other;
    columns besides the two are not read. An empty table gives no rows.
    """
    name = publish_encoder(docs, tokenizer, text_col, lexicon_words)

    def run(batches):
        encoder = encoder_of(name, literal_special)
        for b in batches:
            for at, texts in slices(b.column(1)):
                ids, ends = encoder.encode_all(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with ``text_col``, the text of ``ids_col``: special tokens stay, ids beyond the vocabulary and
    null ids give nothing, a null list gives null, and bytes that aren't UTF-8 become U+FFFD."""
    name = publish_encoder(encoded, tokenizer, most=0)

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        table = encoder_of(name).vocabulary.tokens
        out = []
        for at in range(0, len(lists), 256):
            part = lists.slice(at, 256)
            size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ok = (ids >= 0) & (ids < len(table))
            before = np.concatenate([[0], np.cumsum(ok)])[np.concatenate([[0], np.cumsum(size)])]
            out += [x.decode("utf-8", "replace") for x in joined(table, ids[ok], before)]
        valid = lists.is_valid().to_pylist()
        return pa.array([t if v else None for t, v in zip(out, valid, strict=True)], pa.string())

    return encoded.select("*", text(F.col(ids_col)).alias(text_col))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65536) -> DataFrame:
    """``encode`` and ``decode`` in one worker, of which only digests leave it, one row per input row: ``doc_id``,
    ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` (of the decoded text).

    The same rules as for :func:`encode` hold; a null text counts as empty.
    """
    name = publish_encoder(docs, tokenizer, text_col, lexicon_words)

    def run(batches):
        encoder = encoder_of(name)
        v = encoder.vocabulary
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for at, texts in slices(b.column(1)):
                ids, ends = encoder.encode_all(texts)
                numbers = [sha(x[1:]) for x in joined(v.decimals, ids, ends)]
                decoded = [sha(x.decode("utf-8", "replace").encode()) for x in joined(v.tokens, ids, ends)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(np.diff(ends)), pa.array(numbers, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
