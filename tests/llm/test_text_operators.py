"""The operators on texts against plain versions of what they promise."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import TOKENIZER
from pyspark.sql import functions as F

from feederflow.llm import bpe, langid, mixing, perplexity, secrets, simhash, tokens


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_groups(docs, no_docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{f:016x}") for i, f in fps)
    group = {f: f for _, f in fps}
    for _ in range(len(group)):
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    lowest = {}
    for i, f in fps:
        if i is not None:
            lowest[group[f]] = min(i, lowest.get(group[f], i))
    want = {(i, lowest.get(group[f])) for i, f in fps}
    assert {(r["doc_id"], r["component_id"]) for r in got} == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_trees_lose_no_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    x = np.unique(np.concatenate([x, *(x[:100] ^ np.uint64(1 << 3 | 1 << b) for b in (9, 30, 61))]))
    want = {(a, b) for k, a in enumerate(x.tolist()) for b in x[k + 1 :].tolist() if (a ^ b).bit_count() <= 4}
    found = set()
    for mask in simhash.band_masks(3):
        rows, shard, owned = simhash.route(simhash.plant(x, mask, 16, rng), mask, 1, x)
        assert sorted(rows[owned]) == list(range(len(x)))
        for s in np.unique(shard):
            own, guests = x[rows[(shard == s) & owned]].tolist(), x[rows[(shard == s) & ~owned]].tolist()
            found |= {(min(a, b), max(a, b)) for a in own for b in own + guests if a != b and (a ^ b).bit_count() <= 4}
    assert found == want


def test_large_shards_lose_no_pair():
    """A shard compared whole and by groups of bits gives the same groups, guests included."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    bits = np.uint64(1) << rng.integers(0, 63, (300, 4)).astype(np.uint64)
    x = np.unique(np.concatenate([x, x ^ bits[:, 0] ^ bits[:, 1], x[:150] ^ bits[:150, 2] ^ bits[:150, 3], x[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    rng.shuffle(x)
    owned, guests = np.sort(x[:500]), np.sort(x[500:])
    whole, parts = simhash.stars(owned, guests, 4, wide=10**9), simhash.stars(owned, guests, 4, tile=64, wide=10)
    assert len(whole[0]) > 200
    assert sorted(zip(*map(np.ndarray.tolist, whole), strict=True)) == sorted(zip(*map(np.ndarray.tolist, parts), strict=True))


def plain_spans(text):
    rules = [
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


SECRETS = ["ü PassWord = 'abc123' and AKIA" + "Q" * 16, "deadbeef" * 3 + " token:short", "api_key: " + "0a" * 14 + " secret=abcdef", None, "", "Kelvin toKen=abcdefg", "none", "none", "AKIAshort " + "f" * 23, "-----BEGIN RSA PRIVATE KEY-----"]


def test_secrets_and_ledger(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secrets.findings(df).collect()}
    assert len(got) == len(SECRETS)
    for k, t in enumerate(SECRETS):
        spans = plain_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[k]["n_assign"] == sum(s.startswith("assign") for s in spans)
        assert set(spans) <= set(got[k]["spans"].split(","))
    assert got[9]["spans"].startswith("pem:")
    ledger = f"file://{tmp_path}/ledger"
    secrets.findings(df.where("doc_id < 4"), ledger=ledger).count()
    assert spark.read.parquet(ledger).count() == 4
    again = secrets.findings(df, ledger=ledger)
    assert {r["doc_id"]: r["spans"] for r in again.collect()} == {k: r["spans"] for k, r in got.items()}
    assert spark.read.parquet(ledger).count() == len({t or "" for t in SECRETS})  # each text once, null as empty
    assert secrets.findings(df.limit(0)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[0] == "ü [secret]' and [secret]" and clean[3] is None and clean[6] == "none"


def test_ledger_scans_only_unseen_pairs(spark, tmp_path, monkeypatch):
    """Two runs over a kept ledger: new documents, then a rule of a new version; a fresh ledger finds the same."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS)] + [(None, SECRETS[0]), (0, SECRETS[1])], "doc_id bigint, text string")
    path = f"file://{tmp_path}/ledger"
    secrets.findings(df, ledger=path).count()
    blobs = len({t or "" for t in SECRETS})
    assert spark.read.parquet(path).count() == blobs
    secrets.findings(df, ledger=path).count()
    assert spark.read.parquet(path).count() == blobs  # nothing unseen, nothing scanned
    bumped = secrets.RULES | {"assign": (2, secrets.RULES["hex"][1], 0, 24)}
    got = secrets.findings(df, ledger=path, rules=bumped).collect()
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 * blobs and sum(r["rules"] == ["assign@2"] for r in rows) == blobs
    fresh = secrets.findings(df, rules=bumped).collect()
    assert sorted(map(str, got)) == sorted(map(str, fresh))
    assert all(r["n_assign"] == r["n_hex"] for r in got)  # what version 1 found does not count
    fewer = {k: r for k, r in secrets.RULES.items() if k != "hex"}
    assert all(r["n_hex"] == 0 for r in secrets.findings(df, ledger=path, rules=fewer).collect())
    assert Counter(r["doc_id"] for r in got) == Counter([*range(len(SECRETS)), None, 0])


def test_language(docs, no_docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (102, 103, 104):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got) and by[106]["lang_pred"] in ("de", "en")
    assert langid.identify(no_docs).count() == 0


def test_language_backs_off_to_grams(spark):
    de, en = "der die das und nicht einander straße", "the and with they which house mouse"
    df = spark.createDataFrame([(k, (de if k % 2 else en) * 3, "de" if k % 2 else "en") for k in range(40)], "doc_id bigint, text string, lang string")
    m = langid.learn(df)
    assert m.predict("nichtstraße undeinander")[0] == "de" and m.predict("thehouse withmouse")[0] == "en"
    assert m.predict("123 !")[0] == "und"


def plain_values(m, word):
    """The values of a word by dictionaries."""
    table = {int(k): {int(x): float(y) for x, y in zip(m.lang[a:b], m.value[a:b], strict=True)} for k, a, b in zip(m.keys, m.starts, m.starts[1:], strict=False)}
    dense = lambda one: [one.get(k, m.penalty) for k in range(len(m.langs))]
    if (k := langid.key_of(0, word)) in table:
        return dense(table[k])
    padded = f" {word} "
    for n in range(m.longest, 0, -1):
        found = [dense(table[k]) for i in range(len(padded) - n + 1) if (k := langid.key_of(n, padded[i : i + n])) in table]
        if found:
            return np.mean(found, axis=0).tolist()
    return [m.penalty] * len(m.langs)


def test_language_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    stems = {"de": "der die das und straße haus baum über weiß".split(), "en": "the house tree over and white street with".split(), "nl": "het huis boom over en wit straat met".split()}
    rows = [(k, " ".join(rng.choice(stems[lang], 12)), lang) for k in range(90) for lang in [list(stems)[k % 3]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = langid.learn(df)
    learned = Counter()
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            learned.update((lang, w) for w in langid.words_of(t))
    total = Counter()
    for (lang, _), c in learned.items():
        total[lang] += c
    for (lang, w), c in learned.items():  # the model's own values
        assert plain_values(m, w)[m.langs.index(lang)] == pytest.approx(-math.log10(c / total[lang]), rel=1e-5)
    tied = ["qqq", "house boom unhouse", "ßß der xyz", "the die", "over over", "Über-weißhaus 12"] + [" ".join(rng.choice(sum(stems.values(), []), 5)) + "zz" for _ in range(30)]
    for t in tied:
        values = np.mean([plain_values(m, w) for w in langid.words_of(t)], axis=0)
        lang, score = m.predict(t)
        assert lang == m.langs[int(values.argmin())]
        odds = np.exp(-np.log(10) * min(len(langid.words_of(t)), 10) * (values - values.min()))
        assert score == pytest.approx(1 / odds.sum(), rel=1e-4)
    same = spark.createDataFrame([(k, "one two three", "ba"[k % 2]) for k in (0, 1, 4, 7) if zlib.crc32(str(k).encode()) % 4 != 2 or k < 2], "doc_id bigint, text string, lang string")
    twins = langid.learn(same)
    if len(twins.langs) == 2:
        assert twins.predict("two four") == ("a", pytest.approx(0.5))  # equal values: the first by name


def test_every_language_and_word_is_learned(spark):
    """More languages and words than earlier bounds of 1,000 and 30,000."""
    df = spark.range(1500).selectExpr("id doc_id", "concat('w', id, 'x y', id, 'z') text", "concat('l', id) lang")
    m = langid.learn(df)
    kept = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(m.langs) == len(kept) > 1000
    words = ["".join(chr(97 + int(c)) for c in str(k)) + "q" for k in range(31_000)]
    big = spark.createDataFrame([(0, " ".join(words), "en")], "doc_id bigint, text string, lang string")
    m = langid.learn(big)
    assert (m._find([langid.key_of(0, w) for w in words]) >= 0).all()
    assert m.predict(words[-1] + " " * 10 + "x" * 200_000)[0] == "en"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, is_open, out = float(sum(sizes.values())), set(order), {}
    while True:
        level = left / sum(w[s] for s in is_open) if is_open else 0
        full = [s for s in is_open if level * w[s] > most * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in is_open}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
            is_open.discard(s)


def test_mixture(docs, no_docs, rows):
    got = mixing.mixture(docs, block=8, bucket_rows=5, shard_slots=16).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter(r["size"] for r in got) == Counter(size(r[1]) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = sorted(plain_targets(dict(sizes)).values())
    assert sorted({round(r["target"], 6) for r in got}) == sorted({round(x, 6) for x in want})
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(want)) <= len(want)
    again = mixing.mixture(docs.repartition(5), block=8, bucket_rows=5, shard_slots=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixture(no_docs).count() == 0


def test_mix_takes_each_target_to_the_word(spark):
    """Sources of all kinds of sizes about a block, in documents of 1 to 50 words."""
    sizes = [1, 3, 63, 64, 65, 128, 129, 1000, 200, 77, 0, 640]
    rows, k = [], 0
    for s, n in enumerate(sizes):
        left = n
        while left > 0 or (n == 0 and left == 0):
            take = min(left, 1 + k % 50)
            rows.append((k, "w " * take, f"s{s:02d}"))
            left, k = left - take if left else -1, k + 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in (7, 8, 9):
        got = mixing.mixture(df, seed=seed).join(df.select("doc_id", "source"), "doc_id").collect()
        taken, target = Counter(), {}
        for r in got:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        assert target == pytest.approx(plain_targets({f"s{s:02d}": n for s, n in enumerate(sizes)}))
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def plain_taken(mix_rows, slots, block):
    """Words taken of each (source, start), slot by slot."""
    out = Counter()
    for s in slots:
        for source, start, size in mix_rows:
            if source == s["source_id"] and size:
                lo, hi = s["block"] * block, s["block"] * block + (block if s["words"] is None else s["words"])
                out[source, start] += max(0, min(start + size, hi) - max(start, lo))
    return out


def test_mix_takes_what_its_slots_hold(spark, docs):
    mix = mixing.plan(docs, block=8, bucket_rows=5, bucket_run=2, shard_slots=16)
    placed = {}
    for r in mix.sized.where("size > 0").collect():  # every source's words in one stream without gaps
        placed.setdefault(r["source_id"], []).append((r["start"], r["size"]))
    for mine in placed.values():
        mine.sort()
        assert [a + n for a, n in mine[:-1]] == [a for a, _ in mine[1:]] and mine[0][0] == 0
    slots, sources = mix.slots.collect(), {r["source_id"]: r for r in mix.sources.collect()}
    assert Counter(s["source_id"] for s in slots) == {k: r["quota"] for k, r in sources.items() if r["quota"]}
    for source_id, r in sources.items():  # every slot of a source once, and in each whole pass every block once
        mine = [s for s in slots if s["source_id"] == source_id]
        assert sorted(s["j"] for s in mine) == list(range(r["quota"]))
        for p in range(r["quota"] // max(1, r["blocks"])):
            assert sorted(s["block"] for s in mine if s["j"] // r["blocks"] == p) == list(range(r["blocks"]))
    want = plain_taken([(r["source_id"], r["start"], r["size"]) for r in mix.sized.collect()], slots, 8)
    got = mixing.mixture(docs, block=8, bucket_rows=5, shard_slots=16).where("size > 0").collect()
    assert Counter(r["taken"] for r in got) == Counter(want.values())


def test_bpe_matches_the_library(docs, no_docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    got = bpe.decode(bpe.encode(docs, TOKENIZER, lexicon_words=50), TOKENIZER).collect()
    want = sorted((lib.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows)
    assert sorted((r["ids"], r["text"]) for r in got) == want
    assert bpe.encode(no_docs, TOKENIZER).count() == 0


def plain_merge(word, v):
    ids = [int(v.byte_table[b]) for b in word]
    while True:
        found = [(v.ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in v.ranks]
        if not found:
            return ids
        rank, i = min(found)
        ids[i : i + 2] = [int(v.pair_new[rank])]


def test_round_trip_digests(docs, no_docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, TOKENIZER, lexicon_words=50).collect())) == want
    assert bpe.round_trip(no_docs, TOKENIZER).count() == 0


def test_encoder_forgets_within_bounds():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    e = bpe.Encoder(bpe.load_vocabulary(TOKENIZER), memo_bytes=2000)
    for k in range(20):
        texts = [f"w{k}x{j} some  words\n\n {k * j} " + "y" * 300 for j in range(20)]
        ids, ends = e.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert e.held < 60_000


def test_bpe_pieces():
    v = bpe.load_vocabulary(TOKENIZER)
    words = [b"", b"a", b"aaaaaaa", "Straßenbahn".encode(), b" the", b"x" * 300, bytes(range(256))]
    ids, size = bpe.merge_many(words, v)
    ends = [0, *np.cumsum(size)]
    for k, w in enumerate(words):
        assert ids[ends[k] : ends[k + 1]].tolist() == bpe.merge(w, v) == plain_merge(w, v)


def test_lexicon_shares_suffixes_and_finds_all():
    entries = {w.encode(): [k, k + 1][: 1 + k % 2] for k, w in enumerate(sorted(a + b for a in ("walk", "talk", "call") for b in ("", "s", "ed", "ing")))}
    lex = bpe.Lexicon(**bpe.compile_lexicon(entries))
    assert [x.tolist() for x in lex.lookup(list(entries))] == list(entries.values())
    assert lex.lookup([b"wal", b"walke", b"", b"z"]) == [None] * 4
    assert len(lex.final) < sum(map(len, entries))  # fewer states than letters


def test_token_counts_across_blocks(docs, no_docs, rows, spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    lib.encode_special_tokens = True
    want = Counter((r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for block in (7, 64, 1 << 20):
        got = tokens.document_tokens(docs, TOKENIZER, block_tokens=block).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert tokens.document_tokens(no_docs, TOKENIZER).count() == 0


def test_wide_ids_take_four_bytes(tmp_path, spark):
    import json

    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": 70_000, "content": "<|far|>", "special": True})
    (tmp_path / "t.json").write_text(json.dumps(spec))
    assert tokens.width_of(TOKENIZER) == (50256, "<u2")
    assert tokens.width_of(str(tmp_path / "t.json")) == (50256, "<u4")
    assert tokens.width_of(TOKENIZER, 65_536) == (65_536, "<u4")
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id bigint, text string")
    assert sorted(map(tuple, tokens.document_tokens(df, TOKENIZER, 65_536).collect())) == [(1, 2), (2, 0), (3, 1)]


def units(text):
    return np.frombuffer(text.encode("utf-16-le"), "<u2").tolist()


def plain_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries."""
    top = Counter()
    for t in texts:
        s = [0xFFFF] * (order - 1) + units(t)
        top.update(tuple(s[i : i + order]) for i in range(len(units(t))))
    tables = {order: top}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts = {}
    for k, t in tables.items():
        n = [sum(c == i for c in t.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        cuts[k] = [max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 * i for i, a, b in ((1, n[0], n[1]), (2, n[1], n[2]), (3, n[2], n[3]))]

    def p(g):
        if not g:
            return 1 / 65536
        t, d = tables[len(g)], cuts[len(g)]
        after = {x: c for x, c in t.items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        gamma = sum(d[min(c, 3) - 1] for c in after.values()) / total
        c = after.get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + gamma * p(g[1:])

    return p


def plain_perplexity(p, text):
    s = [0xFFFF] * (perplexity.ORDER - 1) + units(text)
    n = len(units(text))
    return math.exp(-sum(math.log(p(tuple(s[i : i + perplexity.ORDER]))) for i in range(n)) / n)


def test_perplexity(spark, tmp_path):
    texts = ["abab abba", "abba baab ab", "aab bab", "zq zq!", None, "", "ab \U0001f600 漢字仮名交じり", "abba " * 3000, "abba 漢字仮名", "aab bab"]
    langs = ["en", "en", "en", None, "en", "de", "ja", "en", "ja", "en"]
    df = spark.createDataFrame([(k, t, lang, 1.0, 5) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))] + [(0, "abab zz", "en", 1.0, 5), (None, "abab abba", "en", 1.0, 5)], "doc_id bigint, text string, lang string, label double, block int").drop("block").withColumn("g", F.lit("x"))
    trusted = spark.createDataFrame([(0,), (1,), (2,), (6,), (99,), (None,), (4,)], "id bigint")
    p = plain_kneser_ney([texts[0], texts[1], texts[2], texts[6], "abab zz"], perplexity.ORDER)
    df.repartition(1).write.parquet(f"{tmp_path}/docs.parquet")
    for table in (df, df.repartition(4), spark.read.parquet(f"{tmp_path}/docs.parquet")):
        for block_rows in (3, 16_384):
            got = perplexity.filter_quality(table, trusted, quantile=0.5, block_rows=block_rows).collect()
            assert len(got) == len(texts) + 2
            want = [(i, t, lang) for i, t, lang in [(k, t, langs[k]) for k, t in enumerate(texts)] + [(0, "abab zz", "en"), (None, "abab abba", "en")]]
            worth = sorted(((i if i is not None else -1), plain_perplexity(p, t) if t else -1.0) for i, t, _ in want)
            seen = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["perplexity"] if r["perplexity"] is not None else -1.0) for r in got)
            assert [i for i, _ in worth] == [i for i, _ in seen]
            assert [x for _, x in seen] == pytest.approx([x for _, x in worth], rel=1e-4)
            known = {"en": sorted(plain_perplexity(p, t) for t in (texts[0], texts[1], texts[2], "abab zz")), "ja": [plain_perplexity(p, texts[6])]}
            rank = lambda x: x[math.ceil(0.5 * len(x)) - 1]
            limit = {"en": rank(known["en"]), "ja": rank(known["ja"])}
            for r in got:
                assert r["threshold"] == pytest.approx(limit.get(r["lang"], rank(sorted(known["en"] + known["ja"]))), rel=1e-4)
                assert r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"])


def test_perplexity_without_trusted_text(spark, docs, no_docs):
    none = spark.createDataFrame([], "id bigint")
    assert perplexity.filter_quality(no_docs, none).count() == 0
    got = perplexity.filter_quality(docs, none).collect()
    assert len(got) == docs.count() and all(r["perplexity"] is None and r["threshold"] is None for r in got)
    assert sum(r["kept"] for r in got) == docs.where("length(text) > 0").count()


def test_every_letter_is_modelled(spark):
    """More letters than an earlier alphabet of 254: each has its own probability."""
    text = "".join(chr(0x4E00 + k) for k in range(700)) * 3
    df = spark.createDataFrame([(1, text, "zh"), (2, text[::-1], "zh")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["perplexity"] for r in perplexity.filter_quality(df, spark.createDataFrame([(1,)], "id bigint")).collect()}
    assert got[1] < 5 < 50 < got[2]
