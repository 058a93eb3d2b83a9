"""Tokens, packing, shards, statistics and classifiers against brute force or held-out rows."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, language_id, license_scan, licenses, packing, perplexity, sharding, toxicity
from corpusloom.llm.queries import QUERIES
from corpusloom.llm.shared import span_hash_pairs, text_buffers

SCHEMA = "doc_id long, text string, lang string, unit string, at string, part string"
TEXTS = ["Hello world, it's 12 o'clock.", None, "", "  \n\n x\t", "éß漢字 ½ 😀", "a" * 3000, "don't DON'T we'll 'tis", "Hello world, it's 12 o'clock.", "<|endoftext|>"]
TEXTS += ["".join("ab"[(i.bit_count() + k) & 1] for i in range(1024)) for k in (0, 1)]


def frame(spark, texts, langs=None):
    rows = [(i if i != 2 else None, t, langs[i] if langs else None, "u", "a", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA)


RANKS = bpe.load_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'sterl \n\té1²½.,!漢😀", max_size=40), max_size=6))
def test_pretokens(texts):
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    starts, ends, counts = bpe._cut(raw, offsets)
    assert [raw.tobytes()[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]
    assert counts.sum() == len(starts)


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    expected = sorted((library.encode_ordinary(t or "") for t in [*TEXTS, TEXTS[0]]))
    encoded = bpe.encode(frame(spark, TEXTS), path)
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in encoded.collect()) == expected
    assert sorted(bytes(r["bytes"]) for r in bpe.decode(encoded, path).collect()) == sorted((t or "").encode() for t in [*TEXTS, TEXTS[0]])
    digests = bpe.encode(frame(spark, TEXTS), path, digests=True).filter("doc_id = 4").first()
    assert digests["decoded_sha256"] == hashlib.sha256(TEXTS[4].encode()).hexdigest()
    assert bpe.encode(frame(spark, TEXTS).limit(0), path).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcé ", min_size=1, max_size=30), min_size=1, max_size=20))
def test_merge_replay(words):
    replay = bpe.MergeReplay({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"aa": 259, b"aab": 260, " a".encode(): 261, "é".encode(): 262, b"ca": 300, b"abca": 299})
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=replay.ranks, special_tokens={})
    ids, counts = replay([w.encode() for w in words])
    assert ids.tolist() == [i for w in words for i in library.encode_ordinary(w)]
    assert counts.tolist() == [len(library.encode_ordinary(w)) for w in words]


def alternating(n):
    """Two words whose letters alternate by the parity of the place's bits: hashes with a linear structure take them for one."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_hashes_of_alternating_words():
    for n in (2, 8, 16, 64, 128, 256, 1024, 4096):
        raw = np.frombuffer("".join(alternating(n)).encode(), np.uint8)
        a, b = span_hash_pairs(raw, np.array([0, n]), np.array([n, 2 * n]))
        assert a[0] != a[1] and b[0] != b[1]


def test_words_that_share_a_hash(monkeypatch):
    """Clashing words are told apart by the second hash, and the table starts anew with another seed."""
    real = bpe.span_hash_pairs

    def clashing(raw, starts, ends, seed=0):
        a, b = real(raw, starts, ends, seed)
        return (a if seed > 1 else a & np.uint64(1)), b

    monkeypatch.setattr(bpe, "span_hash_pairs", clashing)
    table = bpe.WordTable(bpe.MergeReplay(RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = ["one two three four five six seven", "eight nine", ""]
    (_, ids, ends), *_ = bpe.encode_window([pa.array(texts)], table)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [library.encode_ordinary(t) for t in texts] and table.seed == 2


@pytest.mark.parametrize("word", ["a" * 1_000_000, "ab" * 50_000, "banana ing the" * 5_000, "".join(random.Random(3).choice("abnei") for _ in range(100_000))])
def test_long_words(word):
    """Time grows with length, not with its square."""
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=RANKS, special_tokens={})
    began = time.monotonic()
    ids, counts = bpe.MergeReplay(RANKS)([word.encode()])
    assert time.monotonic() - began < 30
    assert ids.tolist() == library._core_bpe.encode_single_piece(word.encode()) and counts.tolist() == [len(ids)]


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    rows = packing.pack(frame(spark, TEXTS), path, length=16).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        pieces.sort(key=lambda r: r["offset"])
        ends = [r["offset"] + r["length"] for r in pieces]
        assert [r["offset"] for r in pieces] == [0, *ends[:-1]] and (ends[-1] == 16 or s == len(by) - 1)
    texts = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        texts[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    whole = sorted(len(ids(t)) for t in [*TEXTS, TEXTS[0]])
    assert sum(r["length"] for r in rows) == sum(whole)
    long = b"".join(x for _, x in sorted(texts[5, len(ids(TEXTS[5]))]))
    assert np.frombuffer(long, "<u4").tolist() == ids(TEXTS[5])
    digests = packing.pack(frame(spark, TEXTS), path, digests=True).filter("doc_id = 4").first()
    assert digests["ids_crc32"] == zlib.crc32(np.array(ids(TEXTS[4]), "<u4").tobytes())
    assert packing.pack(frame(spark, TEXTS).limit(0), path).count() == 0


def test_one_tokenizer_encodes_words_and_whole_texts():
    """In turn, as a task does; strings of added tokens are tokens in whole texts alone."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    assert packing._tokenizer(definition) is packing._tokenizer(definition)
    words, whole = packing.library_encoder(definition), packing.added_encoder(definition)
    string = next(iter(packing._tokenizer(definition).get_added_tokens_decoder().values())).content
    texts = pa.array([f"a {string} b", "a b"])
    for _ in range(2):
        ids, counts = words([string.encode(), b"a"])
        found = whole(texts)
        assert counts.tolist()[0] > 1 and counts.sum() == len(ids)
        assert list(found) == [0] and len(found[0]) < counts[0] + 4


def test_packing_of_added_tokens(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two", "a <|endoftext|> b", None, "<|endoftext|><|endoftext|> é漢", "<|endoftext", "x" * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["ids_crc32"] for r in QUERIES["op10_packing"](spark, str(tmp_path)).collect()}
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert got == {i: zlib.crc32(np.array(ids(t), "<u4").tobytes()) for i, t in enumerate(texts)} and ids(texts[1]).count(50256) == 1


def brute_capacity(sizes, shards):
    best = [[0 if j == 0 and i == 0 else float("inf") for j in range(shards + 1)] for i in range(len(sizes) + 1)]
    best[0] = [0] * (shards + 1)
    for i in range(1, len(sizes) + 1):
        for j in range(1, shards + 1):
            best[i][j] = min(max(best[k][j - 1], sum(sizes[k:i])) for k in range(i))
    return best[-1][shards]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    assert sharding.smallest_capacity(sizes, shards) == brute_capacity(sizes, shards)
    assert max(sharding.cut(sizes, shards)) < shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 5))
def test_cut_is_even_within_the_capacity(sizes, shards):
    capacity, n = sharding.smallest_capacity(sizes, shards), len(sizes)
    sums = lambda bounds: [sum(sizes[a:b]) for a, b in zip((0, *bounds), (*bounds, n), strict=True)]
    every = [sums(c) for c in itertools.combinations(range(1, n), min(shards, n) - 1)]
    least = min(sum(x * x for x in s) for s in every if max(s) <= capacity)
    got = sharding.cut(sizes, shards)
    assert got == sorted(got) and set(got) == set(range(min(shards, n)))
    found = [sum(x for x, k in zip(sizes, got, strict=True) if k == shard) for shard in sorted(set(got))]
    assert max(found) <= capacity and sum(x * x for x in found) == least


def test_a_hot_unit_leaves_the_other_shards_even():
    sizes = [100 + i % 7 for i in range(2000)]
    for hot in (sum(sizes) // 2, sum(sizes) // 29):  # a third of the bytes, and one in thirty
        got = sharding.cut([*sizes[:700], hot, *sizes[700:]], 40)
        totals = collections.Counter()
        for size, shard in zip([*sizes[:700], hot, *sizes[700:]], got, strict=True):
            totals[shard] += size
        rest = sorted(totals.values())[:-1]
        assert len(totals) == 40 and max(totals.values()) == hot and rest[-1] < 1.1 * rest[0]


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rng = random.Random(1)
    texts = [None, "", *("t" * rng.randint(0, 200) + str(i) for i in range(300)), *["copy"] * 60]
    rows = sharding.assign(frame(spark, texts), 7).collect()
    assert len(rows) == len(texts) + 1
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    for some in shards.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
    sizes = [sum(r["size"] for r in s) for s in shards.values()]
    assert max(sizes) <= sum(sizes) / 7 + 60 * 20 + 500 and set(shards) <= set(range(7))
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"copy")}) == 1
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {16}
    assert sharding.assign(frame(spark, texts).limit(0), 7).count() == 0


def test_cuts_fall_between_texts(spark, monkeypatch):
    """With few coarse units, the units beside the cuts are taken apart, and the capacity is about that of single texts."""
    monkeypatch.setattr(sharding, "UNIT_BITS", 5)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "t" * rng.randint(0, 90) + str(i)) for i in range(900)], "doc_id long, text string")
    rows = sharding.assign(docs, 6).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert sorted(sizes) == list(range(6)) and max(sizes.values()) <= 1.02 * sum(sizes.values()) / 6
    for shard in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_base_statistics(spark):
    texts = [*TEXTS, "a b c a b c d\nx\nx\n\n \nx\n", "# $ %\n# $ %", "one two three " * 30]
    column = pa.array([t or "" for t in texts])
    got = perplexity.base_statistics(*text_buffers(column))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert [int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)], t


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, perplexity._KEYS, 400) & 0x318C63)
    model = perplexity.Model(grams, rng.integers(1, 6, len(grams)))
    contexts = np.unique(grams >> perplexity.SYMBOL_BITS)[:20]
    every = (contexts[:, None] << perplexity.SYMBOL_BITS) | np.arange(32)
    assert np.exp(model.log_chances(every.reshape(-1))).reshape(-1, 32).sum(1) == pytest.approx(np.ones(len(contexts)))


def naive_kneser_ney(counts):
    """The chance of a gram's last symbol after the others, from dictionaries; counts: 4-grams as tuples."""
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    cuts = {}
    for n, level in levels.items():
        n1, n2, n3, n4 = (sum(c == k for c in level.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
        cuts[n] = [min(max(v, 0.05), 0.95 * (k + 1)) for k, v in enumerate(d)]

    def chance(gram):
        n = len(gram)
        if not n:
            return 1 / (1 << perplexity.SYMBOL_BITS)
        follow = [c for g, c in levels[n].items() if g[:-1] == gram[:-1]]
        if not follow:
            return chance(gram[1:])
        own, cut = levels[n].get(gram, 0), cuts[n]
        left = cut[0] * sum(c == 1 for c in follow) + cut[1] * sum(c == 2 for c in follow) + cut[2] * sum(c > 2 for c in follow)
        return ((own - cut[min(own, 3) - 1] if own else 0) + left * chance(gram[1:])) / sum(follow)

    return chance


def test_kneser_ney_against_a_naive_one():
    rng = random.Random(3)
    text = [rng.choice((0, 0, 0, 1, 1, 2, 3, 4)) for _ in range(900)]
    counts = collections.Counter(tuple(text[k : k + 4]) for k in range(len(text) - 3))
    key = lambda g: sum(s << (perplexity.SYMBOL_BITS * k) for k, s in enumerate(reversed(g)))
    grams = sorted(counts, key=key)
    model = perplexity.Model(np.array([key(g) for g in grams]), np.array([counts[g] for g in grams]))
    chance = naive_kneser_ney(counts)
    asked = [*grams[:60], *(tuple(rng.randint(0, 5) for _ in range(4)) for _ in range(60))]
    assert model.log_chances(np.array([key(g) for g in asked])) == pytest.approx([np.log(chance(g)) for g in asked])


def test_perplexity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(("ba", "ne", "ti", "ro")) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    clean = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(40)]
    junk = ["".join(rng.choice("qxzjvk#%&wyf ") for _ in range(500)).replace(" ", " q ") for _ in range(2)]
    texts = [*clean[:2], clean[2], *clean[3:], *junk, None, "too short", "same words " * 80]
    langs = [*["xx"] * (len(clean) + 2), None, "xx", "xx"]
    rows = spark.createDataFrame([(i, t, v, "m") for i, (t, v) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, middle string")
    got = {r["doc_id"]: r for r in perplexity.judge(rows).collect()}
    assert all(got[i]["kept"] and not got[i]["base_failed"] for i in range(40))
    assert not any(got[i]["kept"] for i in range(40, 45)) and [got[i]["base_failed"] for i in range(40, 45)] == [False, False, True, True, True]
    assert perplexity.judge(rows.limit(0)).count() == 0


def test_perplexity_tells_common_junk(spark):
    """Signs behind words, or between them, in a tenth of the texts each: common enough for the model to know them."""
    rng = random.Random(11)
    words = ["".join(rng.choice(("ba", "ne", "ti", "ro", "su")) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    texts = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(200)]
    marked = [" ".join(w + rng.choice(("###", "&&&", "$$$")) if rng.random() < 0.6 else w for w in t) for t in texts[:20]]
    barred = [" | ".join(t) for t in texts[20:40]]
    rows = [*marked, *barred, *(" ".join(t) for t in texts[40:]), "% " * 80]
    got = {r["doc_id"]: r["kept"] for r in perplexity.judge(spark.createDataFrame([(i, t, "xx") for i, t in enumerate(rows)], "doc_id long, text string, lang string")).collect()}
    assert not any(got[i] for i in range(40)) and all(got[i] for i in range(40, 200)) and not got[200]


def test_perplexity_on_labelled_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = perplexity.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("not base_failed")
    rows = judged.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("rejected"))
    rejected = {r["quality"]: r["rejected"] for r in rows.filter("quality is not null").collect()}
    assert rejected[0] >= 0.8 and rejected[1] <= 0.02


def test_perplexity_bands_follow_the_spread(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice(("ba", "ne", "ti", "ro")) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(60)]
    odd = list(texts[0])
    for at in rng.sample(range(len(odd)), len(odd) // 80):  # one letter in eighty
        odd[at] = rng.choice("bnrtaeio")
    rows = [*texts, "".join(odd), *[texts[1]] * 200]  # copies outnumber the rest
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity.judge(docs).collect()}
    assert not got[60]["kept"] and not got[60]["base_failed"]
    assert all(got[i]["kept"] for i in got if i != 60)


def test_chances_are_those_of_one_model(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abbcccdé жЖ漢") for _ in range(3000))
    keys, _ = perplexity.unit_keys(*text_buffers(pa.array([text])))
    units = sorted({int(k) >> s & 0xFFFF for k in keys for s in (0, 16, 32, 48)})
    small = np.zeros(len(keys), np.int64)
    for k in range(perplexity.ORDER):
        small |= np.searchsorted(units, keys >> (16 * k) & 0xFFFF) << (perplexity.SYMBOL_BITS * k)
    grams, at, counts = np.unique(small, return_index=True, return_counts=True)
    wanted = dict(zip(keys[at].tolist(), perplexity.Model(grams, counts, 1 << 16).log_chances(grams).tolist(), strict=True))
    half = len(keys) // 2  # as two blocks
    parts = [("=xx", int(k), 1) for k in keys[:half]] + [("=xx", int(k), 1) for k in keys[half:]] + [("", int(keys[0]), 5)]
    got = {r["gram"]: np.log(r["chance"]) for r in perplexity.chances(spark.createDataFrame(parts, "k string, gram long, n long")).filter("k = '=xx'").collect()}
    assert got == pytest.approx(wanted)


def test_perplexity_reads_every_script(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 20000)
    rng = random.Random(5)
    texts, langs = [], []
    for lang, letters in (("ru", "абвгдежзиклмнопрст"), ("zz", "אבגדהוזחטיכלמנסעפצ")):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40)]
        clean = [[rng.choice(words) for _ in range(150)] for _ in range(40)]
        mixed = ["".join(rng.choice(letters) for _ in w) for w in clean[0]]  # the same lengths of words
        texts += [*map(" ".join, clean), " ".join(mixed)]
        langs += [lang] * 41
    docs = spark.createDataFrame([(i, *v) for i, v in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity.judge(docs).collect()}
    assert len(got) == 82 and {i for i in got if not got[i]["kept"]} == {40, 81}


def test_licenses(spark):
    mit, warranty = (license_text(t) for t in licenses.TEXTS["mit"])
    cases = [
        ("The MIT License, and the Apache-License; GNU General Public License. MIT LICENSE", "apache,gpl,mit", 0.75),
        (None, "", 0.0), ("", "", 0.0), ("permit license general public", "", 0.0),
        ("x " + mit.replace(" ", ",\n").upper() + " y", "mit", 1.0), (mit.replace("charge", "cost"), "", 0.0), (warranty, "mit", 1.0),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0.75), ("Licensed under a CC BY 4.0", "cc-by", 0.75), ("mit  licensed", "", 0.0),
        ("Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc", 0.75), ("Creative Commons Attribution 4.0 International License", "cc-by", 0.75),
        ("a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License", "cc-by-nc-sa", 0.75), ("CC BY-NC-ND 4.0", "cc-by-nc-nd", 0.75),
        ("GNU Affero General Public License", "agpl,gpl", 0.75), ("under the GNU Lesser General Public License, version 3", "gpl,lgpl", 0.75), ("a General Public License", "gpl", 0.5),
        ("Copyright 2020 Some One. All rights reserved.", "all-rights-reserved", 0.75), (license_text(licenses.TEXTS["unlicense"][0]), "unlicense", 1.0),
        (license_text(licenses.TEXTS["bsd-3-clause"][0]), "bsd,bsd-3-clause", 1.0), (license_text(licenses.TEXTS["bsd-2-clause"][0]), "bsd,bsd-2-clause", 1.0),
        (license_text(licenses.TEXTS["zlib"][0]), "zlib", 1.0), ("filler words " * 20_000 + "This is free and unencumbered software released into the public domain.", "unlicense", 1.0),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl,gpl", 1.0),
    ]
    rows = [(i, t, "x", 1.0) for i, (t, _, _) in enumerate(cases)]
    frame = spark.createDataFrame([*rows, (None, "The MIT License", "y", 2.0), rows[0]], "doc_id long, text string, labels string, score double")
    listed = license_scan.scan(frame).collect()
    assert len(listed) == len(cases) + 2 and [r["labels"] for r in listed if r["doc_id"] is None] == ["mit"]
    got = {r["doc_id"]: r for r in listed}
    first = got[0]
    assert (first["n_words"], first["n_base"], first["first_word"], first["last_word"], first["base_labels"]) == (13, 4, 1, 11, "apache,gpl,mit")
    assert [(got[i]["labels"], got[i]["score"]) for i in range(len(cases))] == [c[1:] for c in cases]
    assert license_scan.scan(frame.limit(0)).count() == 0


def license_text(template, rng=None):
    """A text that the template accepts; its regions are kept, or settled by rng."""
    def sequence(i):
        out = []
        while i < len(tokens) and tokens[i] not in ("]]", "))", "|"):
            if tokens[i] == "[[":
                inner, i = sequence(i + 1)
                out += inner if rng is None or rng.random() < 0.5 else []
            elif tokens[i] == "((":
                parts = []
                while tokens[i] != "))":
                    inner, i = sequence(i + 1)
                    parts.append(inner)
                out += parts[0] if rng is None else rng.choice(parts)
            elif tokens[i].startswith("<<"):
                out += ["any"] * (2 if rng is None else rng.randint(0, int(tokens[i][2:-2])))
            else:
                out.append(tokens[i])
            i += 1
        return out, i

    tokens = license_scan._tokens(template)
    return " ".join(sequence(0)[0])


def license_rule(template):
    """The template as a regular expression over words with a space behind each."""
    marks = {"[[": "(?:", "]]": ")?", "((": "(?:", "))": ")", "|": "|"}
    return re.compile("(?:^|(?<= ))(?:" + "".join(marks.get(t) or (rf"(?:\S+ ){{0,{t[2:-2]}}}" if t.startswith("<<") else f"{t} ") for t in license_scan._tokens(template)) + ")")


def test_templates_against_regular_expressions():
    rng = random.Random(8)
    every = [t for kind in (licenses.TEXTS, licenses.NOTICES) for texts in kind.values() for t in texts]
    rules = [(license_scan.Automaton(t), license_rule(t)) for t in every]
    seen = collections.Counter()
    for template in every:
        for _ in range(6):
            words = license_text(template, rng).split()
            for _ in range(rng.choice((0, 0, 1, 2))):
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 1)] = [rng.choice(("the", "license", "any", "gnu", "version"))]
            words = ["so", *words, "end"]
            for automaton, rule in rules:
                found = any(automaton.accepts(words[k:]) for k in range(len(words)))
                assert found == bool(rule.search(" ".join(words) + " ")), (template, words)
                seen[found] += 1
    assert seen[True] > 200 and seen[False] > 5000


def test_automaton():
    a = license_scan.Automaton("a [[b c]] <<2>> d")
    accepts = lambda text: a.accepts(list(text))
    assert [accepts(t) for t in ("ad", "abcd", "axd", "axxd", "abcxxd", "axxxd", "abd", "adx", "a", "abcxd")] == [True, True, True, True, True, False, True, True, False, True]


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    texts, marks = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(("zorkwit", "quxhead"))
        texts.append(" ".join(w))
        marks.append(int(toxic))
    docs = spark.createDataFrame([*((i, t, 0) for i, t in enumerate(texts)), (900, None, 0), (901, "", 1), (None, "zorkwit", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([*((i, m) for i, m in enumerate(marks)), (900, 0), (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    tested = [i for i in range(400) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == marks[i] for i in tested]) > 0.97
    assert got[900]["predicted"] == 0 and 0 <= got[901]["score"] <= 1 and got[None]["predicted"] == 1
    model = toxicity.train(docs, labels)
    assert {r["doc_id"] for r in toxicity.accept(docs, model).collect()} == {r["doc_id"] for r in rows if r["predicted"] == 0}
    assert toxicity.classify(docs, labels.limit(0)).filter("predicted = 1").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB c1.\né漢", max_size=60), max_size=6), st.integers(0, 5))
def test_scores_follow_the_features(texts, seed):
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=1 << toxicity.FEATURE_BITS) * (rng.random(1 << toxicity.FEATURE_BITS) < 0.5)
    model = toxicity.Model(weights, -0.3)
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    expected = [1 / (1 + np.exp(0.3 - model.weights[c].sum(dtype=np.float64))) for c in toxicity.features(raw, offsets)]
    assert model.scores_of(pa.array(texts, pa.string())) == pytest.approx(expected)


def test_forward_backward():
    rng = np.random.default_rng(0)
    scores, move, lengths = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([3, 1, 3])
    both, logs, pairs = language_id.marginals(scores, lengths, move, pairs=True)
    total, at = 0.0, 0
    wanted, steps = np.zeros((7, 3)), np.zeros((3, 3))
    for n in lengths.tolist():
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        value = np.array([sum(scores[at + t, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        p = np.exp(value - value.max())
        total += np.log(p.sum()) + value.max()
        p /= p.sum()
        for weight, path in zip(p, paths, strict=True):
            for t in range(n):
                wanted[at + t, path[t]] += weight
                if t + 1 < n:
                    steps[path[t], path[t + 1]] += weight
        at += n
    assert both == pytest.approx(wanted) and logs == pytest.approx(total) and pairs == pytest.approx(steps)


def test_emissions():
    """Scores of words, made together and kept, against features made one character at a time."""
    rng = np.random.default_rng(1)
    words = ["the", "é", "привет", "漢字漢", "a", "the", "naïve", "x" * 40]
    size = 1 << language_id.FEATURE_BITS
    lexicon = np.sort(np.array([h(w) for w in ("the", "привет")], np.uint64)) if (h := lambda w: int(language_id.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])) else None
    field = language_id.Field(["u", "v"], lexicon, rng.normal(size=(size + 3, 2)), np.zeros((2, 2)))
    field.weights[-1] = 0
    mixed = lambda kind, part: int(language_id.mix(np.array([h(part) + kind], np.uint64))[0]) >> (64 - language_id.FEATURE_BITS)
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = language_id.spans_of(language_id._BREAKS, raw, np.array([0, len(raw)]))
    known = language_id.KnownWords(field)
    for _ in range(2):
        got = known.emissions(raw, starts, ends)
        for word, scores in zip(words, got, strict=True):
            expected = field.weights[size + np.searchsorted(lexicon, h(word))].copy() if word in ("the", "привет") else np.zeros(2)
            for k in (1, 2, 3):
                if len(word) >= k:
                    expected += field.weights[mixed(k, word[:k])] + field.weights[mixed(16 + k, word[-k:])]
            for k in (2, 3):
                for i in range(len(word) - k + 1):
                    expected += field.weights[mixed(32 + k, word[i : i + k])]
            assert scores == pytest.approx(expected)


def test_every_language_is_learned(spark):
    """More languages than a fixed number, one of long texts only, one with most rows, an empty table, and a very long line."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouyäöé") for _ in range(2)) for _ in range(400)]
    words = {f"l{k:02}": stems[5 * k : 5 * k + 5] for k in range(70)} | {"ru": ["привет", "слово", "дом"], "big": ["zzq", "qqz"]}
    text = lambda v, n: " ".join(rng.choice(words[v]) for _ in range(n))
    rows = [(v, text(v, 30)) for v in words for _ in range(4)] + [("long", "xoxo xexe " * 3000)] * 3 + [("big", text("big", 20)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, v) for i, (v, t) in enumerate(rows, 3)], "doc_id long, text string, lang string")
    some = language_id.sample(docs, 3)
    counts = collections.Counter(v for v, _ in some)
    assert {v for v, _ in some} >= set(words) - {v for v in words if v.startswith("l")} and len(counts) > 66 and max(counts.values()) == 3
    assert all(len(t) <= language_id.SAMPLE_CHARS for _, t in some)
    probe = spark.createDataFrame([(1, text("ru", 9), None), (2, "big zzq qqz " * 20_000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.label(probe, language_id.fit(some)).collect()}
    assert got == {1: "ru", 2: "big"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"aa": ("the", "ing", "wo", "sh"), "bb": ("que", "ou", "le", "é"), "cc": ("sch", "ung", "ei", "ö")}
    word = lambda v: "".join(rng.choice(parts[v]) for _ in range(rng.randint(1, 3)))
    rows = [(i, "\n".join(" ".join(word(v) for _ in range(12)) for _ in range(4)), v) for i in range(150) for v in [("aa", "bb", "cc")[i % 3]]]
    mixed = " ".join([word("aa") for _ in range(15)] + [word("bb") for _ in range(12)])
    more = [(1000, None, "aa"), (1001, "12 34 …", "aa"), (1002, "", None), (1003, mixed, None), (None, rows[0][1], "aa")]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string")
    field = language_id.fit(language_id.sample(docs))
    got = {r["doc_id"]: r for r in language_id.label(docs, field, words=True).collect()}
    tested = [(i, v) for i, _, v in rows if got[i]["held_out"]]
    assert len(tested) > 15 and np.mean([got[i]["lang_pred"] == v for i, v in tested]) > 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1001]["score"] == 0
    assert got[1003]["lang_pred"] == "aa" and got[1003]["n_switches"] >= 1 and np.mean([a == b for a, b in zip(got[1003]["word_langs"], ["aa"] * 15 + ["bb"] * 12, strict=True)]) > 0.8
    assert {r["lang_pred"] for r in language_id.identify(docs.filter("doc_id is null")).collect()} == {"und"}
