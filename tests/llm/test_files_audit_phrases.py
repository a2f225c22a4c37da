"""Token files, the filter audit and phrase mining against brute-force versions, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import random
import re
import struct
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import filter_audit, phrase_mining, token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# token files -----------------------------------------------------------------------------------------------------------------
def _library_ids(text):
    return np.array([*Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_units_are_encoded_as_the_library_does():
    own, library, rnd = token_files.TokenEncoder(BYTES), Tokenizer.from_file(BYTES), random.Random(2)
    signs = [*"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎      　​﻿", " ", " ", "  ", "a", "B", "1", "é", "中", "!", "'s", "'", "😀", "<|endoftext|>", "word", "́", "_", "x" * 17]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for batch in (texts[:2000], texts[2000:]):
        for text, ids in zip(batch, own.encode_all(t.encode() for t in batch), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_go_by_parts_and_the_memory_for_units_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "_KNOWN", 50)
    own, library = token_files.TokenEncoder(BYTES), Tokenizer.from_file(BYTES)
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdefé, ") for _ in range(6)) for _ in range(800)), "y" * 3000, "  x" * 900, " " * 3000]
    for text, ids in zip(texts, own.encode_all((t.encode() for t in texts), 500), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) < 5000


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000, 200_000])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = (rnd.zipf(1.3, (2, n)) % 50_000).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    table = token_files.Table.counted(found.tolist(), counts.tolist())
    assert int(table.each.sum()) == 1 << table.scale and int(table.each.min()) >= 1
    blocks = token_files.encode_blocks(ids, table)
    for own, back in zip(ids, token_files.decode_blocks(blocks, table), strict=True):
        assert (own == back).all()
    for start, end in ((0, 1), (n // 2, n), (n - 1, n + 5), (65_535, 65_537), (131_072, 131_080), (70_000, 199_999)):
        assert (token_files.decode_between(blocks[1], start, end, table) == ids[1][start:end]).all()


def test_blocks_that_were_changed_are_told():
    ids = np.arange(600, dtype=np.uint32)[None] % 7
    table = token_files.Table.counted(list(range(7)), [100, 1, 1, 1, 1, 1, 10**15])
    block = token_files.encode_blocks(ids, table)[0]
    for at in (0, 10, len(block) - 1):
        with pytest.raises((ValueError, IndexError, struct.error)):
            token_files.decode_blocks([block[:at] + bytes([block[at] ^ 0xFF]) + block[at + 1 :]], table)
    with pytest.raises(ValueError):
        token_files.decode_blocks([block], token_files.Table.counted(list(range(7)), [1] * 7))
    one = token_files.Table.counted([5], [3])
    assert token_files.decode_blocks(token_files.encode_blocks(np.full((1, 3), 5, np.uint32), one), one)[0].tolist() == [5, 5, 5]


def test_checksums_join():
    rnd = random.Random(0)
    for _ in range(50):
        a, b = (rnd.randbytes(rnd.randint(0, 300)) for _ in range(2))
        assert token_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files(spark, docs, sample, tmp_path):
    texts = [*sample[:60], *sample[-13:], "a <|endoftext|> b", sample[0]]
    ids = [*range(500, 500 + len(texts) - 4), None, None, 3, 3]
    df, path = docs(texts, ids=ids).unionByName(docs([sample[0]], ids=[3])).repartition(5), str(tmp_path / "tokens")
    token_files.write_tokens(df, path, BYTES, block=1024)
    rows = df.select("doc_id", "text").collect()
    got = token_files.digests(spark, path).orderBy("start").collect()
    whole = [_library_ids(r.text) for r in rows]
    assert Counter((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, whole, strict=True)) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    # ids of the corpus from any place
    stream = np.concatenate([x for _, x in sorted(((r.start, x) for r in got for x in [next(w for d, w in zip(rows, whole, strict=True) if d.doc_id == r.doc_id and zlib.crc32(w.tobytes()) == r.ids_crc32)]), key=lambda p: p[0])])
    for start, end in ((0, 5), (1000, 3100), (len(stream) - 3, len(stream) + 10)):
        parts = token_files.read_between(spark, path, start, end, 1024).orderBy("start").collect()
        assert b"".join(p.ids for p in parts) == stream[start:end].tobytes()
    pieces = token_files.read_pieces(spark, path).filter("doc_id = 500").orderBy("at").collect()
    assert b"".join(p.ids for p in pieces) == _library_ids(sample[0]).tobytes()


def test_token_files_of_an_empty_table(spark, docs, tmp_path):
    token_files.write_tokens(docs(["x"]).limit(0), str(tmp_path / "t"), BYTES)
    assert token_files.digests(spark, str(tmp_path / "t")).collect() == []


# filter audit ----------------------------------------------------------------------------------------------------------------
def _audit(rows, labels):
    """By definition: each order is applied to the documents one step after the other."""
    good, toxic, fails = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}, []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        fails.append({x for x, bad in zip("ABCDE", tests, strict=True) if bad})
    out, removed_by = {}, Counter()
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_by[part, x] += len(gone)
                redundant = sum(x in f and bool(f & set(order[: step - 1])) for _, f in own)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, docs):
    rnd = random.Random(6)
    long = " ".join(f"w{k}" for k in range(250))
    pool = [None, "", " ", "A B", long, long + " #", "a b " * 150, "UP " * 300, long.upper(), "x | y", "é " * 220, "w " * 199, "w " * 200, long + " A" * 40, "\x0b\x0c\x1c"]
    texts = [rnd.choice(pool) for _ in range(120)]
    ids = [*range(100), None, None, *[rnd.randint(0, 40) for _ in range(18)]]
    sources = [rnd.choice(["s1", "s2", None, ""]) for _ in texts]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in [*range(0, 90, 2), 4, 6, 6, None]]
    got = filter_audit.filter_audit(docs(texts, sources=sources, ids=ids).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got.collect()}
    expected = _audit(list(zip(ids, texts, sources, strict=True)), [x for x in labels if x[0] is not None])
    assert found == expected and len(found) == 3 * 600


def test_filter_audit_of_long_texts_and_an_empty_table(spark, docs):
    text = "word other " * 300_000 + "x" * 2_000_000
    assert filter_audit.failures(text.encode()) == 0b0010 and filter_audit.failures(b"") == 0b0001
    assert filter_audit.filter_audit(docs(["x"]).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


# phrase mining ---------------------------------------------------------------------------------------------------------------
def _mined(rows, least, longest, most, share=100):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        frequent = {p: n for p, n in own.items() if n >= least and len(p) > 1}
        found = []
        for p, a in frequent.items():
            longer = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in longer):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "shard", "most", "share"), [(2, 1 << 22, 2000, 100), (3, 40, 15, 100), (2, 1, 2000, 60)])
def test_phrase_mining(docs, least, shard, most, share):
    rnd = random.Random(least)
    words = ["a", "b", "B", "cé", "d", "\x1c", "e f", "É", "😀"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)] + [None, "", " ", "...", "a " * 300, "b"]
    langs = [rnd.choice(["en", "fr", None, ""]) for _ in texts]
    got = phrase_mining.phrase_mining(docs(texts, langs=langs).repartition(3), least, 5, most, share, shard)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == _mined(list(zip(langs, texts, strict=True)), least, 5, most, share)


def test_phrase_mining_of_nothing(docs):
    assert phrase_mining.phrase_mining(docs(["x"]).limit(0)).collect() == []
    assert phrase_mining.phrase_mining(docs([None, "", "a b c"])).collect() == []


def test_bitmaps_of_a_shard():
    """Pairs and longer phrases by shift, AND and popcount are those of a scan, over many blocks and with free places."""
    rnd = np.random.default_rng(1)
    seq = rnd.integers(-1, 4, 5000)
    at = np.flatnonzero(seq >= 0)
    order = np.argsort(seq[at], kind="stable")
    blocks, bits, sizes, counts = phrase_mining._packed(seq[at][order], at[order], 4)
    assert counts.tolist() == [int((seq == w).sum()) for w in range(4)]
    shard = phrase_mining.Shard(np.array([10, 11, 12, 13]), sizes, blocks, bits)
    scan = {k: Counter(tuple((seq[i : i + k] + 10).tolist()) for i in range(len(seq) - k + 1) if (seq[i : i + k] >= 0).all()) for k in range(2, 6)}
    a, b, n = shard.pairs()
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == dict(scan[2])
    steps = np.array([0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 0, 2 * 4 + 2, 3 * 4 + 1])
    allowed = {(10 + s // 4, 10 + s % 4) for s in steps.tolist()}
    found = {tuple(p): k for ids, n in shard.phrases(steps, 5) for p, k in zip(ids.tolist(), n.tolist(), strict=True)}
    assert found == {p: k for length in (3, 4, 5) for p, k in scan[length].items() if all(pair in allowed for pair in zip(p, p[1:], strict=False))}


