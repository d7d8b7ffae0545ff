"""Mixing, sharding, language ID, licences, BPE and token files on small tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import regex
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from codelens_spark.llm import sharding
from codelens_spark.llm.bpe import WORD, Codec, decode, encode, encode_documents, read_ranks
from codelens_spark.llm.langid import accepted, identify
from codelens_spark.llm.licences import TEMPLATES, scan_licences
from codelens_spark.llm.mixing import mix_sources
from codelens_spark.llm.sharding import shard_by_bytes
from codelens_spark.llm.tokenfile import WordEncoder, Reader, Writer, read_documents, token_digests, write_tokens

ODD = [None, "", "  a  b\n\n c's 'll ÄÖ 日本語 🙂🙂 ﷽ \t\t x  ", "<|endoftext|>", "　 x", "aaaa" * 40, "é́\x00\x01", "one two", "one two", "ΑΣ Σ x"]


def text_rows(texts):
    return [(i, t, None, f"s{i % 3}") for i, t in enumerate(texts)]


def mixed(rows, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    size = defaultdict(int)
    for _, text, _, source in rows:
        size[source] += len([w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(size.values()), set()
    while True:
        rest = total - sum(most * size[s] for s in stopped)
        open_weight = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and weight[s] * rest / open_weight > most * size[s]}
        if not over:
            return {s: float(most * size[s]) if s in stopped else weight[s] * rest / open_weight for s in names}, size
        stopped |= over


@pytest.mark.parametrize("block", [4096, 4])
def test_mix(spark, documents, monkeypatch, block):
    monkeypatch.setattr("codelens_spark.llm.mixing.BLOCK", block)
    rows = [(i, " ".join(["w"] * (i * 7 % 40)), None, None if i % 11 == 0 else f"s{min(i % 23, 4)}") for i in range(200)]
    rows += [(500, "a b", None, "tiny"), (501, None, None, "none"), (502, "a\x1cb c", None, "s0")]
    targets, size = mixed(rows)
    out = mix_sources(documents(rows)).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) < 1 for s in targets)
    again = mix_sources(documents(rows[::-1]).repartition(5)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mix_empty_and_repeated(spark, documents):
    assert mix_sources(documents([])).collect() == []
    rows = [(None, "a b", None, None), (1, "a", None, None), (1, "a", None, None)]
    assert sum(r["taken"] for r in mix_sources(documents(rows)).collect()) == 4


@pytest.mark.parametrize("ranges", [160, 3])
def test_shards(spark, documents, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "LEAST_RANGES", ranges)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    rows = [(i, None if i % 3 == 0 else "x" * (i * 37 % 900) + str(i % 50) * (i % 2)) for i in range(2000)]
    out = shard_by_bytes(documents(rows)).collect()
    text = dict(rows)
    held, slots = defaultdict(int), defaultdict(list)
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    share = sum(held.values()) / 40
    assert len(out) == len(rows) and set(held) == set(range(40))
    assert all(abs(b - share) < 0.06 * share + 2000 for b in held.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in out:
        where[text[r["doc_id"]]].add(r["shard"])
    group = defaultdict(int)
    for r in out:
        group[text[r["doc_id"]]] += r["size"]
    assert all(len(s) == 1 for t, s in where.items() if group[t] <= sharding.WHOLE_GROUP * share)
    assert all(max(s) - min(s) + 1 == len(s) for s in where.values())


def test_shards_of_few_rows(spark, documents):
    assert shard_by_bytes(documents([])).collect() == []
    out = shard_by_bytes(documents([(1, "a"), (1, "a"), (None, None)])).collect()
    assert len(out) == 3 and all(0 <= r["shard"] < 40 for r in out)


def test_language_id(spark, documents):
    words = {"aa": ["nak", "tok", "lik"], "bb": ["ßul", "öri", "äwe"], "cc": ["que", "ción", "oui"]}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang], rng.integers(20, 200))), lang, "s") for i in range(300) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(900, None, "aa", "s"), (901, "", None, "s"), (902, "12 34 !?", "aa", "s"), (903, "nak tok " * 40_000, None, "s"), (None, "nak tok lik " * 5, None, "s")]
    out = {r["doc_id"]: r for r in identify(documents(rows)).collect()}
    truth = {r[0]: r[2] for r in rows[:300]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in out.items() if r["held_out"] and i is not None and i < 300) == sorted(held)
    assert np.mean([out[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert out[903]["lang_pred"] == out[None]["lang_pred"] == "aa" and not out[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert identify(documents(rows)).filter(accepted()).count() == 302
    assert identify(documents([])).collect() == []
    assert [r["lang_pred"] for r in identify(documents([(1, "abc")])).collect()] == ["und"]  # nothing to learn from


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark, documents):
    rows = [(i, ("nak tok " if i % 2 else "öri äwe ") * 30, "aa" if i % 2 else "bb", "s") for i in range(80)]
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, "other") for i, t, lang, _ in rows]
    get = lambda r: sorted((x["doc_id"], x["lang_pred"], x["score"]) for x in identify(documents(r)).collect())
    assert get(rows) == get(turned)


def licence_words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute_licence(text):
    """Every template over every place of the text: names that match, and the best Dice."""
    words, found = licence_words(text), []
    for name, notice, needs in TEMPLATES:
        t = licence_words(notice)
        own = set(zip(t, t[1:]))
        need = {tuple(n.split()) for n in needs.split(", ") if n}
        for at in range(len(words)):
            part = words[at: at + len(t)]
            window = set(zip(part, part[1:]))
            dice = 2 * len(window & own) / max(1, len(window) + len(own))
            if dice >= 0.8 and need <= window:
                found.append((dice, len(own), name))
    return max(found)[0] if found else None, {name for _, _, name in found}


def test_licences(spark, documents):
    plain = [
        ("Copyright 2020 Foo. Released under the MIT License.", "MIT"),
        ("Copyright 2020 The Project Authors. Licensed under the Apache License, Version 2.0. All else is prose.", "Apache-2.0"),
        ("This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.", "GPL-2.0"),
        ("You may use it. This work is licensed under the GNU Affero General Public License, version 3. Bye", "AGPL-3.0"),
        ("Licensed under CC BY-SA 4.0. So there", "CC-BY-SA-4.0"), ("licensed under cc by 4.0", "CC-BY-4.0"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("Licensed under the BSD 4-Clause License.", None), (None, None), ("", None), ("MIT", None), ("one two three " * 3000, None), ("x " * 50_000 + "released under the MIT\n\nlicense y", "MIT"),
    ]
    rng = np.random.default_rng(8)
    texts = [t for t, _ in plain]
    for name, notice, _ in TEMPLATES:
        for share in (0.0, 0.05, 0.1, 0.2):
            words = [f"q{rng.integers(9999)}" if rng.random() < share else w for w in notice.split()]
            texts.append(" ".join([f"p{rng.integers(99)}" for _ in range(int(rng.integers(0, 12)))] + words + ["end"] * 2))
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in scan_licences(documents([*rows, (None, texts[0]), (0, texts[0])]).repartition(3)).collect()}
    assert len(out) == len(rows) + 1 and out[None]["licence"] == "MIT"
    for i, (_, name) in enumerate(plain):
        assert out[i]["licence"] == name, texts[i]
    for i, text in rows:
        dice, names = brute_licence(text)
        # a window laid at a probe may lie a few words beside the best one of all
        assert (out[i]["dice"] or 0) <= (dice or 0) and set(filter(None, (out[i]["licences"] or "").split(","))) <= names, text
        if dice and dice >= 0.85:
            assert out[i]["dice"] >= dice - 0.05, text
        if out[i]["dice"]:
            assert out[i]["licence"] in names and 1 <= out[i]["start"] <= len(licence_words(text))
    assert scan_licences(documents([])).collect() == [] and scan_licences(documents(rows[:9]), templates=[]).filter("licence is not null").count() == 0

def test_byte_bpe(spark, documents, tik):
    texts = [*ODD, "the quick brown fox " * 30_000, "x\n" * 5000]
    for r in encode_documents(documents(text_rows(texts))).collect():
        text = texts[r["doc_id"]] or ""
        ids = tik.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    tokens = encode(documents(text_rows(texts)))
    assert {r["doc_id"]: bytes(r["raw"]).decode() for r in decode(tokens).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode_documents(documents([])).collect() == []


def test_byte_bpe_pieces(monkeypatch, tik):
    monkeypatch.setattr("codelens_spark.llm.bpe.PIECE", 40)
    codec = Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache=50)
    rng = np.random.default_rng(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "'", "12", "é", "🙂", "!?", " "], 150))
        ids = np.frombuffer(b"".join(p[1] for part in codec.encode(text) for p in part), np.int32)
        assert ids.tolist() == tik.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_byte_bpe_keeps_little(tik):
    codec = Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache=40)
    for text in (" ".join(f"{'long' * 20}{i} word{i}" for i in range(100)), " ".join(f"other{i}" for i in range(100))):
        assert [int(x) for part in codec.encode(text) for p in part for x in p[0].split()] == tik.encode_ordinary(text)
        assert len(codec.chunks) <= 40 and len(codec.cache) <= 20 and max(map(len, [*codec.chunks, *codec.cache])) <= WORD
    # ids are kept once, as integers
    assert len(codec.chunks) == 40 and {type(x) for x in [*codec.chunks.values(), *codec.cache.values()]} == {bytes}


def test_token_files(spark, documents):
    texts = [*ODD, "the quick brown fox " * 60_000, "a <|endoftext|> b<|startoftext|>c <|EndOfText|>"]
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [tool.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    out = sorted(token_digests(documents(text_rows(texts)).repartition(4)).collect())
    start = 0
    for r, ids in zip(out, want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = write_tokens(documents(text_rows(texts)))
    some = {r["doc_id"]: list(r["ids"]) for r in read_documents(spark, files, [3, 6, 99]).collect()}
    assert some == {3: want[3], 6: want[6]}
    assert token_digests(documents([])).collect() == []
    # null ids come last, repeated ids side by side
    twice = token_digests(documents([(1, "b"), (None, "c c"), (1, "a"), (-4, "d"), (None, None)])).collect()
    twice = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in twice)
    assert twice[:3] == [(0, -4, 2), (2, 1, 2), (4, 1, 2)] and twice[3:] in ([(6, None, 1), (7, None, 3)], [(6, None, 3), (9, None, 1)])


def test_words_are_encoded_like_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, encode = Tokenizer.from_file(path), WordEncoder(path, cache=40)
    assert encode.direct
    odd = ["don't WE'LL i'M 'S''re", "ÀÖØÞß ÿ×÷ Straße İstanbul ΣΑΣ cafe\u0301", "x\x1cy a\x85b a\u00a0b \u2028c", "ﬁ ² ½ ª µ º 中文 🙂👍🏽", "a_b-c--d...'ll 12'34", "\x7f\x00a \x1f", "<|endoftext|>x<|startoftext|>"]
    rng = np.random.default_rng(6)
    letters = np.array([*map(chr, range(1, 0x180)), *"'stre", "'ll", " ", "\u0301", "<|endoftext|>", "中"])
    for text in odd + ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(4000)]:
        assert encode(text.encode()).tolist() == tool.encode(text, add_special_tokens=False).ids, text


def test_seekable_file(tmp_path, monkeypatch):
    monkeypatch.setattr("codelens_spark.llm.tokenfile.FRAME_IDS", 10)
    path = str(tmp_path / "x.ids.zst")
    docs = [np.arange(n) * 3 for n in (0, 5, 10, 37, 0, 1)]
    writer = Writer(path, 2)
    for i, ids in enumerate(docs):
        writer.add(i - 3, ids)
    writer.close()
    with Reader(path) as reader:
        assert reader.docs["id"].tolist() == [-3, -2, -1, 0, 1, 2]
        assert all(reader.document(n).tolist() == ids.tolist() for n, ids in enumerate(docs))
        assert len(reader.entries) == 1 + 1 + 4 + 1 + 1
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.starts[1]) + 12] ^= 1
    open(path, "wb").write(raw)
    with Reader(path) as reader, pytest.raises(Exception):
        reader.document(2)
    with Reader(path) as reader:  # the damage is in one frame only
        assert reader.document(3).tolist() == docs[3].tolist()
