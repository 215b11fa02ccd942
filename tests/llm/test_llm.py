"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sighthound.llm import language_id, licenses, media, mixing, multiset_hash, packing, preference, pseudonyms, token_count, trie_join
from sighthound.llm._common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 90))) for _ in range(25)]
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in t.split(" ")) for t in base for _ in range(2)]
    odd = [None, "", " \n\t ", "one", "One", "two words", "é ñ 日本 <|endoftext|> </s> \x00 x", "x" * 3000, "Long. " * 4000, "½ ² Ⅳ ① 7", base[0], base[0], "12 345"]
    return [*base, *near, *odd]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if t != "12 345" else None, t, ("en", "fr", None)[i % 3], (None, "a", "b", "c")[i % 4], 0) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).withColumn("taken", F.lit("clash")).withColumn("size", F.lit(5)).withColumn("n_tokens_", F.lit(1))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_language(docs, empty):
    model = language_id.train(docs)
    rows = language_id.identify(docs.select("doc_id", "text", "lang"), model).collect()
    assert len(rows) == len(texts())
    for r in rows:
        letters = any(unicodedata.category(c)[0] == "L" for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    assert language_id.identify(empty.select("doc_id", "text"), language_id.train(empty)).count() == 0


def test_forward_sums_all_segmentations():
    path = tokenizer_path(language_id.VOCABULARY)
    found, n = language_id.automaton(path)
    p = np.random.default_rng(0).random((n + 1, 2)) / 50
    words = ["the", "zürich", "antidisestablishmentarianism" * 3, "日"]

    def total(word):
        alpha = [np.ones(2)] + [np.zeros(2)] * len(word)
        for end in range(1, len(word) + 1):
            ends = []
            for begin in range(end):
                at = found.get(word[begin:end], None)
                ends += [alpha[begin] * p[at // 32]] if at is not None else [alpha[begin] * p[n]] if end - begin == 1 else []
            alpha[end] = np.sum(ends, axis=0) if ends else np.zeros(2)
        return np.log(alpha[-1])

    got = language_id.Lattice(words, path).forward(p)
    assert np.allclose(got, [total("▁" + w) for w in words])


def test_training_on_long_words():
    """Sums of logarithms give what plain sums give, and words that would underflow still count."""
    path = tokenizer_path(language_id.VOCABULARY)
    _, n = language_id.automaton(path)
    p = np.random.default_rng(0).random((n + 1, 2)) / 50
    short = language_id.Lattice(["the", "zürich", "日", "donaudampfschiff"], path)
    assert np.allclose(short.shares(p, False), short.shares(p, True))
    long = language_id.Lattice(["donaudampfschifffahrt" * 100], path)
    used = long.shares(p / 1e6, True)
    at = np.bincount(long.end, minlength=long.nodes)  # each path crosses each end of the word once
    assert np.allclose(used[long.end == long.last[0]].sum(axis=0), 1) and at[long.last[0]] > 0
    got = language_id.expectation_maximisation(["a", "q" * 5000], np.array([[1.0, 0], [0, 1.0]]), path)
    found, _ = language_id.automaton(path)
    assert got[found.get("q") // 32, 1] + got[found.get("qq", 0) // 32, 1] > got[found.get("q") // 32, 0] and np.isfinite(got).all()


def test_held_out_accuracy(spark):
    """On rows that never train, of four languages made of their own commonest words, and labels that the held out rows lie about."""
    common = {"de": "der die und nicht mit ist auch eine für werden", "en": "the and of which with would there been have this", "es": "los que para una con está como pero más todo", "fr": "les des est dans pour une sur avec plus cette"}
    rng, rows = random.Random(2), []
    for i in range(240):
        lang = sorted(common)[i % 4]
        rows.append((i, " ".join(rng.choice(common[lang].split()) for _ in range(12)), "en" if zlib.crc32(str(i).encode()) % 3 == 1 else lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs.drop("lang").withColumn("score", F.lit("mine")), language_id.train(docs)).collect()
    assert all(r["lang_pred"] == sorted(common)[r["doc_id"] % 4] and r["input_score"] == "mine" for r in got)


def test_token_counts(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_count.MODEL))
    for r in token_count.count_tokens(docs.withColumn("n_bytes", F.lit("mine"))).collect():
        assert r["input_n_bytes"] == "mine"
        assert r["n_tokens"] == len(model.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode())
    assert token_count.count_tokens(empty).count() == 0


def test_png(docs):
    df = media.png_features(media.to_png(docs.withColumn("content", F.col("text").cast("binary"))))
    for r in df.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
    png = bytearray(media.encode_png(bytes(range(128)), 100))
    assert media.decode_png(bytes(png))[0].tobytes() == bytes(range(128)) and media.decode_png(bytes(png))[1] == 100
    png[40] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))


def test_png_features(docs, empty):
    """Digests and features of what is stored, computed apart; equal texts have equal rows; clashing names stay."""
    df = docs.withColumn("content", F.col("text").cast("binary")).withColumn("media", F.lit("m")).withColumn("feature", F.lit("f"))
    rows = media.png_features(media.to_png(df)).collect()
    assert len(rows) == len(texts())
    side, seen = media.SIDE, {}
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert r["media_bytes"] == len(r["media"]) and (r["input_media"], r["input_feature"]) == ("m", "f")
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
        small = np.zeros((side, side))
        for y in range(side):
            for x in range(side):
                a, b = y * len(image) // side, x * 64 // side
                small[y, x] = image[a : max(a + 1, (y + 1) * len(image) // side), b : (x + 1) * 64 // side].mean()
        low = [sum(small[y, x] * np.cos(np.pi / side * u * (y + 0.5)) * np.cos(np.pi / side * v * (x + 0.5)) for y in range(side) for x in range(side)) for u in range(8) for v in range(8)] if len(payload) < 600 else None
        if low:
            low = np.round(low, 6)
            assert r["feature"] == np.packbits(low > np.median(low[1:])).tobytes().hex()
        assert seen.setdefault(r["text"] or "", (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media.png_features(media.to_png(empty.withColumn("content", F.lit(b"")))).count() == 0


def test_png_filters():
    rng = np.random.default_rng(1)
    image, kinds = rng.integers(0, 256, (12, 9)), rng.integers(0, 5, 12)
    lines = np.zeros((12, 10), np.uint8)
    for y in range(12):
        for x in range(9):
            a, b = image[y, x - 1] if x else 0, image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            e = a + b - c
            paeth = a if abs(e - a) <= abs(e - b) and abs(e - a) <= abs(e - c) else b if abs(e - b) <= abs(e - c) else c
            lines[y, x + 1] = (image[y, x] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
        lines[y, 0] = kinds[y]
    assert (media.unfilter(lines) == image).all()


def mix_rows(docs):
    return docs.withColumn("words", mixing.word_count(F.col("text"))).withColumn("key", mixing.row_key(F.col("doc_id"), F.col("text")))


def test_mixing(docs, empty):
    rows = mixing.pareto_mix(mix_rows(docs), docs.columns, "words").collect()
    assert len(rows) == len(texts())
    for s in {r["row"]["source"] for r in rows}:
        own = [r for r in rows if r["row"]["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.pareto_mix(mix_rows(empty), ["doc_id"], "words").count() == 0
    taken = sum(r["taken"] for r in rows)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken


def test_mixing_ranks_by_odds(spark):
    """Pareto order sampling in plain Python, with sizes far apart, null and repeated ids, repeated rows and empty texts."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, i]), f"w{i} " * rng.choice([1, 2, 30, 400]) if i % 9 else "", "a" if i % 4 else "b") for i in range(300)]
    rows += rows[:20]
    df = mix_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted((r["row"]["doc_id"] or -1, r["row"]["text"], r["taken"]) for r in mixing.pareto_mix(df, ["doc_id", "text"], "words").collect())

    def u(i, t):
        key = f"{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}"
        return key, (int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    total = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    want = []
    for s, weight in (("a", 5), ("b", 2)):
        other = next(x for x in "ab" if x != s)
        share, cap = sum(total.values()) * weight / 7, 3 * total[s]
        target = cap if share > cap else sum(total.values()) - 3 * total[other] if sum(total.values()) - share > 3 * total[other] else share
        whole, own = int(target // total[s]), [(i, t) for i, t, x in rows if x == s]
        left = int(target) - whole * total[s]
        p, mean = left / total[s], total[s] / len(own)
        ranked = []
        for i, t in own:
            key, x = u(i, t)
            size = len(t.split())
            ranked.append((x / (1 - x) / (p / (1 - p) * size / mean) if size else float("inf"), key, size, i, t))
        for _, _, size, i, t in sorted(ranked, key=lambda r: r[:3]):
            part = max(0, min(size, left))
            left -= part
            want.append((i or -1, t, whole * size + part))
    assert got == sorted(want)
    sampled = [r for r in got if r[2] % max(1, len(r[1].split()))]
    assert len(sampled) <= 2  # one document of each source in part


def test_inclusion_odds_grow_with_size(spark):
    rows = [(i, "w " * (10 if i % 2 else 40), "a") for i in range(4000)] + [(9999, "w " * 60000, "b")]
    got = mixing.pareto_mix(mix_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")), ["source"], "words").filter("row.source = 'a'").collect()
    whole = min(r["taken"] // r["size"] for r in got)
    shares = [sum(r["taken"] >= (whole + 1) * n for r in got if r["size"] == n) / 2000 for n in (10, 40)]
    odds = [x / (1 - x) for x in shares]
    assert 3 < odds[1] / odds[0] < 5.3, shares


def test_multiset(spark, docs, empty):
    df = spark.createDataFrame([(1, "a b.\nc\nd", "d\na b.\nc", "c", "a b.\nd")], "i long, p string, q string, part string, rest string")
    for c in ("p", "q", "part", "rest"):
        df = multiset_hash.with_fingerprint(df, c, f"f_{c}")
    r = df.select("f_p", "f_q", multiset_hash.subtract("f_p", "f_part").alias("less"), "f_rest", multiset_hash.add("f_rest", "f_part").alias("more"), multiset_hash.likeness("f_p", "f_q").alias("same")).first()
    assert r["f_p"] == r["f_q"] and r["less"] == r["f_rest"] and r["more"] == r["f_p"] and r["same"] == 1.0
    ids = [r["doc_id"] for r in docs.filter("doc_id is not null").collect()]
    after = dict(zip(sorted(ids), sorted(ids)[1:] + sorted(ids)[:1]))
    got = multiset_hash.with_next(docs.filter("doc_id is not null").select("doc_id", "text"), ["doc_id"]).collect()
    assert {r["doc_id"]: r["next"]["doc_id"] for r in got} == after
    assert multiset_hash.with_next(docs.select("doc_id", "text"), ["text"]).count() == len(texts())
    assert multiset_hash.with_next(empty.select("doc_id", "text"), ["text"]).count() == 0


def test_multiset_of_repeated_lines(spark):
    other = "".join(f"line {i}\n" for i in range(300))
    pairs = [("same\n" * 20_000, "same\n" * 10_000 + other), ("same\n" * 16_384, "same\n" * 8_192), ("".join(f"s{i}\n" for i in range(10)) * 6_000, "".join(f"s{i}\n" for i in range(10)) * 3_000)]
    df = spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string, c string")
    for c in "abc":
        df = multiset_hash.with_fingerprint(df, c, f"f_{c}")
    rows = df.select(multiset_hash.likeness("f_a", "f_b").alias("near"), (multiset_hash.add("f_a", "f_b") == F.col("f_c")).alias("sum"), (multiset_hash.subtract("f_c", "f_b") == F.col("f_a")).alias("rest")).collect()
    assert all(abs(r["near"] - 0.8) < 0.02 and r["sum"] and r["rest"] for r in rows), rows


def test_multiset_order_of_keys(spark):
    """Null, repeated and hot keys, repeated rows: each row once, and together one round through all."""
    rows = [(None, f"n{i}") for i in range(30)] + [(5, f"h{i}") for i in range(200)] + [(5, "same")] * 10 + [(i, f"t{i}") for i in range(40)] + [(-3, "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("next", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(5)
    got = multiset_hash.with_next(df, ["doc_id", "text"]).collect()
    pairs = [((r["doc_id"], r["text"]), tuple(r["next"])) for r in got]
    assert Counter(p[0] for p in pairs) == Counter(p[1] for p in pairs) == Counter(rows) and all(r["input_next"] == "clash" and r["bucket"] == 1 for r in got)
    low = lambda k: float("-inf") if k is None else k
    falls = [(a, b) for a, b in pairs if low(a[0]) > low(b[0])]
    assert len(falls) == 1 and falls[0][0] == (39, "t39") and falls[0][1][0] is None
    wanted = sorted({low(k) for k, _ in rows})
    assert {(low(a[0]), low(b[0])) for a, b in pairs if a[0] != b[0]} == set(zip(wanted, wanted[1:] + wanted[:1]))


def test_likeness_of_unrelated_texts(spark):
    rng = random.Random(5)
    rows = [(i, ". ".join(f"s{rng.random()}" for _ in range(rng.randrange(1, 12))), ". ".join(f"s{rng.random()}" for _ in range(rng.randrange(1, 12)))) for i in range(400)]
    df = multiset_hash.with_fingerprint(multiset_hash.with_fingerprint(spark.createDataFrame(rows, "i long, a string, b string"), "a", "fa"), "b", "fb")
    near = [r[0] for r in df.select(multiset_hash.likeness("fa", "fb")).collect()]
    assert max(near) < 0.4 and np.sqrt(np.mean(np.square(near))) < 0.09


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    a, b = [("user", "q"), ("assistant", "x")], [("user", "q"), ("assistant", "yy")]
    long = [("user", f"t{i}") for i in range(6)]
    df = spark.createDataFrame([(a, b), (a, a), (None, b), ([(None, None)], a), (long, long[:3] + [("assistant", "t3")] + long[4:]), ([], [])], f"chosen {turn}, rejected {turn}")
    rows = preference.format_preferences(df.withColumn("prompt", F.lit("clash")).withColumn("n", F.lit(3))).collect()
    assert [r["prompt_turns"] for r in rows] == [1, 2, 0, 0, 3, 0] and all(r["input_prompt"] == "clash" and r["n"] == 3 for r in rows)
    assert rows[0]["prompt"] == "<|user|>\nq\n<|end|>\n" and rows[0]["chosen_mask"] == f"0:14,1:{1 + len(preference.END)}"
    assert rows[1]["chosen_text"] == rows[1]["rejected_text"] == "" and rows[2]["chosen_text"] == ""
    assert sum(int(x.split(":")[1]) for x in rows[0]["rejected_mask"].split(",")) == len(rows[0]["rejected_text"])
    assert preference.format_preferences(df.limit(0)).count() == 0


def test_forks(spark):
    """Pairs part at any depth; null roles, texts and turns, repeated turns, an odd conversation and a table without rows."""
    turns = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c in range(8, 20) for t in range(6)]
    turns += [(40, 0, "user", "only a question"), (41, 0, None, None), (41, None, "assistant", "a"), (41, 1, "assistant", "b"), (41, 1, "assistant", "b"), (None, 0, "user", "x"), (50, 0, "assistant", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    rows = {r["conv_id"]: r for r in preference.format_preferences(preference.forks(df)).collect()}
    assert sorted(rows) == [*range(8, 20), 41, 50]
    assert [rows[c]["prompt_turns"] for c in range(8, 20)] == [c % 6 for c in range(8, 20)]
    assert rows[9]["rejected_text"].startswith("<|assistant|>\n8-3") and rows[9]["chosen_text"].startswith("<|assistant|>\n9-3")
    assert len(rows[41]["chosen"]) == 4 and rows[41]["rejected_text"] == rows[50]["rejected_text"] == ""
    assert preference.forks(df.limit(0)).count() == 0


def test_packing(docs, empty):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    rows = packing.pack(docs.select("doc_id", "text").withColumn("copy", F.col("text")), window=64).orderBy("sequence_id", "offset").collect()
    ids, at = {}, 0
    for r in rows:
        assert r["sequence_id"] * 64 + r["offset"] == at and r["length"] * 4 == len(r["ids"]) and r["offset"] + r["length"] <= 64
        at += r["length"]
        ids.setdefault(r["row"]["doc_id"], []).append((r["start"], r["ids"], r["row"]["copy"]))
    for parts in ids.values():
        want = np.array([*t.encode(parts[0][2] or "", add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()
        assert b"".join(p[1] for p in sorted(parts, key=lambda p: p[0])) == want
    assert packing.pack(empty.select("doc_id", "text")).count() == 0


def test_licenses(docs):
    scan = licenses.scanner().scan
    assert [n[0] for n in scan("x\nLICENSED!! UNDER!! CC!! BY-NC!! 4.0.!!\ny")[1]] == ["CC-BY-NC-4.0"]
    assert [n[0] for n in scan("this work is licensed under the GNU general public license, version 3. And released under the MIT License.")[1]] == ["GPL-3.0", "MIT"]
    assert scan("licensed under the Apache License, Version 9.0.")[1] == [] and scan("a license to speak of")[1] == []
    df = docs.withColumn("notices", F.lit(1)).withColumn("license", F.lit("x"))
    assert licenses.scan_licenses(df).filter("size(notices) > 0 or input_notices <> 1").count() == 0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_ranked_low():
    text = "Released under the MIT License. This work was once licensed under the GNU General Public License, any version, and under a Creative Commons Attribution International License."
    assert [n[0] for n in licenses.scanner().scan(text)[1]] == ["MIT"]


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "BSD": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:""",
    "ISC": """ * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Unlicense": """This is free and unencumbered software released into the public
domain.""",
}


def test_two_clauses_and_three():
    scan = licenses.scanner().scan
    two = "\n".join(re.findall(r".{1,70}(?: |$)", licenses.BSD.replace("Redistributions of", "\n 1. Redistributions of").replace("Redistributions in", "\n 2. Redistributions in")))
    three = two + "\n 3. " + licenses.BSD_THIRD.replace("copyright holder", "University")
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (licenses.BSD_THIRD, "BSD-3-Clause")):
        assert [n[0] for n in scan("before " * 150 + text + " after" * 150)[1]] == [name]


def test_license_scan_against_all_templates_everywhere():
    """Notices at known places of a long text, as many words missing or added as are allowed, found each and no others."""
    rng, scan = random.Random(4), licenses.scanner().scan
    names = [(n, licenses.WORD.findall(w)) for n, w in licenses.TEMPLATES]
    text, want = [], []
    for _ in range(3):
        for name, words in rng.sample(names, len(names)):
            words = list(words)
            for _ in range(int(0.1 * len(words)) if len(words) > 30 else 0):
                i = rng.randrange(3, len(words) - 3)
                if not words[i][0].isdigit():
                    del words[i]
            text += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 200))] + words + [rng.choice(["\n", "."])]
            want.append(name)
    assert [n[0] for n in scan(" ".join(text))[1]] == want


def test_wrapped_licenses():
    scan = licenses.scanner().scan
    for name, text in WRAPPED.items():
        for around in ("", "the of this is released license, version 9 under no copyright to any person\n", "word " * 200 + "\n"):
            seen, found = scan(around + text + "\n" + around)
            assert seen >= 1 and [(n[0], n[4], n[5]) for n in found] == [(name, 0, 0)]
            assert (around + text)[found[0][1] : found[0][2]] in text
    assert [n[0] for n in scan("\n\n".join(WRAPPED.values()))[1]] == list(WRAPPED)
    n = 2 * licenses.scanner().around
    assert scan("license " + "word " * (n + 1) + "license")[0] == 2 and scan("license " + "word " * (n - 1) + "license")[0] == 1
    near = WRAPPED["ISC"].replace("software ", "new software ").replace("above", "")
    assert [(n[0], n[4], n[5]) for n in scan("this permission to use " * 9 + near)[1]] == [("ISC", 1, 1)]


def test_pseudonyms(docs):
    give, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    text = "a.b@mail.example.com 10.1.2.3 4539578763621486 9807915762804495 2024-02-29 31/12/1999 12/25/2001 +1 (017) 555-7713 078-05-1120 GB82WEST12345698765432"
    new, found = give.replace(text)
    assert sum(found.values()) == 10 and not set(text.split()) & (set(new.split()) - {"+1"})
    assert back.replace(new)[0] == text and give.replace(new)[0] != new
    assert pseudonyms.luhn_digit(new.split()[2][:-1]) == new.split()[2][-1]
    assert give.replace("in 1999 we had 1,234,567 and 3.5 of 2020")[0] == "in 1999 we had 1,234,567 and 3.5 of 2020"
    feistel = pseudonyms.Feistel(b"x")
    assert sorted(feistel.permute(i, 97, "t") for i in range(97)) == list(range(97))
    assert pseudonyms.pseudonymise(docs).filter("text is null").count() == 1


def test_values_that_fail_validation_stay(docs, empty):
    give = pseudonyms.Pseudonyms(b"k")
    for x in ("9807915762804490", "1699999999999", "4539 5787 6362 1487", "300.1.2.3", "GB83WEST12345698765432", "2023-02-29", "32/01/2000", "@.@", "…@…"):
        assert give.replace(x) == (x, {}), x
    df = docs.withColumn("pii_found", F.lit(1)).withColumn("n_email", F.lit(2))
    rows = pseudonyms.pseudonymise(df).collect()
    assert len(rows) == len(texts()) and all(r["input_pii_found"] == 1 and r["n_email"] == 2 for r in rows)
    assert pseudonyms.pseudonymise(empty).count() == 0


def test_addresses_of_any_alphabet():
    give, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    for x in ("aİb@mail.com", "жора@почта.рф", "Ünï.ß@mail.de", "日本@x.jp", "李雷@例子.cn", "ǅ@a.b", "a_1@b.c"):
        new, found = give.replace(x)
        assert found == {"email": 1} and new != x and len(new) == len(x) and back.replace(new)[0] == x
    for alphabet in set(pseudonyms.ALPHABET_OF.values()):
        assert all(pseudonyms.ALPHABET_OF[c] == alphabet for c in alphabet)


def test_social_security_numbers():
    give, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    for bad in ("000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"):
        assert give.replace(bad) == (bad, {})
    good = ["001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999", *(f"{a}-{a % 99 + 1:02d}-{a:04d}" for a in range(100, 600, 7))]
    new = [give.replace(x)[0] for x in good]
    assert len(set(new)) == len(good) and [back.replace(x)[0] for x in new] == good and all(give.ssn(x) for x in new)


def test_phone_groupings():
    give, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    heads = {
        "+44 20 7946 0958": "+44 ", "+44 (0)20 7946 0958": "+44 (0)", "+33 1 23 45 67 89": "+33 ", "+49 30 12345678": "+49 ", "+34 612 345 678": "+34 ", "+33123456789": "+33",
        "0033 1 23 45 67 89": "0033 ", "0049 30 12345678": "0049 ", "+351 21 123 4567": "+351 ", "+1 (017) 555-7713": "+1 ", "01 23 45 67 89": "0", "06.12.34.56.78": "0", "020 7946 0958": "0",
        "07700 900123": "0", "030/1234567": "0", "(030) 123 45 67": "(0", "612 345 678": "", "612 34 56 78": "", "91 123 45 67": "", "555-0142": "", "+33\u00a01\u00a023\u00a045\u00a067\u00a089": "+33\u00a0",
    }
    for v, head in heads.items():
        for text in (v, f"Tel. {v}.", f"({v}), call", f"{v} 2024-02-29 10.1.2.3"):
            new, found = give.replace(text)
            assert found.get("phone") == 1 and v not in new and head in new and len(new.split(" 20")[0]) >= len(v), (text, new)
            assert back.replace(new)[0] == text and re.sub(r"\d", "9", new)[: len(v)] == re.sub(r"\d", "9", text)[: len(v)]
    mixed = "+33 1 23 45 67 89 10.1.2.3 +49 30 12345678 2024-02-29 078-05-1120"
    assert give.replace(mixed)[1] == {"phone": 2, "ip": 1, "date": 1, "ssn": 1}
    for plain in ("1 234 567", "12.345.678", "3.14159265", "612.345.678", "+12 34", "in 2019-2020", "10:30", "01/12/99", "20000", "0612345678", "1 612 345 678 901"):
        assert give.replace(plain)[0] == plain, plain


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "chunk", "weight"), [(4, 85, 1024, 1 << 21), (2, 50, 3, 1 << 21), (2, 50, 1024, 200)])
def test_ngram_join(docs, k, percent, chunk, weight):
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").collect()]
    got = trie_join.jaccard_classes(docs, k, percent, chunk=chunk, weight=weight).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(rows, k, percent)
    assert len(got) == len(texts())


@pytest.mark.parametrize("size", [6, 12])
def test_ngram_join_around_the_switch(spark, size):
    """Groups that meet at a shingle, of fewer and of more members than are counted in pairs, in which only some link."""
    rng, rows = random.Random(size), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for m in range(size):
            words = list(base)
            for _ in range(m):
                words[rng.randrange(60)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in trie_join.jaccard_classes(df, 2, 70).collect()} == brute(rows, 2, 70)


def test_ngram_join_of_repeated_and_null_ids(spark):
    rng, rows = random.Random(9), []
    near = lambda: " ".join(w if rng.random() > 0.01 else f"x{rng.random()}" for w in (f"w{i}" for i in range(120)))
    rows += [(None, near()) for _ in range(60)] + [(3, near()) for _ in range(60)] + [(None, "quite another text of a few words")] * 5 + [(3, "third kind of text in four words")] * 5 + [(8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.lit("clash")).withColumn("row", F.lit(1))
    got = trie_join.jaccard_classes(df, 4, 60).collect()
    assert len(got) == len(rows)
    classes = brute(list(enumerate(t for _, t in rows)), 4, 60)
    of = {}
    for i, (n, c) in classes.items():
        of.setdefault(rows[i][1], c if n else None)
    kept = trie_join.one_of_each(df, 4, 60).collect()
    assert sorted(of[r["text"]] for r in kept if r["text"]) == sorted({c for n, c in classes.values() if n}) and sum(not r["text"] for r in kept) == 2
    assert {r["doc_id"] for r in kept if r["text"].startswith(("w", "x"))} == {3}
    assert kept[0].asDict().keys() == {"doc_id", "text", "body", "row"}


def test_session_settings_stay(spark, docs):
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    trie_join.jaccard_classes(docs.limit(5)).count()
    assert spark.conf.get(key) == before


def test_runtime_filters_fit_their_members(spark, docs, monkeypatch):
    """They pass the driver whole: a few members make a small filter, and only the two joins with the texts make one."""
    seen, write, key = {}, trie_join.materialize, "spark.sql.optimizer.runtime.bloomFilter"

    def note(df, name, *args):
        seen[name] = spark.conf.get(f"{key}.creationSideThreshold"), int(spark.conf.get(f"{key}.numBits")), int(spark.conf.get(f"{key}.maxNumBits"))
        return write(df, name, *args)

    monkeypatch.setattr(trie_join, "materialize", note)
    usual = spark.conf.get(f"{key}.creationSideThreshold")
    trie_join.jaccard_classes(docs, 2, 50, chunk=2).collect()
    assert {name for name, x in seen.items() if x[0] != usual} == {"tries", "cross-tries"}
    assert all(x[1] == x[2] <= 1 << 14 for name, x in seen.items() if name in ("tries", "cross-tries"))
    for members, bits in ((0, 1 << 14), (100_000, 1_600_000), (1 << 21, 1 << 25), (1 << 40, 1 << 25)):
        with trie_join.runtime_filter(spark, members):
            assert int(spark.conf.get(f"{key}.numBits")) == bits


def test_other_tokenizers_go_through_the_library(docs):
    import tokenizers

    path = tokenizer_path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    assert packing.splits_words(tokenizer_path(packing.TOKENIZER)) and not packing.splits_words(path)
    for r in packing.tokenize(docs.withColumn("ids", F.lit(1)), tokenizer=path).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*t.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID] and r["input_ids"] == 1


def test_ngram_join_of_nothing(empty):
    assert trie_join.jaccard_classes(empty).count() == 0
