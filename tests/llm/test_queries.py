"""Registered queries and pipeline stages on whole small tables: against their SQL, or against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sighthound.llm import mixing, pseudonyms, queries, trie_join

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def table(duck):
    return duck.execute("select doc_id, text, lang from documents order by doc_id").fetchall()


def plain(x):
    return None if x is None else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, str(SF))
    got = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in got.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == theirs


def test_language_query(spark, table):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op1_language_id"](spark, str(SF)).collect()}
    assert len(rows) == len(table)
    right = Counter()
    for i, text, lang in table:
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"] and lang and text and any(c.isalpha() for c in text):
            right[r["lang_pred"] == lang] += 1
    assert right[True] >= 0.95 * sum(right.values())


def test_media_query(spark, table):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_media_png"](spark, str(SF)).collect()}
    for i, text, _ in table:
        raw, r = (text or "").encode(), rows[i]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_multiset_query(spark, table):
    """Edited texts and their digests exactly; likeness within the estimate's noise of the true one."""
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_multiset_hash"](spark, str(SF)).collect()}
    parts = lambda t: Counter(x for x in re.split(r"\n+|(?<=[.!?])\s+", t) if x)

    def near(a, b):
        a, b = parts(a), parts(b)
        whole = sum(n * n for n in a.values()) + sum(n * n for n in b.values())
        return 1.0 if a == b else 2 * sum(n * b[x] for x, n in a.items()) / whole if whole else 0.0

    off = []
    prints = {}
    for (i, text, _), (_, after, _) in zip(table, table[1:] + table[:1], strict=True):
        r, text, after = rows[i], text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        off += [r["near_edited"] - near(text, edited), r["near_next"] - near(text, after)]
    assert np.sqrt(np.mean(np.square(off))) < 0.1 and max(map(abs, off)) < 0.4


def test_license_query(spark, table):
    """The license lines of the table, each found as often as it stands there, and none but them."""
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op8_license_scan"](spark, str(SF)).collect()}
    for i, text, _ in table:
        want = {name for line, name in lines.items() if line in (text or "")}
        assert rows[i]["licenses"] == ",".join(sorted(want)) and rows[i]["n_notices"] == sum((text or "").count(line) for line in lines)


def test_pseudonym_query(spark, table):
    """All counts, texts that can be put back, nothing else changed."""
    back = pseudonyms.Pseudonyms(pseudonyms.KEY, back=True)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_pii_pseudonyms"](spark, str(SF)).collect()}
    for i, text, _ in table:
        r = rows[i]
        if text is None:
            assert r["text"] is None
            continue
        assert back.replace(r["text"])[0] == text and len(r["text"]) >= len(text) - 8
        assert r["n_email"] == len(re.findall(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+", text))
        assert r["n_card"] == sum(luhn(x) for x in re.findall(r"(?<![\w-])\d{13,19}(?![\w-])", text))
        if not any(r[f"n_{k}"] for k in pseudonyms.KINDS):
            assert r["text"] == text


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, pii_found string, row string, size int, taken int, body string, hash int"
WORDS = {"en": "the and of which with would there been have this", "fr": "les des est dans pour une sur avec plus cette"}


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(8), []
    extra = ("a", "b", "c", "d", 1, 2, "e", 3)
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        text = " ".join(rng.choice(WORDS[lang].split()) + (f" n{rng.randrange(500)}" if rng.random() < 0.5 else "") for _ in range(rng.randrange(5, 60)))
        rows.append((i, text, lang if i % 5 else None, ("s", "t", None)[i % 3], len(text), *extra))
    rows += [(100, None, None, "s", 0, *extra), (101, "", "en", None, 0, *extra), (102, "12 34 ½", "en", "s", 5, *extra), rows[0], (0, "les des est dans pour une autre chose ici", "fr", "s", 1, *extra), (None, rows[1][1], None, "t", 1, *extra), (None, rows[1][1], None, "t", 1, *extra)]
    rows.append((103, "the mail of this is a.b@c.example and 4539578763621486", "en", "s", 1, *extra))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(docs, k):
    _, stage = pipeline.STAGES[k]
    out = stage(docs.sparkSession, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    for r in out.collect():
        assert (r["score"], r["lang_pred"], r["pii_found"], r["row"], r["size"], r["taken"], r["body"], r["hash"]) == ("a", "b", "c", "d", 1, 2, "e", 3)
    assert stage(docs.sparkSession, docs.limit(0), "").count() == 0


def test_language_stage(docs):
    kept = pipeline.language(docs.sparkSession, docs, "").collect()
    assert len(kept) == docs.count() - 3 and not {100, 101, 102} & {r["doc_id"] for r in kept}
    assert all(r["lang"] in WORDS for r in kept)


def test_near_duplicate_stage(docs):
    kept = pipeline.near_duplicates(docs.sparkSession, docs, "").collect()
    want = Counter(r["doc_id"] for r in docs.collect())
    want.update({0: -1, None: -2})
    assert Counter(r["doc_id"] for r in kept) == +want
    assert sorted(r["text"] for r in kept if r["doc_id"] == 0) == sorted({r["text"] for r in docs.collect() if r["doc_id"] == 0})


def test_near_duplicate_stage_makes_small_filters(spark, docs, monkeypatch):
    bits, write = {}, trie_join.materialize
    monkeypatch.setattr(trie_join, "materialize", lambda df, name: [bits.setdefault(name, int(spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.numBits"))), write(df, name)][1])
    pipeline.near_duplicates(spark, docs, "").count()
    assert bits["tries"] <= 1 << 14


def test_personal_data_stage(docs):
    before, after = ({(r["doc_id"], r["source"], r["text"]) for r in d.collect()} for d in (docs, pipeline.personal_data(docs.sparkSession, docs, "")))
    assert {x[0] for x in before - after} == {103} and all(x[2] is None or len(x[2]) > 0 or x[0] == 101 for x in after)


def test_mixture_stage(docs):
    words = F.sum(mixing.word_count(F.col("text"))).alias("words")
    rows = docs.withColumn("words", mixing.word_count(F.col("text"))).withColumn("key", mixing.row_key(F.col("doc_id"), F.col("text")))
    want = {r["source"]: r["words"] for r in mixing.pareto_mix(rows, ["source"], "words").groupBy("row.source").agg(F.sum("taken").alias("words")).collect()}
    got = pipeline.mixture(docs.sparkSession, docs, "")
    assert {r["source"]: r["words"] for r in got.groupBy("source").agg(words).collect()} == want
    texts = [r["text"] or "" for r in docs.collect()]
    assert all(any(t.startswith(r["text"]) for t in texts) for r in got.collect())


def test_packing_stage(docs):
    rows = pipeline.packing(docs.sparkSession, docs, "").orderBy("sequence_id", "offset").collect()
    at = 0
    for r in rows:
        assert r["sequence_id"] * 2048 + r["offset"] == at
        at += r["length"]
    ends = [r for r in rows if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == docs.count() and sum(r["doc_tokens"] for r in ends) == at
    assert pipeline.packing(docs.sparkSession, docs.limit(0), "").count() == 0


def test_whole_pipeline(spark, table):
    """Every stage by itself on what the one before kept gives what the pipeline gives."""
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(SF)).cache()
        assert docs.count() > 0.5 * len(table)
    want = Counter((r["doc_id"], r["doc_tokens"]) for r in pipeline.packing(spark, docs, str(SF)).filter("start + length = doc_tokens").collect())
    got = pipeline.run(spark, str(SF)).filter("start + length = doc_tokens").collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got) == want
