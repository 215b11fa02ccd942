"""Language identification with segmentation-marginalised unigrams.

Every language has probabilities of the pieces of one fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, which a forward pass over its lattice adds up; a text's is the product over its words.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, make_room, schema_of, small_batches, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
WORDS = re.compile(r"[^\W\d_]+")
#: Characters that regular expressions take as part of words but that are no letters (category L), fractions, superscripts and Roman numerals among them.
NUMERALS = {c: " " for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()}
#: Bounds of the training sample for each language: documents expected (by a threshold on a hash of doc_id) and words kept.
TRAIN_DOCS, TRAIN_WORDS = 1000, 30_000
#: Letters of a word from which on training sums logarithms: products of as many probabilities could underflow.
LONG = 24
ROUNDS, SMOOTH, FLOOR, UNKNOWN = 3, 0.02, 1e-8, 1e-9
#: Words whose lattices go through a round together: bounds the memory of training.
BLOCK = 5000
#: Words whose scores a Python worker keeps.
KEPT_WORDS = 300_000


@lru_cache(1)
def automaton(path: str):
    """Aho-Corasick automaton over the vocabulary's lower-case letter pieces; a value is id * 32 + length. And their number."""
    import ahocorasick
    import sentencepiece

    model, found = sentencepiece.SentencePieceProcessor(model_file=path), ahocorasick.Automaton()
    n = 0
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (not (x := piece.removeprefix("▁")) or x.isalpha()) and piece == piece.lower() and len(piece) < 32:
            found.add_word(piece, n * 32 + len(piece))
            n += 1
    found.make_automaton()
    return found, n


def words_of(text: str) -> list[str]:
    """Runs of letters of a text, in lower case."""
    found = WORDS.findall(text.lower())
    return found if "".join(found).isalpha() else WORDS.findall(text.lower().translate(NUMERALS))


class Lattice:
    """Edges of many words: each goes from node ``start`` to ``end`` with a piece; a character without a piece of its own gets the unknown piece."""

    def __init__(self, words: list[str], path: str):
        found, self.unknown = automaton(path)
        joined = "\n".join(f"▁{w}" for w in words) + "\n"
        flat = np.fromiter(chain.from_iterable(found.iter(joined)), np.int64).reshape(-1, 2)
        end, size, piece = flat[:, 0] + 1, flat[:, 1] % 32, flat[:, 1] // 32
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        self.last = self.first + lengths
        self.nodes = len(joined) + 1
        single = np.zeros(self.nodes, bool)
        single[end[size == 1]] = True
        alone = np.ones(self.nodes, bool)
        alone[self.first] = False
        alone[self.last + 1] = False
        lone = np.flatnonzero(alone & ~single)
        end = np.concatenate([end, lone])
        size = np.concatenate([size, np.ones(len(lone), np.int64)])
        piece = np.concatenate([piece, np.full(len(lone), self.unknown)])
        word = np.repeat(np.arange(len(words)), lengths + 1)
        depth = end - self.first[word[end - 1]]
        order = np.lexsort((end, depth))
        self.end, self.start, self.piece = (x[order].astype(np.int32) for x in (end, end - size, piece))
        self.steps = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])[1:]
        self.lengths, self.word = lengths, word.astype(np.int32)

    def forward(self, p: np.ndarray, keep: bool = False):
        """Log probability of each word under each column of ``p``; with ``keep`` the unscaled forward values too."""
        alpha = np.zeros((self.nodes, p.shape[1]))
        alpha[self.first] = 1
        scale = np.zeros((len(self.first), p.shape[1]))
        back = np.arange(-31, 1)
        for depth in range(1, len(self.steps)):
            cut = slice(self.steps[depth - 1], self.steps[depth])
            end = self.end[cut]
            if not len(end):
                continue
            new = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
            alpha[end[new]] = np.add.reduceat(alpha[self.start[cut]] * p[self.piece[cut]], new, axis=0)
            if not keep and depth % 16 == 0:  # long words would underflow
                on = np.flatnonzero(self.lengths > depth)
                at = np.maximum((self.first[on] + depth)[:, None] + back, self.first[on][:, None])
                top = alpha[at].max(axis=1)
                top[top == 0] = 1
                for row in np.unique(at - self.first[on][:, None]):
                    alpha[self.first[on] + row] /= top
                scale[on] += np.log(top)
        total = alpha[self.last]
        if keep:
            return total, alpha
        return np.log(np.maximum(total, 1e-300)) + scale

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.nodes, p.shape[1]))
        beta[self.last] = 1
        for depth in range(len(self.steps) - 1, 0, -1):
            cut = slice(self.steps[depth - 1], self.steps[depth])
            np.add.at(beta, self.start[cut], beta[self.end[cut]] * p[self.piece[cut]])
        return beta

    def shares(self, p: np.ndarray, logs: bool) -> np.ndarray:
        """How often each edge is used, by language, in expectation over all segmentations of its word; with ``logs`` sums of logarithms."""
        at = self.word[self.end - 1]
        if not logs:
            total, alpha = self.forward(p, keep=True)
            return alpha[self.start] * p[self.piece] * self.backward(p)[self.end] / np.maximum(total, 1e-300)[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            q = np.log(p)
            alpha, beta = (np.full((self.nodes, p.shape[1]), -np.inf) for _ in range(2))
            alpha[self.first], beta[self.last] = 0, 0
            for depth in range(1, len(self.steps)):
                cut = slice(self.steps[depth - 1], self.steps[depth])
                np.logaddexp.at(alpha, self.end[cut], alpha[self.start[cut]] + q[self.piece[cut]])
            for depth in range(len(self.steps) - 1, 0, -1):
                cut = slice(self.steps[depth - 1], self.steps[depth])
                np.logaddexp.at(beta, self.start[cut], beta[self.end[cut]] + q[self.piece[cut]])
            return np.nan_to_num(np.exp(alpha[self.start] + q[self.piece] + beta[self.end] - alpha[self.last][at]), posinf=0.0)


def expectation_maximisation(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by language from word counts (words by languages), each round with expected counts over all segmentations."""
    pieces, unknown = automaton(path)[1] + 1, automaton(path)[1]
    order = sorted(range(len(words)), key=lambda i: (len(words[i]) > LONG, i))
    short = sum(len(w) <= LONG for w in words)
    bounds = sorted({*range(0, short, BLOCK), *range(short, len(words), BLOCK), len(words)})
    blocks = [(Lattice([words[i] for i in order[a:b]], path), counts[order[a:b]], a >= short) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    uses = sum(np.bincount(lattice.piece, minlength=pieces) for lattice, _, _ in blocks).astype(float)
    p = np.repeat((uses / uses.sum())[:, None], counts.shape[1], axis=1)
    for _ in range(rounds):
        want = np.zeros_like(p)
        for lattice, n, logs in blocks:
            used = lattice.shares(p, logs) * n[lattice.word[lattice.end - 1]]
            for k in range(p.shape[1]):
                want[:, k] += np.bincount(lattice.piece, used[:, k], pieces)
        want[unknown] = 0
        p = want / np.maximum(want.sum(axis=0), 1e-300)
    both = p.mean(axis=1, keepdims=True)
    p = (1 - SMOOTH) * p + SMOOTH * both + FLOOR
    p[unknown] = UNKNOWN
    return p


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier as text leaves 1 modulo 3; such rows never train. Null identifiers are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, vocabulary: str | None = None, docs_per_language: int = TRAIN_DOCS, words_per_language: int = TRAIN_WORDS):
    """Learn from text and lang of rows that aren't held out: languages in code point order and piece probabilities.

    The sample is bounded: per language about ``docs_per_language`` documents, those whose hashed id falls below a
    threshold, and of their words, of any length, the ``words_per_language`` most frequent, of equals the first in code point
    order. Rows without an id count by the hash of null. One task fits the model, which has a number for each piece and language.
    No labelled rows give a model without languages.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)
    docs = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return [], np.zeros((1, 0)), path
    langs = sorted(sizes)
    below = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(min(1, docs_per_language / n) * (1 << 30)) + 1)) for k, n in sizes.items()))
    sample = docs.filter(F.col("h") < below[F.col("lang")])

    def count(batches):
        from collections import Counter

        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    small_batches(docs.sparkSession)
    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = words.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= words_per_language)

    def fit(batches):
        names: dict[str, int] = {}
        rows = [(names.setdefault(w, len(names)), langs.index(x), n) for b in batches for x, w, n in zip(*(b[c].to_pylist() for c in ("lang", "word", "n")), strict=True)]
        counts = np.zeros((len(names), len(langs)))
        for w, x, n in rows:
            counts[w, x] = n
        p = expectation_maximisation(list(names), counts, path) if names else np.full((automaton(path)[1] + 1, len(langs)), FLOOR)
        yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f8").tobytes()], pa.binary())], ["p"])

    # The bounded sample goes to one task; the driver gets the model alone.
    (model,) = ranked.select("lang", "word", "n").repartition(1).mapInArrow(fit, "p binary").collect()
    return langs, np.frombuffer(model["p"], "<f8").reshape(-1, len(langs)), path


class Scorer:
    """Log probabilities of texts; keeps those of words that it has met."""

    def __init__(self, p: np.ndarray, path: str):
        self.p, self.path, self.rows = p, path, {}
        self.table = np.zeros((0, p.shape[1]))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by text and language, and the number of words of each text."""
        words = [words_of(t) if t else [] for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        if len(self.rows) > KEPT_WORDS:
            self.rows, self.table = {}, self.table[:0]
        fresh = list(set(flat) - self.rows.keys())
        parts = [self.table]
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            parts.append(Lattice(part, self.path).forward(self.p))
            self.rows.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
        self.table = np.concatenate(parts) if fresh else self.table
        out = np.zeros((len(texts), self.p.shape[1]))
        if flat:
            scores = self.table[np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))]
            full = np.flatnonzero(n)
            out[full] = np.add.reduceat(scores, (np.cumsum(n) - n)[full], axis=0)
        return out, n


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` to the rows of ``docs``, by the column ``text`` alone.

    ``score`` is the share of the best language, at equal priors. A null text, one without a letter (Unicode category L),
    or a model without languages gives ``und`` and 0. Ties go to the first language in code point order. Columns of the
    input with the names of the results get ``input_`` before theirs. Rows keep to themselves, so repeated rows get equal
    results; an empty table gives no rows. Texts of any length are read whole.
    """
    langs, p, path = model
    docs, names = make_room(docs, ("lang_pred", "score"))
    text = names[text]
    schema = schema_of(docs).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(p)  # pieces of the fixed vocabulary by languages

    def run(batches):
        score = Scorer(shared.value, path)
        for batch in batches:
            texts = batch[text].to_pylist()
            logs, n = score(texts) if langs else (None, np.zeros(len(texts), np.int64))
            pred, top = ["und"] * len(n), np.zeros(len(n))
            if langs:
                best = logs.argmax(axis=1)
                top = np.where(n > 0, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                pred = [langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(top)], [*batch.schema.names, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = documents(spark, sf_dir)
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
