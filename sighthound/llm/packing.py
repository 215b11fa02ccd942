"""Packing tokens into sequences by concatenating and cutting."""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, make_room, materialize, quoted, schema_of, small_batches, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
WINDOW, END_ID = 2048, 1
#: Rows of two numbers that may be broadcast: 16 MB.
FEW = 1_000_000
#: White-space separated chunks that a Python worker keeps the ids of, and the longest it keeps.
KEPT, LONGEST = 800_000, 48
#: One word of Latin-1 letters, in lower case, and a stop or comma behind it: one or two pre-tokens, whatever stands around.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """Byte-level pre-tokenization's letter for each byte: printable ones stand for themselves, the others go from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


#: What a tokenizer file must say for the short way (fixed values, as they stand in it).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splits_words(path: str) -> bool:
    """Whether a tokenizer lower-cases and splits at white space and around letters, so that chunks between white space are independent."""
    with open(path, "rb") as f:
        told = json.load(f)
    steps = lambda part, inner: (told.get(part) or {}).get(inner)
    plain = not told["model"].get("dropout") and told["model"].get("type") == "BPE" and not told.get("truncation") and not told.get("padding")
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in told.get("added_tokens") or [])
    return plain and special and steps("normalizer", "normalizers") == NORMALIZERS and steps("pre_tokenizer", "pretokenizers") == PRE_TOKENIZERS


class Encoder(dict):
    """Ids of texts under a tokenizer; a dict from UTF-8 chunk to little-endian ids that fills itself.

    Where the tokenizer lower-cases and splits words (``splits_words``), chunks between ASCII white space are encoded apart and
    kept: plain words need the tokenizer's model alone, the others go through the whole tokenizer. Under any other
    tokenizer whole texts do.
    """

    def __init__(self, path: str):
        import tokenizers

        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters, self.apart = self.tokenizer.model, _byte_letters(), splits_words(path)
        self.behind = {x: self.ids(x) for x in ".,"} | {"": b""}

    def ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            new = self.word(chunk.decode().lower())
        elif chunk[-1:] in (b".", b",") and chunk[:-1].isalpha():
            new = self[chunk[:-1]] + self.behind[chunk[-1:].decode()]
        elif m := PLAIN.fullmatch(chunk.decode().lower()):
            new = self.word(m[1].encode().decode("latin-1").translate(self.letters)) + self.behind[m[2]]
        else:
            new = self.ids(chunk.decode())
        if len(chunk) <= LONGEST:
            self[chunk] = new
        return new

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.apart:
            return [self.ids(t.decode()) for t in texts]
        if len(self) > KEPT:
            self.clear()
        # A-Z may go first where no special token's string and no mark to compose with a letter is near.
        split = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        return [b"".join(map(self.__getitem__, chunks)) for chunks in split]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: append ``ids`` (binary, little-endian unsigned 32-bit, the end id last), ``n_ids``, and the place of a
    row: its partition ``part`` and the ids before it there, ``before``. Null texts count as empty, texts are read whole;
    columns of the input with these names get ``input_`` before theirs."""
    docs, names = make_room(docs, ("ids", "n_ids", "part", "before"))
    text = names[text]
    path = tokenizer or tokenizer_path(TOKENIZER)
    schema = schema_of(docs).add("ids", "binary").add("n_ids", "long").add("part", "integer").add("before", "long")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, part, gone = encoder(path).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + end for x in encode([x or b"" for x in batch[text].cast(pa.binary()).to_pylist()])]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            before = gone + np.cumsum(n) - n
            gone += int(n.sum())
            new = [pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "ids", "n_ids", "part", "before"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second pass: cut the concatenation of all rows into windows, one row per piece.

    Sums of the partitions, added up in their order, give each partition's place; there is one row per partition, and they
    are broadcast where they are at most ``FEW``. A row over a window's end gives a piece on either side. Returns ``row`` (struct of the other
    columns), ``start``, ``length``, ``ids`` (of the piece), ``doc_tokens``, ``sequence_id``, ``offset``. Only the last
    sequence can be shorter than the window.
    """
    others = [c for c in tokens.columns if c not in ("ids", "n_ids", "part", "before")]
    sums = tokens.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = materialize(sums.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base")), "pack-sums")
    base = F.broadcast(base) if base.count() <= FEW else base
    placed = tokens.join(base, F.col("part") == F.col("p")).select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), "ids", (F.col("base") + F.col("before")).alias("at"))
    new = {"start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
    kinds = {pa.int64(): "long", pa.binary(): "binary"}
    schema = schema_of(placed.select("row"))
    for c, kind in new.items():
        schema = schema.add(c, kinds[kind])

    def run(batches):
        for batch in batches:
            take, pieces = [], []
            for i, (ids, at) in enumerate(zip(batch["ids"].to_pylist(), batch["at"].to_pylist(), strict=True)):
                n = len(ids) // 4
                edges = [at, *range((at // window + 1) * window, at + n, window), at + n]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    take.append(i)
                    pieces.append((a - at, b - a, ids[4 * (a - at) : 4 * (b - at)], n, a // window, a % window))
            rows = batch.column(batch.schema.get_field_index("row")).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array([p[k] for p in pieces], kind) for k, kind in enumerate(new.values()))], ["row", *new])

    return placed.mapInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenize, store the ids in the shared folder, and cut; see ``tokenize`` and ``cut``. An empty table gives no pieces.

    ``row`` holds the columns of the input but the text. Repeated rows are packed each, in the order of their partitions."""
    docs, names = make_room(docs, ("ids", "n_ids", "part", "before"))
    return cut(materialize(tokenize(docs, names[text], tokenizer).drop(F.col(quoted(names[text]))), "pack-ids", "snappy"), window)


def pieces(docs: DataFrame) -> DataFrame:
    """Pieces of documents, each with a checksum of its ids in place of the ids."""
    return pack(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pieces(documents(spark, sf_dir))
