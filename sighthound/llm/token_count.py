"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, make_room, schema_of, small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Segments that a Python worker keeps the counts of, and the longest it keeps.
KEPT, LONGEST = 800_000, 48


class Merger(dict):
    """Counts of segments under one vocabulary; a dict from segment to count that fills itself."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        letters, longer = {x for x in self.ranks if len(x) == 1}, [x for x in self.ranks if len(x) > 1]
        if not all(letters.issuperset(x) for x in longer):
            raise ValueError("a piece has a character that is no piece itself")
        if any("▁" in x.lstrip("▁") for x in longer):
            raise ValueError("a piece goes on behind a word's start; segments would not be independent")
        #: Characters that no longer piece has end a segment and stand alone.
        self.alone = "" if any("\n" in x for x in longer) else "\n"
        self.pattern = re.compile(rf"▁*[^▁{self.alone}]+|▁+|[{self.alone}]" if self.alone else "▁*[^▁]+|▁+")

    def __missing__(self, segment: str) -> int:
        n = self.count(segment)
        if len(segment) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[segment] = n
        return n

    def count(self, segment: str) -> int:
        """Initial symbols less merges: pops the adjacent pair of lowest rank, the leftmost of equals, until none is left.

        A character outside the vocabulary falls back to its UTF-8 bytes, each an initial symbol.
        """
        ranks, n = self.ranks, len(segment)
        symbols = list(segment)
        count = sum(1 if c in ranks else len(c.encode()) for c in symbols)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := segment[i : i + 2]) in ranks]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            left, j = symbols[i], following[i]
            if not left or j >= n or len(left) + len(symbols[j]) != len(pair):
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = pair, ""
            following[i] = k = following[j]
            count -= 1
            if k < n:
                previous[k] = i
                if (right := pair + symbols[k]) in ranks:
                    heappush(heap, (ranks[right], i, right))
            if (h := previous[i]) >= 0 and (right := symbols[h] + pair) in ranks:
                heappush(heap, (ranks[right], h, right))
        return count

    def tokens(self, text: str) -> int:
        """Tokens of a text: a start of word goes before it, spaces are starts of words, and words merge independently."""
        return sum(map(self.__getitem__, self.pattern.findall("▁" + text.replace(" ", "▁")))) if text else 0


@lru_cache(1)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` to the rows; null and empty texts have 0 of each.

    Texts are counted whole. Columns of the input with the names of the results get ``input_`` before theirs. Rows keep to
    themselves, so repeated rows get equal results; an empty table gives no rows.
    """
    docs, names = make_room(docs, ("n_bytes", "n_tokens", "over_limit"))
    text = names[text]
    path = model or tokenizer_path(MODEL)
    schema = schema_of(docs).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        count = merger(path).tokens
        for batch in batches:
            texts = [x or "" for x in batch[text].to_pylist()]
            n = [count(x) for x in texts]
            new = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op2_token_count(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(documents(spark, sf_dir).select("doc_id", F.col("text"))).drop("text")
