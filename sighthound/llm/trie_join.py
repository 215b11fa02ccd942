"""N-gram Jaccard join with a prefix tree.

Sets of word shingles are ordered by how frequent their shingles are in all documents. Two sets that are similar enough
share a shingle among the rarest few of each (the prefix), so documents meet by those. All that meet at a shingle meet its
least member too, the pivot; sets of one pivot are stored in a trie, commonest shingles first, and probed: a shared path is
matched once, and a subtree is left when the remaining lengths can't reach the overlap that is needed.
"""

from __future__ import annotations

from bisect import bisect_right
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, materialize, quoted, small_batches, utf8
from .components import components
from .shingles import shingle_sets

#: Counters of the frequency sketch and the slices in which they travel; its size is fixed: 8 MB.
COUNTERS, SLICE = 1 << 20, 1 << 14
#: Sets in one trie, and shingles of all of them (8 MB of text or so, some 80 MB as lists). Larger groups are cut into chunks; members of
#: different chunks are joined chunk by chunk. A set of more shingles has a chunk of its own.
CHUNK, WEIGHT = 1024, 1 << 21
#: Tokens on one edge at most, so that a long edge can be left early.
EDGE = 48
#: Rare shingles that similar sets must share (or all that they need to have in common, where that is less), and the
#: largest group at one shingle whose pairs are counted; sets of larger groups meet by the pivot however few they share.
SHARE, SMALL = 8, 8
#: Most members that a runtime filter is laid out for, and its most bits.
MEMBERS, FILTER_BITS = 1 << 22, 1 << 25
NO_ID = -(1 << 63)
#: A word, as the shingles take them.
WORD = r"[^\x20\x09-\x0D]"


class Trie:
    """A path-compressed prefix tree over ascending rank lists."""

    def __init__(self, sets: list[list[int]]):
        order = sorted(range(len(sets)), key=sets.__getitem__)
        self.sizes = [len(s) for s in sets]
        self.edges: list[tuple[list[int], int, int, list[int], list[int]]] = []  # tokens, least size, most size, sets that end here, children
        self.roots = []
        stack = [(0, len(order), 0, self.roots)] if sets else []
        while stack:
            lo, hi, depth, place = stack.pop()
            first, last = sets[order[lo]], sets[order[hi - 1]]
            end = depth
            stop = min(len(first), len(last), depth + EDGE)
            while end < stop and first[end] == last[end]:
                end += 1
            sizes = [self.sizes[order[i]] for i in range(lo, hi)]
            here, i = [], lo
            while i < hi and len(sets[order[i]]) == end:
                here.append(order[i])
                i += 1
            children: list[int] = []
            place.append(len(self.edges))
            self.edges.append((first[depth:end], min(sizes), max(sizes), here, children))
            while i < hi:
                j, token = i + 1, sets[order[i]][end]
                while j < hi and sets[order[j]][end] == token:
                    j += 1
                stack.append((i, j, end, children))
                i = j

    def probe(self, ranks: list[int], percent: int) -> list[tuple[int, int]]:
        """Sets whose Jaccard similarity to ``ranks`` is ``percent`` or more, with the overlap."""
        n, own, found = len(ranks), set(ranks), []
        whole = 100 + percent
        stack = [(root, 0, 0) for root in self.roots]
        while stack:
            at, depth, match = stack.pop()
            tokens, least, most, here, children = self.edges[at]
            match += sum(map(own.__contains__, tokens))
            depth += len(tokens)
            left = n - bisect_right(ranks, tokens[-1]) if tokens else n
            size = min(max(depth + left, least), most)
            if whole * (match + min(left, size - depth)) < percent * (n + size):
                continue
            found += [(i, match) for i in here if whole * match >= percent * (n + self.sizes[i])]
            stack += [(c, depth, match) for c in children]
        return found


def order_key(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions that sort tokens from rare to frequent, equal counts by hash."""
    return np.lexsort((tokens, counts[(tokens >> np.uint64(44)).astype(np.int64)]))


def _groups(batches, keys: tuple[str, ...]):
    """Rows of sorted batches as (key, list of rows) for each run of equal keys, which may go over several batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
            if row[: len(keys)] != key:
                if rows:
                    yield key, rows
                key, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield key, rows


def _ranked(rows: list[tuple], counts: np.ndarray, k: int) -> dict[int, list[int]]:
    """Node to ascending ranks, commonest shingle first, of rows (node, text, ...). Rows whose text makes another node only share a hash with the one that is meant."""
    import xxhash

    sets = shingle_sets([r[1] for r in rows], k)
    sets = {r[0]: s for r, s in zip(rows, sets, strict=True) if np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) == r[0]}
    every = np.unique(np.concatenate(list(sets.values()))) if sets else np.zeros(0, np.uint64)
    rank = np.empty(len(every), np.int64)
    rank[order_key(every, counts)[::-1]] = np.arange(len(every))
    return {node: np.sort(rank[np.searchsorted(every, s)]).tolist() for node, s in sets.items()}


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def signatures(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, body, node, n)`` of every row, node being a 64-bit hash of its shingle set and body its ``body``, and the frequency sketch.

    The sketch counts the shingles of all sets in fixed counters by their hash's upper bits; tasks count apart, counts add up
    in two steps, and the driver gets the sums: 8 MB, whatever the input.
    """

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        counts, names = np.zeros(COUNTERS, np.int64), ["doc_id", "body", "node", "n", "slice", "counts"]
        for batch in batches:
            sets = shingle_sets(batch["text"].to_pylist(), k)
            counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS) if sets else 0
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["body"], pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), *none], names)
        at = range(0, COUNTERS, SLICE)
        part = TaskContext.get().partitionId()
        rows = [pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array([part] * len(at), pa.int64()), pa.array([None] * len(at), pa.int64()), pa.array([a // SLICE for a in at], pa.int32()), pa.array([counts[a : a + SLICE].astype("<i8").tobytes() for a in at], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, names)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, "<i8")
        for x in table["counts"].to_pylist():
            total += np.frombuffer(x, "<i8")
        return pa.table({"slice": table["slice"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = materialize(docs.mapInArrow(run, "doc_id long, body long, node long, n long, slice int, counts binary"), "shingle-sets")
    sums = rows.filter("slice is not null").withColumn("part", F.pmod("node", F.lit(256))).groupBy("slice", "part").applyInArrow(add, "slice int, counts binary")
    counts = np.zeros(COUNTERS, np.int64)
    for r in sums.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
    return rows.filter("slice is null").select("doc_id", "body", "node", "n"), counts


def meeting(docs: DataFrame, counts, k: int, percent: int) -> DataFrame:
    """Distinct ``(pivot, node)``, pivot below node: sets that share a prefix shingle, each with the least set of that shingle.

    Sets whose sizes alone rule a link out don't meet: a set enters the class of its size's logarithm and the next one, so
    sizes within the wanted ratio have a class in common. Prefixes are ``SHARE - 1`` shingles longer than one common
    shingle needs, so sets that link share ``SHARE`` of them: pairs that meet in small groups only, and too seldom, go.
    """

    def run(batches):
        import xxhash

        table, seen = counts.value, set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for s in shingle_sets(batch["text"].to_pylist(), k):
                node = xxhash.xxh3_64_intdigest(s.tobytes())
                if len(s) and node not in seen:
                    seen.add(node)  # exact copies within a task post once
                    tokens.append(s[order_key(s, table)[: len(s) - (percent * len(s) + 99) // 100 + SHARE]])
                    nodes.append(np.full(len(tokens[-1]), node, np.uint64))
                    sizes.append(np.full(len(tokens[-1]), len(s), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.concatenate(sizes))], ["token", "node", "n"])

    # Posts travel once: dealt by token, they are counted by token and then by token and size class where they lie.
    posts = docs.select("text").mapInArrow(run, "token long, node long, n int").repartition("token")
    token, group = Window.partitionBy("token"), Window.partitionBy("token", "size")
    size = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * float(np.log(100 / percent)))).cast("int")
    shared = posts.select("*", F.min("node").over(token).alias("least"), F.max("node").over(token).alias("most")).filter("least < most")
    shared = shared.select("token", "node", "n", size.alias("at")).select("*", F.explode(F.array("at", F.col("at") + 1)).alias("size"))
    met = shared.select("token", "size", "node", "n", (F.col("size") == F.col("at")).alias("own"), F.min("node").over(group).alias("pivot"), F.max("node").over(group).alias("most"), F.count("*").over(group).alias("m"))
    met = materialize(met.filter("pivot < most").drop("most"), "met")
    large = met.filter((F.col("m") > SMALL) & (F.col("pivot") < F.col("node"))).select("pivot", "node")
    pair = "transform(filter(g, b -> a.node < b.node and (a.own or b.own)), b -> struct(a.node as pivot, b.node as node, greatest(a.n, b.n) as n))"
    small = met.filter(F.col("m") <= SMALL).groupBy("token", "size").agg(F.collect_set(F.struct("node", "own", "n")).alias("g"))
    small = small.select(F.inline(F.expr(f"flatten(transform(g, a -> {pair}))"))).groupBy("pivot", "node").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    small = small.filter(F.col("c") >= F.least(F.lit(SHARE), F.ceil(F.col("n") * percent / 100))).select("pivot", "node")
    return large.unionByName(small).distinct()


@contextmanager
def runtime_filter(spark: SparkSession, members: int):
    """While this lasts, Spark makes its runtime filters however large the table is that they are made from.

    They keep texts without a part in a trie out of the exchange. Such a filter, of 16 bits a member, passes the driver
    several times, whole. It has 4 MB at most: from some 10 million members on it lets more and more other texts pass, at
    most all, once.
    """
    filters, items = "spark.sql.optimizer.runtime.bloomFilter", min(max(members, 1 << 10), MEMBERS)
    bits = min(16 * items, FILTER_BITS)
    wanted = {f"{filters}.enabled": "true", f"{filters}.applicationSideScanSizeThreshold": "0", f"{filters}.creationSideThreshold": "1000TB"}
    wanted |= {f"{filters}.expectedNumItems": str(items), f"{filters}.maxNumItems": str(items), f"{filters}.numBits": str(bits), f"{filters}.maxNumBits": str(bits)}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def links(docs: DataFrame, k: int, percent: int, chunk: int = CHUNK, weight: int = WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Sets of the rows ``(doc_id, body, text)`` and enough links between sets to connect all that links connect.

    Within a trie the pivot is probed first; sets that aren't connected to it yet are probed against all others. So every
    link between sets that don't already hang together by the pivot is found. Where a pivot's group is cut into chunks, the
    sets still apart are then probed against the tries of the other chunks.

    One row holds the text of each set: that of the least id and body. Rows alike in both, which would multiply in the
    join with the texts, are folded before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets, table = signatures(docs, k)
    counts = spark.sparkContext.broadcast(table)
    pairs = materialize(meeting(docs, counts, k, percent), "meeting")
    holders = sets.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "body")).alias("h"), F.first("n").alias("n"))
    holders = holders.select("node", F.col("h.doc_id").alias("holder"), F.col("h.body").alias("body"), "n")
    met = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("node")).distinct()).join(holders, "node")
    sizes = met.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / weight)).cast("int").alias("chunks"))
    members = met.filter("node <> pivot").join(sizes, "pivot").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    heads = met.filter("node = pivot").join(sizes, "pivot").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = materialize(members.unionByName(heads), "members")
    texts = docs.select(F.col("doc_id").alias("holder"), "body", "text")
    if not sets.groupBy("doc_id", "body").count().filter("count > 1").isEmpty():
        texts = texts.groupBy("holder", "body").agg(F.first("text").alias("text"))

    def within(batches):
        for (pivot, part), rows in _groups(batches, ("pivot", "chunk")):
            ranks = _ranked(rows, counts.value, k)
            nodes, forest, made = list(ranks), Forest(), []
            trie = Trie(list(ranks.values()))
            for node in sorted(nodes, key=lambda x: x != pivot):
                if node == pivot or forest.find(node) != forest.find(pivot):
                    made += [(pivot, part, node, nodes[i]) for i, _ in trie.probe(ranks[node], percent) if forest.join(node, nodes[i])]
            made += [(pivot, part, node, None) for node in nodes if forest.find(node) != forest.find(pivot)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["pivot", "chunk", "a", "b"])

    def across(batches):
        for (_, part), rows in _groups(batches, ("pivot", "chunk")):
            ranks = _ranked(rows, counts.value, k)
            probes = [r[0] for r in rows if r[2] and r[0] in ranks]
            nodes = [r[0] for r in rows if not r[2] and r[0] in ranks]
            trie, forest = Trie([ranks[x] for x in nodes]), Forest()
            made = [(x, nodes[i]) for x in probes for i, _ in trie.probe(ranks[x], percent) if forest.join(x, nodes[i])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], pa.int64()) for i in (0, 1)], ["a", "b"])

    def dealt(df: DataFrame) -> DataFrame:
        # The comparison always holds. Spark makes its runtime filter only from tables with a filter of their own.
        rows = df.filter(F.col("pivot") <= F.col("node"))
        return texts.join(rows, ["holder", "body"]).repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk")

    cut = members.filter("chunks > 1")
    total, chunks = members.agg(F.count("*"), F.max("chunks")).first()
    with runtime_filter(spark, total):
        made = materialize(dealt(members.select("holder", "body", "pivot", "chunk", "node")).select("pivot", "chunk", "node", "text").mapInArrow(within, "pivot long, chunk int, a long, b long"), "tries")
    found = made.filter("b is not null").select("a", "b")
    if (chunks or 1) == 1:
        return sets, found
    apart = made.filter("b is null").select("pivot", F.col("a").alias("node")).join(cut, ["pivot", "node"])
    blocks = apart.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / weight)).cast("int").alias("blocks"))
    block = F.concat_ws(":", "chunk", "block").alias("chunk")
    stored = cut.join(blocks, "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probing = apart.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int")).withColumnRenamed("chunk", "home")
    probing = probing.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("chunk <> home")
    columns = ["holder", "body", "pivot", block, "node"]
    tasks = materialize(stored.select(*columns, F.lit(False).alias("probe")).unionByName(probing.select(*columns, F.lit(True).alias("probe"))), "cross")
    with runtime_filter(spark, total):
        more = materialize(dealt(tasks).select("pivot", "chunk", "node", "text", "probe").mapInArrow(across, "a long, b long"), "cross-tries")
    return sets, found.unionByName(more)


def jaccard_rows(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK, weight: int = WEIGHT) -> DataFrame:
    """``(id, body, n, root)`` of every row: its id, a 64-bit hash of its text, the size of its set, and a number of the
    component that it is in, null where the set is empty. Repeated ids with different texts are rows of their own here."""
    read = F.col(quoted(text))
    docs = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("doc_id"), body_of(read).alias("body"), utf8(read).alias("text"))
    sets, found = links(docs, k, percent, chunk, weight)
    own = sets.join(components(found), "node", "left")
    return own.select(F.nullif("doc_id", F.lit(NO_ID)).alias("id"), "body", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))


def body_of(text: Column) -> Column:
    return F.xxhash64(utf8(text))


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK, weight: int = WEIGHT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: documents whose shingle sets have a Jaccard similarity of
    ``percent`` hundredths or more link, and a component is all that links reach, named by its smallest id.

    Texts without words have no set and link with nothing; repeated rows and equal texts link with each other. Rows without
    an id take part, and get the smallest id of their component, null if it has none. Rows of one id with different texts are
    rows of their own, each with its set and component. Other columns are left behind, whatever their names; an empty
    table gives no rows, and texts are read whole.
    """
    own = jaccard_rows(docs, k, percent, id_col, text, chunk, weight)
    least = own.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    full = own.filter("root is not null").join(least, "root").select("id", "n", "least").unionByName(own.filter("root is null").select("id", "n", F.col("id").alias("least")))
    return full.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component of ``jaccard_rows`` one row stays, that of the least id
    (rows without an id last), of equal ids that of the least hash of the text. Of rows alike in both one stays.

    Rows without words link with nothing and all stay. Columns stay as they are, whatever their names.
    """
    own = jaccard_rows(docs, k, percent, id_col, text).filter("root is not null")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("f")).select(F.col("f.id").alias("id"), F.col("f.body").alias("body")).distinct()
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).cast("long").alias("doc"), body_of(F.col(quoted(text))).alias("hash"), F.coalesce(F.regexp_like(F.col(quoted(text)), F.lit(WORD)), F.lit(False)).alias("words"))
    kept = rows.filter("words").join(first, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("body")), "left_semi")
    kept = kept.dropDuplicates(["doc", "hash"]).unionByName(rows.filter("not words"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles at a Jaccard similarity of 0.85."""
    return jaccard_classes(documents(spark, sf_dir), 4, 85)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 3], ' ') END AS gram
       FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS i FROM w WHERE len(words) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM o JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
 r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.least AS component_id
FROM documents AS d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT id, min(seen) AS least FROM r GROUP BY id) AS m ON d.doc_id = m.id
"""
