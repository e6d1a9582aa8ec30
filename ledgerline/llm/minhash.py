"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

Each permutation of the hash space keeps a set's least and its greatest value, so one evaluation
gives two signature values. Bands of signature values name candidates. Texts with the same words are
one class and go on as one row. Candidate classes are gathered to clusters, which go in blocks of
bounded size; links are confirmed on whole sets, and what a first pass has joined isn't compared
again. The stars that each block leaves give the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import parts, written
from ledgerline.llm.components import components

WORDS = 5
#: Signature values in a band, and the chance that a pair at the threshold has no band in common.
ROWS, MISS = 6, 1e-6
#: Rows and shingles of a block that is compared in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
U = np.uint64


def bands_for(percent: int) -> int:
    """How many bands keep the chance of missing a pair at the threshold under MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (constants of a known finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def word_numbers(texts: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """For each text its words (between ASCII blanks, A to Z in lower case) joined by blanks, and their numbers.

    Words are made distinct over all the texts first, so each is hashed once. A text without words
    gives an empty text and no numbers.
    """
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(clean)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    numbers = np.fromiter(map(word_number, names), "u8", len(names))[coded.indices.to_numpy()]
    bound = lists.offsets.to_numpy().tolist()
    for joined, x, y in zip(pc.binary_join(lists, " ").to_pylist(), bound[:-1], bound[1:], strict=True):
        yield (joined, numbers[x:y]) if joined else ("", numbers[:0])


def shingles(w: np.ndarray) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct shingles of words with these numbers."""
    n = len(w)
    if not n:
        return np.zeros(0, "u8")
    size = min(n, WORDS)
    count = n - size + 1
    h = np.full(count, size, "u8")
    for k in range(size):
        h = mixed((h + w[k : k + count]) * U(0x9E3779B97F4A7C15) + U(k + 1))
    return np.unique(h)


class MinMax:
    """Band keys of shingle sets, from least and greatest values under half as many permutations."""

    def __init__(self, bands: int):
        self.bands = bands
        self.permutations = -(-bands * ROWS // 2)
        rng = np.random.default_rng(20)
        self.flip = rng.integers(0, 2**63, self.permutations, "u8")
        self.factor = rng.integers(0, 2**63, self.permutations, "u8") << U(1) | U(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """All least values, then all greatest; a band doesn't mix the two of one permutation."""
        low, high = np.full(self.permutations, ~U(0)), np.zeros(self.permutations, "u8")
        for k in range(0, len(shingles), 1024):
            values = (shingles[k : k + 1024, None] ^ self.flip) * self.factor
            np.minimum(low, values.min(0), out=low)
            np.maximum(high, values.max(0), out=high)
        return np.concatenate([low, high])

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        values = self.signature(shingles)[: self.bands * ROWS].reshape(self.bands, ROWS)
        h = np.arange(self.bands, dtype="u8") + U(1)
        for k in range(ROWS):
            h = mixed((h + values[:, k]) * U(0x9E3779B97F4A7C15) + U(k))
        return h.view("i8")


def class_of(joined: str) -> bytes:
    """What texts with the same words in the same order share."""
    return hashlib.md5(joined.encode("utf-8", "surrogatepass")).digest()


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, class binary, n_shingles, bands) of each row, in one pass over the texts.

    class is the MD5 of the words in order; it is null, as are the bands, for texts without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMax(bands_for(percent))
        for batch in batches:
            for part in parts(batch, "text", 512):
                names, sizes, keys = [], [], []
                for joined, numbers in word_numbers(part.column("text")):
                    own = shingles(numbers)
                    names.append(class_of(joined) if joined else None)
                    sizes.append(len(own))
                    keys.append(hashing.keys(own) if joined else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "class", "n_shingles", "bands"])

    return docs.mapInArrow(run, "doc_id long, class binary, n_shingles long, bands array<long>")


def shingle_sets(docs: DataFrame, once: bool) -> DataFrame:
    """(class, shingles) of each row (text) that has words; with `once`, one a class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in parts(batch, "text", 512):
                names, sets = [], []
                for joined, numbers in word_numbers(part.column("text")):
                    name = class_of(joined)
                    if joined and name not in seen:
                        names.append(name)
                        sets.append(shingles(numbers).view("i8"))
                        if once:
                            seen.add(name)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["class", "shingles"])

    return docs.select("text").mapInArrow(run, "class binary, shingles array<long>")


def blocks_for(members, size):
    """How many blocks keep rows and shingles of a block within BLOCK_ROWS and BLOCK_SHINGLES on average."""
    return F.greatest(F.ceil(members / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")


def shared_counts(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n rows share; owner names the row of each value.

    Values that the same rows hold count together. Those of few rows are added pair by pair, those
    of many by a product of matrices, exact as all sums stay below 2 ** 53.
    """
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.r_[0, edge], np.r_[edge, len(values)]
    groups: dict[bytes, int] = {}
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        key = owner[a:b].tobytes()
        groups[key] = groups.get(key, 0) + 1
    shared = np.zeros((n, n))
    wide = []
    for key, count in groups.items():
        rows = np.frombuffer(key, owner.dtype)
        if 6 * len(rows) > n and n > 64:
            wide.append((rows, count))
        else:
            shared[np.ix_(rows, rows)] += count
    for k in range(0, len(wide), 512):
        some = wide[k : k + 512]
        held, weight = np.zeros((n, len(some))), np.array([c for _, c in some], float)
        for j, (rows, _) in enumerate(some):
            held[rows, j] = 1
        shared += (held * weight) @ held.T
    return shared


def links_in_blocks(percent: int):
    """Function over a block, or a pair of blocks: links between different known components, as stars around the least class.

    Of a pair of blocks only the pairs across are this task's.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        names = table.column("class").to_pylist()
        known = table.column("known").combine_chunks().dictionary_encode().indices.to_numpy()
        side = np.asarray(table.column("block"))
        column = table.column("shingles").combine_chunks()
        sizes = np.diff(np.asarray(column.offsets))
        shared = shared_counts(np.asarray(column.flatten()), np.repeat(np.arange(len(names), dtype="i4"), sizes), len(names))
        union = sizes[:, None] + sizes[None, :] - shared
        hit = np.triu(100 * shared >= percent * union, 1) & (known[:, None] != known[None, :])
        if side.min() < side.max():
            hit &= side[:, None] != side[None, :]
        root = list(range(len(names)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
        inner = [i for i in range(len(names)) if find(i) != i]
        left, right = [names[find(i)] for i in inner], [names[i] for i in inner]
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def classed(docs: DataFrame, column: str) -> DataFrame:
    """docs with the class of each text as a last column; null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 512):
                names = [class_of(joined) if joined else None for joined, _ in word_numbers(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.binary())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.BinaryType())]))


def grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n_shingles, ...) of each row, and (class, root, component_id) of each class.

    root is the least class that links reach; it names a component even where all its ids are null.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signatures(source, percent).withColumn("node", F.xxhash64("class")), "signatures")
    by_id = rows.where(F.col("class").isNotNull()).groupBy("class", "node", "doc_id").agg(F.min("n_shingles").alias("size"), F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copies")).alias("least")
    classes = by_id.groupBy("class", "node").agg(least, F.min("size").alias("size"))
    classes = written(classes.select("class", "node", F.col("least.doc_id").alias("first_id"), F.col("least.copies").alias("copies"), "size"), "classes")
    linked = components(links(source, rows, candidates(rows, classes), percent))
    final = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").select("class", "first_id", F.coalesce("root", "class").alias("root"))
    final = written(final, "roots")
    least = written(final.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    return rows, final.join(least, "root").select("class", "root", "component_id")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Words are runs between ASCII blanks with A to Z in lower case; a text's set has its distinct
    five-word shingles, or its whole words as one if it has fewer. Texts are linked if 100 times the
    intersection is at least `percent` times the union. component_id is the least doc_id that links
    reach; kept says that it is the row's own. Texts without words (null, empty, blank) have no
    shingles and no links. Repeated rows each give a row. Null doc_ids stay null, never name a
    component unless all its ids are null, and aren't kept. Other columns are left out.
    """
    rows, final = grouped(docs, percent)
    final = written(final.select("class", "component_id"), "members")
    out = rows.select("doc_id", "n_shingles", "class").join(final, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def clusters(keys: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes that share a key (node, key) with another node, directly or over others."""
    # Least and greatest are taken before the shuffle, so a band of very many rows is no hot key.
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where(F.col("hub") < F.col("other")).select("key", "hub")
    edges = keys.join(written(hubs, "bands"), "key").where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(edges).withColumnRenamed("root", "cluster")


def candidates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, node, first_id, copies, size, cluster) of the classes that share a band with another class.

    The graph's nodes are 64-bit hashes of classes: where two collide they land in one cluster,
    which costs a comparison and nothing else.
    """
    return written(classes.join(clusters(rows.select("node", F.explode("bands").alias("key"))), "node"), "candidates")


def sets_of(source: DataFrame, found: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """found with the shingles of each class, one row a class.

    Texts are read again for these classes only: by the class's least id, broadcast up to a million
    ids and joined by a shuffle beyond. An id may name several texts, so classes are matched as well.
    Where several rows have a class's id, or its ids are null, copies are dropped in the task
    and then by class, with partial aggregation; other classes need no such step.
    """
    lone = F.col("first_id").isNotNull() & (F.col("copies") == 1)
    out = None
    for some, once in ((found.where(lone), False), (found.where(~lone), True)):
        ids = written(some.select(F.col("first_id").alias("doc_id")).distinct(), "ids")
        n = ids.count()
        if not n:
            continue
        texts = source.join(F.broadcast(ids) if n <= broadcast_ids else ids, source["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        sets = shingle_sets(texts, once)
        if once:
            sets = sets.groupBy("class").agg(F.first("shingles").alias("shingles"))
        own = sets.join(some, "class")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else found.where("false").withColumn("shingles", F.lit(None).cast("array<long>"))


def compared(source: DataFrame, dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of dealt rows: candidates with known (a component's class), block and beside (blocks to meet)."""
    pairs = sets_of(source, dealt).withColumn("with", F.explode("beside"))
    pairs = pairs.select("class", "known", "shingles", "block", "cluster", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"))
    return written(pairs.groupBy("cluster", "p", "q").applyInArrow(links_in_blocks(percent), "a binary, b binary"), "links")


def dealt_once(rows: DataFrame, known) -> DataFrame:
    """rows of each cluster in blocks of bounded size, each row in one; `blocks` tells how many there are."""
    sizes = rows.groupBy("cluster").agg(blocks_for(F.count("*"), F.sum("size")).alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    return rows.join(written(sizes, "clusters"), "cluster").withColumn("block", own).withColumns({"beside": F.array("block"), "known": known})


def with_known(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with known: the least class of the component that links give, else the row's own."""
    linked = components(links).select(F.col("node").alias("class"), "root")
    return written(rows.join(linked, "class", "left").withColumn("known", F.coalesce("root", "class")), "known")


def links(source: DataFrame, rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among candidate classes, confirmed on full sets, enough for the components.

    Clusters go in blocks of bounded size, each compared in itself; that is all for a cluster of one
    block. Of larger ones, first a row of each component found meets those of the other blocks. Then
    only bands that still join different components matter: their rows are gathered anew, and those
    outside the largest component of a cluster meet all its rows, pair of blocks by pair of blocks.
    So a large group of near copies, found to be one component, is never compared all with all.
    """
    first = written(dealt_once(found, F.col("class")), "dealt")
    out = compared(source, first, percent)
    large = first.where(F.col("blocks") > 1).drop("blocks", "block", "beside", "known")
    if not large.limit(1).count():
        return out
    heads = with_known(large, out).where(F.col("root") == F.col("class")).drop("root", "known")
    out = out.unionByName(compared(source, written(dealt_once(heads, F.col("class")), "heads"), percent))
    state = with_known(large, out).drop("root", "cluster")
    keys = written(rows.select("node", F.explode("bands").alias("key")).join(state.select("node", "known"), "node").distinct(), "keys")
    mixed = keys.groupBy("key").agg(F.min("known").alias("a"), F.max("known").alias("b")).where(F.col("a") < F.col("b")).select("key")
    left = state.join(clusters(keys.join(written(mixed, "mixed"), "key").select("node", "key")), "node")
    return out.unionByName(compared(source, written(dealt_across(written(left, "left")), "dealt"), percent))


def dealt_across(rows: DataFrame) -> DataFrame:
    """rows in blocks so that any two of a cluster with different `known`, not both of the largest, meet in one task."""
    counts = rows.groupBy("cluster", "known").agg(F.count("*").alias("n"))
    largest = written(counts.groupBy("cluster").agg(F.max_by("known", F.struct("n", "known")).alias("most")), "largest")
    marked = written(rows.join(largest, "cluster").withColumn("major", F.col("known") == F.col("most")).drop("most"), "marked")
    of = lambda side: (F.count_if(side), F.sum(F.when(side, F.col("size")).otherwise(0)))
    sizes = marked.groupBy("cluster").agg(blocks_for(*of(~F.col("major"))).alias("minors"), blocks_for(*of(F.col("major"))).alias("majors"))
    hashed = F.xxhash64("class")
    block = F.when(F.col("major"), F.col("minors") + F.pmod(hashed, F.col("majors"))).otherwise(F.pmod(hashed, F.col("minors"))).cast("int")
    beside = F.sequence(F.lit(0), F.when(F.col("major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    return marked.join(written(sizes, "blocks"), "cluster").withColumns({"block": block, "beside": beside})
