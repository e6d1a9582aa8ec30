"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to cells around centres, and cells to blocks of bounded size, so a block holds
neighbours. A first search of a query's own cell gives it a floor, a k-th score that it has reached
already; what it has found there is kept, and the cell isn't searched again. A query block then meets only cells whose bound is not under its floors. A task gets
query blocks and a run of data blocks, builds a cover tree over each and walks pairs of nodes.

The inner products of all points below two nodes with centres c, covering radii r, angular radii a and
longest points m are at most cq.cx + rq|cx| + rx|cq| + rq rx, and at most mq mx cos(angle(cq, cx) - aq -
ax). A pair is dropped if either is under the worst k-th score of its queries, which only rises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import written

LEAF = 256
#: Scores are whole numbers, so rounding of a bound is well below this.
SLACK = 0.5


class Node:
    """Rows at[...] around a centre; what bounds need of the children is kept side by side."""

    __slots__ = ("angle", "angles", "at", "cell", "centre", "centres", "children", "longest", "longests", "norm", "norms", "radii", "radius")

    def __init__(self, points: np.ndarray, at: np.ndarray, centre: np.ndarray, radius: float):
        self.at, self.centre, self.radius = at, centre, radius
        self.norm = float(np.sqrt(centre @ centre))
        self.angle, self.longest = cone(points[at], centre)
        self.children: list[Node] = []

    def close(self) -> None:
        of = lambda name: np.array([getattr(c, name) for c in self.children])
        self.centres, self.radii, self.norms, self.angles, self.longests = of("centre"), of("radius"), of("norm"), of("angle"), of("longest")


def cone(points: np.ndarray, centre: np.ndarray) -> tuple[float, float]:
    """Greatest angle between points and centre, and length of the longest point; zero vectors have no angle."""
    length = np.sqrt((points * points).sum(1))
    own = float(np.sqrt(centre @ centre))
    if not own:
        return float(np.pi), float(length.max())
    some = length > 0
    cos = (points[some] @ centre) / (length[some] * own)
    return float(np.arccos(np.clip(cos.min(), -1, 1))) + 1e-7 if some.any() else 0.0, float(length.max())


def bounds(dot, norms, others, radii, other_radii, angles, longest):
    """Upper bound of the inner products below pairs of nodes: the lesser of ball and cone, but a cone gives no less than 0."""
    ball = dot + radii * others + other_radii * norms + radii * other_radii
    size = norms * others
    cos = np.divide(dot, size, out=np.ones(np.broadcast(dot, size).shape), where=size > 0)
    between = np.arccos(np.clip(cos, -1, 1)) - 1e-7
    return np.minimum(ball, longest * np.maximum(np.cos(np.clip(between - angles, 0, np.pi)), 0)) + SLACK


def leaf(points: np.ndarray, at: np.ndarray) -> Node:
    """A node without children around the mean of its rows."""
    centre = points[at].mean(0)
    return Node(points, at, centre, float(np.sqrt(((points[at] - centre) ** 2).sum(1)).max()))


def cover_tree(points: np.ndarray) -> Node:
    """A cover tree, levels of one kind merged: each level halves the covering distance.

    Children of a node lie farther apart than its level's distance and cover its points within it;
    the first child has the parent's centre. Few points, or points that are all alike, are a leaf.
    """

    def build(at: np.ndarray, centre: np.ndarray, away: np.ndarray) -> Node:
        radius = float(away.max())
        if len(at) <= LEAF or radius <= 1e-9 * (1 + float(np.abs(points[at[0]]).max())):
            return leaf(points, at)
        node = Node(points, at, centre, radius)
        reach = radius
        while True:
            reach /= 2
            if reach <= 1e-12 * radius:
                return leaf(points, at)
            groups, left, dist = [], np.arange(len(at)), away
            first = centre
            while len(left):
                near = dist <= reach
                if near.any():
                    groups.append((left[near], first, dist[near]))
                left = left[~near]
                if len(left):
                    first = points[at[left[0]]]
                    dist = np.sqrt(((points[at[left]] - first) ** 2).sum(1))
            if len(groups) > 1:
                break
        lone = [g for g in groups if len(g[0]) <= 4]
        for own, c, d in groups:
            if len(own) > 4:
                node.children.append(build(at[own], c, d))
        if lone:  # small groups share leaves, in order
            rest = np.concatenate([g[0] for g in lone])
            for k in range(0, len(rest), LEAF):
                node.children.append(leaf(points, at[rest[k : k + LEAF]]))
        node.close()
        return node

    centre = points.mean(0)
    return build(np.arange(len(points)), centre, np.sqrt(((points - centre) ** 2).sum(1)))


def forest(points: np.ndarray, cells: np.ndarray) -> Node:
    """A tree over points that come sorted by cell: one cover tree a cell below a common root."""
    root = leaf(points, np.arange(len(points)))
    for own in np.split(root.at, np.flatnonzero(np.diff(cells)) + 1):
        root.children.append(moved(cover_tree(points[own]), int(own[0])))
        root.children[-1].cell = int(cells[own[0]])
    root.close()
    return root


def moved(node: Node, by: int) -> Node:
    node.at = node.at + by
    for c in node.children:
        moved(c, by)
    return node


class Best:
    """The k best (score, id) so far of each query; ties go to the smaller id.

    floor: a k-th score that each query is known to reach elsewhere. `scored` counts pairs.
    """

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k, self.scored = ids, k, 0
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def kth(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[at, -1], self.floor[at])

    def worst(self, at: np.ndarray) -> float:
        return float(self.kth(at).min())

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score[i, j] of query at[i] and the row with ids[j]; a row isn't its own query's candidate."""
        self.scored += score.size
        score = np.where(self.ids[at][:, None] == ids[None, :], -np.inf, score)
        hit = np.flatnonzero(score.max(1) >= self.kth(at))
        if not len(hit):
            return
        rows = at[hit]
        s = np.concatenate([self.score[rows], score[hit]], 1)
        f = np.concatenate([self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        order = np.lexsort((f, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.found[rows] = np.take_along_axis(f, order, 1)


def search(queries: np.ndarray, tree: Node, data: np.ndarray, ids: np.ndarray, data_tree: Node, best: Best, same_cell: bool | None = None) -> None:
    """Adds the data's best to `best`; of forests only trees of one cell meet, or only trees of different ones, if same_cell says so."""
    length = np.sqrt((queries * queries).sum(1))

    def visit(q: Node, x: Node) -> None:
        if not x.children and not q.children:
            # Each query of the leaf by itself: a ball without radius, a cone without angle.
            own = bounds(queries[q.at] @ x.centre, length[q.at], x.norm, 0.0, x.radius, x.angle, length[q.at] * x.longest)
            at = q.at[own >= best.kth(q.at)]
            if len(at):
                best.offer(at, queries[at] @ data[x.at].T, ids[x.at])
            return
        # The wider node is opened, so that queries meet the nearest data first and floors rise early.
        if q.children and (not x.children or q.radius >= x.radius):
            bound = bounds(q.centres @ x.centre, q.norms, x.norm, q.radii, x.radius, q.angles + x.angle, q.longests * x.longest)
            for c, b in zip(q.children, bound.tolist(), strict=True):
                if b >= best.worst(c.at):
                    visit(c, x)
            return
        bound = bounds(x.centres @ q.centre, x.norms, q.norm, x.radii, q.radius, x.angles + q.angle, x.longests * q.longest)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < best.worst(q.at):
                break
            visit(q, x.children[k])

    if same_cell is None:
        visit(tree, data_tree)
        return
    for q in tree.children:
        bound = bounds(data_tree.centres @ q.centre, data_tree.norms, q.norm, data_tree.radii, q.radius, data_tree.angles + q.angle, data_tree.longests * q.longest)
        for k in np.argsort(-bound, kind="stable").tolist():
            x = data_tree.children[k]
            if (q.cell == x.cell) == same_cell and bound[k] >= best.worst(q.at):
                visit(q, x)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths, which the first byte tells."""
    size = next(n for n in (2, 4, 8) if not x.size or n == 8 or max(-int(x.min()) - 1, int(x.max())) < 1 << (8 * n - 1))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def unpacked(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell, f"<i{cell[0]}", offset=1).reshape(-1, width).astype("float64")


def packed_blocks(rows: DataFrame) -> DataFrame:
    """(block, ids binary, cells binary, vectors binary) of (vec_id, row, vector, cell, block)."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("row", "ascending")])
        vectors = np.asarray(table.column("vector").combine_chunks().flatten(), dtype="i8")
        ids = np.asarray(table.column("vec_id")).astype("<i8").tobytes()
        cells = np.asarray(table.column("cell")).astype("<i4").tobytes()
        return pa.table({"block": table.column("block")[:1], "ids": [ids], "cells": [cells], "vectors": [packed(vectors)]}, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("cells", pa.binary()), ("vectors", pa.binary())]))

    return rows.groupBy("block").applyInArrow(pack, "block long, ids binary, cells binary, vectors binary")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def centres_of(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Directions of `cells` cells: means of the sample's nearest vectors, begun by far ones. They shape the blocks only."""
    x = unit(sample)
    picked, near = [0], x @ x[0]
    for _ in range(min(cells, len(x)) - 1):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centres = x[picked]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where((total * total).sum(1, keepdims=True) > 0, unit(total), centres)
    order, left = [0], set(range(1, len(centres)))  # each next to the one nearest to it
    while left:
        rest = sorted(left)
        order.append(rest[int((centres[rest] @ centres[order[-1]]).argmax())])
        left.remove(order[-1])
    return centres[order]


def with_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (vec_id, row, vector) with the cell of the nearest direction, the angle to it and the length."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("vector").flatten(), dtype="float64").reshape(batch.num_rows, -1)
                cos = unit(x) @ centres.T
                length = np.sqrt((x * x).sum(1))
                angle = np.where(length > 0, np.arccos(np.clip(cos.max(1), -1, 1)) + 1e-7, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cos.argmax(1), pa.int32()), pa.array(angle), pa.array(length)], names=[*batch.schema.names, "cell", "angle", "length"])

    return rows.select("vec_id", "row", "vector").mapInArrow(run, "vec_id long, row long, vector array<long>, cell int, angle double, length double")


class Blocks:
    """Blocks of about block_rows rows in the order of cells: large cells have several, small neighbours share one."""

    def __init__(self, sizes: dict[int, int], cells: int, block_rows: int):
        self.rows = block_rows
        self.size = np.array([sizes.get(c, 0) for c in range(cells)], "i8")
        self.start = np.cumsum(self.size) - self.size

    def of(self, rows: DataFrame) -> DataFrame:
        pick = lambda values: F.element_at(F.lit(values.tolist()), F.col("cell") + 1)
        place = pick(self.start) + F.pmod(F.xxhash64("row"), F.greatest(pick(self.size), F.lit(1)))
        return rows.withColumn("block", F.floor(place / self.rows).cast("long"))

    def numbers(self, cells: np.ndarray) -> np.ndarray:
        """The blocks that hold rows of these cells."""
        own = [np.arange(self.start[c] // self.rows, (self.start[c] + self.size[c] - 1) // self.rows + 1) for c in cells if self.size[c]]
        return np.unique(np.concatenate(own)) if own else np.zeros(0, "i8")


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, query_rows: int = 1024, block_rows: int = 1024, run_blocks: int = 16, cell_rows: int = 512, most_cells: int = 1024, scored: Accumulator | None = None) -> DataFrame:
    """The k rows of the highest inner product for each row whose vec_id is divisible by `every`.

    Components become floor(scale * x). Rows with a null id, a null vector or a null or non-finite
    component take no part. Candidates are all rows with another vec_id; repeated rows count as rows, as
    queries too. Inner products stay exact below 2**53; a component that leaves 64 bits is an error.
    Ties go to the smaller vec_id. A dimension of its own makes a search of its own: vectors of other
    lengths don't meet. Result: query_id, rank, vec_id, score.

    There are n / cell_rows cells, most_cells at most, around directions learned from 4 rows a cell,
    numbered so that neighbours follow each other;
    they decide what is compared early and skipped, never the result. The driver gets counts, angles and
    lengths by cell. Tasks get run_blocks query blocks and run_blocks data blocks at most. Each gives
    at most k rows a query, and a window over these keeps the best. `scored` counts the pairs whose
    inner product was taken.
    """
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = written(
        embeddings.where(good).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"), F.monotonically_increasing_id().alias("row")
        ),
        "vectors",
    )
    width = F.size("vector")
    sizes = {r["width"]: (r["n"], r["q"]) for r in rows.groupBy(width.alias("width")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    found = None
    for w, (n, q) in sorted(sizes.items()):
        if q:
            own = search_width(rows.where(width == w), w, every, k, query_rows, block_rows, run_blocks, max(1, min(most_cells, n // cell_rows)), scored)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Blocks of its own cells in which a query block looks for its floors, at most; they change no result.
NEAR_BLOCKS = 64


def search_width(rows: DataFrame, width: int, every: int, k: int, query_rows: int, block_rows: int, run_blocks: int, cells: int, scored: Accumulator | None) -> DataFrame:
    """(query_id, query_row, vec_id, score): candidates for the best of each query, over vectors of one length."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(4 * cells).select("vector").toArrow().column("vector").combine_chunks()
    centres = centres_of(np.asarray(sample.flatten(), dtype="float64").reshape(-1, width), cells)
    cells = len(centres)
    placed = written(with_cells(rows, centres), "cells")
    asks = F.col("vec_id") % every == 0
    state = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(asks).alias("q"), F.max("angle").alias("angle"), F.max("length").alias("longest")).collect()}
    data, asked = (Blocks({c: r[name] for c, r in state.items()}, cells, size) for name, size in (("n", block_rows), ("q", query_rows)))
    d_blocks = written(packed_blocks(data.of(placed)), "blocks")
    q_blocks = written(packed_blocks(asked.of(placed.where(asks))).withColumnsRenamed({"block": "q_block", "ids": "q_ids", "cells": "q_cells", "vectors": "q_vectors"}), "queries")
    angles = np.array([state[c]["angle"] if c in state else 0.0 for c in range(cells)])
    longest = np.array([state[c]["longest"] if c in state else 0.0 for c in range(cells)])

    def near(batches):
        for pdf in batches:
            for q_block, cells in zip(pdf["q_block"], pdf["q_cells"], strict=True):
                own = data.numbers(np.unique(np.frombuffer(cells, "<i4")))
                yield pd.DataFrame({"q_block": q_block, "block": own[:: -(-len(own) // NEAR_BLOCKS)], "whole": len(own) <= NEAR_BLOCKS})

    seeds = q_blocks.select("q_block", "q_cells").mapInPandas(near, "q_block long, block long, whole boolean")
    seeds = d_blocks.join(seeds, "block").select(F.col("q_block").alias("for_block"), "whole", "ids", "cells", "vectors")
    floors = written(q_blocks.groupBy("q_block").cogroup(seeds.groupBy("for_block")).applyInPandas(floor_finder(width, k, scored), "q_block long, floors binary, whole boolean, ids binary, found binary, scores binary"), "floors")
    # Where all rows of a query's cell have been seen, they are kept, and the search leaves that cell out.
    own = floors.where("whole").select("q_block", "ids", "found", "scores").mapInPandas(kept_floors(k), CANDIDATES)
    floors = floors.select("q_block", "floors", "whole")
    asking = q_blocks.join(floors, "q_block")

    def open_cells(batches):
        for pdf in batches:
            for q_block, vectors, floor in zip(pdf["q_block"], pdf["q_vectors"], pdf["floors"], strict=True):
                queries = unpacked(vectors, width)
                length = np.sqrt((queries * queries).sum(1, keepdims=True))
                cos = np.clip(np.divide(queries @ centres.T, length, out=np.ones((len(queries), cells)), where=length > 0), -1, 1)
                bound = length * longest * np.maximum(np.cos(np.clip(np.arccos(cos) - 1e-7 - angles, 0, np.pi)), 0) + SLACK
                runs = np.unique(data.numbers(np.flatnonzero((bound >= np.frombuffer(floor)[:, None]).any(0))) // run_blocks)
                yield pd.DataFrame({"q_block": q_block, "run": runs})

    pairs = written(asking.select("q_block", "q_vectors", "floors").mapInPandas(open_cells, "q_block long, run long").withColumn("part", F.floor(F.col("q_block") / run_blocks)), "pairs")
    task = F.concat_ws(":", F.col("run").cast("string"), F.col("part").cast("string"))
    right = d_blocks.withColumn("run", F.floor(F.col("block") / run_blocks))
    right = right.join(pairs.select("run", "part").distinct(), "run").select(task.alias("task"), "ids", "cells", "vectors")
    left = asking.join(pairs, "q_block").select(task.alias("task"), "q_block", "q_ids", "q_cells", "q_vectors", "floors", "whole")
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(searcher(width, k, scored), CANDIDATES).unionByName(own)


def data_forest(right: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, Node]:
    """Vectors, ids and tree of all data blocks of a task, by cell and id."""
    data = np.concatenate([unpacked(v, width) for v in right["vectors"]])
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in right["ids"]])
    cells = np.concatenate([np.frombuffer(x, "<i4") for x in right["cells"]])
    order = np.lexsort((ids, cells))
    return data[order], ids[order], forest(data[order], cells[order])


def searched(left: pd.DataFrame, right: pd.DataFrame, width: int, k: int, scored: Accumulator | None):
    """Number and best of each query block over the data blocks of a task; without floors, over its own cells only."""
    if left.empty or right.empty:
        return
    data, ids, tree = data_forest(right, width)
    none = [None] * len(left)
    told = zip(left["floors"], left["whole"], strict=True) if "floors" in left else zip(none, none, strict=True)
    for q_block, q_ids, q_cells, q_vectors, (floor, whole) in zip(left["q_block"], left["q_ids"], left["q_cells"], left["q_vectors"], told, strict=True):
        queries, best = unpacked(q_vectors, width), Best(np.frombuffer(q_ids, "<i8"), k, None if floor is None else np.frombuffer(floor))
        search(queries, forest(queries, np.frombuffer(q_cells, "<i4")), data, ids, tree, best, True if floor is None else False if whole else None)
        if scored is not None:
            scored.add(best.scored)
        yield q_block, best


def floor_finder(width: int, k: int, scored: Accumulator | None):
    """Function over a query block and data blocks of its cells: the k best that each query finds in its own cell.

    whole tells whether the blocks are all of those cells.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        whole = bool(right["whole"].all()) and not right.empty
        out = [(q_block, best.score[:, -1].astype("<f8").tobytes(), whole, best.ids.astype("<i8").tobytes(), best.found.astype("<i8").tobytes(), best.score.astype("<f8").tobytes()) for q_block, best in searched(left, right, width, k, scored)]
        return pd.DataFrame(out, columns=["q_block", "floors", "whole", "ids", "found", "scores"])

    return run


CANDIDATES = "query_id long, query_row long, vec_id long, score long"


def candidates(q_block: int, ids: np.ndarray, found: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    """Rows of CANDIDATES: what the queries of a block have found."""
    got = np.isfinite(score)
    number = (np.int64(q_block) << 32) + np.arange(len(got))
    return pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], got.shape)[got], "query_row": np.broadcast_to(number[:, None], got.shape)[got], "vec_id": found[got], "score": score[got].astype("int64")})


def kept_floors(k: int):
    def run(batches):
        for pdf in batches:
            for q_block, ids, found, score in zip(pdf["q_block"], pdf["ids"], pdf["found"], pdf["scores"], strict=True):
                yield candidates(q_block, np.frombuffer(ids, "<i8"), np.frombuffer(found, "<i8").reshape(-1, k), np.frombuffer(score, "<f8").reshape(-1, k))

    return run


def searcher(width: int, k: int, scored: Accumulator | None):
    """Function over some query blocks and a run of data blocks."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype="int64")]
        out += [candidates(q_block, best.ids, best.found, best.score) for q_block, best in searched(left, right, width, k, scored)]
        return pd.concat(out, ignore_index=True)

    return run
