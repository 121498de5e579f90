"""Near-duplicate embeddings by cosine similarity within labels.

Equal vectors are one node from the start. Spherical k-means, fitted on a sample
of each label, deals the label's nodes to about sqrt(nodes) / 2 cells, so cells
and their nodes grow together. Neighbouring cells are packed into blocks of about
``block_rows`` nodes or 32 MB (a larger cell is several blocks, by hash), one row each;
pairs of blocks are joined and products taken in double precision between cells.
No link is lost between cells: with a threshold t, linked unit vectors are at most
r = sqrt(2 - 2t) apart, so for v in cell h and w in cell c, v.(h - c) and
w.(c - h) are at most r |h - c|. Only the rows for which that holds are
multiplied. On vectors without clusters the products stay quadratic in a label.

A block pair yields, for each linked node, its number of links and the smallest
node of its group in that pair: at most one row a node, never the pairs. Counts
are summed and the groups joined by :func:`components`.

Bounds: a fit reads about ``SAMPLE_A_CELL`` rows a cell, chosen by hash, of one
label; a task holds two blocks, the centres of one label, or ``PLACED_ROWS`` rows.

Defined results: a vector that is null or empty, all zero, or holds null or
non-finite components, or whose label is null, links with nothing and is kept
with itself as component. Only vectors of equal length are compared. Repeated
rows are vectors of their own and link with each other. A null vec_id counts as
a vector for others, has a null component and is kept. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.llm.common import materialize, release
from textloom.llm.components import components

LEAST, BLOCK_ROWS, BLOCK_BYTES, PLACED_ROWS = 0.93, 8192, 32 << 20, 50_000
#: Nodes a cell, over the root of the label's nodes; sampled rows a cell; rounds; rows multiplied at once.
CELL_ROWS, SAMPLE_A_CELL, ROUNDS, TILE = 2.0, 16, 8, 1024


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, node, unit: unit is the normalised vector, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, dims, units = [], [], []
            for value, label in zip(batch.column(1), batch.column(2).to_pylist()):
                node = unit = dim = None
                inner = value.values
                if label is not None and inner is not None and len(inner) and not inner.null_count:
                    raw = inner.to_numpy(zero_copy_only=False).astype("<f8")
                    length = np.sqrt(raw @ raw) if np.isfinite(raw).all() else 0.0
                    if length and np.isfinite(length):
                        dim, unit = len(raw), (raw / length).tobytes()
                        node = hashlib.md5(str(label).encode() + b"|" + raw.tobytes()).digest()
                nodes.append(node)
                dims.append(dim)
                units.append(unit)
            columns = [batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dim", "node", "unit"])

    ready = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long"))
    return ready.mapInArrow(run, "vec_id long, label long, dim int, node binary, unit binary")


def spherical_k_means(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit ``rows``; starts from evenly spaced rows."""
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(rows[i : i + TILE] @ centres.T).argmax(axis=1) for i in range(0, len(rows), TILE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _matrix(units, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype="<f8").reshape(rows, -1)


def fit_cells(nodes: DataFrame, sizes: DataFrame, cell_rows: float = CELL_ROWS) -> DataFrame:
    """label, dim, centres (the bytes of a matrix) of every label; ``sizes`` has n, the label's nodes."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["node"].to_pylist(), dtype=object), kind="stable")
        rows = _matrix(table["unit"].to_pylist(), len(table))[order]
        found = spherical_k_means(rows, table["cells"][0].as_py())
        return pa.table({"label": table["label"][:1], "dim": table["dim"][:1], "centres": pa.array([found.tobytes()], pa.binary())})

    cells = F.greatest(F.lit(1), F.ceil(F.sqrt("n") / cell_rows)).cast("int")
    planned = sizes.select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), cells.alias("cells"), (cells * SAMPLE_A_CELL / F.col("n")).alias("part"))
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    sample = nodes.join(planned, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))).filter(chance < F.col("part"))
    return sample.select("label", "dim", "node", "unit", "cells").groupBy("label", "dim").applyInArrow(run, "label long, dim int, centres binary")


def in_cells(nodes: DataFrame, sizes: DataFrame, centres: DataFrame, placed_rows: int = PLACED_ROWS) -> DataFrame:
    """label, dim, cell, node, copies, unit: each node in its nearest cell (0 where the sample missed the label)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        units = _matrix(left["unit"].to_pylist(), len(left)) if len(left) else np.zeros((0, 1))
        home = np.zeros(len(left), dtype=np.int32)
        if len(right) and len(left):
            own = _matrix([right["centres"][0].as_py()], len(right["centres"][0].as_py()) // (8 * units.shape[1]))
            for i in range(0, len(left), TILE):
                home[i : i + TILE] = (units[i : i + TILE] @ own.T).argmax(axis=1)
        return left.select(["label", "dim", "node", "copies", "unit"]).append_column("cell", pa.array(home, pa.int32()))

    parts = F.ceil(F.col("n") / placed_rows).cast("int")
    dealt = sizes.select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), parts.alias("parts"))
    same = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    left = nodes.join(dealt, same).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("label", "dim", "part", "node", "copies", "unit")
    right = centres.join(dealt, same).select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centres")
    by = ("label", "dim", "part")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "label long, dim int, node binary, copies long, unit binary, cell int")


def in_blocks(placed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """label, dim, block, nodes, copies, units, cells, starts: one row a block, its nodes in the order of their cells."""

    def run(table: pa.Table) -> pa.Table:
        cells = table["cell"].to_numpy()
        order = np.argsort(cells, kind="stable")
        found, starts = np.unique(cells[order], return_index=True)
        rows = table.take(pa.array(order))
        one = {c: rows[c][:1] for c in ("label", "dim", "block")}
        packed = {c: pa.array([b"".join(rows[c].to_pylist())], pa.binary()) for c in ("node", "unit")}
        lists = {"copies": rows["copies"].to_numpy(), "cells": found, "starts": starts}
        return pa.table({**one, "nodes": packed["node"], "units": packed["unit"], **{k: pa.array([v.tolist()], pa.list_(pa.int64())) for k, v in lists.items()}})

    by_label = W.partitionBy("label", "dim").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("rows"))
    most = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * 8))))
    bundle = F.floor(F.coalesce(F.sum("rows").over(by_label), F.lit(0)) / most)
    sizes = sizes.select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), F.col("cell").alias("_cell"), bundle.alias("bundle"), F.ceil(F.col("rows") / most).alias("parts"))
    same = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    block = F.when(F.col("parts") > 1, F.concat_ws("/", "cell", part)).otherwise(F.concat(F.lit("b"), F.col("bundle")))
    dealt = placed.join(materialize(sizes, "cosine-sizes"), same).select("label", "dim", block.alias("block"), "cell", "node", "copies", "unit")
    schema = "label long, dim int, block string, nodes binary, units binary, copies array<long>, cells array<long>, starts array<long>"
    return dealt.groupBy("label", "dim", "block").applyInArrow(run, schema)


class _Groups:
    """Smallest index of each group of joined indices."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def find(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            top = self.parent[up]
            if (top == up).all():
                return up
            self.parent[at] = top

    def join(self, at: np.ndarray) -> None:
        roots = self.find(at)
        self.parent[roots] = roots.min()


def block_links(one: dict, other: dict | None, centres: np.ndarray | None, least: float) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """Nodes with links, their numbers, and the smallest node of their group, between two blocks or within one."""
    blocks = [one] if other is None else [one, other]
    nodes = [b["nodes"][i : i + 16] for b in blocks for i in range(0, len(b["nodes"]), 16)]
    order = np.argsort(np.array(nodes, dtype=object), kind="stable")
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order] = np.arange(len(nodes))
    copies = np.concatenate([np.asarray(b["copies"], dtype=np.int64) for b in blocks])
    units = [_matrix([b["units"]], len(b["copies"])) for b in blocks]
    first = [0, 0 if other is None else len(one["copies"])]
    links, groups, reach = np.zeros(len(nodes), dtype=np.int64), _Groups(len(nodes)), float(np.sqrt(max(0.0, 2 - 2 * least)))

    def cells(i: int) -> list[tuple[int, int, int]]:
        starts = [*blocks[i]["starts"], len(blocks[i]["copies"])]
        return [(c, a, b) for c, a, b in zip(blocks[i]["cells"], starts, starts[1:])]

    def compare(rows: np.ndarray, columns: np.ndarray, same: bool) -> None:
        a, b = units[0], units[-1]
        for start in range(0, len(rows), TILE):
            some = rows[start : start + TILE]
            near = a[some] @ b[columns].T >= least
            if same:
                near[np.arange(len(some)), start + np.arange(len(some))] = False
            hit = np.flatnonzero(near.any(axis=1))
            if not len(hit):
                continue
            near = near[hit]
            left, right = some[hit] + first[0], columns + first[1]
            links[left] += near @ copies[right]
            if not same:
                links[right] += copies[left] @ near
            for i, row in zip(left, near):
                groups.join(np.append(rank[right[row]], rank[i]))

    for c, a1, b1 in cells(0):
        for d, a2, b2 in cells(len(blocks) - 1):
            if other is None and d < c:
                continue
            rows, columns = np.arange(a1, b1), np.arange(a2, b2)
            if c != d and centres is not None:
                apart = centres[c] - centres[d]
                limit = reach * np.linalg.norm(apart) + 1e-9
                rows, columns = rows[units[0][a1:b1] @ apart <= limit], columns[units[-1][a2:b2] @ -apart <= limit]
            if len(rows) and len(columns):
                compare(rows, columns, other is None and c == d)
    kept = np.flatnonzero(links)
    roots = order[groups.find(rank[kept])]
    return [nodes[i] for i in kept], links[kept], [nodes[i] for i in roots]


def linked(blocks: DataFrame, centres: DataFrame, least: float = LEAST) -> DataFrame:
    """node, links, root: of each node with links in a pair of blocks of a label."""
    fields = ("nodes", "units", "copies", "cells", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = np.frombuffer(row["centres"], dtype="<f8").reshape(-1, row["dim"]) if row["centres"] else None
                nodes, links, roots = block_links(row["one"], row["two"], own, least)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], names=["node", "links", "root"])

    whole = blocks.select("label", "dim", "block", F.struct(*fields).alias("one"))
    key = whole.select("label", "dim", "block")
    other = key.select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), F.col("block").alias("second"))
    pairs = key.join(other, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("block") < F.col("second"))).select("label", "dim", "block", "second")
    two = whole.withColumnsRenamed({"block": "second", "one": "two"})
    crossed = pairs.join(whole, ["label", "dim", "block"]).join(two, ["label", "dim", "second"]).select("label", "dim", "one", "two")
    both = whole.select("label", "dim", "one", F.lit(None).cast(two.schema["two"].dataType).alias("two")).unionByName(crossed)
    return both.join(centres, ["label", "dim"], "left").select("dim", "one", "two", "centres").mapInArrow(run, "node binary, links long, root binary")


def near_duplicates(vectors: DataFrame, least: float = LEAST, cell_rows: float = CELL_ROWS, block_rows: int = BLOCK_ROWS, placed_rows: int = PLACED_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    ready = materialize(prepared(vectors), "cosine-vectors")
    counted = ready.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    counted = materialize(counted.withColumnRenamed("node", "_node"), "cosine-nodes", small=True)
    same = (F.col("node") == F.col("_node")) & F.col("vec_id").eqNullSafe(F.col("first_id"))
    nodes = materialize(ready.join(counted, same).select("label", "dim", "node", "copies", "unit").dropDuplicates(["node"]), "cosine-distinct")
    sizes = materialize(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "cosine-labels", small=True)
    centres = materialize(fit_cells(nodes, sizes, cell_rows), "cosine-centres")
    placed = materialize(in_cells(nodes, sizes, centres, placed_rows), "cosine-cells")
    blocks = materialize(in_blocks(placed, block_rows), "cosine-blocks")
    found = materialize(linked(blocks, centres, least), "cosine-links")
    release(nodes, placed, blocks)
    groups = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked_nodes = groups.join(counted, F.col("node") == F.col("_node")).select("node", "root", "first_id")
    lowest = materialize(linked_nodes.groupBy("root").agg(F.min("first_id").alias("lowest")).withColumnRenamed("root", "_root"), "cosine-lowest", small=True)
    known = linked_nodes.join(lowest, F.col("root") == F.col("_root")).select("node", "lowest").join(links, "node")
    known = known.select(F.col("node").alias("_known"), "lowest", "links")
    named = counted.join(known, F.col("_node") == F.col("_known"), "left")
    named = materialize(named.select("_node", F.coalesce("lowest", "first_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "cosine-named", small=True)
    release(counted, found, groups, lowest)
    out = ready.join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


COSINE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(counts.n, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON v.vec_id = least.a LEFT JOIN counts ON v.vec_id = counts.a
"""
