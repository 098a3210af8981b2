"""Operator 13: vector code compression: product codes whose entries are searched by a GNAT.

Vectors become integers (floor of `scale` times each component) and are cut into `parts` equal
parts. Each part position has a codebook of `entries` entries, which starts as the parts of the
rows of the smallest ids and is refined over `rounds` rounds: every part goes to its nearest
entry, and each entry becomes the floored mean of its parts. Then all parts are coded.

The nearest entry is found by a geometric near-neighbour access tree over the codebook: a node's
split points divide its entries, and for each split point and child the range of distances from
the one to the other is kept. The distances of a query to the split points rule out whole
children, by strict inequality and with room for rounding, so entries that tie are always met;
whatever decides is an exact integer distance, ties to the lower index.

A round is one pass: a task sums up its parts by entry, so what is shuffled is a row an entry and
task, and the driver holds the codebooks only (`parts` x `entries` x part size integers).

Defined results: rows whose vector is null or holds null or non-finite components are dropped;
shorter vectors, also empty ones, count as continued by zeros up to the longest one (made a
multiple of `parts`); rows of one id are all coded, the lesser vector first where they start a
codebook, and rows without an id come last there; labels that are null belong together, as all
rows do where there is no such column. Errors beyond a long are the largest long. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, and entries up to which a node is a leaf.
FAN, LEAF = 8, 8
#: Rows that are searched together.
ROWS = 8_192
#: Room for the rounding of three square roots and two differences, relative to the largest of them.
ROOM = 2.0**-48
LONG = 2**63 - 1


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c, which are of one kind: float64 (integers
    so small that products are exact), int64 or Python integers."""
    if x.dtype == np.float64:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    out = np.zeros((len(x), len(c)), x.dtype)
    for k in range(x.shape[1]):
        step = x[:, k, None] - c[None, :, k]
        out = out + step * step
    return out


def _root(d: np.ndarray) -> np.ndarray:
    """Square roots as float64; integers beyond its range are infinite."""
    if d.dtype == object:
        d = np.array([float(v) if v < 1 << 1000 else np.inf for v in d.ravel()]).reshape(d.shape)
    return np.sqrt(d.astype(np.float64))


class Gnat:
    """A tree over the rows of entries."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None, fan: int = FAN, leaf: int = LEAF):
        self.index = np.arange(len(entries)) if index is None else index
        self.points = entries
        self.children: list[Gnat] = []
        if len(entries) <= max(leaf, 1):
            return
        # split points: each the farthest from those before
        picked = [0]
        far = squared(entries, entries[:1])[:, 0]
        while len(picked) < fan and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, squared(entries, entries[picked[-1:]])[:, 0])
        if len(picked) == 1:
            return
        self.splits = np.array(picked)
        apart = squared(entries, entries[self.splits])
        home = apart.argmin(axis=1)
        home[self.splits] = -1
        groups = [np.flatnonzero(home == j) for j in range(len(picked))]
        self.children = [Gnat(entries[g], self.index[g], fan, leaf) for g in groups]
        root = _root(apart)
        # ranges of an empty child rule it out
        self.low = np.array([[root[g, i].min() if len(g) else np.inf for g in groups] for i in range(len(picked))])
        self.high = np.array([[root[g, i].max() if len(g) else -np.inf for g in groups] for i in range(len(picked))])

    def nearest(self, x: np.ndarray, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of x; counted gets the distances made."""
        where, best = np.full(len(x), -1), np.zeros(len(x), x.dtype)
        self._visit(x, np.arange(len(x)), where, best, counted)
        return where, best

    def _better(self, index: np.ndarray, d: np.ndarray, rows: np.ndarray, where: np.ndarray, best: np.ndarray) -> None:
        """Takes over the least of d, ties to the lower index; index is ascending."""
        order = np.argsort(index, kind="stable")
        d, index = d[:, order], index[order]
        at = d.argmin(axis=1)
        least, of = d[np.arange(len(d)), at], index[at]
        old = best[rows]
        wins = ((where[rows] < 0) | (least < old) | ((least == old) & (of < where[rows]))).astype(bool)
        where[rows[wins]], best[rows[wins]] = of[wins], least[wins]

    def _visit(self, x: np.ndarray, rows: np.ndarray, where: np.ndarray, best: np.ndarray, counted: list[int] | None) -> None:
        if not len(rows) or not len(self.points):
            return
        seen = self.points[self.splits] if self.children else self.points
        d = squared(x[rows], seen)
        if counted is not None:
            counted.append(d.size)
        self._better(self.index[self.splits] if self.children else self.index, d, rows, where, best)
        if not self.children:
            return
        root, first = _root(d), d.argmin(axis=1)
        for j, child in enumerate(self.children):
            child._visit(x, rows[first == j], where, best, counted)
        for j, child in enumerate(self.children):
            near = _root(best[rows])[:, None]
            room = ROOM * np.maximum(np.maximum(root, near), np.where(np.isfinite(self.high[:, j]), self.high[:, j], 0))
            out = (root - self.high[:, j] > near + room) | (self.low[:, j] - root > near + room)
            child._visit(x, rows[(first != j) & ~out.any(axis=1)], where, best, counted)


@dataclass
class Codebooks:
    """One array of entries for each part position, with the kind of numbers that keeps distances exact."""

    books: list[np.ndarray]
    dim: int
    kind: str
    scale: int

    def trees(self) -> list[Gnat]:
        return [Gnat(b.astype(self.kind)) for b in self.books]

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes (a row each) stand for."""
        return np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (as text), unlabelled and v (array of double) of the rows that take part."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    label = F.col(label_col).cast("string") if label_col in vectors.columns else F.lit(None).cast("string")
    return vectors.where(x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(label, F.lit("")).alias("label"), label.isNull().alias("unlabelled"), x.cast("array<double>").alias("v")
    )


def _floor(values: np.ndarray, scale: int, kind: str) -> np.ndarray:
    """floor(scale * x) of doubles, as numbers of the kind."""
    if kind != "object":
        return np.floor(values * scale).astype(kind)
    # beyond 2^53 a double is an integer: Python's product cannot overflow
    flat = [int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale)) for v in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def _matrix(column: pa.Array, dim: int, scale: int, kind: str) -> np.ndarray:
    """The vectors as integers, continued by zeros up to dim components."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return _floor(out, scale, kind)


def _assigned(batches: Iterator[pa.RecordBatch], trees: list[Gnat], dim: int, scale: int, kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their matrix, entries of the parts, squared distances) of a few rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            mine = batch.slice(a, ROWS)
            x = _matrix(mine.column("v"), dim, scale, kind)
            found = [t.nearest(p) for t, p in zip(trees, np.split(x, len(trees), axis=1), strict=True)]
            yield mine, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(batches, trees, dim, scale, kind):
    """part, entry, n and the componentwise sums (decimal text: they may pass a long) of one task."""
    total: dict[tuple[int, int], list] = {}
    for _, x, where, _ in _assigned(batches, trees, dim, scale, kind):
        for k, part in enumerate(np.split(x, len(trees), axis=1)):
            order = np.argsort(where[:, k], kind="stable")
            entry, first, n = np.unique(where[order, k], return_index=True, return_counts=True)
            # the sums of a few thousand rows stay exact in each kind of number
            sums = np.add.reduceat(part[order], first, axis=0) if len(entry) else part
            for e, count, s in zip(entry.tolist(), n.tolist(), sums.tolist(), strict=False):
                old = total.setdefault((k, e), [0, [0] * part.shape[1]])
                old[0] += count
                old[1] = [u + int(v) for u, v in zip(old[1], s, strict=True)]
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()),
         pa.array([[str(v) for v in total[k][1]] for k in keys], pa.list_(pa.string()))],
        names=["part", "entry", "n", "sums"],
    )


def _means(mine: pa.Table) -> pa.Table:
    """The floored mean of one entry from the sums of the tasks."""
    n = sum(mine.column("n").to_pylist())
    sums = zip(*([int(v) for v in s] for s in mine.column("sums").to_pylist()), strict=True)
    return pa.table({"part": mine.column("part")[:1], "entry": mine.column("entry")[:1], "mean": pa.array([[str(sum(s) // n) for s in sums]], pa.list_(pa.string()))})


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of rows (as `kept` returns them)."""
    span = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    dim = max(parts, -(-(span.dim or 0) // parts) * parts)
    most = int(span.most or 0) * scale + scale
    size = 4 * most * most * dim
    # every sum of products below these bounds is exact; sums of ROWS rows are smaller than these
    kind = "float64" if size < 2**52 and most * ROWS < 2**52 else "int64" if size < 2**62 and most * ROWS < 2**62 else "object"
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    first = _matrix(start.column("v").combine_chunks(), dim, scale, kind)
    if not len(first):
        return Codebooks([], dim, kind, scale)
    books = Codebooks([b.copy() for b in np.split(first, parts, axis=1)], dim, kind, scale)
    for _ in range(rounds):
        task = partial(_sums, trees=books.trees(), dim=dim, scale=scale, kind=kind)
        sums = rows.select("v").mapInArrow(task, "part int, entry int, n long, sums array<string>")
        for r in sums.groupBy("part", "entry").applyInArrow(_means, "part int, entry int, mean array<string>").collect():
            books.books[r.part][r.entry] = [int(v) for v in r["mean"]]
    return books


def _codes(batches, trees, books):
    for mine, _, where, d in _assigned(batches, trees, books.dim, books.scale, books.kind):
        error = [min(int(sum(row)), LONG) for row in d.tolist()]
        arrays = [*(mine.column(c) for c in ("vec_id", "label", "unlabelled")), pa.array(list(where.astype(np.int32)), pa.list_(pa.int32())), pa.array(error, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "unlabelled", "codes", "error"])


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, unlabelled, codes (the entry of each part) and error of rows (as `kept` returns them)."""
    schema = "vec_id long, label string, unlabelled boolean, codes array<int>, error long"
    if not books.books:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(partial(_codes, trees=books.trees(), books=books), schema)


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    rows = kept(vectors)
    books = train(rows)
    scratch = tb.Scratch(vectors.sparkSession, "codes")
    coded = scratch.written(encoded(rows, books), "codes")
    wide = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = coded.groupBy("label", "unlabelled").agg(F.least(wide, F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    told = tb.join_hot(coded, sums, ["label", "unlabelled"])
    told = told.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
    return tb.finished(scratch, told, "codes")
