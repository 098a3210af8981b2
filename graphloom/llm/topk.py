"""Operator 7: exact top-k search on a bit-sliced index.

Vectors become integers. A part of the rows (by hash of the id) is indexed as bit slices: for
each attribute, quantised to `bits` bits, one bitmap over the rows for each bit. A query adds
the slices of all attributes, weighted by its own integers, with carry-save adders on whole
bitmaps; negative weights add complemented slices. The sum's slices are searched from the most
significant one down for the k-th largest value, rows that quantisation cannot rule out are
selected by one more comparison of slices, and exact inner products decide among them.

Queries and rows meet in a grid of bounded parts (`rows_part` by `queries_part`), so neither
side is broadcast and every row is indexed; each cell returns k rows a query, of which a window
over the query keeps the k best. The result is exact: recall is 1.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows
without an id, take no part; vectors of another dimension are no candidates of a query; rows
with the query's id are its own; every other row is a candidate, repeats too; exact repeats of a
query row are asked once, and different vectors of one query id are ranked together; ties go to
the smaller id. Integers and scores beyond the range of a long are the nearest long. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

#: Rows and queries of one cell of the grid, and bits of a quantised attribute.
ROWS_PART, QUERIES_PART, BITS = 16_384, 2_048, 7
#: Most attribute values of a cell's rows: vectors of many attributes make smaller cells.
PART_VALUES = 1 << 22


def integers(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of long), dim: the vectors that take part, as integers."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    return good.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"), F.size(x).alias("dim"),
    )


class Index:
    """Bit slices of the quantised attributes of some rows."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.values, self.bits = values, bits
        n, d = values.shape
        self.largest = int(max(int(values.max()), -int(values.min())))
        # differences of 64-bit integers are exact as unsigned ones
        above = values.view(np.uint64) - values.min(axis=0).view(np.uint64)
        self.shift = max(0, int(above.max()).bit_length() - bits)
        self.words = -(-n // 64)
        level = (above >> np.uint64(self.shift)).astype(np.uint8).T
        padded = np.zeros((d, self.words * 64), np.uint8)
        self.slices = np.zeros((d, bits, self.words), np.uint64)
        for b in range(bits):
            padded[:, :n] = (level >> b) & 1
            self.slices[:, b] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        valid = np.zeros(self.words * 64, np.uint8)
        valid[:n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> np.ndarray:
        """Slices of sum |q_j| * u_j, where u_j is the level, or its complement for q_j < 0."""
        sign = np.where(query < 0, ~np.uint64(0), np.uint64(0))
        signed = self.slices ^ sign[:, None, None]
        size = np.abs(query)
        planes: list[list[np.ndarray]] = [[] for _ in range(self.bits + int(size.max()).bit_length() + len(query).bit_length() + 1)]
        for a in range(int(size.max()).bit_length()):
            held = signed[(size >> a) & 1 == 1]
            for b in range(self.bits):
                planes[a + b].append(held[:, b])
        out = []
        for p, parts in enumerate(planes):
            x = np.concatenate(parts) if parts else np.zeros((0, self.words), np.uint64)
            while len(x) > 1:
                third = max(1, len(x) // 3)
                a, b = x[:third], x[third : 2 * third]
                c = x[2 * third : 3 * third] if len(x) >= 3 else None
                half = a ^ b
                carry = a & b if c is None else (a & b) | (c & half)
                x = half if c is None else np.concatenate([half ^ c, x[3 * third :]])
                if p + 1 < len(planes):
                    planes[p + 1].append(carry)
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
        return np.stack(out)

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Numbers of all rows that may be among the k best."""
        slices = self.sums(query)
        sure, tied = np.zeros(self.words, np.uint64), self.valid.copy()
        limit = 0
        for p in range(len(slices) - 1, -1, -1):
            with_bit = sure | (tied & slices[p])
            n = int(np.bitwise_count(with_bit).sum())
            if n >= k:
                limit |= 1 << p
                tied = tied & slices[p]
            else:
                sure, tied = with_bit, tied & ~slices[p]
        # levels err by less than 1 (of 2**shift) for each unit of weight, to either side
        limit = limit - int(np.abs(query).sum()) if self.shift else limit
        if limit <= 0:
            return np.arange(len(self.values))
        above, equal = np.zeros(self.words, np.uint64), self.valid.copy()
        for p in range(len(slices) - 1, -1, -1):
            if limit >> p & 1:
                equal &= slices[p]
            else:
                above |= equal & slices[p]
                equal &= ~slices[p]
        marks = np.unpackbits((above | equal).view(np.uint8), bitorder="little")
        return np.flatnonzero(marks[: len(self.values)])

    def top(self, ids: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows that do not have the query's own id, exactly."""
        widest = max(int(query.max()), -int(query.min()))
        if not widest:
            found = np.arange(len(ids))
        elif widest * self.largest * len(query) >= 1 << 62:
            # sums that 64 bits may not hold: exact integers, kept within the range of a long at the end
            rows = np.flatnonzero(ids != own)
            exact = self.values[rows].astype(object) @ query.astype(object)
            score = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in exact], np.int64)
            best = np.lexsort((ids[rows], ~score))[:k]
            return ids[rows][best], score[best]
        else:
            found = self.candidates(query, min(len(ids), k + int((ids == own).sum())))
        found = found[ids[found] != own]
        score = self.values[found] @ query
        best = np.lexsort((ids[found], ~score))[:k]
        return ids[found][best], score[best]


SCHEMA = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, rows_part: int = ROWS_PART, queries_part: int = QUERIES_PART) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of each query.

    is_query is a condition on vec_id that states the query set.
    """
    rows = tb.written(integers(vectors, scale), "vectors")
    queries = rows.where(is_query).dropDuplicates(["dim", "vec_id", "v"])
    count, dim = rows.agg(F.count("*"), F.max("dim")).first()
    n_rows = max(1, -(-count // max(64, min(rows_part, PART_VALUES // (dim or 1)))))
    n_queries = max(1, -(-queries.count() // max(64, min(queries_part, PART_VALUES // (dim or 1)))))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # repeats of a row spread over the parts
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_rows))
    left = rows.select(spread.cast("int").alias("i"), parts(n_queries).alias("q"), "dim", "vec_id", "v")
    right = queries.select(parts(n_rows).alias("i"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_queries)).cast("int").alias("q"), "dim", "vec_id", "v")

    def cell(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if mine.num_rows and asked.num_rows:
            ids, values = _matrix(mine)
            index = Index(values)
            q_ids, q_values = _matrix(asked)
            for own, query in zip(q_ids, q_values, strict=True):
                found, score = index.top(ids, own, query, k)
                out_q.append(np.full(len(found), own))
                out_v.append(found)
                out_s.append(score)
        join = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
        return pa.table({"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)})

    best = left.groupBy("i", "q", "dim").cogroup(right.groupBy("i", "q", "dim")).applyInArrow(cell, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of the rows."""
    ids = rows.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, np.ascontiguousarray(flat.reshape(len(ids), -1))
