"""Operator 3: a quality classifier of histogram gradient-boosted trees.

Every text becomes about twenty document statistics (`statistics`, vectorised over blocks of
texts). Trees are grown on histograms of the binned statistics of a bounded sample of
labelled rows (`max_train_rows`, chosen by hash) and flattened into arrays, through which all
documents are scored level by level in numpy (`Forest.score`).

Defined results: null and empty texts are scored like any other (all statistics 0, the share of
different windows 1); repeated rows are scored each, and of several texts of an id the one of least
hash is learned from; of several labels of one document the smallest counts; rows with a null
id are held out and scored. Without labelled rows of both classes the score is the share of
label 1, or 0.5 without any. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

#: Bound of the labelled rows that train the trees.
MAX_TRAIN_ROWS = 20_000

NAMES = [
    "log_words", "log_lines", "word_bytes", "upper", "digit", "space", "beyond_ascii", "symbol",
    "bang", "bar", "sentence_end", "comma", "other_punctuation", "upper_words", "symbol_words", "bang_words",
    "long_words", "distinct_triples", "repeated_next", "repeated_lines", "line_words",
]

_CLASS = np.full(256, 9, np.uint8)
for _chars, _c in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"0123456789", 1), (b" \t\n\x0b\x0c\r", 2), (b"*#$%&<>@^~", 4), (b"!", 5), (b"|", 6), (b".?", 7), (b",;:", 8)):
    _CLASS[list(_chars)] = _c
_CLASS[128:] = 3
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 10
_LINE = tb.table(lambda b: b != 0x0A)


def _segments(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def statistics(column: pa.Array) -> np.ndarray:
    """One row of the statistics NAMES for each whole text."""
    buf, offs = tb.flat(column)
    n = len(column)
    size = np.diff(offs)
    kinds = _CLASS[buf]
    by_kind = [_segments(kinds == k, offs) for k in range(10)]
    starts, ends = tb.word_bounds(buf, offs, tb.SPACED)
    at = np.searchsorted(starts, offs)
    words = np.diff(at)
    hashes = tb.word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(n), words)
    length = ends - starts

    upper, symbol = np.zeros(len(buf) + 1, np.int64), np.zeros(len(buf) + 1, np.int64)
    bang = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(kinds == 0, out=upper[1:])
    np.cumsum(kinds == 4, out=symbol[1:])
    np.cumsum(kinds == 5, out=bang[1:])
    n_upper = upper[ends] - upper[starts]
    # the share of different 3-word windows hardly depends on the length of a text, that of words does;
    # equal hashes stand together once they are sorted by text and hash
    first = np.arange(max(len(hashes) - 2, 0))
    first = first[doc[first] == doc[first + 2]] if len(first) else first
    triples, t_doc = tb.gram_hashes(hashes, first, 3), doc[first]
    order = np.lexsort((triples, t_doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (triples[order][1:] != triples[order][:-1]) | (t_doc[order][1:] != t_doc[order][:-1])
    n_triples = np.bincount(t_doc, minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    l_starts, l_ends = tb.word_bounds(buf, offs, _LINE)
    lines = tb.per_text(l_starts, offs)
    l_hash, l_doc = tb.word_hashes(buf, l_starts, l_ends), np.repeat(np.arange(n), lines)
    l_order = np.lexsort((l_hash, l_doc))
    l_again = np.zeros(len(l_order), bool)
    l_again[1:] = (l_hash[l_order][1:] == l_hash[l_order][:-1]) & (l_doc[l_order][1:] == l_doc[l_order][:-1])

    of_bytes, of_words = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    by_doc = lambda flags: _segments(flags, at)
    rows = [
        np.log1p(words), np.log1p(lines), by_doc(length) * of_words,
        *(by_kind[k] * of_bytes for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)),
        by_doc((n_upper == length) & (length > 1)) * of_words,
        by_doc(symbol[ends] > symbol[starts]) * of_words,
        by_doc(bang[ends] > bang[starts]) * of_words,
        by_doc(length > 15) * of_words,
        (np.bincount(t_doc[order], weights=fresh, minlength=n) + (n_triples == 0)) / np.maximum(n_triples, 1),
        by_doc(again) * of_words,
        np.bincount(l_doc[l_order], weights=l_again, minlength=n) / np.maximum(lines, 1),
        words / np.maximum(lines, 1),
    ]
    return np.stack(rows, axis=1) if n else np.zeros((0, len(NAMES)))


@dataclass
class Forest:
    """Complete binary trees, flattened: node i of a tree has the children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            raw += leaf[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 64, rate: float = 0.15, least: float = 0.5) -> Forest:
    """Boosted trees on histograms of the binned columns; logistic loss."""
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    width = bins + 1
    flat_bin = binned + np.arange(x.shape[1]) * width
    feature, limit, leaf = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (x.shape[1] * width) + flat_bin).ravel()
            shape = (count, x.shape[1], width)
            g = np.bincount(key, np.repeat(grad, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(axis=2)
            h = np.bincount(key, np.repeat(hess, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain[(h < least) | (h_all - h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), width)
                if gain[k, f, cut] > 1e-9 and cut < len(cuts[f]):
                    feature[t, first + k], limit[t, first + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > limit[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
        leaf[t] = rate * g / (h + 1)
        raw += leaf[t][at]
    return Forest(base, feature, limit, leaf)


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train_ids(labels: DataFrame, label: str, keep, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, label): at most max_rows labelled rows that may be learned from, chosen by hash."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Forest:
    """Fits the trees on a bounded sample of the labelled rows outside the held-out fold."""
    ids = train_ids(labels, "quality", fold(F.col("doc_id"), 5) != 0, max_train_rows)
    # the ids are at most max_train_rows, so they may be broadcast
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    # of several texts of an id, the one of least hash is learned from
    least = {"h": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    stats = tb.map_text(mine, lambda c: {"x": pa.array(list(statistics(c)), pa.list_(pa.float64()))}, "x array<double>", carried=least)
    stats = stats.groupBy("doc_id").agg(F.min_by("x", "h").alias("x"))
    got = stats.join(F.broadcast(ids), "doc_id").orderBy("doc_id").select("x", "label").collect()
    x = np.array([r.x for r in got]).reshape(-1, len(NAMES))
    return fit(x, np.array([float(r.label > 0) for r in got]))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and the score of every whole text."""
    return tb.map_text(docs, lambda c: {"score": forest.score(statistics(c))}, "score double")


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = 0.3, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = score(docs, train(docs, labels, max_train_rows))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with all their columns.

    The score is added row by row to the batch that holds the text, so nothing is joined.
    """
    forest = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = tb.texts(batch.column(at))
            parts = [forest.score(statistics(column.slice(a, b - a))) for a, b in tb.blocks(column)]
            keep = np.concatenate([np.zeros(0), *parts]) >= accept
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
