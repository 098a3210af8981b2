"""Operator 6: exact n-gram Jaccard join with signature trees.

A document's set holds its distinct `n`-word shingles as 64-bit hashes, under a key that the driver
draws for each run, so no words can be built to be taken for others. Documents with equal sets form
a class (named by a 64-bit hash of the set) and are compared once.

1. Prefixes. In one global order of the shingles, sets that overlap by `share` of either share
   at least l of the first (set size - least overlap + l) shingles. The order puts shingles
   that are frequent in a bounded sample last; it decides speed only, never results.
2. Candidates. Prefix shingles held by two classes or more are kept, and of the classes those
   that hold at least their l of them.
3. Stars. Each candidate class is compared exactly with one other class, the least of those it
   meets most often. The links give preliminary components, so large families of near copies
   are not expanded into pairs.
4. Trees. Classes of different components that meet at a prefix shingle are compared by
   signature trees: leaves are classes with a token bitmap and a size, nodes hold OR-combined
   bitmaps, size ranges and the least number of marked bits. Two trees are traversed together
   and node pairs are pruned by the largest overlap that they allow, or because all below is in
   one component. Of the pairs that remain, a first round compares only a forest of the most
   promising ones for each shingle, which joins families without listing their pairs. A second
   round compares exactly all that then still stand in different components and share enough
   prefix shingles. Where few classes meet, trees would have leaves only: their pairs are listed,
   counted over all shingles, and tested by bitmap afterwards. Sets go only to pairs that pass.
5. Components of all links, by least document id.

Shingles met by many classes are split into pieces by size and hash, and pairs of pieces are
separate groups where their sizes allow a link. Joins on a class or text that many rows share
are dealt over several tasks (`textbuf.join_hot`), and of equal texts one copy a partition moves.

Defined results: null, empty and wordless texts have the empty set and are linked with nothing;
texts of fewer than n words have one shingle, the whole sequence; repeated rows and equal sets
are linked; rows without an id belong to a component but never name it (null, if no row of it
has an id). Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb
from graphloom.llm.components import connected

SHINGLE, PERCENT = 5, 80
#: Documents and least count of the sample that orders shingles; bits of a class's bitmap;
#: classes at one prefix shingle that stay together; leaves below one node.
ORDER_ROWS, ORDER_LEAST, BITMAP, PIECE, FAN = 4_000, 8, 4_096, 512, 8
#: Rows of a cell up to which all its pairs are looked at without trees.
SMALL = 16
#: Most shingles that are put last (a bound of memory, not of results).
ORDER_MOST = 100_000


def shingle_sets(column: pa.Array, key: bytes, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offs = tb.flat(column)
    low = tb.lower_ascii(buf)
    starts, ends = tb.word_bounds(low, offs, tb.SPACED)
    words = tb.keyed_hashes(low, starts, ends, key)
    at = np.searchsorted(starts, offs).tolist()
    count = np.diff(at)
    place = np.arange(len(words))
    stop = np.repeat(at[1:], count)
    good = place[place + n <= stop]
    grams = np.zeros(len(words), np.uint64)
    grams[good] = tb.gram_hashes(words, good, n)
    out = []
    for i, size in enumerate(count.tolist()):
        if size >= n:
            out.append(np.unique(grams[at[i] : at[i + 1] - n + 1]))
        elif size:
            out.append(tb.gram_hashes(words[at[i] : at[i + 1]], np.zeros(1, np.int64), size))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """The fewest shingles that a set of this size shares with any set that it is linked to."""
    return -(-percent * size // 100)


def quota(size, percent: int = PERCENT):
    """l: how many prefix shingles linked sets share at least (the smaller of the two counts)."""
    return 1 + (size - -(-percent * size // 100)) // 5


def _key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a sorted set (of keyed hashes): its class, and what proves that a class is one set."""
    raw = xxhash.xxh3_128_intdigest(s.tobytes())
    return (raw & (2**64 - 1)) - 2**63, (raw >> 64) - 2**63


def frequent(docs: DataFrame, key: bytes, n: int = SHINGLE) -> np.ndarray:
    """Shingles of a bounded hash sample of documents that many of these hold, sorted."""
    step = max(1, docs.count() // ORDER_ROWS)
    few = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.length("text")).alias("h"))
    few = few.where(F.pmod("h", F.lit(step)) == 0).select("text")

    def count(batches):
        sets = [s for batch in batches for s in shingle_sets(tb.texts(batch.column(0)), key, n)]
        u, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["g", "c"])

    sums = few.mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") >= ORDER_LEAST)
    rows = sums.orderBy(F.desc("c"), "g").limit(ORDER_MOST).collect()
    return np.sort(np.array([r.g for r in rows], np.int64).view(np.uint64))


def described(docs: DataFrame, last: np.ndarray, key: bytes, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, k1, k2 (hashes of the text), size, k and proof (hashes of the set) and prefix of every document.

    The prefix stands once for each class in a block.
    """
    rows = tb.text_keys(docs, F.col("doc_id").cast("long").alias("doc_id"))

    def run(batches):
        for batch in batches:
            column = tb.texts(batch.column(3))
            for a, b in tb.blocks(column):
                sets = shingle_sets(column.slice(a, b - a), key, n)
                keys = [_key(s) for s in sets]
                seen, prefixes = set(), []
                for s, (k, _) in zip(sets, keys, strict=True):
                    if k in seen or not len(s):
                        prefixes.append(None)
                        continue
                    seen.add(k)
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        ordered = np.concatenate([s[~late], s[late]])
                    else:
                        ordered = s
                    prefixes.append(ordered[: len(s) - least_overlap(len(s), percent) + quota(len(s), percent)].view(np.int64))
                arrays = [*(batch.column(c).slice(a, b - a) for c in range(3)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[c] for x in keys], pa.int64()) for c in (0, 1)), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k1", "k2", "size", "k", "proof", "prefix"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, size long, k long, proof long, prefix array<long>")


def meetings(table: DataFrame, scratch: tb.Scratch, percent: int = PERCENT) -> DataFrame:
    """g, k, size, leader: prefix shingles that several classes hold, for the candidate classes."""
    # dealt out by shingle once, for the sums and for the join: both read all three columns, so one exchange serves both
    holds = table.where("prefix IS NOT NULL").select(F.explode("prefix").alias("g"), "k", "size").repartition("g")
    by_g = holds.groupBy("g").agg(F.min("k").alias("leader"), F.max("k").alias("last"), F.max("size").alias("most"))
    # a class may stand several times (once a block); rows of one shingle are together after the join
    met = holds.join(by_g.where("leader <> last AND most > 0").select("g", "leader"), "g").distinct()
    met = scratch.written(met, "met")
    enough = met.groupBy("k").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    enough = enough.where(F.col("n") >= F.expr(f"1 + (size - ceil({percent} * size / 100)) DIV 5")).select("k")
    return scratch.written(met.join(enough, "k"), "meetings")


def class_sets(docs: DataFrame, table: DataFrame, wanted: DataFrame, scratch: tb.Scratch, key: bytes, n: int = SHINGLE) -> DataFrame:
    """k, size, shingles, bitmap of the wanted classes, from one text each."""
    # the rows of a class are summed up where they are read, before they meet
    reps = table.groupBy("k").agg(F.min(F.struct("k1", "k2")).alias("t")).join(wanted, "k").select("k", "t.k1", "t.k2")
    reps = scratch.written(reps, "reps")
    held = tb.key_filter(reps, "k1")

    def run(batches):
        for batch in batches:
            column = tb.texts(batch.column(1))
            for a, b in tb.blocks(column):
                sets = shingle_sets(column.slice(a, b - a), key, n)
                arrays = [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "size", "shingles", "bitmap"])

    # copies go where texts meet their classes, so the sets need not be dealt out again
    texts = tb.one_copy(docs, held).repartition("k1", "k2").dropDuplicates(["k1", "k2"])
    made = texts.join(reps, ["k1", "k2"]).select("k", "text").mapInArrow(run, "k long, size long, shingles binary, bitmap binary")
    return scratch.written(made, "class_sets")


def bitmap(s: np.ndarray) -> np.ndarray:
    marks = np.zeros(BITMAP, np.uint8)
    marks[(s >> np.uint64(17)).astype(np.int64) & (BITMAP - 1)] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, scratch: tb.Scratch, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are linked, compared exactly. a may be in many pairs."""
    near = scratch.written(pairs.select("a", "b"), "pairs")
    bits = lambda c: sets.select(F.col("k").alias(c), F.col("size").alias(f"{c}_size"), F.col("bitmap").alias(f"{c}_bits"))
    rows = tb.join_hot(near, bits("a"), ["a"]).join(bits("b"), "b").select("a", "b", "a_size", "b_size", "a_bits", "b_bits")

    def alike(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(a), -1) for c in (4, 5)) if len(a) else (np.zeros((0, 1), np.uint64),) * 2
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(_may_link(a, b, x, y, percent)[0]))

    # signatures go to the pairs first, sets only to the pairs that these leave
    near = scratch.written(rows.mapInArrow(alike, "a long, b long"), "near")
    paired = tb.among(sets.select("k", "shingles"), tb.key_filter(near.select(F.explode(F.array("a", "b")).alias("k")), "k"))
    one = lambda c: paired.select(F.col("k").alias(c), F.col("shingles").alias(f"{c}_set"))
    rows = tb.join_hot(near, one("a"), ["a"]).join(one("b"), "b").select("a", "b", "a_set", "b_set")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _may_link(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of sizes a and b and bitmaps x and y may be linked, and the most that they share."""
    less_a = np.bitwise_count(x & ~y).sum(axis=1).astype(np.int64)
    less_b = np.bitwise_count(y & ~x).sum(axis=1).astype(np.int64)
    most = np.minimum(a - less_a, b - less_b)
    return 100 * most >= percent * (a + b - most), most


class Tree:
    """Levels of nodes over classes; node i has the children FAN * i to FAN * i + FAN - 1.

    A level holds OR-combined bitmaps, least and largest size, least number of marked bits, and
    least and largest component.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray, root: np.ndarray):
        marked = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, size, size, marked, root, root)]
        while len(self.levels[-1][0]) > 1:
            values = self.levels[-1]
            cut = np.arange(0, len(values[0]), FAN)
            ways = (np.bitwise_or, np.minimum, np.maximum, np.minimum, np.minimum, np.maximum)
            self.levels.append(tuple(way.reduceat(v, cut) for way, v in zip(ways, values, strict=True)))


def _shared_bits(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marked bits that rows a of x share with rows b of y, in parts of bounded memory."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 8192):
        out[i : i + 8192] = np.bitwise_count(x[a[i : i + 8192]] & y[b[i : i + 8192]]).sum(axis=1)
    return out


def join_trees(x: Tree, y: Tree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves of x, leaves of y, most overlap) of the pairs that signatures and components cannot rule out."""
    i, j = len(x.levels) - 1, len(y.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        xl, xh, xm, x0, x1 = (v[a] for v in x.levels[i][1:])
        yl, yh, ym, y0, y1 = (v[b] for v in y.levels[j][1:])
        # the most that a set below a node may share with any set below the other node
        shared = _shared_bits(x.levels[i][0], y.levels[j][0], a, b)
        most = np.minimum(np.minimum(xh - np.maximum(xm - shared, 0), yh - np.maximum(ym - shared, 0)), np.minimum(xh, yh))
        keep = (100 * most >= percent * np.maximum(xl, yl)) & (100 * xh >= percent * yl) & (100 * yh >= percent * xl)
        if not i and not j:
            keep &= 100 * most >= percent * (xh + yh - most)
        keep &= (x0 != x1) | (y0 != y1) | (x0 != y0)
        a, b = a[keep], b[keep]
        if not i and not j:
            return a, b, most[keep]
        split_x = i >= j
        level, tree, node = (i, x, a) if split_x else (j, y, b)
        first = node * FAN
        n = np.minimum(first + FAN, len(tree.levels[level - 1][0])) - first
        child = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if split_x:
            a, b, i = child, np.repeat(b, n), i - 1
        else:
            a, b, j = np.repeat(a, n), child, j - 1


def forest(a: np.ndarray, b: np.ndarray, worth: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that join as many components as all pairs do, the worthiest first."""
    _, label = np.unique(root, return_inverse=True)
    left = np.argsort(-worth, kind="stable")
    parent = list(range(int(label.max()) + 1)) if len(label) else []

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    picked: list[int] = []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.array(picked, np.int64)
        # the best pair of each component: pairs are sorted, so it is the first
        ends = np.stack([label[a[left]], label[b[left]]], axis=1).ravel()
        for e in np.unique(np.unique(ends, return_index=True)[1] // 2).tolist():
            u, v = find(int(label[a[left[e]]])), find(int(label[b[left[e]]]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                picked.append(int(left[e]))
        label = np.array([find(v) for v in range(len(parent))])[label]


def small_cells(cell: np.ndarray, k: np.ndarray, root: np.ndarray, size: np.ndarray, apart: np.ndarray, bits: np.ndarray, every: bool, percent: int = PERCENT) -> np.ndarray:
    """Pairs of many cells of a few rows each, at once: trees of one leaf level need no descent.

    Rows of a cell stand together; pairs need different roots and different values of apart.
    Not every: only the best pair of each row.
    """
    found_a, found_b, found_w = [], [], []
    for step in range(1, SMALL):
        i = np.flatnonzero(cell[:-step] == cell[step:])
        if not len(i):
            break
        j = i + step
        ok = (root[i] != root[j]) & (apart[i] != apart[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        for part in np.array_split(np.flatnonzero(ok), max(1, int(ok.sum()) // 8192)):
            a, b = i[part], j[part]
            good, most = _may_link(size[a], size[b], bits[a], bits[b], percent)
            found_a.append(a[good])
            found_b.append(b[good])
            found_w.append(most[good] / np.maximum(size[a][good] + size[b][good] - most[good], 1))
    if not found_a:
        return np.zeros((0, 2), np.int64)
    a, b, w = (np.concatenate(x) for x in (found_a, found_b, found_w))
    if not every and len(a):
        node, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
        order = np.lexsort((pair, -w[pair], node))
        first = np.unique(node[order], return_index=True)[1]
        best = np.unique(pair[order][first])
        a, b = a[best], b[best]
    return np.stack([np.minimum(k[a], k[b]), np.maximum(k[a], k[b])], axis=1)


def tree_pairs(met: DataFrame, sets: DataFrame, comp: DataFrame, every: bool, scratch: tb.Scratch, percent: int = PERCENT, piece: int | None = None) -> DataFrame:
    """Pairs (a, b) of classes of different components that signature trees cannot rule out.

    All of them that share enough prefix shingles, or (not every) a forest for each cell. Cells of up
    to SMALL classes list their pairs without signatures: a pair is shorter than the signatures of two
    rows, most pairs there share too few prefix shingles, and `verified` looks at the signatures of the
    rest. Of those (not every) each class keeps the one that it meets most often.
    """
    piece = piece or PIECE
    of = met.select("g", "k", "size").join(comp.select(F.col("node").alias("k"), "root"), "k", "left").select("g", "k", "size", F.coalesce("root", "k").alias("root"))
    mixed = of.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), (F.count("*") > piece).alias("many"))
    # classes of a shingle that many hold are told apart by size: linked ones are of one or neighbouring sizes
    level = F.when(F.col("many"), F.floor(F.log("size") / math.log(1.01 * 100 / percent))).otherwise(F.lit(0))
    rows = of.join(mixed.where("low <> high").select("g", "many"), "g").select("g", "k", "root", "many", level.alias("z"), "size")
    # a class of a small cell needs another one there of a size that allows a link; its neighbours by size tell
    near = Window.partitionBy("g").orderBy("size", "k")
    fits = (100 * F.lag("size").over(near) >= percent * F.col("size")) | (100 * F.col("size") >= percent * F.lead("size").over(near))
    small = rows.where("NOT many").withColumn("fits", fits).where("fits").drop("fits")
    small = small.withColumn("tiny", F.count("*").over(Window.partitionBy("g")) <= SMALL)
    # in a tiny cell a class lists those that come after it by size
    after = F.collect_list(F.when(F.col("tiny"), F.struct("k", "root", "size"))).over(near.rowsBetween(1, SMALL - 1))
    apart = lambda x: (x["root"] != F.col("root")) & (100 * F.col("size") >= percent * x["size"])
    small = small.withColumn("after", after).withColumn("after", F.transform(F.filter("after", apart), lambda x: x["k"])).where("NOT tiny OR size(after) > 0")
    hot = rows.where("many").withColumn("tiny", F.lit(False)).withColumn("after", F.array().cast("array<bigint>"))
    rows = scratch.written(small.unionByName(hot).drop("size"), "cells")
    listed = rows.where("tiny").select("k", F.explode("after").alias("o")).select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b"))
    rows = rows.where("NOT tiny").drop("tiny", "after")
    few = rows.where("NOT many").select("g", "k", "root", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("other"))
    cut = rows.where("many").groupBy("g", "z").agg(F.ceil(F.count("*") / piece).alias("n"))
    cuts = cut.select("g", "z", "n", F.lit(0).alias("side"))
    cuts = cuts.unionByName(cut.select("g", (F.col("z") - 1).alias("z"), "n", F.lit(1).alias("side"))).unionByName(cut.select("g", (F.col("z") + 1).alias("z"), "n", F.lit(-1).alias("side")))
    cuts = cuts.groupBy("g", "z").agg(*[F.max(F.when(F.col("side") == side, F.col("n"))).alias(name) for side, name in ((0, "same"), (1, "up"), (-1, "down"))])
    hot = tb.join_hot(rows.where("many"), cuts, ["g", "z"])
    # a piece is a size and a hash; every class goes to the pairs of pieces that hold its own
    code = lambda z, i: F.shiftleft(z.cast("long"), 32) + i
    ahead = lambda step, n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: code(F.col("z") + step, i))).otherwise(F.array().cast("array<bigint>"))
    own = code(F.col("z"), F.pmod(F.xxhash64("k"), F.col("same")))
    hot = hot.select("g", "k", "root", own.alias("own"), F.explode(F.concat(ahead(0, "same"), ahead(1, "up"), ahead(-1, "down"))).alias("other"))
    rows = few.unionByName(hot)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.join(sets.select("k", "size", "bitmap"), "k")
    rows = rows.select(F.xxhash64("g", low, high).alias("cell"), "g", low.alias("p"), high.alias("q"), "own", "k", "root", "size", "bitmap")
    width = BITMAP // 64

    def pairs(cells):
        k, root, size, own, low, high, bits = cells
        order = np.lexsort((size, root))
        k, root, size, own, bits = k[order], root[order], size[order], own[order], bits[order]
        if low == high:
            tree = Tree(bits, size, root)
            a, b, most = join_trees(tree, tree, percent)
            once = a < b
            a, b, most = a[once], b[once], most[once]
        else:
            p, q = np.flatnonzero(own == low), np.flatnonzero(own == high)
            if not len(p) or not len(q):
                return np.zeros((0, 2), np.int64)
            a, b, most = join_trees(Tree(bits[p], size[p], root[p]), Tree(bits[q], size[q], root[q]), percent)
            a, b = p[a], q[b]
        if not every and len(a):
            best = forest(a, b, most / (size[a] + size[b] - most), root)
            a, b = a[best], b[best]
        a, b = k[a], k[b]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

    def run(batches):
        rest = None
        for batch in (*batches, None):
            table = rest if batch is None else batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if table is None or not table.num_rows:
                continue
            cell, g = table.column("cell").to_numpy(), table.column("g").to_numpy()
            p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            end = len(cell) if batch is None else int(edge[-1]) if len(edge) else 0
            cuts = [0, *[int(e) for e in edge if e < end], end] if end else [0]
            number = {c: table.column(c).to_numpy() for c in ("k", "root", "size", "own", "p", "q")}
            column = table.column("bitmap").cast(pa.large_binary())
            _, offs, data = column.buffers()
            start = np.frombuffer(offs, np.int64)[column.offset]
            bits = np.frombuffer(data, np.uint8)[start : start + len(cell) * width * 8].view(np.uint64).reshape(len(cell), width)
            out = [np.zeros((0, 2), np.int64)]
            span = np.diff(cuts)
            few = np.repeat((span > 1) & (span <= SMALL), span)
            if few.any():
                own, numbers = np.where(number["p"] == number["q"], np.arange(len(cell)), number["own"])[:end], np.repeat(np.arange(len(span)), span)
                out.append(small_cells(numbers[few], number["k"][:end][few], number["root"][:end][few], number["size"][:end][few], own[few], bits[:end][few], every, percent))
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x > SMALL:
                    out.append(pairs((number["k"][x:y], number["root"][x:y], number["size"][x:y], number["own"][x:y], number["p"][x], number["q"][x], bits[x:y])))
            rest = table.slice(end) if batch is not None else None
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "g", "p", "q")
    met_at = dealt.mapInArrow(run, "a long, b long")
    if not every:
        counted = listed.groupBy("a", "b").agg(F.count("*").alias("n"))
        both = counted.unionByName(counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
        most = both.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
        return met_at.select("a", "b").unionByName(most.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    met_at = met_at.unionByName(listed).groupBy("a", "b").agg(F.count("*").alias("n"))
    need = sets.select("k", F.expr(f"1 + (size - ceil({percent} * size / 100)) DIV 5").alias("l"))
    # pairs of different components meet at every prefix shingle that they share
    counted = met_at.join(need.toDF("a", "la"), "a").join(need.toDF("b", "lb"), "b")
    return counted.where(F.col("n") >= F.least("la", "lb")).select("a", "b")


def members(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, k1, k2 (hashes of the text), n_shingles, component_id and root (a class that names
    the component; null for the empty set) of every document."""
    scratch, key = tb.Scratch(docs.sparkSession, "jaccard"), tb.new_key()
    table = scratch.written(described(docs, frequent(docs, key, n), key, n, percent), "described")
    met = meetings(table, scratch, percent)
    # prefixes are most of the table and serve no more
    table = scratch.written(table.drop("prefix"), "classes_of_texts")
    scratch.free("described")
    scratch.free("met")
    sets = class_sets(docs, table, met.select("k").distinct(), scratch, key, n)
    stars = met.where("k <> leader").groupBy("k", "leader").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    stars = stars.groupBy("k").agg(F.max_by("leader", F.struct("n", "leader")).alias("a"), F.first("size").alias("size"))
    stars = tb.join_hot(scratch.written(stars, "stars"), sets.select(F.col("k").alias("a"), F.col("size").alias("sa")), ["a"])
    stars = stars.where(100 * F.least("sa", "size") >= percent * F.greatest("sa", "size")).select("a", F.col("k").alias("b"))
    links = scratch.written(verified(stars, sets, scratch, percent), "links")
    roots = scratch.written(connected(links, scratch), "components")
    for every in (False, True):
        more = scratch.written(verified(tree_pairs(met, sets, roots, every, scratch, percent), sets, scratch, percent), "links")
        scratch.free("cells")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = scratch.written(connected(links, scratch), "components")
    classes = table.where("size > 0").groupBy("k").agg(F.min("doc_id").alias("least"), F.min("proof").alias("p"), F.max("proof").alias("q"))
    classes = scratch.written(classes, "classes")
    if not classes.where("p <> q").isEmpty():
        raise ValueError("two different sets share a 64-bit name; all results of this run would be in doubt")
    named = classes.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = scratch.written(named.join(names, "root").select("k", "component_id", "root"), "by_class")
    rows = table.select("doc_id", "k1", "k2", F.col("size").alias("n_shingles"), "k")
    full = tb.join_hot(rows.where("n_shingles > 0"), by_class, ["k"])
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    result = full.unionByName(empty, allowMissingColumns=True).select("doc_id", "k1", "k2", "n_shingles", "component_id", "root")
    return tb.finished(scratch, result, "members")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return members(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: the row of the least id, and of its
    texts the one of least hashes.

    Rows with one id and different texts are told apart by their texts, also where these are
    empty sets; repeated rows count as copies. Rows without an id stay.
    """
    found = members(docs, n, percent).where(F.col("doc_id").isNotNull()).select(F.struct("doc_id", "k1", "k2").alias("m"), "root")
    keep = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("m").alias("m")).select("m")
    keep = keep.unionByName(found.where(F.col("root").isNull()).select("m").distinct())
    keep = keep.select(F.col("m.doc_id").alias("i_"), F.col("m.k1").alias("k1"), F.col("m.k2").alias("k2"))
    rows = tb.text_keys(docs, F.struct(*docs.columns).alias("row_"), F.col("doc_id").cast("long").alias("i_")).drop("text")
    one = rows.join(keep, ["i_", "k1", "k2"], "left_semi").dropDuplicates(["i_", "k1", "k2"])
    return one.unionByName(rows.where(F.col("i_").isNull())).select(*[F.col("row_")[c].alias(c) for c in docs.columns])
