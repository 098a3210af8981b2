"""Operator 12: benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, lower-cased ASCII letters and everything beyond ASCII. The windows of
the benchmark (`width` words in a row of one item; an item of fewer words is one window) become
an index: a small table of hash bits, sorted window hashes, and the words behind them. It is
broadcast, and one pass over the documents looks up the hash of every window of theirs. Each hit
is then verified word by word, so equal hashes alone never count, and no hit is lost, as equal
words have equal hashes.

The index is made of at most `block_bytes` of benchmark text. A larger benchmark is dealt out to
blocks of that size; the documents are read once a block and the findings of a text united.

Defined results: null, empty and wordless texts have no words and no hits; null, empty and
wordless items have no windows; repeated documents are searched each, repeated items are one
where their ids are equal; items without an id hit words, but are not counted or named. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

WIDTH = 10
#: Benchmark text behind one broadcast index; a single longer item is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bits of a window hash that the first look-up sees.
_BITS = 22
RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "n_words long, ranges array<struct<start:bigint,end:bigint>>, items array<string>"


class _Words:
    """The normalised words of a block of texts."""

    def __init__(self, column: pa.Array):
        buf, self.offs = tb.flat(column)
        self.low = tb.lower_ascii(buf)
        self.starts, self.ends = tb.word_bounds(self.low, self.offs, tb.LOWERED)
        self.hashes = tb.word_hashes(self.low, self.starts, self.ends)
        self.count = tb.per_text(self.starts, self.offs)
        self.doc = np.repeat(np.arange(len(column)), self.count)
        self.stop = np.repeat(np.cumsum(self.count), self.count)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of so many words; none crosses the end of a text."""
        place = np.arange(len(self.starts))
        return place[place + size <= self.stop]

    def bytes_at(self, places: np.ndarray) -> list[bytes]:
        data = self.low.tobytes()
        return [data[a:b] for a, b in zip(self.starts[places].tolist(), self.ends[places].tolist(), strict=True)]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those of first[1], and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Index:
    """The different windows of some items, by size: sorted hashes, words, and the items of each."""

    def __init__(self, items: list[str | None], texts: list[str | None], width: int = WIDTH):
        named = sorted({i for i in items if i is not None})
        rank = {i: k for k, i in enumerate(named)}
        owner = np.array([rank.get(i, -1) for i in items], np.int64)
        self.items = np.array(named, object)
        words = _Words(tb.texts(pa.array(texts, pa.string())))
        self.number: dict[bytes, int] = {}
        self.ids = np.array([self.number.setdefault(w, len(self.number)) for w in words.bytes_at(np.arange(len(words.starts)))], np.int32)
        self.near = np.zeros(1 << _BITS, bool)
        self.sizes: dict[int, tuple[np.ndarray, ...]] = {}
        size = np.minimum(words.count, width)[words.doc] if len(words.doc) else words.doc
        for n in np.unique(size).tolist():
            place = words.windows(n)
            place = place[size[place] == n]
            of = owner[words.doc[place]]
            rows = self.ids[place[:, None] + np.arange(n)]
            _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            hashes = tb.gram_hashes(words.hashes, place[first], n)
            order = np.argsort(hashes, kind="stable")
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            pairs = np.unique(np.stack([new[which.ravel()], of])[:, of >= 0], axis=1)
            cut = np.searchsorted(pairs[0], np.arange(len(order) + 1))
            self.sizes[n] = (hashes[order], place[first][order], cut, pairs[1])
            self.near[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _verified(self, words: _Words, place: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
        """Do the words from each place on equal those of the window?"""
        spots = place[:, None] + np.arange(size)
        need, at = np.unique(spots, return_inverse=True)
        mine = np.array([self.number.get(w, -1) for w in words.bytes_at(need)], np.int64)
        return (mine[at.reshape(spots.shape)] == self.ids[window[:, None] + np.arange(size)]).all(axis=1)

    def search(self, column: pa.Array) -> tuple[_Words, np.ndarray, list[np.ndarray]]:
        """(words, is each hit, numbers of the items found) for a block of texts."""
        words = _Words(column)
        change = np.zeros(len(words.starts) + 1, np.int64)
        found: list[list[np.ndarray]] = [[] for _ in range(len(column))]
        for size, (hashes, first, cut, owners) in self.sizes.items():
            place = words.windows(size)
            grams = tb.gram_hashes(words.hashes, place, size)
            near = self.near[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]
            place, grams = place[near], grams[near]
            low = np.searchsorted(hashes, grams)
            n = np.searchsorted(hashes, grams, side="right") - low
            place, window = np.repeat(place, n), _spread(low, n)
            if not len(place):
                continue
            good = self._verified(words, place, first[window], size)
            place, window = place[good], window[good]
            np.add.at(change, place, 1)
            np.add.at(change, place + size, -1)
            pair = np.unique(np.stack([words.doc[place], window]), axis=1)
            for d in np.unique(pair[0]).tolist():
                w = pair[1][pair[0] == d]
                found[d].append(owners[_spread(cut[w], cut[w + 1] - cut[w])])
        none = np.zeros(0, np.int64)
        return words, np.cumsum(change[:-1]) > 0, [np.unique(np.concatenate(x)) if x else none for x in found]


def _runs(words: _Words, hit: np.ndarray) -> list[list[dict]]:
    """For each text, the runs of hit words, counted from 0."""
    base = np.cumsum(words.count) - words.count
    edge = np.ones(len(hit), bool)
    edge[1:] = ~hit[:-1] | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(hit & edge)
    last = np.ones(len(hit), bool)
    last[:-1] = edge[1:] | ~hit[1:]
    out: list[list[dict]] = [[] for _ in range(len(words.count))]
    for a, b in zip(first.tolist(), np.flatnonzero(hit & last).tolist(), strict=True):
        d = words.doc[a]
        out[d].append({"start": a - base[d], "end": b + 1 - base[d]})
    return out


def _block(index: Index, column: pa.Array) -> dict:
    words, hit, found = index.search(column)
    return {
        "n_words": words.count.astype(np.int64), "ranges": pa.array(_runs(words, hit), RANGES),
        "items": pa.array([index.items[x].tolist() for x in found], pa.list_(pa.string())),
    }


def indexes(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The index of each block of the benchmark, one after another (one at least)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("octet_length(text) > 0")
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block_")
        sums = rows.groupBy(block).agg(F.sum(F.octet_length("text")).alias("size"), F.count_distinct("item_id", "text").alias("kinds"))
        over = sums.where((F.col("size") > block_bytes) & (F.col("kinds") > 1)).agg(F.max("size")).first()[0]
        if over is None:
            break
        n *= 2 ** max(1, int(over // block_bytes).bit_length())
    for k in range(n):
        mine = rows.where(block == k).dropDuplicates(["item_id", "text"]).collect() if n > 1 else rows.dropDuplicates(["item_id", "text"]).collect()
        if mine or n == 1:
            yield Index([r.item_id for r in mine], [r.text for r in mine], width)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, ranges (runs of hit words, from 0, end exclusive) and items (ids, sorted) of every document."""
    spark = docs.sparkSession
    blocks = indexes(benchmark, width, block_bytes or BLOCK_BYTES)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        held = spark.sparkContext.broadcast(first)
        return tb.map_text(docs, lambda c: _block(held.value, c), SCHEMA)
    scratch = tb.Scratch(spark, "decontaminate")
    rows = scratch.written(tb.text_keys(docs, F.col("doc_id").cast("long").alias("doc_id")), "texts")
    once = scratch.written(rows.dropDuplicates(["k1", "k2"]).select("k1", "k2", "text"), "once")
    united = None
    for index in (first, second, *blocks):
        held = spark.sparkContext.broadcast(index)
        keyed = once.select(F.lit(0).alias("doc_id"), "k1", "k2", "text")
        mine = tb.map_text(keyed, lambda c, held=held: _block(held.value, c), SCHEMA, carried={"k1": F.col("k1"), "k2": F.col("k2")})
        mine = scratch.written(mine.where(F.size("ranges") > 0), "found")
        held.unpersist()
        united = mine if united is None else united.unionByName(mine)
    # a text's ranges and items are bounded by its words and by the benchmark
    merged = united.groupBy(F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2")).agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = tb.map_text(once.select(F.lit(0).alias("doc_id"), "k1", "k2", "text"), lambda c: {"n_words": _Words(c).count.astype(np.int64)}, "n_words long", carried={"k1": F.col("k1"), "k2": F.col("k2")})
    counted = counted.select(F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"), "n_words")
    kind = "array<struct<start:bigint,end:bigint>>"
    told = counted.join(merged, ["k1", "k2"], "left").select(
        "k1", "k2", "n_words", F.coalesce(_united("ranges"), F.array().cast(kind)).alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
    result = tb.join_hot(rows.select("doc_id", "k1", "k2"), told, ["k1", "k2"]).select("doc_id", "n_words", "ranges", "items")
    return tb.finished(scratch, result, "contaminated")


def _united(ranges: str):
    """Sorted ranges, those that touch or overlap made one."""
    return F.expr(f"""aggregate({ranges}, cast(array() AS array<struct<start:bigint,end:bigint>>), (done, r) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).end >= r.start
             THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, r.end))))
             ELSE concat(done, array(r)) END)""")


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, whole: bool = False, block_bytes: int | None = None) -> DataFrame:
    """The documents without their hit spans, or (whole) without the documents that have any.

    A span reaches from the first to the last byte of a run of hit words; what stands between
    words is kept. Rows are told apart by id and text. All columns stay.
    """
    keys = tb.text_keys(docs, F.struct(*docs.columns).alias("row_"))
    spark = docs.sparkSession
    once = tb.text_keys(docs).dropDuplicates(["k1", "k2"])
    scratch = tb.Scratch(spark, "cleaned")
    numbered = scratch.written(once.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    hits = contaminated(numbered, benchmark, width, block_bytes).where(F.size("ranges") > 0)
    hits = scratch.written(hits.join(numbered.select("doc_id", "k1", "k2"), "doc_id").select("k1", "k2", "ranges"), "hits")
    joined = tb.join_hot(keys, hits, ["k1", "k2"], "left")
    if whole:
        kept = joined.where("ranges IS NULL").select("row_.*")
        return tb.finished(scratch, kept, "cleaned")

    def run(batches):
        for batch in batches:
            column = tb.texts(batch.column(batch.schema.get_field_index("text")))
            for a, b in tb.blocks(column):
                words = _Words(column.slice(a, b - a))
                data = tb.flat(column.slice(a, b - a))[0].tobytes()
                base, out = np.cumsum(words.count) - words.count, []
                for i, ranges in enumerate(batch.column("ranges").slice(a, b - a).to_pylist()):
                    at, parts = int(words.offs[i]), []
                    for r in ranges or ():
                        parts.append(data[at : words.starts[base[i] + r["start"]]])
                        at = int(words.ends[base[i] + r["end"] - 1])
                    out.append(b"".join([*parts, data[at : words.offs[i + 1]]]).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([*(batch.slice(a, b - a).column(c) for c in ("k1", "k2")), pa.array(out, pa.string())], names=["k1", "k2", "cleaned_"])

    texts = numbered.join(hits, ["k1", "k2"]).select("k1", "k2", "text", "ranges").mapInArrow(run, "k1 long, k2 long, cleaned_ string")
    rows = tb.join_hot(keys.drop("text"), scratch.written(texts, "texts"), ["k1", "k2"], "left")
    out = rows.select(*[(F.coalesce("cleaned_", F.col("row_")[c].cast("string")) if c == "text" else F.col("row_")[c]).alias(c) for c in docs.columns])
    return tb.finished(scratch, out, "cleaned")


def digests(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return contaminated(docs, benchmark, width).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
