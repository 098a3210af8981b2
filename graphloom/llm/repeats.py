"""Operator 4: substring deduplication by repeated-phrase automata.

A window is `width` consecutive words of one document; every word covered by a window whose
words also start elsewhere is removed. Comparing all windows would shuffle one row a word, so
windows are grouped by an anchor: the `gram`-word phrase of the window with the least hash.
Equal windows have equal anchors, and windows in a row mostly share one, so an anchor stands
for about a dozen windows, those that it *owns*; their words together are its *span*.

1. Candidates: the corpus is read once; (anchor, span hash, how often) are summed by anchor.
   Anchors seen once are done.
2. Spans: of the other anchors one copy of each different span is kept, as word hashes, with the
   number of times that it occurs. They are dealt to shards by anchor; the spans of a hot anchor
   are spread over several pieces of a shard.
3. Passages: a span that occurs twice is one. The windows of the other spans are counted by
   (anchor, window hash), and those seen twice are confirmed; confirmed windows in a row, cut from
   one span of the piece that holds them, make a passage.
4. Automata: each piece of a shard compiles the windows of its passages into an Aho-Corasick
   automaton over words and streams all its spans through it. Only the automaton says where a
   removed range is, word by word.
5. The ranges meet one copy of each different text, and what is kept of it goes to all its rows.

Documents are not streamed past the automata of all shards, which would grow with the square
of the corpus: only the spans around an anchor that recurs reach a shard, and no window can
recur outside of these.

Words are compared by 64-bit hashes under a key that the driver draws for each run
(`textbuf.keyed_hashes`), windows by two such hashes (of the anchor, and of all `width` words), so
no text can be built to be taken for another.

Defined results: null and empty texts have no words; repeated rows make each other's windows
recur; texts of fewer than `width` words stay whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

WIDTH, GRAM = 35, 8
#: Spans of a shard, and different spans of one anchor that stay together.
SHARD_SPANS, HOT_SPANS = 2_000, 500

RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def anchors(column: pa.Array, key: bytes, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """For each anchor of the texts: text number, first word, words of the span, anchor and span hash."""
    buf, offs = tb.flat(column)
    starts, ends = tb.word_bounds(buf, offs, tb.SPACED)
    words = tb.keyed_hashes(buf, starts, ends, key)
    count = tb.per_text(starts, offs)
    doc = np.repeat(np.arange(len(column)), count)
    stop = np.repeat(np.cumsum(count), count)
    place = np.arange(len(words))
    window = place[place + width <= stop]
    if not len(window):
        none = np.zeros(0, np.int64)
        return {"doc": none, "at": none, "size": none, "a": none, "s": none}
    whole = place[place + gram <= stop]
    grams = np.full(len(words), ~np.uint64(0))
    grams[whole] = tb.gram_hashes(words, whole, gram)
    seen = np.lib.stride_tricks.sliding_window_view(grams, width - gram + 1)
    least = window + np.argmin(seen[window], axis=1)
    opens = np.ones(len(window), bool)
    opens[1:] = (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)
    closes = np.append(opens[1:], True)
    first, last = window[opens], window[closes]
    base = np.cumsum(count) - count
    # all windows of a span hold its anchor, so its first and last window cover it
    both = tb.both_hashes(tb.gram_hashes(words, first, width), tb.gram_hashes(words, last, width))
    return {
        "doc": doc[first], "at": first - base[doc[first]], "size": last + width - first,
        "a": grams[least[opens]].view(np.int64), "s": tb.both_hashes(both, (last - first).astype(tb.U64)).view(np.int64),
    }


def _per_batch(docs: DataFrame, schema: str, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            column = tb.texts(batch.column(2))
            for a, b in tb.blocks(column):
                yield from make(batch.slice(a, b - a), column.slice(a, b - a))

    return tb.text_keys(docs).mapInArrow(run, schema)


def candidates(docs: DataFrame, key: bytes, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """a (anchor) and mixed (do its spans differ) for every anchor that occurs twice or more."""

    def make(_, column):
        x = anchors(column, key, width, gram)
        both, n = np.unique(np.stack([x["a"], x["s"]]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(n.astype(np.int64))], names=["a", "s", "n"])

    counted = _per_batch(docs, "a long, s long, n long", make)
    by_anchor = counted.groupBy("a").agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
    return by_anchor.where("n >= 2").select("a", (F.col("low") != F.col("high")).alias("mixed"))


def occurrences(docs: DataFrame, key: bytes, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """k1, k2, at, size, a, s, n: where anchors stand in the texts, each text once a block, n times there."""

    def make(batch, column):
        x = anchors(column, key, width, gram)
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        _, first, times = np.unique(np.stack([k1, k2]), axis=1, return_index=True, return_counts=True)
        n = np.zeros(len(k1), np.int64)
        n[first] = times
        keep = n[x["doc"]] > 0
        doc = x["doc"][keep]
        arrays = [k1[doc], k2[doc], *(x[c][keep] for c in ("at", "size", "a", "s")), n[doc]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["k1", "k2", "at", "size", "a", "s", "n"])

    return _per_batch(docs, "k1 long, k2 long, at long, size long, a long, s long, n long", make)


def _span_words(docs: DataFrame, chosen: DataFrame, key: bytes) -> DataFrame:
    """a, s, n, mixed, piece, pieces and the word hashes of chosen spans (k1, k2, spans: array of these, at and size)."""
    names = ["a", "s", "n", "mixed", "piece", "pieces"]

    def run(batches):
        for batch in batches:
            column, lists = tb.texts(batch.column(0)), batch.column(1)
            for a, b in tb.blocks(column):
                buf, offs = tb.flat(column.slice(a, b - a))
                starts, ends = tb.word_bounds(buf, offs, tb.SPACED)
                words = tb.keyed_hashes(buf, starts, ends, key)
                base = np.searchsorted(starts, offs[:-1])
                mine = lists.slice(a, b - a)
                spans, size = mine.flatten(), mine.value_lengths().to_numpy(zero_copy_only=False)
                at = np.repeat(base, size) + spans.field("at").to_numpy()
                end = at + spans.field("size").to_numpy()
                cut = pa.array([words[x:y].tobytes() for x, y in zip(at.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(spans.field(c) for c in names), cut], names=[*names, "words"])

    # each text once: it is moved once for that and the join
    texts = tb.one_copy(docs).dropDuplicates(["k1", "k2"])
    joined = texts.join(chosen, ["k1", "k2"]).select("text", "spans")
    return joined.mapInArrow(run, "a long, s long, n long, mixed boolean, piece int, pieces int, words binary")


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    return tb.gram_hashes(words, np.arange(len(words) - width + 1), width).view(np.int64)


def windows(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, w, piece, pieces, s, n: all windows of the spans."""
    names = ["a", "piece", "pieces", "s", "n"]

    def run(batches):
        for batch in batches:
            for a, b in tb.blocks(batch.column("words").cast(pa.large_binary())):
                part = batch.slice(a, b - a)
                words = part.column("words").to_pylist()
                size = np.array([len(x) // 8 for x in words], np.int64)
                flat = np.frombuffer(b"".join(words), tb.U64)
                many = size - width + 1
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(size) - size, many)
                arrays = [*(pa.array(np.repeat(part.column(c).to_numpy(), many)) for c in names), pa.array(tb.gram_hashes(flat, place, width).view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "w"])

    return spans.select(*names, "words").mapInArrow(run, "a long, piece int, pieces int, s long, n long, w long")


def confirmed(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, piece, s, w: the windows that occur twice or more, though no span of their piece does that
    holds them, with one span s of the piece that holds them."""
    # where all spans of an anchor are equal, nothing is to be counted
    held = windows(spans.where("mixed"), width)
    once = held.groupBy("a", "w", "piece", "pieces").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("s").alias("s"))
    plain = once.where("pieces = 1 AND n >= 2")
    # windows of hot anchors are summed over the pieces, of which each has one row a window
    spread = windows(spans.where("mixed AND pieces > 1"), width).groupBy("a", "w", "piece").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("s").alias("s"))
    spread = spread.withColumn("n", F.sum("n").over(Window.partitionBy("a", "w"))).where("n >= 2")
    return plain.select("a", "piece", "s", "w", "most").unionByName(spread.select("a", "piece", "s", "w", "most")).where("most < 2").drop("most")


def passages(spans: dict[tuple[int, int], np.ndarray], found: pa.Table, width: int = WIDTH) -> list[np.ndarray]:
    """The runs of confirmed windows (a, s, w), cut from their spans (a, s)."""
    mine: dict[tuple[int, int], list[int]] = {}
    for a, s, w in zip(found.column("a").to_pylist(), found.column("s").to_pylist(), found.column("w").to_pylist(), strict=True):
        mine.setdefault((a, s), []).append(w)
    out = []
    for key, ws in mine.items():
        words = spans[key]
        good = np.flatnonzero(np.isin(_windows(words, width), np.array(ws, np.int64)))
        out += [words[run[0] : run[-1] + width] for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)]
    return out


def locate(spans: list[np.ndarray], found: list[np.ndarray], whole: int = 0, width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each span, the ranges of words that windows of the passages cover, by an automaton.

    The first `whole` passages belong to anchors that have no other span: they occur as a whole or
    not at all, so each is one phrase of the automaton in place of its windows.

    Words of passages become symbols (code points beyond the surrogates), others the symbol 0,
    which no passage holds, so positions in a streamed span are words.
    """
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
    if not len(known):
        return [[] for _ in spans]

    def streams(lists: list[np.ndarray]) -> list[str]:
        flat = np.concatenate([np.zeros(0, np.uint64), *lists])
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        symbol = np.where(known[at] == flat, at + 1, 0)
        symbol = np.where(symbol < 0xD800, symbol, symbol + 0x800).astype("<u4")
        text = symbol.tobytes().decode("utf-32-le")
        cuts = np.cumsum([0] + [len(x) for x in lists]).tolist()
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    automaton = ahocorasick.Automaton()
    for k, text in enumerate(streams(found)):
        if k < whole:
            automaton.add_word(text, len(text))
        else:
            for i in range(len(text) - width + 1):
                automaton.add_word(text[i : i + width], width)
    automaton.make_automaton()
    out = []
    for text in streams(spans):
        ranges: list[tuple[int, int]] = []
        for end, size in automaton.iter(text):
            start = end + 1 - size
            if ranges and start <= ranges[-1][1]:
                ranges[-1] = (min(start, ranges[-1][0]), end + 1)
            else:
                ranges.append((start, end + 1))
        out.append(ranges)
    return out


def resolve(spans: DataFrame, width: int = WIDTH, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """a, s, ranges: the removed ranges of the spans, which the automata of the shards find."""
    shards = max(8, -(-spans.count() // shard_spans))
    shard = F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int").alias("shard")
    left = spans.select(shard, "piece", "a", "s", "n", "mixed", "words")
    right = confirmed(spans, width).select(shard, "piece", "a", "s", "w")

    def compiled(mine: pa.Table, found: pa.Table) -> pa.Table:
        a, s, n = (mine.column(c).to_pylist() for c in ("a", "s", "n"))
        words = [np.frombuffer(x, np.uint64) for x in mine.column("words").to_pylist()]
        mixed = mine.column("mixed").to_pylist()
        alone = [w for w, m in zip(words, mixed, strict=True) if not m]
        again = [w for w, times, m in zip(words, n, mixed, strict=True) if m and times > 1]
        cut = passages(dict(zip(zip(a, s, strict=True), words, strict=True)), found, width)
        got = locate(words, alone + again + cut, len(alone), width)
        ranges = pa.array([[{"start": x, "end": y} for x, y in r] for r in got], RANGES)
        return pa.table({"a": mine.column("a"), "s": mine.column("s"), "ranges": ranges})

    schema = "a long, s long, ranges array<struct<start:bigint,end:bigint>>"
    return left.groupBy("shard", "piece").cogroup(right.groupBy("shard", "piece")).applyInArrow(compiled, schema).where(F.size("ranges") > 0)


def removed_ranges(docs: DataFrame, scratch: tb.Scratch, width: int = WIDTH, gram: int = GRAM, hot_spans: int | None = None) -> DataFrame:
    """k1, k2, ranges: for each different text, the ranges of words to remove, those that touch made one."""
    hot_spans, key = hot_spans or HOT_SPANS, tb.new_key()
    known = scratch.written(candidates(docs, key, width, gram), "anchors")
    placed = scratch.written(occurrences(docs, key, width, gram).join(known, "a"), "places")
    # one copy of each different span, and how often it occurs
    copies = placed.groupBy("a", "s", "mixed").agg(F.min(F.struct("k1", "k2", "at", "size")).alias("one"), F.sum("n").alias("n"))
    copies = scratch.written(copies.select("a", "s", "mixed", "n", "one.*"), "copies")
    hot = copies.groupBy("a").agg(F.ceil(F.count("*") / hot_spans).cast("int").alias("pieces")).where("pieces > 1")
    dealt = tb.join_hot(copies, hot, ["a"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    piece = F.pmod(F.xxhash64("s"), F.col("pieces")).cast("int").alias("piece")
    spans_of = F.collect_list(F.struct("a", "s", "n", "mixed", piece, "pieces", "at", "size")).alias("spans")
    chosen = dealt.groupBy("k1", "k2").agg(spans_of)
    spans = scratch.written(_span_words(docs.select("text"), chosen, key), "spans")
    found = scratch.written(resolve(spans, width), "ranges")
    parts = tb.join_hot(placed.select("k1", "k2", "at", "a", "s"), found, ["a", "s"]).select("k1", "k2", "at", F.explode("ranges").alias("r"))
    parts = parts.select("k1", "k2", (F.col("at") + F.col("r.start")).alias("start"), (F.col("at") + F.col("r.end")).alias("end"))
    # ranges that touch are made one before they are gathered: what is gathered is shorter than the text
    before = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    runs = parts.withColumn("before", before).withColumn("run", opens).groupBy("k1", "k2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def kept_words(text_block: pa.Array, ranges: list) -> tuple[np.ndarray, list[int], list[bytes]]:
    """(words, removed words, kept words joined by one space) of each text."""
    buf, offs = tb.flat(text_block)
    starts, ends = tb.word_bounds(buf, offs, tb.SPACED)
    count = tb.per_text(starts, offs)
    base = np.cumsum(count) - count
    data = buf.tobytes()
    removed, kept = [], []
    for i, mine in enumerate(ranges):
        cover = np.zeros(count[i] + 1, np.int64)
        for r in mine or ():
            cover[r["start"]] += 1
            cover[r["end"]] -= 1
        stay = base[i] + np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        removed.append(int(count[i] - len(stay)))
        kept.append(b" ".join([data[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
    return count, removed, kept


def _finished(docs: DataFrame, kind: str, tell, width: int, gram: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row: texts are finished once, their rows joined to that."""
    scratch = tb.Scratch(docs.sparkSession, "repeats")
    ranges = removed_ranges(docs, scratch, width, gram)
    rows = tb.one_copy(docs).join(ranges, ["k1", "k2"], "left").select("k1", "k2", "text", "ranges")

    def run(batches):
        for batch in batches:
            column = tb.texts(batch.column(2))
            for a, b in tb.blocks(column):
                count, removed, kept = kept_words(column.slice(a, b - a), batch.column(3).slice(a, b - a).to_pylist())
                arrays = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array([tell(x) for x in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "n_words", "n_removed", kind])

    once = rows.mapInArrow(run, f"k1 long, k2 long, n_words long, n_removed long, {kind} string").dropDuplicates(["k1", "k2"])
    ids = scratch.written(tb.text_keys(docs, F.col("doc_id").cast("long").alias("doc_id")).drop("text"), "ids")
    result = tb.join_hot(ids, once, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", kind)
    return tb.finished(scratch, result, "repeats")


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay, joined by one space."""
    return _finished(docs, "kept", lambda x: x.decode("utf-8"), width, gram)


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return _finished(docs, "kept_sha256", lambda x: hashlib.sha256(x).hexdigest(), width, gram)
