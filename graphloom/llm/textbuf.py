"""Flat views of Arrow text columns, shared by the operators that run numpy inside tasks.

Spark partitions the rows; these helpers only look at one Arrow batch at a time and cut it
into blocks of bounded size, so that a worker's memory does not follow the batch size.
A single text longer than a block is a block of its own (texts are never cut).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import settled, shared_path

#: Bytes of text that one numpy block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 19

#: Rows and bytes of an Arrow batch of texts (a batch holds one row at least).
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20

#: Hashes of texts that a task remembers.
SEEN_MOST = 500_000

#: Bits of a filter of keys (a bound of memory, not of results: a fuller filter lets more rows pass).
FILTER_BITS = 1 << 25

U64 = np.uint64


def texts(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset UTF-8; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls, offsets starting at 0."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay under the limit (one row at least)."""
    _, offs = flat(column)
    start, n = 0, len(column)
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def small_batches(spark) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, unless the session says otherwise.

    The defaults (10,000 rows of whole texts, and no bound of bytes) cost an executor several hundred
    MB, twice over (in the JVM and in the worker), before any work begins. Both are settings of the
    session; other queries of it are only cut into smaller batches.
    """
    for key, usual, size in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 2**31 - 1, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if str(spark.conf.get(key, str(usual))) in (str(usual), f"{usual}b", f"{usual}B"):
            spark.conf.set(key, str(size))


def map_text(
    docs: DataFrame,
    fn: Callable[[pa.Array], dict],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Row for row: the id, then the columns that fn makes of the whole texts, then those carried (strings).

    fn takes a block of texts (large_string, no nulls) and returns one sequence per output
    column. Only the named columns are read, so clashing extra columns do no harm.
    """
    carried = carried or {}
    names, more = T.StructType.fromDDL(schema).fieldNames(), list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), texts(batch.column(1))
            for a, b in blocks(column, block_bytes):
                out = fn(column.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a)]
                    + [x if isinstance(x, pa.Array) else pa.array(x) for x in (out[k] for k in names)]
                    + [c.slice(a, b - a) for c in batch.columns[2:]],
                    names=["doc_id", *names, *more],
                )

    small_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.cast("string").alias(k) for k, c in carried.items()])
    return two.mapInArrow(run, ", ".join(["doc_id long", schema, *[f"{k} string" for k in more]]))


def text_keys(docs: DataFrame, *more: str | Column) -> DataFrame:
    """The columns `more`, k1 and k2 (two hashes that name a text: equal texts share all results), and the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit set of FILTER_BITS that holds every hash of the column (long) and by chance a few others."""
    bits = keys.selectExpr(f"pmod({column}, {FILTER_BITS}L) AS bit").selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63L AS INT)) AS mark")
    found = bits.groupBy("word").agg(F.bit_or("mark").alias("marks")).toArrow()
    out = np.zeros(FILTER_BITS // 64, U64)
    out[found.column("word").to_numpy()] = found.column("marks").to_numpy().view(U64)
    return out


def may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) a filter may hold; never false for one that it was made of."""
    bit = keys.view(U64) & U64(64 * len(held) - 1)
    return (held[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1


def among(rows: DataFrame, held: np.ndarray) -> DataFrame:
    """The rows whose first column (a long, never null) a filter may hold, without a shuffle; an exact join must follow."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held, batch.column(0).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def one_copy(docs: DataFrame, held: np.ndarray | None = None) -> DataFrame:
    """k1, k2 and text, most copies left out: each text about once for each partition of docs.

    A task remembers the hashes of the last SEEN_MOST texts and more, so its memory is bounded; a copy
    that comes after it has forgotten passes, and what follows must expect that. With a filter of k1,
    texts that it does not hold stay away.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if held is not None:
                batch = batch.filter(pa.array(may_hold(held, batch.column(0).to_numpy())))
            keep = []
            if len(seen) > SEEN_MOST:
                seen.clear()
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return text_keys(docs).mapInArrow(run, "k1 long, k2 long, text string")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_GOLD, _ODD = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)
#: Words of so many bytes are hashed eight bytes at a time by numpy, longer ones by xxhash.
_LANE, _SHORT_WORD = 8, 32


def word_bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; runs stop at the ends of texts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[buf]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[heads[1:] - 1] = inside[heads[1:] - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes, the same everywhere.

    Eight bytes after another are mixed into a chain that starts from the length. There is no key,
    so words that share a hash can be built on purpose: this is for features and for look-ups that
    are verified by bytes. Results that rest on equal hashes take `keyed_hashes`.
    """
    size = ends - starts
    out = mix(size.astype(U64) * _GOLD + _ODD)
    lanes = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(_LANE, np.uint8)]).data, 0, (1,))
    short = size <= _SHORT_WORD
    for done in range(0, _SHORT_WORD, _LANE):
        rest = np.flatnonzero(short & (size > done))
        if not len(rest):
            break
        lane, left = lanes[starts[rest] + done], size[rest] - done
        lane &= ~U64(0) >> ((_LANE - np.minimum(left, _LANE)) * 8).astype(U64)
        out[rest] = mix((out[rest] + _GOLD) ^ lane)
    far = np.flatnonzero(~short)
    if len(far):
        data = buf.tobytes()
        out[far] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def new_key() -> bytes:
    """A key for the hashes of one run, drawn by the driver: nobody can build texts against it."""
    return os.urandom(16)


#: Bytes up to which a word is its own hash but for a keyed bijection; distinct longer words that a
#: worker remembers for a key, and their most bytes.
_OWN, _KNOWN_MOST, _KNOWN_BYTES = 7, 300_000, 64


class _Known(dict):
    """Longer words to their keyed hashes."""

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(word) <= _KNOWN_BYTES:
            if len(self) >= _KNOWN_MOST:
                self.clear()
            self[word] = h
        return h


_known: dict[bytes, _Known] = {}


def keyed_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """64-bit hashes of the words' bytes under a key of 16 bytes.

    Words of up to seven bytes never share a hash, as bytes and length go through a keyed bijection;
    longer ones have those of a keyed cryptographic hash.
    """
    size = ends - starts
    first, second = np.frombuffer(key, "<u8")
    lanes = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(_LANE, np.uint8)]).data, 0, (1,))
    few = np.minimum(size, _OWN)
    lane = lanes[starts] & (~U64(0) >> ((_LANE - few) * 8).astype(U64)) | (few.astype(U64) << U64(56))
    out = mix(mix(lane ^ first) + second)
    far = np.flatnonzero(size > _OWN)
    if len(far):
        if key not in _known:
            _known.clear()
            _known[key] = _Known(key)
        known, data = _known[key], buf.tobytes()
        out[far] = [known[data[a:b]] for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def both_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, elementwise; the order counts."""
    return mix(a * _ODD + b + _GOLD)


def gram_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n words from each start on (every start has n words after it).

    Hashes of 1, 2, 4 ... words are made of two halves each; those that n is the sum of are joined.
    """
    out, done, width, level = np.full(len(starts), n, U64), 0, 1, words
    while True:
        if n & width:
            out = both_hashes(out, level[starts + done])
            done += width
        if done == n:
            return out
        level = both_hashes(level[:-width], level[width:]) if len(level) > width else level[:0]
        width *= 2


def table(predicate: Callable[[int], bool]) -> np.ndarray:
    return np.array([predicate(i) for i in range(256)])


#: Bytes of words split at space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words of digits, lower-case ASCII letters and everything beyond ASCII.
LOWERED = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def per_text(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall in each text."""
    return np.diff(np.searchsorted(starts, offs))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: cuts the lineage."""
    return settled(df, name)


class Scratch:
    """Tables of one run of an operator in a folder of their own, which goes once the result is written."""

    def __init__(self, spark, name: str):
        self.spark, self.root, self.count = spark, shared_path(spark, name), 0
        self.paths: dict[str, str] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, name: str) -> None:
        """Removes the last table of that name, which no frame that is still used may read."""
        self._remove(self.paths.pop(name))

    def drop(self) -> None:
        """Removes the folder. No frame that reads its tables may be used after that."""
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)


def finished(scratch: Scratch, result: DataFrame, name: str) -> DataFrame:
    """The result, written, after which the tables that it was made of are removed."""
    out = written(result, name)
    scratch.drop()
    return out


#: A key is hot where it holds more than one row in so many; there are fewer such keys than that.
HOT_SHARE = 1_000
#: Narrow tables of fewer rows are joined without a look at their keys: all of one key fit a task.
HOT_ROWS = 20_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """left (made of a written table, of about total rows) joined to right, which has one row a key, where a few keys may hold most of left.

    The rows of hot keys are dealt over several tasks, with right's row repeated for each. Hot keys are
    fewer than HOT_SHARE, so their table may be broadcast whatever the size of left.
    """
    total = left.count() if total is None else total
    if total < HOT_ROWS:
        return left.join(right, keys, how)
    hot = left.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") * HOT_SHARE > total)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("n_") * HOT_SHARE / max(total, 1)).cast("int").alias("pieces_")))
    one = F.coalesce("pieces_", F.lit(1))
    dealt = left.withColumn("salt_", F.monotonically_increasing_id()).join(hot, keys, "left")
    dealt = dealt.withColumn("salt_", F.pmod("salt_", one).cast("int")).drop("pieces_")
    copied = right.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), one - 1))).drop("pieces_")
    return dealt.join(copied, [*keys, "salt_"], how).drop("salt_")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
