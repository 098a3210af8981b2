"""Operator 11: alignment of the tokens of two tokenisers, by divide and conquer at shared cuts.

Each text, led by one space, is encoded by a byte-level vocabulary (A) and by one of pieces with
byte fallback (B); tokens of both become byte ranges. An offset where tokens of both end is a cut.
An interval of tokens that ends at a cut is divided at a common end near its middle: from A's
middle token on, bisection in the other tokeniser's ends leaps from end to end until both agree,
to the right first, then to the left. Both halves are divided in turn; an interval in which no
common end is left is a group. All intervals of a block of texts are divided at once, so a step is
a few numpy calls, and texts are merely the first intervals.

A link is an A and a B token that end together (the last ones of a group). How often the corpus
links two ids is counted from the written links of each text (ids and times), and a join brings
the counts back; the table of counts grows with the pairs of ids in use, so it is broadcast only
below a size, and joined by a shuffle with hot pairs dealt out above it.

A's file is read by `tiktoken`, at a quarter of the time, where its merges are in the order of its
ids; where they are not, or where that library gives up on a text (endless white space), `tokenizers`
encodes.

Defined results: texts that are null or empty, or whose joined tokens are other bytes than the
text with its space, have no tokens; repeated rows are aligned and counted each. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

#: Pairs of ids whose counts may be broadcast.
PAIRS_MOST = 1 << 20
#: A link's code is A's id shifted by so many bits, and B's id.
SHIFT = 32


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters are themselves, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def byte_level(path: str):
    """(encoder of a list of texts, bytes of each id) of a byte-level vocabulary file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    to_byte = _byte_of()
    vocabulary = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in to_byte for c in token)}
    back = [b""] * (slow.get_vocab_size() + 1)
    for token, i in vocabulary.items():
        back[i] = token
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    by_rank = merged == sorted(merged) and len(vocabulary) == len(merged) + 256 and all(bytes([b]) in vocabulary for b in range(256))

    def plainly(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]

    if not by_rank:
        return plainly, back
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(fast.encode_ordinary(text))
            except (KeyboardInterrupt, SystemExit, GeneratorExit):
                raise
            except BaseException:  # the library's panics are no Exceptions
                out += plainly([text])
        return out

    return encode, back


@cache
def pieces(path: str):
    """(encoder of a list of texts, bytes of each id) of a piece vocabulary file; the encoder adds the space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    back = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return (lambda texts: sp.encode(texts, num_threads=1)), back


def _leap(i: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray, other: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each interval, the first common end from ends[i] on (not ahead: backwards): (place in ends,
    place in other), or -1. Places stay within low to high (high itself excluded)."""
    at, to = np.full(len(i), -1), np.full(len(i), -1)
    live = np.arange(len(i))
    while len(live):
        live = live[(i[live] >= low[live]) & (i[live] < high[live])]
        x = ends[i[live]]
        j = np.searchsorted(other, x) if ahead else np.searchsorted(other, x, side="right") - 1
        inside = (j >= other_low[live]) & (j < other_high[live])
        live, x, j = live[inside], x[inside], j[inside]
        y = other[j]
        same = x == y
        at[live[same]], to[live[same]] = i[live[same]], j[same]
        live, y = live[~same], y[~same]
        i[live] = np.searchsorted(ends, y) if ahead else np.searchsorted(ends, y, side="right") - 1
    return at, to


def cuts(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of all common ends, ascending.

    a and b are ascending ends of tokens; the texts' tokens stop at a_stop and b_stop, where both end together.
    """
    found_a, found_b = [a_stop - 1], [b_stop - 1]
    a0, b0 = np.append(0, a_stop[:-1]), np.append(0, b_stop[:-1])
    a1, b1 = a_stop.copy(), b_stop.copy()
    while len(a0):
        # one token on either side is a group of its own
        more = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[more], a1[more], b0[more], b1[more]
        middle = (a0 + a1 - 1) // 2
        at, to = _leap(middle.copy(), a0, a1 - 1, a, b, b0, b1 - 1, True)
        none = np.flatnonzero(at < 0)
        at[none], to[none] = _leap(middle[none] - 1, a0[none], a1[none] - 1, a, b, b0[none], b1[none] - 1, False)
        some = at >= 0
        at, to = at[some], to[some]
        found_a.append(at)
        found_b.append(to)
        a0, a1, b0, b1 = (np.concatenate(x) for x in ((a0[some], at + 1), (at + 1, a1[some]), (b0[some], to + 1), (to + 1, b1[some])))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Aligned:
    """The tokens of a block of texts, those of texts that do not join to their bytes left out, and their groups."""

    def __init__(self, column: pa.Array, path_a: str, path_b: str):
        encode_a, self.back_a = byte_level(path_a)
        encode_b, self.back_b = pieces(path_b)
        self.count = len(column)
        texts = column.to_pylist()
        some = [i for i, t in enumerate(texts) if t]
        got_a = dict(zip(some, encode_a([" " + texts[i] for i in some]), strict=True))
        got_b = dict(zip(some, encode_b([texts[i] for i in some]), strict=True))
        good = []
        for i in some:
            whole = (" " + texts[i]).encode()
            if b"".join([self.back_a[t] for t in got_a[i]]) == whole == b"".join([self.back_b[t] for t in got_b[i]]):
                good.append(i)
        self.docs = np.array(good, np.int64)
        flat = lambda got: np.array([t for i in good for t in got[i]], np.int64)
        self.a, self.b = flat(got_a), flat(got_b)
        self.n_a, self.n_b = (np.array([len(got[i]) for i in good], np.int64) for got in (got_a, got_b))
        size = lambda back, ids: np.array([len(x) for x in back], np.int64)[ids]
        self.end_a, self.end_b = np.cumsum(size(self.back_a, self.a)), np.cumsum(size(self.back_b, self.b))
        stop_a, stop_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.cut_a, self.cut_b = cuts(self.end_a, self.end_b, stop_a, stop_b) if len(good) else (np.zeros(0, np.int64),) * 2
        self.doc = np.searchsorted(stop_a, self.cut_a, side="right")
        self.n_groups = np.bincount(self.doc, minlength=len(good))

    def placed(self, values: np.ndarray) -> np.ndarray:
        """A number for each good text as one for each text, 0 for others."""
        out = np.zeros(self.count, np.int64)
        out[self.docs] = values
        return out

    def links(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(codes of the linked ids, ascending; times) of each text."""
        code = (self.a[self.cut_a] << SHIFT) | self.b[self.cut_b]
        order = np.lexsort((code, self.doc))
        code, doc = code[order], self.doc[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        times, code, doc = np.diff(np.append(at, len(code))), code[at], doc[at]
        edge = np.searchsorted(doc, np.arange(len(self.docs) + 1)).tolist()
        none = np.zeros(0, np.int64)
        out = [(none, none)] * self.count
        for i, x, y in zip(self.docs.tolist(), edge, edge[1:], strict=False):
            out[i] = (code[x:y], times[x:y])
        return out

    def told(self) -> list[bytes]:
        """The groups of each text as decimal ids: a1,a2|b1;a3|b2,b3 (empty where there are none)."""
        names = _names(len(self.back_a), len(self.back_b))
        shift = 2 * len(self.back_a)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.cut_a] = last_b[self.cut_b] = 1
        # a token stands after the tokens of its own kind, and after the other kind's of the groups before (A) or up to (B) it
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(self.a)) + np.append(0, self.cut_b + 1)[group_a]
        place_b = np.arange(len(self.b)) + (self.cut_a + 1)[group_b]
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[place_a] = 2 * self.a + last_a
        code[place_b] = shift + 2 * self.b + last_b
        stop = np.cumsum(self.n_a + self.n_b).tolist()
        words = [names[c] for c in code.tolist()]
        out = [b""] * self.count
        for i, x, y in zip(self.docs.tolist(), [0, *stop], stop, strict=False):
            out[i] = b"".join(words[x:y])[:-1]
        return out


@cache
def _names(n_a: int, n_b: int) -> list[bytes]:
    """Ids in decimal with what follows: for A a comma, or a bar at a group's end; for B a comma or a semicolon."""
    return [b"%d%c" % (i, s) for n, signs in ((n_a, b",|"), (n_b, b",;")) for i in range(n) for s in signs]


COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def _block(column: pa.Array, path_a: str, path_b: str) -> dict:
    x = Aligned(column, path_a, path_b)
    links = x.links()
    return {
        "n_a": x.placed(x.n_a), "n_b": x.placed(x.n_b), "n_groups": x.placed(x.n_groups), "n_links": x.placed(x.n_groups),
        "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in x.told()],
        "codes": pa.array([c for c, _ in links], pa.list_(pa.int64())), "times": pa.array([n for _, n in links], pa.list_(pa.int64())),
    }


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and groups of every document: ids of A, ids of B, and byte range in the text led by a space."""

    def fn(column: pa.Array) -> dict:
        x = Aligned(column, path_a, path_b)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        base = np.append(0, x.end_a[np.cumsum(x.n_a) - 1]) if len(x.docs) else [0]
        at_a = at_b = start = 0
        for p, q, d in zip((x.cut_a + 1).tolist(), (x.cut_b + 1).tolist(), x.doc.tolist(), strict=True):
            end = int(x.end_a[p - 1])
            out[x.docs[d]].append({"a": x.a[at_a:p], "b": x.b[at_b:q], "start": start - int(base[d]), "end": end - int(base[d])})
            at_a, at_b, start = p, q, end
        ids = pa.list_(pa.int32())
        return {"groups": pa.array(out, pa.list_(pa.struct([("a", ids), ("b", ids), ("start", pa.int64()), ("end", pa.int64())])))}

    return tb.map_text(docs, fn, "groups array<struct<a:array<int>,b:array<int>,start:bigint,end:bigint>>")


def counted(links: DataFrame) -> DataFrame:
    """code, n (how many links hold the pair) and best (is that the most of any pair of its B id)."""
    sums = links.groupBy("code").agg(F.sum("times").alias("n"))
    # pairs of ids are bounded by the vocabularies; those of one B id by A's
    b = F.col("code").bitwiseAND((1 << SHIFT) - 1)
    most = sums.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return sums.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def digests(docs: DataFrame, path_a: str, path_b: str, pairs_most: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    scratch = tb.Scratch(docs.sparkSession, "alignment")
    made = tb.map_text(docs, lambda c: _block(c, path_a, path_b), f"{COUNTS}, groups_sha256 string, codes array<long>, times array<long>")
    rows = scratch.written(made.withColumn("row", F.monotonically_increasing_id()), "rows")
    links = rows.select("row", F.explode(F.arrays_zip("codes", "times")).alias("l")).select("row", F.col("l.codes").alias("code"), F.col("l.times").alias("times"))
    counts = scratch.written(counted(links), "counts")
    small = counts.count() <= (PAIRS_MOST if pairs_most is None else pairs_most)
    joined = links.join(F.broadcast(counts), "code") if small else tb.join_hot(links, counts, ["code"])
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    told = rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    return tb.finished(scratch, told, "alignment")
