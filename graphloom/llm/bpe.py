"""Operator 8: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pre-tokeniser never runs a regular expression over the texts. Code points become class
numbers; each class is a function on the states of a small automaton, and a blocked scan over
the (associative) composition of these functions gives the state before every code point. The
boundaries follow from state and class; runs of white space look one code point ahead.
Slices between boundaries feed a pair merger through a bounded cache, and the byte offset of
every token is the running length of what it decodes to.

The vocabulary's path is a parameter; the file must be present on every node.

Defined results: null and empty texts have no tokens and decode to no bytes; repeated rows are
encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import textbuf as tb

#: Slices that a worker remembers; it starts afresh beyond that.
CACHE_SLICES = 200_000
CACHE_BYTES = 64
#: Slices up to so many bytes are merged by plain search of the lowest rank, longer ones by a heap.
SHORT = 96

# States: what has been read of the text so far.
BEGIN, LETTERS, NUMBERS, OTHERS, BLANK, SPACE, QUOTE, QUOTE_RV, QUOTE_L, CLITIC = range(10)
# Classes of code points. Beyond them, FIRST + class is that class at the start of a text.
LETTER, STMD, RV, ELL, E, NUMBER, OTHER, APOSTROPHE, SPACE_CHAR, BLANK_CHAR = range(10)
FIRST = 10


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    chars = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK_CHAR)):
        for m in regex.finditer(pattern, chars):
            out[[ord(c) for c in m[0]]] = kind
    out[[0x1C, 0x1D, 0x1E, 0x1F]] = OTHER  # not White_Space
    for letters, kind in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", E), ("'", APOSTROPHE), (" ", SPACE_CHAR)):
        out[[ord(c) for c in letters]] = kind
    return out


def _next(state: int, kind: int) -> int:
    if kind <= E:
        if state == QUOTE:
            return {STMD: CLITIC, RV: QUOTE_RV, ELL: QUOTE_L}.get(kind, LETTERS)
        done = (state, kind) in ((QUOTE_RV, E), (QUOTE_L, ELL))
        return CLITIC if done else LETTERS
    if kind == APOSTROPHE:
        return OTHERS if state in (SPACE, OTHERS, QUOTE) else QUOTE
    return {NUMBER: NUMBERS, OTHER: OTHERS, SPACE_CHAR: SPACE, BLANK_CHAR: BLANK}[kind]


def _opens(state: int, kind: int) -> bool:
    """Does a slice begin at a code point of this class? Inside white space: settled later."""
    if state == BEGIN:
        return True
    if kind <= E:
        return not (state in (LETTERS, QUOTE_RV, QUOTE_L, SPACE) or (state, kind) == (QUOTE, STMD))
    if kind == NUMBER:
        return state not in (NUMBERS, SPACE)
    if kind in (OTHER, APOSTROPHE):
        return state not in (OTHERS, QUOTE, SPACE)
    return state not in (BLANK, SPACE)


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function number of each class, composition table, functions as rows, opens[state, class])."""
    states = range(10)
    gens = [tuple(_next(s, k) for s in states) for k in range(10)]
    gens += [tuple(_next(BEGIN, k) for _ in states) for k in range(10)]
    identity = tuple(states)
    found = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    rows = np.array(list(found), np.int64)
    size = len(rows)
    compose = np.array([[found[tuple(b[a])] for b in rows] for a in rows], np.uint16).reshape(size * size)
    opens = np.array([[_opens(s, k) for k in range(10)] for s in states])
    return np.array([found[g] for g in gens], np.uint16), compose, rows, opens


def _scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """For each place, the composition of all functions before it (a blocked exclusive scan)."""
    _, compose, rows, _ = _monoid()
    size = len(rows)
    n = len(functions)
    if n <= width:
        out, acc = np.zeros(n, np.uint16), 0
        for i, f in enumerate(functions):
            out[i] = acc
            acc = compose[acc * size + f]
        return out
    lines = -(-n // width)
    grid = np.zeros(lines * width, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(lines, width).T)
    within = np.zeros_like(grid)
    acc = np.zeros(lines, np.int64)
    for i in range(width):
        within[i] = acc
        acc = compose[acc * size + grid[i]].astype(np.int64)
    before = _scan(acc.astype(np.uint16), width).astype(np.int64)
    return compose[before[None, :] * size + within].T.reshape(-1)[:n]


def boundaries(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of the block, byte starts of all slices and the end, slices before each text)."""
    buf, offs = tb.flat(column)
    data = buf.tobytes()
    if not data:
        return data, np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    kinds = _classes()[np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")]
    heads = np.searchsorted(at, offs[:-1][offs[:-1] < offs[1:]])
    functions, _, rows, opens = _monoid()
    marked = kinds.astype(np.int64)
    marked[heads] += FIRST
    state = rows[_scan(functions[marked]), BEGIN]
    state[heads] = BEGIN
    opening = opens[state, kinds]
    # 're, 've and 'll end two code points after the quote: no slice begins at the first of them
    two = ((state == QUOTE_RV) & (kinds == E)) | ((state == QUOTE_L) & (kinds == ELL))
    opening[np.flatnonzero(two) - 1] = False
    # the last of several blanks before something else stands apart, or goes with it
    white = kinds >= SPACE_CHAR
    last = np.zeros(len(kinds), bool)
    last[:-1] = white[:-1] & ~white[1:]
    last[heads[1:] - 1] = False
    opening |= last & ((state == BLANK) | (state == SPACE))
    starts = at[opening]
    return data, np.append(starts, len(data)), np.searchsorted(starts, offs)


def _merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: pairs merge in the order of their ranks, leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        get, none = ranks.get, 1 << 60
        cuts = list(range(n + 1))
        found = [get(piece[i : i + 2], none) for i in range(n - 1)]
        while found and (best := min(found)) != none:
            i = found.index(best)
            del cuts[i + 1], found[i]
            if i < len(found):
                found[i] = get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                found[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    after, ends = list(range(1, n + 1)), list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.get(piece[i : ends[j]]) if j < n else None

    heap = [(r, i, ends[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        ends[i], after[i] = ends[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, ends[after[k]]))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class _Cache(dict):
    """Slice to its ids as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(_merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[piece] = ids
        return ids


@cache
def _vocabulary(path: str) -> tuple[_Cache, list[bytes]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    back = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        back[i] = piece
    return _Cache(ranks), back


def encode_block(column: pa.Array, path: str) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    known, _ = _vocabulary(path)
    data, starts, counts = boundaries(column)
    cuts = starts.tolist()
    pieces = [known[data[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [b"".join(pieces[a:b]) for a, b in zip(counts.tolist(), counts[1:].tolist(), strict=False)]


def decode_ids(ids: bytes, path: str) -> bytes:
    _, back = _vocabulary(path)
    return b"".join([back[i] for i in np.frombuffer(ids, "<u4").tolist()])


def token_offsets(ids: bytes, path: str) -> np.ndarray:
    """The byte offset of each token in the text, and the end."""
    _, back = _vocabulary(path)
    return np.cumsum([0] + [len(back[i]) for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and offsets (byte offset of each token) of every whole text."""

    def fn(column: pa.Array) -> dict:
        ids = encode_block(column, path)
        return {
            "ids": pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())),
            "offsets": pa.array([token_offsets(x, path)[:-1] for x in ids], pa.list_(pa.int64())),
        }

    return tb.map_text(docs, fn, "ids array<int>, offsets array<long>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes, for every text."""

    def fn(column: pa.Array) -> dict:
        ids = encode_block(column, path)
        return {
            "n_tokens": np.array([len(x) // 4 for x in ids], np.int64),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decode_ids(x, path)).hexdigest() for x in ids],
        }

    return tb.map_text(docs, fn, "n_tokens long, ids_sha256 string, decoded_sha256 string")
