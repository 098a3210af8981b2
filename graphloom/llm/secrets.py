"""Operator 1: secret scans by patterns and by character Markov models.

Base spans come from three fixed patterns. The method adds spans: runs of token characters
that no base span touches are scored by two first-order character Markov models, one of random
strings and one of ordinary identifiers, and reported where the log-likelihood ratio says
random. Both models are trained from labelled samples of the corpus itself: values inside base
spans are the random strings, long plain words the identifiers, gathered by a Spark
aggregation over a hash sample of the rows, of `max_train_rows` rows in expectation (rows of one
id and length are taken or left together). What the models hold does not grow with the sample.

Defined results: null texts count as empty and have no spans; repeated rows are scanned each;
spans are in code points, end exclusive, and cover whole matches; ties at one start go by the
order of KINDS. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

# Kinds of spans in their order, and the patterns of the base.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Runs of token characters that the models judge: so long at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z0-9_]{8,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET)
_PLACE = {c: i for i, c in enumerate(ALPHABET)}
#: Rows that train the models, in expectation.
MAX_TRAIN_ROWS = 20_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base matches, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _values(text: str) -> list[str]:
    """What base matches hold: the secret itself, without its name."""
    out = [m[2] for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return out + [m[0] for p in (ACCESS, HEX) for m in p.finditer(text) if m.end() - m.start() >= 16]


def pairs(strings: list[str]) -> Counter:
    """Counts of neighbouring characters; the place SIZE stands before the first."""
    out: Counter = Counter()
    for s in strings:
        last = SIZE
        for c in s:
            if (at := _PLACE.get(c)) is not None:
                out[last * SIZE + at] += 1
                last = at
    return out


def train(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """The table of log-likelihood ratios: [character before, character], flattened.

    One row in `count / max_train_rows` is taken by hash of its id and text length. The counts come back
    as at most 2 * (SIZE + 1) * SIZE sums, whatever the corpus.
    """
    step = max(1, -(-docs.count() // max_train_rows))
    few = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.length("text")).alias("h"))
    few = few.where(F.pmod("h", F.lit(step)) == 0).select("text")

    def count(batches):
        random, plain = Counter(), Counter()
        for batch in batches:
            for text in tb.texts(batch.column(0)).to_pylist():
                random.update(pairs(_values(text)))
                bare = ASSIGN.sub(" ", HEX.sub(" ", ACCESS.sub(" ", text)))
                for c, n in Counter(WORD.findall(bare)).items():
                    for k, m in pairs([c]).items():
                        plain[k] += n * m
        rows = [(0, k, n) for k, n in random.items()] + [(1, k, n) for k, n in plain.items()]
        kind, key, n = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int32()), "n": pa.array(n, pa.int64())})

    sums = few.mapInArrow(count, "kind int, key int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    table = np.ones((2, SIZE + 1, SIZE))
    for r in sums:
        table[r.kind].ravel()[r.key] += r.n
    # the random model keeps a tenth of its weight on strings that are uniform over the alphabet
    p = table / table.sum(axis=2, keepdims=True)
    return np.log((0.9 * p[0] + 0.1 / SIZE) / (0.99 * p[1] + 0.01 / SIZE)).ravel()


def ratio(string: str, table: np.ndarray) -> float:
    """Log-likelihood ratio of random string against identifier, in nats."""
    at = np.array([_PLACE[c] for c in string])
    before = np.concatenate(([SIZE], at[:-1]))
    return float(table[before * SIZE + at].sum())


def spans(text: str, table: np.ndarray, least: float = 8.0, each: float = 0.3) -> tuple[list[tuple[int, int, int]], int]:
    """(all spans sorted, number of base spans): base ones and those of the models.

    A candidate is reported if its ratio is at least `least` nats and `each` nats a character.
    """
    base = base_spans(text)
    more, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # both lists are sorted by start: reach is the furthest end of the base spans before b
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach > a:
            continue
        r = ratio(m[0], table)
        if r >= least and r >= each * (b - a):
            more.append((a, 3, b))
    return (sorted(base + more), len(base)) if more else (base, len(base))


def _told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id and the array of spans (kind, start, end) of every whole text."""

    def fn(column: pa.Array) -> dict:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        found = [spans(t, table)[0] for t in column.to_pylist()]
        return {"spans": pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], kind)}

    return tb.map_text(docs, fn, "spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, counts by kind, SHA-256 of the base spans, and all spans, for every document."""
    table = train(docs, max_train_rows)

    def fn(column: pa.Array) -> dict:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")}
        for text in column.to_pylist():
            found, _ = spans(text, table)
            base = [x for x in found if x[1] < 3]
            for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_markov")):
                out[name].append(sum(x[1] == k for x in found))
            out["base_sha256"].append(hashlib.sha256(_told(base).encode()).hexdigest())
            out["spans"].append(_told(found))
        return out | {k: np.array(v, np.int64) for k, v in out.items() if k[:2] == "n_"}

    return tb.map_text(docs, fn, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redacted(docs: DataFrame, table: np.ndarray, mask: str = "[secret]") -> DataFrame:
    """The documents with the same columns, every span of a secret replaced by the mask.

    Spans that overlap are replaced as one. n_chars, where present, follows the new text.
    """
    names = docs.columns

    def clean(text: str | None) -> str | None:
        if not text or not (found := spans(text, table)[0]):
            return text
        out, at = [], 0
        for s, _, e in found:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            k = names.index("text")
            new = [clean(t) for t in columns[k].to_pylist()]
            columns[k] = pa.array(new, columns[k].type)
            if "n_chars" in names:
                old = columns[names.index("n_chars")]
                size = [len(t) if t is not None else n for t, n in zip(new, old.to_pylist(), strict=True)]
                columns[names.index("n_chars")] = pa.array(size, old.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
