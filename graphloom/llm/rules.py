"""Operator 10: quality rules, with bands on what public tokenisers make of a text.

Base rules count words, symbols, repeated lines and repeated 3-word windows. The method
measures how each of several public vocabularies fits the text: code points for each token
(fertility), the share of byte-fallback tokens (of a byte-level vocabulary: tokens that are no
whole characters), and the entropy of the tokens. A first pass measures every whole
text and is written to the shared folder; quartiles over all documents of a script, language and
length (in powers of two of words: short texts scatter more and have less entropy) then give
rejection bands, and joins with that short table give the verdict. Where such a group has fewer
than LEAST_GROUP documents, the bands of the script and language hold, and else the script's.

Words are encoded one by one (the vocabularies have no piece across words), each different word
of a block once, through a bounded cache. A text is kept if all measures are within its bands.

Defined results: null and empty texts have no words and fail the base; repeated rows are judged
each; texts without letters have the script "none"; a column lang is used where there is one, and
rows without a language are a language of their own. Other extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "east_asian", "other")
#: Words that a worker remembers; it starts afresh beyond that.
CACHE_WORDS = 200_000
#: Bands reach so many interquartile ranges beyond the quartiles; the ranges count as so much at
#: least (most texts have no fallback at all, and one rare sign is several tokens of it).
REACH, LEAST_RANGE = 3.0, {"chars_per_token": 0.03, "fallback": 0.007, "entropy": 0.1}
#: Documents of a group with bands of its own, and the columns that tell groups apart.
LEAST_GROUP, GROUP = 30, ("script", "lang", "length")

#: Words and windows are compared inside a block only, so each process draws a key of its own.
_KEY = tb.new_key()
_SYMBOL = tb.table(lambda b: chr(b) in "#*$%&|<>")
_LINE = tb.table(lambda b: b != 0x0A)


def _script_of(b: int) -> int:
    """The script that a byte speaks for: ASCII letters and first bytes of longer sequences."""
    if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or 0xC3 <= b <= 0xCA:
        return 1
    ranges = ((0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD7, 0xD7, 4), (0xD8, 0xDB, 5), (0xE0, 0xE0, 6), (0xE3, 0xED, 7))
    return next((s for lo, hi, s in ranges if lo <= b <= hi), 8 if b >= 0xC2 else 0)


_SCRIPT = np.array([_script_of(b) for b in range(256)], np.uint8)


@cache
def _tokeniser(path: str):
    """(encoder of a list of words, for each token: is it a fallback) of a vocabulary file, by its suffix."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        part = np.zeros(max(ranks.values()) + 1, bool)
        for piece, i in ranks.items():
            part[i] = len(piece.decode("utf-8", "ignore").encode()) < len(piece)
        return (lambda words: [own.encode_ordinary(f" {w}") for w in words]), part
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    part = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())])
    return (lambda words: sp.encode(words, num_threads=1)), part


_WORDS: dict[str, dict[bytes, np.ndarray]] = {}


def _tokens(words: list[bytes], path: str) -> list[np.ndarray]:
    """The token ids of each word."""
    known = _WORDS.setdefault(path, {})
    new = [w for w in words if w not in known]
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = words
    encode, _ = _tokeniser(path)
    made = dict(zip(new, (np.array(x, np.int64) for x in encode([w.decode("utf-8") for w in new])), strict=True))
    out = [made[w] if w in made else known[w] for w in words]
    known.update((w, ids) for w, ids in made.items() if len(w) <= 64)
    return out


def _fit_of(words: list[bytes], which: np.ndarray, doc: np.ndarray, word_chars: np.ndarray, path: str) -> list[np.ndarray]:
    """MEASURES of each text under one vocabulary, from the different words and where they stand."""
    n = len(word_chars)
    ids = _tokens(words, path)
    size = np.array([len(x) for x in ids], np.int64)
    begin = np.cumsum(size) - size
    flat = np.concatenate([np.zeros(0, np.int64), *ids])
    each = size[which] if len(size) else np.zeros(0, np.int64)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[which] if len(size) else each, each)
    token, token_doc = flat[place], np.repeat(doc, each)
    _, part = _tokeniser(path)
    tokens = np.bincount(token_doc, minlength=n)
    fallback = np.bincount(token_doc, weights=part[token], minlength=n)
    key = np.sort(token_doc * len(part) + token)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count, of = np.diff(np.append(edge, len(key))), key[edge] // len(part)
    p = count / tokens[of] if len(key) else np.zeros(0)
    entropy = np.bincount(of, weights=-p * np.log2(p), minlength=n) if len(key) else np.zeros(n)
    whole = np.maximum(tokens, 1)
    return [np.round(word_chars / whole, 2), np.round(fallback / whole, 3), np.round(entropy, 2)]


def _groups(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by text and hash, first of each run of equals), stable."""
    order = np.lexsort((np.arange(len(hashes)), hashes, doc))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return order, first


def measure_block(column: pa.Array, paths: Sequence[str]) -> dict[str, np.ndarray]:
    """The base counts and the tokenisers' measures of each whole text."""
    buf, offs = tb.flat(column)
    n = len(column)
    starts, ends = tb.word_bounds(buf, offs, tb.SPACED)
    words = tb.per_text(starts, offs)
    doc = np.repeat(np.arange(n), words)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    word_chars = np.bincount(doc, weights=chars[ends] - chars[starts], minlength=n).astype(np.int64)
    symbols = tb.per_text(np.flatnonzero(_SYMBOL[buf]), offs)

    line_starts, line_ends = tb.word_bounds(buf, offs, _LINE)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_doc = np.repeat(np.arange(n), tb.per_text(line_starts, offs))[with_word]
    data = buf.tobytes()
    first_byte, end_byte = line_starts[with_word], line_ends[with_word]
    order, first = _groups(tb.word_hashes(buf, first_byte, end_byte), line_doc)
    dup_lines = np.bincount(line_doc[order][~first], minlength=n)
    # lines that share a hash are compared by their bytes: those that differ are no repeats
    many = ~first
    many[:-1] |= ~first[1:]
    place = order[many]
    group = np.cumsum(first)[many]
    seen: set[tuple[int, bytes]] = set()
    for g, is_first, i in zip(group.tolist(), first[many].tolist(), place.tolist(), strict=True):
        line = (g, data[first_byte[i] : end_byte[i]])
        if line not in seen:
            seen.add(line)
            dup_lines[line_doc[i]] -= not is_first

    hashes = tb.keyed_hashes(buf, starts, ends, _KEY)
    window = np.arange(max(len(doc) - 2, 0))
    window = window[doc[window] == doc[window + 2]] if len(window) else window
    order, first = _groups(tb.gram_hashes(hashes, window, 3), doc[window])
    again = ~first
    again[:-1] |= ~first[1:]
    repeated = np.zeros(len(doc), bool)
    for k in range(3):
        repeated[window[order[again]] + k] = True
    repeat_words = np.bincount(doc[repeated], minlength=n)

    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    kinds = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    fits = [_fit_of(kinds, which, doc, word_chars, path) for path in paths]

    speaks = _SCRIPT[buf]
    by_script = np.stack([tb.per_text(np.flatnonzero(speaks == s), offs) for s in range(1, len(SCRIPTS))])
    script = np.where(by_script.sum(axis=0) > 0, by_script.argmax(axis=0) + 1, 0) if n else np.zeros(0, np.int64)
    out = {"n_words": words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    out["script"] = [SCRIPTS[s] for s in script]
    return out | {name: x for i, fit in enumerate(fits) for name, x in zip(measures(i), fit, strict=True)}


MEASURES = ("chars_per_token", "fallback", "entropy")


def measures(i: int) -> list[str]:
    """The names of vocabulary i's measures."""
    return [f"{m}_{i + 1}" if i else m for m in MEASURES]


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string"


def measure(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """doc_id, the base counts and the tokenisers' measures of every whole text, its language and length class."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    schema = ", ".join([SCHEMA, *[f"{m} double" for i in range(len(paths)) for m in measures(i)]])
    rows = tb.map_text(docs, lambda c: measure_block(c, paths), schema, carried={"lang": lang})
    return rows.withColumn("length", F.floor(F.log2(F.greatest("n_words", F.lit(1)))))


def bands(measured: DataFrame, size: int) -> DataFrame:
    """Rejection bands by script, by script and language, and by these and length (level 3, 1, 0),
    from quartiles over all documents that pass the base, for each of `size` vocabularies.

    The measures are rounded, so an exact percentile keeps a bounded number of values.
    """
    good = measured.where(~failed())
    edges = []
    for i in range(size):
        for name, kind in zip(measures(i), MEASURES, strict=True):
            low, high = F.percentile(name, F.lit(0.25)), F.percentile(name, F.lit(0.75))
            reach = REACH * F.greatest(high - low, F.lit(LEAST_RANGE[kind]))
            edges += [(low - reach).alias(f"least_{name}"), (high + reach).alias(f"most_{name}")]
    made = good.rollup(*GROUP).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *edges)
    return made.where((F.col("level") == 3) | (F.col("level") < 3) & (F.col("n") >= LEAST_GROUP))


def failed():
    """The base rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document, with the measures."""
    scratch = tb.Scratch(docs.sparkSession, "rules")
    measured = scratch.written(measure(docs, paths), "fertility")
    found = scratch.written(bands(measured, len(paths)), "bands")
    names = [m for i in range(len(paths)) for m in measures(i)]
    edges = F.struct(*[f"{side}_{m}" for m in names for side in ("least", "most")])
    judged = measured
    for level, size in ((3, 1), (1, 2), (0, 3)):
        # few rows as a rule, but lang is free text: Spark broadcasts the table where it is small
        mine = found.where(F.col("level") == level).select(*GROUP[:size], edges.alias(f"band_{level}"))
        judged = judged.join(mine, list(GROUP[:size]), "left")
    band = F.coalesce("band_0", "band_1", "band_3")
    within = F.lit(True)
    for m in names:
        # no text has too little fallback
        within = within & (F.col(m) <= band[f"most_{m}"]) & (F.lit("fallback" in m) | (F.col(m) >= band[f"least_{m}"]))
    result = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed().alias("base_failed"), (~failed() & F.coalesce(within, F.lit(False))).alias("kept"), "script", *names,
    )
    return tb.finished(scratch, result, "rules")
