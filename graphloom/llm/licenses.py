"""Operator 2: license scans by exact phrases and fuzzy short notices.

Words are digits, lower-cased ASCII letters and everything beyond ASCII. Base labels come from
places where a phrase's words stand consecutively. The method adds fuzzy notices: every notice
is split into one piece more than the edits it may have, so that one piece at least is intact
(pigeonhole); an Aho-Corasick pass over the block locates the pieces, and the regex library's
bounded-error matching verifies the surroundings and reports span and edits. A notice begins and ends at the
edges of words, which edits may move; what only stands inside words is none. A seed costs one
match of bounded length, so work is in proportion to text and seeds, however long a text is.

Defined results: null texts count as empty (no words, score 0); repeated rows are scanned
each; the first and last word are the smallest and largest start over all phrases. The score is
1 with a base phrase, else the best notice's share of unedited characters, always below 1, else
0. Extra columns are ignored.
"""

from __future__ import annotations

from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm import textbuf as tb

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices of public licenses, normalised to words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "this work is licensed under a creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "released into the public domain": "public-domain",
    "permission to use copy modify and distribute this software for any purpose": "isc",
    "all rights reserved": "reserved",
    "spdx license identifier apache 2 0": "apache-2.0",
    "spdx license identifier mit": "mit",
    "spdx license identifier bsd 3 clause": "bsd",
    "spdx license identifier gpl": "gpl",
    "spdx license identifier mpl 2 0": "mpl-2.0",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license": "bsl-1.0",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "the artistic license": "artistic",
    "open font license": "ofl",
    "open database license": "odbl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "licensed under the terms of the bsd license": "bsd",
    "proprietary and confidential": "proprietary",
}
#: A notice may have one edit for so many characters.
CHARS_AN_EDIT = 12


def edits(notice: str) -> int:
    return max(1, len(notice) // CHARS_AN_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): a cut into edits + 1 nearly equal parts."""
    k = edits(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _automaton():
    """Seeds of all phrases and notices: piece to its (notice, offset) pairs; None for base phrases."""
    seeds: dict[str, list] = {}
    for phrase in BASE:
        seeds.setdefault(phrase, []).append((None, 0))
    for notice in NOTICES:
        for offset, piece in pieces(notice):
            seeds.setdefault(piece, []).append((notice, offset))
    a = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        a.add_word(piece, (len(piece), uses))
    a.make_automaton()
    return a


@cache
def _fuzzy(notice: str):
    return regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits(notice)}}}")


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words with one space after each (none at the end): bytes and offsets."""
    buf, offs = tb.flat(column)
    low = tb.lower_ascii(buf)
    word = tb.LOWERED[low]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    before[offs[:-1][offs[:-1] < offs[1:]]] = False
    keep = word | before
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return np.where(word, low, 0x20).astype(np.uint8)[keep], kept[offs]


def scan_block(column: pa.Array) -> tuple[np.ndarray, dict[int, dict]]:
    """(words of each text, what was found in the texts that hold any seed)."""
    buf, offs = tb.flat(column)
    starts, _ = tb.word_bounds(tb.lower_ascii(buf), offs, tb.LOWERED)
    n_words = tb.per_text(starts, offs)
    norm, cuts = normalised(column)
    text = norm.tobytes().decode("latin-1")
    seeds: dict[int, list] = {}
    for end, (size, uses) in _automaton().iter(text):
        doc = int(np.searchsorted(cuts, end, side="right")) - 1
        seeds.setdefault(doc, []).append((end - size + 1, uses))
    return n_words, {doc: _verify(text[cuts[doc] : cuts[doc + 1]], [(at - int(cuts[doc]), u) for at, u in found]) for doc, found in seeds.items()}


@lru_cache(maxsize=65_536)
def _match(notice: str, around: str) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of a notice between edges of words in a short string, whose first and
    last characters are only looked at.

    The best match anywhere tells where; of the strings from an edge near its start to one near its end the
    one that matches as a whole with the fewest edits is taken, then the first and shortest.
    """
    m, k = _fuzzy(notice).search(around), edits(notice)
    if not m:
        return None
    edge = lambda i: 0 < i < len(around) and (around[i - 1] == " ") != (around[i] == " ")
    starts = [i for i in range(max(1, m.start() - k), m.start() + k + 1) if edge(i) and around[i] != " "]
    ends = [i for i in range(m.end() - k, min(len(around) - 1, m.end() + k) + 1) if edge(i) and around[i] == " "]
    found = []
    for i in starts:
        for j in ends:
            if abs(j - i - len(notice)) <= k and (whole := _fuzzy(notice).fullmatch(around, i, j)):
                found.append((sum(whole.fuzzy_counts), i, j))
    return (min(found)[1], min(found)[2], min(found)[0]) if found else None


def _verify(text: str, seeds: list) -> dict:
    """Base places (word numbers) and fuzzy notices (first word, end word, label: edits, share) of one text."""
    text = text.strip(" ")
    padded = f" {text} "
    # word i of the text starts after the space spaces[i] of the padded text
    spaces = np.flatnonzero(np.frombuffer(padded.encode("latin-1"), np.uint8) == 0x20)
    places, base, notices = [], set(), {}
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        hits = []
        while at >= 0:
            hits.append(at)
            at = padded.find(f" {phrase} ", at + 1)
        if hits:
            base.add(label)
            places += np.searchsorted(spaces, hits).tolist()
    done: dict[str, int] = {}
    for at, uses in seeds:
        for notice, offset in uses:
            if notice is None or at < done.get(notice, -1):
                continue
            k = edits(notice)
            # the padded text has a space before and after; one character more on either side shows edges
            a, b = max(0, at - offset - 2 * k), at - offset + len(notice) + 2 * k + 2
            if m := _match(notice, padded[a:b]):
                start, end = a + m[0] - 1, a + m[1] - 1
                first, last = np.searchsorted(spaces, (start + 1, end), side="right") - 1
                notices[int(first), int(last) + 1, NOTICES[notice]] = (m[2], (m[2] + 1) / (len(notice) + 1))
                done[notice] = end
    return {"places": places, "base": base, "notices": notices}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the notices found in every whole text: label, words that they span (from 0, end exclusive), edits."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))

    def fn(column: pa.Array) -> dict:
        _, found = scan_block(column)
        rows = [[{"label": name, "first_word": s, "end_word": e, "edits": x} for (s, e, name), (x, _) in sorted(found[i]["notices"].items())] if i in found else [] for i in range(len(column))]
        return {"notices": pa.array(rows, kind)}

    return tb.map_text(docs, fn, "notices array<struct<label:string,first_word:bigint,end_word:bigint,edits:bigint>>")


def labels(docs: DataFrame) -> DataFrame:
    """doc_id, word and phrase counts, labels and score of every document, and its notices as
    label:first word:end word:edits, comma-joined in the order of their words."""

    def fn(column: pa.Array) -> dict:
        n_words, found = scan_block(column)
        none = {"places": [], "base": set(), "notices": {}}
        rows = [found.get(i, none) for i in range(len(column))]
        best = [1.0 if r["base"] else 1 - min((x for _, x in r["notices"].values()), default=1.0) for r in rows]
        return {
            "n_words": n_words.astype(np.int64),
            "n_base": np.array([len(r["places"]) for r in rows], np.int64),
            "first_word": pa.array([min(r["places"], default=None) for r in rows], pa.int64()),
            "last_word": pa.array([max(r["places"], default=None) for r in rows], pa.int64()),
            "base_labels": [",".join(sorted(r["base"])) for r in rows],
            "labels": [",".join(sorted(r["base"] | {k[2] for k in r["notices"]})) for r in rows],
            "score": np.array(best, np.float64),
            "notices": [",".join(f"{name}:{s}:{e}:{x}" for (s, e, name), (x, _) in sorted(r["notices"].items())) for r in rows],
        }

    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"
    return tb.map_text(docs, fn, columns)
