"""What the classifiers and rules measure, recomputed text by text in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import jaccard, quality, queries, repeats, rules, toxicity
from tests.conftest import SF

WORD, LONG = rb"[^\x20\x09-\x0D]+", 5_000_000
ODD = [
    None, "", " \n\t", "A", "AB CD!! x|y", "same same same same\nsame line\nsame line\n\nx", "ÄÖ中 été \x1c it's; WE'LL.  \n x",
    "#tag $x *a* supercalifragilistic " * 40, "one two three one two three one two three", "MORON! you idiotic, stupidity Idiot stupid!!!",
]


def texts_of(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices("aAbZ19 \n\t!|.,;#*é中'-", k=rng.randint(1, 300))) for _ in range(60)]


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words, lines = re.findall(WORD, raw), [x for x in raw.split(b"\n") if x]
    kinds = [rb"[A-Z]", rb"[0-9]", rb"[\x20\x09-\x0D]", rb"[\x80-\xff]", rb"[*#$%&<>@^~]", rb"!", rb"\|", rb"[.?]", rb"[,;:]"]
    count = [len(re.findall(k, raw)) for k in kinds]
    count.append(len(raw) - sum(count) - len(re.findall(rb"[a-z]", raw)))
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    share = lambda flags: sum(flags) / max(len(words), 1)
    return [
        math.log1p(len(words)), math.log1p(len(lines)), share(map(len, words)), *(c / max(len(raw), 1) for c in count),
        share(bool(re.fullmatch(rb"[A-Z]{2,}", w)) for w in words), share(bool(re.search(kinds[4], w)) for w in words),
        share(b"!" in w for w in words), share(len(w) > 15 for w in words),
        len(set(triples)) / len(triples) if triples else 1.0, share(a == b for a, b in zip(words, words[1:], strict=False)),
        (len(lines) - len(set(lines))) / max(len(lines), 1), len(words) / max(len(lines), 1),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_statistics(seed):
    mine = texts_of(seed)
    got = quality.statistics(pa.array([t or "" for t in mine], pa.large_string()))
    assert got.shape == (len(mine), len(quality.NAMES))
    for row, text in zip(got, mine, strict=True):
        assert dict(zip(quality.NAMES, row.tolist(), strict=True)) == pytest.approx(dict(zip(quality.NAMES, statistics(text), strict=True)), abs=1e-12), text


def held(text: str | None, terms: list[tuple[bytes, bool]]) -> list[int]:
    raw = (text or "").encode()
    words = set(re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)))
    found = [i for i, (t, prefix) in enumerate(terms) if (any(w.startswith(t) and len(w) > len(t) for w in words) if prefix else t in words)]
    patterns = (len(re.findall(rb"[A-Z]", raw)) > 0.5 * max(len(raw), 1), raw.count(b"!") > 0.03 * max(len(raw), 1))
    return found + [len(terms) + k for k, fires in enumerate(patterns) if fires]


def test_held_terms(spark):
    terms = [(b"idiot", False), (b"idiot", True), (b"stup", True), (b"moron", False), ("été".encode(), False), (b"stupid", True), (b"same", False)]
    mine = texts_of(3) + ["x " * (LONG // 2) + "idiots moron"]
    got = toxicity.held_terms(spark.createDataFrame(list(enumerate(mine)), "doc_id long, text string"), terms).collect()
    assert {r.doc_id: list(r.terms) for r in got} == {i: held(t, terms) for i, t in enumerate(mine)}


def test_texts_that_share_an_id_are_learned_from_alike(spark):
    """The rows of an id come in another order and in other partitions; the scores stay."""
    rng = random.Random(4)
    say = lambda bad: " ".join(rng.choices(["idiotic", "moronic", "vile"] if bad else ["calm", "river", "stone"], k=8)) + "!" * (9 * bad)
    rows = [(i, say(i % 2)) for i in range(60)] + [(i, say((i + 1) % 2)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    for fn in (quality.quality_scores, toxicity.toxicity_scores):
        seen = []
        for order, parts in ((rows, 1), (rows[::-1], 1), (rows, 5)):
            out = fn(spark.createDataFrame(order, "doc_id long, text string").repartition(parts), labels).collect()
            seen.append(sorted((r.doc_id, round(r.score, 9)) for r in out))
        assert seen[0] == seen[1] == seen[2], fn.__name__


def paths() -> list[str]:
    return [queries._vocabulary("piece_bpe_32k.model"), queries._vocabulary("byte_bpe_multi_50k.tiktoken")]


def fertility(text: str | None, path: str) -> list[float]:
    encode, part = rules._tokeniser(path)
    words = [w.decode() for w in re.findall(WORD, (text or "").encode())]
    ids = [t for w in encode(words) for t in w]
    whole = max(len(ids), 1)
    entropy = -sum(c / whole * math.log2(c / whole) for c in Counter(ids).values())
    return [sum(map(len, words)) / whole, sum(bool(part[t]) for t in ids) / whole, entropy]


def test_fertility_and_verdicts(spark):
    """Measures, bands and verdicts of all documents and the odd texts, by loops."""
    have = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(texts_of(5))], "doc_id long, text string, lang string")
    docs = have.unionByName(extra).cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    measured = [r.asDict() for r in rules.measure(docs, paths()).collect()]
    names = [n for i in range(2) for n in rules.measures(i)]
    for r in measured:
        assert r["length"] == int(math.log2(max(r["n_words"], 1)))
        for i, path in enumerate(paths()):
            for name, value, step in zip(rules.measures(i), fertility(text[r["doc_id"]], path), (0.01, 0.001, 0.01), strict=True):
                assert abs(r[name] - value) <= 0.5 * step + 1e-9, (r["doc_id"], name)
    base = lambda r: r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
    groups = defaultdict(list)
    for r in measured:
        for size in (1, 2, 3):
            if not base(r):
                groups[tuple(r[g] for g in rules.GROUP[:size])].append(r)
    bands = {}
    for group, rows in groups.items():
        if len(group) == 1 or len(rows) >= rules.LEAST_GROUP:
            for i in range(2):
                for name, kind in zip(rules.measures(i), rules.MEASURES, strict=True):
                    low, high = np.quantile([r[name] for r in rows], [0.25, 0.75])
                    reach = rules.REACH * max(high - low, rules.LEAST_RANGE[kind])
                    bands[group, name] = (low - reach, high + reach)
    got = {r.doc_id: r for r in rules.judge(docs, paths()).collect()}
    assert len(got) == len(measured)
    for r in measured:
        group = next((g for g in (tuple(r[c] for c in rules.GROUP[:size]) for size in (3, 2, 1)) if (g, names[0]) in bands), None)
        kept, edge = not base(r) and group is not None, False
        for name in names if kept else ():
            least, most = bands[group, name]
            edge |= min(abs(r[name] - least), abs(r[name] - most)) < 1e-9
            kept &= r[name] <= most and ("fallback" in name or r[name] >= least)
        assert got[r["doc_id"]].base_failed == base(r)
        assert edge or got[r["doc_id"]].kept == kept, (r["doc_id"], group)
    assert 0 < sum(r.kept for r in got.values()) < len(got)


def test_texts_of_five_megabytes(spark):
    """One word, different words, and a text that shares its second half with another."""
    rng = random.Random(6)
    one = "a " * (LONG // 2)
    many = " ".join(f"{rng.getrandbits(40):x}" for _ in range(LONG // 11))
    tail = many[len(many) // 2 :].split(" ", 1)[1]
    docs = spark.createDataFrame([(1, one), (2, many), (3, "other head " + tail), (4, "a")], "doc_id long, text string").repartition(4)
    words = {1: LONG // 2, 2: len(many.split()), 3: 2 + len(tail.split()), 4: 1}
    gone = {1: LONG // 2, 2: len(tail.split()), 3: len(tail.split()), 4: 0}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.digests(docs).collect()}
    assert cut == {i: (words[i], gone[i]) for i in words}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert near == {1: (1, 1), 2: (words[2] - 4, 2), 3: (words[3] - 4, 3), 4: (1, 4)}
    ruled = {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed) for r in rules.judge(docs, paths()).collect()}
    assert ruled == {1: (words[1], words[1], True), 2: (words[2], 0, False), 3: (words[3], 0, False), 4: (1, 0, True)}
