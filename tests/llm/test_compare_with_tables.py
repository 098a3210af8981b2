"""Token alignment, decontamination and vector codes against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import alignment, decontaminate, queries, vectorcodes
from graphloom.llm import textbuf as tb

TEXTS = [
    (0, None), (1, ""), (2, " "), (3, "  two  spaces\n\nand\tlines "), (4, "plain words, plain words; 12345 plain"), (4, "plain words, plain words; 12345 plain"),
    (5, "U+2581 here: ▁ is no space"), (6, "ÄÖ中文 é\x00\x1c \U0001f600 it's we'll <|endoftext|> <s></s> <0x41>"), (None, "row without an id"),
    (7, "x" * 3000), (8, "".join(chr(c) for c in range(0x400, 0x460)) + " Ünïcödé ünïcödé"), (9, "lorem " * 2000),
]
CLASH = "text string, doc_id long, n_a string, code int, row int, items string, label int, ranges int, k1 int, word string"


def docs_of(spark, rows):
    return spark.createDataFrame([(t, i, "clash", 1, 2, "x", 3, 4, 5, "w") for i, t in rows], CLASH)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


# -- alignment ---------------------------------------------------------------------------------


def aligned_plainly(rows):
    """(n_a, n_b, groups as text, links) of each text with the libraries themselves, ends met by a dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries._vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=queries._vocabulary("piece_bpe_32k.model"))
    to_byte = alignment._byte_of()
    out = []
    for _, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(to_byte[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((0, 0, "", []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both = sorted(set(end_a) & set(end_b))
        groups, links, low = [], [], 0
        for cut in both:
            mine = [i for i, e in zip(a, end_a, strict=True) if low < e <= cut], [i for i, e in zip(b, end_b, strict=True) if low < e <= cut]
            groups.append("|".join(",".join(map(str, m)) for m in mine))
            links.append((mine[0][-1], mine[1][-1]))
            low = cut
        out.append((len(a), len(b), ";".join(groups), links))
    return out


@pytest.mark.parametrize("pairs_most", [None, 0])
def test_alignment(spark, pairs_most):
    docs = docs_of(spark, TEXTS)
    paths = queries._vocabulary("byte_bpe_50k.json"), queries._vocabulary("piece_bpe_32k.model")
    got = by_id(alignment.digests(docs, *paths, pairs_most))
    want = aligned_plainly(TEXTS)
    count = Counter(x for _, _, _, links in want for x in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    assert sum(map(len, got.values())) == len(TEXTS)
    for (i, _), (n_a, n_b, groups, links) in zip(TEXTS, want, strict=True):
        r = got[i][0]
        n = groups.count(";") + 1 if groups else 0
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n, len(links)), i
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r.n_best == sum(count[x] == most[x[1]] for x in links) and r.count_sum == sum(count[x] for x in links)
    assert want[6][0] == 0 and want[4][0] > 0, "a text that holds the space sign itself is not aligned"
    assert alignment.digests(docs.where("false"), *paths).count() == 0
    told = by_id(alignment.groups(docs, *paths))
    for (i, text), (_, _, groups, _) in zip(TEXTS, want, strict=True):
        rows = told[i][0].groups
        assert ";".join("|".join(",".join(map(str, x)) for x in (g.a, g.b)) for g in rows) == groups
        assert not rows or ([g.start for g in rows[1:]] == [g.end for g in rows[:-1]] and (rows[0].start, rows[-1].end) == (0, len(text.encode()) + 1))


def test_division_finds_every_common_end():
    rng = np.random.default_rng(3)
    for _ in range(300):
        ends_a, ends_b, stop_a, stop_b, base = [], [], [], [], 0
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(1, 60))
            share = rng.choice([0.05, 0.5, 0.95])
            for ends, stop in ((ends_a, stop_a), (ends_b, stop_b)):
                ends += sorted({*(base + 1 + np.flatnonzero(rng.random(n) < share)).tolist(), base + n})
                stop.append(len(ends))
            base += n
        a, b = np.array(ends_a), np.array(ends_b)
        at, to = alignment.cuts(a, b, np.array(stop_a), np.array(stop_b))
        both = np.intersect1d(a, b)
        assert a[at].tolist() == both.tolist() == b[to].tolist()


def test_alignment_of_endless_white_space():
    """The fast library gives up on it; the slow one takes over."""
    x = alignment.Aligned(tb.texts(pa.array([" " * 1_000_000 + "x", "y"])), queries._vocabulary("byte_bpe_50k.json"), queries._vocabulary("piece_bpe_32k.model"))
    assert x.docs.tolist() == [0, 1] and x.end_a[x.n_a[0] - 1] == 1_000_002


# -- decontamination ---------------------------------------------------------------------------


def normal_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def leaks(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = normal_words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for _, t in docs:
        w, hit, found = normal_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (mine := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in mine if i is not None}
        out.append((len(w), hit, sorted(found)))
    return out


def leak_case(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "中文"]
    text = lambda low, high: rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randint(low, high)))
    items = [(rng.choice([None, *range(10, 30)]), text(1, 30)) for _ in range(15)] + [(7, None), (8, ""), (9, " - "), (5, "W3 w3"), (5, "W3 w3")]
    docs = [(k, text(0, 60)) for k in range(25)] + [(50, None), (51, ""), (52, items[0][1].upper()), (52, items[0][1].upper()), (None, "x " + items[1][1])]
    docs += [(60, "pad " * 3000 + items[2][1] + " pad" * 3000)]
    return docs, items


@pytest.mark.parametrize(("seed", "block_bytes"), [(0, None), (1, None), (2, 200)])
def test_decontamination(spark, seed, block_bytes):
    rows, items = leak_case(seed)
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame([(t, i, "clash") for i, t in items], "text string, item_id long, doc_id string")
    got = defaultdict(list)
    for r in decontaminate.contaminated(docs, bench, block_bytes=block_bytes).collect():
        got[r.doc_id].append((r.n_words, {k for x in r.ranges for k in range(x.start, x.end)}, r["items"], [(x.start, x.end) for x in r.ranges]))
    for (i, _), (n, hit, found) in zip(rows, leaks(rows, items), strict=True):
        assert (n, hit, found) in [x[:3] for x in got[i]], i
    assert all(a[1] < b[0] for xs in got.values() for x in xs for a, b in zip(x[3], x[3][1:], strict=False)), "touching ranges are one"
    assert sum(map(len, got.values())) == len(rows)


def test_decontamination_of_empty_tables(spark):
    docs = docs_of(spark, [(1, "some words of a text"), (2, None)])
    bench = spark.createDataFrame([(1, "words of a")], "item_id long, text string")
    assert decontaminate.digests(docs.where("false"), bench).count() == 0
    none = {r.doc_id: r for r in decontaminate.digests(docs, bench.where("false")).collect()}
    assert [(none[i].n_words, none[i].n_hit, none[i].n_items, none[i].contaminated) for i in (1, 2)] == [(5, 0, 0, False), (0, 0, 0, False)]
    some = {r.doc_id: r for r in decontaminate.digests(docs, bench).collect()}
    assert (some[1].n_hit, some[1].n_items, some[1].contaminated) == (3, 1, True)
    assert some[1].items_sha256 == hashlib.sha256(b"1").hexdigest() and some[2].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_decontamination_verifies_words(monkeypatch):
    """With a hash that cannot tell words apart, verification alone decides."""
    monkeypatch.setattr(tb, "word_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    rows, items = leak_case(4)
    rows = [(i, t) for i, t in rows if len(t or "") < 2000]
    index = decontaminate.Index([None if i is None else str(i) for i, _ in items], [t for _, t in items])
    _, hit, found = index.search(tb.texts(pa.array([t for _, t in rows])))
    want = leaks(rows, items)
    assert int(hit.sum()) == sum(len(h) for _, h, _ in want)
    assert [index.items[x].tolist() for x in found] == [f for _, _, f in want]


@pytest.mark.parametrize("block_bytes", [None, 60])
def test_cleaned(spark, block_bytes):
    passage = " ".join(f"p{k}" for k in range(14))
    rows = [(1, f"Before, {passage}! After."), (2, "clean text"), (3, passage), (3, passage), (4, None), (5, f"{passage} mid {passage}")]
    bench = spark.createDataFrame([(1, passage), (2, " ".join(f"q{k}" for k in range(20)))], "item_id long, text string")
    docs = docs_of(spark, rows)
    spans = decontaminate.cleaned(docs, bench, block_bytes=block_bytes)
    assert spans.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in spans.where("text IS NOT NULL").collect()) == [(1, "Before, ! After."), (2, "clean text"), (3, ""), (3, ""), (5, " mid ")]
    assert sorted(r.doc_id for r in decontaminate.cleaned(docs, bench, whole=True, block_bytes=block_bytes).collect()) == [2, 4]


# -- vector codes ------------------------------------------------------------------------------


def codes_plainly(rows, parts=4, entries=256, rounds=4):
    """{row number: (code, error)} and the codebooks, with Python integers."""
    from fractions import Fraction

    good = [(k, i, [int(Fraction(x) * 1024 // 1) for x in v]) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max([parts, *(-(-len(v) // parts) * parts for _, _, v in good)])
    good = [(k, i, v + [0] * (dim - len(v))) for k, i, v in good]
    order = sorted(good, key=lambda g: (g[1] is None, g[1] or 0, g[2]))[:entries]
    p = dim // parts
    books = [[g[2][j * p : j * p + p] for g in order] for j in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for j, book in enumerate(books):
            mine = defaultdict(list)
            for _, _, v in good:
                mine[nearest(v[j * p : j * p + p], book)[1]].append(v[j * p : j * p + p])
            books[j] = [[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if e in mine else c for e, c in enumerate(book)]
    out = {}
    for k, _, v in good:
        best = [nearest(v[j * p : j * p + p], books[j]) for j in range(parts)]
        out[k] = "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), 2**63 - 1)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vector_rows(seed):
    rng = np.random.default_rng(seed)
    size = 8 if seed != 3 else 6
    centres = rng.normal(size=(9, size))
    rows = [(k, (centres[k % 9] + rng.normal(size=size) * 0.02).tolist(), k % 5 or None) for k in range(400)]
    rows += [(400, None, 1), (401, [None] * size, 1), (402, [float("nan")] * size, 2), (403, [float("inf")] * size, 2), (None, [0.5] * size, None)]
    rows += [(404, rows[0][1], 7), (404, rows[0][1], 7), (404, rows[1][1], None)]
    if seed == 1:
        rows += [(-5, [1e300, -1e300] + [3.0] * (size - 2), 9), (500, [-1e308] * size, 9), (501, [2.0**40] * size, None)]
    if seed == 2:
        rows = [(-k, [float(x) for x in rng.integers(-3, 4, size)], None) for k in range(300)] + [(7, [], 1), (8, [1.0, 2.0, 3.0], 1)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_vector_codes(spark, seed):
    """Clusters, huge numbers, ties and short vectors, sizes that parts do not divide."""
    rows = vector_rows(seed)
    table = spark.createDataFrame([(v, i, label, "clash", 1) for i, v, label in rows], "embedding array<double>, vec_id long, label int, code string, v int")
    want, sha = codes_plainly(rows)
    got = vectorcodes.digests(table).collect()
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter((rows[k][0], *x) for k, x in want.items())
    assert {r.codebooks_sha256 for r in got} == {sha}
    sums = defaultdict(int)
    for k, (_, e) in want.items():
        sums[rows[k][2]] += e
    assert Counter(r.label_error for r in got) == Counter(min(sums[rows[k][2]], 2**63 - 1) for k in want)


def test_vector_codes_of_nothing(spark):
    table = spark.createDataFrame([(None, 1, 2)], "embedding array<float>, vec_id long, label int")
    assert vectorcodes.digests(table).count() == 0 and vectorcodes.digests(table.where("false")).count() == 0
    one = vectorcodes.digests(spark.createDataFrame([([0.1] * 4, 3)], "embedding array<float>, vec_id long")).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(3, "00000000", 0, 0)]


@pytest.mark.parametrize("kind", ["float64", "int64", "object"])
def test_trees_find_the_nearest_entry(kind):
    rng = np.random.default_rng(1)
    for _ in range(20):
        span, size = int(rng.choice([1, 30, 900])), int(rng.integers(1, 12))
        entries, x = (rng.integers(-span, span + 1, (n, size)).astype(kind) for n in (int(rng.integers(1, 200)), 60))
        if kind == "object":
            entries, x = entries * 10**40, x * 10**40
        where, best = vectorcodes.Gnat(entries).nearest(x)
        for k, v in enumerate(x.tolist()):
            d, e = min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(entries.tolist()))
            assert (int(best[k]), where[k]) == (d, e)


def test_trees_rule_out_children():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 16)) * 1000
    entries, x = (np.round(centres[np.arange(n) % 16] + rng.normal(size=(n, 16)) * 20) for n in (256, 2000))
    counted: list[int] = []
    vectorcodes.Gnat(entries).nearest(x, counted)
    assert sum(counted) < 2000 * 256 / 4
