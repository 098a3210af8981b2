"""Operator 9: toxicity by weak supervision.

1. Lexicon: words and word prefixes that mark toxic rows are mined from a bounded sample of
   labelled rows of the learning folds (`max_train_rows`; Spark counts them, and all that pass the
   significance test stay), and join a short seed list. Every term is a lexicon voter; shares of
   capitals and exclamation marks are pattern voters.
2. One pass over every whole text notes which terms it holds; the short rows are written.
3. A generative label model of two classes is fitted by expectation-maximisation on the counts of
   vote patterns of all documents, as Spark sums, anchored by the same counts over the labelled
   sample. Its parameters are the voters' rates in each class (their accuracies), and their
   correlations: a voter may depend on one other voter that fires more often, and then has one
   rate beside it and one without it. Which voter that is follows from the pairs that fire
   together beyond chance in the toxic class, after a first round without dependences.
4. A logistic regression on the terms is trained on the posterior labels of the sample and
   scores all documents.

Defined results: null and empty texts hold no terms and get the score of a text without any;
repeated rows are scored each; a row with a null id belongs to fold 0; of several labels of a
document the smallest counts, and of several texts of an id the one with the least list of terms
trains the linear classifier. Without toxic rows to learn from, the seeds vote alone. Extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb
from graphloom.llm.quality import fold, train_ids

#: Bound of the labelled rows that are mined.
MAX_TRAIN_ROWS = 20_000
#: Correlation in the toxic class from which a voter depends on another, and how often two such must fire there.
LEAST_CORRELATION, LEAST_FIRES = 0.5, 5.0
#: Rows that a voter's rate beside another counts for before any are seen (its rate is then the same in both classes).
PRIOR_ROWS = 5.0
#: Bytes of the prefixes that are looked at beside whole words.
PREFIXES = (4, 5, 6)
#: Bytes of the shortest terms.
SHORTEST = 4
#: Different terms that a row brings about, for the number of terms that could stand out by chance.
TERMS_A_ROW = 200

# Common insults that vote whether or not they can be mined.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "imbecile", "pathetic", "worthless", "disgusting")

_LETTERS = tb.table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
_UPPER = tb.table(lambda b: 0x41 <= b <= 0x5A)
#: Pattern voters: numbers beyond the terms.
PATTERNS = ("shouting", "exclaiming")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = tb.flat(column)
    low = tb.lower_ascii(buf)
    starts, ends = tb.word_bounds(low, offs, _LETTERS)
    return low, starts, ends, np.repeat(np.arange(len(column)), tb.per_text(starts, offs))


def mine(docs: DataFrame, ids: DataFrame) -> list[tuple[bytes, bool]]:
    """(term, is it a prefix) of the strongest terms among the labelled rows."""
    mine_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most max_train_rows ids
    # copies and near copies count once or a few times, or all words of a family would look like
    # marks: texts are grouped by the two least hashes of their long words
    long_words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+")), lambda w: F.length(w) >= 8)
    least = F.slice(F.array_sort(F.transform(long_words, lambda w: F.xxhash64(w))), 1, 2)
    kin = F.when(F.size(least) == 2, F.xxhash64(least)).otherwise(F.xxhash64("text"))
    mine_ = mine_.join(F.broadcast(ids), "doc_id").groupBy(kin.alias("kin"), "label").agg(F.min("text").alias("text")).select("text", "label")

    def count(batches):
        for batch in batches:
            column, label = tb.texts(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in tb.blocks(column):
                low, starts, ends, doc = _words(column.slice(a, b - a))
                hashes = tb.word_hashes(low, starts, ends)
                _, first = np.unique(hashes ^ tb.mix(doc.astype(tb.U64)), return_index=True)
                u, at, which = np.unique(hashes[first], return_index=True, return_inverse=True)
                toxic = np.bincount(which, weights=label[a:b][doc[first]] > 0, minlength=len(u)).astype(np.int64)
                total = np.bincount(which, minlength=len(u))
                data, s, e = low.tobytes(), starts[first][at].tolist(), ends[first][at].tolist()
                words = pa.array([data[x:y] for x, y in zip(s, e, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(toxic), pa.array(total - toxic)], names=["word", "toxic", "clean"])

    words = mine_.mapInArrow(count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    forms = [F.struct(F.col("word").alias("term"), F.lit(False).alias("prefix"))]
    forms += [F.when(F.octet_length("word") > n, F.struct(F.expr(f"substring(word, 1, {n})").alias("term"), F.lit(True).alias("prefix"))) for n in PREFIXES]
    terms = words.select(F.explode(F.array_compact(F.array(*forms))).alias("t"), "toxic", "clean")
    terms = terms.where(F.octet_length("t.term") >= SHORTEST).groupBy("t.term", "t.prefix").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share, rows = ids.agg(F.avg("label"), F.count("*")).first()
    share = share or 0.0
    if not 0 < share < 1:
        return []
    n = F.col("a") + F.col("b")
    g2 = 2 * (F.col("a") * F.log(F.col("a") / n / share) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n / (1 - share))).otherwise(0.0))
    strong = terms.where((F.col("a") >= 3) & (F.col("b") <= 0.05 * F.col("a"))).withColumn("g2", g2).where(F.col("g2") >= 2 * math.log(TERMS_A_ROW * rows))
    found: dict[tuple[bytes, bool], None] = {}
    # forms of the sample's words, so bounded as it is
    for r in strong.orderBy(F.desc("g2"), F.desc("prefix"), F.octet_length("term"), "term").collect():
        term = bytes(r.term)
        # a term adds nothing to a prefix of its own that is already there
        if not any((term[:n], True) in found for n in range(SHORTEST, len(term) + 1)):
            found[term, r.prefix] = None
    return list(found)


def _hash(term: bytes) -> int:
    raw = np.frombuffer(term, np.uint8)
    return int(tb.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def held_terms(docs: DataFrame, terms: list[tuple[bytes, bool]]) -> DataFrame:
    """doc_id and the sorted numbers of the terms and patterns that each whole text holds."""
    keys = [(len(t) if prefix else 0, _hash(t), i) for i, (t, prefix) in enumerate(terms)]
    tables = {n: sorted((h, i) for m, h, i in keys if m == n) for n in (0, *PREFIXES)}
    tables = {n: (np.array([h for h, _ in x], tb.U64), np.array([i for _, i in x], np.int64)) for n, x in tables.items() if x}

    def fn(column: pa.Array) -> dict:
        low, starts, ends, doc = _words(column)
        buf, offs = tb.flat(column)
        found_doc, found_term = [], []
        for n, (hashes, numbers) in tables.items():
            ok = np.flatnonzero(ends - starts > n) if n else np.arange(len(starts))
            h = tb.word_hashes(low, starts[ok], starts[ok] + n if n else ends)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            found_doc.append(doc[ok[hit]])
            found_term.append(numbers[at[hit]])
        size = np.maximum(np.diff(offs), 1)
        for k, flags in enumerate((tb.per_text(np.flatnonzero(_UPPER[buf]), offs) > 0.5 * size, tb.per_text(np.flatnonzero(buf == 0x21), offs) > 0.03 * size)):
            found_doc.append(np.flatnonzero(flags))
            found_term.append(np.full(int(flags.sum()), len(terms) + k))
        pairs = np.unique(np.stack([np.concatenate(found_doc), np.concatenate(found_term)], axis=1), axis=0)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(column) + 1))
        return {"terms": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pairs[:, 1], pa.int32()))}

    return tb.map_text(docs, fn, "terms array<int>")


class LabelModel:
    """Log-odds: a bias, a weight of each voter where it fires alone, and one where the voter that it
    depends on (parent, or -1) fires too."""

    def __init__(self, size: int):
        self.bias, self.parent = 0.0, np.full(size, -1)
        self.alone, self.beside = np.zeros(size), np.zeros(size)

    def log_odds(self, terms: list[int]) -> float:
        held = set(terms)
        return self.bias + float(sum(self.beside[t] if self.parent[t] in held else self.alone[t] for t in terms))

    def column(self) -> Column:
        """The log-odds of the column terms."""
        alone, beside, parent = (_lits(x) for x in (self.alone, self.beside, self.parent))
        weight = lambda v: F.when(F.array_contains("terms", F.element_at(parent, v + 1)), F.element_at(beside, v + 1)).otherwise(F.element_at(alone, v + 1))
        return F.aggregate("terms", F.lit(self.bias), lambda acc, v: acc + weight(v))


def _lits(values: np.ndarray) -> Column:
    return F.array(*[F.lit(x) for x in values.tolist()])


def _fires(rows: DataFrame, weights: list[str], parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weight columns where each voter fires (for all rows in the last place), and where its parent fires too."""
    size = len(parent)
    one = rows.select(F.explode(F.concat(F.array(F.lit(size)), "terms")).alias("v"), "terms", *weights)
    both = F.array_contains("terms", F.element_at(_lits(np.append(parent, -1)), F.col("v") + 1))
    fire, joint = np.zeros((size + 1, len(weights))), np.zeros((size + 1, len(weights)))
    for r in one.groupBy("v", both.alias("both")).agg(*[F.sum(w).alias(w) for w in weights]).collect():
        fire[r.v] += [r[w] for w in weights]
        if r.both:
            joint[r.v] = [r[w] for w in weights]
    return fire, joint


def dependences(post: DataFrame, fire: np.ndarray) -> np.ndarray:
    """For each voter the one that it depends on, or -1: of those that fire more often in the toxic
    class the one that it correlates with most there. One row a voter returns to the driver."""
    size = len(fire) - 1
    count = fire[:size, 0]
    mass = max(float(fire[size, 0]), 1e-9)
    n, total = _lits(count), F.lit(mass)
    two = post.select(F.explode("terms").alias("v"), "terms", "p").select("v", F.explode("terms").alias("u"), "p").where("u <> v")
    two = two.groupBy("v", "u").agg(F.sum("p").alias("p"))
    a, b = F.element_at(n, F.col("v") + 1), F.element_at(n, F.col("u") + 1)
    # the voter that fires less often depends on the other, so that dependences never close a circle
    two = two.where((F.least(a, b) > LEAST_FIRES) & ((a < b) | ((a == b) & (F.col("v") > F.col("u")))))
    x, y = a / total, b / total
    over = (F.col("p") / total - x * y) / F.sqrt(F.greatest(x * (1 - x) * y * (1 - y), F.lit(1e-12)))
    best = two.withColumn("over", over).where(F.col("over") >= LEAST_CORRELATION).groupBy("v").agg(F.max_by("u", F.struct("over", "u")).alias("u"))
    parent = np.full(size, -1)
    for r in best.collect():
        parent[r.v] = r.u
    return parent


def estimated(fire: np.ndarray, joint: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The model of the weighted counts (toxic, clean) where voters fire, and where their parents fire too."""
    size = len(parent)
    model = LabelModel(size)
    model.parent = parent
    toxic, clean = fire[size]
    model.bias = math.log((toxic + 0.5) / (clean + 0.5))
    of = np.where(parent >= 0, parent, size)
    # rows where the parent fires, and where it does not; without a parent all rows are of the second kind
    there = np.where((parent >= 0)[:, None], fire[of], 0.0)
    without, away = fire[:size] - joint[:size], fire[size] - there
    a, b = (without[:, 0] + 0.05) / (away[:, 0] + 1), (without[:, 1] + 0.01) / (away[:, 1] + 1)
    model.alone = np.clip(np.log(a / b), -6, 9)
    a = (joint[:size, 0] + 0.5) / (there[:, 0] + 1)
    b = (joint[:size, 1] + PRIOR_ROWS * a) / (there[:, 1] + PRIOR_ROWS)
    model.beside = np.clip(np.log(a / b), -6, 9)
    return model


def label_model(held: DataFrame, ids: DataFrame, size: int, rounds: int = 6) -> LabelModel:
    """The label model; voters abstain where they do not fire.

    Fitted on the counts of all documents' vote patterns; what returns to the driver is two sums
    for each voter.
    """
    patterns = tb.written(held.groupBy("terms").agg(F.count("*").alias("n")), "patterns")
    labelled = held.join(F.broadcast(ids), "doc_id").select("terms", F.col("label").cast("double").alias("p"), (1.0 - F.col("label")).alias("q"))
    labelled = tb.written(labelled, "labelled")
    mass = float(patterns.agg(F.sum("n")).first()[0] or 0)
    parent = np.full(size, -1)
    anchor, joint = _fires(labelled, ["p", "q"], parent)
    weight = mass / max(anchor[size].sum(), 1)
    model = estimated(weight * anchor, weight * joint, parent)
    for k in range(rounds):
        post = patterns.withColumn("p", F.col("n") / (1 + F.exp(-model.column()))).withColumn("q", F.col("n") - F.col("p"))
        if not k:
            parent = dependences(post, _fires(post, ["p", "q"], parent)[0])
            anchor, joint = _fires(labelled, ["p", "q"], parent)
        fire, both = _fires(post, ["p", "q"], parent)
        model = estimated(weight * anchor + fire, weight * joint + both, parent)
    return model


def train_linear(rows: list, bias: float, weight: np.ndarray, steps: int = 300, penalty: float = 1e-6) -> tuple[float, np.ndarray]:
    """Logistic regression on held terms against posterior labels, by full-batch gradient steps.

    It starts from the label model's bias and weights.
    """
    n_terms = len(weight)
    y = np.array([r.posterior for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
    col = np.array([t for r in rows for t in r.terms], np.int64)
    w, b = weight.copy(), bias
    m, s = np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, weights=w[col], minlength=len(rows)))))
        g = (p - y) / max(len(rows), 1)
        grad = np.append(np.bincount(col, weights=g[row], minlength=n_terms) + penalty * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        step = 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return b, w


def toxicity_scores(docs: DataFrame, labels: DataFrame, accept: float = 0.7, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    ids = tb.written(train_ids(labels, "toxic", fold(F.col("doc_id"), 3) != 1, max_train_rows), "toxic_ids")
    mined = mine(docs, ids)
    terms = mined + [(t.encode(), False) for t in SEEDS if (t.encode(), False) not in mined]
    # the last voter fires where no other does
    size = len(terms) + len(PATTERNS) + 1
    nothing = F.when(F.size("terms") == 0, F.array(F.lit(size - 1))).otherwise(F.col("terms"))
    held = tb.written(held_terms(docs, terms).withColumn("terms", nothing), "toxic_terms")
    model = label_model(held, ids, size)
    # the sample: at most max_train_rows rows of a few numbers
    # of several texts of an id, the one with the least list of terms is learned from
    sample = held.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("terms").alias("terms")).orderBy("doc_id").collect()
    raw = [max(-30.0, min(30.0, model.log_odds(r.terms))) for r in sample]
    rows = [_Row(r.terms, 1 / (1 + math.exp(-x))) for r, x in zip(sample, raw, strict=True)]
    b, w = train_linear(rows, model.bias, model.alone)
    seen = np.bincount([t for r in rows for t in r.terms], minlength=size)
    # voters that the sample lacks take their weight from the label model
    w = np.where(seen > 0, w, model.alone)
    by_term = _lits(w)
    linear = F.aggregate("terms", F.lit(float(b)), lambda acc, t: acc + F.element_at(by_term, t + 1))
    return held.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), (1 / (1 + F.exp(-linear))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= accept).cast("int"))


class _Row:
    def __init__(self, terms: list[int], posterior: float):
        self.terms, self.posterior = terms, posterior
