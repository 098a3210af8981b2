"""Operator 5: mixing sources to target weights by soft membership. DataFrame operations only.

1. A naive Bayes classifier is trained from the labelled table: each labelled document belongs
   to a domain, and counts of binned text statistics and of mined words by domain, over a
   bounded sample of labelled rows (`max_train_rows`, chosen by hash), give its tables. All words
   that pass the significance test are kept.
2. Every whole text gets posteriors over the domains and a count of tokens; these narrow rows
   are written to the shared folder.
3. Nonnegative document rates are fitted by projected gradient on the least squares

       (s - target)' H^-1 (s - target),   s_k = sum_d rate_d * tokens_d * posterior_dk

   with H_jk = sum_d tokens_d * posterior_dj * posterior_dk, one sum for each pair of domains. In
   the metric of the documents' tokens its gradient for document d is the product of d's
   posteriors and H^-1 (s - target), and as H weighs domains by how they overlap, steps of length
   1 never overshoot and meet the targets at once where no rate falls to 0. H is summed over the
   documents whose rates can still move both ways; a step that this makes too long is taken again
   with all documents in H. A step is one
   aggregation of the written rows to a sum for each domain; a rate is recomputed from the short
   list of steps and written anew before the list grows long. Steps go on until the targets are
   met or cannot be approached any further; how far each domain is from its target is part of
   the result.

Defined results: null and empty texts have no tokens, posteriors as the statistics of an empty
text give them, and keep the rate that the steps give them; repeated rows are documents of their
own; of several labels of one document the smallest count; without labelled rows there is one
domain, "all". A target for a domain without tokens cannot be met and leaves the other domains
alone. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb

#: Bound of the labelled rows that train the classifier.
MAX_TRAIN_ROWS = 4_000
#: Least log-likelihood gain of a mined word, over all documents that hold it.
LEAST_GAIN = 12.0
#: Weights of the domains in the mixture, where present; they are scaled to sum to 1.
TARGETS = {"clean": 0.92, "low": 0.04, "toxic": 0.04}
#: Steps after which the rates are written, and steps after which the fit gives up with an error.
STEPS_KEPT, STEPS_MOST = 16, 200

#: Bins of a statistic.
BINS = 8
#: Runs of characters whose number for each token is a statistic: digits, capitals, symbols that
#: prose does without, one mark several times in a row, ends of sentences, other stops. Line feeds
#: are counted by bytes.
RUNS = (r"[0-9]++", r"[A-Z]++", r"[#*$%&|<>@^~_=+/\\{}\[\]]++", r"([!-/:-@\[-`{-~])\1++", r"[.!?]++(?=\s|$)", r"[,;:]++")
N_STATISTICS = len(RUNS) + 4


def tokens(text: Column) -> Column:
    """Tokens of a text: its maximal runs of characters that are not ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def statistics(text: Column, distinct: Column, n_letters: Column) -> list[Column]:
    """The counts that the statistics of a text are made of; distinct are its different runs of letters."""
    size = F.octet_length(text)
    return [*[F.regexp_count(text, F.lit(r)) for r in RUNS], size - F.octet_length(F.replace(text, F.lit("\n"))), size, F.size(distinct), n_letters]


def bins(c: list[Column], n_tokens: Column) -> list[Column]:
    """The bins of the statistics: 0 for nothing, else from 1 on, each so many times as wide as the one before."""
    n = F.greatest(n_tokens, F.lit(1)).cast("double")
    shares = [(x / n, 2.0, 1.0) for x in c[:-3]] + [(c[-3] / n, 1.25, 12.0), (n_tokens.cast("double"), 3.0, 2000.0), (c[-2] / c[-1], 1.3, 0.95)]
    # the last bin begins at `last`
    number = lambda x, step, last: F.floor(F.lit(float(BINS - 1)) + F.log(x / last) / math.log(step)).cast("int")
    return [F.when(x <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS - 1), number(x, step, last)))) for x, step, last in shares]


def letter_runs(text: Column) -> Column:
    """The lower-cased runs of letters of a text (with an empty one at its ends where it begins or ends otherwise)."""
    return F.split(F.lower(text), "[^\\p{L}]++")


def words(letters: Column) -> Column:
    """The different runs of four letters and more."""
    return F.filter(F.array_distinct(letters), lambda w: F.length(w) >= 4)


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled documents: toxic, low or clean."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") <= 0, "low").when(F.col("quality") > 0, "clean")
    return one.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


@dataclass
class Classifier:
    """Naive Bayes tables, by domain: log priors, log shares of each statistic's bins, and for
    each mined word the log shares of documents without and with it."""

    names: list[str]
    prior: list[float]
    bins: list[list[list[float]]]
    words: list[str]
    held: list[list[tuple[float, float]]]


_COUNTS = [f"c_{i}" for i in range(len(RUNS) + 4)]


def _read(docs: DataFrame, *more: Column) -> DataFrame:
    """more, n_tokens_, the different runs of letters and the counts of the statistics, all under names of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [f"m_{i}" for i in range(len(more))]
    rows = docs.select(*[m.alias(k) for k, m in zip(kept, more, strict=True)], text.alias("text_"), letter_runs(text).alias("letters_"))
    rows = rows.select(*kept, "text_", F.array_distinct("letters_").alias("distinct_"), F.size("letters_").alias("n_letters_"))
    counts = [c.cast("double").alias(name) for name, c in zip(_COUNTS, statistics(F.col("text_"), F.col("distinct_"), F.col("n_letters_")), strict=True)]
    return rows.select(*kept, tokens(F.col("text_")).alias("n_tokens_"), "distinct_", *counts)


def _bins() -> list[Column]:
    return bins([F.col(c) for c in _COUNTS], F.col("n_tokens_"))


def train(docs: DataFrame, labelled: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Classifier:
    """Tables from a bounded hash sample of the labelled documents (doc_id, domain)."""
    ids = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most max_train_rows ids
    mine = _read(mine.join(F.broadcast(ids), "doc_id"), F.col("domain"))
    mine = tb.written(mine.select(F.col("m_0").alias("domain"), F.array(*_bins()).alias("b"), words(F.col("distinct_")).alias("w")), "mixing_sample")
    count = {r.domain: r.n for r in mine.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(count)
    if not names:
        return Classifier(["all"], [0.0], [[[0.0] * BINS for _ in range(N_STATISTICS)]], [], [[]])
    total = sum(count.values())
    prior = [math.log(count[k] / total) for k in names]
    seen = {(r.domain, r.pos, r.col): r.n for r in mine.select("domain", F.posexplode("b")).groupBy("domain", "pos", "col").agg(F.count("*").alias("n")).collect()}
    shares_of = [[[math.log((seen.get((k, f, v), 0) + 0.2) / (count[k] + 0.2 * BINS)) for v in range(BINS)] for f in range(N_STATISTICS)] for k in names]

    one = mine.select("domain", F.explode("w").alias("word")).groupBy("word")
    table = one.agg(*[F.count_if(F.col("domain") == k).alias(f"n{i}") for i, k in enumerate(names)])
    held = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    # how far a word's share of a domain goes beyond that domain's share of all
    gain = F.greatest(F.lit(0.0), *[F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * F.log(F.col(f"n{i}") * total / (held * count[k]))) for i, k in enumerate(names) if k != "clean"])
    # words of the sample, so bounded as it is
    picked = table.withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "word").collect()
    shares = [[math.log((r[f"n{i}"] + 0.2) / (count[k] + 0.4)) for r in picked] for i, k in enumerate(names)]
    return Classifier(names, prior, shares_of, [r.word for r in picked], [[(math.log(max(1 - math.exp(x), 1e-3)), x) for x in row] for row in shares])


def memberships(docs: DataFrame, model: Classifier, *more: Column) -> DataFrame:
    """The columns `more` of the documents, with n_tokens and p, the posteriors in the order of names."""
    kept = ["m_0"] if more else []
    rows = _read(docs, *([F.struct(*more)] if more else []))
    numbers = [b.alias(f"b_{f}") for f, b in enumerate(_bins())]
    # mined words are found in the set of a text's words, whole words against whole words
    known = F.array(*map(F.lit, model.words)).cast("array<string>")
    hits = F.array_intersect("distinct_", known) if model.words else known
    rows = rows.select(*kept, "n_tokens_", *numbers, hits.alias("hits_"))
    logs = []
    for k in range(len(model.names)):
        raw = F.lit(model.prior[k] + sum(no for no, _ in model.held[k]))
        for f, share in enumerate(model.bins[k]):
            raw = raw + F.element_at(F.array(*[F.lit(x) for x in share]), F.col(f"b_{f}") + 1)
        if model.words:
            gains = F.create_map(*[F.lit(x) for w, (no, yes) in zip(model.words, model.held[k], strict=True) for x in (w, yes - no)])
            raw = raw + F.aggregate("hits_", F.lit(0.0), lambda acc, w: acc + F.element_at(gains, w))  # noqa: B023
        logs.append(raw.alias(f"l_{k}"))
    rows = rows.select(*kept, "n_tokens_", *logs)
    every = range(len(logs))
    post = [1 / sum((F.exp(F.least(F.lit(700.0), F.col(f"l_{j}") - F.col(f"l_{k}"))) for j in every if j != k), F.lit(1.0)) for k in every]
    return rows.select(*(["m_0.*"] if more else []), F.col("n_tokens_").alias("n_tokens"), F.array(*post).alias("p"))


def rate(steps: list[list[float]], start: Column | None = None) -> Column:
    """A document's rate after the steps: each goes down the gradient and back to what is not negative."""
    r = F.lit(1.0) if start is None else start
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col("p")[k] * F.lit(x) for k, x in enumerate(step)), F.lit(0.0)))
    return r


def fit(rows: DataFrame, targets: list[float], close: float = 1e-7) -> tuple[DataFrame, list[float]]:
    """(rows with their rate, tokens beyond the target by domain) for written rows (n_tokens, p, ...).

    It ends where all targets are met to `close` of all tokens, where a step brings the rates nearer to
    them by less than a thousandth, or after STEPS_MOST steps. Targets that no rates can meet, and those
    on the edge of what rates can, end with a rest, which is returned; it is never an error.
    """
    size = len(targets)

    def at(r: Column) -> tuple[np.ndarray, np.ndarray]:
        """(expected tokens of each domain, H over the documents whose rate is not 0)."""
        one = rows.select("n_tokens", r.alias("r"), *[F.col("p")[k].alias(f"p{k}") for k in range(size)])
        whole = [F.sum(F.col("r") * F.col("n_tokens") * F.col(f"p{k}")) for k in range(size)]
        both = [F.sum(F.when(F.col("r") > 0, F.col("n_tokens") * F.col(f"p{k}") * F.col(f"p{j}"))) for k in range(size) for j in range(size)]
        got = np.array([x or 0.0 for x in one.agg(*whole, *both).first()], float)
        return got[:size], np.linalg.pinv(got[size:].reshape(size, size), rcond=1e-12)

    start, steps = F.lit(1.0), []
    now, metric = at(start)
    whole, scale, last, before = metric, max(float(now.sum()), 1.0), math.inf, None
    for _ in range(STEPS_MOST):
        left = now - np.array(targets)
        worth = float(left @ whole @ left)
        if before is not None and worth > last:
            # documents whose rates fell to 0 took part in the step: again, with all documents in H
            left, before = before, None
            steps[-1] = (whole @ left).tolist()
        elif np.abs(left).max(initial=0.0) <= close * scale or worth >= last * (1 - 1e-3):
            return rows.withColumn("rate", rate(steps, start)).drop("start_"), left.tolist()
        else:
            if len(steps) == STEPS_KEPT:
                rows, steps, start = tb.written(rows.withColumn("start_", rate(steps, start)), "rates"), [], F.col("start_")
            last, before = worth, left
            steps.append((metric @ left).tolist())
        now, metric = at(rate(steps, start))
    # hard targets (on the edge of what any rates can meet) are approached ever more slowly: what is left is told
    return rows.withColumn("rate", rate(steps, start)).drop("start_"), (now - np.array(targets)).tolist()


def _fitted(docs: DataFrame, model: Classifier, targets: Mapping[str, float] | None, hold: str, *more: Column) -> tuple[DataFrame, list[float]]:
    """(the columns `more` of the documents with n_tokens, p and rate, written; tokens beyond the target by domain, as shares of it)."""
    rows = tb.written(memberships(docs, model, *more), "memberships")
    weights = [(targets or TARGETS).get(k, 0.0) for k in model.names]
    whole = sum(weights)
    if not whole:
        return rows.withColumn("rate", F.lit(1.0)), [0.0] * len(weights)
    sums = rows.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(len(weights))]).first()
    budget = float(sums[0] or 0)
    if hold in model.names and weights[model.names.index(hold)]:
        at = model.names.index(hold)
        budget = (sums[1 + at] or 0.0) * whole / weights[at]
    wanted = [budget * w / whole for w in weights]
    rated, beyond = fit(rows, wanted)
    return rated, [x / t if t else 0.0 for x, t in zip(beyond, wanted, strict=True)]


def rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] | None = None, hold: str = "clean") -> DataFrame:
    """doc_id, source, n_tokens, one posterior for each domain, and the fitted rate of every
    document; and for each domain how far the mixture is from its target, as a share of it.

    The mixture has as many tokens as leave the domain `hold` as large as it is; without that
    domain, as many as there are.
    """
    model = train(docs, domains(labels))
    rows, beyond = _fitted(docs, model, targets, hold, F.col("doc_id"), F.col("source"))
    posterior = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(model.names)]
    gaps = [F.lit(float(x)).alias(f"gap_{name}") for name, x in zip(model.names, beyond, strict=True)]
    return rows.select("doc_id", "source", "n_tokens", *posterior, "rate", *gaps)


def copies(r: Column, *key: Column) -> Column:
    """How often a document stands in the mixture: its rate, rounded up or down by hash of a key.

    It is rounded up with the probability of its fraction, so the expected number is the rate
    itself, whatever its size. Rows of one key share the draw.
    """
    dice = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(r + dice).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] | None = None, hold: str = "clean") -> DataFrame:
    """The documents with the same columns, each as often as its rate says (not at all, once or more).

    The posteriors are written beside the texts, so that no text is shuffled or joined.
    """
    names = docs.columns
    model = train(docs, domains(labels))
    whole = [F.struct(*names).alias("row_"), F.xxhash64("doc_id", "text").alias("key_")]
    rows, _ = _fitted(docs, model, targets, hold, *whole)
    times = rows.select("row_", copies(F.col("rate"), F.col("key_")).alias("n_"))
    return times.select("row_", F.explode(F.array_repeat(F.lit(1), F.col("n_")))).select(*[F.col("row_")[c].alias(c) for c in names])
