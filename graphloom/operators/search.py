"""Tiered text search over nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.relational import first_wins


def terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^a-z0-9_]+")), lambda t: t != "")


def inverted(nodes: DataFrame) -> DataFrame:
    """id, term: the index of names and paths."""
    return nodes.select("id", F.explode(terms(F.concat_ws(" ", "name", "path"))).alias("term"))


def full_text(nodes: DataFrame, query: str) -> DataFrame:
    """id, hits: nodes that hold every word of the query."""
    import re

    wanted = sorted({t for t in re.split(r"[^a-z0-9_]+", query.lower()) if t})
    found = inverted(nodes).where(F.col("term").isin(*wanted)).groupBy("id").agg(F.count("*").alias("hits"))
    return found.where(F.col("hits") == len(wanted))


def substring(nodes: DataFrame, query: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("name"), F.lit(query.lower())))


def search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """id, match, tier: exact name, exact path, all words, then substring; a node keeps its first tier."""
    tiers = [
        ("name", nodes.where(F.col("name") == query)), ("path", nodes.where(F.col("path") == query)),
        ("text", full_text(nodes, query)), ("substring", substring(nodes, query)),
    ]
    rows = None
    for k, (match, found) in enumerate(tiers):
        one = found.select("id", F.lit(match).alias("match"), F.lit(k).alias("tier"))
        rows = one if rows is None else rows.unionByName(one)
    return first_wins(rows, ["id"], [F.col("tier")]).orderBy("tier", "id").limit(limit)


def tokens(text: Column) -> Column:
    """The words of a text in order, with repeats: runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def positions(nodes: DataFrame, columns: Sequence[str] = ("name", "qname", "path")) -> DataFrame:
    """id, field, term, pos: an inverted index with the places of the words in each field."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), tokens(F.col(c)).alias("words")) for c in columns])).alias("f")
    return nodes.select("id", fields).select("id", "f.field", F.posexplode("f.words").alias("pos", "term"))


def _words(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^a-z0-9]+", query.lower()) if t]


def all_words(index: DataFrame, query: str) -> DataFrame:
    """id: nodes that hold every word of the query, in any field and order."""
    wanted = sorted(set(_words(query)))
    found = index.where(F.col("term").isin(*wanted)).groupBy("id").agg(F.count_distinct("term").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("id")


def phrase(index: DataFrame, query: str) -> DataFrame:
    """id, field, pos: where the words of the query follow one another in one field.

    The postings of the k-th word are shifted back by k; where all words meet at a place, a phrase begins. A
    word that stands in the phrase twice is shifted by both of its places.
    """
    words = _words(query)
    shift = F.explode(F.array_compact(F.array(*[F.when(F.col("term") == w, k) for k, w in enumerate(words)]))).alias("k")
    starts = index.where(F.col("term").isin(*set(words))).select("id", "field", "pos", shift).select("id", "field", (F.col("pos") - F.col("k")).alias("pos"), "k")
    return starts.groupBy("id", "field", "pos").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("id", "field", "pos")


def tiered(nodes: DataFrame, query: str, limit: int, columns: Sequence[str] = ("qname", "name", "path")) -> DataFrame:
    """id, match, tier of the first nodes by tier: exact by column, the words as a phrase, then as a part of a column.

    One pass over the nodes: the first test that holds is the tier.
    """
    query = query.strip()
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" "))
    words = " " + " ".join(_words(query)) + " "
    any_ = lambda test: reduce(lambda a, b: a | b, [F.coalesce(test(c), F.lit(False)) for c in columns])
    tests = [(f"exact:{c}", F.col(c) == query) for c in columns]
    tests += [("fts", any_(lambda c: F.contains(spaced(c), F.lit(words))) & F.lit(bool(words.strip()))), ("like", any_(lambda c: F.contains(F.lower(c), F.lit(query.lower()))))]
    tier = F.coalesce(*[F.when(test, k) for k, (_, test) in enumerate(tests)])
    names = F.array(*[F.lit(m) for m, _ in tests])
    rows = nodes.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    return rows.orderBy("tier", "id").limit(limit).select("id", F.get(names, F.col("tier")).alias("match"), "tier")
