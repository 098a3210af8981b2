"""Ordered classifiers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions by language.
LANGUAGES = {
    "fortran": ("f", "for", "f77", "f90", "f95", "f03", "f08"),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
    "python": ("py",),
    "go": ("go",),
    "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cts", "mts"),
    "java": ("java",),
}
# Parts of a called name by resource, first match wins; the last pair are prefixes.
RESOURCES = {
    "FileSystem": ("printf", "fopen", "open("),
    "Database": ("insert", "select", "sql", "db_"),
    "Network": ("socket", "send", "recv", "http"),
    "GPU": ("gpu", "cuda"),
}
FILE_PREFIXES = ("fwrite", "fread")
# Phrases of diagnostics by category, first match wins.
DIAGNOSTICS = {
    "MISSING_INCLUDE_OR_MODULE": ("no such file or directory", "file not found", "cannot open module file"),
    "UNDEFINED_SYMBOL": ("undefined reference", "undefined symbols", "symbol(s) not found"),
    "DUPLICATE_SYMBOL": ("duplicate symbol", "multiple definition"),
    "TYPE_OR_INTERFACE_MISMATCH": ("incompatible type", "conflicting types", "type mismatch", "argument mismatch", "rank mismatch"),
    "SYNTAX_ERROR": ("expected", "syntax error", "unexpected"),
}


def any_of(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def first_match(cases: Sequence[tuple[str, Column]], default) -> Column:
    """The label of the first case that holds."""
    out = None
    for label, holds in cases:
        out = F.when(holds, label) if out is None else out.when(holds, label)
    return out.otherwise(default)


def language(path: Column) -> Column:
    """Language from the extension, empty if unknown."""
    ext = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")
    return first_match([(k, ext.isin(*v)) for k, v in LANGUAGES.items()], "")


def resource(callee: Column) -> Column:
    """Resource class of a called name, null if none."""
    low = F.lower(F.coalesce(callee, F.lit("")))
    cases = [(k, any_of(low, v)) for k, v in RESOURCES.items()]
    prefix = F.lit(False)
    for p in FILE_PREFIXES:
        prefix = prefix | low.startswith(p)
    cases[0] = ("FileSystem", cases[0][1] | prefix)
    return first_match(cases, F.lit(None).cast("string"))


def diagnostic(message: Column) -> Column:
    low = F.lower(message)
    cases = [(k, any_of(low, v)) for k, v in DIAGNOSTICS.items()]
    module = F.contains(low, F.lit("module file")) & F.contains(low, F.lit("not found"))
    cases[0] = (cases[0][0], cases[0][1] | module)
    return first_match(cases, "COMPILE_OR_LINK_ERROR")


def family(name: Column, prefixes: Sequence[str]) -> Column:
    """The first of the ordered prefixes that a name has, null if none."""
    return first_match([(p, name.startswith(p)) for p in prefixes], F.lit(None).cast("string"))


def join_key(name: Column) -> Column:
    """Names compare without outer underscores and in upper case."""
    return F.upper(F.regexp_replace(name, "^_+|_+$", ""))


def layer(truth: Column, resolution: Column) -> Column:
    """T0 for exact observed or resolved facts, else T1."""
    return F.when(truth.isin("OBSERVED", "RESOLVED") & (resolution == "EXACT"), "T0").otherwise("T1")


def guarded(truth: Column, witnesses: Column) -> Column:
    """RESOLVED needs both ends witnessed, otherwise it is INFERRED; weaker classes never rise."""
    both = F.array_contains(witnesses, "producer_return") & F.array_contains(witnesses, "consumer_parameter")
    return F.when((truth == "RESOLVED") & ~both, "INFERRED").otherwise(truth)


def freshness(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """UNKNOWN if any key is missing, CURRENT if all are equal, else STALE."""
    missing, equal = F.lit(False), F.lit(True)
    for a, b in pairs:
        missing, equal = missing | a.isNull() | b.isNull(), equal & (a == b)
    return F.when(missing, "UNKNOWN").when(equal, "CURRENT").otherwise("STALE")
