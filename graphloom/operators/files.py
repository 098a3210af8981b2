"""Files and lines: scans, manifests, extractors, and canonical output."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.classify import diagnostic, language

#: Files above this size are not read.
MOST_BYTES = 4 * 1024 * 1024


def scan(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, language, text of the files of known languages; hidden ones and large ones are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    seen = rows.where((F.col("length") <= most_bytes) & ~F.col("path").rlike(r"/\.[^/]+"))
    return seen.select("path", language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text")).where("language <> ''")


def manifest(files: DataFrame, key: str, content: Column) -> DataFrame:
    """key, digest, size of each file."""
    return files.select(key, F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("size"))


def manifest_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, state: ADDED, REMOVED, CHANGED or SAME, by digest."""
    a, b = before.select(key, F.col("digest").alias("a")), after.select(key, F.col("digest").alias("b"))
    state = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") == F.col("b"), "SAME").otherwise("CHANGED")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content of every line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content")).select(key, (F.col("line") + 1).cast("long").alias("line"), "content")


def registry_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, name, handler of lines that hold {"name", handler."""
    # Fixed value: a whole entry, up to its comma or brace.
    pattern = r'^[ \t]*\{"([^"]+)",\s*([A-Za-z_][A-Za-z0-9_]*)\s*[,}]'
    return lines(rows, key, text).where(F.regexp_like("content", F.lit(pattern))).select(key, "line", F.regexp_extract("content", pattern, 1).alias("name"), F.regexp_extract("content", pattern, 2).alias("handler"))


def guards(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, kind (if, switch, case), expression; the first kind that matches a line."""
    # How guards begin a line, in any case.
    kinds = {"if": r"(?i)^\s*if\s*\((.*)\)\s*\{?", "switch": r"(?i)^\s*switch\s*\((.*)\)\s*\{?", "case": r"(?i)^\s*case\s+([^:]+):"}
    kind, expression = None, []
    for name, pattern in kinds.items():
        hit = F.regexp_like("content", F.lit(pattern))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        expression.append(F.when(hit, F.regexp_extract("content", pattern, 1)))
    return lines(rows, key, text).select(key, "line", kind.alias("kind"), F.coalesce(*expression).alias("expression")).where("kind IS NOT NULL")


def diagnostics(rows: DataFrame, key: str, text: str, back: int = 8) -> DataFrame:
    """key, line, file, severity, message, category of compiler messages.

    A message without a place of its own takes that of the nearest of the `back` lines before it.
    """
    from pyspark.sql import Window

    # How messages with and without a place are written, in any case.
    placed, plain = r"(?i)^(.+?):(\d+)(?::\d+)?:\s*(fatal error|error|warning|note):\s*(.*)$", r"(?i)^(?:fatal )?error:\s*(.*)$"
    own = F.regexp_extract("content", placed, 1)
    rows = lines(rows, key, text).withColumn("own", F.when(own != "", own))
    near = Window.partitionBy(key).orderBy("line").rowsBetween(-back, 0)
    rows = rows.withColumn("file", F.last("own", ignorenulls=True).over(near))
    message = F.when(F.col("own").isNotNull(), F.regexp_extract("content", placed, 4)).when(F.regexp_like("content", F.lit(plain)), F.regexp_extract("content", plain, 1))
    severity = F.when(F.col("own").isNotNull(), F.lower(F.regexp_extract("content", placed, 3))).otherwise("error")
    rows = rows.select(key, "line", "file", severity.alias("severity"), message.alias("message")).where("message IS NOT NULL")
    return rows.withColumn("category", diagnostic(F.col("message")))


def logs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The diagnostics of each log, and for a log without any one row of the category UNCLASSIFIED at line 0."""
    found = diagnostics(rows, key, text)
    none = rows.join(found.select(key).distinct(), key, "left_anti")
    empty = F.lit(None).cast("string")
    none = none.select(key, F.lit(0).cast("long").alias("line"), empty.alias("file"), F.lit("error").alias("severity"), empty.alias("message"), F.lit("UNCLASSIFIED").alias("category"))
    return found.select(*none.columns).unionByName(none)


def links(pages: DataFrame) -> DataFrame:
    """page_id, target: the href of every anchor, as includes of a page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("target"))


def extract(files: DataFrame, extractor: Callable[[str, str], Iterable[tuple]], schema: str, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of a user's extractor (path, text) -> tuples, run on Arrow batches of files."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch[path], batch[text], strict=True) for r in extractor(p, t)]
            yield pd.DataFrame(rows, columns=names)

    return files.select(path, text).mapInPandas(run, schema)


def probe_records(files: DataFrame) -> DataFrame:
    """path, seq, kind, object, value of binary probe files (path, content).

    Fixed format: an 18-byte header, then records of a 17-byte head (kind u8, object u64, size
    u64, little-endian) and that many bytes, read as doubles. A cut-off record ends a file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, raw in zip(batch["path"], batch["content"], strict=True):
                at, seq = 18, 0
                while at + 17 <= len(raw):
                    kind, obj, size = struct.unpack_from("<BQQ", raw, at)
                    at += 17
                    if at + size > len(raw):
                        break
                    for (value,) in struct.iter_unpack("<d", raw[at : at + size // 8 * 8]):
                        rows.append((p, seq, kind, obj, value))
                    at, seq = at + size, seq + 1
            yield pd.DataFrame(rows, columns=["path", "seq", "kind", "object", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, seq long, kind int, object long, value double")


def trace_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, step (+1 enter, -1 exit), offset, callsite of lines `E|X offset callsite`."""
    part = F.split("content", " ")
    hit = lines(rows, key, text).where(F.regexp_like("content", F.lit(r"^[EX] \S+ \S+$")))
    return hit.select(key, "line", F.when(part[0] == "E", 1).otherwise(-1).alias("step"), part[1].alias("offset"), part[2].alias("callsite"))


def canonical(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, json: the fields in alphabetical order, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*sorted(fields))).alias("json"))


def append(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Adds rows to a table of files."""
    rows.write.mode("append").format(kind).save(path)


def publish(rows: DataFrame, root: str, snapshot_id: str) -> None:
    """Writes a snapshot's partition first and its line in `snapshots` last: that line publishes it."""
    rows.write.mode("overwrite").parquet(f"{root}/data/snapshot_id={snapshot_id}")
    rows.sparkSession.range(1).select(F.lit(snapshot_id).alias("snapshot_id")).write.mode("append").parquet(f"{root}/snapshots")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all published snapshots."""
    done = spark.read.parquet(f"{root}/snapshots").distinct()
    return spark.read.parquet(f"{root}/data").join(done, "snapshot_id", "left_semi")
