"""The registered queries of this subpackage: thin digests of the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import alignment, bpe, decontaminate, jaccard, licenses, mixing, quality, repeats, rules, secrets, textbuf, topk, toxicity, vectorcodes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    textbuf.small_batches(spark)
    return textbuf.documents(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """Where this machine keeps a public vocabulary; its package is on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.tiktoken"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), [_vocabulary("piece_bpe_32k.model"), _vocabulary("byte_bpe_multi_50k.tiktoken")])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.digests(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op3_quality_classifier, op8_byte_bpe, op1_secret_scan, op2_license_scan, op10_quality_rules, op9_toxicity, op7_bit_sliced_top_k, op5_mixing, op4_substring_dedup, op6_ngram_jaccard_join, op11_token_alignment, op12_decontamination, op13_vector_codes)}

def _codes_sql() -> str:
    """The twin of op13: a round is an assignment of all parts and the means of their entries."""
    nearest = """
        SELECT vec_id, k, min(struct_pack(d := d, e := e)) AS best, any_value(p) AS p FROM (
          SELECT x.vec_id, x.k, x.p, c.e, list_sum(list_transform(list_zip(x.p, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
          FROM parts x JOIN book{n} c ON x.k = c.k) GROUP BY vec_id, k"""
    steps = []
    for n in range(4):
        steps.append(f"near{n} AS MATERIALIZED ({nearest.format(n=n)})")
        steps.append(f"""book{n + 1} AS MATERIALIZED (
          SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN (
            SELECT k, e, list(m ORDER BY i) AS c FROM (
              SELECT k, best.e AS e, i, (sum(p[i]) - ((sum(p[i]) % count(*) + count(*)) % count(*))) // count(*) AS m
              FROM near{n}, unnest(range(1, len(p) + 1)) AS u(i) GROUP BY k, best.e, i) GROUP BY k, e) m ON m.k = b.k AND m.e = b.e)""")
    return f"""
        WITH kept AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
          SELECT vec_id, k, v[k * (len(v) // 4) + 1:(k + 1) * (len(v) // 4)] AS p FROM kept, unnest(range(4)) AS u(k)
        ), book0 AS MATERIALIZED (
          SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, p AS c
          FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
        ), {", ".join(steps)}, final AS ({nearest.format(n=4)}), coded AS (
          SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY k) AS code, sum(best.d)::BIGINT AS error FROM final GROUP BY vec_id
        ), sha AS (
          SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS h FROM book4
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id), sha
    """


#: DuckDB twins, where SQL can express the whole result.
ORACLES: dict[str, str] = {
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
          FROM documents
        ), shingles AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
        ), sizes AS (
          SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
          FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
          SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)
        ), reach(a, b) AS (
          SELECT doc_id, doc_id FROM w
          UNION
          SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), roots AS (
          SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM roots LEFT JOIN sizes USING (doc_id)
    """,
    "op4_substring_dedup": r"""
        WITH w AS (
          SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), windows AS (
          SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS t
          FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
        ), again AS (
          SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY t) AS c FROM windows) WHERE c > 1
        ), covered AS (
          SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM again
        ), placed AS (
          SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
        ), kept AS (
          SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM placed ANTI JOIN covered USING (rid, j) GROUP BY rid
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (rid)
    """,
    "op7_bit_sliced_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id
        ), ranked AS (
          SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
          FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_decontamination": r"""
        WITH d AS (
          SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM documents
        ), b AS (
          SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM benchmark
        ), items AS (
          SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS t
          FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
        ), sizes AS (
          SELECT DISTINCT n FROM items
        ), windows AS (
          SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t
          FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
        ), found AS (
          SELECT rid, w.n, i, item_id FROM windows w JOIN items USING (n, t)
        ), hit AS (
          SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM found) GROUP BY rid
        ), named AS (
          SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM found WHERE item_id IS NOT NULL) GROUP BY rid
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
    """,
    "op13_vector_codes": _codes_sql(),
}
