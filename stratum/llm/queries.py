"""The thin driver queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import html_text, near_dedup, ordinal, packing, pii, quality_rules, sharding, substring_dedup, topk, unigram


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.assess(table(spark, sf_dir, "documents"))
    grams = [F.col("dup_gram_chars")[i].alias(f"dup_chars_{n}") for i, (n, _) in enumerate(quality_rules.Rules().gram_share)]
    return found.select(*(c for c in found.columns if c != "dup_gram_chars"), *grams)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Plan(width=4))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unigram.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 good; kept are texts that are likely good."""
    docs = table(spark, sf_dir, "documents")
    grades = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") > 0, 0).otherwise(F.col("quality") + 1).alias("grade"))
    return ordinal.score(docs, ordinal.fit(docs, grades))


QUERIES = {f.__name__: f for f in (op9_quality_rules, op10_near_dedup, op1_substring_dedup, op4_packing, op7_pii, op5_sharding, op8_topk, op2_html_text, op6_sentencepiece, op3_quality_classifier)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^ \t\n\v\f\r]+')"

ORACLES: dict[str, str] = {
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op10_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w
        ),
        one AS (SELECT doc_id, unnest(g) AS g FROM sets),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_ JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least ON a = doc_id""",
    "op9_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        base AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM d
        ),
        lines AS (
            SELECT doc_id, line, count(*) AS n, CAST(list_sum(list_transform({_WORDS.format("line")}, lambda x: length(x))) AS BIGINT) AS chars
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE len({_WORDS.format("line")}) > 0 GROUP BY doc_id, line
        ),
        dup AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum((n - 1) * chars) AS BIGINT) AS dup_line_chars, sum(n) AS n_lines FROM lines GROUP BY doc_id),
        grams AS (
            SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT unnest([3, 5, 7, 10]) AS k))
        ),
        often AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, g) AS n FROM grams) WHERE n > 1),
        inside AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM often),
        cover AS (
            SELECT doc_id, count(*) FILTER (k = 3) AS w3, sum(length(w[i])) FILTER (k = 5) AS c5, sum(length(w[i])) FILTER (k = 7) AS c7, sum(length(w[i])) FILTER (k = 10) AS c10
            FROM inside JOIN d USING (doc_id) GROUP BY doc_id
        ),
        a AS (
            SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(w3, 0) AS BIGINT) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
                CAST(coalesce(c5, 0) AS BIGINT) AS dup_chars_5, CAST(coalesce(c7, 0) AS BIGINT) AS dup_chars_7, CAST(coalesce(c10, 0) AS BIGINT) AS dup_chars_10, coalesce(n_lines, 0) AS n_lines
            FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)
        ),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(word_chars, 1) AS letters FROM a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, dup_chars_5, dup_chars_7, dup_chars_10, base_failed,
            NOT (base_failed OR 10 * n_symbols > n_words OR 10 * dup_line_chars > 2 * letters OR 2 * n_dup_lines > greatest(n_lines, 1)
                OR 100 * dup_chars_5 > 30 * letters OR 100 * dup_chars_7 > 28 * letters OR 100 * dup_chars_10 > 26 * letters) AS kept
        FROM f""",
}
