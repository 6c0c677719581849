"""What SQL can say about the operators: the whole result of the Jaccard join, and the base columns of others.

base_* queries run an operator over its whole table and keep the columns that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules, secret_scans, sharding

BLANK = r"[ \t\n\x0B\f\r]+"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '')"


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_assign", "n_access", "n_hex")


def base_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all rows, whether the slots of all shards have no gaps, and whether no shard is over 5 % off the mean and a row's size."""
    rows = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shards = rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"), F.sum("size").alias("bytes"), F.max("size").alias("most"))
    facts = shards.agg(
        F.count("*").cast("long").alias("n_shards"), F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"),
        (F.max("bytes") - F.avg("bytes") <= 0.05 * F.avg("bytes") + F.max("most")).alias("even"),
    )
    return rows.select("doc_id", "size", "law").join(F.broadcast(facts))  # one row


QUERIES = {f.__name__: f for f in (base_quality_rules, base_secret_scans, base_histogram_sort)}

SQL = {
    "base_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, row_number() OVER () AS i FROM documents),
        win AS (SELECT i, p, array_to_string(w[p : p + 7], ' ') AS x FROM (SELECT i, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
        twice AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, x) AS n FROM win) WHERE n > 1),
        again AS (SELECT i, count(DISTINCT q) AS n FROM (SELECT i, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY i),
        lines AS (SELECT i, count(*) - count(DISTINCT line) AS n FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY i)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(w) AS base_failed
        FROM d LEFT JOIN again USING (i) LEFT JOIN lines USING (i)""",
    "base_secret_scans": r"""
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
          CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
        FROM documents""",
    "base_histogram_sort": """
        SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'bytes' AS law, CAST(16 AS BIGINT) AS n_shards, true AS gapless, true AS even FROM documents""",
    "op10_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        c AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id) AS least, count(*) AS copies, row_number() OVER (ORDER BY array_to_string(w, ' ')) AS c FROM d WHERE len(w) > 0 GROUP BY array_to_string(w, ' ')),
        s AS (SELECT c, unnest(CASE WHEN len(w) < 5 THEN [k] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' '))) END) AS s FROM c),
        n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
        p AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.c <> b.c GROUP BY a.c, b.c),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.c = p.a JOIN n y ON y.c = p.b WHERE p.n >= 0.8 * (x.n + y.n - p.n) - 1e-9),
        r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        m AS (SELECT r.a, min(c.least) AS class_id FROM r JOIN c ON c.c = r.b GROUP BY r.a),
        k AS (SELECT l.a, sum(c.copies) AS links, count(*) AS classes FROM l JOIN c ON c.c = l.b GROUP BY l.a)
        SELECT d.doc_id, CASE WHEN len(d.w) = 0 THEN d.doc_id ELSE m.class_id END AS class_id, CASE WHEN len(d.w) = 0 THEN d.doc_id ELSE c.least END AS text_class_id, CAST(coalesce(c.copies, 1) AS BIGINT) AS n_copies,
          CAST(coalesce(k.links, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(k.classes, 0) AS BIGINT) AS n_linked_classes
        FROM d LEFT JOIN c ON len(d.w) > 0 AND c.k = array_to_string(d.w, ' ') LEFT JOIN m ON m.a = c.c LEFT JOIN k ON k.a = c.c""",
}
