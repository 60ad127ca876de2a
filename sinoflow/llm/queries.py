"""The registered queries of the operators, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, licenses, mixing, quality, repeats, sharding, simhash, spelling, token_output, toxicity, url_filter
from .training import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def hex16(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def predicted(scores: DataFrame, held: Column) -> DataFrame:
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(toxicity.toxicity(docs, table(spark, sf_dir, "labels"), fold(5) != 0), fold(5) == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("licenses", F.concat_ws(",", "licenses"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(quality.quality(docs, table(spark, sf_dir, "labels"), fold(3) != 1), fold(3) == 1)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept").withColumn("has_repeats", F.col("n_removed") > 0)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(rows), rows)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_urls": op7_urls,
    "op8_tokens": op8_tokens,
    "op9_mix": op9_mix,
    "op10_repeats": op10_repeats,
    "op11_shards": op11_shards,
    "op12_spelling": op12_spelling,
    "op13_conversations": op13_conversations,
}

def _license_sql() -> str:
    """The licence scan without its pruning: every unit against every template."""
    words = "regexp_extract_all(replace(lower({}), 'licence', 'license'), '[a-z0-9]+')".format
    pairs = "list_distinct(list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1]))".format
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)
    lines, ends = r"'[\r\n]+'", r"regexp_replace(t, '([.;:!?])[ \t\n\x0B\f\r]+', E'\\1\n', 'g')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
        u AS (SELECT k, unnest(list_distinct(list_concat(list_concat(regexp_split_to_array(t, {lines}), regexp_split_to_array({ends}, {lines})),
                     list_concat(regexp_split_to_array(t, '(?:\\r?\\n[ \\t]*){{2,}}'), [t])))) AS u FROM d),
        w AS (SELECT DISTINCT k, {words("u")} AS w FROM u),
        a AS (SELECT k, {pairs("w")} AS a FROM w WHERE len(w) > 1),
        tw AS (SELECT name, {words("t")} AS w FROM (VALUES {rows}) AS x(name, t)),
        b AS (SELECT name, {pairs("w")} AS b FROM tw),
        m AS (SELECT k, a, max({{'score': 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 'name': name}}) AS best FROM a CROSS JOIN b
              WHERE len(a) BETWEEN len(b) * {licenses.DICE / (2 - licenses.DICE)} - 1e-9 AND len(b) * {(2 - licenses.DICE) / licenses.DICE} + 1e-9 GROUP BY k, a),
        f AS (SELECT k, max(best) AS best, array_to_string(list_sort(list_distinct(list(best.name))), ',') AS names FROM m WHERE best.score >= {licenses.DICE} GROUP BY k)
        SELECT d.doc_id, f.best.name AS license, coalesce(CAST(f.best.score AS DOUBLE), 0.0) AS score, coalesce(f.names, '') AS licenses FROM d LEFT JOIN f ON d.k = f.k
    """


ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op2_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        occ AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
    """,
    "op5_licenses": _license_sql(),
}
