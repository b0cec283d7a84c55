"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, bpe, decontam, langid, mtree, packing, phrases, secrets, simhash, suffixdedup, toxicity, warc, whitening

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id doesn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, F.pmod("vec_id", F.lit(20)) == 0)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, VOCABULARY).select("doc_id", "bpe.*")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scanned(docs).select("doc_id", "secrets.*")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 3, 1)
    model = toxicity.fitted(docs.where(~out), table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model, spans=True)
    spans = F.array_join(F.transform("toxicity.spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"), spans.alias("spans"))


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.read(binpack.write(table(spark, sf_dir, "documents"), VOCABULARY))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicated(table(spark, sf_dir, "documents")).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    found = langid.identified(docs.select("doc_id", "text"), langid.fitted(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_bpe_round_trip, op3_secret_scan, op4_simhash_components, op5_toxicity, op6_packed_ids, op7_decontamination, op8_suffix_dedup, op9_language_id, op10_warc_revisits, op11_embedding_whitening, op12_phrases, op13_packing)}

ORACLE_SQL = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda k: q.e[k] * c.e[k])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_warc_revisits": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS m
            FROM pages)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND m <> page_id THEN m END AS refers_to
        FROM p""",
    "op12_phrases": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d),
        w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
            FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
        cut AS (SELECT lang, k, phrase, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y FROM c, (VALUES (1), (2)) AS t(j) WHERE j < k),
        s AS (
            SELECT cut.lang, cut.k, cut.phrase, cut.a, j, l.a AS l, r.a AS r, (CAST(1000000 AS HUGEINT) * cut.a * cut.a) // (CAST(l.a AS HUGEINT) * r.a) AS score
            FROM cut JOIN f l ON l.lang = cut.lang AND l.k = j AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.k = cut.k - j AND r.phrase = y),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
        inner_ AS (
            SELECT lang, phrase, max(f) AS f FROM (
                SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a AS f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM c WHERE k = 3) GROUP BY 1, 2),
        o AS (SELECT b.* FROM b LEFT JOIN inner_ i ON b.k = 2 AND i.lang = b.lang AND i.phrase = b.phrase WHERE NOT coalesce(100 * i.f >= 50 * b.a, false)),
        q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT q.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000""",
}
