"""The registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import conversations, decontam, fingerprints, language_id, mixing, packing, paragraph_dedup, pii, quality, search, secrets, similarity_join, token_files
from tessera.llm.common import fold, table


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold(F.col("doc_id"), 4) != 2)
    got = language_id.predict(docs, model)
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    got = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return got.select("doc_id", *counts, F.sha2(pii.written("base").cast("binary"), 256).alias("base_sha256"), pii.written("found").alias("spans"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_join.join(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    got = secrets.find(table(spark, sf_dir, "documents"))
    counts = [secrets.count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return got.select("doc_id", *counts, F.sha2(secrets.written("base").cast("binary"), 256).alias("base_sha256"), secrets.written("found").alias("spans"))


def op10_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeats(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.damaged(table(spark, sf_dir, "conversations")), dropped="dropped")


def pipeline(spark, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_token_files, op2_language_id, op3_quality, op4_mixing, op5_pii, op6_jaccard_join, op7_fingerprints, op8_decontamination, op9_secrets, op10_paragraph_dedup, op11_best_fit_packing, op12_ranked_search, op13_conversation_repair, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _terms(column: str) -> str:
    lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLES: dict[str, str] = {
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS w FROM documents),
        s AS (SELECT count(*) AS docs, sum(len(w)) AS words FROM d WHERE len(w) > 0),
        i AS (SELECT DISTINCT item_id, text FROM benchmark),
        q AS (SELECT item_id, text, t, count(*) AS c FROM (SELECT item_id, text, unnest({_terms("text")}) AS t FROM i) GROUP BY ALL),
        p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
        x AS (SELECT item_id, text, r, doc_id, sum(c * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS score
              FROM q JOIN p USING (t) JOIN f USING (t) CROSS JOIN s GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM x WHERE score > 0)
        WHERE rank <= 20""",
}
