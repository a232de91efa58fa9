"""The operators bound to their tables: one query each, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, conversation_trie, decontam, exact, html_text, jaccard_join, langid, license_join, packing, quality, secret_scan, shared, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_join.license_scan(_table(spark, sf_dir, "documents")).drop("blocks")


def op3_benchmark_decontamination(spark, sf_dir):
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _scored(docs: DataFrame, score, modulus: int, held: int) -> DataFrame:
    fold = F.coalesce(shared.remainder("doc_id", modulus) == held, F.lit(False))
    scored = docs.select("doc_id", fold.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, _table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score_column(spark, model), toxicity.MODULUS, toxicity.HELD)


def op5_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(spark, docs, _table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score_column(spark, model), quality.MODULUS, quality.HELD)


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents")).withColumn("start", F.col("start").cast("long"))


def op7_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.secret_scan(_table(spark, sf_dir, "documents")))


def op8_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict_column(spark, langid.train(spark, docs))
    fold = F.coalesce(shared.remainder("doc_id", langid.MODULUS) == langid.HELD, F.lit(False))
    return docs.select("doc_id", fold.alias("held_out"), found.alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op9_html_extraction(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_exact_dedup(spark, sf_dir):
    return exact.exact_groups(_table(spark, sf_dir, "documents"), digests=True)


def op11_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations")).drop("place", "last")


def op13_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_license_scan, op3_benchmark_decontamination, op4_toxicity, op5_quality, op6_best_fit_packing, op7_secret_scan, op8_language_id, op9_html_extraction, op10_exact_dedup, op11_collocations, op12_conversation_trie, op13_jaccard_join)}

#: The others have models, sketches, tokenizers or parsers that SQL can't express, or are too slow there; their tests use brute force.
ORACLES = {"op10_exact_dedup": exact.ORACLE, "op11_collocations": collocations.ORACLE, "op12_conversation_trie": conversation_trie.ORACLE}
