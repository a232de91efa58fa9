"""Tables that the catalogue's queries start from, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions import tokens as tk
from strandloom.operators import examples, vocab

SEED = 42
#: Draws lie under it; as SQL.
TOP = "1152921504606846976e0"
K, STRIDE = 8, 2
# Weights of the offsets -5 to 5, falling with the distance.
KERNEL = [1, 2, 3, 4, 5, 5, 4, 3, 2, 1]
MIN_FREQUENCY = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    """(doc_id, line_no, line)."""
    text = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text).alias("line_no", "line"))


def word_tokens(spark, sf_dir) -> DataFrame:
    """(doc_id, line_no, token)."""
    return lines(spark, sf_dir).select("doc_id", "line_no", F.explode(tk.words(F.col("line"))).alias("token"))


def bags(spark, sf_dir) -> DataFrame:
    """(doc_id, token, n): how often a document has a word.

    Texts are dealt by doc_id before they are cut into words, so that texts are shuffled and not a row for each of their words; rows of one id meet all the same.
    """
    return dealt_words(spark, sf_dir).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def dealt_words(spark, sf_dir) -> DataFrame:
    """(doc_id, token) of texts dealt by doc_id: the words of a text follow each other."""
    dealt = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return dealt.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("doc_id", F.explode(tk.words(F.col("line"))).alias("token"))


def word_counts(spark, sf_dir) -> DataFrame:
    return vocab.count_tokens(word_tokens(spark, sf_dir))


def dna(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tk.pseudo_dna(F.col("text")).alias("seq"))


def kmers(spark, sf_dir, k: int = K, stride: int = STRIDE) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", "lang", F.explode(tk.kmers(F.col("seq"), k, stride)).alias("kmer"))


def kmer_counts(spark, sf_dir) -> DataFrame:
    return vocab.count_tokens(kmers(spark, sf_dir), "kmer")


def event_tokens(spark, sf_dir) -> DataFrame:
    """(sent, pos, length, token): events of a user in order of time."""
    return examples.positions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def event_vocab(spark, sf_dir) -> DataFrame:
    return vocab.build(vocab.count_tokens(table(spark, sf_dir, "events"), "event_type"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


SQL_LINES = "l AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"
SQL_WORDS = SQL_LINES + r", t AS (SELECT doc_id, line_no, unnest(list_filter(regexp_split_to_array(line, '[ \t\r\n\f]+'), lambda x: x <> '')) AS token FROM l)"
SQL_WORD_COUNTS = SQL_WORDS + ", c AS (SELECT token, count(*) AS count FROM t GROUP BY token)"
SQL_DNA = "d AS (SELECT doc_id, lang, source, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"


def sql_kmers(k: int = K, stride: int = STRIDE) -> str:
    return SQL_DNA + f", k AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(seq) - {k} + 2, {stride}), lambda i: substr(seq, i, {k}))) AS kmer FROM d)"


def sql_rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


SQL_KMER_COUNTS = sql_kmers() + f", c AS (SELECT kmer AS token, count(*) AS count FROM k GROUP BY kmer), cc AS (SELECT token, least(token, {sql_rc('token')}) AS canon, count FROM c)"
SQL_EVENTS = "e AS (SELECT user_id AS sent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS length, event_type AS token FROM events)"
SQL_EVENT_VOCAB = "v AS (SELECT token, CAST(dense_rank() OVER (ORDER BY token) AS INT) AS id, count FROM (SELECT event_type AS token, count(*) AS count FROM events GROUP BY event_type))"
SQL_VECTORS = "x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def sql_draw(tag: str, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{tag}', '{SEED}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 15) AS BIGINT)"
