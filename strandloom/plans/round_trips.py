"""Sources and sinks: a table is written to the shared folder in a format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import tokens as tk
from strandloom.operators import examples, tables, vocab
from strandloom.sources import archives, corpus, scratch, store
from strandloom.streaming import counter

from . import inputs as i
from .registry import query


def _sequences(s, d):
    return i.dna(s, d).where("doc_id is not null and length(seq) > 0")


@query(f"WITH {i.SQL_DNA} SELECT CAST(doc_id AS VARCHAR) AS id, len(seq) AS n, md5(seq) AS digest FROM d WHERE len(seq) > 0")
def fasta_round_trip(s, d):
    path = scratch.new_path(s, "fasta")
    _sequences(s, d).select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), F.lower("seq"))).write.text(path)
    return corpus.read_fasta(s, path).where("ok").select("id", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"WITH {i.SQL_DNA} SELECT '@HISEQ:' || doc_id AS id, md5(seq) AS digest, len(seq) AS n_quality FROM d WHERE len(seq) > 0")
def fastq_round_trip(s, d):
    path = scratch.new_path(s, "fastq")
    quality = F.translate("seq", "ACGT", "IIII")
    _sequences(s, d).select(F.concat_ws("\n", F.concat(F.lit("@HISEQ:"), F.col("doc_id").cast("string")), "seq", F.lit("+"), quality)).write.option("compression", "gzip").text(path)
    return corpus.read_fastq(s, path).where("ok").select("id", F.md5(F.col("seq").cast("binary")).alias("digest"), F.length("quality").cast("long").alias("n_quality"))


@query(f"WITH {i.sql_kmers()} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def fasta_corpus_kmers(s, d):
    """The corpus reader by its parser's name, with k-mers of every record."""
    path = scratch.new_path(s, "fasta")
    _sequences(s, d).select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), "seq")).write.text(path)
    return corpus.read_corpus(s, path, "fasta", i.K, i.STRIDE).select(F.explode("tokens").alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {i.SQL_WORD_COUNTS} SELECT token, count FROM c")
def gzip_text_round_trip(s, d):
    path = scratch.new_path(s, "text")
    i.lines(s, d).select("line").write.option("compression", "gzip").text(path)
    return vocab.count_tokens(corpus.read_corpus(s, path).select(F.explode("tokens").alias("token")))


@query("SELECT coalesce(source, 'none') AS source, count(*) AS n FROM documents WHERE NOT regexp_matches(coalesce(source, 'none'), 'src1') GROUP BY 1")
def skip_directories(s, d):
    """Files below folders, by suffix, without the folders that a pattern names."""
    path = scratch.new_path(s, "folders")
    docs = i.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("value"), F.coalesce("source", F.lit("none")).alias("source"))
    docs.write.partitionBy("source").text(path)
    read = corpus.read_lines(s, path, skip=["/source=[^/]*src1"], suffix=".txt", recursive=True)
    return read.groupBy(F.regexp_extract("file", "/source=([^/]+)/", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {i.SQL_WORD_COUNTS} SELECT token, CAST(row_number() OVER (ORDER BY token) AS INT) AS id, count FROM c WHERE token <> 'UNK' UNION ALL SELECT 'UNK', 0, 0")
def vocab_text_round_trip(s, d):
    path = scratch.new_path(s, "vocabulary")
    store.export_text(vocab.with_unk(vocab.build(i.word_counts(s, d))), path)
    return store.import_text(s, path)


@query(f"WITH {i.SQL_KMER_COUNTS} SELECT token, canon, CAST(dense_rank() OVER (ORDER BY canon) AS INT) AS id, count FROM cc")
def vocab_round_trip(s, d):
    path = scratch.new_path(s, "vocabulary")
    store.save_vocabulary(vocab.build(i.kmer_counts(s, d), reverse_complement=True), path)
    return store.load_vocabulary(s, path)


@query(f"WITH {i.SQL_WORD_COUNTS}, p AS (SELECT CASE WHEN count >= {i.MIN_FREQUENCY} AND token <> 'UNK' THEN token END AS token, count FROM c WHERE token <> 'UNK') SELECT token, CAST(dense_rank() OVER (ORDER BY token) AS INT) AS id, count FROM p WHERE token IS NOT NULL UNION ALL SELECT 'UNK', 0, CAST(coalesce(sum(count), 0) AS BIGINT) FROM p WHERE token IS NULL")
def prepared_vocab(s, d):
    """Counted, saved unpruned, loaded, pruned and given ids; what is rare is the count of UNK."""
    path = scratch.new_path(s, "prepared")
    return store.prepare(i.word_tokens(s, d), path, i.MIN_FREQUENCY).select("token", "id", "count")


@query("WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS id, count(*) AS count FROM lineitem GROUP BY 1) SELECT r.id, coalesce(c.count, 0) AS count FROM (SELECT unnest(range((SELECT max(id) + 1 FROM c))) AS id) r LEFT JOIN c ON r.id = c.id")
def dense_counter_round_trip(s, d):
    path = scratch.new_path(s, "dense")
    store.export_dense(vocab.dense_counts(i.table(s, d, "lineitem"), "l_quantity"), path)
    return store.load_dense(s, path)


@query(f"WITH {i.SQL_VECTORS} SELECT id, CAST(len(v) AS INT) AS dims, round(v[1], 6) AS first FROM x")
def vector_checkpoint_round_trip(s, d):
    path = scratch.new_path(s, "embeddings")
    rows = i.vectors(s, d).select("id", F.col("v").cast("array<double>").alias("w"))
    for epoch in (0, 1):
        store.save_embeddings(rows, path, epoch)
    return store.load_embeddings(s, path, 1).select("id", F.size("w").alias("dims"), F.round(F.col("w")[0], 6).alias("first"))


@query("WITH nb AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS rn, CAST(user_id AS INT) AS query, CAST(event_id % 7 AS INT) AS context FROM events) SELECT CAST(rn % 1000 AS INT) AS row_in_batch, query, context FROM nb WHERE rn // 1000 = 1")
def macrobatch_files(s, d):
    """One macrobatch of those on disk: only its own folder is read."""
    path = scratch.new_path(s, "macrobatches")
    rows = i.table(s, d, "events").select("event_id", F.col("user_id").cast("int").alias("query"), (F.col("event_id") % 7).cast("int").alias("context"))
    store.save_macrobatches(examples.macrobatches(rows, 1000, ["event_id"]), path)
    return store.load_macrobatch(s, path, 1).select("row_in_batch", "query", "context").where("query <> 0 or context <> 0 or row_in_batch >= 0")


_CHROM = "'chr' || CAST({k} % 23 AS VARCHAR)"


@query(f"SELECT {_CHROM.format(k='l_orderkey')} AS chrom, l_orderkey AS \"start\", l_orderkey + 100 * l_linenumber AS \"end\", 100 * l_linenumber AS width, l_quantity / (100 * l_linenumber) AS height_per_width, o_custkey AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 7 + 1")
def peak_atlas_join(s, d):
    """Peaks from a headerless TSV and an atlas from a CSV with header, joined on (chrom, start, end)."""
    chrom = lambda k: F.concat(F.lit("chr"), (F.col(k) % 23).cast("string")).alias("chrom")
    peaks, atlas = scratch.new_path(s, "peaks"), scratch.new_path(s, "atlas")
    i.table(s, d, "lineitem").select(chrom("l_orderkey"), F.col("l_orderkey"), F.col("l_orderkey") + 100 * F.col("l_linenumber"), F.col("l_quantity")).write.csv(peaks, sep="\t")
    i.table(s, d, "orders").select(chrom("o_orderkey").alias("seqnames"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 100 * (F.col("o_orderkey") % 7 + 1)).alias("end"), F.col("o_custkey").alias("gene")).write.csv(atlas, header=True)
    left = tables.read_intervals(s, peaks, "chrom string, start long, end long, height double", sep="\t")
    right = tables.read_intervals(s, atlas, "seqnames string, start long, end long, gene long", header=True)
    return tables.with_width(tables.same_interval(left, right.withColumnRenamed("seqnames", "chrom"))).select("chrom", "start", "end", "width", "height_per_width", "gene")


SQL_LOG = "WITH a AS (SELECT user_id % 20 AS run, event_id, CAST(event_id % 50 AS INT) AS macrobatch, CAST(concat(user_id % 9, '.', lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')) AS DOUBLE) AS loss FROM events), j AS (SELECT *, CASE WHEN abs(macrobatch - lag(macrobatch, 1, 0) OVER (PARTITION BY run ORDER BY event_id)) > 1 THEN 1 ELSE 0 END AS j FROM a), p AS (SELECT *, CAST(sum(j) OVER (PARTITION BY run ORDER BY event_id) AS INT) AS epoch FROM j)"


@query(f"{SQL_LOG} SELECT run, epoch, count(*) AS n, round(avg(loss), 6) AS loss FROM p GROUP BY run, epoch")
def log_files_epoch_loss(s, d):
    """Mean loss of each epoch from log files of several runs; lines carry their number in the log."""
    path = scratch.new_path(s, "logs")
    line = F.format_string("%d running macrobatch %d, macrobatch average loss: %d.%03d", "event_id", F.col("event_id") % 50, F.col("user_id") % 9, F.col("event_id") % 1000)
    i.table(s, d, "events").select((F.col("user_id") % 20).alias("run"), line.alias("value")).write.partitionBy("run").text(path)
    logged = tables.read_log(s, path).select(F.regexp_extract("file", "/run=([0-9]+)/", 1).cast("long").alias("run"), F.regexp_extract("line", "^([0-9]+) ", 1).cast("long").alias("line_no"), "macrobatch", "loss")
    return tables.epochs(logged, "run", "line_no", "macrobatch").groupBy("run", "epoch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


@query("SELECT r_name AS name, true AS writable FROM region")
def write_probe(s, d):
    """Whether a run may write into the folder of each region, asked before the run."""
    base = scratch.new_path(s, "probe")
    names = [r.r_name for r in i.table(s, d, "region").select("r_name").collect()]  # one folder each
    return s.createDataFrame([(n, scratch.can_write(s, f"{base}/{k}")) for k, n in enumerate(names)], "name string, writable boolean")


@query(f"WITH {i.SQL_WORD_COUNTS} SELECT token, count FROM c")
def zip_corpus_words(s, d):
    """Words of a corpus of zip archives, a member for each document."""
    path = scratch.new_path(s, "archives").removeprefix("file:")
    archives.write_zip(i.lines(s, d).select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")).alias("member"), "line"), path, value="line")
    return vocab.count_tokens(archives.read_zip(s, path, ".txt").select(F.explode(tk.words(F.col("value"))).alias("token")))


@query(f"WITH {i.SQL_WORD_COUNTS} SELECT token, count FROM c")
def streamed_counts(s, d):
    """Counts of a growing folder: two runs of one query, the second only over what is new."""
    path, at = scratch.new_path(s, "stream"), scratch.new_path(s, "stream-state")
    kept = counter.CountStore(s, f"{at}/counts", merge_after=3)
    for half in (0, 1):
        i.lines(s, d).where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)) == half).select("line").write.mode("append").text(path)
        counter.start_counter(s, path, kept, f"{at}/checkpoint", 4).awaitTermination()
    return kept.counts()


@query("SELECT 'S' || l_linestatus AS label, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def labelled_files(s, d):
    """Positive files of a folder of FASTA files, their label from the file's name."""
    path = scratch.new_path(s, "labelled")
    name = F.concat(F.lit("S"), F.col("l_linestatus"), F.lit("_run_"), F.when(F.col("l_returnflag") != "N", "pos").otherwise("neg"))
    rows = i.table(s, d, "lineitem").select(name.alias("name"), F.concat(F.lit(">"), F.col("l_orderkey").cast("string"), F.lit("\nACGT")).alias("value"))
    rows.write.partitionBy("name").text(path)
    read = corpus.read_fasta(s, path, recursive=True).where("ok").withColumn("file", F.concat(F.regexp_extract("file", "/name=([^/]+)/", 1), F.lit(".fasta")))
    return corpus.positive_files(read).groupBy(corpus.file_label(F.col("file")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {i.SQL_WORD_COUNTS}, v AS (SELECT token, CAST(row_number() OVER (ORDER BY token) AS INT) AS id FROM c WHERE token <> 'UNK' UNION ALL SELECT 'UNK', 0) SELECT token, id FROM v")
def token_list_round_trip(s, d):
    """A plain list of tokens, the line's number being the id."""
    path = scratch.new_path(s, "token-list")
    store.export_token_lines(vocab.with_unk(vocab.build(i.word_counts(s, d))), path)
    return store.load_token_lines(s, path)


@query(f"WITH {i.sql_kmers(6, 3)}, t AS (SELECT kmer AS token FROM k) SELECT token, count(*) AS count FROM t GROUP BY token")
def plugged_parser(s, d):
    """A parser of one's own: a function of a line's Column."""
    path = scratch.new_path(s, "plugged")
    _sequences(s, d).select("seq").write.text(path)
    return vocab.count_tokens(corpus.read_corpus(s, path, lambda line: tk.kmers(line, 6, 3)).select(F.explode("tokens").alias("token")))
