import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import tokens as tk
from strandloom.operators import examples, ranges, sampling, tables, vectors, vocab
from strandloom.sources import corpus, store

TOOLS = [("hammer", 5), ("saw", 11), ("drill", 7), ("file", 2), ("wrench", 13)]
KERNEL = [1, 2, 3, 4, 5, 5, 4, 3, 2, 1]


def counts(spark, rows=TOOLS):
    return spark.createDataFrame(rows, "token string, count long")


def test_kmers(spark):
    seqs = ["ACGTAC", "ACG", "AC", "", " ACGTA\n", None]
    for k in (1, 3, 4):
        for stride in (1, 2, 5):
            df = spark.createDataFrame([(s,) for s in seqs], "s string").select(tk.kmers(F.col("s"), k, stride))
            want = [None if s is None else [s.strip()[i : i + k] for i in range(0, len(s.strip()) - k + 1, stride)] for s in seqs]
            assert [r[0] for r in df.collect()][:4] == want[:4]
    with pytest.raises(ValueError):
        tk.kmers(F.col("s"), 0, 1)


def test_reverse_complement_and_canonical(spark):
    row = spark.createDataFrame([("CCATGGTA",), ("GGCATGCC",), ("NKU",)], "s string").select(tk.reverse_complement(F.col("s")).alias("r"), tk.canonical(F.col("s")).alias("c")).collect()
    assert [r.r for r in row] == ["TACCATGG", "GGCATGCC", "UKN"]
    assert row[0].c == "CCATGGTA"


def test_prune_gives_mass_to_unk(spark):
    got = dict(vocab.prune(counts(spark, [*TOOLS, ("UNK", 100)]), 6).collect())
    assert got == {"saw": 11, "drill": 7, "wrench": 13, "UNK": 7}
    assert vocab.dropped(counts(spark), 6).first() == (2, 7)


def test_class_ids_and_class_prune(spark):
    c = counts(spark, [("CCATGGTA", 4), ("GGCATGCC", 5), ("TTGCAACG", 4), ("CGTTGCAA", 9)])
    ids = {r.token: r.id for r in vocab.build(c, reverse_complement=True).collect()}
    assert ids["TTGCAACG"] == ids["CGTTGCAA"] and len(set(ids.values())) == 3 and min(ids.values()) == 1
    assert dict(vocab.prune(c, 6).collect()) == {"CGTTGCAA": 9, "UNK": 13}
    assert dict(vocab.prune(c, 6, "class").collect()) == {"CGTTGCAA": 9, "TTGCAACG": 4, "UNK": 9}


def test_merge_difference_remove_compact(spark):
    merged = dict(vocab.merge(counts(spark), counts(spark, [("hammer", 6), ("chisel", 3), ("wrench", -1)])).collect())
    assert merged["hammer"] == 11 and merged["chisel"] == 3 and merged["wrench"] == 12
    assert vocab.difference(counts(spark), counts(spark)).count() == 0
    v = vocab.build(counts(spark))
    left = vocab.compact(vocab.remove(v, ["saw"]))
    assert sorted(r.id for r in left.collect()) == [1, 2, 3, 4]
    for bad in ("UNK", "kiwi"):
        with pytest.raises(ValueError):
            vocab.remove(v, [bad])


def test_look_up_policies(spark):
    rows = spark.createDataFrame([("drill",), ("kiwi",)], "token string")
    v = vocab.build(counts(spark))
    assert {r.token: (r.id, r["count"]) for r in vocab.look_up(rows, v).collect()} == {"drill": (1, 7), "kiwi": (0, 0)}
    with pytest.raises(Exception, match="unknown token"):
        vocab.look_up(rows, v, on_unknown="error").collect()
    with pytest.raises(ValueError):
        vocab.look_up(rows, v, on_unknown="loud")


def test_dense_ids_follow_the_order(spark):
    got = vocab.dense_ids(spark.range(1000).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("token")), [F.col("token")]).orderBy("token").collect()
    assert [r.id for r in got] == list(range(1, 1001))


def test_draws_follow_counts(spark):
    drawn = sampling.draw_outcomes(spark.range(20000), counts(spark), "t", 1, F.col("id"))
    share = {r.outcome: r["count"] / 20000 for r in drawn.groupBy("outcome").count().collect()}
    for token, n in TOOLS:
        assert abs(share[token] - n / 38) < 0.02


@pytest.mark.parametrize(("pos", "length", "legal"), [(2, 20, [-2, -1, 1, 2, 3, 4, 5]), (19, 20, [-5, -4, -3, -2, -1]), (0, 3, [1, 2])])
def test_kernel_is_cut_at_the_ends(spark, pos, length, legal):
    got = spark.range(6000).select(sampling.choose_offset(F.lit(pos), F.lit(length), KERNEL, F.xxhash64("id")).alias("o")).groupBy("o").count().collect()
    weights = dict(zip([*range(-5, 0), *range(1, 6)], KERNEL, strict=True))
    total = sum(weights[o] for o in legal)
    assert sorted(r.o for r in got) == legal
    for r in got:
        assert abs(r["count"] / 6000 - weights[r.o] / total) < 0.03


def test_kernel_and_split_are_checked(spark):
    with pytest.raises(ValueError):
        sampling.check_kernel([1, 2, 3])
    with pytest.raises(ValueError):
        sampling.split(spark.range(3), 1.0, 1, F.col("id"))


def test_macrobatches_are_padded(spark):
    rows = spark.range(11).select("id", (F.col("id") + 1).cast("int").alias("query"), F.lit(3).alias("context"))
    got = examples.macrobatches(rows, 5, ["id"]).groupBy("macrobatch_id").agg(F.count("*").alias("n"), F.sum((F.col("query") == 0).cast("int")).alias("pad")).orderBy("macrobatch_id").collect()
    assert [(r.n, r.pad) for r in got] == [(5, 0), (5, 0), (5, 4)]
    assert examples.macrobatches(rows.limit(10), 5, ["id"]).where("query = 0").count() == 0
    assert examples.minibatches(rows, 4, ["id"], "drop").count() == 8


def test_contrastive_loss(spark):
    rows = [(s, True) for s in (0.6, 0.7, 0.8)] + [(n, False) for n in (0.2, 0.3, 0.1, 0.5, 0.6, 0.7)]
    got = vectors.contrastive_loss(spark.createDataFrame(rows, "score double, is_signal boolean")).first().loss
    want = -(np.log([0.6, 0.7, 0.8]).sum() + np.log(1 - np.array([0.2, 0.3, 0.1, 0.5, 0.6, 0.7])).sum()) / 3
    assert abs(got - want) < 1e-12


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "ALX4_x_pos.fasta").write_text(">\nacgt\n>a\nACGTA\n\n>bad\nAC\nGT\n>\nTTTT\n")
    with gzip.open(tmp_path / "B_y_neg.fasta.gz", "wt") as f:
        f.write(">z\nGGGG\n")
    df = corpus.read_fasta(spark, str(tmp_path))
    got = sorted((r.id, r.seq, r.ok) for r in df.collect())
    assert got == sorted([("", "ACGT", True), ("a", "ACGTA", True), ("bad", None, False), ("", "TTTT", True), ("z", "GGGG", True)])
    assert {r[0] for r in df.select(corpus.file_label(F.col("file"))).collect()} == {"ALX4", "B"}
    assert corpus.read_fasta(spark, str(tmp_path), multiline=True).where("seq = 'ACGT' and id = 'bad'").count() == 1
    assert corpus.read_fasta(spark, str(tmp_path), skip=["neg"]).where("id = 'z'").count() == 0
    assert corpus.bad_records(df).first().n_bad == 1
    (tmp_path / "r.fastq").write_text("@HISEQ:1\nACGT\n+\nIIII\n@HISEQ:2\nacg\n+\n")
    fq = corpus.read_fastq(spark, str(tmp_path / "r.fastq")).orderBy("id").collect()
    assert [(r.id, r.seq, r.ok) for r in fq] == [("@HISEQ:1", "ACGT", True), ("@HISEQ:2", None, False)]


def test_record_names_keep_their_digits(spark, tmp_path):
    (tmp_path / "n.fasta").write_text(">10\n ACGT \n>0\nAC\n")
    assert {(r.id, r.seq) for r in corpus.read_fasta(spark, str(tmp_path / "n.fasta")).collect()} == {("10", "ACGT"), ("0", "AC")}
    (tmp_path / "n.fastq").write_text("@HISEQ:10\n ACGT\n+\n1122\n")
    row = corpus.read_fastq(spark, str(tmp_path / "n.fastq")).first()
    assert (row.id, row.seq, row.quality) == ("@HISEQ:10", "ACGT", "1122")


def test_text_and_dispatch(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("one two\tthree\n\n four\n")
    got = [r.tokens for r in corpus.read_corpus(spark, str(tmp_path / "a.tsv")).collect()]
    assert sorted(got, key=len) == [[], ["four"], ["one", "two", "three"]]
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(tmp_path), parser="fasta")


def test_vocabulary_round_trip(spark, tmp_path):
    v = vocab.build(counts(spark))
    store.save_vocabulary(v, str(tmp_path))
    assert sorted(store.load_vocabulary(spark, str(tmp_path)).collect()) == sorted(v.collect())
    store.export_text(v, str(tmp_path))
    assert {(r.token, r.id, r["count"]) for r in store.import_text(spark, str(tmp_path)).collect()} == {(r.token, r.id, r["count"]) for r in v.collect()}


def test_streaming_counter(spark, tmp_path):
    from strandloom.streaming.counter import CountStore, start_counter

    (tmp_path / "in").mkdir()
    kept = CountStore(spark, str(tmp_path / "state"), merge_after=2)
    assert kept.counts().isEmpty()
    want = {}
    for k in range(5):  # a query that ends and starts again, over what is new
        (tmp_path / "in" / f"{k}.txt").write_text(f"x y x w{k}\n\n")
        for w in ("x", "y", "x", f"w{k}"):
            want[w] = want.get(w, 0) + 1
        start_counter(spark, str(tmp_path / "in"), kept, str(tmp_path / "cp")).awaitTermination(60)
        assert dict(kept.counts().collect()) == want
    assert kept.merged_to() == 3 and kept.batches() == [4]
    again = spark.createDataFrame([(w,) for w in ("x", "y", "x", "w4")], "token string")
    kept.add(again, 4)  # batches that are run again count once
    kept.add(again, 2)
    assert dict(kept.counts().collect()) == want
    (tmp_path / "state" / "batches" / "batch=9").mkdir(parents=True)  # begun, never ended
    assert dict(kept.counts().collect()) == want


def test_zip_corpus(spark, tmp_path):
    import zipfile

    from strandloom.sources import archives

    (tmp_path / "in" / "sub").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", "a b\r\n\nç")
        z.writestr("folder/", "")
        z.writestr("skip.csv", "no")
        z.writestr("big.txt", "word " * 20 + "\n" + "0123456789\n" * 300_000)
    with zipfile.ZipFile(tmp_path / "in" / "sub" / "b.zip", "w") as z:
        z.writestr("empty.txt", "")
    rows = archives.read_zip(spark, str(tmp_path / "in"), ".txt")
    assert rows.rdd.getNumPartitions() == 3
    assert [(r.line_no, r.value) for r in rows.where("member = 'one.txt'").orderBy("line_no").collect()] == [(0, "a b"), (1, ""), (2, "ç")]
    assert rows.where("member = 'big.txt'").agg(F.count(F.lit(1)), F.max("line_no")).first() == (300_001, 300_000)
    assert archives.read_zip(spark, str(tmp_path / "in" / "sub" / "b.zip")).count() == 0
    lines = spark.createDataFrame([(f"m{k % 7}", f"line {k}") for k in range(200)] + [("m0", None)], "member string, value string").repartition(5)
    assert archives.write_zip(lines, str(tmp_path / "out"), archives=3) <= 3
    got = archives.read_zip(spark, str(tmp_path / "out"))
    assert sorted((r.member, r.value) for r in got.collect()) == sorted((r.member, r.value or "") for r in lines.collect())
    with pytest.raises(Exception, match="nowhere"):
        archives.read_zip(spark, str(tmp_path / "nowhere")).count()


def test_no_examples_keep_int_pairs(spark):
    none = spark.createDataFrame([], "sent long, pos int, length int, token string")
    got = examples.signal(none, vocab.build(counts(spark)), KERNEL, 0.1, 1)
    assert dict(got.dtypes)["query"] == dict(got.dtypes)["context"] == "int" and got.isEmpty()
    batched = examples.macrobatches(got, 4, ["sent", "pos"])
    assert batched.columns == ["macrobatch_id", "row_in_batch", "query", "context"] and set(dict(batched.dtypes).values()) == {"int"} and batched.isEmpty()
    with pytest.raises(ValueError):
        sampling.draw_outcomes(spark.range(3), counts(spark, [("x", 0)]), "t", 1, F.col("id"))


def test_config():
    c = Config.from_mapping({"K": 8, "kernel": [1, 1], "momentum": 0.9})
    assert c.k == 8 and c.kernel == (1, 1) and c.extra == {"momentum": 0.9}
    for bad in ({"kernel": [1]}, {"split": 1.0}, {"stride": 0}):
        with pytest.raises(ValueError):
            Config.from_mapping(bad)


def test_entry_point_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _long_and_short(spark):
    """A sentence of 57 tokens, short ones, one of a single token and one without a name."""
    rows = [(s, n, f"{s}-{n}") for s, size in (("long", 57), ("a", 3), ("b", 1), (None, 23), ("c", 8)) for n in range(size)]
    return spark.createDataFrame(rows, "s string, n int, t string").repartition(5)


def test_long_sentences_are_dealt_to_chunks(spark):
    rows = _long_and_short(spark)
    one, many = (examples.positions(rows, "s", ["n"], "t", chunk) for chunk in (1000, 7))
    assert one.dtypes == many.dtypes
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert {(r.sent, r.length) for r in many.collect()} == {("long", 57), ("a", 3), ("b", 1), (None, 23), ("c", 8)}
    assert all(r.token.endswith(f"-{r.pos}") for r in many.collect())
    for make in (lambda t, chunk: examples.with_context(t, KERNEL, 1, 1, chunk), lambda t, chunk: examples.skip_grams(t, 3, 2, 1, chunk)):
        want = sorted(map(str, make(one, 1000).collect()))
        assert want == sorted(map(str, make(many, 7).collect())) == sorted(map(str, make(one, 5).collect()))
    with pytest.raises(ValueError):
        examples.with_context(one, KERNEL, 1, chunk=4)


def test_contexts_are_the_tokens_at_the_offset(spark):
    got = examples.with_context(examples.positions(_long_and_short(spark), "s", ["n"], "t", 6), KERNEL, 3, chunk=6).collect()
    assert len(got) == 57 + 3 + 23 + 8
    assert all(r.context == f"{r.sent}-{r.pos + r.offset}" for r in got)


def test_no_task_holds_a_long_sentence(spark):
    tokens = examples.positions(_long_and_short(spark), "s", ["n"], "t", 7)
    held = ranges.in_chunks(tokens, 2, 2, 7).groupBy("sent", "_chunk").agg(F.count(F.lit(1)).alias("n"), F.count_if("_own").alias("own")).collect()
    assert max(r.n for r in held) <= 7 + 4
    assert sum(r.own for r in held) == 92


def test_epochs_of_a_long_log(spark):
    rng = np.random.default_rng(5)
    numbers = {g: [int(x) for x in rng.integers(0, 4, size)] for g, size in (("x", 61), ("y", 5), (None, 19))}
    rows = [(g, k, m) for g, ms in numbers.items() for k, m in enumerate(ms)]
    want = {}
    for g, ms in numbers.items():
        epoch, last = 0, 0
        for k, m in enumerate(ms):
            epoch, last = epoch + (abs(m - last) > 1), m
            want[g, k] = epoch
    df = spark.createDataFrame(rows, "g string, k int, m int").repartition(4)
    for chunk in (1000, 6):
        assert {(r.g, r.k): r.epoch for r in tables.epochs(df, "g", "k", "m", chunk).collect()} == want
    assert tables.epochs(df.limit(0), "g", "k", "m").count() == 0


def test_hold_out_groups_by_hash_order(spark):
    df = spark.createDataFrame([(f"g{k % 9}",) for k in range(40)] + [(None,)], "g string")
    parts = [r.part for r in sampling.hold_out_groups(df, "g", 4).collect()]
    assert sorted(parts) == ["test"] + ["train"] * 8 + ["valid"]


def test_zip_partitions_hold_many_members(spark, tmp_path, monkeypatch):
    import zipfile

    from strandloom.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(500):
            z.writestr(f"{k}.txt", f"first {k}\nsecond")
    rows = archives.read_zip(spark, str(tmp_path), ".txt")
    assert rows.rdd.getNumPartitions() == 1
    got = sorted((r.member, r.line_no, r.value) for r in rows.collect())
    assert got == sorted((f"{k}.txt", n, v) for k in range(500) for n, v in enumerate((f"first {k}", "second")))
    monkeypatch.setattr(archives, "PARTITION_BYTES", 1600)
    parts = archives.ZipReader({"path": str(tmp_path)}).partitions()
    assert 4 <= len(parts) <= 8 and [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and parts[-1].stop == 500


def test_bags_shuffle_texts_once(spark, tmp_path):
    from strandloom.plans import inputs

    rows = [(1, "a b a\nb"), (1, "a c"), (2, None), (None, "d\td"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = inputs.bags(spark, str(tmp_path))
    assert sorted((r.doc_id or 0, r.token, r.n) for r in found.collect()) == [(0, "d", 2), (1, "a", 3), (1, "b", 2), (1, "c", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate explode")


def test_merged_labels_shuffle_sequences(spark, tmp_path):
    from strandloom.plans import catalogue

    rows = [(1, "abcdefgh" * 4, "en"), (1, "abcdefgh", "de"), (2, None, "en"), (3, "hgfedcbazz", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["merge_label_counts"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    assert sorted((r.doc_id, r.lang or "", r.n) for r in found.collect()) == [(1, "de", 2), (1, "en", 14), (3, "", 3)]


def test_projection_shuffles_no_token_shares(spark, tmp_path):
    """sums of a sentence are made where its tokens are, so more partitions don't shuffle more of them, and no draws meet tokens in a join."""
    from strandloom.functions import rng
    from strandloom.plans import catalogue

    rows = [(d, " ".join(f"w{(d * 7 + j * j) % 211}" for j in range(60))) for d in range(40)] + [(40, None), (41, ""), (42, "x" * 60 + " \u00e9 \u00e9"), (42, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["random_projection_words"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2  # texts, and the sums of each sentence
    got = {(r.doc_id, r.dim): r.value for r in found.collect()}
    words = spark.createDataFrame(rows, "d long, t string").select("d", F.explode(F.split("t", " ")).alias("t")).where("t <> ''")
    u, v = (rng.uniform(tag, 42, F.col("t"), F.col("k")) for tag in ("proj-u", "proj-v"))
    drawn = words.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("z", F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v))
    want = {(r.d, r.k): r.s for r in drawn.groupBy("d", "k").agg((F.sum("z") / 10).alias("s")).collect()}
    assert got.keys() == want.keys() and len(got) == 4100 and max(abs(got[x] - want[x]) for x in got) < 1e-6


def test_projection_of_a_sentence_in_two_blocks(monkeypatch):
    import pyarrow as pa

    tokens = [f"t{j % 5}" for j in range(12)]
    table = pa.table({"s": [1] * 5 + [2] * 4 + [None] * 3, "_t": tokens, "_n": [float(j) for j in range(12)]})

    def sums(pairs, per_token):
        monkeypatch.setattr(vectors, "PAIRS", pairs)
        monkeypatch.setattr(vectors, "TOKENS", per_token)
        out, rows = {}, 0
        for b in vectors._projected(iter(table.to_batches(max_chunksize=2)), "s", 3, 7):
            for s, v in zip(*b.to_pydict().values(), strict=True):
                out[s], rows = out.get(s, 0) + np.array(v), rows + 1
        return out, rows

    (whole, n), (cut, m) = sums(100, 100), sums(4, 2)
    assert n == 3 and m > 3 and whole.keys() == cut.keys() == {1, 2, None}
    assert all(np.allclose(whole[s], cut[s], atol=1e-12) for s in whole)


def test_draws_inside_tasks_are_those_of_columns(spark):
    from strandloom.functions import rng

    keys = ["", "a", "b", "word", "\u00e9\u6f22", "x" * 41, "x" * 42, "x" * 43, "y" * 200]
    keyed = spark.createDataFrame([(k, d) for k in keys for d in range(12)], "t string, d int")
    want = {(r.t, r.d): r.u for r in keyed.select("t", "d", rng.uniform("proj-u", 42, F.col("t"), F.col("d")).alias("u")).collect()}
    got = rng.uniforms("proj-u", 42, [k.encode() for k in keys], 12)
    assert all(got[i, d] == want[k, d] for i, k in enumerate(keys) for d in range(12))


def test_noise_draws_once_and_meets_the_vocabulary_once(spark, tmp_path):
    """the intervals carry ids, so what was drawn needs no second join, and no filter of the join draws again."""
    import hashlib

    vocab.build(counts(spark)).write.parquet(str(tmp_path / "vocab"))
    words = spark.read.parquet(str(tmp_path / "vocab"))
    signal = spark.createDataFrame([(s, p, 9) for s in range(20) for p in range(5)], "sent long, pos int, query int")
    signal.write.parquet(str(tmp_path / "signal"))
    found = examples.noise(spark.read.parquet(str(tmp_path / "signal")), words, 3, 42)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("Join ") == 2  # offsets of the ranges, intervals
    ids = [k for k, (_, n) in enumerate(sorted(TOOLS), 1) for _ in range(n)]
    at = lambda *key: ids[int(hashlib.md5("|".join(map(str, ("noise", 42, *key))).encode()).hexdigest()[:15], 16) % len(ids)]
    assert sorted(map(tuple, found.collect())) == sorted((s, p, d, 9, at(s, p, d)) for s in range(20) for p in range(5) for d in (1, 2, 3))
