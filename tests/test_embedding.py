"""Estimator, model, persistence and the run from a Config."""

import pytest
from pyspark.sql import functions as F

from strandloom import embedding
from strandloom.config import Config
from strandloom.operators import tables
from strandloom.sources import checkpoints, store

SMALL = {"dims": 4, "epochs": 2, "noiseRatio": 2, "batchSize": 10, "blocks": 2, "t": 1.0, "kernel": [1, 2, 2, 1]}
LINES = ["ab cd ef gh", "cd ef ab", "gh gh ab cd", "solo", "", "ef ab cd gh ab"] * 4


def sentences(spark):
    return spark.createDataFrame([(k, line.split()) for k, line in enumerate(LINES)], "sent long, tokens array<string>")


def test_fit_save_load_transform(spark, tmp_path):
    fitted = embedding.TokenEmbedding(**SMALL).fit(sentences(spark))
    asked = sentences(spark).union(spark.createDataFrame([(99, ["ab", "never"])], "sent long, tokens array<string>"))
    first = {r.sent: r.vector for r in fitted.transform(asked).collect()}
    fitted.write().overwrite().save(f"{tmp_path}/model")
    again = embedding.TokenEmbeddingModel.load(f"{tmp_path}/model")
    assert {r.sent: r.vector for r in again.transform(asked).collect()} == first
    assert again.losses == fitted.losses and again.uid == fitted.uid and again.getOrDefault(again.dims) == 4
    by_token = {r.token: r.x for r in fitted.token_vectors().collect()}
    assert set(by_token) == {"UNK", "ab", "cd", "ef", "gh", "solo"}
    assert first[4] is None and first[3] == pytest.approx(by_token["solo"])
    assert first[99] == pytest.approx([(a + b) / 2 for a, b in zip(by_token["ab"], by_token["UNK"], strict=True)])
    assert first[2] == pytest.approx([(2 * g + a + c) / 4 for g, a, c in zip(*(by_token[k] for k in ("gh", "ab", "cd")), strict=True)])


def test_estimator_persists_and_hooks_are_used(spark, tmp_path):
    class OnlyFirst(embedding.TokenEmbedding):
        def signal_examples(self, tokens, words):
            return super().signal_examples(tokens, words).where("pos = 0")

    embedding.TokenEmbedding(**SMALL).write().overwrite().save(f"{tmp_path}/estimator")
    loaded = embedding.TokenEmbedding.load(f"{tmp_path}/estimator")
    assert loaded.getOrDefault(loaded.kernel) == [1, 2, 2, 1] and loaded.getOrDefault(loaded.noiseRatio) == 2
    own = OnlyFirst(**SMALL)
    tokens = own.tokens_of(sentences(spark))
    words = own.vocabulary_of(tokens)
    rows = own.examples_of(tokens, words)
    long = sum(len(line.split()) > 1 for line in LINES)
    assert rows.where("is_signal").count() == long and rows.where("not is_signal").count() == 2 * long
    assert rows.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("q")).where("n != 3 or q != 1").count() == 0
    with pytest.raises(RuntimeError):
        own.examples_of(tokens, None)


def test_run_from_config(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(LINES) + "\n")
    (tmp_path / "in" / "skipped.txt").write_text("never never never\n" * 5)
    out = tmp_path / "out"
    out.mkdir()
    (tmp_path / "c.yaml").write_text(f"directories: [{tmp_path}/in]\nskip: [skipped]\ndims: 3\nnum_epochs: 2\nnoise_ratio: 2\nbatch_size: 8\nblocks: 2\nt: 1.0\nkernel: [1, 1]\nrate: 0.05\nsave_dir: {out}\nlog_path: {out}/training.log\n")
    config = Config.from_yaml(f"{tmp_path}/c.yaml")
    fitted, loss = embedding.run(spark, config)
    assert loss > 0 and len(fitted.losses) == 2
    assert {r.token for r in fitted.vocabulary.collect()} <= {"UNK", "ab", "cd", "ef", "gh", "solo"}
    saved = checkpoints.last_epoch(spark, str(out))
    assert saved.epoch == 1 and saved.values["losses"] == fitted.losses
    lines = [r for r in tables.read_log(spark, f"{out}/training.log").collect() if r.macrobatch is not None]
    assert [r.macrobatch for r in lines] == [0, 1, 0, 1]
    weights = {r.id: r.x for r in fitted.queries.collect()}
    again, loss_again = embedding.run(spark, config)  # resumes after the last epoch
    assert {r.id: r.x for r in again.queries.collect()} == weights and loss_again == loss
    words = store.load_prepared(spark, str(out))
    assert {r.token for r in words.collect()} == {r.token for r in fitted.vocabulary.collect()}
    for bad in ({}, {"files": [f"{tmp_path}/in/a.txt"], "save_dir": "/proc/nowhere"}):
        with pytest.raises((ValueError, OSError)):
            embedding.run(spark, Config.from_mapping(bad))
