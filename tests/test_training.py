"""The trainer against a plain numpy run, under other partitions and batches, and after an interruption."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import model
from strandloom.sources import checkpoints

SIZES = (13, 9)


def some_examples(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(k // 3), int(rng.integers(SIZES[0])), int(rng.integers(SIZES[1])), bool(k % 3 == 0)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "ord long, query int, context int, is_signal boolean")


def table(df):
    rows = df.orderBy("id").collect()
    return np.array([r.id for r in rows]), np.array([r.x for r in rows])


def plain_run(rows, w, c, s):
    """Example by example in the stated order, with dictionaries of moments."""
    moments = {}
    losses = []

    def adam(side, i, x, g):
        m, v, t = moments.get((side, i), (np.zeros_like(g), np.zeros_like(g), 0))
        m, v, t = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, t + 1
        moments[side, i] = m, v, t
        return x - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    for _ in range(s.epochs):
        seen = []
        for shift in range(s.blocks):
            for cell in range(s.blocks):
                own = sorted(r for r in rows if r[1] % s.blocks == cell and (r[2] - r[1]) % s.blocks == shift)
                for at in range(0, len(own), s.batch):
                    part = own[at : at + s.batch]
                    n = max(1, sum(r[3] for r in part))
                    gw, gc, loss = {}, {}, 0.0
                    for _, q, x, y in part:
                        p = 1 / (1 + np.exp(-w[q] @ c[x]))
                        loss -= np.log(p if y else 1 - p) / n
                        gw[q] = gw.get(q, 0) + (p - y) / n * c[x]
                        gc[x] = gc.get(x, 0) + (p - y) / n * w[q]
                    seen.append(loss)
                    for q, g in gw.items():
                        w[q] = adam("w", q, w[q], g)
                    for x, g in gc.items():
                        c[x] = adam("c", x, c[x], g)
        losses.append(np.mean(seen))
    return w, c, losses


@pytest.mark.parametrize("blocks,batch", [(1, 48), (3, 40), (4, 7)])
def test_equals_plain_run(spark, blocks, batch):
    rows, df = some_examples(spark)
    s = model.Settings(dims=5, epochs=2, batch=batch, rate=0.05, blocks=blocks)
    w, c = (table(model.initial_states(spark, n, side, s))[1].copy() for n, side in zip(SIZES, ("queries", "contexts"), strict=True))
    want_w, want_c, want = plain_run(rows, w, c, s)
    got = model.train(df, SIZES, s)
    ids, x = table(got.queries)
    assert ids.tolist() == list(range(SIZES[0])) and np.abs(x - want_w).max() < 1e-6
    assert np.abs(table(got.contexts)[1] - want_c).max() < 1e-6
    assert np.allclose(got.losses, want, atol=1e-6)


def test_same_weights_for_any_batches_and_partitions(spark):
    _, df = some_examples(spark)
    s = model.Settings(dims=4, epochs=2, batch=30, rate=0.1, blocks=3)
    first = table(model.train(df, SIZES, s).queries)[1]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for rows, parts in ((7, 1), (64, 9)):
            spark.conf.set(key, str(rows))
            assert (table(model.train(df.repartition(parts), SIZES, s).queries)[1] == first).all()
    finally:
        spark.conf.set(key, was)


def test_resumed_run_equals_one_run(spark, tmp_path, monkeypatch):
    _, df = some_examples(spark)
    s = model.Settings(dims=4, epochs=4, batch=30, rate=0.1, blocks=2)
    whole = model.train(df, SIZES, s)
    root, real = f"{tmp_path}/run", checkpoints.write_text

    def killed(spark, path, text):
        if "epoch=2" in path:
            raise KeyboardInterrupt  # the tables of epoch 2 are written, its manifest isn't
        real(spark, path, text)

    monkeypatch.setattr(checkpoints, "write_text", killed)
    with pytest.raises(KeyboardInterrupt):
        model.train(df, SIZES, s, save_dir=root)
    monkeypatch.setattr(checkpoints, "write_text", real)
    assert checkpoints.last_epoch(spark, root).epoch == 1
    again = model.train(df, SIZES, s, save_dir=root)
    assert (table(again.queries)[1] == table(whole.queries)[1]).all() and (table(again.contexts)[1] == table(whole.contexts)[1]).all()
    assert again.losses == whole.losses and checkpoints.last_epoch(spark, root).epoch == 3
    assert model.train(df, SIZES, s, save_dir=root).losses == whole.losses  # nothing is left to do
    with pytest.raises(ValueError):
        model.train(df, SIZES, model.Settings(dims=5, epochs=4, batch=30, rate=0.1, blocks=2), save_dir=root)


def test_given_vectors_and_embed(spark):
    _, df = some_examples(spark)
    s = model.Settings(dims=2, epochs=0, blocks=2)
    given = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(SIZES[0])], "id long, x array<double>")
    got = model.train(df, SIZES, s, (given, None))
    assert table(got.queries)[1][:, 0].tolist() == list(range(SIZES[0]))
    asked = spark.createDataFrame([(3,), (3,), (99,)], "id long")
    assert sorted((r.id, r.w) for r in got.embed(asked).collect()) == [(3, [3.0, 1.0]), (3, [3.0, 1.0]), (99, None)]
    assert got.embeddings().count() == SIZES[0] and got.embeddings().where("c is null").count() == SIZES[0] - SIZES[1]
    with pytest.raises(Exception, match="no vector of 2 numbers"):
        model.train(df, SIZES, s, (given.where("id < 5"), None)).queries.count()


def test_one_block_batches_are_signals_with_their_noise(spark, monkeypatch):
    rows, df = some_examples(spark, 60)
    shapes = []
    real = model.minibatch
    monkeypatch.setattr(model, "minibatch", lambda q, c, query, context, signal, rate: shapes.append((len(query), int(signal.sum()), len(q.ids), len(c.ids))) or real(q, c, query, context, signal, rate))
    s = model.Settings(dims=3, batch=4 * 3, blocks=1)
    cells = model._run_cells(s)
    import pyarrow as pa

    blocks = [model.initial_states(spark, n, side, s).toArrow().to_batches() for n, side in zip(SIZES, ("queries", "contexts"), strict=True)]
    names = ["cell", "kind", "query", "context", "signal", "id", "x", "m", "v", "t"]

    def states(kind, b):
        n = b.num_rows
        return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([kind] * n, pa.int32()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.bool_())), *b.columns], names=names)

    def examples(part):
        n = len(part)
        return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([2] * n, pa.int32()), *(pa.array(list(c)) for c in list(zip(*part, strict=True))[1:]), *(pa.nulls(n, t) for t in (pa.int64(), *[pa.list_(pa.float64())] * 3, pa.int64()))], names=names)

    stream = [states(k, b) for k in (0, 1) for b in blocks[k]] + [examples(rows[i : i + 17]) for i in range(0, 60, 17)]
    out = list(cells(iter(stream)))
    assert shapes == [(12, 4, *SIZES)] * 5
    assert sum(b.num_rows for b in out) == sum(SIZES) + 1


def test_empty_and_bad_examples(spark):
    s = model.Settings(dims=3, epochs=1, blocks=2)
    none = spark.createDataFrame([], "ord long, query int, context int, is_signal boolean")
    got = model.train(none, 4, s)
    assert got.queries.count() == 4 and np.isnan(got.losses[0])
    with pytest.raises(Exception, match="beyond the vocabulary"):
        model.train(spark.createDataFrame([(0, 7, 1, True)], none.schema), 4, s)
    with pytest.raises(ValueError):
        model.Settings(blocks=0)


def test_training_learns_pairs(spark):
    pairs = [(i, 9 - i) for i in range(10)]
    rng = np.random.default_rng(0)
    rows = [(k, q, c, True) for k, (q, c) in enumerate(pairs * 40)] + [(k // 4, int(rng.integers(10)), int(rng.integers(10)), False) for k in range(1600)]
    got = model.train(spark.createDataFrame(rows, "ord long, query int, context int, is_signal boolean"), 10, model.Settings(dims=8, epochs=12, batch=20, rate=0.1, blocks=2))
    both = got.embeddings().orderBy("id").toPandas()
    score = np.stack(both["w"]) @ np.stack(both["c"]).T
    assert got.losses[-1] < got.losses[0]
    assert (score.argmax(1) == [c for _, c in pairs]).all()


def test_examples_are_sorted_once(spark, monkeypatch):
    rows, df = some_examples(spark, 700)
    monkeypatch.setattr(model, "PACK", 16)
    packed = model._packed(df.withColumnRenamed("is_signal", "signal"), 2).orderBy("shift", "cell", "number").collect()
    assert len(packed) < 100 and all(len(r.query) <= 16 for r in packed)
    got = [(r.shift, r.cell, *x) for r in packed for x in zip(r.query, r.context, r.signal, strict=True)]
    assert got == [((c - q) % 2, q % 2, q, c, y) for _, q, c, y in sorted(rows, key=lambda r: ((r[2] - r[1]) % 2, r[1] % 2, *r))]
