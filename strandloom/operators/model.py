"""Noise-contrastive token embeddings, trained in blocks of ids with state that outlives a task.

Queries and contexts have a table each: (id, x, m, v, t), a vector, Adam's two moments of it and how often it has been
stepped. Ids are dealt into blocks by their remainder. An epoch has as many rounds as there are blocks; in round s, cell i holds query block i
and context block i + s, so no two cells of a round share a row, and they can run anywhere in any order with one result. A
task streams a cell: its states come first, then its examples in their order, then it gives the states back. So it holds two blocks and one minibatch,
the driver holds nothing of the vocabulary's size, and neither partitions nor Arrow batches change a weight.

Adam steps only the rows that a minibatch touches, with their own step counts. With one block and examples in order of their signal, a minibatch of
batch * (1 + ratio) rows is that many signals, each with its noise. A token that very many examples share makes its cell's stream long (not large);
down-sampling is what shortens it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.functions.rng import uniform
from strandloom.sources import checkpoints
from strandloom.sources.scratch import discard, stored

# Adam's usual rates and its guard against division by zero.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
STATE = "id long, x array<double>, m array<double>, v array<double>, t long"
CELL = "side int, id long, x array<double>, m array<double>, v array<double>, t long"
QUERY, CONTEXT, LOSS = 0, 1, 2
#: Examples of a stored row.
PACK = 256


@dataclass(frozen=True)
class Settings:
    dims: int = 100
    epochs: int = 10
    #: Rows of a minibatch, noise included.
    batch: int = 1000
    rate: float = 0.001
    blocks: int = 8
    seed: int = 42
    scale: float = 0.1

    def __post_init__(self):
        if min(self.dims, self.batch, self.blocks) < 1 or self.epochs < 0:
            raise ValueError("dims, batch and blocks must be at least 1, epochs at least 0")


def normal(tag: str, seed: int, *keys: Column) -> Column:
    """A standard normal draw keyed by the columns (Box-Muller)."""
    u, v = uniform(f"{tag}-u", seed, *keys), uniform(f"{tag}-v", seed, *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def initial_states(spark: SparkSession, size: int, side: str, settings: Settings, given: DataFrame | None = None) -> DataFrame:
    """States of ids 0 .. size - 1: drawn by id and dimension, or given vectors (id, x), which must be there for every id."""
    dims = settings.dims
    if given is None:
        rows = spark.range(size).select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.lit(settings.scale) * normal(f"init-{side}", settings.seed, F.col("id"), k)).alias("x"))
    else:
        wrong = F.raise_error(F.concat(F.lit(f"no vector of {dims} numbers for {side} "), F.col("id").cast("string"))).cast("array<double>")
        rows = spark.range(size).join(given.select("id", F.col("x").cast("array<double>").alias("_x")), "id", "left").select("id", F.when(F.size("_x") == dims, F.col("_x")).otherwise(wrong).alias("x"))
    zero = F.array_repeat(F.lit(0.0), dims)
    return rows.select("id", "x", zero.alias("m"), zero.alias("v"), F.lit(0).cast("long").alias("t"))


class Block:
    """The states of a block's ids, dense; ``at`` finds their rows."""

    def __init__(self, dims: int):
        self.dims, self.parts = dims, []
        self.ids = self.x = self.m = self.v = self.t = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def ready(self) -> None:
        def column(k):
            return pa.chunked_array([p.column(k) for p in self.parts]).combine_chunks() if self.parts else None

        ids = column(0)
        self.ids = np.zeros(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)
        self.x, self.m, self.v = ((np.zeros((0, self.dims)) if ids is None else np.array(column(k).flatten()).reshape(-1, self.dims)) for k in (1, 2, 3))
        self.t = np.zeros(0, np.int64) if ids is None else np.array(column(4))
        order = np.argsort(self.ids)
        self.ids, self.x, self.m, self.v, self.t = (a[order] for a in (self.ids, self.x, self.m, self.v, self.t))
        self.parts = []

    def at(self, ids: np.ndarray) -> np.ndarray:
        rows = np.searchsorted(self.ids, ids)
        if len(ids) and (rows.max(initial=0) >= len(self.ids) or (self.ids[rows] != ids).any()):
            raise ValueError("an example has an id beyond the vocabulary")
        return rows

    def step(self, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        """Adam on the touched rows; gradient has a row for each."""
        t = self.t[rows] = self.t[rows] + 1
        m = self.m[rows] = BETA1 * self.m[rows] + (1 - BETA1) * gradient
        v = self.v[rows] = BETA2 * self.v[rows] + (1 - BETA2) * gradient**2
        self.x[rows] -= rate * (m / (1 - BETA1**t)[:, None]) / (np.sqrt(v / (1 - BETA2**t)[:, None]) + EPSILON)

    def rows(self, side: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), 2000):
            part = slice(i, i + 2000)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a[part].reshape(-1)), self.dims).cast(pa.list_(pa.float64())) for a in (self.x, self.m, self.v)]
            n = len(self.ids[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, side, np.int32)), pa.array(self.ids[part]), *lists, pa.array(self.t[part])], names=["side", "id", "x", "m", "v", "t"])


def minibatch(queries: Block, contexts: Block, query: np.ndarray, context: np.ndarray, signal: np.ndarray, rate: float) -> float:
    """One step in place; the loss for each signal row, or for the batch if it has none."""
    size = max(1, len(contexts.ids))
    pairs, times = np.unique((queries.at(query) * size + contexts.at(context)) * 2 + signal, return_counts=True)  # equal examples are one with their number
    q, c, signal = pairs // 2 // size, pairs // 2 % size, pairs % 2 == 1
    xq, xc = queries.x[q], contexts.x[c]
    s = 1 / (1 + np.exp(-np.clip((xq * xc).sum(axis=1), -30, 30)))
    n = max(1, int(times[signal].sum()))
    loss = -((times[signal] * np.log(s[signal] + 1e-12)).sum() + (times[~signal] * np.log(1 - s[~signal] + 1e-12)).sum()) / n
    d = (times * (s - signal) / n)[:, None]
    for block, rows, gradient in ((queries, q, d * xc), (contexts, c, d * xq)):
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
        block.step(rows[order][starts], np.add.reduceat(gradient[order], starts, axis=0), rate)
    return float(loss)


def _run_cells(settings: Settings):
    """mapInArrow over rows (cell, kind, query, context, signal, id, x, m, v, t) sorted by cell, kind and the examples' order."""

    def run(batches):
        cell, blocks, held, losses = None, None, None, None

        def steps(everything: bool):
            nonlocal held
            while len(held[0]) >= settings.batch or (everything and len(held[0])):
                now, held = [h[: settings.batch] for h in held], [h[settings.batch :] for h in held]
                losses.append(minibatch(*blocks, *now, settings.rate))

        def done():
            for b in blocks:
                if b.ids is None:
                    b.ready()
            steps(True)
            for side in (QUERY, CONTEXT):
                yield from blocks[side].rows(side)
            good = [x for x in losses if not np.isnan(x)]
            row = [pa.array([LOSS], pa.int32()), pa.array([int(cell)]), *(pa.array([x], pa.list_(pa.float64())) for x in ([float(np.sum(good)), float(len(good))], [], [])), pa.array([len(losses)])]
            yield pa.RecordBatch.from_arrays(row, names=["side", "id", "x", "m", "v", "t"])

        for got in batches:
            cells, kinds = (got.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])]) if len(cells) else []
            for start, stop in zip(cuts, [*cuts[1:], len(cells)], strict=True) if len(cells) else ():
                if cells[start] != cell:
                    if cell is not None:
                        yield from done()
                    cell, blocks, losses = cells[start], (Block(settings.dims), Block(settings.dims)), []
                    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
                part = got.slice(start, stop - start)
                if kinds[start] < 2:
                    blocks[kinds[start]].add(pa.RecordBatch.from_arrays([part.column(k) for k in range(5, 10)], names=["id", "x", "m", "v", "t"]))
                    continue
                for b in blocks:
                    if b.ids is None:
                        b.ready()
                held = [np.concatenate([h, part.column(k).to_numpy(zero_copy_only=False)]) for h, k in zip(held, (2, 3, 4), strict=True)]
                steps(False)
        if cell is not None:
            yield from done()

    return run


def _packed(examples: DataFrame, blocks: int) -> DataFrame:
    """Stored (shift, cell, number, query, context, signal): the examples of each round and cell in their order, PACK to a row, so that they are sorted once and not in every epoch."""

    def pack(batches):
        task, made = TaskContext.get().partitionId(), 0
        for got in batches:
            shifts, cells = (got.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero(np.r_[True, (shifts[1:] != shifts[:-1]) | (cells[1:] != cells[:-1])]) if len(cells) else np.zeros(0, np.int64)
            starts = np.concatenate([np.arange(lo, hi, PACK) for lo, hi in zip(cuts, [*cuts[1:], len(cells)], strict=True)]).astype(np.int32) if len(cells) else np.zeros(0, np.int32)
            ends = pa.array(np.r_[starts, np.int32(len(cells))].astype(np.int32))
            number = (np.int64(task) << 40) + made + np.arange(len(starts))
            made += len(starts)
            lists = [pa.ListArray.from_arrays(ends, got.column(k)) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([got.column(0).take(pa.array(starts)), got.column(1).take(pa.array(starts)), pa.array(number), *lists], names=["shift", "cell", "number", "query", "context", "signal"])

    placed = examples.select(F.pmod(F.col("context") - F.col("query"), F.lit(blocks)).cast("int").alias("shift"), F.pmod("query", F.lit(blocks)).cast("int").alias("cell"), "ord", F.col("query").cast("long").alias("query"), F.col("context").cast("long").alias("context"), "signal")
    order = ["shift", "cell", "ord", "query", "context", "signal"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("ord")
    return stored(examples.sparkSession, dealt.mapInArrow(pack, "shift int, cell int, number long, query array<long>, context array<long>, signal array<boolean>"), "packed")


def _unpacked(batches):
    """Rows of _run_cells from such with packed examples."""
    names = ["cell", "kind", "query", "context", "signal", "id", "x", "m", "v", "t"]
    for got in batches:
        packed = got.column(1).to_numpy(zero_copy_only=False) == 2
        cuts = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else []
        for start, stop in zip(cuts, [*cuts[1:], len(packed)], strict=True) if len(packed) else ():
            part = got.slice(start, stop - start)
            if packed[start]:
                times = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                head = [pa.array(np.repeat(part.column(k).to_numpy(zero_copy_only=False), times)) for k in (0, 1)]
                rest = [pa.nulls(int(times.sum()), part.column(k).type) for k in range(5, 10)]
                yield pa.RecordBatch.from_arrays([*head, *(part.column(k).flatten() for k in (2, 3, 4)), *rest], names=names)
            else:
                none = [pa.nulls(part.num_rows, part.column(k).type.value_type) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *none, *(part.column(k) for k in range(5, 10))], names=names)


def _round(queries: DataFrame, contexts: DataFrame, packed: DataFrame, shift: int, settings: Settings, name: str) -> DataFrame:
    """Stored rows of CELL: the states after a round, and each cell's losses."""
    blocks = settings.blocks
    none = [F.lit(None).cast(t).alias(n) for n, t in (("query", "array<long>"), ("context", "array<long>"), ("signal", "array<boolean>"))]
    state = ["id", "x", "m", "v", "t"]
    first = F.lit(None).cast("long").alias("number")
    mine = F.pmod("id", F.lit(blocks)).cast("int")
    parts = queries.select(mine.alias("cell"), F.lit(QUERY).alias("kind"), first, *none, *state)
    parts = parts.union(contexts.select(F.pmod(mine - shift, F.lit(blocks)).alias("cell"), F.lit(CONTEXT).alias("kind"), first, *none, *state))
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("x", "array<double>"), ("m", "array<double>"), ("v", "array<double>"), ("t", "long"))]
    parts = parts.union(packed.where(F.col("shift") == shift).select("cell", F.lit(2).alias("kind"), "number", "query", "context", "signal", *empty))
    dealt = parts.repartition(blocks, "cell").sortWithinPartitions("cell", "kind", "number").drop("number")
    run = _run_cells(settings)
    return stored(queries.sparkSession, dealt.mapInArrow(lambda batches: run(_unpacked(batches)), CELL), name)


@dataclass
class Trained:
    """Stored tables (id, x, m, v, t) and the mean loss of a minibatch in each epoch."""

    queries: DataFrame
    contexts: DataFrame
    losses: list[float]

    def embeddings(self) -> DataFrame:
        """(id, w, c) of the ids that either side has."""
        return self.queries.select("id", F.col("x").alias("w")).join(self.contexts.select("id", F.col("x").alias("c")), "id", "full")

    def embed(self, ids: DataFrame, id_col: str = "id") -> DataFrame:
        """ids with the query vector w of their id; null for one that isn't in the vocabulary."""
        return ids.join(self.queries.select(F.col("id").alias("_id"), F.col("x").alias("w")), F.col(id_col) == F.col("_id"), "left").drop("_id")


def train(examples: DataFrame, size: int | tuple[int, int], settings: Settings = Settings(), given: tuple[DataFrame | None, DataFrame | None] = (None, None), save_dir: str | None = None, on_round: Callable[[int, int, float], None] | None = None) -> Trained:
    """Trains on examples (ord, query, context, is_signal); size is the number of ids, or one number for queries and one for contexts.

    With save_dir each epoch is saved and committed there, and a start goes on after the last committed epoch; an interrupted epoch
    is run again from its start, with the same result. on_round gets the epoch, the round and the mean loss of its minibatches.
    """
    spark = examples.sparkSession
    sizes = size if isinstance(size, tuple) else (size, size)
    rows = stored(spark, examples.select(F.col("ord").cast("long").alias("ord"), F.col("query").cast("long").alias("query"), F.col("context").cast("long").alias("context"), F.col("is_signal").cast("boolean").alias("signal")), "examples")
    examples_of_rounds = _packed(rows, settings.blocks)
    discard(spark, rows)
    begun, losses = 0, []
    saved = checkpoints.last_epoch(spark, save_dir) if save_dir else None
    if saved is None:
        states = [stored(spark, initial_states(spark, n, side, settings, table), side) for n, side, table in zip(sizes, ("queries", "contexts"), given, strict=True)]
    else:
        begun, (queries, contexts), losses = saved.epoch + 1, (saved.table("queries"), saved.table("contexts")), list(saved.values["losses"])
        if saved.values["settings"] != checkpoints.plain(settings, "epochs") or saved.values["sizes"] != list(sizes):
            raise ValueError(f"the checkpoint under {save_dir} is of other settings")
        states = [queries, contexts]
    for epoch in range(begun, settings.epochs):
        total = count = 0.0
        for shift in range(settings.blocks):
            out = _round(*states, examples_of_rounds, shift, settings, f"round-{epoch}-{shift}")
            loss = out.where(F.col("side") == LOSS).agg(F.sum(F.col("x")[0]), F.sum(F.col("x")[1])).first()
            total, count = total + (loss[0] or 0.0), count + (loss[1] or 0.0)
            if on_round and loss[1]:
                on_round(epoch, shift, loss[0] / loss[1])
            before, states = states, [out.where(F.col("side") == side).drop("side") for side in (QUERY, CONTEXT)]
            states[0]._stored_at = out._stored_at
            for old in before:
                discard(spark, old)
        losses.append(total / count if count else float("nan"))
        if save_dir:
            checkpoints.save_epoch(spark, save_dir, epoch, {"queries": states[0], "contexts": states[1]}, {"losses": losses, "settings": checkpoints.plain(settings, "epochs"), "sizes": list(sizes)})
    discard(spark, examples_of_rounds)
    return Trained(*states, losses)
