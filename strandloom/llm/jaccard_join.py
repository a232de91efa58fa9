"""Set-similarity join of documents on word n-grams, by R-trees over count vectors.

Documents of equal shingle sets are one class, and its least document stands for it. The others' shingles are counted, and each gets its rarest
n - ceil(0.8 n) + 1; any two similar sets share one of them. Sets that share one meet in an R-tree over their count vectors (see
count_tree); its surviving pairs are verified on whole sets.

Defined results: A-Z is lower-cased; fewer words than a shingle has are one shingle; texts that are null, empty or without words are empty sets, linked
with nothing; every row of a repeated id is a document of its own; rows with a null id are linked like others but name no component unless it has no
other id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import count_tree, near, shared
from .decontam import WordHashes
from .simhash import words_of

SIMILARITY = 0.8


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, n_shingles, component_id): components of the documents whose sets of five-word shingles have the Jaccard similarity."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    known = WordHashes()

    def sets(texts: pa.Array):
        for t in texts.cast(pa.binary()):
            words = words_of(t.as_py() or b"")
            yield near.shingle_set(words, known) if words else np.empty(0, np.uint64)

    def heads(texts: pa.Array) -> pa.Array:
        rows = [(len(s), xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63)) for s in sets(texts)]
        n, c, e = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(e, pa.int64())], names=["n", "c", "e"])

    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for s in sets(texts)], pa.binary())

    id_type = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row's own number: its id, or a hash of id and text where ids repeat or are null
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) | F.col(id_col).isNull())
    row = F.col(id_col).cast("long") if ids.isEmpty() else F.xxhash64(F.col(id_col), text)
    head = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.arrow_udf(shared.by_runs(heads), "n long, c long, e long")(text).alias("h")).select("id", "row", "h.*")
    head = shared.stored(spark, head, "heads")
    classes = shared.stored(spark, head.where("n > 0").groupBy("c", "e").agg(F.min("row").alias("d"), F.min("id").alias("least")), "classes")
    lost = shared.stored(spark, head.where("n = 0").select("row").union(head.join(classes, ["c", "e"]).where("row != d").select("row")).distinct(), "lost")
    rows = docs.select(row.alias("row"), text.alias("t"))
    base = shared.by_ids(rows, lost, "left_anti", "row").select(F.col("row").alias("d"), "t")
    rare = shared.stored(spark, near._rare(base, known, similarity), "rare")
    roots = count_tree.connected(spark, base, rare, spark.createDataFrame([], "node long, root long"), hashed, similarity)
    shared.discard(spark, rare)
    named = shared.stored(spark, classes.join(roots.withColumnRenamed("node", "d"), "d", "left").select("c", "e", "least", F.coalesce("root", "d").alias("root")), "named")
    whole = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("c", "e", "component")
    whole = shared.stored(spark, whole, "whole")
    for done in (classes, lost, roots, named):
        shared.discard(spark, done)
    out = head.join(whole, ["c", "e"], "left")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
