"""Token embeddings as a pyspark.ml estimator and model, and a training run from a Config.

The estimator takes sentences (an id and an array of tokens), counts and prunes their vocabulary, draws signal and noise examples and trains.
What a subclass may replace: ``vocabulary_of``, ``signal_examples`` and ``noise_examples``.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .operators import examples, model, sampling, vectors, vocab
from .sources import checkpoints, corpus, scratch, store


def _param(name: str, doc: str, kind):
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _EmbeddingParams(HasInputCol, HasOutputCol, HasSeed):
    sentenceCol = _param("sentenceCol", "column of the sentence's id", TypeConverters.toString)
    kernel = _param("kernel", "weights of the 2K offsets of a context", TypeConverters.toListInt)
    t = _param("t", "threshold of down-sampling", TypeConverters.toFloat)
    noiseRatio = _param("noiseRatio", "noise examples for each signal example", TypeConverters.toInt)
    minFrequency = _param("minFrequency", "tokens that are rarer become UNK", TypeConverters.toInt)
    canonical = _param("canonical", "whether a token and its reverse complement are one", TypeConverters.toBoolean)
    dims = _param("dims", "length of a vector", TypeConverters.toInt)
    epochs = _param("epochs", "passes over the examples", TypeConverters.toInt)
    batchSize = _param("batchSize", "signal examples of a minibatch", TypeConverters.toInt)
    rate = _param("rate", "learning rate", TypeConverters.toFloat)
    blocks = _param("blocks", "blocks of ids, and tasks of a round", TypeConverters.toInt)
    saveDir = _param("saveDir", "where vocabulary and epochs are saved; empty for nowhere", TypeConverters.toString)
    dictionaryDir = _param("dictionaryDir", "a saved vocabulary's folder to use instead of counting; empty for none", TypeConverters.toString)
    logPath = _param("logPath", "file of the training log; empty for none", TypeConverters.toString)

    def _defaults(self):
        base = Config()
        self._setDefault(
            inputCol="tokens", outputCol="vector", sentenceCol="sent", seed=base.seed, kernel=list(base.kernel), t=base.t, noiseRatio=base.noise_ratio, minFrequency=base.min_frequency, canonical=base.canonical, dims=base.dims,
            epochs=base.epochs, batchSize=base.batch_size, rate=base.rate, blocks=base.blocks, saveDir="", dictionaryDir="", logPath="",
        )

    def value(self, name: str):
        return self.getOrDefault(getattr(self, name))


class TokenEmbedding(Estimator, _EmbeddingParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    @classmethod
    def from_config(cls, config: Config) -> TokenEmbedding:
        return cls(
            seed=config.seed, kernel=list(config.kernel), t=config.t, noiseRatio=config.noise_ratio, minFrequency=config.min_frequency, canonical=config.canonical, dims=config.dims, epochs=config.epochs,
            batchSize=config.batch_size, rate=config.rate, blocks=config.blocks, saveDir=config.save_dir or "", dictionaryDir=config.load_dictionary_dir or "", logPath=config.log_path or "",
        )

    def tokens_of(self, dataset: DataFrame) -> DataFrame:
        """(sent, pos, length, token)."""
        column = F.col(self.getInputCol())
        return dataset.select(F.col(self.value("sentenceCol")).alias("sent"), F.size(column).alias("length"), F.posexplode(column).alias("pos", "token"))

    def vocabulary_of(self, tokens: DataFrame) -> DataFrame:
        """The pruned vocabulary with UNK: loaded, or counted and, with a folder to save to, saved unpruned."""
        least, rc = self.value("minFrequency"), self.value("canonical")
        if self.value("dictionaryDir"):
            return store.load_prepared(tokens.sparkSession, self.value("dictionaryDir"), least, rc)
        return store.prepare(tokens, self.value("saveDir") or scratch.new_path(tokens.sparkSession, "prepared"), least, rc)

    def signal_examples(self, tokens: DataFrame, words: DataFrame) -> DataFrame:
        """(sent, pos, query, context)."""
        return examples.signal(tokens, words, self.value("kernel"), self.value("t"), self.getSeed())

    def noise_examples(self, signal: DataFrame, words: DataFrame) -> DataFrame:
        """(sent, pos, draw, query, context)."""
        return examples.noise(signal, words, self.value("noiseRatio"), self.getSeed())

    def examples_of(self, tokens: DataFrame, words: DataFrame | None) -> DataFrame:
        """(ord, query, context, is_signal): each signal, numbered, with its noise."""
        words = store.require_prepared(words)
        signal = scratch.stored(tokens.sparkSession, examples.numbered(self.signal_examples(tokens, words), ["sent", "pos"]), "signal")
        noise = self.noise_examples(signal.drop("rn"), words).join(signal.select("sent", "pos", "rn"), ["sent", "pos"])
        return signal.select(F.col("rn").alias("ord"), "query", "context", F.lit(True).alias("is_signal")).union(noise.select("rn", "query", "context", F.lit(False)))

    def _fit(self, dataset: DataFrame) -> TokenEmbeddingModel:
        spark = dataset.sparkSession
        tokens = scratch.stored(spark, self.tokens_of(dataset), "tokens")
        words = scratch.stored(spark, self.vocabulary_of(tokens), "vocabulary")
        size = words.agg(F.max("id")).first()[0] + 1
        settings = model.Settings(self.value("dims"), self.value("epochs"), self.value("batchSize") * (1 + self.value("noiseRatio")), self.value("rate"), self.value("blocks"), self.getSeed())
        log = TrainingLog(spark, self.value("logPath")) if self.value("logPath") else None
        trained = model.train(self.examples_of(tokens, words), size, settings, save_dir=self.value("saveDir") or None, on_round=log)
        return self._copyValues(TokenEmbeddingModel(words, trained.queries.select("id", "x"), trained.contexts.select("id", "x"), trained.losses))


class TrainingLog:
    """Lines of the form that ``tables.read_log`` reads, in one file that is moved into place whole after every round."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.lines = (checkpoints.read_text(spark, path) or "").splitlines()

    def __call__(self, epoch: int, turn: int, loss: float) -> None:
        if turn == 0:
            self.lines.append(f"starting epoch {epoch}")
        self.lines.append(f"running macrobatch {turn}, macrobatch average loss: {loss:.6f}")
        checkpoints.write_text(self.spark, self.path, "\n".join(self.lines) + "\n")


class TokenEmbeddingModel(Model, _EmbeddingParams, MLReadable, MLWritable):
    """vocabulary is (token, canon, id, count); queries and contexts are (id, x)."""

    def __init__(self, vocabulary: DataFrame, queries: DataFrame, contexts: DataFrame, losses: list[float]):
        super().__init__()
        self._defaults()
        self.vocabulary, self.queries, self.contexts, self.losses = vocabulary, queries, contexts, losses

    def token_vectors(self) -> DataFrame:
        """(token, id, x)."""
        return self.vocabulary.select("token", "id").join(self.queries, "id")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """dataset with the mean query vector of its tokens; unknown tokens count as UNK; null where there are none."""
        spark, dims = dataset.sparkSession, self.value("dims")
        rows = scratch.stored(spark, dataset.withColumn("_row", F.monotonically_increasing_id()), "rows")
        bags = rows.select("_row", F.explode(self.getInputCol()).alias("token")).groupBy("_row", "token").agg(F.count(F.lit(1)).alias("n"))
        met = vocab.look_up(bags, self.vocabulary).groupBy("_row", "id").agg(F.sum("n").alias("n")).join(self.queries, "id")
        mean = F.array(*(F.sum(F.col("n") * F.col("x")[i]) / F.sum("n") for i in range(dims)))
        pooled = met.groupBy("_row").agg(mean.alias(self.getOutputCol()))
        return rows.join(pooled, "_row", "left").select(*dataset.columns, self.getOutputCol())

    def validation_loss(self, pairs: DataFrame) -> float | None:
        """The contrastive loss of examples (query, context, is_signal)."""
        scored = vectors.scores(pairs, self.queries.withColumnRenamed("x", "w"), self.contexts.withColumnRenamed("x", "c"))
        return vectors.contrastive_loss(scored).first().loss

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: TokenEmbeddingModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"losses": self.instance.losses})
        for name in ("vocabulary", "queries", "contexts"):
            getattr(self.instance, name).write.mode("overwrite").parquet(f"{path}/{name}")


class _ModelReader(MLReader):
    def load(self, path: str) -> TokenEmbeddingModel:
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = (self.sparkSession.read.parquet(f"{path}/{name}") for name in ("vocabulary", "queries", "contexts"))
        out = TokenEmbeddingModel(*tables, said["losses"])
        out._resetUid(said["uid"])
        DefaultParamsReader.getAndSetParams(out, said)
        return out


def run(spark: SparkSession, config: Config) -> tuple[TokenEmbeddingModel, float | None]:
    """Reads the Config's corpus, trains on its share of the sentences, and gives the model and the loss on the others.

    A run with save_dir goes on after its last committed epoch.
    """
    paths = [*config.files, *config.directories]
    if not paths:
        raise ValueError("the configuration names neither files nor directories")
    if config.save_dir and not scratch.can_write(spark, config.save_dir):
        raise OSError(f"can't write under {config.save_dir}")
    sentences = corpus.read_corpus(spark, paths, config.parser, config.k, config.stride, skip=list(config.skip))
    sentences = sentences.groupBy("file", "tokens").agg(F.count(F.lit(1)).alias("n")).select("file", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    # equal sentences of a file are told apart by a number, so ids are the same in any run
    sentences = scratch.stored(spark, sentences.select(F.xxhash64(corpus.base_name(F.col("file")), "tokens", "copy").alias("sent"), "tokens"), "sentences")
    parts = sampling.split(sentences, config.split, config.seed, F.col("sent"))
    estimator = TokenEmbedding.from_config(config)
    fitted = estimator.fit(parts.where("is_train").drop("is_train"))
    held = estimator.examples_of(estimator.tokens_of(parts.where("not is_train")), fitted.vocabulary)
    return fitted, fitted.validation_loss(held)
