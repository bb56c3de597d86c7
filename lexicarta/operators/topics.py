"""Topic model and its reports."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, DistributedLDAModel, LDAModel, LocalLDAModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, VectorUDT
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.operators.features import MAX_MODEL_TERMS, TOP, top_per_group
from lexicarta.operators.ids import ranked_in_groups
from lexicarta.operators.maximisation import entries_of, maximised, numbered_start
from lexicarta.session import job_scratch, materialize, scratch_path

# Fixed values of the topic report.
TOPICS = 7
TOP_DOCUMENTS = 20

LIST_IDS = 100_000


def fit_topics(
    vectors: DataFrame,
    k: int = TOPICS,
    max_iter: int = 20,
    seed: int = 17,
    optimizer: str = "em",
    partitions: int | None = None,
) -> LDAModel:
    """Fit ``k`` topics on ``(doc_id, features)``.

    A fit repeats only on the same partitions in the same order, hence the
    placing by document id. The number is fixed, since the start of the fit depends on
    it and merged partitions would leave cores idle.
    """
    if optimizer == "em":
        return training_fit(vectors, k, max_iter, seed, partitions).model
    placed = _placed(vectors, partitions or _fit_partitions(vectors)).persist(StorageLevel.MEMORY_AND_DISK)
    model = _estimator(k, max_iter, seed, optimizer).fit(placed)
    placed.unpersist()
    return model


def _fit_partitions(vectors: DataFrame) -> int:
    return max(vectors.sparkSession.sparkContext.defaultParallelism, vectors.rdd.getNumPartitions())


def _placed(vectors: DataFrame, partitions: int) -> DataFrame:
    scratch_path(vectors.sparkSession, "topics")  # makes sure a checkpoint folder is known
    return vectors.repartition(partitions, "doc_id").sortWithinPartitions("doc_id")


def _estimator(k: int, max_iter: int, seed: int, optimizer: str = "em") -> LDA:
    return LDA(
        k=k, maxIter=max_iter, seed=seed, optimizer=optimizer, checkpointInterval=10, featuresCol="features"
    )


class SavedFit(DistributedLDAModel):
    """The fit saved in ``path``; its terms by topics are read from the saved table of vertices.

    The model that ``pyspark.ml`` loads looks for them in its graph, and for that lays out all entries in the memory of the
    executors. Here only what is of the entries makes it, and does not keep it: the likelihood of the training set and its prior.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark._jvm.org.apache.spark.ml.clustering.DistributedLDAModel.load(path))
        self._transfer_params_from_java()
        self._java_obj.getModel().graph().unpersist(False)  # else it stays marked to be kept in memory
        saved = spark.read.parquet(f"{path}/oldModel/data/topicCounts")
        self.vertices = saved.select("id", vector_to_array("topicWeights").alias("weights"))
        self._terms = self._local = None

    def _term_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the terms that have a vertex, and their weights, terms by topics; read once."""
        if self._terms is None:
            found = self.vertices.where("id < 0").toPandas().sort_values("id", ascending=False)
            weights = np.array(found["weights"].to_list()).reshape(len(found), self.estimatedDocConcentration().size)
            self._terms = -1 - found["id"].to_numpy(), weights
        return self._terms

    def topicsMatrix(self) -> DenseMatrix:
        ids, weights = self._term_weights()
        matrix = np.zeros((weights.shape[1], self.vocabSize()))
        matrix[:, ids] = weights.T
        return DenseMatrix(matrix.shape[1], matrix.shape[0], matrix.ravel())

    def toLocal(self) -> LocalLDAModel:
        if self._local is None:  # what the loaded model would make of its graph
            spark, own = self.vertices.sparkSession, self._java_obj.getModel()
            packages = spark._jvm.org.apache.spark
            matrix = packages.mllib.linalg.Matrices.fromML(_py2java(spark.sparkContext, self.topicsMatrix()))
            parts = matrix, own.docConcentration(), own.topicConcentration(), own.gammaShape()
            old = packages.mllib.clustering.LocalLDAModel(*parts)
            made = packages.ml.clustering.LocalLDAModel(self.uid, self.vocabSize(), old, spark._jsparkSession)
            self._local = LocalLDAModel(made)
        return self._copyValues(self._local)

    def describeTopics(self, maxTermsPerTopic: int = 10) -> DataFrame:
        """``(topic, termIndices, termWeights)``, ties by term id."""
        ids, weights = self._term_weights()
        shares = (weights / weights.sum(axis=0)).T
        best = [np.argsort(-share, kind="stable")[:maxTermsPerTopic] for share in shares]
        columns = {
            "topic": np.arange(len(shares), dtype=np.int32),
            "termIndices": [ids[order].astype(np.int32) for order in best],
            "termWeights": [share[order] for share, order in zip(shares, best)],
        }
        schema = "topic int NOT NULL, termIndices array<int>, termWeights array<double>"
        return self.vertices.sparkSession.createDataFrame(pa.table(columns), schema)

    def logLikelihood(self, dataset: DataFrame) -> float:
        return self.toLocal().logLikelihood(dataset)

    def logPerplexity(self, dataset: DataFrame) -> float:
        return self.toLocal().logPerplexity(dataset)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.toLocal().transform(dataset)


@dataclass(frozen=True)
class TopicFit:
    """A fit by expectation maximisation, and what it ends with.

    ``vertices(id, weights)`` are those of its graph, written when the fit was saved: a document
    is its number, a term ``-1 - term_id``; the weights, one per topic, are how the
    occurrences are shared among the topics. ``numbers(doc_id, id)`` are the documents' numbers.
    """

    model: LDAModel
    vertices: DataFrame
    numbers: DataFrame


def training_fit(
    vectors: DataFrame,
    k: int = TOPICS,
    max_iter: int = 20,
    seed: int = 17,
    partitions: int | None = None,
    max_model_terms: int = MAX_MODEL_TERMS,
) -> TopicFit:
    """Fit ``k`` topics on ``(doc_id, features)`` and keep the graph the fit ends with.

    Vectors of more than ``max_model_terms`` terms are fitted by the estimator on its graph, with the same results
    from the same partitions.
    """
    spark = vectors.sparkSession
    partitions = partitions or _fit_partitions(vectors)
    first = vectors.select("features").head()
    if first is None:
        raise ValueError("no documents to fit topics on")
    size = first["features"].size
    path = scratch_path(spark, "topic-fit")
    if size > max_model_terms:
        numbers = _graph_fit(vectors, k, max_iter, seed, partitions, path)
    else:
        numbers = _row_fit(vectors, size, k, max_iter, seed, partitions, path)
    model = SavedFit(spark, path)
    model.set(model.maxIter, max_iter)  # the saved frame has none
    return TopicFit(model, model.vertices, numbers)


def _graph_fit(vectors, k, max_iter, seed, partitions, path) -> DataFrame:
    """Saves a fit by the estimator, which numbers its documents by ``monotonically_increasing_id``.

    Its input is therefore written, placed by document id, and read twice in the same splits: for the numbers and for the fit.
    """
    placed = materialize(_placed(vectors, partitions), "fit-input")
    numbers = materialize(
        placed.select("doc_id", F.monotonically_increasing_id().alias("id")), "fit-numbers"
    )
    _estimator(k, max_iter, seed).fit(placed).write().save(path)
    return numbers


def _row_fit(vectors, size, k, max_iter, seed, partitions, path) -> DataFrame:
    """Saves a fit of entries kept in the rows of their documents, in the form of the estimator's model.

    The model is that of a fit on one document without iterations, its tables replaced.
    """
    spark = vectors.sparkSession
    _estimator(k, 0, seed).fit(materialize(vectors.select("features").limit(1), "fit-first")).write().save(path)
    parts = T.StructType([vectors.schema["doc_id"], T.StructField("features", VectorUDT().sqlType())])
    documents = materialize(vectors.select("doc_id", "features"), "fit-vectors", parts)
    start = numbered_start(documents.select("doc_id", *entries_of("features")), size, k, seed, partitions)
    edges = start.where("id >= 0").select("id", F.inline(F.arrays_zip("terms", "amounts")))
    with job_scratch(spark, "fit-steps"):
        vertices, totals = maximised(start, size, k, max_iter, partitions)
        weights = vertices.select("id", array_to_vector("weights").alias("topicWeights"))
        tables = {
            "topicCounts": MLUtils.convertVectorColumnsFromML(weights, "topicWeights"),
            "tokenCounts": edges.select(
                F.col("id").alias("srcId"),
                (-1 - F.col("terms")).cast("bigint").alias("dstId"),
                F.col("amounts").alias("tokenCounts"),
            ),
            "globalTopicTotals": spark.createDataFrame([(Vectors.dense(totals),)], ["globalTopicTotals"]),
        }
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/oldModel/data/{name}")
    return start.where("id >= 0").select("doc_id", "id")


def training_weights(fit: TopicFit) -> DataFrame:
    """``(doc_id, weights array<double>)``: a document's occurrences by topic; none for documents without weights."""
    documents = fit.vertices.where("id >= 0")
    return fit.numbers.join(documents, "id").select("doc_id", "weights")


def training_mixtures(fit: TopicFit) -> DataFrame:
    """``(doc_id, mixture array<double>)`` as the fit ends, for the documents with weights (M2).

    Unlike :func:`document_topics`, nothing is inferred anew.
    """
    total = F.aggregate("weights", F.lit(0.0), lambda sum_, w: sum_ + w)
    return (
        training_weights(fit)
        .withColumn("total", total)
        .where("total > 0")
        .select("doc_id", F.transform("weights", lambda w: w / F.col("total")).alias("mixture"))
    )


def training_term_weights(fit: TopicFit) -> DataFrame:
    """``(topic, term_id, weight)``: the share of a term in a topic, one row per term vertex and topic (M3)."""
    shares = fit.vertices.where("id < 0").select(
        (-F.col("id") - 1).cast("int").alias("term_id"), F.posexplode("weights").alias("topic", "part")
    )
    totals = shares.groupBy(F.col("topic").alias("of_topic")).agg(F.sum("part").alias("total"))
    return shares.join(totals, F.col("topic") == F.col("of_topic")).select(
        "topic", "term_id", (F.col("part") / F.col("total")).alias("weight")
    )


def document_topics(model: LDAModel, vectors: DataFrame) -> DataFrame:
    """``(doc_id, mixture array<double>)``, inferred from the fitted topics."""
    return model.transform(vectors).select(
        "doc_id", vector_to_array("topicDistribution").alias("mixture")
    )


def topic_weights(mixtures: DataFrame) -> DataFrame:
    """Long form ``(doc_id, topic, weight)``."""
    return mixtures.select("doc_id", F.posexplode("mixture").alias("topic", "weight"))


def dominant_topic(mixture: Column, unassigned_as_first: bool = False) -> Column:
    """Index of the first largest weight.

    A document without weight in any topic has none; the compatible form puts
    it, and any mixture without a positive weight, into topic 0.
    """
    largest = F.array_max(mixture)
    nothing = F.lit(0) if unassigned_as_first else F.lit(None)
    return F.when(largest > 0, F.array_position(mixture, largest) - 1).otherwise(nothing).cast("int")


def documents_by_topic(assigned: DataFrame, list_ids: int = LIST_IDS) -> DataFrame:
    """``(topic, part, n_docs, doc_ids)``: ascending ids of each topic.

    One topic may hold most of the corpus, so its list comes in parts of
    ``list_ids`` consecutive ids, which follow each other by ``part``.
    """
    return (
        assigned.where(F.col("topic").isNotNull())
        .groupBy("topic", F.expr(f"doc_id div {list_ids}").alias("part"))
        .agg(F.count("*").alias("n_docs"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    )


def topic_top_documents(weights: DataFrame, n: int = TOP_DOCUMENTS) -> DataFrame:
    """``(topic, rank, doc_id, weight)``: the documents with most weight in a topic."""
    return top_per_group(weights, "topic", "weight", "doc_id", n).select(
        "topic", "rank", "doc_id", "weight"
    )


def topic_terms(model: LDAModel, dictionary: DataFrame) -> DataFrame:
    """``(topic, rank, term_id, term, weight)`` of every term with weight in a topic."""
    pairs = F.posexplode(F.arrays_zip("termIndices", "termWeights"))
    return (
        model.describeTopics(model.vocabSize())
        .select("topic", pairs.alias("at", "pair"))
        .select(
            "topic",
            (F.col("at") + 1).alias("rank"),
            F.col("pair.termIndices").alias("term_id"),
            F.col("pair.termWeights").alias("weight"),
        )
        .join(dictionary.select("term_id", "term"), "term_id")
        .select("topic", "rank", "term_id", "term", "weight")
    )


def ranked_terms(weights: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same of given ``(topic, term_id, weight)``; ties by term id.

    Ranks come from one order over all topics, so that a topic's terms, which are the whole
    dictionary, are neither in one task nor on the driver.
    """
    named = weights.join(dictionary.select("term_id", "term"), "term_id").withColumn(
        "_order", -F.col("weight")
    )
    return ranked_in_groups(named, "topic", ["_order", "term_id"]).select(
        "topic", F.col("rank").cast("int").alias("rank"), "term_id", "term", "weight"
    )


def topic_top_terms(terms: DataFrame, n: int = TOP) -> DataFrame:
    """``(topic, rank, term_id, term, weight)``: the words with most weight in a topic."""
    return top_per_group(terms.drop("rank"), "topic", "weight", "term", n)


def with_weightless_terms(terms: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """Topic terms over the whole dictionary: words the model has no weight for weigh nothing.

    The compatible form for ranking, which fills short topics up with them.
    """
    every = dictionary.select(
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("topic"), "term_id", "term"
    )
    known = terms.select("topic", "term_id", "weight")
    return every.join(known, ["topic", "term_id"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )
