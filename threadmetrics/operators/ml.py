"""Machine learning as data jobs with ``pyspark.ml`` (M1-M8, M10, M12, M13,
W6, X8).

Fitting is distributed (covariance by tree aggregation, online LDA on
mini-batches, boosted trees on binned features); only model parameters
(a d x k matrix, coefficients) reach the driver.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, CountVectorizer, CountVectorizerModel, NGram, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import NUM_TOPICS
from ..session import ensure_checkpoint_dir


# ------------------------------------------------------------------ PCA
class PcaResult:
    """Fitted centred PCA with the sign fixed (largest |loading| positive)."""

    def __init__(self, model: PipelineModel, cols: list[str], k: int):
        self.model = model
        self.cols = cols
        self.k = k
        pca = model.stages[-1]
        m = pca.pc.toArray()  # d x k
        self.signs = []
        for j in range(k):
            col = m[:, j]
            big = max(range(len(col)), key=lambda i: abs(col[i]))
            self.signs.append(-1.0 if col[big] < 0 else 1.0)
        self.components = [[float(m[i, j]) * self.signs[j] for i in range(len(cols))] for j in range(k)]
        self.ratios = [float(x) for x in pca.explainedVariance.toArray()]

    def ratio_table(self, spark) -> DataFrame:
        """M3: explained-variance ratio per component."""
        return spark.createDataFrame([(j, r) for j, r in enumerate(self.ratios)],
                                     "component int, explained_variance_ratio double")

    def transform(self, df: DataFrame, key: str, prefix: str = "PC") -> DataFrame:
        """M5: scores ``PC0..PC{k-1}`` keyed by ``key`` (no positional glue)."""
        out = self.model.transform(df).select(key, vector_to_array("_pc").alias("_a"))
        return out.select(key, *[(F.col("_a")[j] * self.signs[j]).alias(f"{prefix}{j}") for j in range(self.k)])

    def loadings(self, scores: DataFrame, prefix: str = "PC") -> DataFrame:
        """M4: component x sqrt(explained variance); the variance is the
        sample variance of the component's scores."""
        sd = scores.agg(*[F.stddev_samp(f"{prefix}{j}").alias(str(j)) for j in range(self.k)]).first()
        rows = [(j, self.cols[i], self.components[j][i] * float(sd[str(j)]))
                for j in range(self.k) for i in range(len(self.cols))]
        return scores.sparkSession.createDataFrame(rows, "component int, feature string, loading double")


def fit_pca(df: DataFrame, cols: list[str], k: int) -> PcaResult:
    """M3/M6: centre (``StandardScaler(withMean, not withStd)``: Spark's
    PCA does not centre) and fit PCA with ``k`` components. A null among
    ``cols`` is an error, never a dropped row."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="error"),
        StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_xc"),
        PCA(k=k, inputCol="_xc", outputCol="_pc"),
    ])
    return PcaResult(pipe.fit(df), cols, k)


def top_components(ratios: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` components with the largest explained variance."""
    return ratios.orderBy(F.col("explained_variance_ratio").desc(), "component").limit(n)


# ------------------------------------------------------------------ topics
def fit_topics(docs: DataFrame, tokens_col: str, k: int = NUM_TOPICS, seed: int = 42,
               max_iter: int = 20, vocab_size: int = 1 << 30) -> PipelineModel:
    """M1: bag of words + LDA (online variational Bayes, each batch as large
    as the corpus). Spark draws a batch with replacement, so a document is in
    none of ``max_iter`` batches with probability ``exp(-max_iter)``, 2e-9.
    ``vocab_size`` is the size of the vocabulary that ``docs`` are filtered to;
    the default leaves no word out."""
    pipe = Pipeline(stages=[
        CountVectorizer(inputCol=tokens_col, outputCol="_bow", vocabSize=vocab_size),
        LDA(k=k, seed=seed, maxIter=max_iter, subsamplingRate=1.0, featuresCol="_bow", topicDistributionCol="_topics"),
    ])
    return pipe.fit(docs)


def topic_columns(model: PipelineModel, docs: DataFrame, key: str, prefix: str, keep: int | None = None) -> DataFrame:
    """M2: one column per topic (``{prefix}_topic{i}``); ``keep`` drops the
    last topics (they sum to 1, the reference uses 19 of 20)."""
    k = model.stages[-1].getK()
    keep = k if keep is None else keep
    a = model.transform(docs).select(key, vector_to_array("_topics").alias("_t"))
    return a.select(key, *[F.col("_t")[i].alias(f"{prefix}_topic{i}") for i in range(keep)])


# ------------------------------------------------------------------ regression / classification
def fit_gbt(df: DataFrame, features: list[str], label: str, valid_col: str, max_iter: int = 50,
            step: float = 0.1, depth: int = 4, subsample: float = 0.8, col_share: str = "0.8",
            seed: int = 42) -> PipelineModel:
    """M7: gradient-boosted regression trees with a validation indicator
    (early stop by ``validationTol``). Spark's GBT has no l1/l2 terms."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep"),
        GBTRegressor(featuresCol="_f", labelCol=label, predictionCol="prediction", maxIter=max_iter,
                     stepSize=step, maxDepth=depth, subsamplingRate=subsample,
                     featureSubsetStrategy=col_share, validationIndicatorCol=valid_col, seed=seed),
    ])
    return pipe.fit(df)


def fit_linear(df: DataFrame, features: list[str], label: str) -> PipelineModel:
    """M8: ordinary least squares (normal equations, no regularisation)."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_f"),
        LinearRegression(featuresCol="_f", labelCol=label, predictionCol="prediction", solver="normal"),
    ])
    return pipe.fit(df)


def score_with_coefficients(df: DataFrame, coef_row: dict[str, float], intercept: float = 0.0,
                            out: str = "score"):
    """M8 (loaded model): ``intercept + sum(x_c * w_c)`` over the table's
    numeric columns aligned by name; a column without a coefficient counts 0."""
    terms = [F.col(c) * F.lit(float(coef_row.get(c, 0.0))) for c in df.columns if c in coef_row]
    expr = F.lit(float(intercept))
    for t in terms:
        expr = expr + t
    return df.withColumn(out, expr)


def fit_pair_classifier(pairs: DataFrame, features: list[str], label: str) -> PipelineModel:
    """Two-class classifier on the left and right features of a pair."""
    cols = [f"{c}_l" for c in features] + [f"{c}_r" for c in features]
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="_f", handleInvalid="keep"),
        LogisticRegression(featuresCol="_f", labelCol=label, maxIter=50, regParam=0.0),
    ])
    return pipe.fit(pairs)


# ------------------------------------------------------------------ persistence
def save_with_params(model: PipelineModel, spark, params: dict, seed: int, path: str | None = None) -> tuple[str, DataFrame]:
    """Write the fitted pipeline and its parameters and seed together at
    ``path`` (scratch below the checkpoint folder if none is given); returns
    (path, metadata row)."""
    path = path or os.path.join(ensure_checkpoint_dir(spark), f"tm-model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    meta = spark.createDataFrame([(path, seed, ";".join(f"{k}={v}" for k, v in sorted(params.items())))],
                                 "path string, seed int, params string")
    meta.write.mode("overwrite").parquet(path + "-params")
    return path, spark.read.parquet(path + "-params")


def read_coefficients(spark, path: str) -> dict[str, float]:
    """One row of coefficients by feature name (CSV with a header)."""
    row = spark.read.csv(path, header=True, inferSchema=False).first()      # one row by format
    return {c: float(v) for c, v in row.asDict().items() if v not in (None, "")}


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ------------------------------------------------------------------ n-grams
def top_terms(docs: DataFrame, terms_col: str, n: int) -> list[str]:
    """The ``n`` most frequent terms of the corpus, ties by term."""
    counts = docs.select(F.explode(terms_col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    return [r["term"] for r in counts.orderBy(F.desc("c"), "term").limit(n).collect()]


def ngram_vectors(tokens: DataFrame, tokens_col: str, vocab_size: int = 1000) -> DataFrame:
    """Counts of the 1,000 most frequent unigrams and bigrams per document
    as two sparse vectors (never 2,000 physical columns)."""
    docs = NGram(n=2, inputCol=tokens_col, outputCol="_bi").transform(tokens)
    for source, name in ((tokens_col, "unigrams"), ("_bi", "bigrams")):
        terms = top_terms(docs, source, vocab_size) or [""]
        docs = CountVectorizerModel.from_vocabulary(terms, inputCol=source, outputCol=name).transform(docs)
    return docs.drop("_bi")
