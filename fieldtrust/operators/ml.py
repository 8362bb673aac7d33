"""Model features, training, prediction and evaluation with MLlib."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.functions import geo, hashing
from fieldtrust.functions import text as tx
from fieldtrust.operators.reports import confusion
from fieldtrust.params import DEFAULT, Params

SCHEMA_VERSION = "hybrid-v1"
HYBRID = ("geo", "text", "simhash", "semantic", "length", "marketing", "valid_coordinate", "high_severity", "confidence", "similar")
POI = ("spatial_density", "category_clustering", "coordinate_offset", "name_length", "address_completeness", "marketing_ratio", "upload_frequency", "platform_consistency", "authoritative_match", "text_similarity")
# fixed values: the words whose share is a model feature
MODEL_WORDS = ("第一", "最好", "最大", "最强", "顶级", "极致", "完美", "绝佳", "免费", "赠送", "优惠", "折扣", "促销", "活动", "限时")


def hybrid_features(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds ``f_*``: the ten features of a scored row."""
    t = tx.text_of(F.col("text"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 100.0
    values = [
        share("geo_score"), share("text_score"), share("simhash_score"), share("semantic_score"), F.least(F.length(t) / 500.0, F.lit(1.0)), tx.marketing_share(t, MODEL_WORDS),
        F.coalesce(geo.in_country(F.col("latitude"), F.col("longitude"), p), F.lit(False)).cast("double"), F.coalesce(F.col("forced_high"), F.lit(False)).cast("double"),
        F.least(F.coalesce(F.col("confidence"), F.lit(0.5)), F.lit(1.0)), F.least(F.coalesce(F.col("similar_records"), F.lit(0)) / 10.0, F.lit(1.0)),
    ]
    return df.withColumns({f"f_{n}": v for n, v in zip(HYBRID, values, strict=True)})


def poi_features(df: DataFrame) -> DataFrame:
    """Adds ``f_*``: the ten features of a place with its joined context; absent context is 0."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    values = [
        c("spatial_density"), c("category_share"), c("coordinate_offset") / 1000.0, F.length(tx.text_of(F.col("name"))) / 100.0, tx.address_completeness(F.col("address")),
        tx.marketing_share(F.concat_ws(" ", F.col("name"), F.col("description")), MODEL_WORDS), c("upload_frequency"), c("platform_consistency"), c("authoritative_match"), c("text_similarity"),
    ]
    return df.withColumns({f"f_{n}": v for n, v in zip(POI, values, strict=True)})


def upload_frequency(uploads: DataFrame, as_of: float, key: str = "device_id", ts: str = "timestamp") -> DataFrame:
    """(key, upload_frequency): uploads of the hour before ``as_of`` by a hundred, 1 at most; 0 with under two uploads at all."""
    g = uploads.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(ts) > as_of - 3600).alias("recent"))
    return g.select(key, F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.col("recent") / 100, F.lit(1.0))).alias("upload_frequency"))


def _assembled(names: tuple[str, ...]) -> list:
    columns = [f"f_{n}" for n in names]
    return [VectorAssembler(inputCols=columns, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``: rows by twice the class's rows, so that both classes weigh the same."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    w = n.join(F.broadcast(total)).select(label, (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))  # one row
    return df.join(F.broadcast(w), label)  # a row a class


def stratified_split(df: DataFrame, key: str, label: str = "label", test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows of each class dealt by the hash of their key: the same split on every run."""
    test = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(10_000)) < int(test_share * 10_000)
    return df.where(~test), df.where(test)


def train(df: DataFrame, kind: str = "random_forest", names: tuple[str, ...] = HYBRID, seed: int = 42) -> PipelineModel:
    """``df`` has the features and a 0/1 ``label``. Kinds: random_forest (200 trees of depth 10, balanced), gradient_boosting (100 of depth 5), mlp (256 and 128 hidden)."""
    rows = balanced(df.withColumn("label", F.col("label").cast("double")))
    if kind == "random_forest":
        model = RandomForestClassifier(numTrees=200, maxDepth=10, weightCol="weight", seed=seed)
    elif kind == "gradient_boosting":
        model = GBTClassifier(maxIter=100, maxDepth=5, seed=seed)
    elif kind == "mlp":
        model = MultilayerPerceptronClassifier(layers=[len(names), 256, 128, 2], seed=seed, maxIter=60)
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Pipeline(stages=[*_assembled(names), model]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted`` and ``probability_fake``."""
    out = model.transform(df)
    return out.withColumns({"predicted": F.col("prediction").cast("int"), "probability_fake": vector_to_array("probability")[1]}).drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, names: tuple[str, ...] = HYBRID) -> list[tuple[str, float]]:
    return list(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True))


def evaluate(df: DataFrame, truth: DataFrame, key: str = "record_id") -> DataFrame:
    """Metrics of ``df(key, predicted)`` against ``truth(key, label)``."""
    return confusion(df.select(key, "predicted").join(truth.select(key, "label"), key))


def risk_factors() -> Column:
    """What stands out among the place features."""
    over = {"marketing_ratio": 0.3, "spatial_density": 0.8, "upload_frequency": 0.5, "text_similarity": 0.9}
    under = {"address_completeness": 0.4, "platform_consistency": 0.3}
    return F.array_compact(F.array(*[F.when(F.col(f"f_{k}") > v, k) for k, v in over.items()], *[F.when(F.col(f"f_{k}") < v, k) for k, v in under.items()]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(SCHEMA_VERSION,)], "schema_version string").coalesce(1).write.mode("overwrite").json(f"{path}/contract")


def load(spark, path: str) -> PipelineModel:
    """Fails for a model of another feature contract."""
    version = spark.read.json(f"{path}/contract").first()["schema_version"]
    if version != SCHEMA_VERSION:
        raise ValueError(f"model has features {version}, not {SCHEMA_VERSION}")
    return PipelineModel.load(path)


class Registry:
    """Named models and the active one."""

    def __init__(self):
        self.models: dict[str, PipelineModel] = {}
        self.active: str | None = None

    def register(self, name: str, model: PipelineModel) -> None:
        self.models[name] = model
        self.active = self.active or name

    def set_active(self, name: str) -> None:
        if name not in self.models:
            raise KeyError(name)
        self.active = name

    def predict(self, df: DataFrame) -> DataFrame:
        if self.active is None:
            raise ValueError("no model is active")
        return predict(self.models[self.active], df)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _code_bins(texts: pa.Array) -> pa.Array:
    """Shares of a text's code points modulo 64; zeros for the empty text."""
    out = []
    for t in texts.to_pylist():
        c = np.bincount(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
        out.append(c / max(1, c.sum()))
    return pa.array(out, pa.list_(pa.float64()))


def neural_features(df: DataFrame) -> DataFrame:
    """Adds ``neural_vector`` (64 bins of code points by length, ten of place and device) for the small network."""
    t = tx.text_of(F.col("text"))
    bins = _code_bins(t)
    lat, lon = F.coalesce("latitude", F.lit(0.0)), F.coalesce("longitude", F.lit(0.0))
    place = [lat / 90, lon / 180, geo.in_country(lat, lon).cast("double"), geo.is_valid(lat, lon).cast("double"), hashing.device_bucket(F.col("device_id")), (F.col("timestamp") % 24) / 24]
    place += [F.coalesce(F.col("geo_score"), F.lit(0.0)) / 100, F.length(t) / 500.0, F.size("geo_anomalies") / 4.0, F.lit(0.0)]
    return df.withColumn("neural_vector", F.concat(bins, F.array(*[x.cast("double") for x in place])))


#: The small network: what it is fed, its hidden layers and its two classes.
NETWORK = (74, 256, 128, 2)


def _usable() -> Column:
    v = F.col("neural_vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == NETWORK[0]) & ~bad, F.lit(False))


def train_network(df: DataFrame, iterations: int = 60, seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """Fit the network on rows with ``neural_vector`` and a 0/1 ``label``; rows without a usable vector are left out. MLlib's hidden layers are sigmoid ones."""
    rows = df.where(_usable()).select(array_to_vector("neural_vector").alias("features"), F.col("label").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=list(NETWORK), seed=seed, maxIter=iterations).fit(rows)


def neural_scores(df: DataFrame, model: MultilayerPerceptronClassificationModel | None) -> DataFrame:
    """Adds ``neural_score``, the network's chance of a fake in percent; null without a network and for rows without a usable vector, which so weigh nothing in the total."""
    if model is None:
        return df.withColumn("neural_score", F.lit(None).cast("double"))
    ok = _usable()
    # rows that cannot be scored go through with zeros and lose their score afterwards
    v = F.when(ok, F.col("neural_vector")).otherwise(F.array_repeat(F.lit(0.0), NETWORK[0]))
    out = model.transform(df.withColumns({"_ok": ok, "_v": v}).withColumn(model.getFeaturesCol(), array_to_vector("_v")))
    return out.withColumn("neural_score", F.when(F.col("_ok"), vector_to_array(model.getProbabilityCol())[1] * 100)).select(*[c for c in df.columns if c != "neural_score"], "neural_score")


def save_network(model: MultilayerPerceptronClassificationModel | None, path: str) -> None:
    """The network and what it is for; None leaves a note that there is no trained one."""
    from pyspark.sql import SparkSession

    if model is not None:
        model.write().overwrite().save(f"{path}/model")
    note = SparkSession.active().createDataFrame([(model is not None, list(NETWORK))], "is_trained boolean, layers array<int>")
    note.coalesce(1).write.mode("overwrite").json(f"{path}/contract")


def load_network(spark, path: str) -> MultilayerPerceptronClassificationModel | None:
    """The network saved under ``path``; None where none was trained. One of other layers is refused."""
    note = spark.read.schema("is_trained boolean, layers array<int>").json(f"{path}/contract").first()
    if note is None or not note.is_trained:
        return None
    if list(note.layers) != list(NETWORK):
        raise ValueError(f"network has layers {list(note.layers)}, not {list(NETWORK)}")
    return MultilayerPerceptronClassificationModel.load(f"{path}/model")


def neural_fallback(df: DataFrame) -> DataFrame:
    """Where no network is: three tenths place, seven tenths text; fake from 35, risk at 70 and 40."""
    s = F.col("geo_score") * 0.3 + F.col("text_score") * 0.7
    return df.withColumns({"neural_fallback": s, "neural_fake": s >= 35, "neural_risk": F.when(s >= 70, "high").when(s >= 40, "medium").otherwise("low")})
