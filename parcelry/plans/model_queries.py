"""Queries over models: nearest examples, features, neighbours, price models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.operators import dedup, features, gram, metrics, neighbours, pricing, similarity
from parcelry.operators.model_stages import NeighbourRegressor
from parcelry.plans.bindings import LISTINGS_SQL, TIE_BREAK, documents, labelled_documents, listings
from parcelry.plans.listing_queries import FIRST_ORDER_SQL
from parcelry.plans.registry import Registry, rounded
from parcelry.plans.text_queries import _normal
from parcelry.session import cut_lineage, ensure_checkpoint_dir

registry = Registry()
query = registry.query

# ---- Nearest examples -----------------------------------------------------------------------


def _terms_sql(source: str, key: str) -> str:
    """One row per occurrence of a word or word pair."""
    return f"""words AS (SELECT {key}, regexp_extract_all({_normal('body')}, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source}
), terms AS (
  SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words)
"""


@query(
    f"""WITH bodies AS (SELECT doc_id, text AS body FROM documents), {_terms_sql('bodies', 'doc_id')}
SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM terms GROUP BY term"""
)
def tokens_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.term_totals(documents(spark, sf_dir), "text")


VOCABULARY_SQL = f"""examples AS (SELECT doc_id, text AS body, quality = 1 AS relevant FROM documents JOIN labels USING (doc_id)
), {_terms_sql('examples', 'doc_id').replace('words AS', 'example_words AS').replace('FROM words', 'FROM example_words').replace('terms AS', 'example_terms AS')},
totals AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM example_terms GROUP BY term),
vocabulary AS (
  SELECT term, total, df, ln((1.0 + (SELECT count(*) FROM examples)) / (1.0 + df)) + 1 AS idf FROM totals
  WHERE df >= 2 AND df <= 0.8 * (SELECT count(*) FROM examples) ORDER BY total DESC, term LIMIT 500)
"""


@query(f"WITH {VOCABULARY_SQL} SELECT term, total, df, round(idf, 9) AS idf FROM vocabulary")
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = labelled_documents(spark, sf_dir)
    return rounded(similarity.vocabulary(examples, "description", examples.count()), 9, "idf")


WEIGHTS_SQL = f"""{VOCABULARY_SQL}, bodies AS (SELECT doc_id, text AS body FROM documents), {_terms_sql('bodies', 'doc_id')},
raw AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM terms JOIN vocabulary USING (term) GROUP BY doc_id, term),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""


@query(f"WITH {WEIGHTS_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = similarity.TextVectors.fit(labelled_documents(spark, sf_dir), "description")
    return rounded(vectors.weights(documents(spark, sf_dir), "doc_id", "text"), 6, "weight")


SIMILARITY_SQL = f"""{WEIGHTS_SQL}, pairs AS (
  SELECT a.doc_id, b.doc_id AS example_id, sum(a.weight * b.weight) AS sim
  FROM weights a JOIN weights b ON a.term = b.term WHERE b.doc_id IN (SELECT doc_id FROM examples) GROUP BY ALL
), best AS (
  SELECT pairs.doc_id, max(sim) FILTER (relevant) AS rel, max(sim) FILTER (NOT relevant) AS irr
  FROM pairs JOIN examples ON example_id = examples.doc_id GROUP BY pairs.doc_id
), sims AS (
  SELECT doc_id, round(coalesce(rel, 0), 6) AS relevant_sim, round(coalesce(irr, 0), 6) AS irrelevant_sim
  FROM documents LEFT JOIN best USING (doc_id)
), decisions AS (
  SELECT *, CASE WHEN relevant_sim > 0.65 AND relevant_sim > irrelevant_sim THEN true
                 WHEN irrelevant_sim > 0.35 AND irrelevant_sim > relevant_sim THEN false END AS relevant FROM sims)
"""


def _similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    classifier = similarity.ExampleClassifier.fit(labelled_documents(spark, sf_dir))
    found = classifier.similarities(documents(spark, sf_dir), "doc_id", "text")
    return rounded(found, 6, "relevant_sim", "irrelevant_sim")


@query(f"WITH {SIMILARITY_SQL} SELECT doc_id, relevant_sim, irrelevant_sim FROM sims")
def example_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similarities(spark, sf_dir)


@query(
    f"""WITH {SIMILARITY_SQL} SELECT doc_id, relevant, greatest(relevant_sim, irrelevant_sim) AS confidence,
  CASE WHEN relevant THEN 'ML: Releváns (sim=' WHEN NOT relevant THEN 'ML: Irreleváns (sim=' ELSE 'ML: Bizonytalan (rel=' END AS kind
FROM decisions"""
)
def example_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = similarity.decide(_similarities(spark, sf_dir))
    return decided.select("doc_id", "relevant", "confidence", F.regexp_extract("ml_reason", "^[^=]+=", 0).alias("kind"))


@query(
    f"""WITH {SIMILARITY_SQL} SELECT count(*) AS total_predictions, count(relevant) AS confident_predictions,
       round(count(relevant) / count(*), 6) AS confidence_rate FROM decisions"""
)
def example_decision_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.decision_statistics(similarity.decide(_similarities(spark, sf_dir))), 6, "confidence_rate")


# ---- Features -------------------------------------------------------------------------------

MODEL_INPUTS = (
    "article_id",
    "price_huf",
    "area_sqm",
    "rooms",
    "floor",
    "district",
    "delivery_day",
    "building_type",
    "property_category",
    "has_terrace",
    "relevant",
)


def _model_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per key with the model inputs."""
    rows = listings(spark, sf_dir, [*MODEL_INPUTS, *TIE_BREAK[1:3]])
    return dedup.first_per_key(rows, ["article_id"], TIE_BREAK).select(*MODEL_INPUTS)


MODEL_ROWS_SQL = f"""{LISTINGS_SQL}, model_rows AS (
  SELECT * FROM listings QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY {FIRST_ORDER_SQL}) = 1
), kept AS (SELECT * FROM model_rows WHERE price_huf BETWEEN 15000000 AND 300000000 AND area_sqm > 0 AND relevant
), ready AS (
  SELECT article_id AS key, ln(price_huf) AS label, area_sqm, coalesce(floor, 0)::DOUBLE AS floor,
         coalesce(has_terrace, false)::INT::DOUBLE AS has_terrace, coalesce(rooms, (SELECT median(rooms) FROM kept)) AS rooms,
         coalesce(year(delivery_day), 2025)::DOUBLE AS y, coalesce(month(delivery_day), 1)::DOUBLE AS m,
         coalesce(quarter(delivery_day), 1)::DOUBLE AS q, coalesce((isodow(delivery_day) - 1), 0)::DOUBLE AS dow,
         district, CASE lower(trim(building_type)) WHEN 'tegla' THEN 'tegla' WHEN 'tégla' THEN 'tegla' WHEN 'panel' THEN 'panel'
           WHEN 'egyeb' THEN 'egyeb' ELSE 'unknown' END AS building, property_category AS category,
         ('0x' || substr(md5(article_id || '#42'), 1, 8))::BIGINT % 100 < 80 AS training
  FROM kept)
"""


@query(
    f"""WITH {MODEL_ROWS_SQL} SELECT key AS article_id, training, rooms, area_sqm, floor, has_terrace, y AS delivery_year,
  m AS delivery_month, q AS delivery_quarter, dow AS delivery_dayofweek, building, category, round(label, 9) AS label FROM ready"""
)
def feature_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.training_rows(_model_listings(spark, sf_dir))
    fitted = features.FeatureModel.fit(rows)
    named = dict(zip(fitted.feature_names(), fitted.expressions()))
    numeric = ["rooms", *[n.removeprefix("f_") for n in features.NUMERIC if n != "f_has_street_info"]]
    return features.prepared(rows).select(
        "article_id",
        features.is_training("article_id").alias("training"),
        *[named[n].alias(n) for n in numeric],
        F.col("c_building").alias("building"),
        F.col("c_category").alias("category"),
        F.round(F.log("price_huf"), 9).alias("label"),
    )


@query(
    f"""WITH {MODEL_ROWS_SQL}, counted AS (
  SELECT 'district' AS feature, district AS level, count(*) AS n_rows FROM ready GROUP BY district
  UNION ALL SELECT 'building', building, count(*) FROM ready GROUP BY building
  UNION ALL SELECT 'category', category, count(*) FROM ready GROUP BY category)
SELECT feature, level, n_rows FROM counted QUALIFY row_number() OVER (PARTITION BY feature ORDER BY level) > 1"""
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = features.prepared(features.training_rows(_model_listings(spark, sf_dir)))
    return features.indicator_sums(ready, {name: f"c_{name}" for name in ("district", "building", "category")})


@query(
    f"""WITH {LISTINGS_SQL}, scored AS (
  SELECT property_category, price_huf AS actual, area_sqm * avg(price_per_sqm) OVER (PARTITION BY district) AS predicted FROM listings)
SELECT property_category, round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 6) AS test_r2,
       round(avg(abs(actual - predicted)), 2) AS test_mae, round(sqrt(avg((actual - predicted) ** 2)), 2) AS test_rmse,
       round(avg(abs((actual - predicted) / actual)) * 100, 6) AS test_mape,
       round(avg(abs(ln(actual) - ln(predicted))), 9) AS test_mae_log
FROM scored GROUP BY property_category"""
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a naive model: area times the district's mean price per square metre."""
    rows = listings(spark, sf_dir, ["property_category", "price_huf", "area_sqm", "price_per_sqm", "district"])
    means = rows.groupBy("district").agg(F.avg("price_per_sqm").alias("unit_price"))
    scored = rows.join(means, "district").select(
        "property_category",
        F.log("price_huf").alias("label"),
        F.log(F.col("area_sqm") * F.col("unit_price")).alias("prediction"),
    )
    found = metrics.regression_metrics(scored, by=["property_category"])
    return rounded(rounded(rounded(found, 6, "test_r2", "test_mape"), 2, "test_mae", "test_rmse"), 9, "test_mae_log")


# ---- Neighbours -----------------------------------------------------------------------------


def _points(rows: DataFrame) -> DataFrame:
    """Position of a listing for the neighbour query: size, rooms, floor and month of the year.

    Materialised, since fitting and searching read it several times and the listings are joined from five tables.
    """
    ready = features.prepared(rows)
    position = F.array(
        F.col("f_area_sqm"),
        F.coalesce(F.col("rooms"), F.lit(0.0)),
        F.col("f_floor") * 2.0,
        F.col("f_delivery_month").cast("double"),
        F.col("f_has_terrace") * 5.0,
    )
    return cut_lineage(ready.select(F.col("article_id").alias("key"), position.alias("features"), F.log("price_huf").alias("label")))


KNN_SQL = f"""WITH {MODEL_ROWS_SQL}, points AS (
  SELECT r.key, r.label, r.training, r.area_sqm AS a, coalesce(k.rooms, 0) AS b, r.floor * 2 AS c, r.m AS d, r.has_terrace * 5 AS e
  FROM ready r JOIN kept k ON r.key = k.article_id
), places AS (SELECT DISTINCT a, b, c, d, e FROM points WHERE NOT training
), train AS (
  SELECT * FROM points WHERE training
  QUALIFY row_number() OVER (PARTITION BY a, b, c, d, e ORDER BY key) <= 10
), near AS (
  SELECT p.a, p.b, p.c, p.d, p.e,
         min({{'d2': (p.a-t.a)**2 + (p.b-t.b)**2 + (p.c-t.c)**2 + (p.d-t.d)**2 + (p.e-t.e)**2, 'key': t.key, 'y': t.label}}, 10) AS n
  FROM places p, train t GROUP BY ALL
), parts AS (
  SELECT a, b, c, d, e, unnest(n, recursive := true) FROM near
), predicted AS (
  SELECT a, b, c, d, e, CASE WHEN min(d2) = 0 THEN avg(y) FILTER (d2 = 0)
         ELSE sum(y / sqrt(d2)) FILTER (d2 > 0) / sum(1 / sqrt(d2)) FILTER (d2 > 0) END AS prediction
  FROM parts GROUP BY a, b, c, d, e)
SELECT key, round(label, 6) AS label, round(prediction, 6) AS prediction
FROM points JOIN predicted USING (a, b, c, d, e) WHERE NOT training"""


@query(KNN_SQL)
def knn_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(features.training_rows(_model_listings(spark, sf_dir)))
    train, test = pricing.split(points)
    scored = neighbours.NeighbourModel.fit(train).predict(test)
    return rounded(scored.select("key", "label", "prediction"), 6, "label", "prediction")


@query(KNN_SQL)
def knn_price_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a model that was saved and read again."""
    train, test = (
        rows.withColumn("features", array_to_vector("features"))
        for rows in pricing.split(_points(features.training_rows(_model_listings(spark, sf_dir))))
    )
    path = f"{ensure_checkpoint_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    PipelineModel([NeighbourRegressor(standardize=False).fit(train)]).save(path)
    scored = PipelineModel.load(path).transform(test)
    return rounded(scored.select("key", "label", "prediction"), 6, "label", "prediction")


# ---- Price models ---------------------------------------------------------------------------

# Smaller trees than the library defaults, so that all models fit in about a minute on few cores.
# The rows are the whole table all the same.
SMALL = pricing.Settings(
    forest_trees=10,
    forest_depth=8,
    boosted_trees=10,
    boosted_depth=5,
    stack_forest_trees=5,
    stack_forest_depth=6,
    stack_boosted_trees=5,
    stack_boosted_depth=4,
)


def _price_data(spark: SparkSession, sf_dir: str) -> pricing.PriceData:
    return pricing.PriceData.of(_model_listings(spark, sf_dir))


@query()
def price_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All compared models with their test metrics, best first."""
    comparison, _ = pricing.compare(_price_data(spark, sf_dir), SMALL)
    return comparison


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _price_data(spark, sf_dir)
    forest = pricing.fit_forest(data.train, SMALL.forest_trees, SMALL.forest_depth, SMALL.forest_min_leaf)
    return metrics.top_features(pricing.importances(spark, forest, data.features))


_RIDGE_SQL = f"""WITH {LISTINGS_SQL}, rows AS (
  SELECT article_id, district, area_sqm AS a, coalesce(floor, 0) AS b, ln(price_huf) AS y FROM listings
), sums AS (
  SELECT district, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my,
         var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab,
         covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS cy FROM rows GROUP BY district
), solved AS (
  SELECT district, n, ma, mb, my, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS wa, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM sums)
"""


@query(
    _RIDGE_SQL + "SELECT district, n AS n_rows, round(wa, 7) AS area_weight, round(wb, 6) AS floor_weight, "
    "round(my - ma * wa - mb * wb, 5) AS intercept FROM solved"
)
def district_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge of the log price on area and floor, for every district, from one pass over the listings."""
    fitted = _district_ridge(_ridge_rows(spark, sf_dir))
    return fitted.select(
        "district", "n_rows", F.round(F.col("weights")[0], 7).alias("area_weight"), F.round(F.col("weights")[1], 6).alias("floor_weight"),
        F.round("intercept", 5).alias("intercept"),
    )


@query(
    _RIDGE_SQL + "SELECT article_id, count(*) AS n_rows, round(sum(y), 4) AS label, round(sum(my + (a - ma) * wa + (b - mb) * wb), 4) AS prediction "
    "FROM rows JOIN solved USING (district) GROUP BY article_id"
)
def district_ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing scored by the ridge of its district (labels and predictions of a repeated id are added up)."""
    rows = _ridge_rows(spark, sf_dir)
    scored = gram.predict(rows, _district_ridge(rows), ["district"], "features")
    return scored.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("label"), 4).alias("label"), F.round(F.sum("prediction"), 4).alias("prediction")
    )


def _ridge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["article_id", "district", "area_sqm", "floor", "price_huf"])
    position = F.array(F.col("area_sqm").cast("double"), F.coalesce(F.col("floor"), F.lit(0)).cast("double"))
    return rows.select("article_id", "district", position.alias("features"), F.log("price_huf").alias("label"))


def _district_ridge(rows: DataFrame) -> DataFrame:
    return gram.solve_ridge(gram.gram_statistics(rows, ["district"], "features", "label"), pricing.Settings().ridge_alpha)


@query()
def price_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing scored with the ridge model of the training rows."""
    data = _price_data(spark, sf_dir)
    ridge = pricing.fit_ridge(data.train, SMALL.ridge_alpha)
    return pricing.score(_model_listings(spark, sf_dir), pricing.served(data.features, ridge))
