"""Registered queries: feature preparation, models, evaluation, clustering."""

from __future__ import annotations

import os
import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions.columns import hhmm_to_minutes, row_mean, scale
from wayfarer.operators import clusters, evaluation, features, folds, models, neighbours, splits
from wayfarer.plans import study
from wayfarer.plans.binding import oracle, star, table, view
from wayfarer.plans.star import Dimension, Star
from wayfarer.session import spread, stage, staging_dir
from wayfarer.sources import writers

KEY, TARGET = "Service_Key", "Overall_Satisfaction"
NUMERIC = ["Age"]
#: every attribute of a rated trip and its passenger but keys and the targets
TEXT = [
    *vocab.RATING_COLUMNS, "Complaint_Submitted", "Complaint_Type", "Gender", "Travel_Purpose", "Nationality", "Seat_Type",
    "Preferred_Airline", "Special_Assistance", "Frequent_Route",
]
FOREST = {"numTrees": 100, "maxDepth": 30}
CODED = vocab.RATING_COLUMNS


def _experience(spark, sf_dir):
    """One row per rated trip, with the passenger's attributes."""
    rows = Star(view(spark, sf_dir, "service"), {"passenger": Dimension(view(spark, sf_dir, "passenger"), "Passenger_Key")})
    return rows.flat([KEY, TARGET, "Recommendation", *NUMERIC, *TEXT])


_FITTED: dict = {}


def _once(what, spark, sf_dir, make):
    """What several queries of one application share is made by the first of them."""
    key = (what, spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _study(spark, sf_dir):
    return _once("study", spark, sf_dir, lambda: study.prepare(_experience(spark, sf_dir), KEY, TARGET, NUMERIC, TEXT))


def _forest(spark, sf_dir):
    """The forest of the study, for its report, its importances and the bake-off."""
    s = _study(spark, sf_dir)
    return _once("forest", spark, sf_dir, lambda: models.make_model("random_forest", FOREST, **models.context(s.train, s.key)).fit(s.train))


def _report(name, params=None):
    return lambda spark, sf_dir: study.report(_study(spark, sf_dir), name, params)


def random_forest(spark, sf_dir):
    return evaluation.classification_report(_forest(spark, sf_dir).transform(_study(spark, sf_dir).test))


def _coded(spark, sf_dir):
    rows = view(spark, sf_dir, "service")
    return rows.select(KEY, TARGET, *[scale(c, vocab.SCALES["rating_prepared"]).alias(c) for c in CODED])


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _vectors(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


def standardize(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(3.0).alias("constant"))
    out = features.standardize(rows, ["o_totalprice", "constant"])
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), "constant")


def feature_pipeline(spark, sf_dir):
    rows = _experience(spark, sf_dir)
    model = features.fit_feature_pipeline(rows, NUMERIC, TEXT)
    return features.encode(model, rows).select(KEY, vector_to_array("features").alias("features"))


def variance_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(1.0))
    out = features.variance_table(rows, ["l_quantity", "l_linenumber", "l_tax", "constant"])
    return out.withColumn("variance", F.round("variance", 6))


def anova_top_k(spark, sf_dir):
    out = features.anova_top_k(_coded(spark, sf_dir), CODED, TARGET, 4)
    return out.withColumn("f_score", F.round("f_score", 4))


def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", 0.75)


def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", 5)


def smote(spark, sf_dir):
    out = splits.smote(_embeddings(spark, sf_dir), "vec_id", "label", "embedding")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("synthetic"))


def pca(spark, sf_dir):
    scores, ratios, _ = features.pca(_embeddings(spark, sf_dir), "embedding", 2)
    return scores.select(
        "vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"), F.lit(ratios[0]).alias("share1"), F.lit(ratios[1]).alias("share2")
    )


def gaussian_nb(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return models.GaussianBayes(1e-9).fit(rows).transform(rows).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


def knn_classify(spark, sf_dir):
    """Three vote rules on one split of all vectors."""
    rows = splits.stratified_split(_embeddings(spark, sf_dir), ["vec_id"], "label", 0.8)
    test, train = rows.where(~F.col("is_train")), rows.where("is_train")
    near = neighbours.nearest_neighbours(test, train, "vec_id", "vec_id", "embedding", 5, carry=["label"])
    city = neighbours.nearest_neighbours(test, train, "vec_id", "vec_id", "embedding", 5, "manhattan", carry=["label"])
    out = None
    for name, found, k, weights in (("five", near, 5, "uniform"), ("three_weighted", near, 3, "distance"), ("manhattan", city, 5, "uniform")):
        votes = neighbours.vote(found, "vec_id", "label", k, weights).withColumnRenamed("prediction", name)
        out = votes if out is None else out.join(votes, "vec_id")
    return out


KEEP = 15  #: features that every fold of a search selects on its training rows


def grid_search(spark, sf_dir):
    """The grids of all four models over three folds, selection inside the folds."""
    s = _study(spark, sf_dir)
    rows = stage(spread(splits.stratified_folds(s.train, [KEY], "label", 3), KEY), "folds")
    out = None
    for name, settings in vocab.ENCODED_GRIDS.items():
        found = folds.search(rows, name, settings, "fold", 3, KEY, KEEP)[0].select(F.lit(name).alias("model"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def _vector_folds(spark, sf_dir):
    return stage(splits.stratified_folds(_vectors(spark, sf_dir), ["vec_id"], "label", 3), "vector-folds")


def grid_bayes(spark, sf_dir):
    """All Bayes settings over three folds of the vectors, 15 dimensions selected inside each."""
    found, _ = folds.search(_vector_folds(spark, sf_dir), "gaussian_nb", vocab.ENCODED_GRIDS["gaussian_nb"], "fold", 3, "vec_id", KEEP)
    return found.select("setting", "right", "rows", F.round("accuracy", 6).alias("accuracy"))


def grid_neighbours(spark, sf_dir):
    """All neighbour settings over three folds of the vectors, from one search a fold."""
    found, _ = folds.search(_vector_folds(spark, sf_dir), "knn", vocab.ENCODED_GRIDS["knn"], "fold", 3, "vec_id")
    return found.select("setting", "right", "rows", F.round("accuracy", 6).alias("accuracy"))


def _tuning(name):
    """One of the five-fold tuning grids on the study's training rows."""

    def run(spark, sf_dir):
        s = _study(spark, sf_dir)
        rows = stage(spread(splits.stratified_folds(s.train, [KEY], "label", 5), KEY), "folds")
        return folds.search(rows, name, vocab.TUNING_GRIDS[name], "fold", 5, KEY)[0]

    return run


def feature_scores(spark, sf_dir):
    """F score and variance of every dimension, as the selection stage uses them."""
    found = folds.f_table(_vectors(spark, sf_dir), [str(i) for i in range(64)])
    return found.select("feature", F.round("variance", 9).alias("variance"), F.round("f_score", 4).alias("f_score"))


def selection_pipeline(spark, sf_dir):
    """Encode, select, classify: importances of the tree named through the selection."""
    s = _study(spark, sf_dir)
    model = folds.selecting("decision_tree", {"maxDepth": 10}, KEEP, **models.context(s.train, KEY)).fit(s.train)
    names = [s.names[i] for i in model.stages[0].getIndices()]
    return models.feature_importance(model, names, spark)


def smote_training(spark, sf_dir):
    """Training rows oversampled, a tree fitted on them, the report on the untouched test rows."""
    found, made = study.oversampled_report(_study(spark, sf_dir), "decision_tree", {"maxDepth": 10})
    sizes = made.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("synthetic"))
    return found.join(F.broadcast(sizes.select(F.format_string("%.1f", "label").alias("name"), F.col("n").alias("train_rows"), "synthetic")), "name", "left")  # a row per class


def bayes_areas(spark, sf_dir):
    """One-against-rest areas of the Bayes model of the vectors, from its probabilities."""
    rows = _vectors(spark, sf_dir)
    scores = models.class_scores(models.GaussianBayes(1e-9).fit(rows), rows, "vec_id").withColumn("score", F.round("score", 9))
    found = evaluation.areas(evaluation.curves(scores, ["class"]), ["class"])
    return found.select(F.col("class").cast("int").alias("class"), F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"), "points")


def model_curves(spark, sf_dir):
    """ROC and PR areas of the study's models on its test rows, every class against the rest, from one running sum."""
    s = _study(spark, sf_dir)
    known = models.context(s.train, KEY)
    fitted = {name: models.make_model(name, params, **known).fit(s.train) for name, params in (
        ("gaussian_nb", {}), ("decision_tree", {}), ("logistic_regression", {}), ("knn", {"k": 5}))} | {"random_forest": _forest(spark, sf_dir)}
    out = None
    for name, model in fitted.items():
        scores = models.class_scores(model, s.test, KEY).select(F.lit(name).alias("model"), "class", "label", "score")
        out = scores if out is None else out.unionByName(scores)
    return evaluation.areas(evaluation.curves(stage(out, "scores")))


def model_bakeoff(spark, sf_dir):
    s = _study(spark, sf_dir)
    board, _ = models.bake_off(s.train, s.test, {
        "logistic_regression": {}, "decision_tree": {}, "linear_svm": {}, "gaussian_nb": {}, "mlp": {}, "knn": {"k": 5},
    }, KEY)
    forest = evaluation.accuracy(_forest(spark, sf_dir).transform(s.test))
    return board.unionByName(spark.createDataFrame([("random_forest", forest)], "model string, accuracy double")).orderBy(F.desc("accuracy"), "model")


def multi_output(spark, sf_dir):
    return study.multi_output(_experience(spark, sf_dir), KEY, [TARGET, "Recommendation"], NUMERIC, TEXT, params=FOREST)


def feature_importance(spark, sf_dir):
    return models.feature_importance(_forest(spark, sf_dir), _study(spark, sf_dir).names, spark, 10)


def fold_scores(spark, sf_dir):
    return study.time_validation(_experience(spark, sf_dir), KEY, TARGET, NUMERIC, TEXT, 5, params=FOREST)


def _predicted(spark, sf_dir):
    """A rule of thumb as prediction: what the seat rating suggests."""
    guess = F.when(F.col("Seat_Comfort") == "Excellent", "Happy").when(F.col("Seat_Comfort").isin("Good", "Fair"), "Satisfied").otherwise("Dissatisfied")
    return view(spark, sf_dir, "service").select(KEY, F.col(TARGET).alias("label"), guess.alias("prediction"))


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def roc_curve(spark, sf_dir):
    out = evaluation.roc_curve(_scored(spark, sf_dir), "o_orderstatus", "o_totalprice", "F")
    return out.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def pr_curve(spark, sf_dir):
    out = evaluation.pr_curve(_scored(spark, sf_dir), "o_orderstatus", "o_totalprice", "F")
    return out.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_scored(spark, sf_dir), "o_orderstatus", "o_totalprice", "F").select(F.round("auc", 6).alias("auc"))


def kmeans_fixed(spark, sf_dir):
    """Four clusters of flights by service score, total delay, age, distance and WiFi, over complete rows."""
    s = star(spark, sf_dir)
    rows = s.flat(["Departure_Delay", "Arrival_Delay", "Age", "Flight_Distance", *vocab.SERVICE_COLUMNS, "WiFi_Service"])
    scores = {c: scale(c, vocab.SCALES["rating_prepared"]).cast("double") for c in [*vocab.SERVICE_COLUMNS, "WiFi_Service"]}
    rows = rows.withColumns(scores).select(
        row_mean(*vocab.SERVICE_COLUMNS).alias("Service_Score"), (F.col("Departure_Delay") + F.col("Arrival_Delay")).cast("double").alias("Total_Delay"),
        F.col("Age").cast("double").alias("Age"), "Flight_Distance", "WiFi_Service").dropna()
    names = rows.columns
    rows = stage(features.standardize(rows, names).withColumn("features", F.array(*names)), "trips")
    model = clusters.kmeans(rows, 4, restarts=10)
    return clusters.cluster_profile(model.transform(rows), "cluster", names, [])


def kmeans_sweep(spark, sf_dir):
    found, _, _ = clusters.kmeans_sweep(_vectors(spark, sf_dir), "vec_id")
    return found


def silhouette(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    squared = clusters.silhouettes(rows, "vec_id", "embedding", "label").select("vec_id", F.round("silhouette", 6).alias("squared"))
    plain = clusters.silhouettes(rows, "vec_id", "embedding", "label", "euclidean").select("vec_id", F.round("silhouette", 6).alias("euclidean"))
    return squared.join(plain, "vec_id")


def _nearest(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return clusters.assign_nearest(rows, "embedding", clusters.class_means(rows, "embedding", "label"))


def write_labeled(spark, sf_dir):
    labels = _nearest(spark, sf_dir).select("vec_id", "cluster")
    rows = _embeddings(spark, sf_dir).select("vec_id", "label")
    path = writers.write_labeled(rows, labels, "vec_id", os.path.join(staging_dir(spark), f"labelled-{uuid.uuid4().hex}"))
    return spark.read.parquet(path)


def _legs(spark, sf_dir):
    return view(spark, sf_dir, "fact")


LEG_NUMBERS, LEG_TEXT = ["Departure_Delay", "Arrival_Delay"], ["Payment_Method", "Booking_Channel"]


def feature_set_ranking(spark, sf_dir):
    """Five feature sets over whole flights, k from 2 to 10, ten starts each."""
    numbers = {"Age", "Flight_Distance", "Departure_Delay", "Arrival_Delay", "Flight_Minutes"}
    sets = {name: [c if c != "Flight_Duration" else "Flight_Minutes" for c in columns] for name, columns in vocab.FEATURE_SETS.items()}
    s = star(spark, sf_dir)
    timed = s.dimensions["flight"].derive("Flight_Minutes", by=lambda f: f.withColumn("Flight_Minutes", hhmm_to_minutes("Flight_Duration")))
    s = s.with_dimension("flight", timed)
    wanted = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    rows = stage(s.flat(["Service_Key", "Leg", "Flight_Key", *wanted]).withColumn("Trip_Key", F.concat_ws("-", "Service_Key", "Leg", "Flight_Key")), "flights")
    parts = {name: ([c for c in columns if c in numbers], [c for c in columns if c not in numbers]) for name, columns in sets.items()}
    return study.rank_feature_sets(rows, "Trip_Key", parts)


QUERIES = {
    "standardize": standardize,
    "feature_pipeline": feature_pipeline,
    "variance_filter": variance_filter,
    "anova_top_k": anova_top_k,
    "stratified_split": stratified_split,
    "stratified_folds": stratified_folds,
    "time_series_folds": lambda s, d: splits.time_series_folds(table(s, d, "events").select("event_id", "event_type"), "event_id", 5),
    "time_fold_ranges": lambda s, d: splits.time_fold_ranges(table(s, d, "events"), 5),
    "smote": smote,
    "pca": pca,
    "random_forest": random_forest,
    "decision_tree": _report("decision_tree", {"maxDepth": 30}),
    "logistic_regression": _report("logistic_regression", {"C": 1.0, "penalty": "l2"}),
    "gaussian_nb": gaussian_nb,
    "knn_classify": knn_classify,
    "linear_svm": _report("linear_svm", {"C": 1.0}),
    "mlp": _report("mlp"),
    "grid_search": grid_search,
    "grid_bayes": grid_bayes,
    "grid_neighbours": grid_neighbours,
    "bayes_areas": bayes_areas,
    "model_curves": model_curves,
    "tuning_tree": _tuning("decision_tree"),
    "tuning_neighbours": _tuning("knn"),
    "feature_scores": feature_scores,
    "selection_pipeline": selection_pipeline,
    "smote_training": smote_training,
    "model_bakeoff": model_bakeoff,
    "multi_output": multi_output,
    "confusion_matrix": lambda s, d: evaluation.confusion_matrix(_predicted(s, d)),
    "classification_report": lambda s, d: evaluation.classification_report(_predicted(s, d)),
    "roc_curve": roc_curve,
    "roc_auc": roc_auc,
    "pr_curve": pr_curve,
    "feature_importance": feature_importance,
    "fold_scores": fold_scores,
    "kmeans_fixed": kmeans_fixed,
    "kmeans_sweep": kmeans_sweep,
    "silhouette": silhouette,
    "assign_nearest": lambda s, d: _nearest(s, d).select("vec_id", "cluster"),
    "cluster_profile": lambda s, d: clusters.cluster_profile(_legs(s, d), "Leg", LEG_NUMBERS, LEG_TEXT),
    "distinctive_features": lambda s, d: clusters.distinctive_features(_legs(s, d), "Leg", LEG_NUMBERS, LEG_TEXT),
    "cluster_sizes": lambda s, d: clusters.cluster_sizes(_legs(s, d), "Leg"),
    "feature_set_ranking": feature_set_ranking,
    "write_labeled": write_labeled,
}

# --- oracles ----------------------------------------------------------------------------

_RATING = {"Poor": 1, "Fair": 2, "Good": 3, "Excellent": 4}


def _code(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RATING.items()) + f" ELSE 0 END AS {c}"


_CODED_ROWS = f"(SELECT {TARGET}, {', '.join(_code(c) for c in CODED)} FROM service)"


def _anova() -> str:
    parts = []
    for c in CODED:
        parts.append(
            f"SELECT '{c}' AS feature, sum(n * pow(m - g, 2)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM "
            f"(SELECT count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {_CODED_ROWS}) AS g FROM {_CODED_ROWS} GROUP BY {TARGET})")
    return f"SELECT feature, round(f, 4) AS f_score FROM ({' UNION ALL '.join(parts)}) ORDER BY f DESC, feature LIMIT 4"


def _ranked(source: str, key: str, label: str) -> str:
    return (
        f"(SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat({key}, '|42'))) AS r, count(*) OVER (PARTITION BY {label}) AS n FROM {source})"
    )


_DIMS = "(SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_CENTRES = f"centres AS (SELECT label AS c, list(m ORDER BY i) AS x FROM (SELECT label, i, avg(v) AS m FROM {_DIMS} GROUP BY 1, 2) GROUP BY 1)"
_ASSIGNED = (
    "(SELECT vec_id, label, arg_min(c, struct_pack(d := d, c := c)) AS cluster FROM (SELECT vec_id, label, c, "
    "list_distance(embedding::DOUBLE[], x) AS d FROM embeddings, centres) GROUP BY 1, 2)"
)


def _neighbours_sql() -> str:
    base = (
        f"WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, r <= round(n * 0.8) AS is_train FROM {_ranked('embeddings', 'vec_id', 'label')}), "
        "d AS (SELECT q.vec_id, p.vec_id AS pid, p.label, list_distance(q.e, p.e) AS d2, "
        "list_sum([abs(a - b) for a, b in list_zip_(q.e, p.e)]) AS d1 FROM s q, s p WHERE NOT q.is_train AND p.is_train), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, pid) AS p2, row_number() OVER (PARTITION BY vec_id ORDER BY d1, pid) AS p1 FROM d), "
    )
    base = base.replace("list_sum([abs(a - b) for a, b in list_zip_(q.e, p.e)])", "list_sum([abs(t[1] - t[2]) for t in list_zip(q.e, p.e)])")
    votes = []
    for name, place, k, weight in (("five", "p2", 5, "1.0"), ("three_weighted", "p2", 3, "1.0 / d2"), ("manhattan", "p1", 5, "1.0")):
        votes.append(
            f"{name} AS (SELECT vec_id, label AS {name} FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(sum({weight}), 9) DESC, label) AS r "
            f"FROM n WHERE {place} <= {k} GROUP BY vec_id, label) WHERE r = 1)")
    return base + ", ".join(votes) + " SELECT vec_id, five, three_weighted, manhattan FROM five JOIN three_weighted USING (vec_id) JOIN manhattan USING (vec_id)"


def _folds_sql() -> str:
    return f"(SELECT vec_id AS id, CAST((r - 1) % 3 AS INT) AS fold FROM {_ranked('embeddings', 'vec_id', 'label')})"


def _grid_bayes_sql() -> str:
    """Means and variances of the rows outside each fold, the 15 dimensions they choose, and the scores of the fold's rows."""
    settings = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(vocab.ENCODED_GRIDS["gaussian_nb"]["smoothing"]))
    return (
        f"WITH x AS MATERIALIZED (SELECT d.*, fold FROM {_DIMS} d JOIN {_folds_sql()} f ON d.vec_id = f.id), "
        "g AS MATERIALIZED (SELECT test, label AS c, i, count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) AS s FROM x JOIN (SELECT unnest(range(3)) AS test) ON fold <> test GROUP BY ALL), "
        "w AS (SELECT test, i, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * s) AS gaps FROM g GROUP BY ALL), "
        "b AS (SELECT g.test, g.i, any_value(w.n) AS n, any_value(w.k) AS k, any_value(w.gaps) AS gaps, sum(g.n * pow(g.m - w.mean, 2)) AS apart FROM g JOIN w USING (test, i) GROUP BY ALL), "
        f"p AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY apart / (k - 1) / (gaps / (n - k)) DESC, i) AS place FROM b) WHERE place <= {KEEP}), "
        f"e AS (SELECT test, setting, any_value(share) * max((apart + gaps) / n) AS eps FROM p, (VALUES {settings}) v(setting, share) GROUP BY ALL), "
        "l AS (SELECT x.vec_id, x.fold, e.setting, g.c, any_value(x.label) AS label, ln(any_value(g.n) / any_value(p.n)) + sum(-0.5 * ln(2 * pi() * (g.s + eps)) - pow(v - g.m, 2) / (2 * (g.s + eps))) AS score "
        "FROM x JOIN p ON p.test = x.fold AND p.i = x.i JOIN g ON g.test = x.fold AND g.i = x.i JOIN e ON e.test = x.fold GROUP BY x.vec_id, x.fold, e.setting, g.c), "
        "h AS (SELECT fold, setting, vec_id, any_value(label) = arg_max(c, score) AS hit FROM l GROUP BY ALL), "
        "t AS (SELECT fold, setting, count(*) FILTER (hit) AS hits, count(*) AS n FROM h GROUP BY ALL) "
        "SELECT CAST(setting AS INT) AS setting, CAST(sum(hits) AS BIGINT) AS right, CAST(sum(n) AS BIGINT) AS rows, round(avg(hits / n::DOUBLE), 6) AS accuracy FROM t GROUP BY setting"
    )


def _grid_neighbours_sql() -> str:
    grid = vocab.ENCODED_GRIDS["knn"]
    parts = [
        f"SELECT {i} AS setting, vec_id, fold, own, label, round(sum({'1.0' if s['weights'] == 'uniform' else '1.0 / d'}), 9) AS votes FROM n WHERE place <= {s['k']} GROUP BY ALL"
        for i, s in enumerate(models.grid(grid))]
    return (
        f"WITH r AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e, fold FROM embeddings JOIN {_folds_sql()} ON id = vec_id), "
        "d AS (SELECT q.vec_id, q.fold, q.label AS own, p.vec_id AS pid, p.label, list_distance(q.e, p.e) AS d FROM r q JOIN r p ON q.fold <> p.fold), "
        f"n AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, pid) AS place FROM d) WHERE place <= {max(grid['k'])}), "
        f"v AS ({' UNION ALL '.join(parts)}), "
        "h AS (SELECT setting, fold, own = label AS hit FROM (SELECT *, row_number() OVER (PARTITION BY setting, vec_id ORDER BY votes DESC, label) AS r FROM v) WHERE r = 1), "
        "t AS (SELECT setting, fold, count(*) FILTER (hit) AS hits, count(*) AS n FROM h GROUP BY ALL) "
        "SELECT CAST(setting AS INT) AS setting, CAST(sum(hits) AS BIGINT) AS right, CAST(sum(n) AS BIGINT) AS rows, round(avg(hits / n::DOUBLE), 6) AS accuracy FROM t GROUP BY setting"
    )


_GUESS = "CASE WHEN Seat_Comfort = 'Excellent' THEN 'Happy' WHEN Seat_Comfort IN ('Good', 'Fair') THEN 'Satisfied' ELSE 'Dissatisfied' END"
_PREDICTED = f"p AS (SELECT Overall_Satisfaction AS label, {_GUESS} AS prediction FROM service)"
_STEPS = (
    "f AS (SELECT o_totalprice AS t, count(*) FILTER (o_orderstatus = 'F') AS pos, count(*) FILTER (o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1), "
    "c AS (SELECT t, pos, neg, sum(pos) OVER (ORDER BY t DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY t DESC)::DOUBLE AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM f)"
)


def _leg_mode(c: str) -> str:
    return f"(SELECT Leg, {c} AS v FROM (SELECT Leg, {c}, row_number() OVER (PARTITION BY Leg ORDER BY count(*) DESC, {c}) AS r FROM fact GROUP BY 1, 2) WHERE r = 1)"


def _all_mode(c: str) -> str:
    return f"(SELECT {c} FROM fact GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"


def _distinctive() -> str:
    parts = [
        f"SELECT Leg, '{c}' AS feature, CASE WHEN m > o THEN 'higher' ELSE 'lower' END AS kind, CAST(round(m, 6) AS VARCHAR) AS value, CAST(round(o, 6) AS VARCHAR) AS overall FROM "
        f"(SELECT Leg, avg({c}) AS m FROM fact GROUP BY 1), (SELECT avg({c}) AS o, stddev_samp({c}) AS s FROM fact) WHERE abs(m - o) > 0.5 * s" for c in LEG_NUMBERS
    ] + [
        f"SELECT Leg, '{c}', 'different', v, {_all_mode(c)} FROM {_leg_mode(c)} WHERE v <> {_all_mode(c)}" for c in LEG_TEXT
    ]
    return " UNION ALL ".join(parts)


ORACLES = {name: oracle(sql) for name, sql in {
    "standardize":
        "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice, 0.0::DOUBLE AS constant FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)",
    "variance_filter": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, var_pop({c}) > 0 AS kept FROM lineitem" for c in ("l_quantity", "l_linenumber", "l_tax"))
        + " UNION ALL SELECT 'constant', 0.0::DOUBLE, false",
    "anova_top_k": _anova(),
    "stratified_split": f"SELECT o_orderkey, o_orderstatus, r <= round(n * 0.75) AS is_train FROM {_ranked('orders', 'o_orderkey', 'o_orderstatus')}",
    "stratified_folds": f"SELECT o_orderkey, o_orderstatus, CAST((r - 1) % 5 AS INT) AS fold FROM {_ranked('orders', 'o_orderkey', 'o_orderstatus')}",
    "time_series_folds":
        "SELECT event_id, event_type, position, CAST(CASE WHEN position < n - 5 * (n // 6) THEN 0 ELSE (position - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INT) AS test_fold "
        "FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS position, count(*) OVER () AS n FROM events)",
    "time_fold_ranges":
        "SELECT CAST(i AS INT) AS fold, n - (6 - i) * (n // 6) AS train_rows, n - (6 - i) * (n // 6) AS test_from, n - (5 - i) * (n // 6) AS test_to "
        "FROM (SELECT count(*) AS n FROM events), range(1, 6) t(i)",
    "gaussian_nb":
        f"WITH x AS (SELECT * FROM {_DIMS}), e AS (SELECT 1e-9::DOUBLE * max(v) AS eps FROM (SELECT i, var_pop(v) AS v FROM x GROUP BY 1)), "
        "g AS (SELECT label AS c, i, avg(v) AS m, var_pop(v) + any_value(eps) AS s, count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS p FROM x, e GROUP BY 1, 2), "
        "l AS (SELECT vec_id, c, ln(any_value(p)) + sum(-0.5 * ln(2 * pi() * s) - pow(v - m, 2) / (2 * s)) AS score FROM x JOIN g USING (i) GROUP BY 1, 2) "
        "SELECT vec_id, arg_max(c, score) AS prediction FROM l GROUP BY 1",
    "knn_classify": _neighbours_sql(),
    "bayes_areas":
        f"WITH x AS (SELECT * FROM {_DIMS}), e AS (SELECT 1e-9::DOUBLE * max(v) AS eps FROM (SELECT i, var_pop(v) AS v FROM x GROUP BY 1)), "
        "g AS (SELECT label AS c, i, avg(v) AS m, var_pop(v) + any_value(eps) AS s, count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS p FROM x, e GROUP BY 1, 2), "
        "l AS (SELECT vec_id, any_value(x.label) AS label, c, ln(any_value(p)) + sum(-0.5 * ln(2 * pi() * s) - pow(v - m, 2) / (2 * s)) AS score FROM x JOIN g USING (i) GROUP BY vec_id, c), "
        "t AS (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM l), "
        "p AS (SELECT c, label = c AS hit, round(exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY vec_id), 9) AS p FROM t), "
        "f AS (SELECT c, p, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM p GROUP BY ALL), "
        "s AS (SELECT *, sum(pos) OVER (PARTITION BY c ORDER BY p DESC)::DOUBLE AS tp, sum(neg) OVER (PARTITION BY c ORDER BY p DESC)::DOUBLE AS fp FROM f) "
        "SELECT c AS class, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision, count(*) AS points FROM s GROUP BY c",
    "grid_bayes": _grid_bayes_sql(),
    "grid_neighbours": _grid_neighbours_sql(),
    "feature_scores":
        f"WITH x AS (SELECT * FROM {_DIMS}), g AS (SELECT label, i, count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY ALL), "
        "w AS (SELECT i, avg(v) AS mean, var_pop(v) AS variance FROM x GROUP BY i) "
        "SELECT CAST(i AS VARCHAR) AS feature, round(any_value(variance), 9) AS variance, "
        "round(sum(n * pow(m - mean, 2)) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))), 4) AS f_score FROM g JOIN w USING (i) GROUP BY i",
    "confusion_matrix": f"WITH {_PREDICTED} SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2",
    "classification_report":
        f"WITH {_PREDICTED}, k AS (SELECT DISTINCT label AS name FROM p UNION SELECT DISTINCT prediction FROM p), "
        "m AS (SELECT name, (SELECT count(*) FROM p WHERE label = name) AS support, (SELECT count(*) FROM p WHERE prediction = name) AS predicted, "
        "(SELECT count(*) FROM p WHERE label = name AND prediction = name) AS hit FROM k), "
        "s AS (SELECT name, CASE WHEN predicted = 0 THEN 0 ELSE hit::DOUBLE / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END AS recall, "
        "2.0::DOUBLE * hit / (support + predicted) AS f1, support, hit FROM m), "
        "o AS (SELECT name, precision, recall, f1, support FROM s UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit)::DOUBLE / sum(support), CAST(sum(support) AS BIGINT) FROM s "
        "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s "
        "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s) "
        "SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM o",
    "roc_curve": f"WITH {_STEPS} SELECT t AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c UNION ALL SELECT 'inf'::DOUBLE, 0, 0",
    "roc_auc": f"WITH {_STEPS} SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(p) * any_value(n)), 6) AS auc FROM c",
    "pr_curve": f"WITH {_STEPS} SELECT t AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM c UNION ALL SELECT NULL, 1, 0",
    "silhouette":
        "WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), "
        "m AS (SELECT vec_id, own, other, avg(d) AS e, avg(d * d) AS s FROM d GROUP BY ALL), "
        "ab AS (SELECT vec_id, max(e) FILTER (own = other) AS ea, min(e) FILTER (own <> other) AS eb, max(s) FILTER (own = other) AS sa, min(s) FILTER (own <> other) AS sb FROM m GROUP BY 1) "
        "SELECT vec_id, round((sb - sa) / greatest(sa, sb), 6) AS squared, round((eb - ea) / greatest(ea, eb), 6) AS euclidean FROM ab",
    "assign_nearest": f"WITH {_CENTRES} SELECT vec_id, cluster FROM {_ASSIGNED}",
    "write_labeled": f"WITH {_CENTRES} SELECT vec_id, label, cluster FROM {_ASSIGNED}",
    "cluster_profile":
        "SELECT f.*, p.v AS Payment_Method, b.v AS Booking_Channel FROM (SELECT Leg, round(avg(Departure_Delay), 6) AS Departure_Delay, round(avg(Arrival_Delay), 6) AS Arrival_Delay, "
        "count(*) AS Cluster_Size, round_even(count(*)::DOUBLE / (SELECT count(*) FROM fact) * 100, 2) AS Cluster_Percentage FROM fact GROUP BY 1) f "
        f"JOIN {_leg_mode('Payment_Method')} p USING (Leg) JOIN {_leg_mode('Booking_Channel')} b USING (Leg)",
    "distinctive_features": _distinctive(),
    "cluster_sizes": "SELECT Leg, count(*) AS size FROM fact GROUP BY 1",
}.items()}
