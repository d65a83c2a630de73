"""Aggregates and models over texts: frequencies, statistics, clusters, classifiers, confusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.functions.text import strip, tokens


def term_counts(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Uses of each blank-separated lower-case word, per group if keys are given."""
    words = F.split(strip(F.lower(F.coalesce(F.col(text), F.lit("")))), r"\s+")
    return df.select(*keys, F.explode(words).alias("term")).where("term != ''").groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(df: DataFrame, text: str, k: int) -> DataFrame:
    """The ``k`` most used words (ties: alphabetical)."""
    return term_counts(df, text).orderBy(F.desc("n"), "term").limit(k)


def top_terms_by(df: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """The ``k`` most used words of each group."""
    ranked = term_counts(df, text, key).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term")))
    return ranked.where(F.col("place") <= k)


def top_prefixes(df: DataFrame, text: str, length: int, k: int) -> DataFrame:
    """The ``k`` most frequent beginnings of texts longer than ``length``."""
    heads = df.where(F.length(text) > length).select(F.lower(F.left(F.col(text), F.lit(length))).alias("prefix"))
    return heads.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(k)


def length_stats(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Count, mean, median, least, most and sample deviation of text lengths."""
    n = F.length(text)
    return df.groupBy(*keys).agg(
        F.count(n).alias("n_texts"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.min(n).alias("least"), F.max(n).alias("most"), F.stddev_samp(n).alias("deviation")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and whether it is the most frequent one (ties: smallest value)."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.where(F.col("value").isNotNull()).agg(F.max("n")).scalar()
    mode = counted.where((F.col("n") == best) & F.col("value").isNotNull()).agg(F.min("value")).scalar()
    return counted.withColumn("is_mode", F.coalesce(F.col("value") == mode, F.lit(False)))


def ordinal_mean(df: DataFrame, column: str, scale: dict[str, int], *keys: str) -> DataFrame:
    """Mean of an ordinal column by a fixed scale; values outside it are skipped."""
    place: Column = F.lit(None).cast("int")
    for name, value in scale.items():
        place = F.when(F.lower(F.trim(column)) == name, value).otherwise(place)
    return df.withColumn("_o", place).groupBy(*keys).agg(F.avg("_o").alias("mean"), F.count("_o").alias("n_mapped"), F.count(F.lit(1)).alias("n_rows"))


def audit_counts(df: DataFrame, issues: str, *dimensions: str) -> DataFrame:
    """Rows per issue over all rows and per value of each dimension, in one pass by grouping sets.

    Result: issue, dimension ('all' or its name), value, n.
    """
    flat = df.select(F.explode(issues).alias("issue"), *[F.col(d).cast("string").alias(d) for d in dimensions])
    sets = [[F.col("issue")], *[[F.col("issue"), F.col(d)] for d in dimensions]]
    counted = flat.groupingSets(sets, "issue", *dimensions).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    name: Column = F.lit("all")
    value: Column = F.lit(None).cast("string")
    for d in dimensions:
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return counted.select("issue", name.alias("dimension"), value.alias("value"), "n")


def rate_checks(df: DataFrame, rates: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per named rate: value (mean of a condition, in percent), target and verdict."""
    one = df.agg(*[F.round(F.avg(c.cast("double")) * 100, 1).alias(n) for n, (c, _) in rates.items()])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(float(t)).alias("target"), F.when(F.col(n) >= t, "PASS").otherwise("FAIL").alias("verdict"))
            for n, (_, t) in rates.items()
        ]
    )
    return one.select(F.inline(rows))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per pair of actual and predicted value, and their share of the actual value's rows."""
    pairs = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def keyword_flags(text: str | Column, domains: dict[str, Sequence[str]]) -> Column:
    """Struct of the number of each domain's keywords that the text contains, and flags for numbers, percent, currency and formulas."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    hits = [sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)).alias(name) for name, words in domains.items()]
    flags = {"has_number": r"\d", "has_percent": "%", "has_currency": r"r\$|€|us\$", "has_formula": r"[=+×÷√²³]"}
    return F.struct(*hits, *[t.rlike(p).alias(n) for n, p in flags.items()])


def cluster_texts(df: DataFrame, id_column: str, text: str, k: int = 5, vocabulary: int = 1000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) and (cluster, size, top terms) by k-means on normalised tf-idf vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    bags = df.select(F.col(id_column).alias("id"), tokens(text).alias("_w")).where(F.size("_w") > 0)
    steps = [
        CountVectorizer(inputCol="_w", outputCol="_tf", vocabSize=vocabulary),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features"),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
    ]
    model = Pipeline(stages=steps).fit(bags)
    assigned = model.transform(bags).select("id", "cluster")
    words = model.stages[0].vocabulary
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    tops = [(i, [words[j] for j in sorted(range(len(c)), key=lambda j: (-c[j], words[j]))[:10]]) for i, c in enumerate(model.stages[-1].clusterCenters())]
    return assigned, df.sparkSession.createDataFrame(tops, "cluster int, top_terms array<string>").join(sizes, "cluster", "left").fillna(0, ["size"])


def split_rows(df: DataFrame, id_column: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by a hash of the id, so every label is split in about the same proportion, and the same in every run."""
    u = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(10_000))
    test = u < int(test_share * 10_000)
    return df.where(~test), df.where(test)


def train_classifier(
    df: DataFrame, label: str, text: str, kind: str = "nb", vocabulary: int = 5000, folds: int | None = None, seed: int = 42, pairs: bool = False, balanced: bool = False
):
    """A fitted pipeline from text to label: 'nb' naive Bayes, 'svm' linear machines one against the rest, 'rf' random forest,
    'gbt' boosted trees (two labels only).

    With ``pairs`` pairs of neighbouring words are terms, too; with ``balanced`` every label has the same weight in all. With ``folds`` the
    main parameter is chosen by cross-validation. ``save_model`` and ``load_model`` keep the pipeline.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import IDF, CountVectorizer, SQLTransformer, StringIndexer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = df.select(F.col(label).alias("label_text"), tokens(text).alias("words")).where(F.col("label_text").isNotNull() & (F.size("words") > 0))
    weight = {}
    if balanced:
        sizes = data.groupBy("label_text").agg(F.count(F.lit(1)).alias("_n"))
        weights = sizes.select("label_text", (sizes.agg(F.avg("_n")).scalar() / F.col("_n")).alias("weight"))
        data, weight = data.join(weights, "label_text"), {"weightCol": "weight"}
    common = {"labelCol": "label", "featuresCol": "features", **weight}
    if kind == "nb":
        last = NaiveBayes(smoothing=1.0, **common)
        grid = ParamGridBuilder().addGrid(last.smoothing, [0.1, 1.0]).build()
    elif kind == "svm":
        inner = LinearSVC(maxIter=20)
        last = OneVsRest(classifier=inner, **common)
        grid = ParamGridBuilder().addGrid(inner.regParam, [0.0, 0.1]).build()
    elif kind == "gbt":
        last = GBTClassifier(maxIter=20, seed=seed, **common)
        grid = ParamGridBuilder().addGrid(last.maxDepth, [3, 5]).build()
    else:
        last = RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **common)
        grid = ParamGridBuilder().addGrid(last.maxDepth, [5, 10]).build()
    both = "concat(words, transform(sequence(1, greatest(size(words) - 1, 1)), i -> concat_ws(' ', slice(words, i, 2))))"
    steps = [
        StringIndexer(inputCol="label_text", outputCol="label", handleInvalid="keep", stringOrderType="frequencyDesc"),
        SQLTransformer(statement=f"SELECT *, {both if pairs else 'words'} AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary),
        IDF(inputCol="tf", outputCol="features"),
        last,
    ]
    pipeline = Pipeline(stages=steps)
    if folds:
        judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
        return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed).fit(data).bestModel
    return pipeline.fit(data)


def _stage(model, kind: type):
    return next(s for s in model.stages if isinstance(s, kind))


def predict_labels(df: DataFrame, model, id_column: str, text: str) -> DataFrame:
    """(id, predicted, probabilities): the label's text, and a map of each label to its probability (null for kinds without any)."""
    from pyspark.ml.feature import IndexToString, StringIndexerModel
    from pyspark.ml.functions import vector_to_array

    names = _stage(model, StringIndexerModel)
    scored = df.select(F.col(id_column).alias("id"), F.lit(None).cast("string").alias("label_text"), tokens(text).alias("words"))
    for stage in model.stages:
        scored = scored if stage is names else stage.transform(scored)
    if "probability" in scored.columns:
        labels = F.array(*[F.lit(x) for x in [*names.labels, "?"]])
        values = vector_to_array("probability")
        chances = F.map_from_arrays(F.slice(labels, F.lit(1), F.size(values)), values)
    else:
        chances = F.lit(None).cast("map<string,double>")
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*names.labels, "?"]).transform(scored)
    return named.select("id", "predicted", chances.alias("probabilities"))


def term_importances(model, spark, k: int = 20) -> DataFrame:
    """(term, importance) of the ``k`` terms that a forest or boosted trees use most (ties: alphabetical)."""
    from pyspark.ml.feature import CountVectorizerModel

    weights = model.stages[-1].featureImportances
    words = _stage(model, CountVectorizerModel).vocabulary
    pairs = sorted(((words[int(i)], float(x)) for i, x in zip(weights.indices, weights.values, strict=True)), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame(pairs[:k], "term string, importance double")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def golden_metrics(extracted: DataFrame, golden: DataFrame, keys: Sequence[str], text: str, group: str, *exact: str) -> DataFrame:
    """Extracted texts against a golden set, per value of the golden side's ``group``.

    Result: group, n_golden, n_found, completeness (found of golden), error_rate (mean edit distance per golden character of those
    found, at most 1 each; an empty golden text has 0 if the other is empty as well, else 1), and the accuracy of each ``exact`` column.
    Keys must be unique on either side.
    """
    left = golden.select(*keys, F.col(group).alias("_group"), F.coalesce(text, F.lit("")).alias("_want"), *[F.col(c).alias(f"_g_{c}") for c in exact])
    right = extracted.select(*keys, F.coalesce(text, F.lit("")).alias("_got"), *[F.col(c).alias(f"_e_{c}") for c in exact], F.lit(True).alias("_there"))
    both = left.join(right, list(keys), "left")
    size = F.length("_want")
    rate = F.when(size == 0, F.when(F.col("_got") == "", 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein("_got", "_want") / size))
    found = F.coalesce("_there", F.lit(False))
    return both.groupBy(F.col("_group").alias(group)).agg(
        F.count(F.lit(1)).alias("n_golden"),
        F.count_if(found).alias("n_found"),
        F.avg(found.cast("double")).alias("completeness"),
        F.avg(F.when(found, rate)).alias("error_rate"),
        *[F.avg(F.when(found, F.col(f"_g_{c}").eqNullSafe(F.col(f"_e_{c}")).cast("double"))).alias(f"{c}_accuracy") for c in exact],
    )
