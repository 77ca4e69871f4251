import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import kmeans, models
from tests import fixtures
from tests.fixtures import one


def scores(spark):
    groups = [(5, 30, 900.0), (300, 3, 90.0), (40, 10, 400.0), (500, 1, 10.0)]
    data = [
        (f"C{g}_{i}", recency + i % 5, frequency + i % 2, money + i)
        for g, (recency, frequency, money) in enumerate(groups) for i in range(25)
    ]
    return spark.createDataFrame(data, "customer_id string, recency int, frequency bigint, monetary double")


def test_kmeans_finds_the_groups_and_orders_them(spark):
    clustered, silhouette = models.kmeans_segments(scores(spark), 4, restarts=3)
    found = {r["customer_id"]: r["cluster"] for r in clustered.collect()}
    assert len(found) == 100 and silhouette > 0.8
    assert [{found[f"C{g}_{i}"] for i in range(25)} for g in range(4)] == [{3}, {1}, {2}, {0}]
    again, _ = models.kmeans_segments(scores(spark), 4, restarts=3)
    assert {r["customer_id"]: r["cluster"] for r in again.collect()} == found


def test_scan_cost_never_rises(spark):
    scan = models.k_scan(scores(spark), 4, restarts=2).orderBy("k").collect()
    assert [r["k"] for r in scan] == [2, 3, 4]
    assert scan[0]["wcss"] >= scan[1]["wcss"] >= scan[2]["wcss"]


def test_price_clusters_are_ascending(spark):
    goods = fixtures.products(spark, [(f"P{i}", "x", base + i) for i, base in enumerate([1, 1, 100, 100, 1000, 1000])])
    assigned, centres = models.kmeans_price(goods, 3)
    assert [r["cluster"] for r in assigned.orderBy("price").collect()] == [0, 0, 1, 1, 2, 2]
    assert [r["center"] for r in centres.orderBy("cluster").collect()] == pytest.approx([1.5, 102.5, 1004.5])


def test_logistic_equals_newton(spark):
    generator = np.random.default_rng(5)
    price = generator.uniform(0, 10, 200).round(2)
    label = (generator.uniform(0, 1, 200) < 1 / (1 + np.exp(-(price - 5)))).astype(float)
    goods = fixtures.products(spark, [(f"P{i}", "x" if y else "y", p) for i, (p, y) in enumerate(zip(price, label))])
    model = models.logistic_category_on_price(goods, "x")
    weights = np.zeros(2)  # coefficient, intercept: summed loss plus half the squared coefficient
    design = np.column_stack([price, np.ones(200)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ weights))
        gradient = design.T @ (p - label) + np.array([weights[0], 0])
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1.0, 0.0])
        weights -= np.linalg.solve(hessian, gradient)
    assert (model.coefficients[0], model.intercept) == pytest.approx(tuple(weights), rel=1e-4)
    report = one(models.logistic_report(goods, "x", model))
    assert report["accuracy"] == pytest.approx(np.mean((design @ weights > 0) == label))
    curve = models.logistic_curve(goods, model).orderBy("point").collect()
    assert len(curve) == 300 and curve[0]["price"] == price.min() and curve[-1]["price"] == pytest.approx(price.max())
    assert models.logistic_category_on_price(goods, "absent") is None
    assert models.logistic_report(goods, "absent", None).columns == models.logistic_report(goods, "x", model).columns
    assert models.logistic_curve(goods, None).count() == 0


def people(spark, n=300):
    data = [
        (f"C{i}", float(i % 50), "F" if i % 2 else "M", ("Card", "Cash", "App")[i % 3], "Regular", 100.0 * (i % 50), "High" if i % 50 > 24 else "Low")
        for i in range(n)
    ]
    frame = spark.createDataFrame(
        data, "customer_id string, recency double, gender string, payment_method string, segment string, future_ltv double, ltv_class string"
    )
    zero = {c: F.lit(1.0) for c in models.NUMERIC_FEATURES if c != "recency"}
    return frame.withColumns(zero)


def test_encoder_drops_the_first_level_and_zeroes_unknown_ones(spark):
    encoder = models.FeatureEncoder.fit(people(spark))
    assert encoder.names[len(models.NUMERIC_FEATURES):] == ["gender_M", "payment_method_Card", "payment_method_Cash"]
    odd = people(spark, 1).withColumn("payment_method", F.lit("Shells")).withColumn("gender", F.lit(None).cast("string"))
    row = one(encoder.transform(odd))
    assert (row["gender_M"], row["payment_method_Card"], row["payment_method_Cash"]) == (0.0, 0.0, 0.0)
    assert row["monetary_scaled"] == 0.0 and row["features"].size == len(encoder.names)
    assert row["recency_scaled"] == pytest.approx((0 - 24.5) / np.std(np.arange(300) % 50))


def test_forests_learn_the_rule(spark):
    frame = people(spark)
    train, test = models.split_train_test(frame)
    assert train.count() + test.count() == 300 and 30 < test.count() < 90
    assert train.join(test, "customer_id").count() == 0
    fitted = models.train_ltv_models(train, trees=10, depth=5)
    predictions = models.predict_customers(fitted, test)
    assert one(models.regression_metrics(predictions, "actual_ltv", "predicted_ltv"))["r2"] > 0.9
    report = {r["label"]: r for r in models.classification_report(predictions, "actual_value_class", "predicted_value_class").collect()}
    assert report["accuracy"]["f1"] > 0.9 and report["macro avg"]["support"] == test.count()
    importance = models.feature_importance(fitted).collect()
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0) and importance[0]["feature"] == "recency"
    assert models.predict_customers(fitted, frame.drop("future_ltv", "ltv_class")).columns == [
        "customer_id", "predicted_ltv", "predicted_value_class"
    ]


def test_forests_do_not_depend_on_files_or_cores(spark):
    frame = people(spark)
    found = []
    for layout, parallelism in ((frame.repartition(1), 2), (frame.repartition(7, "recency"), 5)):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallelism)
        fitted = models.train_ltv_models(layout, trees=5, depth=4, partitions=6)
        predictions = models.predict_customers(fitted, frame)
        found.append(([tuple(r) for r in models.feature_importance(fitted).collect()], sorted(tuple(r) for r in predictions.collect())))
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert found[0] == found[1]


def test_report_of_known_confusion(spark):
    pairs = [("High", "High")] * 3 + [("High", "Low")] + [("Low", "Low")] * 4 + [("Low", "High")] * 2
    frame = spark.createDataFrame(pairs, "a string, p string")
    found = {r["label"]: tuple(r)[1:] for r in models.classification_report(frame, "a", "p").collect()}
    assert found["High"] == pytest.approx((3 / 5, 3 / 4, 2 / 3, 4))
    assert found["Low"] == pytest.approx((4 / 5, 4 / 6, 8 / 11, 6))
    assert found["accuracy"] == pytest.approx((0.7, 0.7, 0.7, 10))
    assert found["macro avg"][0] == pytest.approx(0.7) and found["weighted avg"][0] == pytest.approx(0.72)
    never = models.classification_report(frame.withColumn("p", F.lit("Low")), "a", "p")
    assert {r["label"]: r["precision"] for r in never.collect()}["High"] == 0.0


def test_kmeans_takes_ties_repeats_and_few_points(spark):
    from basketlens.operators import kmeans
    from basketlens.session import settle

    def points(values):
        return settle(spark.createDataFrame([(f"p{i}", [float(v)]) for i, v in enumerate(values)], "id string, x array<double>"))

    fits = kmeans.fit(points([1, 1, 1, 5, 5, 9]), [2, 3])
    assert fits[3][1] == 0 and sorted(c[0] for c in fits[3][0]) == [1, 5, 9]
    assert fits[2][1] == pytest.approx(min(((np.array(a) - np.mean(a)) ** 2).sum() + ((np.array(b) - np.mean(b)) ** 2).sum() for a, b in (([1, 1, 1], [5, 5, 9]), ([1, 1, 1, 5, 5], [9]))))
    few = kmeans.fit(points([1, 2]), [4])
    assert len(few[4][0]) == 2 and few[4][1] == 0
    assert kmeans.fit(points([7, 7, 7]), [2])[2][1] == 0  # a centre without points stays
    assert kmeans.fit(points([]), [2]) == {}
    tied = spark.range(3).select(F.array(F.col("id").cast("double")).alias("x"))
    assert [r[0] for r in tied.select(kmeans.nearest(F.col("x"), np.array([[2.0], [0.0]]))).collect()] == [1, 0, 0]


def test_fits_do_not_depend_on_partitions(spark):
    from basketlens.operators import kmeans
    from basketlens.session import settle

    frame = spark.createDataFrame([(i, [float(i * i % 97), float(i % 13)]) for i in range(300)], "id int, x array<double>")
    one, many = (kmeans.fit(settle(frame.repartition(n)), [3, 5], restarts=4) for n in (1, 16))
    for k in (3, 5):
        assert one[k][1] == pytest.approx(many[k][1]) and np.allclose(one[k][0], many[k][0])


def test_silhouettes_equal_all_pairs(spark):
    from basketlens.operators import kmeans

    rng = np.random.default_rng(3)
    x, cluster = rng.normal(size=(60, 2)), rng.integers(0, 4, 60)
    cluster[0] = 9  # alone
    frame = spark.createDataFrame([(1, int(c), p.tolist()) for c, p in zip(cluster, x)], "k int, cluster int, x array<double>")
    distance = ((x[:, None] - x[None]) ** 2).sum(2)
    values = []
    for i, c in enumerate(cluster):
        own = (cluster == c).sum()
        a = distance[i][cluster == c].sum() / max(own - 1, 1)
        b = min(distance[i][cluster == o].mean() for o in set(cluster) - {c})
        values.append(0 if own == 1 else (b - a) / max(a, b))
    assert kmeans.silhouettes(frame).first()["silhouette_sq_euclidean"] == pytest.approx(np.mean(values))


def test_starts_take_the_least_of_each_task(spark):
    rows = [(i % 50, [float(i)]) for i in range(200)]
    points = spark.createDataFrame(rows, "id bigint, x array<double>")
    text = kmeans.drawn(points, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "Window" not in text and "Exchange" not in text
    hashes = {r: sorted((hashlib.md5(f"42|{r}|{i}".encode()).hexdigest(), i, x) for i, x in rows)[:3] for r in range(2)}
    wanted = {r: [x for *_, x in least] for r, least in hashes.items()}
    assert {r: x.tolist() for r, x in kmeans.starts(points, 3, 2).items()} == wanted
    assert {r: x.tolist() for r, x in kmeans.starts(points.orderBy(F.desc("x")).coalesce(1), 3, 2).items()} == wanted


def test_starts_read_the_points_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    points = spark.createDataFrame([(i, [float(i)]) for i in range(200)], "id bigint, x array<double>").mapInArrow(counted, "id bigint, x array<double>")
    assert len(kmeans.starts(points, 3, 4)) == 4 and read.value == 200


def test_starts_of_missing_and_repeated_ids(spark):
    rows = [(None, [3.0, 1.0]), (None, [None, 1.0]), (None, [3.0, 0.0]), (None, [float("nan"), 0.0])] + [(f"p{i % 3}", [float(i % 5), float(i)]) for i in range(30)]
    points = spark.createDataFrame(rows, "id string, x array<double>")
    for most in (1, 3, 8, 40):
        for restart in range(6):
            key = F.md5(F.concat_ws("|", F.lit("42"), F.lit(str(restart)), "id"))
            wanted = [r["x"] for r in points.orderBy(key, "id", "x").limit(most).collect()]
            found = kmeans.drawn(points.repartition(3), most, 6).where(F.col("restart") == restart).orderBy("key", "id", "x").collect()
            assert str([r["x"] for r in found]) == str(wanted)


def test_rounds_read_blocks_of_points(spark):
    from basketlens.session import settle

    points = settle(spark.range(0, 25_000, 1, 2).select("id", F.array(F.col("id") % 7, F.when(F.col("id") > 2, 1.0)).cast("array<double>").alias("x")))
    blocks = kmeans._blocks(points, 2)
    found = [np.frombuffer(r["block"], float).reshape(2, -1) for r in blocks.collect()]
    assert max(b.shape[1] for b in found) <= kmeans.AT_ONCE and len(found) < 10
    every = np.hstack(found)
    assert every.shape == (2, 25_000) and every[0].sum() == sum(i % 7 for i in range(25_000)) and np.isnan(every[1]).sum() == 3
    centres = {(2, 0): np.array([[0.0, 1.0], [5.0, 1.0]])}
    plain = every[:, ~np.isnan(every[1])]
    sums = kmeans._round(kmeans._blocks(points.where("id > 2"), 2), centres, last=True)[2, 0]
    distance = ((plain[:, None] - centres[2, 0].T[:, :, None]) ** 2).sum(0)
    for c in range(2):
        own = distance.argmin(0) == c
        n, total, cost = sums[c]
        assert n == own.sum() and total == pytest.approx(plain[:, own].sum(1)) and cost == pytest.approx(distance[c, own].sum())


def test_points_are_settled_over_all_cores(spark):
    points = kmeans.settled_points(spark.range(0, 400, 1, 1).withColumn("v", F.col("id")), "id", "v")
    assert points.count() == 400 and len(points.inputFiles()) == spark.sparkContext.defaultParallelism


def test_forests_remember_nodes_and_scoring_is_dealt_over_all_cores(spark):
    frame = people(spark)
    fitted = models.train_ltv_models(frame, trees=3, depth=3, partitions=4)
    assert fitted.regressor.getCacheNodeIds() and fitted.classifier.getCacheNodeIds()
    scored = models.predict_customers(fitted, frame.coalesce(1))
    assert scored.count() == 300 and scored.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
