import numpy as np
from keelgrid.operators import score
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F


def test_models_fitted_together_are_spark_mls(spark):
    random = np.random.default_rng(5)
    x = random.normal(size=(1500, 3)) * (1, 20, 0.1)
    y = (x[:, 0] + x[:, 1] / 15 + random.normal(size=1500) > 0.5).astype(float)
    rows = [(*map(float, r), 7.0, float(t), int(i % 3), int(i % 5)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    xs = ["kg_x0", "kg_x1", "kg_x2", "kg_x3"]
    data = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in xs) + ", kg_y double, kg_f long, kg_i int").cache()
    facts = [F.count("*").alias("n"), F.sum("kg_y").alias("y"), *(f(c).alias(f"{n}{c}") for c in xs for n, f in (("m", F.avg), ("v", F.var_pop)))]
    cells = [r.asDict() for r in data.groupBy("kg_f", "kg_i").agg(*facts).collect()]
    keys = [(0, -1, 0.1), (1, 3, 0.01), (2, 0, 0.001)]
    for (f, i, strength), got in zip(keys, score._fit_together(data, xs, keys, cells), strict=True):
        train = VectorAssembler(inputCols=xs, outputCol="v").transform(data.where((F.col("kg_f") != f) & (F.col("kg_i") != i)))
        m = LogisticRegression(featuresCol="v", labelCol="kg_y", regParam=strength, maxIter=300, tol=1e-12).fit(train)
        assert np.allclose(got, [*m.coefficients, m.intercept], rtol=1e-5, atol=1e-6)
        assert got[3] == 0.0
