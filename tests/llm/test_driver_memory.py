"""What the classifier's fit keeps on the driver."""

import tracemalloc

import numpy as np

from trencher.llm import quality_classifier


def test_the_fit_keeps_arrays(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"{'good' if i % 2 else 'bad'}{k}" for k in rng.choice(600, 450, replace=False)]
        rows.append((" ".join(words), int(i % 2 == 0), None if i % 5 == 0 else int(i % 4 == 0)))
    sample = spark.createDataFrame(rows, "text string, low_quality int, toxic int").coalesce(1).cache()
    quality_classifier._fitted(sample)
    tracemalloc.start()
    weights, added = quality_classifier._fitted(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    numbers = sum(len(quality_classifier.features(t, quality_classifier._Words(None)) & weights.keys()) for t, *_ in rows)
    assert numbers > 100_000 and peak < 45 * numbers
    assert weights["bad1"][0] > 0 > weights["good1"][0] and len(added) == 2


def test_regression_is_that_of_the_sets():
    rng = np.random.default_rng(6)
    sets = [sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist()) for _ in range(80)]
    bad = rng.integers(0, 2, 80).astype(float)
    of = np.repeat(np.arange(80), [len(s) for s in sets])
    at = np.array([f for s in sets for f in s], np.int64)
    found, intercept = quality_classifier.regression(of, at, bad, 30)
    x = np.zeros((80, 31))
    x[of, at], x[:, 30] = 1, 1
    w, first, second = np.zeros(31), np.zeros(31), np.zeros(31)
    for t in range(1, quality_classifier.ROUNDS + 1):
        slope = x.T @ (1 / (1 + np.exp(-x @ w)) - bad) / 80 + quality_classifier.RIDGE * np.append(w[:30], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= quality_classifier.RATE * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    assert np.allclose([*found, intercept], w)
