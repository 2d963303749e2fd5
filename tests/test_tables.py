import random

from pyspark.sql import functions as F

from reportloom.operators import structure as B
from reportloom.operators import tables as TB


def test_running_totals_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGES", 7)
    rng = random.Random(3)
    rows = [(rng.randrange(40), i, rng.randrange(5)) for i in range(300)]
    got = {r["i"]: r["before"] for r in B.running_totals(spark.createDataFrame(rows, "k long, i long, v long"), ["k", "i"], F.col("v"), "before").collect()}
    total = 0
    for _, i, v in sorted(rows):
        assert got[i] == total
        total += v
    assert B.running_totals(spark.createDataFrame([], "k long, v long"), ["k"], F.col("v"), "before").count() == 0


def test_widths_against_bisection(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        n = rng.randrange(1, 7)
        least = [float(rng.randrange(0, 50)) for _ in range(n)]
        rows.append((least, [w + rng.randrange(0, 60) for w in least], float(rng.randrange(20, 500))))
    df = spark.createDataFrame(rows, "least array<double>, wished array<double>, target double")
    for least, wished, target, got in df.select("*", TB.fitted_widths(F.col("least"), F.col("wished"), F.col("target"))).collect():
        if sum(least) > target:
            want = [w * target / sum(least) for w in least]
        else:
            low, high = 0.0, target + max(wished)
            at = (lambda v: [max(w, v) for w in wished]) if sum(wished) <= target else (lambda v: [max(a, min(b, v)) for a, b in zip(least, wished)])  # noqa: B023, B905
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(at(mid)) < target else (low, mid)
            want = at(high)
        assert abs(sum(got) - target) < 1e-6 and all(abs(a - b) < 1e-4 for a, b in zip(got, want, strict=True)), (least, wished, target)


def test_headers_that_fit(spark):
    df = spark.createDataFrame([("구분", 1.0), ("소요 예산(단위: 천원)", 300_000.0), ("소요 예산(단위: 천원)", 5_000_000.0)], "t string, w double")
    got = [r[0] for r in df.select(TB.fitting_header(F.col("t"), F.array(F.col("t")), 100_000, F.col("w"), 1)).collect()]
    assert got == ["구분", "예산", "소요 예산(단위: 천원)"]
