"""Styled runs against plain Python, and Markdown and pages read into them and written again."""

import random
import re

from pyspark.sql import functions as F

from reportloom.functions import runs as R
from reportloom.sources import html as H
from reportloom.sources import sinks
from reportloom.sources import text_files as X


def rows_of(runs):
    return [dict(zip(("text", "bold", "italic", "code", "href"), r, strict=True)) for r in runs]


def tuples(runs):
    return [tuple(r) for r in runs]


def random_runs(rng):
    words = ["", " ", "a", "b c", " d ", "e\n", "\nf", "1000건", "*x*", "g\n\nh"]
    return [(rng.choice(words), rng.random() < 0.3, rng.random() < 0.2, rng.random() < 0.2, rng.choice([None, None, "u"])) for _ in range(rng.randrange(6))]


def plain_merged(runs):
    out = []
    for r in runs:
        if r[0] and out and out[-1][1:] == r[1:]:
            out[-1] = (out[-1][0] + r[0], *r[1:])
        elif r[0]:
            out.append(r)
    return out


def test_runs_against_plain_python(spark):
    rng = random.Random(1)
    cases = [random_runs(rng) for _ in range(200)]
    df = spark.createDataFrame([(i, rows_of(c), rng.randrange(8)) for i, c in enumerate(cases)], f"i long, runs array<{R.RUN}>, n int").cache()
    upper = lambda t: F.upper(t)
    got = df.select("i", "n", R.plain(F.col("runs")).alias("plain"), R.uniform(F.col("runs")).alias("uniform"), R.merged(F.col("runs")).alias("merged"), R.lines(F.col("runs")).alias("lines"), R.without_start(F.col("runs"), F.col("n")).alias("rest"), R.trimmed(F.col("runs")).alias("trimmed"), R.rewritten(F.col("runs"), upper, lambda t: F.concat(t, F.lit("!"))).alias("new")).orderBy("i").collect()
    for r, case in zip(got, cases, strict=True):
        text = "".join(x[0] for x in case)
        assert r["plain"] == text and r["uniform"] == (len({x[1:] for x in case}) <= 1)
        assert tuples(r["merged"]) == plain_merged(case)
        assert [t for t in ("".join(x["text"] for x in line) for line in r["lines"])] == [t for t in text.split("\n") if t.strip()]
        assert "".join(x["text"] for x in r["rest"]) == text[r["n"] :] and {x[1:] for x in tuples(r["rest"])} <= {x[1:] for x in case}
        ends = [(x[0].lstrip() if i == 0 else x[0], *x[1:]) for i, x in enumerate(case)]
        ends = [(x[0].rstrip() if i == len(ends) - 1 else x[0], *x[1:]) for i, x in enumerate(ends)]
        assert tuples(r["trimmed"]) == [x for x in ends if x[0]]
        if not case:
            assert r["new"] == []
        elif r["uniform"]:
            assert tuples(r["new"]) == [(text.strip().upper() + "!", *case[0][1:])]
        else:
            lead = lambda t: t[: len(t) - len(t.lstrip())]
            trail = lambda t: t[len(t.rstrip()) :] if t.strip() else ""
            want = [x if x[3] else (lead(x[0]) + x[0].strip().upper() + ("!" if i == len(case) - 1 else "") + trail(x[0]), *x[1:]) for i, x in enumerate(case)]
            assert tuples(r["new"]) == [x for x in want if x[0]]
    nothing = spark.createDataFrame([(None,)], f"runs array<{R.RUN}>").select(R.plain(F.col("runs")), R.uniform(F.col("runs"))).first()
    assert tuple(nothing) == ("", True)


def test_styles_carried_through_a_rewrite(spark):
    case = rows_of([("빨간 ", False, False, False, None), ("사과 3개", True, False, False, None), (" 를 샀다", False, True, False, "u")])
    texts = ["빨간 사과 3개 를 샀다", "빨간 사과 12개 를 샀다", "파란 사과 3개 를 샀다", "빨간 사과 3개 를 샀다!", "", "완전히 다름", "빨간 사과 3개"]
    df = spark.createDataFrame([(i, case, t) for i, t in enumerate(texts)], f"i int, runs array<{R.RUN}>, t string")
    got = [tuples(r[0]) for r in df.orderBy("i").select(R.carried(F.col("runs"), F.col("t"))).collect()]
    assert ["".join(x[0] for x in g) for g in got] == texts
    assert [x[0] for x in got[1]] == ["빨간 ", "사과 12개", " 를 샀다"] and [x[0] for x in got[2]] == ["파란 ", "사과 3개", " 를 샀다"]
    assert [x[0] for x in got[3]] == ["빨간 ", "사과 3개", " 를 샀다!"] and got[3][-1][2:] == (True, False, "u")
    assert [x[:2] for x in got[6]] == [("빨간 ", False), ("사과 3개", True)]


def test_markdown_runs():
    plain = (False, False, False, None)
    assert X.markdown_runs("a **b *c*** `d*e` [f **g**](h) ~~i~~") == [("a ", *plain), ("b ", True, False, False, None), ("c", True, True, False, None), (" ", *plain), ("d*e", False, False, True, None), (" ", *plain), ("f ", False, False, False, "h"), ("g", True, False, False, "h"), (" ", *plain), ("i", False, True, False, None)]
    assert X.markdown_runs("2 * 3 * 4 snake_case_name \\*no\\* **open") == [("2 * 3 * 4 snake_case_name *no* **open", *plain)]
    assert X.markdown_runs("a<br>b\nc  \nd ![i](p.png)e") == [("a\nb c\nd e", *plain)] and X.markdown_runs("") == []


def test_markdown_runs_round_trip(spark):
    """What is written from runs is read as the same runs."""
    rng = random.Random(2)
    cases = []
    for _ in range(150):
        words = [("".join(rng.choice("ab*_`[]\\ 가") for _ in range(rng.randrange(1, 6))).strip("` ") or "z", False, False, False, None) for _ in range(3)]
        styled = [(re.sub(r"[`\[\]\\]", "", w[0]).strip() or "y", rng.random() < 0.5, rng.random() < 0.3, False, rng.choice([None, "u/1"])) for w in words]
        cases.append(plain_merged([x for s in styled for x in (s, (" 가 ", False, False, False, None))][:-1]))
    df = spark.createDataFrame([(i, rows_of(c)) for i, c in enumerate(cases)], f"i int, runs array<{R.RUN}>")
    for r in df.orderBy("i").select("i", R.inline_markdown(F.col("runs")).alias("m")).collect():
        assert X.markdown_runs(r["m"]) == cases[r["i"]], r["m"]


def test_pages_keep_styles(spark):
    page = '<h1>T <b>x</b></h1><p>a <b>b <i>c</i></b><br>d <a href="u">e</a> <code>f  g</code></p><p><b>open</p><ul><li> <em>i</em> </li></ul>'
    blocks = H.read_blocks(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html")
    found = blocks.orderBy("ord").select("kind", R.inline_markdown(F.col("runs"))).collect()
    assert [tuple(r) for r in found] == [("heading", "T **x**"), ("paragraph", "a **b** ***c*** d [e](u) `f g`"), ("paragraph", "**open**"), ("item", "*i*")]
    text = sinks.to_markdown(blocks.withColumns({"lang": F.lit(None).cast("string"), "number": F.lit(None).cast("long")}), "id").first()["markdown"]
    assert text.startswith("# T **x**\n\na **b") and "**open**" in text
