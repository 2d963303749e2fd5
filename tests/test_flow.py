"""Page flow against a plain reading of its rules, over whole documents and with closer lines."""

import random

from pyspark.sql import functions as F

from reportloom.operators import flow as FL

KINDS = ["paragraph", "paragraph", "item", "table", "heading", "page_break", "blank"]


def plain_flow(blocks, usable, margin, least):
    """Every position from scratch: all heights are kept, starts are sums over them."""
    heights = [int(lines + fixed) for _, lines, fixed in blocks]
    scale, y, out = [1.0] * len(blocks), 0, []
    for i, (kind, _, _) in enumerate(blocks):
        moved, empty = False, 0
        if kind == "page_break" and y % usable:
            y += usable - y % usable
        end = y - y % usable + usable
        if kind == "table" and 0 < heights[i] <= usable and y + heights[i] > end:
            window = [j for j in range(i) if blocks[j][0] in ("paragraph", "item") and sum(heights[:j]) >= end - usable and scale[j] == 1.0]
            best = None
            for k in range(99, 0, -1):
                if k / 100 < least - 1e-9 or best or not window or least >= 1:
                    break
                new = {j: int(blocks[j][1] * (k / 100) + blocks[j][2]) for j in window}
                if sum(heights[j] - new[j] for j in window) >= y + heights[i] - end + margin:
                    best = k / 100, new
            if best:
                y -= sum(heights[j] - n for j, n in best[1].items())
                for j, n in best[1].items():
                    heights[j], scale[j] = n, best[0]
            else:
                moved, empty, y = True, end - y, end
        out.append([y, moved, empty])
        y += heights[i]
    return [(i, y, y // usable, heights[i], scale[i], moved, empty) for i, (y, moved, empty) in enumerate(out)]


def test_flow_against_plain_python(spark):
    rng = random.Random(3)
    for margin, least in ((0, 1.0), (0, 0.9), (7, 0.8), (0, 0.5)):
        docs = {f"d{d}": [(k, float(rng.randrange(1, 60)) if k != "page_break" else 0.0, rng.randrange(4) if k != "page_break" else 0) for k in rng.choices(KINDS, k=rng.randrange(1, 60))] for d in range(12)}
        docs[None] = [("table", 500.0, 0), ("table", 90.0, 0), ("paragraph", 20.0, 0), ("table", 85.0, 0)]
        rows = [(d, i, *b) for d, blocks in docs.items() for i, b in enumerate(blocks)]
        rng.shuffle(rows)
        got = FL.page_flow(spark.createDataFrame(rows, "doc_id string, ord long, kind string, lines_height double, fixed long"), 100, margin, least).collect()
        for d, blocks in docs.items():
            want = plain_flow(blocks, 100, margin, least)
            assert sorted((r["ord"], r["y"], r["page"], r["height"], r["scale"], r["moved"], r["left_empty"]) for r in got if r["doc_id"] == d) == want
        assert len(got) == len(rows)
    assert FL.page_flow(spark.createDataFrame([], "doc_id string, ord long, kind string, lines_height double, fixed long"), 100).count() == 0


def test_heights_and_spaces(spark):
    page = FL.Page(width=1000, height=5000, body=FL.Font(100, 1.0, 3, 4), headings={1: FL.Font(200, 1.5, 10, 20)}, code=FL.Font(100, 1.0, 3, 4), levels=(FL.Level(0, 1, 5, (6, 60), (7, 70), (8, 80)), FL.Level(500, 2, 15, (16, 17), (18, 19), (20, 21))), table_after=9)
    rows = [(1, 0, "heading", 1, None, "a" * 21), (1, 1, "item", None, 0, "b" * 41), (1, 2, "item", None, 1, "c" * 11), (1, 3, "item", None, 1, "d"), (1, 4, "item", None, 0, "e"), (1, 5, "table", None, None, ""), (1, 6, "item", None, 0, "f"), (1, 7, "paragraph", None, None, "가" * 11), (1, 8, "code", None, None, "x\ny"), (1, 9, "blank", None, None, "")]
    got = FL.block_heights(spark.createDataFrame(rows, "doc_id long, ord long, kind string, level long, depth long, text string"), page).orderBy("ord").collect()
    body, big = 120.0, 360.0
    assert [round(r["lines_height"] / (big if r["kind"] == "heading" else body), 6) for r in got] == [3, 3, 2, 1, 1, 0, 1, 2, 2, 1]
    assert [r["fixed"] for r in got] == [30, 7 + 7, 15 + 7, 16 + 7, 8 + 7 + 1, 0, 8 + 7 + 9, 7, 7, 0]
    assert [r["extra"] for r in got] == [0, 63, 0, 1, 72, 0, 72, 0, 0, 0]


def test_relaxed_documents_and_stretched_tables(spark):
    rows = [("room", 0, "item", 30.0, 0, 10), ("room", 1, "table", 40.0, 0, 0), ("full", 0, "item", 90.0, 0, 10), ("pushed", 0, "item", 55.0, 0, 10), ("pushed", 1, "table", 40.0, 0, 0), ("pushed", 2, "paragraph", 20.0, 0, 0), ("none", 0, "paragraph", 10.0, 0, 0)]
    placed, plan = FL.flow_plan(spark.createDataFrame(rows, "doc_id string, ord long, kind string, lines_height double, fixed long, extra long"), 100)
    assert {r["doc_id"]: (r["height"], r["pages"], r["spare"], r["relaxed"]) for r in plan.collect()} == {"room": (70, 1, 30, True), "full": (90, 1, 10, False), "pushed": (115, 2, 85, False), "none": (10, 1, 90, False)}
    assert {(r["doc_id"], r["ord"]): r["y"] for r in placed.collect()} == {("room", 0): 0, ("room", 1): 40, ("full", 0): 0, ("pushed", 0): 0, ("pushed", 1): 55, ("pushed", 2): 95, ("none", 0): 0}
    on = placed.where("doc_id in ('room', 'pushed')").withColumn("kind", F.when(F.col("ord") == 1, "table").otherwise("item")).withColumn("table_rows", F.lit(4))
    assert [tuple(r) for r in FL.stretched_rows(on, 100, 0.9).collect()] == [("room", 1, 2)]
    assert [tuple(r) for r in FL.stretched_rows(on, 100, 0.9, 1).collect()] == [("room", 1, 1)]
