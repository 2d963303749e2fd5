import random

from pyspark.sql import functions as F

from reportloom.operators import stats as S
from reportloom.operators import structure as B

BLOCK = "doc_id long, ord long, kind string, level int, depth int, text string"


def blocks(spark, *docs):
    rows = [(d, i, *b) for d, doc in enumerate(docs) for i, b in enumerate(doc)]
    return spark.createDataFrame(rows, BLOCK)


def texts(df, doc=0):
    return [r["text"] for r in df.where(F.col("doc_id") == doc).orderBy("ord").collect()]


def test_settle_blank_lines(spark):
    b, p, t = ("blank", None, None, ""), lambda x: ("paragraph", None, None, x), ("table", None, None, "T")
    df = blocks(spark, [b, p("a"), b, b, p("b"), b, ("page_break", None, None, "PB"), b, p("[표]"), b, t, b, p("c"), b])
    assert texts(B.settle_blank_lines(df)) == ["a", "", "b", "PB", "[표]", "T", "c"]
    assert texts(B.settle_blank_lines(df, keep=False)) == ["a", "b", "PB", "[표]", "T", "c"]


def greedy(items, most):
    out, i = [], 0
    while i < len(items):
        a = items[i]
        b = items[i + 1] if i + 1 < len(items) else None
        if b and a[0] == b[0] == "item" and a[2] == b[2] and len(a[3]) + len(b[3]) + 3 <= most:
            out.append(f"{a[3]} 및 {b[3]}")
            i += 2
        else:
            out.append(a[3])
            i += 1
    return out


def test_merge_short_items_is_greedy(spark):
    rng = random.Random(3)
    docs = [[(rng.choice(["item", "item", "item", "paragraph"]), None, rng.randrange(2), "x" * rng.randrange(1, 14)) for _ in range(30)] for _ in range(12)]
    merged = B.merge_short_items(blocks(spark, *docs), 20)
    for d, doc in enumerate(docs):
        assert texts(merged, d) == greedy(doc, 20)


def test_levels_numbers_captions_notes(spark):
    df = blocks(spark, [("heading", 2, None, "A"), ("item", None, 0, "a"), ("item", None, 0, "b"), ("heading", 2, None, "B"), ("item", None, 0, "c")])
    folded = B.fold_levels(df)
    assert [r["depth"] for r in folded.orderBy("ord").collect()] == [0, 1, 1, 0, 1]
    assert [r["number"] for r in B.number_items(folded).orderBy("ord").collect()] == [1, 1, 2, 2, 1]
    table = blocks(spark, [("paragraph", None, None, "[표 1]"), ("table", None, None, "T"), ("paragraph", None, None, "※ 주의"), ("paragraph", None, None, "* 둘"), ("paragraph", None, None, "본문"), ("paragraph", None, None, "※ 떨어진 주석")])
    done = B.attach_notes(B.attach_captions(table)).orderBy("ord").collect()
    assert [r["text"] for r in done] == ["T", "본문", "※ 떨어진 주석"] and done[0]["caption"] == "[표 1]" and done[0]["notes"] == ["※ 주의", "* 둘"]


def test_merge_documents(spark):
    df = blocks(spark, [("paragraph", None, None, "a"), ("paragraph", None, None, "b")], [("paragraph", None, None, "c")]).withColumn("place", -F.col("doc_id"))
    whole = B.merge_documents(df, "place", breaks=True).orderBy("position").collect()
    assert [(r["position"], r["kind"], r["text"]) for r in whole] == [(1, "page_break", ""), (2, "paragraph", "c"), (3, "page_break", ""), (4, "paragraph", "a"), (5, "paragraph", "b")]


def test_grid_columns(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 0, 1, 2, 1), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1)], "table_id long, row_idx long, cell_idx long, colspan long, rowspan long")
    assert [r["grid_col"] for r in B.grid_columns(cells).orderBy("row_idx", "cell_idx").collect()] == [0, 1, 1, 2]


def test_page_closure_stops_at_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 3, 2), (3, 4, 1), (4, 5, 1), (5, 6, 1)], "page long, includes long, position long")
    found = {(r["root"], r["page"]): r["path"] for r in B.page_closure(edges).collect()}
    assert found[1, 2] == "1>2" and found[1, 5] == "1>2>3>4>5" and (1, 1) not in found and (1, 6) not in found


def test_distribution_is_nearest_rank(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(50)) for g in range(3) for _ in range(rng.randrange(1, 60))]
    got = {r["g"]: r for r in S.distribution(spark.createDataFrame(rows, "g int, v int"), "v", ["g"]).collect()}
    for g in got:
        v = sorted(x for k, x in rows if k == g)
        at = lambda q, v=v: float(v[min(len(v) - 1, int(q * len(v)))])
        assert (got[g]["n"], got[g]["p25"], got[g]["p50"], got[g]["p75"], got[g]["p90"], got[g]["max"]) == (len(v), at(0.25), at(0.5), at(0.75), at(0.9), float(v[-1]))


def test_blank_runs_and_shares(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "", "", "b", "", "c", "", ""])], "doc_id long, ord long, line string")
    assert [(r["run_no"], r["length"]) for r in S.blank_runs(lines).orderBy("run_no").collect()] == [(1, 2), (2, 1)]
    top = S.top_shares(spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "v string"), "v", n=2).orderBy("rank").collect()
    assert [(r["v"], r["count"], r["share"]) for r in top] == [("x", 2, 0.5), ("y", 1, 0.25)]


def test_pages_spliced_against_plain_python(spark):
    """Random inclusions: what stands in place of each, against a walk over the first paths."""

    import random

    rng = random.Random(5)
    pages = list(range(12))
    rows = []
    for p in pages:
        rows.append((p, 1, "title", f"title {p}", None) if p % 4 else (p, 1, "paragraph", f"untitled {p}", None))
        for o in range(2, 2 + rng.randrange(5)):
            rows.append((p, o, "include", None, rng.choice([*pages, 99, None])) if rng.random() < 0.6 else (p, o, "paragraph", f"{p}.{o}", None))
    of = {p: sorted(r[1:] for r in rows if r[0] == p) for p in pages}
    title = {p: next((t for _, k, t, _ in of[p] if k == "title"), str(p)) for p in pages}

    def first_paths(root, depth, most):
        found, level = {}, [((), (root,))]
        for _ in range(depth):
            level = [(key + (o,), path + (to,)) for key, path in level for o, k, _, to in of[path[-1]] if k == "include" and to in of and to not in path]
            best = {}
            for key, path in level:
                best[path[-1]] = min(best.get(path[-1], (key, path)), (key, path))
            level = list(best.values())
            for key, path in level:
                found[path[-1]] = min(found.get(path[-1], (key, path)), (key, path))
        return dict(sorted(found.items(), key=lambda x: x[1][0])[:most])

    def build(root, depth, most):
        put = first_paths(root, depth, most)

        def walk(page, key, path):
            for o, kind, text, to in of[page]:
                at = key + (o,)
                if kind != "include":
                    if not (kind == "title" and key):
                        yield page, len(key), kind, text, None
                elif to in put and put[to][0] == at:
                    yield to, len(at), "page_break", None, None
                    yield to, len(at), "heading", title[to], None
                    yield from walk(to, at, path + (to,))
                else:
                    why = "missing" if to not in of else "cycle" if to in path else "again" if to in put else "depth" if len(key) >= depth else "most"
                    yield page, len(key), "note", why, to

        return list(walk(root, (), (root,)))

    df = spark.createDataFrame(rows, "page long, ord int, kind string, text string, target long")
    for depth, most in ((1, 40), (3, 40), (4, 3)):
        got = {}
        for r in B.spliced_pages(df, depth, most).orderBy("root", "position").collect():
            got.setdefault(r["root"], []).append(tuple(r)[2:])
        assert got == {p: build(p, depth, most) for p in pages}
    some = B.spliced_pages(df, 3, 40, spark.createDataFrame([(3,), (4,)], "page long")).collect()
    assert {r["root"] for r in some} == {3, 4} and len(some) == sum(len(build(p, 3, 40)) for p in (3, 4))
    assert B.spliced_pages(df.limit(0)).count() == 0
