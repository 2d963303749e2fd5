"""Assignment by shared words, review and repair of rewrites, echoes and what a draft leaves out."""

import random

from pyspark.sql import functions as F

from reportloom.operators import drafting as DR


def test_best_overlap_against_plain_python(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    rows = [(s, i, [rng.choice(words) for _ in range(rng.randrange(6))]) for s in ("a", "b") for i in range(25)] + [("c", 1, ["w1"]), ("a", 3, ["w2"])]
    targets = [(s, i, rng.sample(words, rng.randrange(1, 6))) for s in ("a", "b") for i in range(6)]
    made = lambda data, key: spark.createDataFrame(data, f"scope string, {key} long, tokens array<string>")
    for least in (1, 2):
        got = {(r["scope"], r["i"]): (r["t"], r["overlap"]) for r in DR.best_overlap(made(rows, "i"), made(targets, "t"), ["scope"], "i", "t", least=least).collect()}
        want = {}
        for s, i in {r[:2] for r in rows}:
            own = {w for r in rows if r[:2] == (s, i) for w in r[2]}
            shared = {t: len(own & set(x)) for s2, t, x in targets if s2 == s and len(own & set(x)) >= least}
            most = max(shared.values(), default=0)
            best = [t for t, n in shared.items() if n == most]
            want[s, i] = (best[0] if len(best) == 1 else None, most)
        assert got == want
    assert DR.best_overlap(made(rows, "i").limit(0), made(targets, "t"), ["scope"], "i", "t").count() == 0


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "doc long, line_no int, mark string, text string, source string, src array<int>, summary boolean")


def test_review_and_repair(spark):
    rows = [
        (1, 1, "□", "창고 상자 7개 이동", "창고 상자 7개를 옮겼습니다.", [1], False), (1, 2, "-", "상자 9개 이동", "상자 7개를 이동하였습니다.", [2], False), (1, 3, "-", "상자를 옮겼습니다", "상자를 옮겼습니다.", [3], None),
        (1, 4, "-", "비용 9억원", None, [], False), (1, 5, "※", "남은 상자 12개", "상자가 남았습니다.", [4], True), (1, 6, "-", None, None, None, None), (1, 7, "※", "가" * 61, "가" * 61, [5], True), (1, 8, "-", "비용 하락", "비용이 올랐습니다.", [6], False),
    ]
    df = lines_of(spark, rows)
    got = {r["line_no"]: (r["action"], r["text"], r["problems"]) for r in DR.mended(df, ["doc"], 2026, "summary").collect()}
    assert got[1] == ("kept", "창고 상자 7개 이동", []) and got[2] == ("restored", "상자 7개 이동", [])
    assert got[3] == ("fixed", "상자를 옮겼음", []) and got[6] == ("kept", "", [])
    assert got[4][:2] == ("dropped", None) and got[5] == ("dropped", None, ["number"]) and got[7] == ("dropped", None, ["long"])
    assert got[8][0] == "restored" and "올랐" in got[8][1] and got[8][2] == []
    found = {(r["line_no"], r["kind"]) for r in DR.review(df, ["doc"], 2026).collect()}
    assert {(2, "number"), (3, "style:polite"), (5, "number"), (8, "opposite")} <= found and not {n for n, _ in found} & {1, 6}


def test_residue_and_echoes(spark):
    lines = lines_of(spark, [(1, 1, "1", "창고 이동 현황", "", [], False), (1, 2, "□", "창고 이동 현황 보고", "", [1], False), (1, 3, "-", "상자 7개", "", [1, 2], False), (1, 4, "1", "배송 지연 현황", "", [], False), (1, 5, "□", "배송 지연 현황 2건", "", [3], False), (1, 6, "1", "창고 이동 현황", "", [], False), (1, 7, "□", "창고 이동 현황", "", [4], False), (1, 8, "-", None, "", [5], False)])
    assert sorted(r["line_no"] for r in DR.drop_echoes(lines, ["doc"]).collect()) == [1, 3, 4, 5, 6, 8]
    sentences = spark.createDataFrame([(1, i, f"문장 {i * 10}개와 7개") for i in range(1, 7)], "doc long, sent_no int, text string")
    got = {r["sent_no"]: r["numbers"] for r in DR.residue(sentences, lines, ["doc"]).collect()}
    assert got == {5: ["50"], 6: ["60"]}
    assert DR.residue(sentences.limit(0), lines, ["doc"]).count() == 0 and DR.drop_echoes(lines.limit(0), ["doc"]).count() == 0
    assert lines.select(F.round(DR.echo_share(F.lit(""), F.col("text")), 2).alias("x")).where("x is not null").count() == 0
