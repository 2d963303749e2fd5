"""Lines against a plain reading of the rules, and the least closeness by trying all."""

import random

from reportloom.operators import line_fit as LF


def plain_lines(text, rules):
    """Every end of every line is tried, from the longest down."""
    out, offset = [], 0
    for part in text.split("\n"):
        pos = 0
        while True:
            pos += len(part[pos:]) - len(part[pos:].lstrip(" "))
            if pos >= len(part):
                break
            width = lambda a, b, part=part: sum(LF.widths_of(part, rules)[a:b])
            room = max((rules.first if not out and not offset else rules.later) * (1 - rules.margin), width(pos, pos + 1))
            label = part.find(" : ") if rules.keep_label else -1
            letters = lambda a, b, label=label: sum(i >= label for i in range(a, b))
            ends = [i for i in range(pos + 1, len(part) + 1) if i == len(part) or part[i] == " "]
            good = []
            for e in ends:
                if width(pos, e) - room > 1e-6 and width(pos, e) - room > rules.closer * letters(pos, e):
                    break
                good.append(e)
            commas = [e for e in good if width(pos, e) - room <= 1e-6 and part[e - 1] in rules.cut_behind]
            if not good:
                end = next((e for e in range(len(part), pos, -1) if width(pos, e) <= room), pos + 1)
                out.append((offset + pos, offset + end, 0))
            elif commas and commas[-1] < good[-1] < len(part) and commas[-1] - pos >= rules.least_cut * (good[-1] - pos):
                end = commas[-1]
                out.append((offset + pos, offset + end, 0))
            else:
                end = good[-1]
                over = width(pos, end) - room
                steps = next(s for s in range(1000) if over <= 1e-6 or s * rules.step * letters(pos, end) >= over - 1e-6 and s)  if over > 1e-6 else 0
                out.append((offset + pos, offset + end, steps))
            pos = end
        offset += len(part) + 1
    return out


def test_lines_against_plain_python(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "bc", "가", "나다", " ", " ", ", ", "1", ". ", "x" * 9, "\n", " : "]) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["", " ", "\n", None, "끝"]
    for rules in (LF.LineRules(1000, 9_000, 7_000), LF.LineRules(1000, 9_000, 7_000, closer=120, step=10, gap=250), LF.LineRules(1000, 8_000, 8_000, closer=60, step=7, keep_label=True, margin=0.05, cut_behind="")):
        got = LF.with_lines(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", rules).orderBy("i").collect()
        for r, t in zip(got, texts, strict=True):
            assert [(x["start"], x["end"], x["steps"]) for x in r["lines"]] == plain_lines(t or "", rules), (t, rules)


def test_least_closeness(spark):
    rules = LF.LineRules(1000, 6_000, 6_000, closer=300, step=50)
    texts = ["abc", "가나다라마바 사", "가나다 라마바사", "가" * 30, None]
    got = [r["closer"] for r in LF.closest(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", rules, 1).orderBy("i").collect()]

    def tried(t):
        return next((s for s in range(rules.closer // rules.step + 1) if len(LF.fit_lines(t or "", LF.LineRules(1000, 6_000, 6_000, closer=s * 50, step=50, cut_behind=""))) <= 1), None)

    assert got == [tried(t) for t in texts] and got[0] == 0 and got[3] is None and got[1]
