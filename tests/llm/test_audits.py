"""Quality rules, source divergence and spelling variants against plain Python, and on odd rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.llm import divergence, quality_rules, variants

CLASH = ["n_words", "kept", "rate", "bin", "n", "value", "part", "word", "rank", "term", "p", "z", "gid", "id", "__text", "low_symbols"]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def plain_judge(rows):
    """(measures, base_failed, kept) of each row (id, text, lang, source)."""
    found = [plain_measures(r[1]) for r in rows]
    groups = [((r[2] or ""), (r[3] or "")) for r in rows]
    base = [m[0] < 50 or 100 * m[4] > 50 * m[0] for m in found]
    rates = [(1000 * m[1] // max(m[0], 1), 1000 * m[2] // max(m[0], 1), 1000 * m[3] // max(m[5], 1), 1000 * m[4] // max(m[0], 1)) for m in found]

    def fence(picked, k):
        cut = lambda v: (v >> max(v.bit_length() - 7, 0)) << max(v.bit_length() - 7, 0)
        values = sorted(cut(rates[i][k]) for i in picked)
        q1, q3 = (values[-(-len(values) * q // 4) - 1] for q in (1, 3))
        width = 3 * max(q3 - q1, (500, 33, 133, 100)[k])
        return len(values), max(q1 - width, 0), q3 + width

    drawn = lambda own, above: (own[0], *((own[0] * own[s] + 100 * above[s]) // (own[0] + 100) for s in (1, 2)))
    out = []
    for i in range(len(rows)):
        kept = not base[i]
        for k in range(4) if kept else ():
            levels = [fence([j for j in range(len(rows)) if not base[j] and groups[j][:n] == groups[i][:n]], k) for n in (0, 1, 2)]
            _, low, high = drawn(levels[2], drawn(levels[1], levels[0]))
            kept = kept and rates[i][k] <= high and (k > 0 or rates[i][k] >= low)
        out.append((found[i][:5], base[i], kept))
    return out


def test_quality_rules_against_plain_python(spark):
    rng = random.Random(4)
    small = ["the", "of", "a b", "b\nc", "x", "x\n", "#", "naïve", "語", "🙂", "\t", "long" * 6]
    rows = []
    for i in range(120):
        words = [rng.choice(small) if rng.random() < 0.1 * (i % 7) else f"w{rng.randrange(10 ** (1 + i % 5))}" for _ in range(rng.randrange(140))]
        text = "\n".join(" ".join(words[a : a + 9]) for a in range(0, len(words), 9)) + rng.choice(["", "\n"]) + " $$$" * (40 * (i % 11 == 0))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None])))
    rows += [(1, None, "en", "s1"), (None, "", None, None), (None, "q " * 60, "en", "s1"), (7, "a\n" * 60, "en", "new"), (500, "one two three " * 2 + " ".join(f"u{i}" for i in range(60)), "xx", "new")]
    got = sorted(((str(r["doc_id"]), *(r[c] for c in quality_rules.MEASURES), r["base_failed"], r["kept"]) for r in quality_rules.judge(table(spark, rows)).collect()))
    want = sorted(((str(r[0]), *m, b, k) for r, (m, b, k) in zip(rows, plain_judge(rows), strict=True)))
    assert got == want
    assert {w[-2:] for w in want} == {(True, False), (False, True), (False, False)}
    failed = quality_rules.judge(table(spark, rows)).where("not base_failed")
    assert failed.where("kept != (size(failed) = 0)").count() == 0 and failed.where("array_contains(failed, 'symbols')").count() > 0


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.judge(table(spark, [(1, "a", "en", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sketches_merge_exactly(spark):
    """The sketch of a union is the merged sketch of its parts, and a quartile is off by its bin's width at most."""
    values = [random.Random(5).randrange(10**k) for k in (2, 4, 6, 9) for _ in range(500)]
    df = spark.createDataFrame([("a" if i % 3 else "b", 1000, v * 1, 0, 0, 0, 1) for i, v in enumerate(values)], "g string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    rows = lambda x: sorted(map(tuple, x.where("rate = 0").collect()))
    assert rows(quality_rules.merged(quality_rules.sketches(df, ["g"]), [])) == rows(quality_rules.sketches(df, []))
    limits = quality_rules.limits_of(quality_rules.sketches(df, []), [], "a").where("rate = 0").first()
    q1, q3 = (sorted(values)[len(values) * q // 4 - 1] for q in (1, 3))
    assert abs(limits["ahigh"] - (q3 + 3 * (q3 - q1))) <= 4 * q3 / 64


def plain_divergence(rows, least):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    groups = [((r[2] or ""), (r[3] or "")) for r in rows]
    out = []
    for lang in {g[0] for g in groups}:
        docs = collections.Counter(t for g, own in zip(groups, terms, strict=True) if g[0] == lang for t in set(own))
        kept = [t for t, n in docs.items() if n >= least]

        def shares(picked):
            n = collections.Counter(t for g, own in zip(groups, terms, strict=True) if picked(g) for t in own if t in set(kept))
            return n, {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        sources = {g[1] for g in groups if g[0] == lang}
        of, q = {s: shares(lambda g, s=s: g == (lang, s)) for s in sources}, shares(lambda g: g[0] == lang)[1]
        for s in sources:
            pairs = sorted(((-sum(abs(of[s][1][t] - of[o][1][t]) for t in kept), o.encode(), o) for o in sources - {s}))
            over = sorted((-(of[s][1][t] - q[t]), t.encode(), t) for t in kept if of[s][0][t] and of[s][1][t] > q[t])[:50]
            out += [(lang, s, part, x[2], -x[0], i + 1) for part, found in (("pair", pairs), ("term", over)) for i, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("light", [0, 2, 100])
def test_divergence_against_plain_python(spark, monkeypatch, light):
    rng = random.Random(6)
    for name, value in (("LEAST_DOCS", 3), ("LIGHT", light), ("TILE_GROUPS", 2), ("TILE_TERMS", 4), ("MOST_COUNTS", 40), ("MOST_PAIRS", 5)):
        monkeypatch.setattr(divergence, name, value)
    vocabulary = [f"{a}{b}" for a in ("ab", "É", "zé", "語") for b in "cdefgh"]
    rows = []
    for i in range(150):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", "s4", "S5", "é6", None])
        text = " ".join(rng.choice(vocabulary[hash_of(source) % 9 : 12 + i % 13]) + rng.choice(["", ",", "X", "1"]) for _ in range(rng.randrange(25)))
        rows.append((i, text, rng.choice(["en", "en", "de"]), source))
    rows += [(1, None, "en", "only"), (None, "ABC", None, None), (None, None, None, "s1"), (3, "abc abc abc", "en", "s1"), (3, "abc abc abc", "en", "s1")]
    got = sorted(map(tuple, divergence.source_divergence(table(spark, rows)).collect()))
    assert got == plain_divergence(rows, 3)
    assert divergence.source_divergence(table(spark, rows).limit(0)).count() == 0


def hash_of(text):
    return zlib.crc32(str(text).encode())


def test_tiles_and_corrections_agree():
    """The dense and the sparse way give the same sums for the same postings, in blocks or whole."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        groups, terms = rng.integers(2, 9), rng.integers(1, 12)
        z, there = rng.integers(1, 50, groups), rng.random((terms, groups)) < 0.6
        p = z[None, :] + rng.integers(0, 10**9, (terms, groups))
        want = {}
        for t, a, b in itertools.product(range(terms), range(groups), range(groups)):
            if a < b and there[t, a] and there[t, b]:
                x, y = p[t, a], p[t, b]
                want[a, b] = want.get((a, b), 0) + abs(x - y) - abs(x - z[b]) - abs(z[a] - y) + abs(z[a] - z[b])
        want = {k: v for k, v in want.items() if v}
        own = [np.nonzero(t)[0] for t in there]
        a, b, v = divergence.corrections(own, [p[k][g] for k, g in enumerate(own)], [z[g] for g in own])
        assert {(i, j): x for i, j, x in zip(a, b, v, strict=True) if x} == want
        term, gid = np.nonzero(there)
        for cut in (None, groups // 2):
            a, b, v = divergence.tile(gid, term, p[term, gid], z[gid], cut)
            assert {(i, j): x for i, j, x in zip(a, b, v, strict=True) if x} == {k: x for k, x in want.items() if cut is None or k[0] < cut <= k[1]}


def plain_variants(rows):
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = {w: [x for x in words if x != w and ((len(x) == len(w) and sum(a != b for a, b in zip(x, w, strict=True)) == 1) or x in less(w) or w in less(x))] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] and max(map(words.get, near[w])) >= 5 * words[w] else None for w in words}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words.get(form[w]) or 0) for w in words)


def test_variants_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(variants, "MOST_COUNTS", 20)
    rng = random.Random(8)
    base = ["garden", "gardens", "ärgern", "Straßen", "aabbaabb", "mississippi"]
    words = base + ["".join(rng.choice("gardensxé") if rng.random() < 0.15 else c for c in w) for w in base for _ in range(40)]
    words += [w[:i] + w[i + 1 :] for w in base for i in range(0, len(w), 2)] + [w[:3] + "a" + w[3:] for w in base]
    often = {w: 6 ** rng.randrange(4) for w in words}
    rows = [(i, " ".join(rng.choices(words, [often[w] for w in words], k=120)) + rng.choice(["", " ÷ x×yabcd 1garden2 GARDEN"]), "en", "s") for i in range(150)]
    rows += [(None, "gardens " * 7, None, None), (3, None, None, None), (3, "", None, None), (3, "garden " * 9, None, None)]
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in variants.spelling_variants(table(spark, rows)).collect())
    want = plain_variants(rows)
    assert got == want and any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 5 for w in want)
    assert variants.spelling_variants(table(spark, rows).limit(0)).count() == 0


def test_audits_of_megabytes(spark):
    text = " ".join(f"gardens{i % 977} tuliparum" for i in range(150_000))
    rows = [(1, text, "en", "s1"), (2, "tulipanum " * 5, "en", "s2")]
    df = table(spark, rows)
    r = quality_rules.judge(df).where("doc_id = 1").first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (300_000, 300_000, True, False)
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in variants.spelling_variants(df).collect()) == plain_variants(rows)
    assert divergence.source_divergence(df).where("part = 'pair'").count() == 2


def test_variants_broadcast_nothing(spark):
    rows = [(i, "kleiner Garten kleinet Gärten grosses Garden " * 6) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (variants.spelling_variants(docs), variants.replacements(variants.word_counts(docs))):
        part.collect()
        assert "Broadcast" not in part._jdf.queryExecution().executedPlan().toString()
