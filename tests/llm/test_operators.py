"""The training-data operators on small and odd inputs, against brute force or the public libraries."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.llm import byte_bpe, embedding_dedup, fingerprint, language, main_text, near_duplicates, packing, quality, token_counts, toxicity
from reportloom.llm.common import safe_parts
from reportloom.llm.components import connected_components

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n", "a", "A b", "a  b", "a \n b", " lead and trail ", "日本 語 텍스트", "é à ñ ß", "x y z", "‍﻿", "\x00\x1c\x85", "<|endoftext|> in <|endoftext|>text", "<s> </s> <unk>",
    "it's I'LL don't", "½ ² Ⅷ 12345", "🙂👍🏽", "word " * 3000, "z" * 5000, "ΑΣ Σ", "İstanbul", "é combining", "a\tb\r\nc",
]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def odd_docs(spark):
    """Nulls, repeats and a column whose name clashes with a result's."""
    return docs_of(spark, ODD + ["word " * 3000, None]).withColumns({"score": F.lit("clash"), "n_tokens": F.lit(None), "held_out": F.lit(1), "component_id": F.lit("x"), "length": F.lit(0)})


def test_safe_parts():
    for t in filter(None, ODD):
        assert " ".join(safe_parts(t)) == t


def test_token_counts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(odd_docs(spark), P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    for r, t in zip(got, [*ODD, "word " * 3000, None], strict=True):
        assert (r["n_bytes"], r["n_tokens"]) == (len((t or "").encode()), len(lib.encode(t or ""))), t
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_byte_bpe(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = byte_bpe.encode_digests(odd_docs(spark), P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    for r, t in zip(got, [*ODD, "word " * 3000, None], strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids), t
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_all_characters(name):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(P.path(name)), byte_bpe.load(P.path(name))
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in [*range(0x3000), *range(0xA000, 0xB000), *range(0x1F300, 0x1F700)]] + [t or "" for t in ODD]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abcdetnorsi'.,0") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    for text, e, packed in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode_all(texts), strict=True):
        assert array("I", e.ids).tobytes() == packed, repr(text[:40])


def best_fit_decreasing(sizes, window):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(window - s)
    return sorted(window - r for r in rooms)


def test_plan_equals_piecewise_best_fit():
    rng = random.Random(2)
    for window in (7, 16, 50):
        for _ in range(60):
            sizes = [rng.randrange(1, window + 1) for _ in range(rng.randrange(1, 80))]
            counts = {s: sizes.count(s) for s in set(sizes)}
            filled, seen = {}, {}
            for length, rank, pieces, each, first, offset in packing.plan_best_fit(counts, window):
                for j in range(pieces):
                    filled.setdefault(first + j // each, []).append((offset + j % each * length, length))
                    seen[length] = seen.get(length, 0) + 1
            assert seen == counts
            for spans in filled.values():
                at = 0
                for offset, length in sorted(spans):
                    assert offset == at
                    at += length
                assert at <= window
            assert sorted(filled) == list(range(len(filled)))
            assert sorted(sum(n for _, n in s) for s in filled.values()) == best_fit_decreasing(sizes, window)


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = odd_docs(spark)
    got = packing.pack_documents(df, P.path("word_bpe_49k.json"), window=64).collect()
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate([*ODD, "word " * 3000, None])}
    windows, parts = {}, {}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(array("I", piece).tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans in [*windows.values(), *parts.values()]:
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    assert all(sum(n for _, n in s) <= 64 for s in windows.values())
    assert all(sum(n for _, n in parts[d]) == len(x) for d, x in ids.items())
    sizes = [n for s in parts.values() for _, n in s]
    assert sorted(sum(n for _, n in s) for s in windows.values()) == best_fit_decreasing(sizes, 64)
    assert packing.pack_documents(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    texts = [None, "", "  ", "one", "One", "one two", "ONE  two"]
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(3, 80))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    for n in (2, 5):
        got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs_of(spark, texts), n).collect()}
        sets = {}
        for i, t in enumerate(texts):
            w = (t or "").lower().split()
            sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
        parent = list(range(len(texts)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
        for i in sets:
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root(i), root(i) == i), texts[i]


def test_near_duplicates_odd_rows(spark):
    df = odd_docs(spark)
    assert near_duplicates.near_duplicates(df, 2).count() == df.count()
    assert near_duplicates.near_duplicates(df.limit(0), 2).count() == 0
    nulls = docs_of(spark, ["same text here", "same text here"]).withColumn("doc_id", F.when(F.col("doc_id") == 0, F.lit(None)).otherwise(F.col("doc_id")))
    assert sorted((str(r["doc_id"]), r["kept"]) for r in near_duplicates.near_duplicates(nulls, 2).collect()) == [("1", True), ("None", True)]


def test_bayes_bounds_are_monotone():
    needed = near_duplicates.least_matches(0.8)
    assert [n for n, _ in needed] == list(range(32, 193, 32)) and all(0 < m < 0.8 * n for n, m in needed)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(7)
    rows = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [1.0] * 16, None), (906, [1.0] * 3, 1), (907, [1.0] * 3, 1), (908, [2.0] * 16, 1), (908, [2.0] * 16, 1)]
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 20))):
            rows.append((len(rows), (base + rng.standard_normal(16) * 0.09).tolist(), int(g % 3)))
    df = spark.createDataFrame([(i, v, k) for i, v, k in rows], "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = [tuple(r) for r in embedding_dedup.near_embeddings(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    good = [(n, i, np.array(v), k) for n, (i, v, k) in enumerate(rows) if v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, comp = {n: 0 for n in range(len(rows))}, {n: r[0] for n, r in enumerate(rows)}
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.98]
    for a, b in pairs:
        links[a], links[b] = links[a] + 1, links[b] + 1
    for _ in rows:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    want = [(r[0], links[n], comp[n], comp[n] == r[0]) for n, r in enumerate(rows)]
    assert sum(x[1] for x in got) >= 0.99 * sum(x[1] for x in want)
    assert sorted(x for x in got if x[0] >= 900) == sorted(x for x in want if x[0] >= 900)
    assert np.mean([a == b for a, b in zip(sorted(got), sorted(want), strict=True)]) > 0.98
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = [*ODD, "word " * 3000, "the same words here", "the same words here"]
    got = fingerprint.fingerprint_documents(docs_of(spark, texts)).orderBy(F.desc("doc_id")).collect()
    falling = [t or "" for t in reversed(texts)]
    for r, t, after in zip(got, falling, falling[1:] + falling[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1
    assert fingerprint.fingerprint_documents(docs_of(spark, [])).count() == 0
    assert fingerprint.fingerprint_documents(docs_of(spark, ["alone"])).first()["near_next"] == 1


def test_fingerprint_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    texts = [f"text number {i} of many" for i in range(100)]
    got = fingerprint.fingerprint_documents(docs_of(spark, texts, 1000).repartition(5)).orderBy(F.desc("doc_id")).collect()
    falling = list(reversed(texts))
    assert [r["edited_sha256"] for r in got] == [hashlib.sha256(fingerprint.edited(a, b).encode()).hexdigest() for a, b in zip(falling, falling[1:] + falling[:1], strict=True)]


def test_fingerprint_estimates_jaccard():
    rng, errors = random.Random(8), []
    sampler = fingerprint.Sampler()
    for _ in range(60):
        a = {f"w{i}": rng.randrange(1, 9) for i in range(40)}
        b = {w: n if rng.random() < 0.6 else rng.randrange(1, 9) for w, n in a.items() if rng.random() < 0.8}
        text = lambda bag: " ".join(w for w, n in bag.items() for _ in range(n))
        keys = a.keys() | b.keys()
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        errors.append(fingerprint.likeness(sampler.signature(text(a)), sampler.signature(text(b))) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def auc(score, label):
    order = np.argsort(np.argsort(score))
    label = np.array(label)
    n = label.sum()
    return (order[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_held_out(spark, name):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    if name == "quality":
        model = quality.fit_quality(docs, labels)
        scored = quality.score_quality(docs, model)
        odd = quality.score_quality(odd_docs(spark), model)
    else:
        model = toxicity.fit_toxicity(docs, labels)
        scored = toxicity.score_toxicity(docs, model)
        odd = toxicity.score_toxicity(odd_docs(spark), model)
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows["score"], rows[name]) > (0.9 if name == "quality" else 0.7)
    found = odd.collect()
    assert len(found) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"]: r["held_out"] for r in found} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(ODD) + 2)}


def test_classifiers_without_labels(spark):
    docs, none = docs_of(spark, ["some text", None]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect())
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect())
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0), none)).count() == 0


def test_offending_sentences_are_located(spark):
    clean = [f"The plain sentence number {i} is here. Another one follows it. And a third." for i in range(60)]
    bad = [f"The plain sentence number {i} is here. You are a zorgish fool. And a third." for i in range(60)]
    docs = docs_of(spark, clean + bad)
    labels = docs.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs, labels)
    hits = toxicity.locate(docs, model).collect()
    assert {r["sentence_no"] for r in hits} == {1} and all("zorgish" in r["sentence"] for r in hits) and len(hits) > 50
    assert toxicity.keep_clean(docs, model).count() == 60


PAGES = {
    "<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><div id='content'><h1>Title</h1><p>Hello &amp; world, this\n is <b>text</b>.</p><div class='comments'><p>Good post.</p></div></div><div class=sidebar><p>Other things.</p></div><footer>c</footer>": "Title\nHello & world, this is text.",
    "<article><p>a &lt; b&nbsp;c<aside>side</aside><p>d<br>e</p><form><label>Name</label><input></form><script>var t='</p>';</script></article>": "a < b c\nd e",
    "<main><h1>T</h1><p>Body of the story, told.</p><section id='reader-comments'><p>Nice, thanks.</p></section></main>": "T\nBody of the story, told.",
    "": "",
}


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = main_text.fit_blocks(pages)
    odd = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate([*PAGES, None, "<p", "plain words only", "<div>" * 500 + "deep text", "<![bad[ x"])], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in main_text.extract_pages(odd, weights).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert len(got) == odd.count() and got[len(PAGES)]["text"] == ""
    assert main_text.extract_pages(odd.limit(0), main_text.fit_blocks(odd.limit(0))).count() == 0


PROSE = "The council met on Monday, and it talked about the new bridge. Work begins in spring, they said."
WRAPPED = {
    f"<body><form id='aspnetForm'><div id='top'><a href='/'>Home</a></div><div><h1>Bridge</h1><p>{PROSE}</p><p>{PROSE}</p></div></form><footer>c</footer>": [PROSE, PROSE],
    f"<body><div class='has-sidebar'><article><p>{PROSE}</p></article><div class='sidebar'><p>Other things, also told.</p></div></div><footer><p>{PROSE} {PROSE} {PROSE}</p></footer>": [PROSE],
    f"<main class='content with-sidebar'><p>{PROSE}</p><section class='comments'><p>Good post.</p></section></main>": [PROSE],
    f"<article class='post sharing-enabled'><p>{PROSE}</p><p>{PROSE}</p></article><aside><p>Other things, also told.</p></aside>": [PROSE, PROSE],
    f"<main><article><p>{PROSE}</p></article><div class='comments'><article class='comment'><p>{PROSE} {PROSE}</p></article><article class='comment'><p>{PROSE}</p></article></div></main>": [PROSE],
}


def test_main_text_of_wrapped_pages(spark):
    weights = main_text.fit_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    for html, want in WRAPPED.items():
        assert [line for line in main_text.extract(html, weights).split("\n") if line != "Bridge"] == want, html
    # prose that a word calls outer, amid content of the same parent: the edges outvote the word
    amid = f"<article><p>{PROSE}</p><p class='share'>{PROSE}</p><p>{PROSE}</p></article>"
    assert main_text.extract(amid, weights).count(PROSE) == 3
    assert np.abs(weights[9:]).max() <= main_text.MOST_EVIDENCE


def test_main_text_keeps_formulas_and_fallbacks(spark):
    weights = main_text.fit_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='application/x-tex'>E=m</annotation></semantics></math>"
    html = f"<article><p>{PROSE}</p><p>So {formula}, as was shown.</p><object data='a.pdf'><p>{PROSE}</p></object></article>"
    assert main_text.extract(html, weights).split("\n") == [PROSE, "So E=m, as was shown.", PROSE]


def test_minimum_cut_is_least():
    rng = random.Random(9)
    for _ in range(80):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {i: {} for i in range(n)}
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.5:
                    edges[i][j] = edges[j][i] = rng.uniform(0, 1.5)

        def cost(label, odds=odds, edges=edges, n=n):
            return sum(-o if x else 0 for o, x in zip(odds, label, strict=True)) + sum(edges[i].get(j, 0) for i in range(n) for j in range(i) if label[i] != label[j])

        least = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(main_text.settle(odds, edges)) == pytest.approx(least)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_text_model(docs)
    blank = language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")), model).withColumnRenamed("lang", "found")
    right = blank.join(docs, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").select(F.avg((F.col("found") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98
    html = "<html lang='fr'><body><p>%s</p></body>"
    odd = spark.createDataFrame([(1, None, None), (2, "https://x.example.fr/de/1", html % "123"), (3, "nonsense", html % "the and of the with this that"), (4, "", "<p>")], "page_id long, url string, html string").withColumn("lang", F.lit(0))
    got = {r["page_id"]: r for r in language.identify_pages(odd, model).collect()}
    assert len(got) == 4 and got[1]["lang"] == "und" and got[1]["confidence"] == 0 and got[2]["declared"] == "fr" and got[4]["lang"] == "und"
    assert language.identify_pages(odd.limit(0), model).count() == 0
    kept = language.keep_identified(docs_of(spark, ["the and of", None, "123 456"]), model).collect()
    assert 0 in {r["doc_id"] for r in kept}


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았다.",
    "xq zvkj wpfh qqzx jkvw zzpq hfgk xwvq bnmk qzxj ptkd wqxz kkjv pqzf xvbn",
    "12 345 -- 6.789 !!",
]


def test_language_of_texts_outside_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = docs_of(spark, [t for t in FOREIGN for _ in range(2)] + [FOREIGN[0] * 40], 10_000_000)
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(planted)
    model = language.fit_text_model(both)
    kept = {r["doc_id"] for r in language.keep_identified(both, model).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10_000_000]
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
    pages = spark.createDataFrame([(i, "https://x.example.org/en/1", f"<html lang='en'><body><p>{t}</p></body>") for i, t in enumerate(FOREIGN)], "page_id long, url string, html string")
    assert {(r["lang"], r["confidence"]) for r in language.identify_pages(pages, model).collect()} == {("und", 0.0)}


def test_language_of_many_labels(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(30)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(words[lang], k=60)), lang, "src0") for i, lang in enumerate([*words] * 20)] + [(9999, "a lone label", "odd", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit_text_model(docs)
    assert set(model.languages) == set(words)
    blank = language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")), model).where("doc_id < 9999")
    found = {r["doc_id"]: r["lang"] for r in blank.collect()}
    assert all(found[i] == lang for i, _, lang, _ in rows[:-1])
