"""Scores of op1 and op10 recomputed row by row, and texts of megabytes through every operator on texts and pages."""

import hashlib
import html
import re
from array import array
from urllib.parse import urlsplit

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from reportloom.llm import byte_bpe, fingerprint, language, main_text, quality, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_quality_scores_recomputed(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    assert model.good and model.bad and model.good != model.bad and model.slope > 0

    def size(raw, d):
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False)
        return sum(len(compressor.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))

    rows = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()} | {-1: b""}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None)], "doc_id long, text string")).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    assert got.keys() == rows.keys()
    for i, raw in rows.items():
        gap = (size(raw, model.bad) - size(raw, model.good)) / len(raw) if raw else 0.0
        want = 1 / (1 + np.exp(-np.clip(model.slope * gap + model.constant, -30, 30)))
        assert abs(got[i]["score"] - want) < 1e-12 and got[i]["predicted"] == (want >= 0.5)


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def test_page_languages_recomputed(spark):
    """The fusion of text, declared markup, address suffix and host, from the definitions, page by page."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    odd = [(10_001, "//User@Host.example.org:8080/de?x=1", '<HTML class="a" xml:lang=DE-at><p>12 34</p>'), (10_002, None, None), (10_003, "https://other.example.net/x", "<p>" + re.sub("<[^>]*>", " ", pages[0]["html"])[:400] + "</p>"), (10_003, "", "<html lang='fr'><p>le la les des une</p>")]
    rows = [tuple(r) for r in pages] + odd
    model = language.fit_text_model(spark.read.parquet(f"{SF}/documents.parquet"))
    n, facts = len(model.languages), []
    for i, url, page in rows:
        text = re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", page or ""))
        ll, told = model.evidence(html.unescape(text))
        parts = urlsplit(url or "")
        host = (parts.hostname or "") if parts.netloc else ""
        first = parts.path.split("/")[1] if parts.path.count("/") else ""
        first = re.split("[-]", first)[0] if re.match(r"[A-Za-z]{2}(-|$)", first) else ""
        declared = re.search(r"(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})", page or "")
        facts.append((i, ll, told, declared[1].lower() if declared else "", host.rpartition(".")[2] + "/" + first.lower(), host, ".".join(host.split(".")[-2:])))
    votes = [softmax(f[1]) if f[2] else np.zeros(n) for f in facts]
    whole, tables = sum(votes), [{}, {}, {}, {}]
    for v, f in zip(votes, facts, strict=True):
        for t, key in zip(tables, f[3:], strict=True):
            t[key] = t.get(key, 0) + v
    smooth = lambda counts, prior, weight: (counts + prior * weight) / (counts.sum() + weight)
    want = []
    for v, (i, ll, told, declared, suffix, host, domain) in zip(votes, facts, strict=True):
        rest = [np.maximum(t[k] - v, 0) for t, k in zip(tables, (declared, suffix, host, domain), strict=True)]
        prior = smooth(rest[2], smooth(rest[3], smooth(whole, np.full(n, 1 / n), 1.0), language.SMOOTH_DOMAIN), language.SMOOTH_HOST)
        odds = ll + np.log(prior + 1e-12)
        for key, counts in (((declared, rest[0]), (suffix if suffix != "/" else "", rest[1]))):
            if key:
                odds = odds + np.log((counts + language.SMOOTH_TABLE) / (whole + language.SMOOTH_TABLE * 10))
        post = softmax(odds)
        want.append((str(i), model.languages[int(post.argmax())] if told else "und", float(post.max()) if told else 0.0, declared, host))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    got = sorted((str(r["page_id"]), r["lang"], r["confidence"], r["declared"], r["host"]) for r in language.identify_pages(df, model).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and a[3:] == b[3:]
    assert {w[1] for w in want} > {"und"}


def test_megabytes_through_every_operator(spark):
    docs, labels, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages"))
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0 and quality = 1"), "doc_id").where("lang = 'en'").limit(20).collect()]
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").first()["text"]
    long = "\n".join(clean * 60)
    long = (long + " ") * (1 + 1_200_000 // len(long))
    texts = {1: long, 2: long + "\n" + toxic, 3: "x" * 1_200_000, 4: "short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    model = toxicity.fit_toxicity(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    _, whole = toxicity.make_scorer(model)
    assert {i: round(s, 12) for i, s in scores.items()} == {i: round(whole(t), 12) for i, t in texts.items()}
    good = quality.fit_quality(docs, labels)
    measured = quality.difference_of(good.good, good.bad)(list(texts.values()))
    assert np.allclose([r["score"] for r in quality.score_quality(df, good).orderBy("doc_id").collect()], good.score(measured))
    found = {r["doc_id"]: r["lang"] for r in language.identify_documents(df, language.fit_text_model(docs)).collect()}
    assert found[1] == found[2] == "en" and len(found) == 4
    prints = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(df).collect()}
    assert all(prints[i]["n_chars"] == len(t) for i, t in texts.items()) and len({r["fingerprint"] for r in prints.values()}) >= 3

    import sentencepiece
    from tokenizers import Tokenizer

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, P.path("piece_bpe_32k.model")).collect()} == {i: len(lib.encode(t)) for i, t in texts.items()}
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = {i: other.encode(t, add_special_tokens=False).ids for i, t in texts.items() if i != 3}  # the library takes minutes on one word of a megabyte
    for r in byte_bpe.encode_digests(df.where("doc_id != 3"), P.path("byte_bpe_50k.json")).collect():
        assert r["n_tokens"] == len(some[r["doc_id"]]) and r["ids_sha256"] == hashlib.sha256(array("I", some[r["doc_id"]]).tobytes()).hexdigest()
    weights = main_text.fit_blocks(pages)
    page = "<html><body><nav><a href='/x'>x</a></nav><article>" + "".join(f"<p>{html.escape(t)}</p>" for t in clean * 30) + "</article></body></html>"
    text = main_text.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), weights).first()["text"]
    assert text == "\n".join(" ".join(t.split()) for t in clean * 30)
