"""Odd rows for every operator, buckets without a common lead, and the pipeline's stages against plain Python."""

import collections
import itertools
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reportloom.llm import byte_bpe, embedding_dedup, fingerprint, language, main_text, near_duplicates, packing, quality, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
CLASH = ["n_chars", "n_tokens", "score", "held_out", "fingerprint", "near_next", "component_id", "kept", "length", "confidence", "declared", "text_", "id", "doc", "node", "part", "job"]


def table(spark, rows, kind="long"):
    df = spark.createDataFrame([(i, t, "en", "src0") for i, t in rows], f"doc_id {kind}, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (1, None), (None, "one two three four five six"), (None, None), (2, ""), (3, "the and of to in that it is was for on with")]


def operators(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good, toxic, text = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels), language.fit_text_model(docs)
    return {
        "op1": lambda d: quality.score_quality(d, good),
        "op2": lambda d: token_counts.count_tokens(d, P.path("piece_bpe_32k.model")),
        "op5": fingerprint.fingerprint_documents,
        "op6": lambda d: near_duplicates.near_duplicates(d, 2),
        "op7": lambda d: byte_bpe.encode_digests(d, P.path("byte_bpe_50k.json")),
        "op8": lambda d: packing.pack_documents(d, P.path("word_bpe_49k.json")),
        "op9": lambda d: toxicity.score_toxicity(d, toxic),
        "op10": lambda d: language.identify_documents(d, text),
    }


def test_null_and_repeated_ids_clashing_columns_and_empty_tables(spark):
    df = table(spark, ROWS)
    for name, run in operators(spark).items():
        ids = sorted(str(r["doc_id"]) for r in run(df).collect())
        assert ids == sorted(str(i) for i, _ in ROWS), name
        assert run(df.limit(0)).count() == 0, name
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_duplicates.near_duplicates(df, 2).collect()}
    assert found == {(1, 5): 1, (1, 0): 1, (None, 5): None, (None, 0): None, (2, 0): 2, (3, 11): 3}


def test_pages_with_null_and_repeated_ids(spark):
    weights = main_text.fit_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    pages = spark.createDataFrame([(1, "u", "<article><p>Text, and more.</p></article>"), (1, None, None), (None, "u", "<p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((str(r["page_id"]), r["text"]) for r in main_text.extract_pages(pages, weights).collect()) == [("1", ""), ("1", "Text, and more."), ("None", "")]
    assert main_text.fit_blocks(pages).shape == weights.shape


def test_text_of_megabytes(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", ".", "."]) for _ in range(250_000))
    df = table(spark, [(1, text), (2, "short")])
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = lib.encode(text, add_special_tokens=False).ids + [1]
    pieces = [r for r in packing.pack_documents(df, P.path("word_bpe_49k.json")).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
    assert all(zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes()) == r["ids_crc32"] for r in pieces)
    assert near_duplicates.near_duplicates(df).where("doc_id = 1").first()["n_shingles"] > 200_000


def test_marks_before_spaces_are_words_of_their_own():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), byte_bpe.load(P.path("word_bpe_49k.json"))
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "be", "1", ".", ",", "_", "!", ")", " ", "\n", "'s", "é", "..."]) for _ in range(40)) for _ in range(600)]
    for text, e, packed in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode_all(texts), strict=True):
        assert array("I", e.ids).tobytes() == packed, text


def components_of(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, n):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("unlike", [True, False])
def test_one_bucket_of_many_documents(spark, monkeypatch, unlike):
    """All documents in one bucket, cut into many cells: lone unlike ones with a few near pairs among them, or a family
    around one text of which many members are outliers."""
    monkeypatch.setattr(near_duplicates, "bands", lambda: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(near_duplicates, "CELL_SETS", 32)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = []
    for i in range(300):
        words = list(base) if not unlike else [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(rng.randrange(0, 12) if not unlike else 0):
            words[rng.randrange(60)] = f"x{rng.randrange(900)}"
        if unlike and i % 10 == 9:
            words = texts[-5].split()
            words[7] = "changed"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(table(spark, list(enumerate(texts))), 2).collect()}
    assert got == components_of({i: shingles(t, 2) for i, t in enumerate(texts)})


def test_fingerprint_against_a_plain_loop():
    rng = random.Random(9)
    sampler = fingerprint.Sampler()
    for _ in range(20):
        bag = {f"w{rng.randrange(200)}": rng.randrange(1, 6) for _ in range(40)}
        text = " ".join(w for w, n in bag.items() for _ in range(n))
        best = None
        for word, n in bag.items():
            seed = np.array([fingerprint.xxhash.xxh64_intdigest(word)], np.uint64)
            own = fingerprint.term_samples(seed, np.array([float(n)]))[0]
            r = fingerprint.gamma(fingerprint.draws(seed, 0))[0].astype(float)
            b = ((fingerprint.draws(seed, 0)[0] & np.uint64(0x3FFFF)).astype(float) + 0.5) / 2**18
            c = fingerprint.gamma(fingerprint.draws(seed, 1))[0].astype(float)
            t = np.floor(np.log(n) / r + b)
            score = np.log(c) - r * (t - b + 1)
            kept = (own >> np.uint64(32)).astype(np.uint32)
            sign = np.where(kept >> np.uint32(31), kept ^ np.uint32(0x80000000), ~kept).view(np.float32)
            assert np.allclose(sign, score, atol=1e-2, rtol=1e-3)
            best = own if best is None else np.minimum(best, own)
        assert (sampler.signature(text) == best.astype(np.uint32)).all()


def test_fingerprints_of_text_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 5)
    rows = [(f"k{i:03}", f"text number {i} of many") for i in range(60)] + [(None, "without an id")]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprint_documents(table(spark, rows, "string").repartition(4)).collect()}
    falling = sorted(rows, key=lambda r: r[0] or "", reverse=True)
    for (i, t), (_, after) in zip(falling, falling[1:] + falling[:1], strict=True):
        assert got[i] == fingerprint.hashlib.sha256(fingerprint.edited(t, after).encode()).hexdigest()


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def plain_languages(rows, model):
    """Ids that the language stage keeps, recomputed row by row."""
    found = [(i, *model.evidence(t or ""), (lang or "").strip().lower(), source or "") for i, t, lang, source in rows]
    n = len(model.languages)
    votes = [softmax(ll) if told else np.zeros(n) for _, ll, told, _, _ in found]
    whole, declared, hosts, domains = sum(votes), {}, {}, {}
    domain = lambda host: ".".join(host.split(".")[-2:])
    for v, (_, _, _, d, h) in zip(votes, found, strict=True):
        for known, key in ((declared, d), (hosts, h), (domains, domain(h))):
            known[key] = known.get(key, 0) + v
    smooth = lambda counts, prior, weight: (counts + prior * weight) / (counts.sum() + weight)
    kept = set()
    for v, (i, ll, told, d, h) in zip(votes, found, strict=True):
        prior = smooth(whole, np.full(n, 1 / n), 1.0)
        prior = smooth(np.maximum(domains[domain(h)] - v, 0), prior, language.SMOOTH_DOMAIN)
        prior = smooth(np.maximum(hosts[h] - v, 0), prior, language.SMOOTH_HOST)
        odds = ll + np.log(prior + 1e-12)
        if d:
            odds = odds + np.log((np.maximum(declared[d] - v, 0) + language.SMOOTH_TABLE) / (whole + language.SMOOTH_TABLE * 10))
        if told and softmax(odds).max() >= 0.5:
            kept.add(i)
    return kept


def test_pipeline_against_plain_python(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    long = [r for r in docs.collect() if len(r["text"] or "") > 400][:5]
    copies = [(10_000_000 + i, r["text"].replace(r["text"].split()[3], "changed", 1), r["lang"], r["source"], len(r["text"])) for i, r in enumerate(long)]
    odd = [(20_000_000, "12 345 -- 6.789 !!", "en", "src0", 18), (20_000_001, "xq zvkj wpfh qqzx jkvw zzpq hfgk xwvq bnmk qzxj ptkd wqxz kkjv pqzf xvbn " * 5, "en", "src0", 400)]
    both = docs.unionByName(spark.createDataFrame(copies + odd, docs.schema))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.select("doc_id", "text", "lang", "source").collect()
        if name == "toxicity":
            _, whole = toxicity.make_scorer(toxicity.fit_toxicity(kept, labels))
            want = {r["doc_id"] for r in before if whole(r["text"] or "") < 0.7}
        elif name == "language":
            want = plain_languages([tuple(r) for r in before], language.fit_text_model(kept))
            assert not want & {20_000_000, 20_000_001}
        else:
            of = components_of({r["doc_id"]: shingles(r["text"] or "", 5) for r in before})
            want = {i for i, c in of.items() if i == c}
            assert not want & {c[0] for c in copies}
        kept = corpus_pipeline.written(stage(spark, kept, str(tmp_path)))
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want, name
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in kept.collect()}
    pieces, windows = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert zlib.crc32(array("I", ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]).tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces == {i: len(x) for i, x in ids.items()}
    for spans in windows.values():
        assert sum(n for _, n in spans) <= 2048 and [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]


def test_vectors_of_any_size(spark, monkeypatch):
    """Squares that over- or underflow, one vector of very many components, and codes of folded vectors."""
    rng = np.random.default_rng(3)
    base, far = rng.standard_normal(40), rng.standard_normal(40)
    freak = rng.standard_normal(100_000)
    rows = [(1, base * 1e200), (2, base * 1e-200), (3, base), (4, far), (5, far * 1e-320), (6, freak), (7, freak * 3), (8, np.full(40, 1.7e308)), (9, np.full(40, 5e-324))]
    data = [(i, v.tolist(), 1) for i, v in rows]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "LEARN_DIMS", 16)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_embeddings(df).collect()}
    tiny = far * 1e-320  # its components have few bits left
    close = tiny / np.abs(tiny).max() @ far / np.linalg.norm(tiny / np.abs(tiny).max()) / np.linalg.norm(far) >= 0.98
    assert {i: got[i] for i in (1, 2, 3, 6, 7, 8, 9)} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 8)}
    assert got[5] == ((1, 4) if close else (0, 5))


def test_tables_grow_with_the_largest_label():
    """Longer substrings for more vectors, and as many tables as the stated probability of a miss needs at the least
    distance from the mean at which they are used."""
    for most, dims, far in itertools.product((1, 10**5, 10**7, 10**10), (8, 64, 256), (0.1, 0.5, 1.0)):
        bits, turns, near, upto = embedding_dedup.plan_tables(most, dims, 0.98, far * np.linspace(0.9, 1.0, 500))
        agree = (1 - 2 * np.arcsin(0.1 / near) / np.pi) ** bits
        assert bits == min(dims, 30, max(12, int(np.ceil(np.log2(max(1, most / 64))))))
        assert (1 - agree) ** (turns * (dims // bits)) <= 1.001e-7 and upto >= near + 0.2
        assert turns == 1 or (turns - 1) * (dims // bits) < embedding_dedup.MOST_TABLES


def cone(rng, n, dims, mean, spread=1.0):
    """Unit noise around a common direction ``mean`` times as long, each vector followed by a near one."""
    x = mean * np.eye(dims)[0] + spread * rng.standard_normal((n, dims)) / np.sqrt(dims)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((n, dims))
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    return np.concatenate([x, 0.982 * x + np.sqrt(1 - 0.982**2) * side])


@pytest.mark.parametrize("means, dims", [((0, 0.5, 1, 2, 4, 6, 7, 8), 64), ((7,), 64), ((0, 1.5), 768)])
def test_every_link_on_cones(spark, means, dims):
    """Recall against brute force, with a label for each cone from wide to narrow, some around other directions."""
    rng = np.random.default_rng(dims)
    sizes = [150 if k % 2 else 90 for k in range(len(means))]
    x = np.concatenate([cone(rng, n, dims, mean) * (1 if k % 3 else -1) for k, (n, mean) in enumerate(zip(sizes, means, strict=True))])
    label = np.repeat(np.arange(len(means)), [2 * n for n in sizes])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_embeddings(df).collect()}
    assert near.sum() >= len(x) and {i: int(n) for i, n in enumerate(near.sum(1))} == got


def test_places_of_pieces_in_many_parts(spark, monkeypatch):
    """Each piece has a place of its own and windows are those of the plan, however many parts ranks are counted in."""
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in np.minimum(rng.integers(1, 90, 500), 64)]
    pieces = spark.createDataFrame([(i // 3, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    for part_pieces in (1_000_000, 3):
        monkeypatch.setattr(packing, "PART_PIECES", part_pieces)
        rows = packing.place(pieces, 64).collect()
        assert collections.Counter((r["doc_id"], r["length"]) for r in rows) == collections.Counter((i // 3, n) for i, n in enumerate(lengths))
        runs = packing.plan_best_fit(dict(collections.Counter(lengths)), 64)
        want = sorted((first + j // each, offset + j % each * length, length) for length, _, n, each, first, offset in runs for j in range(n))
        assert sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows) == want
    assert packing.place(pieces.limit(0), 64).count() == 0


def test_toxicity_scores_are_the_noisy_or_that_is_fitted(spark):
    """Scores against a plain noisy-or with a leak, and their likelihood on the rows that the model was fitted to."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    spared = lambda z: 1 / (1 + np.exp(min(max(model.constant + z, -30), 30)))

    def plain(text):
        none = 1 - toxicity.LEAK
        for sentence in toxicity.sentences(text.lower()):
            z = sum(model.weights.get(f, 0.0) for w in set(toxicity.WORD.findall(sentence)) for f in toxicity.features(w))
            none *= spared(z) / spared(0.0) if z > 0 else 1.0
        return 1 - none

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert scores.keys() == texts.keys() and max(abs(scores[i] - plain(t)) for i, t in texts.items()) < 1e-9
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["toxic"] in (0, 1)}
    share = sum(known.values()) / len(known)
    likely = lambda p, y: np.log(np.clip(p if y else 1 - p, 1e-9, 1))
    assert sum(likely(scores[i], y) for i, y in known.items()) > 0.7 * sum(likely(share, y) for y in known.values())
    assert [r["score"] for r in toxicity.score_toxicity(table(spark, [(1, ""), (2, None)]), model).collect()] == pytest.approx([toxicity.LEAK] * 2)


def test_token_counts_of_random_odd_texts():
    """Literal word marks, controls, byte order marks and all kinds of white space, against the library on whole texts."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    pieces = ["▁", "▁▁", " ", "  ", "\n", "\t", "\ufeff", "\x00", "\x85", "\u3000", "\u200b", "a", "the", "Token", "é", "語", "🙂", ".", "1", "<s>", "</s>", "<unk>", "<0x41>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(6000)] + ["▁ ▁", "▁ \ufeff", "▁ \x00"]
    assert token_counts.make_counter(P.path("piece_bpe_32k.model"))(texts) == [len(x) for x in lib.encode(texts)]


def test_pipeline_filters_on_odd_rows(spark):
    """Null and repeated ids, null texts, clashing columns and empty tables in the pipeline's filters."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic, text = toxicity.fit_toxicity(docs, labels), language.fit_text_model(docs)
    df = table(spark, ROWS).withColumns({c: F.lit("clash") for c in ("__gone", "__order", "__text", "__c", "__doc")})
    filters = {"clean": lambda d: toxicity.keep_clean(d, toxic), "identified": lambda d: language.keep_identified(d, text), "one": lambda d: near_duplicates.keep_one_each(d)}
    kept = {name: run(df) for name, run in filters.items()}
    for name, found in kept.items():
        assert found.columns == df.columns and filters[name](df.limit(0)).count() == 0, name
    ids = {name: sorted(str(r["doc_id"]) for r in found.collect()) for name, found in kept.items()}
    assert ids["clean"] == ids["one"] == sorted(str(i) for i, _ in ROWS)
    assert {"None"} <= set(ids["identified"]) <= {"None", "1", "3"} and "2" not in ids["identified"]
