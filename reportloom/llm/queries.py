"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, divergence, embedding_dedup, fingerprint, language, main_text, near_duplicates, packing, quality, quality_rules, token_counts, toxicity, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extract_pages(pages, main_text.fit_blocks(pages))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_text_model(table(spark, sf_dir, "documents"))
    return language.identify_pages(table(spark, sf_dir, "pages"), model)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("failed")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_token_counts, op3_main_text, op4_embedding_dedup, op5_fingerprint, op6_near_duplicates, op7_byte_bpe, op8_packing, op9_toxicity, op10_language, op11_quality_rules, op12_source_divergence, op13_spelling_variants)}


#: Links by brute force over pairs of one label, then the smallest id reachable.
OP4_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN component p ON p.a = e.vec_id LEFT JOIN counted k ON k.a = e.vec_id
"""

#: Shared shingles counted by a join on shingles; exact, without sketches.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN component p ON p.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: Measures by lists and joins of windows; sketches as counts of the same bins; the same limits.
OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 's': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) AS x FROM t),
twice AS (SELECT rid, i FROM (SELECT rid, x.i AS i, count(*) OVER (PARTITION BY rid, x.s) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
m AS (
  SELECT t.rid, doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM t LEFT JOIN rep ON rep.rid = t.rid),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [1000 * word_chars // greatest(n_words, 1), 1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1)] AS r FROM m),
v AS (SELECT lang, source, unnest([0, 1, 2, 3]) AS rate, unnest(r) AS v FROM b WHERE NOT base_failed),
sketch AS (SELECT lang, source, rate, (v >> s) << s AS bin, count(*) AS n FROM (SELECT *, greatest(len(bin(v)) - 7, 0)::INTEGER AS s FROM v) GROUP BY ALL),
least(rate, width) AS (VALUES (0, 500), (1, 33), (2, 133), (3, 100)),
level AS (
  SELECT lang, source, rate, bin, n FROM sketch
  UNION ALL SELECT lang, NULL, rate, bin, sum(n) FROM sketch GROUP BY lang, rate, bin
  UNION ALL SELECT NULL, NULL, rate, bin, sum(n) FROM sketch GROUP BY rate, bin),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM level),
q AS (SELECT lang, source, rate, max(total)::BIGINT AS n, min(bin) FILTER (WHERE 4 * upto >= total) AS q1, min(bin) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM run GROUP BY lang, source, rate),
f AS (SELECT lang, source, q.rate, n, greatest(q1 - 3 * greatest(q3 - q1, width), 0) AS low, q3 + 3 * greatest(q3 - q1, width) AS high FROM q JOIN least USING (rate)),
u AS (SELECT x.lang, x.rate, (x.n * x.low + 100 * a.low) // (x.n + 100) AS low, (x.n * x.high + 100 * a.high) // (x.n + 100) AS high
  FROM f x JOIN f a ON a.rate = x.rate AND a.lang IS NULL WHERE x.lang IS NOT NULL AND x.source IS NULL),
s AS (SELECT x.lang, x.source, x.rate, (x.n * x.low + 100 * u.low) // (x.n + 100) AS low, (x.n * x.high + 100 * u.high) // (x.n + 100) AS high
  FROM f x JOIN u ON u.lang = x.lang AND u.rate = x.rate WHERE x.source IS NOT NULL),
limits AS (SELECT lang, source, max(low) FILTER (WHERE rate = 0) AS low, list(high ORDER BY rate) AS high FROM s GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(r[1] < low OR r[1] > high[1] OR r[2] > high[2] OR r[3] > high[3] OR r[4] > high[4], false) AS kept
FROM b LEFT JOIN limits USING (lang, source)
"""

#: Every group by every kept term, and every pair of groups over all of them.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
occ AS (SELECT rid, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
voc AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM occ GROUP BY lang, source, term),
whole AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.ln FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT w.lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY w.lang, source) + 5 * v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (ln + 5)) // (total + 5 * v) AS BIGINT) AS q FROM whole w JOIN voc ON voc.lang = w.lang),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: The checksum bit by bit from its polynomial; near words by a join on what is left without one place.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{6,}')) AS run FROM documents)
  GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
    lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hexed, bits),
said AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, word[1 : i - 1] AS a, word[i + 1 :] AS b FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON y.word = x.a || x.b),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, (SELECT min(other) FROM near WHERE near.word = w.word AND near.n = b.most AND b.most >= 5 * w.n) AS form,
    CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
follow AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT f.word, x.form, step + 1 FROM follow f JOIN formed x ON x.word = f.root WHERE x.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, max_by(root, step) AS root FROM follow GROUP BY word) r ON r.word = f.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_dedup": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op11_quality_rules": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_spelling_variants": OP13_SQL}
