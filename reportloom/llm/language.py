"""Language identification by Bayesian fusion of evidence.

The posterior of a document's language multiplies
  * the likelihood of its text under byte trigram models (naive Bayes, tempered, as trigrams are not independent),
  * the likelihood of the declared markup language given each language,
  * the likelihood of the address suffix (top-level domain and first path part) given each language,
  * the prior of its host, smoothed towards its domain's, and that towards the corpus's.
A text that no model explains (its mean log-likelihood under all models mixed falls far short of that of held-out
labelled texts of its best language) and a text without letters are undetermined, whatever else is known of them.
The trigram models are fitted on a bounded sample of labelled texts. The three other tables are counts over all
documents by grouped aggregation, each document voting with its text's posterior; a document's own vote is left
out of its host's prior.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, held_out, map_texts, sample_order, without, written

#: Trigram buckets, and the weight of one trigram's evidence (they overlap, so three say as much as one).
BUCKETS, TEMPER = 1 << 16, 0.1
#: Pseudo-counts: of trigrams, of declared and suffix tables, of a domain for its host and of the corpus for a domain.
SMOOTH_GRAM, SMOOTH_TABLE, SMOOTH_HOST, SMOOTH_DOMAIN = 0.5, 1.0, 10.0, 20.0
PER_LANGUAGE, LEAST_ROWS = 600, 3
UNDETERMINED = "und"
#: How many deviations a text's mean log-likelihood may fall short of its language's; the least deviation between
#: texts, that of a language with under FEW held-out texts; and how many trigrams say as much as one.
SHORTFALL, SPREAD, WIDE_SPREAD, FEW, OVERLAP = 10.0, 0.1, 0.5, 20, 3
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^>]*>")


@dataclass(frozen=True)
class TextModel:
    """log P(trigram bucket | language), one row for each bucket, one column for each language, and that of the
    languages mixed. ``usual``: mean, deviation between texts and deviation between trigrams of the mixed
    log-likelihood of each language's texts."""

    languages: tuple[str, ...]
    table: np.ndarray
    mixed: np.ndarray
    usual: np.ndarray

    def log_likelihoods(self, text: str) -> np.ndarray:
        return self.evidence(text)[0]

    def evidence(self, text: str) -> tuple[np.ndarray, bool]:
        """The log likelihoods, and whether the text is in one of the languages at all."""
        grams = trigrams(text)
        if not len(grams):
            return np.zeros(len(self.languages)), False
        found = self.table[grams].sum(axis=0) * TEMPER
        mean, between, within = self.usual[found.argmax()]
        least = mean - SHORTFALL * np.sqrt(between**2 + OVERLAP * within**2 / len(grams))
        return found, bool(self.mixed[grams].mean(dtype=float) >= least)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the text's lower-cased letters; runs of anything else count as one space."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else re.sub(r"[^a-z]", " ", text.lower())
    raw = np.frombuffer((" " + " ".join(words.split()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.uint32)
    mixed = (raw[:-2] * 65_599 + raw[1:-1]) * 65_599 + raw[2:]
    return (mixed * np.uint32(2_654_435_761)) >> np.uint32(16)


def count_trigrams(rows: DataFrame) -> DataFrame:
    """How often each bucket occurs in the texts of each language: ``rows`` (__lang, __text) to (__lang, bucket, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(trigrams(text or ""))
            for lang, grams in found.items():
                buckets, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(buckets, pa.int32()), pa.array(n, pa.int64())], names=["__lang", "bucket", "n"])

    return rows.select("__lang", "__text").mapInArrow(run, "__lang string, bucket int, n long").groupBy("__lang", "bucket").agg(F.sum("n").alias("n"))


def sampled(known: DataFrame, counts: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language in ``counts`` (__lang, count), all where it has no more: those
    whose ``__order`` is under the language's share. Nothing is sorted or dealt by language."""
    below = F.col("__order").cast("double") < per_language / F.col("count") * 2.0**64 - 2.0**63
    return known.join(F.broadcast(counts), "__lang").where(below | (F.col("count") <= per_language))


def labelled(docs: DataFrame, lang_col: str, id_col: str, text_col: str) -> DataFrame:
    """Texts with a label: __lang, __text, __order, __held."""
    known = docs.where((F.trim(lang_col) != "") & F.col(text_col).isNotNull())
    return known.select(F.lower(F.trim(F.col(lang_col))).alias("__lang"), F.col(text_col).alias("__text"), sample_order(id_col).alias("__order"), held_out(id_col).alias("__held"))


def fit_text_model(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> TextModel:
    """The model of every label with ``LEAST_ROWS`` texts at least, from about ``per_language`` texts of each at most,
    in a fixed pseudo-random order of ids outside the held-out third."""
    known = labelled(docs, lang_col, id_col, text_col).where("not __held")
    counts = written(known.groupBy("__lang").count().where(F.col("count") >= LEAST_ROWS))
    languages = tuple(sorted(r["__lang"] for r in counts.collect()))
    table = np.full((BUCKETS, max(1, len(languages))), SMOOTH_GRAM)
    if languages:
        found = count_trigrams(sampled(known, counts, per_language)).toArrow()
        place = {lang: k for k, lang in enumerate(languages)}
        table[found["bucket"].to_numpy(), [place[x] for x in found["__lang"].to_pylist()]] += found["n"].to_numpy()
    dropped(counts)
    share = table / table.sum(axis=0)
    model = TextModel(languages or (UNDETERMINED,), np.log(share).astype(np.float32), np.log(share.mean(axis=1)).astype(np.float32), np.tile([-np.inf, SPREAD, 0.0], (table.shape[1], 1)))
    return replace(model, usual=usual_of(docs, model, lang_col, id_col, text_col, per_language)) if languages else model


def usual_of(docs: DataFrame, model: TextModel, lang_col: str, id_col: str, text_col: str, per_language: int) -> np.ndarray:
    """``usual`` of the model's languages from about ``per_language`` held-out texts of each at most, by medians, so
    that some texts with a wrong label do not move it. A language without any takes every text."""
    known = labelled(docs, lang_col, id_col, text_col).where("__held")
    some = sampled(known, known.where(F.col("__lang").isin(*model.languages)).groupBy("__lang").count(), per_language)
    mixed = model.mixed

    def make():
        def call(texts):
            grams = [mixed[trigrams(t)].astype(float) for t in texts]
            return [[float(g.mean()) if len(g) else None for g in grams], [float(g.std()) if len(g) else None for g in grams]]

        return call

    found: dict[str, list] = {}
    for r in map_texts(some, "__text", "__mean double, __within double", make, ["__lang"]).where("__mean is not null").collect():
        found.setdefault(r["__lang"], []).append((r["__mean"], r["__within"]))
    usual = np.tile([-np.inf, SPREAD, 0.0], (len(model.languages), 1))
    for k, lang in enumerate(model.languages):
        if lang in found:
            means, within = np.array(found[lang]).T
            mean = np.median(means)
            usual[k] = mean, max(SPREAD if len(means) >= FEW else WIDE_SPREAD, 1.4826 * np.median(np.abs(means - mean))), np.median(within)
    return usual


def host_of(url: Column) -> Column:
    """The lower-cased host of an address, without port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def suffix_of(url: Column) -> Column:
    """The top-level domain and the first path part where that has two letters, such as 'org/fr'."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][\w+.-]*:)?//[^/?#]*/([A-Za-z]{2})(?:[/?#-]|$)", 1)
    return F.concat(F.regexp_extract(host_of(url), r"([^.]*)$", 1), F.lit("/"), F.lower(part))


def declared_of(html: Column) -> Column:
    """The primary language subtag that the html element declares, '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", 1))


def visible(markup: str) -> str:
    """The text between the tags, character references decoded (their names are no words of any language)."""
    return html.unescape(TAG.sub(" ", HIDDEN.sub(" ", markup)))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def text_evidence(rows: DataFrame, model: TextModel, keep: list[str], text_col: str, markup: bool) -> DataFrame:
    """``keep``, the text's log likelihoods (``__ll``; all 0 for texts without letters) and whether it is in one of
    the model's languages (``__told``)."""

    def make():
        clean = visible if markup else str

        def call(texts):
            found = [model.evidence(clean(t)) for t in texts]
            return [[ll.astype(float).tolist() for ll, _ in found], [told for _, told in found]]

        return call

    return map_texts(rows, text_col, "__ll array<double>, __told boolean", make, keep)


def softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def totals(votes: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The sum of the votes for each language, by ``keys``, as one array."""
    return votes.groupBy(*keys).agg(F.array(*[F.sum(F.col("__vote")[i]) for i in range(n)]).alias(name))


def likelihood(counts: Column, by_language: Column) -> Column:
    """log P(value | language) from the value's votes and the languages' totals, smoothed."""
    return F.zip_with(counts, by_language, lambda c, t: F.log((c + SMOOTH_TABLE) / (t + SMOOTH_TABLE * 10)))


def fuse(evidence: DataFrame, model: TextModel, id_col: str) -> DataFrame:
    """The posterior of each row of ``evidence`` (id_col, __ll, __told, __declared, __suffix, __host)."""
    n = len(model.languages)
    if n == 0:
        raise ValueError("the model has no language")
    told = F.col("__told")
    vote = F.when(told, softmax(F.col("__ll"))).otherwise(F.array_repeat(F.lit(0.0), n))
    votes = evidence.withColumns({"__vote": vote, "__domain": domain_of(F.col("__host"))})
    corpus = totals(votes, [], n, "__all").withColumn("__all", F.transform("__all", lambda x: F.coalesce(x, F.lit(0.0))))
    declared = totals(votes, ["__declared"], n, "__by_declared")
    suffix = totals(votes, ["__suffix"], n, "__by_suffix")
    hosts = totals(votes, ["__host", "__domain"], n, "__by_host")
    domains = hosts.groupBy("__domain").agg(F.array(*[F.sum(F.col("__by_host")[i]) for i in range(n)]).alias("__by_domain"))
    joined = votes.join(F.broadcast(corpus)).join(declared, "__declared").join(suffix, "__suffix").join(hosts.join(domains, "__domain").drop("__domain"), "__host")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    less = lambda a: F.zip_with(a, F.col("__vote"), lambda x, v: F.greatest(x - v, F.lit(0.0)))
    smooth = lambda counts, prior, weight: F.zip_with(counts, prior, lambda c, p: (c + p * weight) / (add(counts) + weight))
    prior = smooth(F.col("__all"), F.array_repeat(F.lit(1.0 / n), n), 1.0)
    prior = smooth(less(F.col("__by_domain")), prior, SMOOTH_DOMAIN)
    prior = smooth(less(F.col("__by_host")), prior, SMOOTH_HOST)
    parts = joined.select(
        *[c for c in evidence.columns if c != "__vote"],
        prior.alias("__prior"),
        F.when(F.col("__declared") != "", likelihood(less(F.col("__by_declared")), F.col("__all"))).otherwise(F.array_repeat(F.lit(0.0), n)).alias("__lik_declared"),
        F.when(F.col("__suffix") != "/", likelihood(less(F.col("__by_suffix")), F.col("__all"))).otherwise(F.array_repeat(F.lit(0.0), n)).alias("__lik_suffix"),
    )
    fused = F.zip_with("__ll", "__prior", lambda x, p: x + F.log(p + 1e-12))
    for part in ("__lik_declared", "__lik_suffix"):
        fused = F.zip_with(fused, part, lambda x, y: x + y)
    scored = parts.withColumn("__post", softmax(fused))
    best = F.array_position(F.col("__post"), F.array_max("__post")).cast("int")
    names = F.array(*[F.lit(x) for x in model.languages])
    silent = ~F.col("__told")
    return scored.select(
        *[c for c in evidence.columns if not c.startswith("__")],
        F.when(silent, F.lit(UNDETERMINED)).otherwise(F.element_at(names, best)).alias("lang"),
        F.when(silent, F.lit(0.0)).otherwise(F.array_max("__post")).alias("confidence"),
        F.col("__declared").alias("declared"),
        F.col("__host").alias("host"),
    )


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns id_col, url_col, lang, confidence, declared, host: a row for each row of ``pages``.

    Null html or url count as empty. A page without letters, and one whose text no language of the model
    explains, is 'und' with confidence 0, whatever it declares. Ties go to the first language in alphabetical order. Extra columns are ignored; rows with null
    or repeated ids keep a row each; an empty table gives an empty result.
    """
    known = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"), declared_of(F.col(html_col)).alias("__declared"), suffix_of(F.col(url_col)).alias("__suffix"), host_of(F.col(url_col)).alias("__host"))
    evidence = written(text_evidence(known, model, [id_col, url_col, "__declared", "__suffix", "__host"], "__html", True))
    return fuse(evidence, model, id_col)


def identify_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The same for plain documents: ``declared_col`` is what their metadata declare, ``host_col`` where they are from."""
    known = docs.select(F.col(id_col), F.col(text_col).alias("__doc"), F.lower(F.trim(F.coalesce(F.col(declared_col), F.lit("")))).alias("__declared"), F.lit("/").alias("__suffix"), F.coalesce(F.col(host_col), F.lit("")).alias("__host"))
    evidence = written(text_evidence(known, model, [id_col, "__declared", "__suffix", "__host"], "__doc", False))
    return fuse(evidence, model, id_col)


def keep_identified(docs: DataFrame, model: TextModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, but those whose language is undetermined or less likely than ``least``.

    Null, empty and letterless texts are undetermined. Rows of one id are one document: all stay if one of them does.
    Rows with a null id stay. An empty table gives an empty result.
    """
    found = identify_documents(docs, model, id_col, text_col, declared_col, host_col)
    ids = found.groupBy(id_col).agg(F.max("confidence").alias("__c")).where(F.col("__c") < least).select(F.col(id_col).alias("id"))
    return without(docs, ids, id_col)
