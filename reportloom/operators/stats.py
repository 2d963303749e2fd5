"""Corpus statistics: counts with shares, distributions, repeated phrases, runs of blank lines, character sets.

All of them aggregate before they rank: what a window sorts is one row for each distinct value, not each occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOP = 8


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded half-even to three places; null for a whole of 0."""
    return F.bround(F.try_divide(part, whole), 3)


def top_shares(df: DataFrame, value: str, by: list[str] | None = None, n: int = TOP, weight: str | None = None, order: str | None = None) -> DataFrame:
    """The ``n`` commonest values, with count (or summed ``weight``) and share of all, in each group of ``by``.

    Ties go to the value seen first (least ``order``), or to the lesser value without an order column.
    """
    by = by or []
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    first = F.min(order) if order else F.min(value)
    counted = df.groupBy(*by, value).agg(amount.alias("count"), first.alias("__first"))
    rank = Window.partitionBy(*by).orderBy(F.desc("count"), "__first")
    total = F.sum("count").alias("__total")  # of the counts, which are there already
    totals = counted.groupBy(*by).agg(total) if by else counted.agg(total)
    ranked = counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
    joined = ranked.join(totals, by) if by else ranked.join(F.broadcast(totals))
    return joined.select(*by, value, F.col("count").cast("long").alias("count"), ratio(F.col("count"), F.col("__total")).alias("share"), F.col("rank").cast("long").alias("rank"))


def distribution(df: DataFrame, value: str, by: list[str], decimals: int = 2) -> DataFrame:
    """n, min, p25, p50, p75, p90 and max of a numeric column in each group.

    The quantile q is the value at index least(n - 1, floor(q * n)) of the sorted values. It is read from counts of
    distinct values and their running sums, so no group is ever collected.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    running = counts.withColumns({"__n": F.sum("__c").over(w), "__upto": F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("__upto") > F.least(F.col("__n") - 1, F.floor(F.lit(q) * F.col("__n"))), F.col(value)))
    figures = {"min": F.min(value), "p25": at(0.25), "p50": at(0.5), "p75": at(0.75), "p90": at(0.9), "max": F.max(value)}
    return running.groupBy(*by).agg(F.max("__n").cast("long").alias("n"), *[F.bround(c.cast("double"), decimals).alias(k) for k, c in figures.items()])


def sentence_rows(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A row for each sentence of each document: ``keep``, sentence_no (from 1), sentence."""
    return docs.select(*keep, F.posexplode(T.sentences(F.col(text_col))).alias("__n", "sentence")).select(*keep, (F.col("__n") + 1).cast("long").alias("sentence_no"), "sentence")


def line_rows(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A row for each line of each document: ``keep``, ord (from 1), line."""
    return docs.select(*keep, F.posexplode(T.lines(F.col(text_col))).alias("__n", "line")).select(*keep, (F.col("__n") + 1).cast("long").alias("ord"), "line")


def ending_shares(docs: DataFrame, by: str = "lang", n: int = TOP) -> DataFrame:
    """The commonest sentence endings (class and last two characters) in each group of documents."""
    ends = sentence_rows(docs, [by]).select(by, T.ending_class(F.col("sentence")).alias("ending"), T.tail(F.col("sentence")).alias("tail"))
    ends = ends.withColumn("value", F.concat_ws(" ", "ending", "tail"))
    return top_shares(ends, "value", [by], n)


def form_totals(docs: DataFrame, forms: dict[str, str], text_col: str = "text") -> DataFrame:
    """How often each form occurs in all documents: form, occurrences, docs (documents with it)."""
    counted = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(T.form_counts(F.col(text_col), forms))])
    sums = counted.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).cast("long").alias(f"c{i}") for i in range(len(forms))], *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(forms))])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("form"), F.col(f"c{i}").alias("occurrences"), F.col(f"d{i}").cast("long").alias("docs")) for i, name in enumerate(forms)]))
    return sums.select(rows.alias("r")).select("r.*")


def shared_phrases(df: DataFrame, value: str, doc: str, least: int = 2, n: int | None = None) -> DataFrame:
    """Values found in ``least`` or more different documents: value, docs, occurrences; the first ``n`` by docs."""
    counted = df.groupBy(value, doc).agg(F.count("*").alias("__c")).groupBy(value).agg(F.count("*").alias("docs"), F.sum("__c").cast("long").alias("occurrences")).where(F.col("docs") >= least)
    return counted.orderBy(F.desc("docs"), value).limit(n) if n else counted


def blank_runs(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Runs of blank lines that a visible line follows: doc, run_no, length. ``lines`` has doc, ord, line."""
    w = Window.partitionBy(doc).orderBy("ord")
    marked = lines.select(doc, "ord", T.is_blank(F.col("line")).alias("__blank")).withColumn("__after", F.sum((~F.col("__blank")).cast("int")).over(w))
    ends = marked.groupBy(doc).agg(F.max("__after").alias("__last"))
    runs = marked.where("__blank").groupBy(doc, "__after").agg(F.count("*").alias("length"))
    kept = runs.join(ends, doc).where("__after < __last")
    return kept.select(doc, F.row_number().over(Window.partitionBy(doc).orderBy("__after")).cast("long").alias("run_no"), "length")


def charset(docs: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """Shares of Hangul, Hanja, Latin letters, digits and other among visible characters, in each group."""
    docs = docs.select(by, F.regexp_replace(T.filled(F.col(text_col)), r"(?U)\s+", "").alias("__seen"))
    t = F.col("__seen")
    count = lambda cls: F.sum(F.char_length(F.regexp_replace(t, f"[^{cls}]+", "")))
    classes = {"hangul": "가-힣ㄱ-ㅎㅏ-ㅣ", "hanja": "一-鿿", "latin": "A-Za-z", "digits": "0-9"}
    sums = docs.groupBy(by).agg(F.sum(F.char_length(t)).alias("chars"), *[count(c).alias(k) for k, c in classes.items()])
    return sums.select(by, F.col("chars").cast("long").alias("chars"), *[ratio(F.col(k), F.col("chars")).alias(f"{k}_share") for k in classes])


def marker_profile(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each leading mark: lines, docs, separators, mean length and share of lines with a blank line before."""
    w = Window.partitionBy(doc).orderBy("ord")
    marked = lines.withColumns({"__m": T.typed_marker(F.col("line")), "__before": F.lag(T.is_blank(F.col("line"))).over(w)}).where("__m is not null")
    rows = marked.select(doc, F.col("__m.mark").alias("mark"), F.col("__m.sep").alias("sep"), F.char_length("line").alias("len"), F.coalesce(F.col("__before"), F.lit(False)).alias("spaced"))
    return rows.groupBy("mark").agg(F.count("*").alias("lines"), F.countDistinct(doc).alias("docs"), F.array_join(F.array_sort(F.collect_set("sep")), ",").alias("seps"), F.bround(F.avg("len"), 2).alias("mean_len"), ratio(F.count_if("spaced"), F.count("*")).alias("spaced_share"))


def skeleton(lines: DataFrame, doc: str = "doc_id", head: int = 6, tail: int = 3) -> DataFrame:
    """The shapes of a document's first and last visible lines as one string: marks, dates, captions or text."""
    visible = lines.where(~T.is_blank(F.col("line")))
    mark = T.typed_marker(F.col("line"))
    shape = F.when(T.is_date_line(F.col("line")), "date").when(T.is_bracket_caption(F.col("line")), "caption").when(mark.isNotNull(), mark["mark"]).otherwise(F.concat(F.lit("text"), F.least(F.floor(F.char_length("line") / 20), F.lit(5)).cast("string")))
    w = Window.partitionBy(doc).orderBy("ord")
    placed = visible.select(doc, "ord", shape.alias("shape"), F.row_number().over(w).alias("a"), F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("ord"))).alias("z"))
    some = placed.where((F.col("a") <= head) | (F.col("z") <= tail))
    return some.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "shape"))), lambda s: s["shape"]), "·").alias("skeleton"))
