"""Quality rules with adaptive thresholds, in DataFrame functions only.

1. Each text is measured by array functions within its row: words, symbols, repeated lines, repeated windows of three
   words. Nothing is exploded by word and nothing is shuffled for it.
2. Rates of the documents that pass the fixed base rules go into quantile sketches, one for each language, source and
   rate. A sketch is a log-linear histogram: a value is kept to its ``SIGNIFICANT`` leading bits, so a quantile is
   known within one part in 2 ** (SIGNIFICANT - 1), whatever its size. Sketches merge by adding counts, which is
   what the grouped aggregation does within tasks, between them, and again from sources to languages and to all
   documents. The result does not depend on how rows are dealt, and a sketch has some thousand counts at most.
3. A rate's limits are its quartiles widened by ``FENCE`` times their distance. Limits of a source are drawn towards
   those of its language, and these towards those of all documents, as ``PRIOR`` more documents would draw them, so
   small sources need no switch.
4. Documents meet the limits of their language and source in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

#: Leading bits that a sketch keeps of a value; widths of the fence in quartile distances; documents by which a limit
#: is drawn towards that of the level above.
SIGNIFICANT, FENCE, PRIOR = 7, 3, 100
#: Rates in thousandths: name, SQL over the measures, the least quartile distance, and whether low values fail too.
RATES = (
    ("word_length", "1000 * word_chars div greatest(n_words, 1)", 500, True),
    ("symbols", "1000 * n_symbols div greatest(n_words, 1)", 33, False),
    ("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", 133, False),
    ("repeat_words", "1000 * n_repeat_words div greatest(n_words, 1)", 100, False),
)
#: Fixed base rules: least words, and the percentage of words in repeated windows that is too much.
LEAST_WORDS, MOST_REPEATED = 50, 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def windows(words: Column, make) -> Column:
    """``make(a, b, c, position)`` for each window of three words."""
    whole = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: make(words[i], words[i + 1], words[i + 2], i))
    return F.when(F.size(words) >= 3, whole)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more.

    Equal windows have equal hashes, so a text whose hashes are all different repeats nothing; in others the windows
    themselves are sorted and compared with their neighbours.
    """

    def exact(words):
        found = F.sort_array(windows(words, lambda a, b, c, i: F.struct(F.concat_ws(" ", a, b, c).alias("s"), i.alias("i"))))
        twice = lambda z: F.filter(z, lambda x, k: ((k > 0) & (F.get(z, k - 1)["s"] == x["s"])) | F.coalesce(F.get(z, k + 1)["s"] == x["s"], F.lit(False)))
        return let(found, lambda z: F.size(F.array_distinct(F.flatten(F.transform(twice(z), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    hashes = windows(words, lambda a, b, c, i: F.xxhash64(a, b, c))
    alike = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) >= 4) & alike, exact(words)).otherwise(0)


def measures(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns ``keep``, ``MEASURES`` and n_lines (lines with a word) of each text; null texts are empty."""
    texts = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    said = let(F.regexp_extract_all("__text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeated")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    names = [c for c in texts.columns if c != "__text"]
    found = texts.select(*names, said.alias("__words"), of_lines.alias("__lines"), F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).alias("__symbols"))
    parts = ("__words.n", "__words.chars", "__symbols", "__lines.dup", "__words.repeated", "__lines.n")
    return found.select(*names, *[F.col(p).cast("long").alias(n) for p, n in zip(parts, [*MEASURES, "n_lines"], strict=True)])


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, rate (its number), bin (the least value it stands for), n."""
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), F.expr(sql).alias("v")) for k, (_, sql, _, _) in enumerate(RATES)])).alias("r")
    cut = f"greatest(length(bin(r.v)) - {SIGNIFICANT}, 0)"
    return measured.select(*keys, rates).select(*keys, "r.rate", F.expr(f"shiftleft(shiftright(r.v, {cut}), {cut})").alias("bin")).groupBy(*keys, "rate", "bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of the sketches that agree on ``keys``."""
    return sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def limits_of(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Columns keys, rate, and with the prefix: n (documents), low and high, the fence around the quartiles."""
    upto = Window.partitionBy(*keys, "rate").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = sketch.select(*keys, "rate", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*keys, "rate")).alias("n"))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("bin")))
    of = run.groupBy(*keys, "rate").agg(F.max("n").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    least = F.element_at(F.array(*[F.lit(r[2]) for r in RATES]), F.col("rate") + 1)
    width = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    return of.select(*keys, "rate", F.col("n").alias(f"{prefix}n"), F.greatest(F.col("q1") - width, F.lit(0)).alias(f"{prefix}low"), (F.col("q3") + width).alias(f"{prefix}high"))


def adaptive_limits(sketch: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row for each language and source of a sketch: low_<rate> and high_<rate> for each rate, in thousandths."""
    upper, lower = keys
    whole = limits_of(merged(sketch, []), [], "a")
    by_upper = limits_of(merged(sketch, [upper]), [upper], "u").join(F.broadcast(whole), "rate")  # one row for each rate
    for side in ("low", "high"):
        by_upper = by_upper.withColumn(f"u{side}", F.expr(f"(un * u{side} + {PRIOR} * a{side}) div (un + {PRIOR})"))
    both = limits_of(sketch, [upper, lower], "s").join(by_upper.select(upper, "rate", "ulow", "uhigh"), [upper, "rate"])
    out = []
    for k, (name, *_) in enumerate(RATES):
        out += [F.max(F.when(F.col("rate") == k, F.expr(f"(sn * s{side} + {PRIOR} * u{side}) div (sn + {PRIOR})"))).alias(f"{side}_{name}") for side in ("low", "high")]
    return both.groupBy(upper, lower).agg(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Columns id_col, ``MEASURES``, base_failed, kept and failed (names of the rates out of limits), a row for each
    row of ``docs``.

    base_failed: under ``LEAST_WORDS`` words, or over ``MOST_REPEATED`` percent of the words in repeated windows. kept:
    not base_failed, and no rate beyond the limits of the row's language and source. Null texts are empty; null
    languages and sources count as ''. Rows with null or repeated ids keep a row each and are judged by their own
    text. Extra columns are ignored. An empty table gives an empty result. Ties need no rule: equal values share a bin.
    """
    keep = [F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = written(measures(docs, text_col, keep).withColumn("base_failed", failed))
    limits = written(adaptive_limits(sketches(measured.where("not base_failed"), ["lang", "source"])))
    few = limits.count() <= BROADCAST_IDS
    met = measured.join(F.broadcast(limits) if few else limits, ["lang", "source"], "left")
    out_of = [F.when((F.expr(sql) > F.col(f"high_{name}")) | (F.lit(low_too) & (F.expr(sql) < F.col(f"low_{name}"))), F.lit(name)) for name, sql, _, low_too in RATES]
    rates_failed = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*out_of)))
    return met.select(F.col("id").alias(id_col), *MEASURES, "base_failed", (~F.col("base_failed") & (F.size(rates_failed) == 0)).alias("kept"), rates_failed.alias("failed"))
