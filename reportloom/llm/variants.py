"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point.

1. Words are counted within tasks; each task holds ``MOST_COUNTS`` counts at most before it passes them on.
2. Replacements: a word of n code points belongs to n wildcard groups (position, prefix, suffix). A group keeps its size
   and its two commonest words; a member's partners there are the others, and its best one is the first, or the second
   where the first is itself. So no pair is made, and a group is an aggregate that is summed within tasks.
3. Insertions and deletions: each word's shortened forms meet the vocabulary. What is found for the longer word and
   for the shorter one is summed up in two aggregates.
4. All joins are of two tables of words, which grow with the corpus: both sides are dealt and sorted, never sent whole
   through the driver (``shuffled``).
5. A word's form is its commonest near word, if that is ``TIMES`` times as frequent. Forms are far more frequent than
   their words, so following them ends; roots are found by doubling the step until no word moves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, dropped, written

#: Code points and occurrences that a word has at least; times that a form is as frequent as its word.
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a code point, by the checksum of its document and itself.
EVERY = 199
MOST_COUNTS = 300_000
#: Maximal runs; shorter ones can be no word.
RUN = re.compile(r"[a-zA-ZÀ-ÿ]{%d,}" % LEAST_CHARS)


def words_of(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts, a code point deleted where the checksum says so."""
    start = zlib.crc32(f"{doc_id}:".encode())
    small = text.encode("utf-8", "replace").lower().decode()  # only A-Z
    for run, n in Counter(RUN.findall(small)).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST_CHARS:
            yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns word, n: words that occur ``LEAST_COUNT`` times or more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in words_of(doc_id or "", text or ""):
                    held[word] += n
            if len(held) > MOST_COUNTS:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


def shuffled(words: DataFrame) -> DataFrame:
    """``words`` as a side of a sort-merge join, however small its files look: a table under Spark's limit for broadcasts
    in compressed bytes takes many times as much of the driver."""
    return words.hint("merge")


def first_of(word: str, n: str) -> Column:
    """The aggregate that finds the commonest word, ties by code-point order, as a struct (minus, word)."""
    return F.min(F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word")))


def replacements(words: DataFrame) -> DataFrame:
    """Columns word, n_near, best (minus, word): what the wildcard groups of each word (word, n) hold besides it."""
    place = F.explode(F.expr("sequence(1, length(word))")).alias("at")
    keyed = words.select("word", "n", place).select("word", "n", "at", F.expr("substr(word, 1, at - 1)").alias("head"), F.expr("substr(word, at + 1)").alias("tail"))
    key = ["at", "head", "tail"]
    # a group has a word for each letter at the most, so its array is as small
    members = F.collect_list(F.struct((-F.col("n")).alias("minus"), "word"))
    groups = keyed.groupBy(*key).agg(F.count("*").alias("size"), F.slice(F.sort_array(members), 1, 2).alias("top")).where("size > 1")
    met = keyed.join(shuffled(groups), key)
    other = F.when(F.col("top")[0]["word"] == F.col("word"), F.col("top")[1]).otherwise(F.col("top")[0])
    return met.groupBy("word").agg(F.sum(F.col("size") - 1).alias("n_near"), F.min(other).alias("best"))


def indels(words: DataFrame) -> DataFrame:
    """Columns word, n_near, best: the words of the vocabulary that one deletion turns a word into, or that turn into it."""
    shorter = F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1)))"))).alias("short")
    vocabulary = words.select(F.col("word").alias("short"), F.col("n").alias("short_n"))
    links = written(words.where(f"length(word) > {LEAST_CHARS}").select("word", "n", shorter).join(shuffled(vocabulary), "short"))
    down = links.groupBy("word").agg(F.count("*").alias("n_near"), first_of("short", "short_n").alias("best"))
    up = links.groupBy(F.col("short").alias("word")).agg(F.count("*").alias("n_near"), first_of("word", "n").alias("best"))
    return down.unionByName(up)


def roots_of(forms: DataFrame) -> DataFrame:
    """Columns word, root: the end of the chain of forms (word, form), by doubling the step until no word moves."""
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ends = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(steps.join(shuffled(ends), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        dropped(steps)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        steps = moved.drop("moved")
        steps._written_to = moved._written_to


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns word, form, root, n, n_near, form_n, a row for each word.

    Words are maximal runs of Latin letters (with U+00C0 to U+00FF), A-Z made small, of at least ``LEAST_CHARS`` code points
    and ``LEAST_COUNT`` occurrences, after one run in ``EVERY`` has lost a code point by the checksum of
    ``<doc_id>:<run>``. form: the commonest word that differs by one inserted, deleted or replaced code point (ties: the
    smallest), if it is ``TIMES`` times as frequent, else null. root: the last of the chain of forms. n_near: how many
    words are near. Null texts have no words; null ids count as ''. Rows with repeated ids count each. Extra columns are
    ignored. An empty table gives an empty result.
    """
    words = written(word_counts(docs, id_col, text_col))
    near = replacements(words).unionByName(indels(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.minus") >= TIMES * F.col("n")
    with_form = written(words.join(shuffled(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    roots = roots_of(with_form.where("form is not null"))
    return with_form.join(shuffled(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
