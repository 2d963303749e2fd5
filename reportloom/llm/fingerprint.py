"""Document fingerprints by consistent weighted sampling.

A document is a multiset of lower-cased words, each weighted by its count. Sample k of a document is the word that
minimises a gamma-based score: with r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) drawn from a hash of (word, k),
    t = floor(ln(weight) / r + b),   ln(score) = ln(c) - r * (t - b) - r,
and the sample is the pair (word, t). Two documents give the same sample with a probability equal to the
generalised Jaccard similarity of their weighted words, sum of minima over sum of maxima; the share of equal
samples among ``SAMPLES`` estimates it. A sample is kept as a 32-bit hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

SAMPLES = 128
#: (word, count) pairs whose samples a worker remembers at most; 8 * SAMPLES bytes each.
MEMO_TERMS = 100_000
#: Terms whose samples are computed at a time, and rows of a batch that are Python objects at a time.
TERMS, ROWS = 2048, 1024
#: Rows of a range of neighbouring ids, about, until there are MOST_RANGES ranges, and ids looked at for each boundary;
#: a range is read in order by one task.
BUCKET_ROWS, MOST_RANGES, IDS_PER_CUT = 2000, 20_000, 20
EMPTY = np.zeros(SAMPLES, np.uint32)


STEPS = (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(4) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
SCALE, HALF = np.float32(2.0**-23), np.float32(2.0**-24)


def draws(seeds: np.ndarray, salt: int) -> np.ndarray:
    """64 random bits for each seed and sample."""
    with np.errstate(over="ignore"):
        x = seeds[:, None] + (STEPS + np.uint64(salt) * np.uint64(0xD1B54A32D192ED03))[None, :]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def gamma(x: np.ndarray) -> np.ndarray:
    """A Gamma(2, 1) number from the upper 46 bits of each x: -ln(u * v) for two uniform numbers in (0, 1)."""
    u = (x >> np.uint64(41)).astype(np.int32).astype(np.float32)
    v = ((x >> np.uint64(18)).astype(np.uint32) & np.uint32(0x7FFFFF)).astype(np.float32)
    u *= SCALE
    u += HALF
    v *= SCALE
    v += HALF
    u *= v
    return -np.log(u, out=u)


def term_samples(seeds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each term a row of samples as integers: ln(score) in the upper half, so that integers order as scores do,
    and the hash of (word, t) in the lower."""
    bits = draws(seeds, 0)
    r = gamma(bits)
    b = ((bits & np.uint64(0x3FFFF)).astype(np.uint32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-18)
    score = np.log(gamma(draws(seeds, 1)))
    heavy = np.flatnonzero(weights > 1)  # for weight 1, t = 0
    rest = 1 - b
    mark = np.broadcast_to(marks_of(seeds)[:, None], score.shape)
    if len(heavy):
        t = np.floor(np.log(weights[heavy]).astype(np.float32)[:, None] / r[heavy] + b[heavy])
        rest[heavy] += t
        mark = mark.copy()
        with np.errstate(over="ignore"):
            mark[heavy] = marks_of(seeds[heavy, None] ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    score -= r * rest
    raw = score.view(np.int32)
    ordered = raw ^ ((raw >> 31) | np.int32(-(1 << 31)))
    return (ordered.view(np.uint32).astype(np.uint64) << np.uint64(32)) | mark


def marks_of(seeds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (seeds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


class Sampler:
    """Signatures of texts.

    The samples of terms met before are looked up in a bounded memo of two halves: when the younger is full, the
    older is given up and the younger takes its place, so terms that keep coming are never computed anew.
    """

    def __init__(self):
        self.half = MEMO_TERMS // 2
        self.young: dict[tuple[str, int], int] = {}
        self.old: dict[tuple[str, int], int] = {}
        self.samples, self.old_samples = (np.empty((self.half, SAMPLES), np.uint64) for _ in range(2))

    def place(self, terms: list[tuple[str, int]]) -> None:
        """Bring terms that are not in the younger half into it."""
        if len(self.young) + len(terms) > self.half:
            self.young, self.old = {}, self.young
            self.samples, self.old_samples = self.old_samples, self.samples
        known = [t for t in terms if t in self.old]
        if known:
            at = len(self.young)
            self.samples[at : at + len(known)] = self.old_samples[[self.old[t] for t in known]]
            self.young.update(zip(known, range(at, at + len(known)), strict=True))
            terms = [t for t in terms if t not in self.old]
        at = len(self.young)
        if terms:
            for i in range(0, len(terms), TERMS):
                some = terms[i : i + TERMS]
                seeds = np.array([xxhash.xxh64_intdigest(w) for w, _ in some], np.uint64)
                self.samples[at + i : at + i + len(some)] = term_samples(seeds, np.array([n for _, n in some], np.float64))
            self.young.update(zip(terms, range(at, at + len(terms)), strict=True))

    def signature(self, text: str) -> np.ndarray:
        terms = list(Counter(text.lower().split()).items())
        if not terms:
            return EMPTY
        least = None
        for i in range(0, len(terms), self.half // 4):
            part = terms[i : i + self.half // 4]
            if new := [t for t in part if t not in self.young]:
                self.place(new)
                if len(new) < len(part) and (gone := [t for t in part if t not in self.young]):
                    self.place(gone)  # the halves have changed places
            rows = np.fromiter(map(self.young.__getitem__, part), np.int64, len(part))
            found = self.samples.take(rows, axis=0).min(axis=0)
            least = found if least is None else np.minimum(least, found)
        return least.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples; 1 for two empty signatures, 0 for an empty and another."""
    if a is EMPTY or b is EMPTY:
        return 1.0 if a is b else 0.0
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before in rising order of (id, hash of the text, text), null ids lowest; after the
    last comes the first; a single document is its own next. Ids may be of any type that has an order. Null text
    counts as empty. Two texts without words have equal fingerprints and likeness 1, one with words and one without
    have likeness 0. Extra columns are ignored; an empty table gives an empty result.

    Rows are dealt into ranges of (id, hash); a range is sorted and read in falling order, a row at a time. The
    first row of each range is also sent to the range above, where it follows the last (that of the highest to the
    lowest). So texts are shuffled once, and nothing but boundaries (``IDS_PER_CUT`` ids looked at for each, picked by
    a hash) and the first row's (id, hash) of each range reaches the driver.
    """
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    texts = texts.withColumn("__place", F.struct(F.col("__id").isNotNull().alias("there"), F.col("__id").alias("id"), F.xxhash64("__text").alias("hash")))
    kind = docs.schema[id_col].dataType
    out = StructType([StructField(id_col, kind), *StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    n = docs.count()
    ranges = min(n // BUCKET_ROWS, MOST_RANGES)
    cuts = []
    if ranges > 1:
        share = min(1.0, IDS_PER_CUT * ranges / n)
        picked = texts.where(F.xxhash64("__id", F.col("__place.hash"), F.lit(5)).cast("double") < share * 2.0**64 - 2.0**63)
        found = [tuple(r["p"]) for r in picked.select(F.col("__place").alias("p")).distinct().orderBy("p").collect()]
        step = max(1, len(found) // ranges)
        cuts = found[step::step]

    @F.pandas_udf("int")
    def bucket_of(place: pd.DataFrame) -> pd.Series:
        rows = zip(*(place[c].tolist() for c in ("there", "id", "hash")), strict=True)
        return pd.Series([bisect_right(cuts, r if r[0] else (False,)) for r in rows], dtype="int32")

    dealt = texts.withColumn("__bucket", bucket_of("__place") if cuts else F.lit(0))
    heads = {r[0]: r[1] for r in dealt.groupBy("__bucket").agg(F.max("__place")).collect()}
    filled = sorted(heads)
    above = dict(zip(filled, filled[1:] + filled[:1], strict=True))
    table = docs.sparkSession.createDataFrame([(b, v, above[b]) for b, v in heads.items()], StructType([StructField("__bucket", IntegerType()), StructField("__head", texts.schema["__place"].dataType), StructField("__above", IntegerType())]))
    # one small row for each range, MOST_RANGES at most
    dealt = dealt.join(F.broadcast(table), "__bucket")
    here = F.struct(F.col("__bucket"), F.lit(False).alias("tail"))
    places = F.when(F.col("__place").eqNullSafe(F.col("__head")), F.array(here, F.struct(F.col("__above").alias("__bucket"), F.lit(True).alias("tail")))).otherwise(F.array(here))
    placed = dealt.select("__id", "__text", F.col("__place.hash").alias("__hash"), F.explode(places).alias("p")).select("__id", "__text", "p.__bucket", F.col("p.tail").alias("__tail"), "__hash")
    ordered = placed.repartition("__bucket").sortWithinPartitions("__bucket", "__tail", F.desc_nulls_last("__id"), F.desc("__hash"), F.desc("__text"))
    return ordered.mapInArrow(lambda batches: follow(batches, out), out)


def follow(batches: Iterator[pa.RecordBatch], out: StructType) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in falling order; each waits for the row after it in its range."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sampler, schema, waiting = Sampler(), to_arrow_schema(out), None
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        rows = []
        for key, text, bucket, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = None if tail and (waiting is None or waiting[0] != bucket) else sampler.signature(text)
            if waiting is not None and waiting[0] == bucket:
                _, its_key, its_text, its = waiting
                changed = edited(its_text, text)
                new = sampler.signature(changed)
                rows.append((its_key, len(its_text), hashlib.sha256(changed.encode()).hexdigest(), its.tobytes().hex(), new.tobytes().hex(), likeness(its, new), likeness(its, own)))
            waiting = None if tail else (bucket, key, text, own)
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
