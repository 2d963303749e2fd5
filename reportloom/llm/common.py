"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Used only where all tasks run on this machine and the session names no shared folder (tests).
LOCAL_CHECKPOINTS = "/tmp/reportloom-checkpoints"
#: Bytes of text that one call of a batch function gets at most (a single longer text goes alone), and rows of an
#: Arrow batch that are Python objects at a time.
BATCH_BYTES, SLICE_ROWS = 2 << 20, 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which a cluster must name."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return LOCAL_CHECKPOINTS
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/reportloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def dropped(*frames: DataFrame) -> None:
    """Remove the files of frames that ``written`` returned and nothing reads any more."""
    for df in frames:
        if path := vars(df).get("_written_to"):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(id_col: str) -> Column:
    """True where crc32(id as text) mod 3 is 1: rows that no model learns labels from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample_order(id_col: str) -> Column:
    """A fixed pseudo-random order of rows, the same on every run and cluster."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(7))


def by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``most`` bytes (UTF-8) each, or of one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        own = len(t) if t.isascii() else len(t.encode("utf-8", "replace"))
        if i > start and size + own > most:
            yield start, i
            start, size = i, 0
        size += own
    if start < len(texts):
        yield start, len(texts)


SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def safe_parts(text: str) -> list[str]:
    """``text`` cut at, and without, each single space between two characters that are no white space."""
    plain = "  " not in text and " \n" not in text and "\n " not in text and text[:1] != " " and text[-1:] != " "
    if plain and len(text.replace(" ", "").replace("\n", "").split()) < 2 and not text[:1].isspace() and not text[-1:].isspace():
        return text.split(" ")
    return SAFE_SPACE.split(text)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, a slice of it at a time."""
    for i in range(0, batch.num_rows, SLICE_ROWS):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, SLICE_ROWS).columns), strict=True)


def map_texts(df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable[[list[str]], list[list]]], keep: list[str]) -> DataFrame:
    """Add columns computed from a text column, batch by batch, to the columns ``keep``.

    ``make()`` runs once a task and returns a function from a list of texts (null read as empty) to a list of
    columns in the order of ``schema``. Only ``keep`` and the text column are read, so other columns, whatever
    their names, never reach the Python workers.
    """
    fields = [f for f in df.select(*keep).schema.fields]
    extra = StructType.fromDDL(schema).fields
    out = StructType([*fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        call, arrow = make(), to_arrow_schema(out)
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            texts = [t or "" for t in batch.column(len(fields)).to_pylist()]
            parts: list[list] = [[] for _ in extra]
            for a, b in by_bytes(texts):
                for whole, part in zip(parts, call(texts[a:b]), strict=True):
                    whole.extend(part)
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(fields))]
            arrays += [pa.array(p, arrow.field(len(fields) + i).type) for i, p in enumerate(parts)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    chosen = df.select(*[F.col(k) for k in keep], F.col(text_col).cast("string").alias("__text"))
    return chosen.mapInArrow(run, out)


#: What a fitted model is trained on at most: so many rows of each class, in a fixed pseudo-random order of ids, and
#: no further row once those before it have so many characters. Both bound what reaches the driver; no row is left
#: out for its own length, and scoring reads every text whole.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 16 << 20


def sample_of(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> list:
    """Rows (id_col, group_cols, __text) of the ids ``picked`` (id_col, group_cols; few), in a fixed order, within
    ``SAMPLE_CHARS`` for each group. Of a repeated id the least text counts; null texts are empty."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    one_each = texts.join(F.broadcast(picked), id_col).groupBy(id_col, *group_cols).agg(F.min("__text").alias("__text"))
    before = Window.partitionBy(*group_cols).orderBy(sample_order(id_col), id_col).rowsBetween(Window.unboundedPreceding, -1)
    within = one_each.withColumn("__before", F.sum(F.length("__text")).over(before)).where(f"coalesce(__before, 0) < {SAMPLE_CHARS}")
    return within.drop("__before").orderBy(id_col).collect()


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_ROWS) -> tuple[list[str], list[str], float]:
    """Texts of rows labelled 0, texts of rows labelled 1, and the share of 1 among all rows to learn from.

    Rows are taken in a fixed pseudo-random order of their ids, ``per_class`` of each class at most, never from
    the held-out third. Labels other than 0 and 1 are ignored; of a repeated id the greatest label and the least
    text count.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    shares = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    total = sum(shares.values())
    picked = None
    for label in (0, 1):
        some = known.where(F.col("__label") == label).orderBy(sample_order(id_col), id_col).limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = sample_of(docs, picked, id_col, text_col, ["__label"])
    bad, good = ([r["__text"] for r in rows if r["__label"] == k] for k in (0, 1))
    return bad, good, shares.get(1, 0) / total if total else 0.5


def fit_logistic(x, y, weight, steps: int = 50, ridge: float = 1e-3, known=None):
    """Weights of a weighted logistic regression by Newton steps; the last weight is the constant. On top of
    ``known`` log-odds, there is no constant."""
    import numpy as np

    x, known = (np.column_stack([x, np.ones(len(y))]), 0.0) if known is None else (x, known)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + known, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Ids that a filtering join broadcasts at most; beyond that both sides are shuffled.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (a column ``id``); null ids stay."""
    ids = written(gone.select(F.col("id").alias("__gone")).where("__gone is not null").distinct())
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids["__gone"], "left_anti")


def only(df: DataFrame, ids: DataFrame, id_col: str, more: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` whose ``id_col`` is in ``ids``, with the columns ``more`` of ``ids``."""
    wanted = written(ids.select(id_col, *(more or [])).distinct())
    few = wanted.count() <= BROADCAST_IDS
    return df.join(F.broadcast(wanted) if few else wanted, id_col)
