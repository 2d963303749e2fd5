"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

1. Vectors at length 1 are taken relative to the mean of their label (of labels with ``OWN_MEAN`` rows or more in a
   bounded sample of ``SAMPLE`` rows, else of the sample) and projected on at most ``CODE_DIMS`` principal axes. Rotations
   are learned there by iterative quantisation: alternating signs and orthogonal Procrustes, so that signs are balanced
   and near the vectors. Each rotation gives a binary code of as many bits as there are axes.
2. Codes are cut into substrings; each substring is a hash table. Vectors of one label that agree on a whole
   substring share a bucket of that table. Substrings get longer as the largest label grows, so that a balanced
   bucket holds about ``BUCKET`` vectors. A link's ends are at most d apart, d * d = 2 - 2 * least, before and after the
   projection. Where both are farther than ``near`` from the mean, the angle between them there is 2 * asin(d / 2 / near)
   at most, and there are as many tables as such a pair needs to miss all of them with probability ``MISS`` at most, if
   bits differ independently. Vectors within near + d of the mean, where angles say little, meet in one bucket of their
   own as well, or there alone within ``near`` (see ``plan_tables``): a label that is one narrow cone is compared whole,
   as most of its pairs are links.
3. Within a bucket every pair is reranked with the original vectors in double precision, in blocks: a bucket of
   more than ``BLOCK`` vectors is cut into chunks and each pair of chunks is one task's work. A pair is counted in
   the first table that holds it, so blocks return counts for each vector and a spanning set of links, never pairs.
4. Connected components of these links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import sample_order, written
from .components import connected_components

SAMPLE, ITERATIONS, BLOCK = 10_000, 40, 1024
#: Bits of a substring at least, and at most (keys are 32-bit integers); vectors of a bucket; probability of a miss.
BITS, MOST_BITS, BUCKET, MISS = 12, 30, 64, 1e-7
#: Tables at most, which bounds how near the mean angles are used; share of the vectors beyond that in the middle bucket.
MOST_TABLES, MIDDLE = 128, 0.01
#: Dimensions of a code, and those learned on (longer vectors are folded for their codes only); rows of a label with a
#: mean of its own.
CODE_DIMS, LEARN_DIMS, OWN_MEAN = 256, 1024, 64


def tables_for(angle: float, bits: int) -> int:
    """Tables of ``bits`` bits that a pair at ``angle`` needs to miss all of them with probability ``MISS`` at most."""
    agree = (1 - angle / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-min(agree, 1 - 1e-12))) if agree > 1e-12 else 1 << 40


def plan_tables(most: int, dims: int, least: float, radii: np.ndarray) -> tuple[int, int, float, float]:
    """Bits of a substring, rotations, and two distances from the mean: ``near``, up to which vectors are in the middle
    bucket alone, and that up to which they are in it too. ``radii``: distances of the sample from their means; ``most``:
    vectors in the largest label."""
    bits = min(dims, MOST_BITS, max(BITS, math.ceil(math.log2(max(1, most / BUCKET)))))
    apart = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    angle = lambda near: 2 * math.asin(min(1.0, apart / 2 / near))
    low, high = apart / 2, 2.0
    for _ in range(60):  # the least distance at which the tables suffice
        middle = (low + high) / 2
        low, high = (low, middle) if tables_for(angle(middle), bits) <= MOST_TABLES else (middle, high)
    beyond = np.sort(radii[radii > high + apart])
    share = min(MIDDLE, math.sqrt(MOST_TABLES * BUCKET / max(1, most)))
    near = max(high, beyond[int(share * len(beyond))] - apart if len(beyond) else high)
    return bits, max(1, math.ceil(tables_for(angle(near), bits) / max(1, dims // bits))), near, near + apart


def folded(units: list[np.ndarray], dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers: a vector padded with zeros, or, if it is longer, projected on sums of its components with
    signs by a fixed pseudo-random place of each (at length 1, so that no distance grows)."""
    out, places = np.zeros((len(units), dims)), {}
    for row, u in zip(out, units, strict=True):
        if len(u) <= dims:
            row[: len(u)] = u
        else:
            if len(u) not in places:
                rng = np.random.default_rng(5)
                place = rng.integers(0, dims, len(u))
                places[len(u)] = place, rng.choice([-1.0, 1.0], len(u)), np.sqrt(np.maximum(np.bincount(place, minlength=dims), 1))
            place, sign, length = places[len(u)]
            row += np.bincount(place, u * sign, dims) / length
    return out


def units_of(vectors: pa.Array, scale: pa.Array, norm: pa.Array) -> list[np.ndarray]:
    """The vectors, none of them null or holding nulls, at length 1."""
    ends = np.cumsum([len(v) for v in vectors])[:-1]
    parts = np.split(vectors.flatten().to_numpy(zero_copy_only=False), ends)
    return [v / s / n for v, s, n in zip(parts, scale.to_pylist(), norm.to_pylist(), strict=True)]


def means_of(x: np.ndarray, labels: list[str]) -> dict[str | None, np.ndarray]:
    """The mean of each label with ``OWN_MEAN`` rows or more, and, by None, of all rows."""
    rows: dict[str | None, list[int]] = {}
    for i, label in enumerate(labels):
        rows.setdefault(label, []).append(i)
    found = {label: x[own].mean(axis=0) for label, own in rows.items() if len(own) >= OWN_MEAN}
    return found | {None: x.mean(axis=0) if len(x) else np.zeros(x.shape[1])}


def from_means(x: np.ndarray, labels: list[str], means: dict) -> np.ndarray:
    return x - np.stack([means.get(label, means[None]) for label in labels]) if len(x) else x


def principal_axes(centred: np.ndarray) -> np.ndarray:
    """At most ``CODE_DIMS`` orthonormal axes as columns, those along which rows differ most."""
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(centred.shape[1]))
    return axes[:, ::-1][:, :CODE_DIMS]


def learn_rotations(v: np.ndarray, rotations: int, seed: int = 11) -> np.ndarray:
    """``rotations`` matrices (dims x dims, side by side) learned by iterative quantisation on rows of v."""
    rng, dims, out = np.random.default_rng(seed), v.shape[1], []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(ITERATIONS if len(v) else 0):
            u, _, wt = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
            r = u @ wt
        out.append(r)
    return np.hstack(out)


def table_keys(v: np.ndarray, rotations: np.ndarray, bits: int) -> np.ndarray:
    """The substrings of each row's codes as integers, a column for each table."""
    signs = (v @ rotations) >= 0
    dims = v.shape[1]
    cut = [signs[:, r * dims + i : r * dims + i + bits] for r in range(rotations.shape[1] // dims) for i in range(0, max(1, dims - bits + 1), bits)]
    return np.stack([c @ (1 << np.arange(c.shape[1], dtype=np.int64)) for c in cut], axis=1).astype(np.int32)


def links_of_block(unit: np.ndarray, keys: np.ndarray, weight: np.ndarray, chunk: np.ndarray, table: int, least: float):
    """(row, links counted here, row of the smallest id it reaches within the block) for linked rows.

    Rows come in rising order of ids. Rows of two chunks are compared across them only, rows of one chunk with each
    other. The last column of ``keys`` tells whether a row is in the tables at all; the middle bucket comes after them.
    """
    n = len(unit)
    near = unit @ unit.T >= least
    if chunk.min() != chunk.max():
        near &= chunk[:, None] != chunk[None, :]
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    fresh = np.ones(len(i), bool)
    for t in range(table):
        fresh &= keys[i, t] != keys[j, t]
    if table == keys.shape[1] - 1:
        fresh |= (keys[i, -1] & keys[j, -1]) == 0
    count_i, count_j = i[fresh], j[fresh]
    counts = np.bincount(count_i, weight[count_j], n).astype(np.int64)
    root = np.arange(n)
    while len(i):  # least linked row by propagation and jumping
        new = root.copy()
        np.minimum.at(new, i, root[j])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    linked = np.unique(i)
    return linked, counts[linked], root[linked]


def near_embeddings(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Columns id_col, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Two rows are linked if their labels are equal and not null and the cosine of their vectors, in double precision,
    is ``least`` or more. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null id or label, link with nothing. Vectors are scaled before they are squared, so no finite vector is too long
    or too short. Equal vectors are one class with its count. Vectors of different lengths are not compared. Of rows with one id each is a row of the result; links between them count. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    sound = F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("__v", lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("__v"))
    good = rows.where("id is not null and label is not null and __v is not null").where(sound)
    # the power of two below the largest component: dividing by it is exact and keeps squares finite
    scale = F.pow(F.lit(2.0), F.least(F.floor(F.log2(F.array_max(F.transform("__v", F.abs)))), F.lit(1023)).cast("double"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + (x / F.col("scale")) * (x / F.col("scale"))))
    one_each = good.groupBy("label", "__v").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    sized = one_each.withColumn("scale", scale).withColumn("norm", norm).withColumn("cls", F.xxhash64("label", "__v"))
    classes = written(sized.withColumn("label", F.concat_ws("\u0001", "label", F.size("__v").cast("string"))))
    by_label = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("__v")).alias("d"))
    most, longest = by_label.agg(F.max("n"), F.max("d")).first()
    dims = min(longest or 1, LEARN_DIMS)

    def in_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = folded(units_of(*batch.columns[:3]), dims)
            yield pa.RecordBatch.from_arrays([pa.array([u.tobytes() for u in x], pa.binary()), batch.column(3)], names=["unit", "label"])

    sample = classes.select("id", sample_order("id").alias("o"), "__v", "scale", "norm", "label").orderBy("o", "id", "__v").limit(SAMPLE)
    learned = sample.select("__v", "scale", "norm", "label").mapInArrow(in_short, "unit binary, label string").collect()
    x, of_rows = np.frombuffer(b"".join(r["unit"] for r in learned)).reshape(-1, dims), [r["label"] for r in learned]
    means = means_of(x, of_rows)
    centred = from_means(x, of_rows, means)
    axes = principal_axes(centred)
    projected = centred @ axes
    bits, turns, near, upto = plan_tables(most or 1, axes.shape[1], least, np.sqrt((projected**2).sum(axis=1)))
    rotations = learn_rotations(projected, turns)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, vectors, id_, weight, scale_, norm_, cls = batch.columns
            units = units_of(vectors, scale_, norm_)
            v = from_means(folded(units, dims), label.to_pylist(), means) @ axes
            radius = np.sqrt((v**2).sum(axis=1))
            keys = np.column_stack([table_keys(v, rotations, bits), (radius > near).astype(np.int32)])
            tables = keys.shape[1] - 1
            slots = [[*(enumerate(k[:tables]) if k[tables] else ()), *([(tables, 0)] if r <= upto else ())] for k, r in zip(keys.tolist(), radius, strict=True)]
            placed = [pa.array([[slot[k] for slot in own] for own in slots], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([cls, id_, label, weight, pa.array([u.tobytes() for u in units], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()), *placed], names=["cls", "id", "label", "weight", "unit", "codes", "table", "key"])

    id_type = classes.schema["id"].dataType.simpleString()
    codes = written(classes.select("label", "__v", "id", "weight", "scale", "norm", "cls").mapInArrow(coded, f"cls long, id {id_type}, label string, weight long, unit binary, codes binary, table array<int>, key array<int>"))
    slots = codes.select("cls", "id", "label", F.explode(F.arrays_zip("table", "key")).alias("s")).select("cls", "id", "label", "s.table", "s.key")
    sizes = slots.groupBy("label", "table", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int"))
    shared = slots.join(sizes, ["label", "table", "key"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, "chunk").alias("c"), F.greatest(j, "chunk").alias("d"))))
    dealt = shared.select("cls", "id", "label", "table", "key", "chunk", met.alias("m")).select("cls", "id", "label", "table", "key", "chunk", "m.c", "m.d")
    # a class is known by its hash and its least id together
    keyed = dealt.join(codes.select("cls", "label", "id", "weight", "unit", "codes"), ["cls", "id", "label"])
    group = ["label", "table", "key", "c", "d"]
    ordered = keyed.select(*group, "id", "weight", "unit", "codes", "chunk", "cls").repartition(*group).sortWithinPartitions(*group, "id")

    arrow_types = [pa.int64(), pa.int64(), *[to_arrow_type(classes.schema["id"].dataType)] * 2]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            ids, weight, unit, codes_, chunk, cls = zip(*rows, strict=True)
            unit = np.frombuffer(b"".join(unit), np.float64).reshape(len(ids), -1)
            keys = np.frombuffer(b"".join(codes_), np.int32).reshape(len(ids), -1)
            row, counts, root = links_of_block(unit, keys, np.array(weight), np.array(chunk), current[1], least)
            return [cls[i] for i in row], counts.tolist(), [ids[i] for i in row], [ids[i] for i in root]

        current, waiting = None, []
        for batch in batches:
            found = []
            cols = [batch.column(i).to_pylist() for i in range(11)]
            for key, row in zip(zip(*cols[:5], strict=True), zip(*cols[5:], strict=True), strict=True):
                if key != current:
                    if len(waiting) > 1:
                        found.append(solve(waiting))
                    current, waiting = key, []
                waiting.append(row)
            yield from blocks_out(found)
        if len(waiting) > 1:
            yield from blocks_out([solve(waiting)])

    def blocks_out(found):
        if found:
            columns = [[v for part in parts for v in part] for parts in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow_types, strict=True)], names=["cls", "links", "id", "root"])

    links = written(ordered.mapInArrow(compare, f"cls long, links long, id {id_type}, root {id_type}"))
    components = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    counted = links.groupBy("cls", F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    of_class = classes.select("cls", F.col("id").alias("rep"), "label", "__v", "weight").join(counted, ["cls", "rep"], "left").drop("cls").join(components, F.col("rep") == F.col("node"), "left").drop("node")
    answer = rows.withColumn("label", F.concat_ws("\u0001", "label", F.size("__v").cast("string"))).join(of_class, ["label", "__v"], "left")
    whole = F.coalesce("component", "rep", "id")
    alone = F.col("rep").isNull() | F.col("id").isNull()
    return answer.select(
        F.col("id").alias(id_col),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(whole).alias("component_id"),
        F.coalesce(F.when(alone, F.lit(True)).otherwise(whole == F.col("id")), F.lit(True)).alias("kept"),
    )
