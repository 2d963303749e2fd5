"""Near-duplicate documents by MinHash, banding and sequential Bayesian verification.

1. Each text gives its set of word shingles (64-bit hashes), the set's key and a MinHash signature. Texts with equal
   sets are one node from here on, named by the key.
2. Nodes that share a band of the signature are candidates. A bucket, of any size, first compares each node with its
   least node (the lead) only; the links found give first components.
3. In a bucket whose other nodes are still of several components, the nodes outside its largest one are compared
   with all others, but for pairs that an earlier band holds and pairs of one component. Both sides are cut into
   chunks, and a pair of chunks is a cell.
4. Leads with their buckets and pairs of chunks are compared by the same code, cell by cell and without writing pairs.
   Signatures are compared batch by batch: after each batch the posterior of the similarity (uniform prior, binomial
   likelihood) is asked how likely it reaches the threshold; below ``MISS`` the pair is dropped. Only nodes left with
   a partner are sent on with their texts, for exact verification on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_texts, only, rows_of, without, written
from .components import connected_components

#: BANDS * ROWS hashes; two sets of similarity 0.8 share no band with probability (1 - 0.8**6)**32 = 6e-5.
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
#: Hashes compared between two looks at the posterior, and the chance at which a look may drop a true link.
BATCH, MISS = 32, 1e-6
#: Sets that a cell holds on either side, and shingles of the side it keeps in memory, about: larger buckets are cut.
CELL_SETS, CELL_SHINGLES = 1024, 1 << 20
MEMO_WORDS = 150_000
_random = np.random.default_rng(20_240_229)
MULTIPLY = _random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, HASHES, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``words`` words."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def __call__(self, text: str) -> np.ndarray:
        # bytes.lower() changes A-Z alone, bytes.split() cuts at 0x20 and 0x09-0x0D alone
        tokens, memo = text.encode().lower().split(), self.memo
        if not tokens:
            return np.zeros(0, np.uint64)
        try:
            hashed = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            new = set(tokens).difference(memo)
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = set(tokens)
            memo.update((t, xxhash.xxh64_intdigest(t)) for t in new)
            hashed = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        size = min(self.words, len(hashed))
        with np.errstate(over="ignore"):
            shingles = np.full(len(hashed) - size + 1, size, np.uint64)
            for i in range(size):
                shingles = mix(shingles * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(hashed) - size + 1 + i])
        return np.unique(shingles)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The signature: for each hash function its least value over the set, as 32 bits."""
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            part = shingles[i : i + 1024, None] * MULTIPLY + ADD
            part ^= part >> np.uint64(32)
            np.minimum(least, part.min(axis=0), out=least)
        return (mix(least) >> np.uint64(32)).astype(np.uint32)


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Columns id_col, n_shingles, set_key, signature (the last two null for empty sets)."""

    def make():
        shingler = Shingler(words)

        def call(texts):
            sizes, keys, signatures = [], [], []
            for t in texts:
                s = shingler(t)
                sizes.append(len(s))
                keys.append(key_of(s) if len(s) else None)
                signatures.append(minhash(s).tobytes() if len(s) else None)
            return [sizes, keys, signatures]

        return call

    return map_texts(docs, text_col, "n_shingles long, set_key binary, signature binary", make, [id_col])


def key_of(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def bands() -> Column:
    """The keys of a signature's bands, in order; equal keys of one place mean an equal band."""
    width = 4 * ROWS
    return F.array(*[F.xxhash64(F.substring("signature", 1 + width * i, width), F.lit(i)) for i in range(BANDS)])


def least_matches(threshold: float) -> list[tuple[int, int]]:
    """(hashes compared, matches needed): with fewer, P(similarity >= threshold | matches) < MISS.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the binomial
    P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= MISS:
                break
        out.append((n, m))
    return out


class Cell:
    """The nodes that a cell holds, for comparison with those that are read after them."""

    def __init__(self, needed: list[tuple[int, int]]):
        self.needed, self.rows, self.parts, self.number = needed, [], [], {}
        self.signatures: np.ndarray | None = None

    def part_of(self, part) -> int:
        return self.number.setdefault(part, len(self.number))

    def hold(self, row: tuple, part, signature: bytes) -> None:
        self.rows.append([*row, signature])
        self.parts.append(self.part_of(part))

    def near(self, part, signature: bytes, table: int) -> np.ndarray:
        """Places of held nodes of other parts that may be similar enough, the likeliest first.

        Pairs that agree on one of the first ``table`` bands are left out: they meet there.
        """
        if self.signatures is None:
            self.signatures = np.frombuffer(b"".join(r[-1] for r in self.rows), np.uint32).reshape(-1, HASHES)
            self.parts = np.array(self.parts, np.int64)
        own = np.frombuffer(signature, np.uint32)
        left, at = np.flatnonzero(self.parts != self.part_of(part)), 0
        matches = np.zeros(len(self.rows), np.int64)
        for n, least in self.needed:
            matches[left] += (self.signatures[left, at:n] == own[at:n]).sum(axis=1)
            left, at = left[matches[left] >= least], n
        if table and len(left):
            end = table * ROWS
            left = left[~(self.signatures[left, :end] == own[:end]).reshape(len(left), table, ROWS).all(axis=2).any(axis=1)]
        return left[np.argsort(-matches[left], kind="stable")]


#: A row of a cell: which cell (job, i, j), held (0) or read after those (1), bands of earlier tables, node, component.
CELL = ["job", "i", "j", "role", "idx", "node", "part"]


def in_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*CELL, *columns).repartition("job", "i", "j").sortWithinPartitions("job", "i", "j", "role")


def with_likely_partner(rows: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """The rows of cells (``CELL``), with signatures, that the sequential test leaves a partner in their cell."""
    needed = least_matches(threshold)
    full = in_cells(rows.join(signatures, "node"), ["signature"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cell, hit, names = None, Cell(needed), set(), None
        for batch in batches:
            out, names = [], batch.schema
            for *row, signature in rows_of(batch):
                if tuple(row[:3]) != current:
                    out += [cell.rows[k] for k in hit]
                    current, cell, hit = tuple(row[:3]), Cell(needed), set()
                if row[3] == 0:
                    cell.hold(row, row[6], signature)
                elif cell.rows and len(found := cell.near(row[6], signature, row[4])):
                    hit.update(found.tolist())
                    out.append([*row, signature])
            yield from as_batch(out, batch.schema)
        if hit:
            yield from as_batch([cell.rows[k] for k in hit], names)

    return full.mapInArrow(test, full.schema)


def as_batch(rows: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def links_of(rows: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links (a, b) that join all components linked within a cell; ``rows`` with signatures, ``texts``: node, text.

    A link is a pair with intersection / union >= threshold on the full sets. A text whose set is not its node's (a
    repeated id has several) is passed over.
    """
    needed, per_cent = least_matches(threshold), round(threshold * 100)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, current, cell, joined = Shingler(words), None, Cell(needed), {}

        def own_set(text, node):
            found = shingler(text or "")
            return found if key_of(found) == node else found[:0]

        def root(part):
            while (up := joined.get(part, part)) != part:
                part = up
            return part

        for batch in batches:
            out = []
            for *row, signature, text in rows_of(batch):
                if tuple(row[:3]) != current:
                    current, cell, joined = tuple(row[:3]), Cell(needed), {}
                node, part = row[5:7]
                if row[3] == 0:
                    cell.hold([part, node, text], part, signature)
                    continue
                own = None
                for k in cell.near(part, signature, row[4]).tolist() if cell.rows else ():
                    held = cell.rows[k]
                    if root(held[0]) == root(part):
                        continue
                    own = own_set(text, node) if own is None else own
                    if not isinstance(held[2], np.ndarray):
                        held[2] = own_set(held[2], held[1])
                    both = len(np.intersect1d(own, held[2], assume_unique=True))
                    if both and 100 * both >= per_cent * (len(own) + len(held[2]) - both):
                        out.append((node, held[1]))
                        joined[root(held[0])] = root(part)
            yield from as_batch(out, pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return in_cells(rows.join(texts, "node"), ["signature", "text"]).mapInArrow(test, "a binary, b binary")


def star_cells(shared: DataFrame) -> DataFrame:
    """Each lead against the other nodes of its buckets, in cells of CELL_SETS or so."""
    pairs = shared.where("node != lead").select("lead", "node").distinct()
    chunks = pairs.groupBy("lead").agg(F.ceil(F.count("*") / CELL_SETS).cast("int").alias("chunks"))
    job, zero = F.xxhash64("lead").alias("job"), F.lit(0)
    held = chunks.select(job, F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("i"), zero.alias("j"), zero.alias("role"), zero.alias("idx"), F.col("lead").alias("node"), F.col("lead").alias("part"))
    met = pairs.join(chunks, "lead").select(job, F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("i"), zero.alias("j"), F.lit(1).alias("role"), zero.alias("idx"), "node", F.col("node").alias("part"))
    return held.unionByName(met)


def open_cells(shared: DataFrame, found: DataFrame) -> DataFrame:
    """What stars leave open: in each bucket, without its lead, the nodes outside the largest component against all."""
    rest = written(shared.where("node != lead").join(found, "node", "left").select("idx", "band", "node", "size", F.coalesce("component", "node").alias("part")))
    parts = rest.groupBy("band", "part").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    jobs = parts.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts")).where("parts > 1")
    jobs = jobs.select("band", "main", F.ceil((F.col("n") - F.col("most")) / CELL_SETS).cast("int").alias("rows"), F.ceil(F.greatest(F.col("n") / CELL_SETS, F.col("shingles") / CELL_SHINGLES)).cast("int").alias("columns"))
    dealt = rest.join(jobs, "band").withColumnRenamed("band", "job")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = dealt.select("job", every("rows").alias("i"), F.pmod(F.xxhash64("node"), "columns").cast("int").alias("j"), F.lit(0).alias("role"), "idx", "node", "part")
    met = dealt.where("part != main").select("job", F.pmod(F.xxhash64("node", F.lit(1)), "rows").cast("int").alias("i"), every("columns").alias("j"), F.lit(1).alias("role"), "idx", "node", "part")
    return held.unionByName(met)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_shingles, component_id, kept (id = component_id), a row for each row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words, A-Z lower-cased; with fewer words the whole
    sequence is one shingle; null and empty texts have an empty set, linked with nothing. Two sets are linked if
    intersection / union >= ``threshold``. component_id is the smallest id reachable by links, itself included.
    Equal sets are always linked. Rows with a null id have a null component and are kept. Rows of one id are one
    document, linked to whatever any of its texts is linked to. Extra columns are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    sketches = written(sketch(rows, words, "doc", "text"))
    members = sketches.where("n_shingles > 0 and doc is not null")
    nodes = written(members.groupBy(F.col("set_key").alias("node")).agg(F.min("doc").alias("rep"), F.first("n_shingles").cast("int").alias("size"), F.first("signature").alias("signature")))

    keys = nodes.select("node", "size", F.posexplode(bands()).alias("idx", "band"))
    buckets = keys.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("top")).where("lead < top").select("band", "lead")
    shared = written(keys.join(buckets, "band").select("idx", "band", "lead", "node", "size"))
    met = written(only(nodes, shared.select("node"), "node"))
    signatures = met.select("node", "signature")

    def links(cells: DataFrame) -> DataFrame:
        likely = written(with_likely_partner(cells, signatures, threshold))
        reps = met.select("node", F.col("rep").alias("doc")).join(likely.select("node").distinct(), "node", "left_semi")
        texts = only(rows, reps, "doc", ["node"]).select("node", "text")
        found = written(links_of(likely, texts, words, threshold))
        dropped(likely)
        return found

    first = links(star_cells(shared))
    found = connected_components(first)
    second = links(open_cells(shared, found))

    # a document of several texts is one document: its id links them
    several = members.groupBy("doc").agg(F.min("set_key").alias("a"), F.max("set_key").alias("z")).where("a < z").select("doc", "a")
    same_id = members.join(several, "doc").select("a", F.col("set_key").alias("b"))
    components = connected_components(first.unionByName(second).unionByName(same_id))
    in_components = nodes.select("node", "rep").join(components, "node")
    least = in_components.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = in_components.join(least, "component").select("node", "component_id")
    of_node = nodes.select("node", "rep").join(linked, "node", "left").select(F.col("node").alias("set_key"), F.coalesce("component_id", "rep").alias("component"))
    final = sketches.select("doc", "n_shingles", "set_key").join(of_node, "set_key", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    result = written(final.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept")))
    dropped(sketches, nodes, shared, met, first, second, found, components)
    return result


def keep_one_each(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest of their group.

    Rows with one id are one document: all or none stay. Rows with a null id, and null, empty and wordless texts,
    stay. An empty table gives an empty result.
    """
    found = near_duplicates(docs, words, threshold, id_col, text_col)
    return without(docs, found.where("not kept").select(F.col(id_col).alias("id")), id_col)
