"""Packing of token sequences into windows by best-fit decreasing, for any number of documents.

Overlong documents are first cut into full windows; the rest of each document is one piece. Best-fit decreasing
treats pieces of one length alike, and windows with the same room alike. So the plan needs only how many pieces
there are of each length: at most ``window`` numbers, summed by Spark, whatever the corpus. The driver runs the
very best-fit decreasing over these counts: lengths in falling order, each into the tightest open window, which a
segment tree indexed by remaining capacity finds; equal pieces fill equal windows many at a time. The plan is a
list of runs ("the pieces a..b of this length fill n windows from window w on, k in each, at offset o"), and each
piece finds its own run by its rank among the pieces of its length. No piece passes through the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import load
from .common import map_texts, written

#: Ranks are counted first within parts: so many at least, and one for each so many pieces.
RANK_PARTS, PART_PIECES = 64, 1_000_000


class RoomTree:
    """Segment tree over remaining capacities 0..n: which have open windows, and the least such from a value on."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.leaves
        self.any[i] = is_open
        while i := i >> 1:
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least open remaining capacity that is at least ``need``."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan_best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, each, first window, offset): piece ``first rank + j`` of that length is in
    window ``first window + j // each`` at ``offset + (j % each) * length``. Windows are numbered from 0 without gaps.

    ``counts`` gives how many pieces have each length from 1 to ``window``. The result equals best-fit decreasing
    piece by piece, where a piece goes to the tightest window that holds it and else opens one.
    """
    runs, tree = [], RoomTree(window)
    rooms: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: [(first window, windows)]
    opened = 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            each = (window if room is None else room) // length
            if room is None:
                first, n = opened, -(-left // each)
                opened += n
                room = window
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            used = min(n, -(-left // each))
            pieces = min(left, used * each)
            runs.append((length, rank, pieces, each, first, window - room))
            full = pieces // each
            add(room - each * length, first, full)
            if used > full:
                add(room - (pieces - full * each) * length, first + full, 1)
            add(room, first + used, n - used)
            left, rank = left - pieces, rank + pieces
    return runs


def cut_pieces(docs: DataFrame, vocab_path: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, start, length, ids_crc32, doc_tokens, a row for each piece of each document.

    A document's ids are those of its text (null: empty) and ``end_id`` at the end; so each has a piece at least.
    """

    def make():
        bpe, end = load(vocab_path), end_id.to_bytes(4, "little")

        def call(texts):
            packed = [p + end for p in bpe.encode_all(texts)]
            step = 4 * window
            return [[[{"start": i // 4, "length": len(p[i : i + step]) // 4, "ids_crc32": zlib.crc32(p[i : i + step])} for i in range(0, len(p), step)] for p in packed], [len(p) // 4 for p in packed]]

        return call

    cut = map_texts(docs, text_col, "piece array<struct<start:long,length:long,ids_crc32:long>>, doc_tokens long", make, [id_col])
    return cut.select(id_col, F.explode("piece").alias("piece"), "doc_tokens").select(id_col, "piece.*", "doc_tokens")


def place(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """``pieces`` (with ``length``) and their sequence_id and offset.

    Ranks among pieces of one length come from counts by (part, length), where parts hash all columns, and a
    running number within each part: no length, however common, meets in one task. Parts grow in number with the
    pieces; the driver sees a count for each length only.
    """
    own = pieces.columns
    parts = max(RANK_PARTS, -(-pieces.count() // PART_PIECES))
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64(*own), F.lit(parts)))
    counts = written(dealt.groupBy("__part", "length").agg(F.count("*").alias("__n")))
    runs = plan_best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, window)
    if not runs:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    by_length: dict[int, list] = {}
    for run in runs:
        by_length.setdefault(run[0], []).append(run[1:])
    starts = {k: [r[0] for r in v] for k, v in by_length.items()}

    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", "length", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part", "length").orderBy(*own)) - 1)
    ranked = within.join(before, ["__part", "length"]).withColumn("__at", F.col("__before") + F.col("__rank"))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            sequence, offset = [], []
            for length, at in zip(*(rows.column(c).to_pylist() for c in ("length", "__at")), strict=True):
                first_rank, _, each, first, start = by_length[length][bisect_right(starts[length], at) - 1]
                sequence.append(first + (at - first_rank) // each)
                offset.append(start + (at - first_rank) % each * length)
            out = rows.select(own).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from out.to_batches()

    return ranked.select(*own, "__at").mapInArrow(settle, schema)


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, a row for each piece.

    Null and empty texts give a piece with the end id alone. Rows with null or repeated ids are documents of their
    own. Extra columns are ignored. An empty table gives an empty result. Sequences are numbered from 0 without
    gaps; in each, offsets run from 0 without gaps.
    """
    return place(written(cut_pieces(docs, vocab_path, end_id, window, id_col, text_col)), window)


def padding(packed: DataFrame, window: int = 2048) -> DataFrame:
    """One row: sequences, tokens, padded (tokens of padding, with none for lengths that are a power of two)."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n") == F.pow(F.lit(2.0), F.round(F.log2("n")))
    return each.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(window - F.col("n"))).alias("padded"))


__all__ = ["RoomTree", "cut_pieces", "pack_documents", "padding", "place", "plan_best_fit"]
