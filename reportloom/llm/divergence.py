"""How far the sources of a language differ in their terms: an exact audit by a heavy-light split.

1. Terms are counted within tasks: each task holds counts and document counts by group (language, source) and term,
   and passes them on when they reach ``MOST_COUNTS``. Grouped sums give the kept terms of each language, its groups,
   and a posting (group, term, p) for each kept term of a group.
2. A group's p of a term that it lacks is one number, z. So the distance of two groups a and b is
   V * |za - zb| + one(a, b) + one(b, a) + both(a, b): one(a, b) sums |p - zb| - |za - zb| over the terms of a, and
   both(a, b) sums what is still wrong for terms that both have: |pa - pb| - |pa - zb| - |za - pb| + |za - zb|.
3. one(a, b) for all b comes from a's postings by value, in running sums.
4. both(a, b) is split. Heavy terms, in more than ``LIGHT`` groups and an eighth of them, go to dense tiles: an array
   of ``TILE_GROUPS`` groups by ``TILE_TERMS`` terms, a group without a term at its z, where nothing is wrong. The
   postings of a light term are paired within the arrays of a task, which sums the corrections by pair.
5. All parts are integers below 2 ** 53, so the sums are exact in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SLICE_ROWS, written

#: Documents of a language that a kept term occurs in at least; what is added to a count; the scale of p; ranks of terms.
LEAST_DOCS, ADDED, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Counts that a task holds at most; groups that a light term has at most, if an eighth of all are not more.
MOST_COUNTS, LIGHT = 200_000, 8
#: Groups (a side) and terms of a tile; pair sums that a task holds at most; parts that a group's pairs are dealt to.
TILE_GROUPS, TILE_TERMS, MOST_PAIRS, PARTS = 256, 1024, 500_000, 32
#: A-Z to a-z, and all other bytes below 128 that are no letter to a space; bytes of other characters stay.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns lang, source, term, n (occurrences), docs (documents); sums of some of the rows of ``docs`` each."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def sums(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array(map(in_docs.__getitem__, n), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for key, text in zip(keys, batch.column(2).cast(pa.binary()), strict=True):
                if key not in held:
                    held[key] = Counter(), Counter()
                terms = text.as_py().translate(TO_TERMS).split()
                n, in_docs = held[key]
                n.update(terms)
                in_docs.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > MOST_COUNTS:
                yield from sums(held)
                held = {}
        yield from sums(held)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")
    return docs.select("lang", "source", text).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, terms: V, total: N, z, groups of the language, gid: number in it) and their postings
    (lang, source, term, p, q, spread: groups with the term, groups, gid, z), one for each kept term of a group."""
    counts = written(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    in_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("spread")).where(f"docs >= {LEAST_DOCS}").drop("docs")
    kept = written(counts.drop("docs").join(in_lang, ["lang", "term"]))
    langs = in_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    each = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    in_order = Window.partitionBy("lang").orderBy("source")
    groups = written(each.na.fill(0, ["terms", "total", "lang_total"]).withColumn("z", F.expr(f"if(terms = 0, 0, 1 + {SCALE * ADDED} div greatest(total + {ADDED} * terms, 1))"))
        .withColumn("gid", F.row_number().over(in_order) - 1).withColumn("groups", F.count("*").over(Window.partitionBy("lang"))))
    few = groups.count() <= BROADCAST_IDS
    met = kept.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    share = lambda n, total: F.expr(f"1 + cast(({SCALE}bd * ({n} + {ADDED})) div ({total} + {ADDED} * terms) as long)")
    return groups, met.select("lang", "source", "term", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"), "spread", "groups", "gid", "z")


def tile(gid: np.ndarray, term: np.ndarray, p: np.ndarray, z: np.ndarray, across: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a < b of the groups of a tile and the sum of what is wrong for each over all its terms: |pa - pb| - |pa - zb|
    - |za - pb| + |za - zb|. With ``across``, only pairs of a group below it and one from it on."""
    own, at = np.unique(gid, return_inverse=True)
    of_own = np.zeros(len(own), np.int64)
    of_own[at] = z
    terms, col = np.unique(term, return_inverse=True)
    dense = np.repeat(of_own[:, None], len(terms), axis=1)
    dense[at, col] = p
    out = []
    for i in range(len(own) - 1):
        later = dense[i + 1 :] if across is None else dense[max(i + 1, np.searchsorted(own, across)) :]
        if across is not None and own[i] >= across:
            break
        z_later = of_own[len(own) - len(later) :]
        wrong = np.abs(later - dense[i]).sum(1) - np.abs(later - of_own[i]).sum(1) - np.abs(dense[i][None, :] - z_later[:, None]).sum(1) + len(terms) * np.abs(z_later - of_own[i])
        out.append((np.full(len(later), own[i]), own[len(own) - len(later) :], wrong))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def heavy_pairs(heavy: DataFrame) -> DataFrame:
    """Columns lang, a, b, v: the sums of tiles over heavy terms (term, lang, gid, p, z, groups)."""
    blocks = F.expr(f"(groups + {TILE_GROUPS - 1}) div {TILE_GROUPS}")
    in_tile = heavy.select("lang", F.xxhash64("term").alias("t"), "term", "gid", "p", "z", F.expr(f"gid div {TILE_GROUPS}").alias("block"), blocks.alias("blocks"))
    terms = written(heavy.select("lang", "term").distinct().groupBy("lang").agg(F.expr(f"(count(*) + {TILE_TERMS - 1}) div {TILE_TERMS}").alias("chunks")))
    few = terms.count() <= BROADCAST_IDS
    dealt = in_tile.join(F.broadcast(terms) if few else terms, "lang").withColumn("chunk", F.expr("pmod(t, chunks)"))
    met = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "block").alias("c"), F.greatest(j, "block").alias("d")))).alias("m")
    each = dealt.select("lang", "chunk", met, "term", "gid", "p", "z").select("lang", "chunk", "m.c", "m.d", "term", "gid", "p", "z")
    each = each.repartition("lang", "chunk", "c", "d")  # by the whole key, not by the language that a join may have dealt by

    def solve(key, table):
        lang, _, c, d = (k.as_py() for k in key)
        term = table["term"].combine_chunks().dictionary_encode()
        term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
        a, b, v = tile(*(x if isinstance(x, np.ndarray) else table[x].to_numpy() for x in ("gid", term, "p", "z")), None if c == d else d * TILE_GROUPS)
        kept = v != 0
        return pa.table({"lang": pa.array([lang] * int(kept.sum()), pa.string()), "a": a[kept].astype(np.int64), "b": b[kept].astype(np.int64), "v": v[kept]})

    return each.groupBy("lang", "chunk", "c", "d").applyInArrow(solve, "lang string, a long, b long, v long")


def corrections(gid: list[np.ndarray], p: list[np.ndarray], z: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a < b and what is wrong for each, summed, over terms given as their postings in rising order of groups."""
    codes, wrong = [], []
    by_size: dict[int, list[int]] = {}
    for k, g in enumerate(gid):
        by_size.setdefault(len(g), []).append(k)
    for size, own in by_size.items():
        g, x, y = (np.stack([part[k] for k in own]) for part in (gid, p, z))
        for i in range(size - 1):
            a, pa_, za = g[:, i : i + 1], x[:, i : i + 1], y[:, i : i + 1]
            pb, zb = x[:, i + 1 :], y[:, i + 1 :]
            codes.append(((a << 32) | g[:, i + 1 :]).ravel())
            wrong.append((np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(za - pb) + np.abs(za - zb)).ravel())
    if not codes:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, np.concatenate(wrong))
    return pairs >> 32, pairs & 0xFFFFFFFF, total


def light_pairs(light: DataFrame) -> DataFrame:
    """Columns lang, a, b, v: the corrections for light terms (lang, term, gid, p, z), summed within tasks."""
    lists = light.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("gid", "p", "z"))).alias("of")).select("lang", F.col("of.gid").alias("gid"), F.col("of.p").alias("p"), F.col("of.z").alias("z"))
    schema = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def passed_on():
            langs, a, b = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(held.values(), pa.int64())], schema=schema)

        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            langs = np.array(batch.column(0).to_pylist(), object)
            parts = [[v.values.to_numpy().astype(np.int64) for v in batch.column(k)] for k in (1, 2, 3)]
            for lang in set(langs):
                own = np.nonzero(langs == lang)[0]
                for a, b, v in zip(*(x.tolist() for x in corrections(*([part[k] for k in own] for part in parts))), strict=True):
                    held[lang, a, b] = held.get((lang, a, b), 0) + v
                    if len(held) >= MOST_PAIRS:
                        yield passed_on()
                        held.clear()
        if held:
            yield passed_on()

    return lists.mapInArrow(run, "lang string, a long, b long, v long")


def one_sided(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """Columns lang, a, b, v for all ordered pairs of groups of a language: V * |za - zb| / 2 on either side, kept whole
    on the side of the smaller number, and one(a, b)."""
    a = groups.select("lang", F.col("gid").alias("a"), F.col("z").alias("za"), "terms", F.expr(f"pmod(gid, {PARTS})").alias("part"))
    b = groups.select("lang", F.col("gid").alias("b"), F.col("z").alias("zb"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    pairs = a.join(b, ["lang", "part"]).where("a != b").drop("part")
    values = posted.groupBy("lang", F.col("gid").alias("a"), F.col("p").alias("at")).agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    points = values.select("lang", "a", "at", "n", "s", null("int", "b"), null("long", "za"), null("long", "terms")).unionByName(
        pairs.select("lang", "a", F.col("zb").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), "b", "za", "terms")
    )
    upto, whole = Window.partitionBy("lang", "a").orderBy("at"), Window.partitionBy("lang", "a")
    run = points.select("*", F.sum("n").over(upto).alias("n_upto"), F.sum("s").over(upto).alias("s_upto"), F.sum("n").over(whole).alias("n_all"), F.sum("s").over(whole).alias("s_all")).where("b is not null")
    one = "(at * n_upto - s_upto) + (s_all - s_upto) - at * (n_all - n_upto) - n_all * abs(za - at)"
    return run.select("lang", "a", F.col("b").cast("int").alias("b"), F.expr(f"{one} + if(a < b, terms * abs(za - at), 0)").alias("v"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Columns lang, source, part, item, value, rank: how far each source of a language is from each other one (part
    ``pair``) and its most overused terms (part ``term``, ranks to ``MOST_TERMS``).

    Null texts, languages and sources count as ''. Terms are runs of letters and of characters beyond ASCII, with only
    A-Z made small. A language keeps the terms of at least ``LEAST_DOCS`` of its documents; every group that occurs has
    p = 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)) of each. pair: the sum of |pa - pb| over all kept terms, 0 if
    there are none. term: kept terms of the group with p above the language's, by the difference. Ranks run from 1 by
    falling value, then rising item. Rows with null or repeated ids count like any. Extra columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).cast("string").alias("text"))
    groups, posted = postings(rows)
    posted = written(posted)
    light = F.col("spread") <= F.greatest(F.lit(LIGHT), F.expr("groups div 8"))
    both = heavy_pairs(posted.where(~light)).unionByName(light_pairs(posted.where(light & (F.col("spread") > 1))))
    one = one_sided(groups, posted)
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v")
    distance = one.unionByName(turned(one)).unionByName(both).unionByName(turned(both)).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    named = lambda gid, name: groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(name))
    pairs = distance.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = posted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(ranked).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(f"rank <= {MOST_TERMS}"))
