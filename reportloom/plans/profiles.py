"""Profiles as data: each may extend another, and what it says itself goes over what it inherits."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import step

#: Inheritances followed at most; a longer chain is reported like a cycle.
MOST_STEPS = 32


def merged(base, over):
    """Mappings key by key; anything else is replaced whole."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: merged(base[k], v) if k in base else v for k, v in over.items()}
    return over


def with_numbering(profile: dict) -> dict:
    """``numbering_all`` goes over each level of ``numbering``."""
    common = profile.pop("numbering_all", None)
    return profile | {"numbering": [level | common for level in profile.get("numbering") or []]} if common else profile


def leaves(value, path: str = ""):
    """Paths and JSON texts of all that is no mapping, or an empty one."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    else:
        yield path, json.dumps(value, ensure_ascii=False, sort_keys=True)


def lineage(profiles: DataFrame) -> DataFrame:
    """Columns name, ancestor, depth (0: itself), problem: each profile with those it extends, nearest first. ``problem`` is
    ``cycle`` where a chain meets itself and ``missing`` where it names no profile; such a row ends its chain.

    ``profiles``: name, extends (null for none). A name that occurs twice is two profiles of one name; both count.
    """
    parents = profiles.select(F.col("name").alias("ancestor"), F.col("extends").alias("next")).distinct()
    known = profiles.select(F.col("name").alias("next"), F.lit(True).alias("__known")).distinct()
    level = step(profiles.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth"), F.array("name").alias("path"), F.lit(None).cast("string").alias("problem")).distinct())
    found = level
    for depth in range(1, MOST_STEPS + 1):
        # both sides grow with the profiles: sorted and merged, as a broadcast at each level would pass them through the driver
        on = level.where("problem is null").join(parents.hint("merge"), "ancestor").where("next is not null").join(known.hint("merge"), "next", "left")
        problem = F.when(F.array_contains("path", F.col("next")) | F.lit(depth == MOST_STEPS), "cycle").when(F.col("__known").isNull(), "missing")
        level = step(on.select("name", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("next")).alias("path"), problem.alias("problem")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.drop("path")


def resolved(profiles: DataFrame) -> DataFrame:
    """Columns name, profile (JSON), problem: each profile with all it inherits. ``profiles``: name, extends, body (a JSON
    mapping; null for an empty one). Where a chain has a problem, the profile is null; a body that is no JSON mapping is
    the problem ``broken`` of all that inherit it."""
    chain = lineage(profiles)
    bodies = chain.join(profiles.select(F.col("name").alias("ancestor"), "body").hint("merge"), "ancestor", "left")
    gathered = bodies.groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("far"), "body"))).alias("__b"), F.max("problem").alias("problem"))

    @F.arrow_udf("string")
    def merge(chains: pa.Array) -> pa.Array:
        out = []
        for one in chains.to_pylist():
            profile: dict = {}
            try:
                for body in one:
                    said = json.loads(body or "{}")
                    if not isinstance(said, dict):
                        raise ValueError
                    profile = merged(profile, said)
                out.append(json.dumps(with_numbering(profile), ensure_ascii=False, sort_keys=True))
            except (ValueError, TypeError, AttributeError):
                out.append(None)
        return pa.array(out, pa.string())

    whole = gathered.withColumn("profile", F.when(F.col("problem").isNull(), merge(F.transform("__b", lambda x: x["body"]))))
    return whole.select("name", "profile", F.when(F.col("problem").isNull() & F.col("profile").isNull(), "broken").otherwise(F.col("problem")).alias("problem"))


def profile_rows(profiles: DataFrame) -> DataFrame:
    """Resolved profiles as rows: name, path (keys parted by points), value (JSON), problem. A profile with a problem is one
    row without a path."""

    @F.arrow_udf("array<struct<path:string,value:string>>")
    def paths(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
        return pa.array([[{"path": p, "value": v} for p, v in leaves(json.loads(t))] if t else [] for t in texts.to_pylist()], kind)

    rows = resolved(profiles).withColumn("__p", paths(F.col("profile")))
    return rows.select("name", "problem", F.explode_outer("__p").alias("p")).select("name", "p.path", "p.value", "problem")
