"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times. The whole part is taken for sure; the fractional
part is a copy probability. Two documents of a source are paired and probability mass, weighed by their sizes, moves
from one to the other, in a direction drawn at random so that expectations stay, until one is integral. Each block of
documents leaves at most one fractional document per source; these residuals meet in a tree of fixed fan-in.

Draws are hashes of the seed and the two documents' keys, and blocks are hashes of keys, so reruns agree whatever the
files or the cluster look like.

Defined results: rows equal in doc_id, source and text are one unit and share a decision; a null text has size 0; a null
source is a source of its own, after all others; documents of size 0 take 0 words; an empty table gives no rows.
A text's length matters by its number of words alone; mix() keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkmill.llm.common import materialize, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_ROWS, FAN_IN = 16_384, 64
SEED = 17
_EPS = 1e-9


def size_of(text) -> F.Column:
    """Number of words, white space being U+0020 and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of() -> F.Column:
    return F.xxhash64("doc_id", F.coalesce("source", F.lit("\u0000none")), "text")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (source, source_size): adds target. One row per source; no iteration.

    With sources ordered by cap per weight, those up to some place are capped and the rest share what is left by weight;
    the level is that of the first place whose own cap isn't exceeded.
    """
    everything = W.partitionBy()
    order = W.orderBy(F.col("ratio"), F.col("place"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everything))
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    out = out.withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything))
    return out.select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("weight"))).alias("target"))


def _uniform(seed: int, a: int, b: int) -> float:
    """A draw in (0, 1) from two keys."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for _ in range(2):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
    return ((x >> 11) + 0.5) / (1 << 53)


def pivot(keys: list[int], masses: list[int], probs: list[float], seed: int = SEED, last: bool = False) -> list[float]:
    """Round the probabilities of one source; at most one stays fractional, none if last. The sum of mass * p is kept but for the last draw."""
    out, open_ = list(probs), -1
    for i, p in enumerate(out):
        if masses[i] == 0:
            out[i] = float(_uniform(seed, keys[i], 0) < p)
            continue
        if p <= _EPS or p >= 1 - _EPS:
            out[i] = float(p > 0.5)
            continue
        if open_ < 0:
            open_ = i
            continue
        j, ratio = open_, masses[i] / masses[open_]
        up, down = min(1 - p, out[j] / ratio), min(p, (1 - out[j]) / ratio)
        step = up if _uniform(seed, keys[i], keys[j]) * (up + down) < down else -down
        out[i], out[j] = p + step, out[j] - step * ratio
        open_ = -1
        for k in (i, j):
            if out[k] <= _EPS or out[k] >= 1 - _EPS:
                out[k] = float(out[k] > 0.5)
            else:
                open_ = k
    if last and open_ >= 0:
        out[open_] = float(_uniform(seed, keys[open_], 1) < out[open_])
    return out


_SCHEMA = "node long, key long, doc_id long, source string, n_rows long, size long, p double"


def _round(rows: DataFrame, node: F.Column, seed: int, last: bool) -> DataFrame:
    """One level of the tree: the rows that share a node are rounded source by source."""

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "key"], na_position="last", kind="stable").reset_index(drop=True)
        for own in pdf.groupby("source", dropna=False, sort=False).indices.values():
            part = pdf.loc[own]
            pdf.loc[own, "p"] = pivot(part["key"].tolist(), (part["size"] * part["n_rows"]).tolist(), part["p"].tolist(), seed, last)
        return pdf

    return rows.withColumn("node", node.cast("long")).groupBy("node").applyInPandas(level, _SCHEMA)


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per unit: key, doc_id, source, n_rows, size, source_size, target, copies."""
    units = docs.select(key_of().alias("key"), F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"))
    units = materialize(units.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n_rows")), "mix-units")
    sources = materialize(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")), weights, share, most), "mix-targets")
    blocks = max(1, math.ceil(units.count() / BLOCK_ROWS))

    joined = units.join(sources, units["source"].eqNullSafe(sources["source"]), "left").drop(sources["source"])
    wanted = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    joined = joined.withColumn("p", wanted - F.floor(wanted))
    state = materialize(_round(joined.select("key", "doc_id", "source", "n_rows", "size", "p"), F.pmod(F.xxhash64("key"), F.lit(blocks)), seed, blocks == 1), "mix-level")
    settled, depth = [], 0
    while blocks > 1:
        depth += 1
        blocks = math.ceil(blocks / FAN_IN)
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(state.where(~is_open))
        state = materialize(_round(state.where(is_open).select("node", "key", "doc_id", "source", "n_rows", "size", "p"), F.floor(F.col("node") / FAN_IN), seed + depth, blocks == 1), "mix-level")
    rounded = state
    for more in settled:
        rounded = rounded.unionByName(more)
    out = rounded.join(sources, rounded["source"].eqNullSafe(sources["source"]), "left").drop(sources["source"])
    return out.select("key", "doc_id", "source", "n_rows", "size", "source_size", "target", (F.floor(wanted) + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, each row as often as the mix takes it. Columns of any name pass through."""
    taken = decide(docs, **options).where("copies > 0").select("key", "copies")
    rows = docs.select(key_of().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(taken, "key")
    each = rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide(table(spark, sf_dir, "documents"))
    each = out.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, their sizes and targets: the part of the mix that SQL can express."""
    docs = table(spark, sf_dir, "documents").select("source", size_of(F.col("text")).alias("size"))
    return targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("target", F.round("target", 4))


TARGETS_SQL = f"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT source, n, [{", ".join(f"{w}.0" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
l AS (SELECT a.n * {MOST} / a.weight AS level FROM w a),
t AS (SELECT min(level) AS level FROM (
  SELECT l.level, sum(least(w.n * {MOST}, l.level * w.weight)) AS given FROM l, w GROUP BY l.level) WHERE given >= {SHARE} * (SELECT sum(n) FROM s)),
u AS (SELECT (SELECT level FROM t) AS above, coalesce((SELECT max(level) FROM l WHERE level < (SELECT level FROM t)), 0) AS below),
f AS (SELECT sum(CASE WHEN n * {MOST} / weight <= below THEN n * {MOST} ELSE 0 END) AS fixed, sum(CASE WHEN n * {MOST} / weight <= below THEN 0 ELSE weight END) AS free FROM w, u)
SELECT source, n AS source_size, round(CASE WHEN n * {MOST} / weight <= below THEN n * {MOST} ELSE least(n * {MOST}, weight * ({SHARE} * (SELECT sum(n) FROM s) - fixed) / free) END, 4)::DOUBLE AS target
FROM w, u, f
"""
