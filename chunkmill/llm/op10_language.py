"""Language identification by nearest centroid.

A text becomes a vector of hashed byte 2- and 3-grams (letters in lower case, everything ASCII that is no letter as one
space), weighed by 1 + log tf and idf and normalised. Each language has several centroids from spherical k-means over a bounded sample
of labelled rows; the prediction is the language of the centroid with the largest cosine. A text is rejected when that
cosine lies far below what fitted texts of its length reach: halfway between that and what the centroids of the other
languages reach on them, as they do on the texts of a language that isn't learned.

Fitting takes FIT_ROWS labelled rows in all, an equal share of each language, but LEAST_ROWS of each at least and MOST_ROWS at
most: every language is learned, and what reaches the driver grows with the number of languages alone. Rows whose
crc32(doc_id) mod 4 is 2 are held out. A scan estimates each language's distinct rows, a second one draws a few times the
wanted number by a hash of doc_id and text, and of the drawn rows, as sparse counts and each once, those with the least hashes
are taken: rows that repeat, or share a null doc_id, neither crowd out others nor swell the sample. n-grams are hashed to 8192
places, fewer where centroids would pass MODEL_BYTES (as with over 680 languages). Prediction covers every row, in one scan.

Defined results: a null text, or one without a letter, is "und" with score 0 and rejected; where nothing can be fitted
every text is; of centroids that are equally near the first counts, in the order of the languages' names; texts of any length
are counted whole; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, table, use_cache

#: Places of hashed n-grams as powers of two, at most and at least, and bytes of centroids beyond which there are fewer.
BITS, LEAST_BITS, MODEL_BYTES = 13, 8, 64 << 20
#: Labelled rows to fit on, over all languages, and for one language at least and at most; rows drawn for each wanted one.
FIT_ROWS, LEAST_ROWS, MOST_ROWS, DRAWN = 2000, 8, 400, 4
CENTROIDS, ROUNDS = 3, 8
#: Share of fitted texts of a length below whose cosine the rejection starts, and the least and the largest part of that cosine it allows.
TAIL, SLACK, MOST_SLACK = 0.01, 0.35, 0.75
UNKNOWN = "und"
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def bits_for(languages: int) -> int:
    """As many places as keep the centroids of so many languages within MODEL_BYTES."""
    bits = BITS
    while bits > LEAST_BITS and (4 << bits) * CENTROIDS * languages > MODEL_BYTES:
        bits -= 1
    return bits


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed 2- and 3-gram counts of the whole text."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    grams = np.concatenate([two ^ np.uint32(0x5BD10000), three])
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)


def length_bin(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n, 1)).astype(int)


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # least cosine by length bin

    @property
    def bits(self) -> int:
        return len(self.idf).bit_length() - 1

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        out = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine and whether it is rejected."""
        cosines = self.vectors(tf) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)
        return self.of[best], score, score < self.floor[np.minimum(length_bin(tf.sum(1)), len(self.floor) - 1)]


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, started from the mean's nearest row and then the rows farthest from those chosen."""
    near = x @ x.mean(0)
    chosen = [int(near.argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(rows: list[tuple[str, np.ndarray]]) -> Model | None:
    """Fit on (language, counts) rows."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    label = np.array([languages.index(lang) for lang, _ in rows])
    tf = np.array([c for _, c in rows], np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    model = Model(languages, np.zeros(0, int), idf, np.zeros((0, tf.shape[1]), np.float32), np.zeros(1))
    x = model.vectors(tf)
    parts = [cluster(x[label == k]) for k in range(len(languages))]
    model.centroids, model.of = np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    cosines, bins = x @ model.centroids.T, length_bin(tf.sum(1))
    best, foreign = cosines.max(1), np.where(label[:, None] == model.of, 0, cosines).max(1)
    floor = np.zeros(bins.max() + 1)
    for k in range(len(floor)):
        if (bins == k).sum() < 5:
            floor[k] = floor[k - 1] if k else 0
            continue
        low, high = np.quantile(best[bins == k], TAIL), np.quantile(foreign[bins == k], 1 - TAIL)
        floor[k] = np.clip((low + high) / 2, SLACK * low, MOST_SLACK * low)
    model.floor = np.minimum.accumulate(floor[::-1])[::-1]
    return model


def fit(docs: DataFrame) -> Model | None:
    """The model of the labelled rows of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    labelled = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null and not coalesce(pmod(crc32(cast(id as binary)), 4) = 2, false)")
    labelled = labelled.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    learned = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row of each language
    if not learned:
        return None
    wanted, bits = max(LEAST_ROWS, min(MOST_ROWS, FIT_ROWS // len(learned))), bits_for(len(learned))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, h, counts(t, bits)) for lang, h, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True) if has_letter(t)]
            where = [np.flatnonzero(c) for *_, c in rows]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([w.astype("<i4").tobytes() for w in where], pa.binary()), pa.array([r[2][w].astype("<i8").tobytes() for r, w in zip(rows, where, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "h", "at", "n"])

    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = spark.createDataFrame([(r["lang"], DRAWN * (wanted + 16) / r["n"]) for r in learned], "lang string, share double")
    drawn = labelled.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "h", "text").mapInArrow(vectors, "lang string, h long, at binary, n binary")
    once = drawn.groupBy("lang", "h").agg(F.first("at").alias("at"), F.first("n").alias("n"))
    sample = once.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= wanted)
    rows = []
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        c = np.zeros(1 << bits, np.float32)
        c[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<i8")
        rows.append((r["lang"], c))
    return train(rows)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and rejected, which replace columns of these names; the rows pass through, column by column, in one scan."""
    spark, docs = docs.sparkSession, docs.drop("lang_pred", "score", "rejected")
    arrow_limits(spark, 500)
    shared = spark.sparkContext.broadcast(model)
    added = [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("model", int)
        m = shared.value
        for batch in batches:
            strings = batch.column("text").to_pylist()
            lang, score, rejected = [UNKNOWN] * len(strings), [0.0] * len(strings), [True] * len(strings)
            readable = [i for i, t in enumerate(strings) if has_letter(t)] if m else []
            for k in range(0, len(readable), 64):
                part = readable[k : k + 64]
                for i, got, s, r in zip(part, *m.predict(np.array([counts(strings[i], m.bits) for i in part])), strict=True):
                    lang[i], score[i], rejected[i] = m.languages[got], float(s), bool(r)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, (_, t) in zip((lang, score, rejected), added, strict=True))], names=[*batch.schema.names, *(n for n, _ in added)])

    fields = ", ".join(f"`{n}` {t}" for n, t in [*docs.dtypes, ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")])
    return docs.mapInArrow(run, fields)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their own columns, null or of any name; documents without a text or a letter are rejected."""
    packed = docs.select("text", F.struct(F.lit(0).alias("none"), *[c for c in docs.columns if c != "text"]).alias("row"))
    out = predict(packed, fit(docs)).where(~F.col("rejected"))
    return out.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return predict(rows, fit(docs)).drop("text")
