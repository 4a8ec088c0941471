"""Lempel-Ziv phrase fingerprints.

A text is parsed left to right into LZ78 phrases, each the longest known phrase and one more code point. The phrases'
hashes are min-hashed; a fingerprint holds one byte of each minimum, and likeness is the share of equal bytes without
those that are equal by chance. Whole texts have one dictionary, whatever their length. Code points are read PIECE at a
time and minima are taken as phrases come, so beside the text itself only the dictionary is held: about 150 bytes a phrase,
and phrases grow with the text's length (at a million code points of prose they have 6 to 8 code points each).

For documents in ascending doc_id order, each is also compared with its successor and with an edited text: its last
quarter replaced by the successor's beginning. Texts move once, in a range shuffle; the last document of a partition is
paired with the first of the next by a join of those rows alone.

Defined results: a null text is empty; all empty texts share one fingerprint and are alike (1.0); null doc_ids come
first; equal doc_ids are ordered by text; a single document is its own successor; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, materialize, partitions, table

#: Bytes of a fingerprint; code points read at a time.
COMPONENTS, PIECE = 128, 1 << 16
_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 1 << 32, COMPONENTS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, COMPONENTS, dtype=np.uint32)[:, None]
_EMPTY = np.full(COMPONENTS, 0xFFFFFFFF, np.uint32)
_MASK = (1 << 48) - 1


def minima(hashes: Sequence[int]) -> np.ndarray:
    """Minimum of each component's hash over the phrases."""
    if not len(hashes):
        return _EMPTY
    x = np.array(hashes, np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = _EMPTY
    for k in range(0, len(x), 4096):
        out = np.minimum(out, (x[k : k + 4096] * _A + _B).min(1))
    return out


class Parser:
    """LZ78 over code points. run() goes on from the last state; mark() and back() undo what came between."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.hashes = array("Q", [0x2545F491])
        self.node = 0
        self.saved: tuple[int, int] | None = None

    def mark(self) -> None:
        self.saved, self.log = (self.node, len(self.hashes)), array("Q")

    def back(self) -> None:
        for key in self.log:
            del self.known[key]
        self.node, n = self.saved
        del self.hashes[n:]
        self.saved = None

    def run(self, points: list[int]) -> Sequence[int]:
        """Hashes of the phrases that end in these code points."""
        known, hashes, node = self.known, self.hashes, self.node
        get, n, keys = known.get, len(hashes), []
        for c in points:
            key = node << 21 | c
            to = get(key)
            if to is None:
                known[key] = len(hashes)
                hashes.append((hashes[node] * 0x5851F42D ^ c * 0x9E3779B1) & _MASK)
                keys.append(key)
                node = 0
            else:
                node = to
        self.node = node
        if self.saved:
            self.log.extend(keys)
        return hashes[n:]

    def parse(self, text: str) -> np.ndarray:
        """Minima over the phrases that end in this text."""
        out = _EMPTY
        for k in range(0, len(text), PIECE):
            out = np.minimum(out, minima(self.run(points_of(text[k : k + PIECE]))))
        return out


def points_of(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").tolist()


def signature(text: str) -> np.ndarray:
    return Parser().parse(text)


def fingerprint(sig: np.ndarray) -> bytes:
    return ((sig * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    same = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def compare(text: str, following: str) -> tuple[int, str, bytes, bytes]:
    """Code points, sha256 of the edited text, fingerprint, edited fingerprint; the common beginning is parsed once."""
    quarter = len(text) // 4
    tail, other = text[len(text) - quarter :], following[:quarter]
    kept = text[: len(text) - quarter]
    parser = Parser()
    base = parser.parse(kept)
    parser.mark()
    edited = np.minimum(base, parser.parse(other))
    parser.back()
    own = np.minimum(base, parser.parse(tail))
    return len(text), hashlib.sha256((kept + other).encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(edited)


_OUT = pa.schema([
    ("kind", pa.string()), ("part", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "kind string, part long, text string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, got: tuple[int, str, bytes, bytes], following: bytes) -> dict:
    n, sha, own, edited = got
    return {"kind": "done", "part": None, "text": None, "doc_id": doc_id, "n_chars": n, "edited_sha256": sha, "fingerprint": own.hex(), "edited_fingerprint": edited.hex(), "near_edited": likeness(own, edited), "near_next": likeness(own, following)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of the text and of its edited text, and likenesses."""
    spark = docs.sparkSession
    arrow_limits(spark)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, waiting = TaskContext.get().partitionId(), None, None
        edge = lambda kind, doc: dict.fromkeys(_OUT.names) | {"kind": kind, "part": part, "doc_id": doc[0], "text": doc[1]}
        for batch in batches:
            rows = []
            for doc in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if last is None:
                    rows.append(edge("first", doc))
                else:
                    got = compare(last[1], doc[1])
                    if waiting:
                        rows.append(_row(*waiting, got[2]))
                    waiting = (last[0], got)
                last = doc
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)
        if last is not None:
            rows = [edge("last", last)]
            if waiting:
                rows.append(_row(*waiting, fingerprint(signature(last[1]))))
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(d, compare(t, f), fingerprint(signature(f))) for d, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    order = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions(spark), order).sortWithinPartitions(order, "text")
    out = materialize(ordered.mapInArrow(stream, _TYPES), "lz")
    first = out.where("kind = 'first'").select(F.col("part").alias("to"), F.col("text").alias("following"))
    follows = first.select("to").withColumn("part", F.coalesce(F.lag("to").over(W.orderBy("to")), F.max("to").over(W.partitionBy())))
    pairs = out.where("kind = 'last'").select("part", "doc_id", "text").join(follows, "part").join(first, "to").select("doc_id", "text", "following")
    return out.where("kind = 'done'").select(*_COLUMNS).unionByName(pairs.mapInArrow(borders, _TYPES).select(*_COLUMNS))


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
