"""Near-duplicate vectors: product quantisation with coarse inverted lists, table-lookup distances, exact cosine rerank.

1. Vectors are scaled to length 1 in double precision. Equal vectors of one label form a class, so exact copies cost nothing;
   all else works on classes.
2. Coarse centroids of length 1 and codebooks of residuals (PIECES subspaces of 256 codes) are fitted on a sample of at most
   SAMPLE vectors. Every class is stored in the list of its nearest centroid, with its code and the distance by which the
   code misses it.
3. Probes are sufficient, not a fixed number: of two linked unit vectors, which are at most r apart (cos >= 0.98: r = 0.2), in
   the cells of centroids a and b, one at least lies within r / 2 of the plane between a and b. So a class visits every
   list whose plane is that near, and no link between cells is lost. Where both visit each other, the lower cell's visit
   to the higher cell's list counts.
4. In a list, the squared distance of a visitor, or of a stored row to those after it, to a stored code is a sum of PIECES
   looked-up numbers; a pair goes on if it is at most r plus the code's miss, a bound that no link exceeds. Those pairs are
   scored by cosine of the full vectors. Only counts, and a spanning forest of the links found, leave a task.
5. Lists longer than BLOCK rows are dealt as blocks: no group of vectors meets in one task, and no pair is emitted.

The plan finds all links; what is fitted only decides how many pairs are looked at. Cells grow with the square root of the
rows a label has, up to SAMPLE / 16 and BOOK_BYTES of centroids; beyond that lists grow and are cut into more blocks. A group
of near copies that are not equal needs a comparison for each of its pairs, since its links are counted; these are blocks
of matrix work whose rows don't leave the task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or a
null vec_id, link with nothing: n_links 0, component_id vec_id, kept. Vectors of different lengths aren't compared; cells
and codes see the length that is most frequent in the sample, longer vectors cut and shorter ones filled up with zeros, which
only brings them closer. Rows that share a vec_id are rows of their own in n_links and one node in components, kept together.
A cosine within 1e-9 of the threshold is computed again with exactly rounded sums. -0.0 equals 0.0. An empty table gives
no rows; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.functions.quantizer import Quantizer, unit
from chunkmill.llm.common import arrow_limits, materialize, partitions, table, temporaries
from chunkmill.llm.components import components

COSINE = 0.98
#: Rows that coarse centroids and codebooks are fitted on, and subspaces of a residual.
SAMPLE, PIECES = 8192, 8
#: Rows of a list that meet in one task, and pairs that are scored at once.
BLOCK, PAIRS = 1024, 1 << 15
#: What rounding may add to a distance.
SLACK = 1e-6


def reach(cosine: float = COSINE) -> float:
    """Largest distance of two unit vectors of at least this cosine."""
    return math.sqrt(2 - 2 * cosine)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """With sums that are rounded once."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def fitted(sample: list[list[float]], per_label: float) -> Quantizer:
    """From the vectors of the sample that have the most frequent length."""
    width = int(np.bincount([len(v) for v in sample]).argmax())
    return Quantizer.fit(unit(np.array([v for v in sample if len(v) == width], np.float64)), round(math.sqrt(per_label)), PIECES)


def visits(quantizer: Quantizer, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and which cells' planes are within margin; a row's own cell isn't among them."""
    score = x @ quantizer.centroids.T
    own = score.argmax(1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * quantizer.centroids @ quantizer.centroids.T))[own]
    near = score[np.arange(len(x)), own][:, None] - score <= margin * gap + SLACK
    near[np.arange(len(x)), own] = False
    return own, near


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and links (i, j): the least node of each node's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            return root


def _vectors(column: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), ends[:-1])


def describe(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, digest; the last three are null in rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests = []
            for v in batch.column("embedding").to_pylist():
                fine = bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
                digests.append(xxhash.xxh3_128_digest((np.asarray(v, np.float64) + 0.0).tobytes()) if fine else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, "digest"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    out = rows.mapInArrow(run, f"{fields}, digest binary")
    fine = F.col("digest").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    return out.select("vec_id", *[F.when(fine, F.col(c)).alias(c) for c in ("label", "embedding", "digest")])


def fit(classes: DataFrame) -> Quantizer | None:
    """Fitted on the SAMPLE classes with the least hashes of their contents; None where there are no classes."""
    rows, labels = classes.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    if not rows:
        return None
    order = F.xxhash64("digest", F.lit(11))
    sample = classes.select(order.alias("o"), "digest", "embedding").orderBy("o", "digest").limit(SAMPLE).collect()
    return fitted([r["embedding"] for r in sample], rows / labels)


def _placed(classes: DataFrame, quantizer: Quantizer, margin: float) -> DataFrame:
    """A row of each class for its own list (stored) and for each list that it visits: id, label, size, home, cell, stored, code, miss, visits, w, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("embedding"))
            x = quantizer.shaped([unit(v) for v in vectors])
            own, near = visits(quantizer, x, margin)
            codes, miss = quantizer.encode(x, own)
            near[np.arange(len(x)), own] = True
            row, cell = np.nonzero(near)
            stored = own[row] == cell
            near[np.arange(len(x)), own] = False
            visited = [n.astype("<i4").tobytes() if s else None for n, s in ((np.flatnonzero(near[r]), s) for r, s in zip(row, stored, strict=True))]
            code = [codes[r].tobytes() if s else None for r, s in zip(row, stored, strict=True)]
            size = np.array([len(v) for v in vectors])[row]
            placed = [pa.array(size, pa.int32()), pa.array(own[row], pa.int32()), pa.array(cell, pa.int32()), pa.array(stored), pa.array(code, pa.binary()), pa.array(miss[row]), pa.array(visited, pa.binary())]
            for k in range(0, len(row), BLOCK):  # vectors are copied a block at a time
                copied = batch.select(["id", "label", "w", "embedding"]).take(pa.array(row[k : k + BLOCK]))
                yield pa.RecordBatch.from_arrays([*copied.columns, *(c.slice(k, BLOCK) for c in placed)], names=["id", "label", "w", "embedding", "size", "home", "cell", "stored", "code", "miss", "visits"])

    kinds = dict(classes.dtypes)
    return classes.select("id", "label", "w", "embedding").mapInArrow(run, f"id long, label {kinds['label']}, w long, embedding {kinds['embedding']}, size int, home int, cell int, stored boolean, code binary, miss double, visits binary")


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows dealt into blocks (key, q, d) of a list: every row asks in a block q, the stored ones answer in a block d. Two blocks of stored rows meet once."""
    key = F.xxhash64("label", "size", "cell").alias("key")
    rows = placed.select("*", key)
    sizes = rows.groupBy("label", "size", "cell").agg(F.count_if("stored").alias("n"), F.count_if(~F.col("stored")).alias("v")).where("n > 0 and (n > 1 or v > 0)")
    sizes = sizes.select(F.col("label").alias("_label"), F.col("size").alias("_size"), F.col("cell").alias("_cell"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nd"), F.ceil(F.col("v") / BLOCK).cast("int").alias("nv"))
    rows = rows.join(sizes, (F.col("label") == F.col("_label")) & (F.col("size") == F.col("_size")) & (F.col("cell") == F.col("_cell"))).drop("_label", "_size", "_cell")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    # blocks 0 to nd - 1 ask as stored rows, the others as visitors
    stored = rows.where("stored").withColumn("own", part("nd"))
    answers = F.transform(F.sequence(F.lit(0), F.col("own")), lambda q: F.struct(q.alias("q"), F.col("own").alias("d")))
    visited = F.when(F.col("nv") > 0, F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda q: F.struct((q + F.col("nd")).alias("q"), F.col("own").alias("d"))))
    asks = F.transform(F.sequence(F.col("own"), F.col("nd") - 1), lambda d: F.struct(F.col("own").alias("q"), d.alias("d")))
    visitor = F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda d: F.struct((F.col("own") + F.col("nd")).alias("q"), d.alias("d")))
    each = lambda df, x: df.withColumn("x", F.explode(x)).select("key", "x.q", "x.d", "nd", "label", "id", "w", "embedding", "size", "home", "cell", "stored", "code", "miss", "visits")
    everything = F.array_distinct(F.concat(answers, asks, F.coalesce(visited, F.slice(answers, 1, 0))))
    return each(stored, everything).unionByName(each(rows.where("not stored").withColumn("own", part("nv")), visitor))


def _links(asks: dict, answers: dict, same: bool, cell: int, quantizer: Quantizer, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of asking and answering rows, in chunks. same: asking and answering rows are one block."""
    bound = reach(cosine) + answers["miss"] + SLACK
    near = quantizer.distances(asks["x"], cell, answers["codes"]) <= ((bound + 1e-3) ** 2).astype(np.float32)
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    other = asks["home"] != cell
    if other.any():  # both visit: the pair counts in the higher cell's list
        both = other[:, None] & (asks["home"][:, None] > cell) & answers["visits"][:, asks["home"]].T
        near &= ~both
    i, j = np.nonzero(near)
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        score = np.einsum("ij,ij->i", asks["full"][a], answers["full"][b])
        linked = score >= cosine
        for t in np.flatnonzero(np.abs(score - cosine) < 1e-9):
            linked[t] = exact_cosine(asks["raw"][a[t]], answers["raw"][b[t]]) >= cosine
        yield a[linked], b[linked]


def search(placed: DataFrame, quantizer: Quantizer, cosine: float = COSINE) -> DataFrame:
    """(id, n, other): numbers of links, and links of a spanning forest of each block (n 0). Each link is counted once at each of its ends."""
    schema = "id long, n long, other long"

    def block(rows: list[dict], q: int, d: int, nd: int) -> Iterator[pa.RecordBatch]:
        cell = rows[0]["cell"]

        def part(own: list[dict]) -> dict:
            raw = [r["embedding"] for r in own]
            full = unit(np.array(raw))
            visited = np.zeros((len(own), len(quantizer.centroids)), bool)
            for k, r in enumerate(own):
                if r["visits"]:
                    visited[k, np.frombuffer(r["visits"], "<i4")] = True
            codes = [np.frombuffer(r["code"], np.uint8) for r in own] if own[0]["stored"] else []
            return {"raw": raw, "full": full, "x": quantizer.shaped(list(full)), "visits": visited, "codes": np.array(codes), "home": np.array([r["home"] for r in own]), "miss": np.array([r["miss"] for r in own]), "id": np.array([r["id"] for r in own]), "w": np.array([r["w"] for r in own])}

        same = q == d
        answering = [r for r in rows if r["stored"] and r["own"] == d]
        asking = answering if same else [r for r in rows if (r["own"] == q if q < nd else not r["stored"])]
        if not answering or not asking:
            return
        left = part(asking)
        right = left if same else part(answering)
        n, m = np.zeros(len(asking), np.int64), np.zeros(len(answering), np.int64)
        base = 0 if same else len(asking)
        ids = left["id"] if same else np.concatenate([left["id"], right["id"]])
        tree_i, tree_j = [], []
        for a, b in _links(left, right, same, cell, quantizer, cosine):
            np.add.at(n, a, right["w"][b])
            np.add.at(m, b, left["w"][a])
            root = forest(a, b + base, len(ids))
            node = np.flatnonzero(root != np.arange(len(ids)))
            tree_i.append(node)
            tree_j.append(root[node])
        if not tree_i:
            return
        i, j = np.concatenate(tree_i), np.concatenate(tree_j)
        root = forest(i, j, len(ids))
        node = np.flatnonzero(root != np.arange(len(ids)))
        counted = np.concatenate([left["id"], right["id"]])
        counts = np.concatenate([n, m])
        some = counts > 0
        id_, n_, other = np.concatenate([counted[some], ids[node]]), np.concatenate([counts[some], np.zeros(len(node), np.int64)]), [*[None] * int(some.sum()), *ids[root[node]].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(n_), pa.array(other, pa.int64())], names=["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None
        for batch in batches:
            vectors = _vectors(batch.column("embedding"))
            for r, vector in zip(batch.drop_columns(["embedding"]).to_pylist(), vectors, strict=False):
                r["embedding"] = vector
                now = (r["label"], r["size"], r["cell"], r["q"], r["d"], r["nd"])
                if now != key:
                    if held:
                        yield from block(held, *key[3:])
                    held, key = [], now
                held.append(r)
        if held:
            yield from block(held, *key[3:])

    own = F.when(F.col("stored"), F.pmod(F.xxhash64("id"), F.col("nd")).cast("int"))
    rows = _blocks(placed).withColumn("own", own)
    dealt = rows.repartition(partitions(placed.sparkSession), "key", "q", "d").sortWithinPartitions("label", "size", "cell", "q", "d", "id").drop("key")
    return dealt.mapInArrow(run, schema)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per vector."""
    spark = vectors.sparkSession
    arrow_limits(spark, 1000)
    with temporaries(spark):
        every = materialize(describe(vectors), "vectors", keep=True)
        classes = every.where("digest is not null").groupBy("label", "digest").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("rep"))
        classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes", keep=True)
        quantizer = fit(classes)
        if quantizer is None:
            return _result(every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
        found = materialize(search(_placed(classes, quantizer, reach(cosine) / 2), quantizer, cosine), "found")
        counts = materialize(found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n")), "counts", keep=True)
        # rows of one vec_id are one node: classes meet by the least vec_id of each, and by every vec_id that they share
        edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
        shared = every.where("digest is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("vec_id")
        several = every.join(shared, "vec_id", "left_semi").select("vec_id", "label", "digest").distinct().join(classes.select("label", "digest", "id"), ["label", "digest"])
        first = several.groupBy("vec_id").agg(F.min("id").alias("b"))
        labels = materialize(components(edges.unionByName(several.join(first, "vec_id").where("id <> b").select(F.col("id").alias("a"), "b"))), "labels")
        named = classes.select("id", "rep").join(labels, classes["id"] == labels["node"]).select("id", "rep", "component")
        least = materialize(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
        named = materialize(named.join(least, "component").select("id", "least"), "named", keep=True)
    of_class = classes.select("id", "label", "digest", "w", "rep").join(counts, "id", "left").join(named, "id", "left")
    of_class = of_class.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("least", "rep").alias("least"))
    linking = every.where("digest is not null").select("vec_id", "label", "digest").join(of_class, ["label", "digest"]).select("vec_id", "n_links", F.col("least").alias("component_id"))
    rest = every.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return _result(linking.unionByName(rest))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = rf"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: coalesce(NOT isfinite(c), true))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b USING (label) WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r AS (SELECT a, a AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
