"""Vectors by content: a text that has been embedded is never sent to the service again, in whichever file or repository it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.operators.store import Table
from chunkmill.plans.schema import VECTOR
from chunkmill.sources.embed import Embedder, embed_chunks


class Vectors:
    """A merged table of digest and vector for each model; new ones come as deltas. Digests have Bloom filters in the Parquet files."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder):
        self.embedder, self.model = embedder, f"{getattr(embedder, 'model', 'hash')}-{embedder.dim}".replace("/", "-")
        self.table = Table(spark, root, "vectors", VECTOR, key="digest", by=None, options={"parquet.bloom.filter.enabled#digest": "true"})

    def embed(self, chunks: DataFrame, text: str = "text") -> DataFrame:
        """chunks with vector. Texts without one are embedded first, each once; then a join by digest looks all up. Chunks are computed twice, so they shouldn't be dear."""
        rows = chunks.withColumn("_digest", F.sha2(F.coalesce(text, F.lit("")), 256))
        wanted = rows.select(F.col("_digest").alias("digest"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["digest"])
        new = wanted.join(self._known(wanted), "digest", "left_anti")
        if not new.isEmpty():
            self.table.merge(self.model, embed_chunks(new, self.embedder).select("digest", "vector"))
        known = self.table.read(self.model).withColumnRenamed("digest", "_digest")
        return rows.join(known, "_digest").drop("_digest")

    def _known(self, wanted: DataFrame) -> DataFrame:
        """Digests among the wanted ones that have a vector; vectors aren't read."""
        return self.table.read(self.model).select("digest").join(wanted.select("digest"), "digest", "left_semi")
