"""Trigram posting lists over blocks of files, so that an identifier search opens only blocks that can hold the word.

The files lie in Parquet files of about BLOCK_ROWS rows, the blocks, in the order of a column whose neighbours have words in common
(paths or languages). A posting names a trigram and a block; the trigrams are those of each word between marks for its start and
end, so a word of any length has some. Blocks that have a word's trigrams in different words are told apart by postings of a
checksum of the whole word, of which there are BUCKETS. So postings are bounded for each block, whatever words there are. They
are sorted, and a search reads the few row groups that hold its own; the blocks that have all of them are then searched as
symbol_search() does, which decides.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.operators.symbol import symbol_search

BLOCK_ROWS, BUCKETS = 2000, 1 << 20
#: Marks of a word's start and end, which no word holds.
START, END = "<", ">"
WORD = "[A-Za-z0-9_]+"


def postings_of(identifier: str) -> list[str]:
    """Trigrams and checksums that a block has if it holds the identifier as a whole word."""
    return sorted(set(trigrams(identifier)) | {f"#{zlib.crc32(w.encode()) % BUCKETS}" for w in re.findall(WORD, identifier)})


def trigrams(identifier: str) -> list[str]:
    """Those that a text must have if it holds the identifier as a whole word."""
    words = [f"{START}{w}{END}" for w in re.findall(WORD, identifier)]
    return sorted({w[k : k + 3] for w in words for k in range(len(w) - 2)})


@dataclass
class TextIndex:
    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, files: DataFrame, folder: str, by: str, text: str = "text", block_rows: int = BLOCK_ROWS) -> TextIndex:
        """Index files, whose columns come back with the lines found, in blocks by a column."""
        # rows that agree in the column are many, and a task would get them all: among them the order is by hash
        files.orderBy(by, F.xxhash64(*files.columns)).write.option("maxRecordsPerFile", str(block_rows)).parquet(f"{folder}/blocks")
        index = cls(files.sparkSession, folder)
        marked = F.concat(F.lit(START), "word", F.lit(END))
        words = index.blocks().select(F.col("_metadata.file_name").alias("block"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})")))).alias("word")).distinct()
        grams = F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda k: F.substring(marked, k, F.lit(3)))
        whole = F.concat(F.lit("#"), F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(BUCKETS)).cast("string"))
        postings = words.select(F.explode(F.concat(grams, F.array(whole))).alias("posting"), "block").distinct()
        postings.orderBy("posting", "block").write.option("parquet.block.size", str(4 << 20)).parquet(f"{folder}/postings")
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def candidates(self, identifier: str) -> list[str] | None:
        """Names of the blocks that can hold the identifier; None where any may, since it has no word."""
        wanted = postings_of(identifier)
        if not wanted:
            return None
        postings = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("posting").isin(wanted))
        found = postings.groupBy("block").agg(F.countDistinct("posting").alias("n")).where(F.col("n") == len(wanted))
        return sorted(r["block"] for r in found.select("block").collect())

    def search(self, identifier: str, text: str = "text") -> DataFrame:
        """symbol_search() over the blocks that can hold the identifier."""
        names = self.candidates(identifier)
        blocks = self.blocks()
        if names is not None:
            schema = blocks.schema
            blocks = self.spark.read.schema(schema).parquet(*[f"{self.folder}/blocks/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)
        return symbol_search(blocks, identifier, text)
