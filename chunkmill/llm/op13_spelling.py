"""Spelling variants: a word's whole neighbourhood of one edit, looked up in the vocabulary.

1. Words are the runs of letters of all texts, counted with partial sums before the shuffle; one run in 199, by a checksum
   of document and run, loses a code point.
2. Each word of the vocabulary emits every distinct string that one deletion, replacement or insertion over the observed
   alphabet makes of it: a deletion only at the first of equal letters, an insertion only where the letter before differs.
   Strings that are in the vocabulary are its near words; a hash join tells, and no distance is computed.
3. The strings, hundreds for each word, never move. An edit leaves the first or the last half of a word as it is, so words
   are dealt by the half that stays (once for each kind of edit and half) and so is the vocabulary; both meet where the
   strings are made. Only six short rows a word, and four of the vocabulary, are shuffled.
4. Near words are counted, and the most frequent one chosen, with partial aggregation; forms are followed to the root by
   pointer doubling.

Halves have three letters at least, and more in longer words, so no group holds a large share of a vocabulary.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string in the checksum; rows that
repeat are counted as often as they occur; of near words with equal counts the least in code-point order is the form; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import materialize, partitions, table

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
EVERY = 199
#: Least code points and occurrences of a word; times by which a form must be more frequent.
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of doc_id and text."""
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halves(kind: str, size: Column, half: Column) -> tuple[Column, Column]:
    """Keys of a word for edits that leave its first half letters as they are, and for those that leave the others of size letters."""
    word, rest = F.col("word"), size - half
    return F.concat(F.lit(f"{kind}<"), F.substring(word, F.lit(1), half)), F.concat(F.lit(f"{kind}>"), F.substring(word, F.length(word) - rest + 1, rest))


def _half(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def targets(words: DataFrame) -> DataFrame:
    """(key, word, n): each word under the halves by which an edit may reach it; "s" of as many or fewer letters than it started from, "l" of more."""
    size = F.length("word")
    keys = F.array(*_halves("s", size, _half(size)), *_halves("l", size - 1, _half(size - 1)))
    return words.select("word", "n", F.explode(keys).alias("key"))


def sources(words: DataFrame) -> DataFrame:
    """(key, word, kind, low, high): positions from low to high of a word where edits of a kind leave the half of the key as it is."""
    size, rows = F.length("word"), []
    for kind, key, shared, last in (("r", "s", size, size - 1), ("d", "s", size - 1, size - 1), ("i", "l", size, size)):
        half = _half(shared)
        first, other = _halves(key, shared, half)
        rows += [F.struct(k.alias("key"), F.lit(kind).alias("kind"), low.alias("low"), high.alias("high")) for k, low, high in ((first, half, last), (other, F.lit(0), half - 1))]
    return words.select("word", F.explode(F.array(*rows)).alias("x")).select("word", "x.*")


def edits(rows: DataFrame, alphabet: list[str]) -> DataFrame:
    """(key, word, near): the distinct strings that the edits of sources() make."""
    word, i = F.col("word"), F.col("i")
    size = F.length(word)
    cut = rows.select("key", "word", "kind", F.explode(F.sequence("low", "high")).alias("i"))
    cut = cut.select("key", "word", "kind", F.substring(word, F.lit(1), i).alias("left"), F.substring(word, i, F.when(i > 0, 1).otherwise(0)).alias("before"), F.substring(word, i + 1, F.lit(1)).alias("at"), F.substring(word, i + 2, size).alias("rest"))
    letters = F.when(F.col("kind") == "d", F.array(F.lit(""))).otherwise(F.array(*[F.lit(c) for c in alphabet]))
    made = cut.select("*", F.explode(letters).alias("c"))
    new = F.when(F.col("kind") == "d", F.col("at") != F.col("before")).when(F.col("kind") == "r", F.col("c") != F.col("at")).otherwise(F.col("c") != F.col("before"))
    near = F.concat("left", "c", F.when(F.col("kind") == "i", F.col("at")).otherwise(""), "rest")
    return made.where(new).select("key", "word", near.alias("near"))


@contextmanager
def joined_by_part_of_the_key(spark: SparkSession) -> Iterator[None]:
    """Let a join use rows that are dealt by some of its columns as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words; form is the most frequent near word, whatever its count."""
    spark = words.sparkSession
    # at most 26 + 64 letters
    alphabet = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
    n = partitions(spark)
    made = edits(sources(words).repartition(n, "key"), alphabet)
    known = targets(words).repartition(n, "key").withColumnRenamed("word", "near").hint("shuffle_hash")
    found = made.join(known, ["key", "near"])
    best = F.min(F.struct((-F.col("n")).alias("m"), "near"))
    with joined_by_part_of_the_key(spark):
        out = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
        return materialize(out.select("word", "n_near", F.col("b.near").alias("form"), (-F.col("b.m")).alias("form_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) whose forms are followed to the last. Counts grow RATIO-fold with each step, so chains are short."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        links = step.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    words = materialize(vocabulary(docs), "vocabulary")
    near = near_words(words)
    rows = words.join(near, "word", "left")
    has = F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE t AS (SELECT list(CAST(c AS BIGINT) ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(k))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))::BIGINT[] AS b FROM d),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1])), 4294967295) AS h FROM b, t),
o AS (SELECT CASE WHEN h % {EVERY} = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM o WHERE length(word) >= {LEAST_CHARS} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT DISTINCT word, n, concat(left(word, i - 1), substr(word, i + 1)) AS short FROM i),
g AS (SELECT word, n, i, concat(left(word, i - 1), '?', substr(word, i + 1)) AS gap FROM i),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM g a JOIN g b USING (gap) WHERE a.word <> b.word
  UNION ALL SELECT s.word, w.word, w.n FROM s JOIN w ON s.short = w.word
  UNION ALL SELECT w.word, s.word, s.n FROM s JOIN w ON s.short = w.word),
x AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM p GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN near END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM w LEFT JOIN x USING (word)),
z AS (SELECT word, word AS at FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON z.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.at AS root, f.n, f.n_near, f.form_n FROM f JOIN z USING (word) JOIN f l ON z.at = l.word WHERE l.form IS NULL
"""
