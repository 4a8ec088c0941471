"""Scalar functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkmill.plans.schema import BINARY_SNIFF_BYTES, CHARS_PER_TOKEN, DEFINITION_BOOST, LANGUAGES, TRIVIAL_BASENAME

#: The URL namespace of name-based UUIDs (RFC 4122).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(repo_id: Column, path: Column, start_byte: Column, end_byte: Column) -> Column:
    return uuid5(F.concat_ws(":", repo_id, path, start_byte.cast("string"), end_byte.cast("string")))


def slug(name: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(cleaned == "", "repo").otherwise(cleaned)


def repo_id(root: Column) -> Column:
    """slug of the base name, and 8 digits of the SHA-1 of the lower-cased POSIX path without its last slash."""
    norm = F.regexp_replace(F.lower(F.replace(root, F.lit("\\"), F.lit("/"))), "/+$", "")
    base = F.element_at(F.split(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)
    return F.concat(slug(base), F.lit("-"), F.substring(F.sha1(norm), 1, 8))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_for(path: Column) -> Column:
    """Language of the last extension, any case; null where there is none."""
    extension = F.regexp_extract(F.lower(path), r"\.[^.]*$", 0)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension)


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens: runs of letters, digits (both of any script) and underscores."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != ""), F.lower))


def query_tokens(text: str) -> list[str]:
    """Tokens of one query, by Unicode word characters, on the driver."""
    return sorted({t.lower() for t in re.split(r"\W+", text or "") if t})


def nonblank_lines(code: Column) -> Column:
    lines = F.split(code, "\r\n|[\n\r\\x0B\\f\\x1c-\\x1e\\x85\\u2028\\u2029]")
    return F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S")))


def is_trivial(path: Column) -> Column:
    return basename(path) == TRIVIAL_BASENAME


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def tokens_of(n_chars: Column) -> Column:
    return F.coalesce(F.ceil(n_chars / F.lit(float(CHARS_PER_TOKEN))), F.lit(0)).cast("bigint")


def token_estimate(text: Column) -> Column:
    return tokens_of(F.length(text))


def saved_percent(saved: Column, baseline: Column) -> Column:
    """Half-even percentage, 0 without a baseline."""
    return F.when(baseline > 0, F.bround(saved / baseline * 100, 0)).otherwise(0.0).cast("int")


def boosted(score: Column, symbol: Column, query: Column) -> Column:
    return score + F.when(F.array_contains(query, F.lower(symbol)), DEFINITION_BOOST).otherwise(0.0)


def collapses(a: Column, b: Column) -> Column:
    """Whether two structs (start_line, end_line) overlap by more than half of the shorter, or one holds the other."""
    lo = lambda x: F.least(x["start_line"], x["end_line"])
    hi = lambda x: F.greatest(x["start_line"], x["end_line"])
    overlap = F.least(hi(a), hi(b)) - F.greatest(lo(a), lo(b)) + 1
    shorter = F.least(hi(a) - lo(a), hi(b) - lo(b)) + 1
    nested = ((lo(a) <= lo(b)) & (hi(a) >= hi(b))) | ((lo(b) <= lo(a)) & (hi(b) >= hi(a)))
    return (overlap > 0) & (nested | (2 * overlap > shorter))


def normal_path(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""))


def glob_regex(pattern: Column) -> Column:
    """A wildcard pattern as a regular expression: * and ? cross slashes, any case."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def matches_any(path: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: (F.trim(p) != "") & F.regexp(path, glob_regex(p)))


def is_binary(content: Column, sniff: int = BINARY_SNIFF_BYTES) -> Column:
    """A NUL byte among the first bytes; over a hex string, where every byte is two digits."""
    return F.hex(F.substring(content, 1, sniff)).rlike("^(..)*?00")


def word_pattern(identifier: str) -> str:
    """The identifier as a whole word, taken literally."""
    literal = re.sub(r"([^A-Za-z0-9_\s\u0080-\U0010ffff])", r"\\\1", identifier)
    return rf"(?<![A-Za-z0-9_]){literal}(?![A-Za-z0-9_])"
