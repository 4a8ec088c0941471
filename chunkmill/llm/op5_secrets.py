"""Secret scan by token efficiency.

Random strings break into many short vocabulary pieces, so a string whose characters-per-token ratio under a byte-pair
vocabulary is low, and that is neither a known digest, a UUID nor an identifier made of words, is a finding of kind
"random". Words joined to a random string would hide it, so where a whole string is no finding, what is left between its words
is judged by its own ratio. A digest is known if it's in a given list, or if it has a digest's length in hexadecimal (or starts as a
subresource hash) and the words before it say that it is one. Three patterns of known shape (assign, access, hex) are always reported; the method's spans come besides
and never overlap them.

Defined results: a null text is empty and has no spans; repeated rows give repeated results; other columns are ignored;
offsets are code points with exclusive ends; strings of any length are tokenised whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, table, use_cache

# The base patterns, least lengths and their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Candidates of the token-efficiency test.
#: Candidates of 16 to 19 characters need a lower ratio: at 2.1, about one clean word in forty of that length is a finding.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SHORT, SHORT_RATIO = 20, 1.7
#: A part of an identifier is a word by its least length and characters per token; WORDS is the least share of a string in words.
RATIO, PART, PART_RATIO, WORDS = 2.1, 3, 2.5, 0.4
# Hexadecimal digits of common digests, and what stands before one.
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
DIGEST_WORD = re.compile(r"""(?:md5|sha-?\d*|sum|digest|hash|etag|fingerprint)["']?\s*[:=(]?\s*["']?\Z""", re.I)
SUBRESOURCE = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Between separators; those of NAME characters and more that are identifiers part what is left of a string.
SEGMENT, NAME = re.compile(r"[A-Za-z0-9]+"), 4
_encodings: dict[str, object] = {}


def forget() -> None:
    """Drop what this worker keeps; a function, so that tasks reach the module's own memory."""
    _encodings.clear()


def encoding(path: str):
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost non-overlapping for each kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_digest(string: str, before: str, digests: frozenset[str]) -> bool:
    """In the given list (lower case), or of a digest's form where the words before it say so."""
    if string.lower() in digests or SUBRESOURCE.fullmatch(string):
        return True
    return len(string) in DIGESTS and bool(HEXADECIMAL.fullmatch(string)) and bool(DIGEST_WORD.search(before))


def is_known(string: str, vocabulary) -> bool:
    """A UUID, a number, one repeated character or an identifier made of words that are cheap in the vocabulary."""
    if string.isdigit() or len(set(string)) == 1 or UUID.fullmatch(string):
        return True
    parts = PARTS.findall(string)
    words = sum(len(p) for p in parts if p.isalpha() and len(p) >= PART and len(p) >= PART_RATIO * len(vocabulary.encode_ordinary(p)))
    return words >= WORDS * max(1, sum(map(len, parts)))


def is_secret(string: str, before: str, vocabulary, digests: frozenset[str]) -> bool:
    """Few characters per token, and neither an identifier nor a digest."""
    ratio = SHORT_RATIO if len(string) < SHORT else RATIO
    return len(string) < ratio * len(vocabulary.encode_ordinary(string)) and not is_known(string, vocabulary) and not is_digest(string, before, digests)


def between_words(string: str, vocabulary) -> Iterator[tuple[int, int]]:
    """Runs of LEAST characters and more that are left once segments made of words are cut off; none where there is no such segment."""
    parts = [(m.start(), m.end(), m.end() - m.start() >= NAME and is_known(m.group(), vocabulary)) for m in SEGMENT.finditer(string)]
    if not any(known for *_, known in parts):
        return
    first = None
    for k, (start, end, known) in enumerate(parts):
        if known:
            first = None
            continue
        first = start if first is None else first
        if (k + 1 == len(parts) or parts[k + 1][2]) and end - first >= LEAST:
            yield first, end


def random_spans(text: str, taken: list[tuple[int, int, int]], vocabulary, digests: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Findings that overlap none of the taken spans, which are in order of their starts."""
    out = []
    at = reach = 0  # the taken spans that start before this candidate ends reach up to here
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][2])
            at += 1
        if reach > m.start():
            continue
        before = lambda k: text[max(0, k - 24) : k]
        if is_secret(m.group(), before(m.start()), vocabulary, digests):
            out.append(m.span())
        elif not UUID.fullmatch(m.group()):
            for start, end in between_words(m.group(), vocabulary):
                if is_secret(m.group()[start:end], before(m.start() + start), vocabulary, digests):
                    out.append((m.start() + start, m.start() + end))
    return out


def scan_text(text: str, vocabulary, digests: frozenset[str] = frozenset()) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    spans = [(s, k, e, KINDS[k]) for s, k, e in base]
    joined = lambda rows: ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in rows)
    every = sorted(spans + [(s, 3, e, "random") for s, e in random_spans(text, base, vocabulary, digests)])
    count = [sum(k == n for _, n, _ in base) for k in range(3)]
    return *count, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(every)


def scan(docs: DataFrame, vocabulary: str, digests: frozenset[str] = frozenset()) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans. digests is a stated list of known ones, which goes to every task. No shuffle."""
    arrow_limits(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("vocabulary", forget)
        ranks = encoding(vocabulary)
        for batch in batches:
            found = [scan_text("" if t is None else t, ranks, digests) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[k] for f in found], schema.field(k + 1).type) for k in range(5))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
