"""Splits source files into function- and class-level chunks.

Python is parsed by the standard library, with an indentation scan where that fails; languages with braces are scanned
over a copy of the text in which strings and comments are blank. Scanners are looked up by language, so a real parser can
take a language's place. A function is a chunk of its own and isn't searched further; a container (class, interface,
namespace) is a chunk and is searched. A file without declarations that isn't blank is one chunk.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chunkmill.functions.scalar import newlines
from chunkmill.plans.schema import CHUNK

Span = tuple[int, int, str | None]  # first byte or character, end, symbol


@dataclass(frozen=True)
class Chunk:
    path: str
    language: str
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    text: str
    symbol: str | None


def python_spans(text: str) -> list[Span]:
    """Character spans of functions and classes; decorators stay outside."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return indented_spans(text)
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def place(line: int, column: int) -> int:
        """Character of a line and a column in bytes."""
        own = lines[line - 1]
        return starts[line - 1] + (column if own.isascii() else len(own.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "surrogatepass")))

    found: list[Span] = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            is_function = isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef)
            if is_function or isinstance(child, ast.ClassDef):
                found.append((place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), child.name))
            if not is_function:
                visit(child)

    visit(tree)
    return found


def indented_spans(text: str) -> list[Span]:
    """Python declarations by indentation, for text that can't be parsed."""
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text)
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line))
    head = re.compile(r"([ \t]*)(async\s+def|def|class)\s+(\w+)")
    found: list[Span] = []
    inside = -1
    for k, line in enumerate(lines):
        m = head.match(line)
        if not m or offsets[k] < inside:
            continue
        indent, end = len(m[1]), k + 1
        for j in range(k + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                end = j + 1
        stop = offsets[end - 1] + len(lines[end - 1].rstrip("\r\n"))
        found.append((offsets[k] + indent, stop, m[3]))
        if m[2] != "class":
            inside = stop
    return found


_BLANKED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)


def blanked(text: str) -> str:
    """The text with strings and comments as spaces, line feeds kept."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


# Declarations of the brace languages.
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|virtual|override|async|readonly|unsafe|extern|new|ref|file|required)\s+)*"
_ATTRIBUTES = r"(?:\[[^\]\n]*\]\s*)*"
_CS_CONTAINER = re.compile(rf"{_ATTRIBUTES}{_MODIFIERS}\b(?:class|struct|interface|record(?:\s+(?:class|struct))?|namespace)\s+([A-Za-z_][\w.]*)")
_CS_METHOD = re.compile(rf"{_ATTRIBUTES}{_MODIFIERS}(?:~\s*)?(?:[A-Za-z_][\w.<>,\[\]?]*(?:\s*<[^(){{}};=]*>)?[\s]+)?(?<![\w.])([A-Za-z_]\w*)\s*(?:<[^(){{}};]*>)?\s*\(")
#: A function among top-level statements has a type, which a call hasn't.
_LOCAL = re.compile(r"\s*(?!(?:await|return|new|throw|else|yield|in|is|as|not|and|or|case|goto)\b)[A-Za-z_][\w.<>,\[\]?\s]*[\s>\]?][A-Za-z_]\w*\s*(?:<[^(){};]*>)?\s*\(\Z")
_JS_FUNCTION = re.compile(r"(?:\basync\s+)?\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>)?\s*\(")
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>)?\s*\(")
_JS_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)")
_TS_INTERFACE = re.compile(r"\binterface\s+([A-Za-z_$][\w$]*)")
_NOT_NAMES = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "new", "await", "throw", "else", "function", "typeof", "nameof", "base", "this", "super", "when", "fixed", "do", "with", "yield", "in", "of", "case", "sizeof", "default"}


_PAIRS = {"()": re.compile(r"[()]"), "{}": re.compile(r"[{}]")}
_STOPS = re.compile(r"[({;}]|=>")


def _close(code: str, at: int, pair: str) -> int:
    """End of the bracket that opens at `at`."""
    depth = 0
    for m in _PAIRS[pair].finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(code)


def _body(code: str, at: int) -> tuple[int, int] | None:
    """Start and end of the block or arrow body that follows a header; None for a declaration without one."""
    while m := _STOPS.search(code, at):
        k = m.start()
        if m[0] == "(":
            at = _close(code, k, "()")
            continue
        if m[0] == "{":
            return k, _close(code, k, "{}")
        if m[0] == "=>":
            end = code.find(";", k)
            return k, len(code) if end < 0 else end + 1
        return None
    return None


def _owners(code: str) -> Callable[[int], int]:
    """The position of the innermost brace that is open at a character, or -1; a brace lies in the one around it."""
    places, owners, stack = [], [], [-1]
    for m in _PAIRS["{}"].finditer(code):
        if m[0] == "}" and len(stack) > 1:
            stack.pop()
        places.append(m.start())
        owners.append(stack[-1])
        if m[0] == "{":
            stack.append(m.start())

    def owner(at: int) -> int:
        k = bisect.bisect_right(places, at) - 1
        return -1 if k < 0 else owners[k] if places[k] == at or code[places[k]] == "}" else places[k]

    return owner


def _objects(code: str) -> set[int]:
    """Open braces of object literals, by what stands before them."""
    out = set()
    for m in re.finditer(r"\{", code):
        k = m.start()
        last = k - 1
        while last >= 0 and code[last].isspace():
            last -= 1
        if (last >= 0 and code[last] in "=(,:[?") or code[max(0, k - 40) : k].rstrip().endswith("return"):
            out.add(k)
    return out


def brace_spans(text: str, language: str) -> list[Span]:
    code = blanked(text)
    owner = _owners(code)
    csharp = language == "csharp"
    bodies: set[int] = set()
    found: list[Span] = []
    starts: list[int] = []  # functions, in order; they don't overlap
    ends: list[int] = []
    containers = [_CS_CONTAINER] if csharp else [_JS_CLASS] + [_TS_INTERFACE] * (language in ("typescript", "tsx"))
    heads = sorted((m.start(), m.end(), m[1]) for p in containers for m in p.finditer(code))
    for start, end, name in heads:
        body = _body(code, end)
        if csharp and body is None:
            stop = code.find(";", end)
            found.append((start, stop + 1 if stop >= 0 else len(code), name))
        elif body:
            bodies.add(body[0])
            found.append((start, body[1], name))
    candidates: list[tuple[int, int, str]] = []
    if not csharp:
        bodies |= _objects(code)
        candidates += [(m.start(), m.end() - 1, m[1]) for m in _JS_FUNCTION.finditer(code)]
    for m in (_CS_METHOD if csharp else _JS_METHOD).finditer(code):
        if m[1] in _NOT_NAMES:
            continue
        if (at := owner(m.end() - 1)) not in bodies and not (csharp and at < 0 and _LOCAL.match(m[0])):
            continue
        k = m.start() - 1
        while k >= 0 and code[k].isspace():
            k -= 1
        if k < 0 or code[k] in "{};],":
            candidates.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - 1, m[1]))

    def inside(at: int) -> bool:
        """Whether a position lies in a function."""
        k = bisect.bisect_left(starts, at) - 1
        return k >= 0 and at < ends[k]

    for start, end, name in sorted(candidates):
        if inside(start):
            continue
        body = _body(code, end)
        if body is None:
            continue
        starts.append(start)
        ends.append(body[1])
        found.append((start, body[1], name))
    return sorted(s for s in found if not inside(s[0]))


#: Scanner of each language; replace one to plug in another parser.
SCANNERS: dict[str, Callable[[str], list[Span]]] = {"python": python_spans, **{x: (lambda text, x=x: brace_spans(text, x)) for x in ("csharp", "javascript", "typescript", "tsx")}}


def chunk_source(path: str, content: bytes, language: str) -> list[Chunk]:
    text = content.decode("utf-8", "replace")
    exact = text.encode("utf-8") == content
    spans = SCANNERS[language](text)
    feeds = [m.start() for m in re.finditer("\n", text)] if spans else []
    line = lambda at: bisect.bisect_left(feeds, at) + 1
    byte = _bytes_at(text, {p for start, end, _ in spans for p in (start, end)})
    out = [Chunk(path, language, line(start), line(max(start, end - 1)), byte[start], byte[end], text[start:end], symbol) for start, end, symbol in spans]
    if not out and text.strip():
        out.append(Chunk(path, language, 1, text.count("\n") + 1, 0, len(content) if exact else len(text.encode("utf-8")), text, None))
    return out


def _bytes_at(text: str, places: set[int]) -> dict[int, int]:
    """Bytes before each of the character positions, in one pass."""
    if text.isascii():
        return {p: p for p in places}
    out, before, total = {}, 0, 0
    for p in sorted(places):
        total += len(text[before:p].encode("utf-8"))
        before, out[p] = p, total
    return out


def chunk_files(files: DataFrame, *keep: str) -> DataFrame:
    """(path, content, language) to chunks, file by file, without a shuffle; string columns to keep come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = CHUNK.fieldNames()
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(c, r) for r in batch.to_pylist() for c in chunk_source(r["path"], r["content"], r["language"])]
            columns = [pa.array([getattr(c, n) for c, _ in rows], t) for n, t in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([r[n] for _, r in rows], pa.string()) for n in keep], names=[*names, *keep])

    ready = files.where(F.col("language").isNotNull() & F.col("content").isNotNull()).select("path", F.col("content").cast("binary"), "language", *keep)
    return ready.mapInArrow(run, StructType([*CHUNK.fields, *(StructField(n, StringType()) for n in keep)]))


def whole_files(files: DataFrame) -> DataFrame:
    """(path, content) to a chunk for each file that isn't blank, as for a file without declarations: lines and bytes of the whole, no symbol."""
    text = F.decode("content", "UTF-8")
    size = F.length("content").cast("int")
    rows = files.where(text.rlike(r"(?U)\S"))
    return rows.select("path", F.lit(1).alias("start_line"), (newlines(text) + 1).alias("end_line"), F.lit(0).alias("start_byte"), size.alias("end_byte"), text.alias("text"), F.lit(None).cast("string").alias("symbol"))
