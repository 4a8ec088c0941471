"""The part of YAML that lists of records use, for where PyYAML isn't installed.

Block mappings and sequences by indentation, flow sequences and mappings of scalars, plain and quoted scalars, comments.
Anchors, tags, block scalars and several documents are refused.
"""

from __future__ import annotations

import re

_PLAIN = {"true": True, "false": False, "null": None, "~": None, "": None}
_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s"'\[{#&*!|>%@`-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?:\s+|$)""")
_QUOTED = re.compile(r"""\s*("(?:\\.|[^"\\])*"|'(?:''|[^'])*')\s*(?:#.*)?$""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}


class YamlError(ValueError):
    pass


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1])


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"'):
        if not (m := _QUOTED.match(text)):
            raise YamlError(f"a quote that isn't closed: {text}")
        return _unquoted(m[1])
    text = re.split(r"(?:^|\s)#", text, maxsplit=1)[0].strip()
    if text[:1] in "&*!|>%@`" and text:
        raise YamlError(f"not supported: {text}")
    if text[:1] in ("[", "{"):
        return _flow(text)
    if text.lower() in _PLAIN:
        return _PLAIN[text.lower()]
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?", text):
        return float(text)
    return text


def _flow(text: str):
    """[a, b] and {a: b} without nesting."""
    if text[-1] != {"[": "]", "{": "}"}[text[0]]:
        raise YamlError(f"a bracket that isn't closed: {text}")
    parts = [p for p in re.findall(r"""\s*("(?:\\.|[^"\\])*"[^,]*|'(?:''|[^'])*'[^,]*|[^,]+)\s*(?:,|$)""", text[1:-1]) if p.strip()]
    if any(c in p for p in parts for c in "[]{}" if p[0] not in "'\""):
        raise YamlError(f"nested brackets: {text}")
    if text[0] == "[":
        return [_scalar(p) for p in parts]
    pairs = [p.split(":", 1) for p in parts]
    return {_scalar(k): _scalar(v) for k, v in pairs}


def _lines(text: str) -> list[tuple[int, str]]:
    out = []
    for line in text.splitlines():
        body = line.strip()
        if body and body[0] != "#" and not (body == "---" and not out):
            if "\t" in line[: len(line) - len(line.lstrip())]:
                raise YamlError("a tab in the indentation")
            out.append((len(line) - len(line.lstrip()), line.strip()))
    return out


def load(text: str):
    lines = _lines(text)
    if not lines:
        return None
    value, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise YamlError(f"unexpected indentation: {lines[at][1]}")
    return value


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    if lines[at][1] == "-" or lines[at][1].startswith("- "):
        out = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
            rest = lines[at][1][1:]
            inner = indent + 1 + len(rest) - len(rest.lstrip())
            if not rest.strip() or rest.strip()[0] == "#":
                value, at = _below(lines, at + 1, indent)
            elif rest.strip().startswith("- ") or _KEY.match(rest.strip()):
                lines[at] = (inner, rest.strip())
                value, at = _block(lines, at, inner)
            else:
                value, at = _scalar(rest), at + 1
            out.append(value)
        return out, at
    if not _KEY.match(lines[at][1]):
        return _scalar(lines[at][1]), at + 1
    found = {}
    while at < len(lines) and lines[at][0] == indent and (m := _KEY.match(lines[at][1])):
        key, rest = _scalar(m[1]), lines[at][1][m.end() :]
        if rest and rest[0] != "#":
            found[key], at = _scalar(rest), at + 1
        else:  # a sequence may stand at its key's own indentation
            same = at + 1 < len(lines) and lines[at + 1][0] == indent and lines[at + 1][1].startswith("-")
            found[key], at = _block(lines, at + 1, indent) if same else _below(lines, at + 1, indent)
    return found, at


def _below(lines: list[tuple[int, str]], at: int, indent: int):
    """The block that is indented deeper, if there is one."""
    return _block(lines, at, lines[at][0]) if at < len(lines) and lines[at][0] > indent else (None, at)
