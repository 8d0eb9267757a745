"""Chunks of source code along its syntax: statements that fit together are grouped, those too large are opened.

A parser gives a tree of byte spans. The one here is Python's own; other languages need a grammar package, which a caller
may hand in as a parser of its own. What has no parser, or doesn't parse, is chunked by lines.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import chunking

#: Part of the largest size under which a last group joins the one before it.
TRAILING = 0.25


@dataclass(frozen=True)
class Node:
    """Bytes start to end of the source; name: of the scope that it opens, if any."""

    start: int
    end: int
    name: str = ""
    children: list[Node] = field(default_factory=list)


Parser = Callable[[bytes], "Node | None"]


def python_tree(source: bytes) -> Node | None:
    """Statements within statements; a compound one's first child is its head. None if the source doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))

    def node(stmt: ast.AST) -> Node:
        # a decorator stands before what it decorates, after its sign
        first = min((starts[d.lineno - 1] + d.col_offset - 1 for d in getattr(stmt, "decorator_list", [])), default=1 << 62)
        start = min(first, starts[stmt.lineno - 1] + stmt.col_offset)
        end = starts[stmt.end_lineno - 1] + stmt.end_col_offset
        inner = [node(x) for block in ("body", "handlers", "orelse", "finalbody", "cases") for x in getattr(stmt, block, []) if hasattr(x, "lineno")]
        if inner:
            head = source[start : inner[0].start].rstrip()
            inner.insert(0, Node(start, start + len(head)))
        named = isinstance(stmt, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        return Node(start, end, stmt.name if named else "", inner)

    return Node(0, len(source), "", [node(x) for x in tree.body])


PARSERS: dict[str, Parser] = {"python": python_tree}


def _size(source: bytes, start: int, end: int) -> int:
    """Characters that are no white space."""
    return len("".join(source[start:end].decode("utf-8", "replace").split()))


@dataclass
class _Piece:
    start: int
    end: int
    size: int
    scopes: tuple[str, ...]
    grouped: bool


def _by_lines(source: bytes, leaf: Node, most: int, scopes: tuple[str, ...]) -> Iterator[_Piece]:
    start, size, at = leaf.start, 0, leaf.start
    for line in source[leaf.start : leaf.end].splitlines(keepends=True):
        n = _size(line, 0, len(line))
        if size and size + n > most:
            yield _Piece(start, at, size, scopes, False)
            start, size = at, 0
        at, size = at + len(line), size + n
    if size:
        yield _Piece(start, at, size, scopes, False)


def _pieces(source: bytes, siblings: list[Node], most: int, scopes: tuple[str, ...]) -> list[_Piece]:
    out: list[_Piece] = []
    open_ = False
    for x in siblings:
        n = _size(source, x.start, x.end)
        if n > most:
            within = (*scopes, x.name) if x.name else scopes
            out += _pieces(source, x.children, most, within) if x.children else _by_lines(source, x, most, scopes)
            open_ = False
        elif open_ and out[-1].size + n <= most:
            out[-1].end, out[-1].size = x.end, out[-1].size + n
        else:
            out.append(_Piece(x.start, x.end, n, scopes, True))
            open_ = True
    if len(out) > 1 and out[-1].grouped and out[-2].grouped and out[-1].scopes == out[-2].scopes and out[-1].size < TRAILING * most:
        last = out.pop()
        out[-1].end, out[-1].size = last.end, out[-1].size + last.size
    return out


def chunks_of(text: str, most: int, parser: Parser) -> list[tuple[str, int, int, str]]:
    """(text, first line, last line, context) of a source; empty if it has no statement or doesn't parse.

    context: the scopes that were opened to get there, so a whole function or class has none."""
    source = text.encode()
    tree = parser(source)
    out = []
    for p in _pieces(source, tree.children, most, ()) if tree else ():
        body = source[p.start : p.end].rstrip()
        if body.strip():
            skipped = len(body) - len(body.lstrip(b"\r\n"))
            first = source.count(b"\n", 0, p.start + skipped) + 1
            out.append((body[skipped:].decode(), first, first + body[skipped:].count(b"\n"), " > ".join(p.scopes)))
    return out


def documents(files: DataFrame, most: int | None = None, policy: chunking.ChunkingPolicy | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(docid, text, url, source_path, start_line, end_line, context, metadata) of files(path, text), chunk by chunk.

    A file without a parser, or that doesn't parse, is chunked by its lines, without context. Null texts have no chunk."""
    policy = policy or chunking.ChunkingPolicy()
    known, most = parsers or PARSERS, most or policy.ast_max_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, x, grammar, target in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = chunks_of(x or "", most, known[grammar]) if grammar in known else []
                found = found or [(t, a, b, "") for _, t, a, b in chunking.chunks_of(x or "", target)]
                rows += [(f"{path}:{a}-{b}", t, "", path, a, b, c, None) for t, a, b, c in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = ["docid", "text", "url", "source_path", "start_line", "end_line", "context", "metadata"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = files.select("path", F.col("text").cast("string").alias("text"), chunking.language(F.col("path")).alias("grammar"), policy.target(F.col("path")).cast("int").alias("target"))
    return rows.mapInArrow(run, "docid string, text string, url string, source_path string, start_line int, end_line int, context string, metadata string")
