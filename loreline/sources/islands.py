"""Syntax trees of files that do not parse: the sound blocks of a broken file, each parsed alone.

A file is cut into blocks by indentation, over logical lines (brackets, strings and continuations are joined). A block that parses is taken
as it stands. Of one that does not, the header of a class or function is kept (its name alone, if it is the header that is broken, and only above a
sound statement) and its body is cut in turn, so that only the smallest broken
statement is lost. A bracket that is never closed ends where a line begins with a word that no expression can begin with; a string
that is never closed is cut in the same way, but only if that leaves fewer broken rows (sound strings often hold code).
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

_HEAD = re.compile(r"\s*(async\s+def|def|class)\s+(\w+)")
_CLAUSE = re.compile(r"(else|elif|except|finally)\b")
_RESYNC = re.compile(r"\s*(?:(?:async\s+)?def\s+\w+|class\s+\w+|import\s+\w|from\s+[\w.]+\s+import\b|return\b|raise\b|while\b|with\b|try\s*:|else\s*:|finally\s*:|(?:elif|except)\b.*:\s*(?:#.*)?$|pass\s*$|@\w)")
_TOKEN = re.compile(r"""#.*|(?P<triple>\"{3}|'{3})|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|(?P<open>[\[({])|(?P<close>[\])}])|(?P<more>\\$)""")
TRIED = 16  # strings that are cut in turn
_FAILS = (SyntaxError, ValueError, RecursionError, MemoryError)


@dataclass
class _Line:
    """A logical line: rows first .. last of the file, and its indentation."""

    first: int
    last: int
    indent: int
    text: str  # of its first row, stripped


def _indent(row: str) -> int:
    row = row.expandtabs(8)
    return len(row) - len(row.lstrip())


def _closing(row: str, at: int, quote: str) -> int:
    """Where a triple-quoted string that is open at ``at`` ends on this row; -1 if it does not."""
    while at < len(row):
        if row[at] == "\\":
            at += 2
        elif row.startswith(quote, at):
            return at + 3
        else:
            at += 1
    return -1


def _logical(rows: list[str], lo: int, hi: int, cuts: frozenset[int] = frozenset(), strict: bool = False) -> tuple[list[_Line], list[int]]:
    """Logical lines of rows lo .. hi - 1, and the rows at which a string opens that holds what looks like code.

    A string that opens in a row of ``cuts`` ends before the first such line. ``strict`` ends an unclosed header at a colon.
    """
    out: list[_Line] = []
    doubtful: list[int] = []
    depth, quote, joined, opened = 0, "", False, lo
    for k in range(lo, hi):
        row = rows[k]
        if _RESYNC.match(row):
            if quote and opened in cuts:
                depth, quote, joined = 0, "", False
            elif quote:
                doubtful += [opened] if doubtful[-1:] != [opened] else []
            elif depth:
                depth, joined = 0, False
        at = 0
        if quote:
            out[-1].last = k
            at = _closing(row, 0, quote)
            if at < 0:
                continue
            quote = ""
        elif depth or joined:
            out[-1].last = k if row.strip() else out[-1].last
        elif not row.strip() or row.lstrip().startswith("#"):
            continue
        else:
            out.append(_Line(k, k, _indent(row), row.strip()))
        joined = False
        while token := _TOKEN.search(row, at):
            at = token.end()
            if token["triple"]:
                at = _closing(row, at, token["triple"])
                if at < 0:
                    quote, opened = token["triple"], k
                    break
            elif token["open"]:
                depth += 1
            elif token["close"]:
                depth = max(0, depth - 1)
            elif token["more"] is not None:
                joined = True
        if strict and depth and _HEAD.match(rows[out[-1].first]) and row.split("#")[0].rstrip().endswith(":"):
            depth = 0
    return out, doubtful


def _blocks(lines: list[_Line]) -> list[list[_Line]]:
    """Runs of logical lines: one at the outer indentation, with its decorators, what is indented below it, and its further clauses."""
    out: list[list[_Line]] = []
    base = lines[0].indent if lines else 0
    for line in lines:
        base = min(base, line.indent)
        decorated = out and out[-1][-1].text.startswith("@") and out[-1][-1].indent == line.indent
        if out and (line.indent > base or decorated or (_CLAUSE.match(line.text) and len(out[-1]) > 1 and line.indent == out[-1][0].indent)):
            out[-1].append(line)
        else:
            out.append([line])
    return out


def _parse(rows: list[str], first: int, last: int) -> list[ast.stmt]:
    """The statements of rows first .. last, with the line numbers of the file."""
    text = "\n".join(rows[first:last + 1])
    inside = _indent(rows[first]) > 0
    tree = ast.parse(f"if 1:\n{text}" if inside else text)
    ast.increment_lineno(tree, first - 1 if inside else first)
    return tree.body[0].body if inside else tree.body


def _header(rows: list[str], first: int, line: _Line):
    """The statement that a header (with decorators from row ``first``) opens, with an empty body; None if it does not parse."""
    pad = " " * (line.indent + 1)
    try:
        text = "\n".join(rows[first:line.last + 1])
        tree = ast.parse(("if 1:\n" if line.indent else "") + text + f"\n{pad}pass")
    except _FAILS:
        return None
    ast.increment_lineno(tree, first - 1 if line.indent else first)
    body = tree.body[0].body if line.indent else tree.body
    return body[0] if len(body) == 1 else None


def _stub(kind: str, name: str, line: _Line):
    at = dict(lineno=line.first + 1, end_lineno=line.last + 1, col_offset=0, end_col_offset=0)
    if kind == "class":
        return ast.ClassDef(name=name, bases=[], keywords=[], body=[], decorator_list=[], type_params=[], **at)
    made = ast.AsyncFunctionDef if kind.startswith("async") else ast.FunctionDef
    empty = ast.arguments(posonlyargs=[], args=[], vararg=None, kwonlyargs=[], kw_defaults=[], kwarg=None, defaults=[])
    return made(name=name, args=empty, body=[], decorator_list=[], returns=None, type_comment=None, type_params=[], **at)


class _Islands:
    """What can be told of a file if the strings that open in rows ``cuts`` are cut; ``lost`` counts the rows that cannot."""

    def __init__(self, rows: list[str], cuts: frozenset[int] = frozenset()):
        self.rows, self.cuts, self.lost = rows, cuts, 0
        lines, self.doubtful = _logical(rows, 0, len(rows), cuts)
        self.body = [x for block in _blocks(lines) for x in self.recover(block)]

    def recover(self, block: list[_Line], strict: bool = False) -> list[ast.stmt]:
        rows, first, last = self.rows, block[0].first, block[-1].last
        try:
            return _parse(rows, first, last)
        except _FAILS:
            pass
        k = next((i for i, x in enumerate(block) if not x.text.startswith("@")), None)
        if k is None:
            self.lost += last + 1 - first
            return []
        line, rest = block[k], block[k + 1:]
        named = _HEAD.match(rows[line.first])
        head = _header(rows, first, line) or (_header(rows, line.first, line) if k else None)
        if head is None and named and not strict and line.last > line.first:  # an unclosed bracket of the header has joined its body
            lines, _ = _logical(rows, first, last + 1, self.cuts, True)
            return [x for part in _blocks(lines) for x in self.recover(part, True)]
        self.lost += (line.last + 1 - line.first) * (head is None)
        found = [x for part in _blocks(rest) for x in self.recover(part, strict)] if rest else []
        if named and (head is not None or found):  # a broken header counts if something sound stands below it
            node = head if head is not None else _stub(named[1], named[2], line)
            node.body = found or [ast.copy_location(ast.Pass(), node)]
            node.end_lineno = last + 1
            return [node]
        if head is not None and getattr(head, "body", None):
            head.body = found or head.body
            return [head]
        return found


def recover(source: str) -> ast.Module:
    """A module of all statements that can be told, in file order, with the line numbers of the file.

    Where a string holds what looks like code, it may be one that was never closed: each of the first ``TRIED`` such strings is cut in turn,
    and the reading that loses the fewest rows is taken (the one without a cut among equals).
    """
    rows = source.replace("\x00", " ").replace("\r\n", "\n").replace("\r", "\n").replace("\f", " ").split("\n")
    try:
        best = _Islands(rows)
        for row in best.doubtful[:TRIED]:
            other = _Islands(rows, frozenset([row]))
            best = min(best, other, key=lambda x: x.lost)
        body = best.body
    except RecursionError:
        body = []
    return ast.Module(body=body, type_ignores=[])
