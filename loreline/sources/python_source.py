"""Python parsing: one pass of the standard ast module in Arrow batches, nested rows out, exploded into relations.

Symbols, imports, calls and base classes come from one visitor, so callers and symbols share one scope rule (nested functions included).
A file that does not parse gives the rows of its sound blocks (``islands``) and an error text.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loreline.functions.text import content_hash, line_count
from loreline.schemas import PARSED
from loreline.sources import islands
from loreline.sources.facts import blocks_of, facts_of

FACTS = ("symbols", "imports", "calls", "bases", "flows")
PIECE = 512  # files whose rows are held at once


def module_name(path: str) -> str:
    name = path.replace("\\", "/").lstrip("./").replace("/", ".").replace(".py", "")
    return name[: -len(".__init__")] if name.endswith(".__init__") else name


def _signature(node) -> str:
    returns = f" -> {ast.unparse(node.returns)}" if getattr(node, "returns", None) is not None else ""
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{word} {node.name}({ast.unparse(node.args)}){returns}"


def _dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return None


class _Visitor(ast.NodeVisitor):
    def __init__(self, module: str, signatures: bool = True, calls: bool = True):
        self.module, self.scope, self.signatures, self.with_calls = module, [], signatures, calls
        self.symbols, self.imports, self.calls, self.bases = [], [], [], []

    def generic_visit(self, node):
        if self.with_calls:
            super().generic_visit(node)
        else:  # all else stands in statements
            for part in blocks_of(node):
                self.visit(part)

    def _qualified(self, *more: str) -> str:
        return ".".join(x for x in (self.module, *[n for n, _ in self.scope], *more) if x)

    def _class_at(self):
        """Name of the innermost class around, and its qualified name."""
        for k in range(len(self.scope) - 1, -1, -1):
            if self.scope[k][1] == "class":
                return self.scope[k][0], ".".join(x for x in (self.module, *[n for n, _ in self.scope[: k + 1]]) if x)
        return None, None

    def _symbol(self, node, kind: str, signature: str | None) -> None:
        name, _ = self._class_at()
        if kind == "function" and name:
            kind = "method"
        self.symbols.append(dict(name=node.name, type=kind, qualified_name=self._qualified(node.name), start_line=node.lineno, end_line=node.end_lineno or node.lineno, docstring=ast.get_docstring(node), signature=signature, is_exported=not node.name.startswith("_"), parent_class=name))

    def _inside(self, node, kind: str) -> None:
        self.scope.append((node.name, kind))
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_ClassDef(self, node):
        self._symbol(node, "class", None)
        own = self._qualified(node.name)
        for base in node.bases:
            parent = _dotted(base.value if isinstance(base, ast.Subscript) else base)
            if parent:
                self.bases.append(dict(child=own, parent=parent, line_number=node.lineno))
        for part in (*node.decorator_list, *node.bases, *[k.value for k in node.keywords]):
            self.visit(part)
        self._inside(node, "class")

    def _function(self, node):
        self._symbol(node, "function", _signature(node) if self.signatures else None)
        for part in (*node.decorator_list, node.args):
            self.visit(part)
        self._inside(node, "function")

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _import(self, node, module: str, name: str | None, alias: str | None, level: int) -> None:
        self.imports.append(dict(module_path=module, imported_name=name, alias=alias, is_relative=level > 0, relative_level=level, line_number=node.lineno))

    def visit_Import(self, node):
        for a in node.names:
            self._import(node, a.name, None, a.asname, 0)

    def visit_ImportFrom(self, node):
        for a in node.names:
            self._import(node, node.module or "", a.name, a.asname, node.level)

    def visit_Call(self, node):
        chain = _dotted(node.func)
        if chain:
            own = chain.split(".")
            kind = "self" if own[0] == "self" and len(own) > 1 else "method" if len(own) > 1 or isinstance(node.func, ast.Attribute) else "direct"
            _, cls = self._class_at()
            self.calls.append(dict(target=own[-1], call_type=kind, caller_class=cls, caller_qname=self._qualified() if self.scope else None, line_number=node.lineno, chain=chain))
        self.generic_visit(node)


def parse_source(source: str, path: str, only: tuple[str, ...] = FACTS, signatures: bool = True) -> dict:
    """Rows of one file: symbols, imports, calls, bases, value flows (those that ``only`` names); and an error if only parts of it parse.
    Without ``signatures`` those of symbols are null."""
    error = None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        error = f"{type(e).__name__}: {e}"
        tree = islands.recover(source)
    visitor = _Visitor(module_name(path), signatures and "symbols" in only, "calls" in only)
    try:
        visitor.visit(tree)
    except RecursionError as e:  # an expression nested too deep to walk: what was met before it stays
        error = error or f"{type(e).__name__}: {e}"
    flows = facts_of(tree, module_name(path), path.endswith("__init__.py")) if "flows" in only else []
    found = dict(symbols=visitor.symbols, imports=visitor.imports, calls=visitor.calls, bases=visitor.bases, flows=flows)
    return dict(error=error) | {f: found[f] for f in only}


def parse_files(files: DataFrame, only: tuple[str, ...] = FACTS, signatures: bool = True) -> DataFrame:
    """(path, content as binary or string) -> one nested row a file (schema PARSED, of its relations those that ``only`` names; signatures null, if not asked for)."""
    content = F.col("content").cast("binary")
    rows = files.select("path", content_hash(content).alias("hash"), line_count(F.decode(content, "UTF-8")).alias("line_count"), F.length(content).cast("long").alias("size_bytes"), content.alias("content"))
    schema = T.StructType([f for f in PARSED if f.name not in FACTS or f.name in only])
    made = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                parsed = [parse_source(c.decode("utf-8", "replace"), p, only, signatures) for c, p in zip(b["content"].to_pylist(), b["path"].to_pylist())]
                yield pa.record_batch([b[f.name] if f.name in b.schema.names else pa.array([x[f.name] for x in parsed], f.type) for f in made], schema=made)

    return rows.mapInArrow(run, schema)


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Symbol rows with ids in (path, position) order. Ids come from a hash, so no global sort or single task is needed."""
    rows = parsed.select("path", F.posexplode("symbols").alias("pos", "s")).select("path", "pos", "s.*")
    sid = F.xxhash64("path", "pos", "qualified_name")
    return rows.select(sid.alias("symbol_id"), F.xxhash64("path").alias("file_id"), F.col("path").alias("file_path"), "pos", "name", "type", "qualified_name", "start_line", "end_line", "docstring", "signature", "is_exported", "parent_class")


def with_parents(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """parent_class_id by the qualified name of what encloses a symbol. names: (qname, type, symbol_id)."""
    parents = names.filter("type = 'class'").groupBy(F.col("qname").alias("parent_qname")).agg(F.min("symbol_id").alias("parent_class_id"))
    enclosing = F.regexp_replace("qualified_name", r"\.[^.]+$", "")
    return symbols.withColumn("parent_qname", enclosing).join(parents, "parent_qname", "left").drop("parent_qname")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.xxhash64("path").alias("file_id"), "path", F.posexplode("imports").alias("pos", "i")).select("file_id", "path", "pos", "i.*")


def calls_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("calls").alias("pos", "c")).select("path", "pos", "c.*")


def bases_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("bases").alias("pos", "b")).select("path", "pos", "b.*")


def flows_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("flows").alias("f")).select("path", "f.*")
