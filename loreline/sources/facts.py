"""Facts of how values flow in a Python file, for type inference across files.

A slot is a place that holds values: ``module.f.x`` (a variable or parameter), ``module.C.x`` (an attribute), ``module.f()`` (what a function returns), or
``module#k`` (the k-th expression of a file that needs a name). Facts (dst, kind, src, member, line_number):

- type: slot dst holds instances of src; move: dst holds what slot src holds
- call: dst holds what calling src gives; arg: src is passed to callee dst as argument ``member`` (a place from 0, or a keyword)
- member, attr: dst holds what method or attribute ``member`` of the values of slot src gives
- marg: src is passed to a method of the values of slot dst as argument ``method|place``
- param: slot src is parameter ``member`` of function dst: its place, its place in a call through an instance (m0, m1 ...), its name; alias: name dst of a module stands for src

Names of callees and types are absolute as far as the file tells them; whether they are classes or functions is told later, by joins.
"""

from __future__ import annotations

import ast
import builtins
from collections import deque

_LITERALS = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.Tuple: "tuple", ast.JoinedStr: "str", ast.Compare: "bool"}
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


_BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")


def blocks_of(node) -> list:
    """The statements right inside a statement, handler or case: no expression holds any."""
    return [x for f in node._fields if f in _BLOCKS and isinstance(v := getattr(node, f), list) for x in v]


def _stored(body) -> set[str]:
    """Names that some statements store, without what inner functions and classes store."""
    found, todo = set(), list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                found.add(node.id)
        elif not isinstance(node, _SCOPES):
            for f in node._fields:
                v = getattr(node, f, None)
                if isinstance(v, list):
                    todo.extend(x for x in v if isinstance(x, ast.AST))
                elif isinstance(v, ast.AST) and f != "ctx":
                    todo.append(v)
    return found


def _params(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *args.kwonlyargs]


class Facts(ast.NodeVisitor):
    """Collects ``rows`` of a tree. ``module`` is its dotted name; ``package`` tells whether the file is a package's own."""

    def __init__(self, module: str, package: bool = False):
        self.module, self.package = module, package
        self.rows: list[dict] = []
        self.names: list[tuple[str, set[str], str | None]] = []  # scopes: qualified name, names stored there, class around
        self.imported: dict[str, str] = {}
        self.count = 0

    def add(self, dst, kind, src, member=None, node=None) -> None:
        if dst and src:
            self.rows.append(dict(dst=dst, kind=kind, src=src, member=member, line_number=getattr(node, "lineno", None)))

    def collect(self, tree: ast.Module) -> list[dict]:
        todo = deque([tree])
        while todo:
            node = todo.popleft()
            todo.extend(blocks_of(node))
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.imported[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(node, ast.ImportFrom):
                base = self._base(node)
                for a in node.names:
                    self.imported[a.asname or a.name] = f"{base}.{a.name}" if base else a.name
        for name, ref in self.imported.items():
            self.add(f"{self.module}.{name}", "alias", ref)
        self.defined = {n.name for n in tree.body if isinstance(n, _SCOPES[:3])}
        self.names.append((self.module, _stored(tree.body), None))
        self._body(tree.body)
        return self.rows

    def _base(self, node: ast.ImportFrom) -> str:
        if not node.level:
            return node.module or ""
        parts = self.module.split(".")
        keep = len(parts) - node.level + (1 if self.package else 0)
        return ".".join([*parts[:max(keep, 0)], *([node.module] if node.module else [])])

    def _body(self, body) -> None:
        for node in body:
            self.visit(node)

    # names
    def _var(self, name: str) -> str | None:
        """The slot of a variable that is stored in some scope around."""
        for where, stored, _ in reversed(self.names):
            if name in stored:
                return f"{where}.{name}"
        return None

    def _ref(self, node) -> str | None:
        """The absolute dotted name of an expression that names something defined or imported; None if a variable stands at its head."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name) or self._var(node.id):
            return None
        head = self.imported.get(node.id) or next((f"{w}.{node.id}" for w, _, _ in reversed(self.names[1:]) if node.id in self.inner.get(w, ())), None)
        head = head or (f"{self.module}.{node.id}" if node.id in self.defined else None)
        return ".".join([head, *reversed(parts)]) if head else None

    inner: dict = {}

    def _fresh(self) -> str:
        self.count += 1
        return f"{self.module}#{self.count}"

    # expressions
    def slot(self, node) -> str | None:
        """The slot that holds the value of an expression; facts of its parts are added."""
        if isinstance(node, ast.Name):
            ref = None if self._var(node.id) else self._ref(node)
            return self._var(node.id) or ref
        if isinstance(node, ast.Constant):
            if node.value is None or node.value is Ellipsis:
                return None
            out = self._fresh()
            self.add(out, "type", type(node.value).__name__, None, node)
            return out
        if isinstance(node, ast.Call):
            return self._call(node)
        if isinstance(node, ast.Attribute):
            if ref := self._ref(node):
                return ref
            out, value = self._fresh(), self.slot(node.value)
            self.add(out, "attr", value, node.attr, node)
            return out if value else None
        if isinstance(node, (ast.IfExp, ast.BoolOp)):
            parts = [node.body, node.orelse] if isinstance(node, ast.IfExp) else node.values
            if isinstance(node, ast.IfExp):
                self.slot(node.test)
            out = self._fresh()
            for p in parts:
                self.add(out, "move", self.slot(p), None, node)
            return out
        if isinstance(node, (ast.Await, ast.NamedExpr)):
            value = self.slot(node.value)
            if isinstance(node, ast.NamedExpr):
                self._assign(node.target, value, node)
            return value
        for kind, name in _LITERALS.items():
            if isinstance(node, kind):
                out = self._fresh()
                self.add(out, "type", name, None, node)
                self._parts(node)
                return out
        self._parts(node)
        return None

    def _parts(self, node) -> None:
        if not isinstance(node, ast.Lambda):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.expr):
                    self.slot(child)
                elif isinstance(child, ast.comprehension):
                    self.slot(child.iter)

    def _call(self, node: ast.Call) -> str:
        out, ref = self._fresh(), self._ref(node.func)
        given = [(str(k), a) for k, a in enumerate(node.args) if not isinstance(a, ast.Starred)] + [(k.arg, k.value) for k in node.keywords if k.arg]
        if ref:
            self.add(out, "call", ref, None, node)
            for place, a in given:
                self.add(ref, "arg", self.slot(a), place, node)
        elif isinstance(node.func, ast.Attribute):
            of = self.slot(node.func.value)
            self.add(out, "member", of, node.func.attr, node)
            for place, a in given:
                self.add(of, "marg", self.slot(a), f"{node.func.attr}|{place}", node)
        else:
            if isinstance(node.func, ast.Name) and not self._var(node.func.id) and isinstance(getattr(builtins, node.func.id, None), type):
                self.add(out, "type", node.func.id, None, node)
            for _, a in given:
                self.slot(a)
        return out

    def _annotated(self, dst: str, node) -> None:
        """Types that an annotation names: a class, or those of a union; of a generic its head."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                node = ast.parse(node.value, mode="eval").body
            except (SyntaxError, ValueError):
                return
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            self._annotated(dst, node.left)
            self._annotated(dst, node.right)
        elif isinstance(node, ast.Subscript):
            head = node.value.attr if isinstance(node.value, ast.Attribute) else getattr(node.value, "id", "")
            if head in ("Optional", "Union"):
                for part in node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]:
                    self._annotated(dst, part)
            else:
                self._annotated(dst, node.value)
        elif isinstance(node, (ast.Name, ast.Attribute)):
            ref = self._ref(node)
            if not ref and isinstance(node, ast.Name) and isinstance(getattr(builtins, node.id, None), type):
                ref = node.id
            self.add(dst, "type", ref, None, node)

    # statements
    def _assign(self, target, value: str | None, node) -> None:
        if isinstance(target, ast.Name):
            self.add(self._var(target.id), "move", value, None, node)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and self.names[-1][2]:
            self.add(f"{self.names[-1][2]}.{target.attr}", "move", value, None, node)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for part in target.elts:
                self._assign(part, None, node)

    def visit_Assign(self, node):
        value = self.slot(node.value)
        for target in node.targets:
            self._assign(target, value, node)

    def visit_AnnAssign(self, node):
        where = f"{self.names[-1][2]}.{node.target.attr}" if isinstance(node.target, ast.Attribute) and self.names[-1][2] else self._var(node.target.id) if isinstance(node.target, ast.Name) else None
        if where:
            self._annotated(where, node.annotation)
        if node.value is not None:
            self._assign(node.target, self.slot(node.value), node)

    def visit_Return(self, node):
        if node.value is not None and len(self.names) > 1:
            self.add(f"{self.names[-1][0]}()", "move", self.slot(node.value), None, node)

    def visit_ClassDef(self, node):
        own = f"{self.names[-1][0]}.{node.name}"
        self.inner = {**self.inner, self.names[-1][0]: {*self.inner.get(self.names[-1][0], ()), node.name}}
        # names of a class body are no scope for what stands inside its methods
        for inner in node.body:
            if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._function(inner, own)
            elif isinstance(inner, ast.ClassDef):
                self.names.append((own, set(), None))
                self.visit(inner)
                self.names.pop()
            elif isinstance(inner, ast.AnnAssign) and isinstance(inner.target, ast.Name):
                self._annotated(f"{own}.{inner.target.id}", inner.annotation)
                self.add(f"{own}.{inner.target.id}", "move", self.slot(inner.value) if inner.value is not None else None, None, inner)
            elif isinstance(inner, ast.Assign):
                value = self.slot(inner.value)
                for target in inner.targets:
                    if isinstance(target, ast.Name):
                        self.add(f"{own}.{target.id}", "move", value, None, inner)
            else:
                self.visit(inner)

    def _function(self, node, cls: str | None = None):
        own = f"{cls or self.names[-1][0]}.{node.name}"
        if cls is None:
            self.inner = {**self.inner, self.names[-1][0]: {*self.inner.get(self.names[-1][0], ()), node.name}}
        marks = {d.id for d in node.decorator_list if isinstance(d, ast.Name)}
        static = bool(marks & {"staticmethod", "classmethod"})
        params = _params(node.args)
        for k, p in enumerate(params):
            slot = f"{own}.{p.arg}"
            if p not in node.args.kwonlyargs:
                self.add(own, "param", slot, str(k), node)
                self.add(own, "param", slot, f"m{k + ('staticmethod' in marks)}", node)
            self.add(own, "param", slot, p.arg, node)
            if p.annotation is not None:
                self._annotated(slot, p.annotation)
            elif cls and k == 0 and not static:
                self.add(slot, "type", cls, None, node)
        if node.returns is not None:
            self._annotated(f"{own}()", node.returns)
        for default in (*node.args.defaults, *[d for d in node.args.kw_defaults if d is not None]):
            self.slot(default)
        self.names.append((own, {p.arg for p in params} | _stored(node.body), cls or self.names[-1][2]))
        self._body(node.body)
        self.names.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def generic_visit(self, node):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):
                self.slot(child)
            else:
                self.visit(child)


def facts_of(tree: ast.Module, module: str, package: bool = False) -> list[dict]:
    try:
        return Facts(module, package).collect(tree)
    except RecursionError:
        return []
