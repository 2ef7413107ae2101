"""Python files to symbols, by the standard library's syntax tree.

Raw texts (owners, bases, signatures) come from the source by byte offsets, as written.
"""

from __future__ import annotations

import ast
import re

MODULE = "<module>"
_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
DOC_BYTES = 120


def clip(text: str) -> str:
    """At most DOC_BYTES bytes, cut between characters."""
    return text.encode("utf-8")[:DOC_BYTES].decode("utf-8", "ignore")


class PythonFile:
    def __init__(self, source: bytes):
        self.text = source.decode("utf-8-sig")
        self.tree = ast.parse(self.text)
        # lines as the syntax tree counts them: form feeds and other separators do not end one
        self.lines = _LINE.findall(self.text.encode("utf-8"))
        self.out: dict = {"package": "", "imports": [], "objects": [], "methods": [], "calls": [], "var_types": []}
        self.known: set[str] = set()  # names of imports and of top-level definitions

    def raw(self, node: ast.AST) -> str:
        """Source of a node, parentheses around it not included."""
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset : node.end_col_offset].decode("utf-8")
        parts = [self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]]
        return b"".join(parts).decode("utf-8")

    def parse(self) -> dict:
        rows = self.text.count("\n") + (0 if self.text.endswith("\n") else 1) if self.text else 1
        # the tree's root ends behind the last newline
        last = self.text.count("\n") + 1
        self.out["methods"].append(self._method(MODULE, MODULE, "", "module", "global", "", "", 1, max(last, rows)))
        for node in self.tree.body:
            self._top(node)
        self._walk(self.tree, MODULE, set())
        return self.out

    # -- declarations

    def _top(self, node: ast.stmt) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self._import(a.name, a.asname or a.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for a in node.names:
                self._import(module, "" if a.name == "*" else a.asname or a.name)
        elif isinstance(node, ast.ClassDef):
            self._class(node, "")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self._function(node, "", "fn")
        elif isinstance(node, ast.AnnAssign):
            self._annotated(node, "")

    def _import(self, raw: str, alias: str) -> None:
        self.out["imports"].append({"raw": raw, "alias": alias})
        if alias:
            self.known.add(alias)

    def _class(self, node: ast.ClassDef, parent: str) -> None:
        fqn = f"{parent}.{node.name}" if parent else node.name
        if not parent:
            self.known.add(node.name)
        args = sorted([*node.bases, *node.keywords], key=lambda n: (n.lineno, n.col_offset))
        bases = [{"name": self.raw(a), "relation": "extends"} for a in args]
        self.out["objects"].append(
            {"name": node.name, "fqn": fqn, "subkind": "class", "bases": bases, "doc": self._doc(node), "start_line": node.lineno, "end_line": node.end_lineno}
        )
        for child in node.body:
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                plain_init = child.name == "__init__" and not child.decorator_list
                self._function(child, fqn, "ctor" if plain_init else "method")
            elif isinstance(child, ast.ClassDef):
                self._class(child, fqn)

    def _function(self, node, owner: str, subkind: str) -> None:
        fqn = f"{owner}.{node.name}" if owner else node.name
        if not owner:
            self.known.add(node.name)
        scope = "member" if owner else "global"
        self.out["methods"].append(self._method(node.name, fqn, owner, subkind, scope, self._signature(node), self._doc(node), node.lineno, node.end_lineno))
        a = node.args
        for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
            kind = self._type(p.annotation) if p.annotation else ""
            if kind:
                name = ("*" if p is a.vararg else "**" if p is a.kwarg else "") + p.arg
                self.out["var_types"].append({"scope_fqn": fqn, "var_name": name, "type_name": kind})

    @staticmethod
    def _method(name, fqn, owner, subkind, scope, signature, doc, start, end) -> dict:
        return {
            "name": name, "fqn": fqn, "owner_fqn": owner, "subkind": subkind, "scope": scope,
            "signature": signature, "doc": doc, "start_line": start, "end_line": end,
        }

    def _signature(self, node) -> str:
        """`def name(params) -> ret` as written, without the body."""
        lines = self.lines[node.lineno - 1 : node.body[0].lineno]
        head = b"".join(lines)[node.col_offset :].decode("utf-8")
        at = head.index("(", head.index("def "))
        if node.type_params if hasattr(node, "type_params") else False:
            at = head.index("(", head.index("]"))
        depth, i, quote = 0, at, ""
        while i < len(head):
            c = head[i]
            if quote:
                if c == "\\":
                    i += 1
                elif head.startswith(quote, i):
                    i += len(quote) - 1
                    quote = ""
            elif c in "\"'":
                quote = head[i : i + 3] if head[i : i + 3] in ('"""', "'''") else c
                i += len(quote) - 1
            elif c == "#":
                i = head.find("\n", i)
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    break
            i += 1
        ret = f" -> {self.raw(node.returns)}" if node.returns else ""
        lead = "async " if isinstance(node, ast.AsyncFunctionDef) else ""
        return f"{lead}def {node.name}{head[at : i + 1]}{ret}"

    def _doc(self, node) -> str:
        first = node.body[0]
        if not (isinstance(first, ast.Expr) and isinstance(first.value, (ast.Constant, ast.JoinedStr))):
            return ""
        if isinstance(first.value, ast.Constant) and not isinstance(first.value.value, (str, bytes)):
            return ""
        text = self.raw(first.value)
        for q in ('"""', "'''", '"', "'"):
            text = text.removeprefix(q).removesuffix(q)
        return clip(re.split(r"\r\n|\r|\n", text.strip())[0].strip())

    # -- calls and types of variables

    def _walk(self, node: ast.AST, caller: str, seen: set) -> None:
        """All nodes from the first to the last, with a stack of our own: chains of calls nest as deep as they are long."""
        top, todo = {id(n) for n in self.tree.body}, [(node, caller)]
        while todo:
            node, caller = todo.pop()
            todo += reversed(self._visit(node, caller, seen, id(node) in top))

    def _visit(self, node: ast.AST, caller: str, seen: set, is_top: bool) -> list[tuple[ast.AST, str]]:
        """Takes what the node itself tells; its children with their callers."""
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = node.name if caller == MODULE else f"{caller}.{node.name}"
            return [(d, caller) for d in node.decorator_list] + [(child, inner) for child in node.body]
        scope = "" if caller == MODULE else caller
        if isinstance(node, ast.Call):
            self._call(node, caller, seen)
        elif isinstance(node, ast.AnnAssign):
            if not (caller == MODULE and is_top):  # those were taken with the declarations
                self._annotated(node, scope)
            self._assigned(node.target, node.value, scope)
        elif isinstance(node, ast.Assign):
            self._assigned(node.targets[-1], node.value, scope)
        return [(child, caller) for child in self._children(node)]

    @staticmethod
    def _children(node: ast.AST) -> list[ast.AST]:
        """Children in the order of the source."""
        if isinstance(node, ast.IfExp):
            return [node.body, node.test, node.orelse]
        if isinstance(node, ast.Dict):
            return [x for pair in zip(node.keys, node.values) for x in pair if x is not None]
        return list(ast.iter_child_nodes(node))

    def _call(self, node: ast.Call, caller: str, seen: set) -> None:
        if isinstance(node.func, ast.Attribute):
            name, owner = node.func.attr, self.raw(node.func.value)
        else:
            name, owner = self.raw(node.func), ""
        if name and (caller, owner, name) not in seen:
            seen.add((caller, owner, name))
            self.out["calls"].append({"caller_fqn": caller, "callee_name": name, "callee_owner": owner, "line": node.lineno})

    def _annotated(self, node: ast.AnnAssign, scope: str) -> None:
        kind = self._type(node.annotation)
        if kind and isinstance(node.target, ast.Name):
            self.out["var_types"].append({"scope_fqn": scope, "var_name": node.target.id, "type_name": kind})

    def _assigned(self, target, value, scope: str) -> None:
        if isinstance(target, ast.Name) and isinstance(value, ast.Call):
            kind = self.raw(value.func)
            if kind in self.known:
                self.out["var_types"].append({"scope_fqn": scope, "var_name": target.id, "type_name": kind})

    def _type(self, node: ast.expr) -> str:
        """The root name of an annotation: List for List[Foo], pkg.Foo for pkg.Foo, else nothing."""
        if isinstance(node, ast.Subscript):
            return self._type(node.value)
        return self.raw(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


def parse_python(source: bytes) -> dict | None:
    """Symbols of a file, or nothing if it can't be parsed."""
    try:
        return PythonFile(source).parse()
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last is what very deep expressions raise
        return None
