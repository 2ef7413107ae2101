"""Java files to symbols, by a lexer and a scanner for declarations and calls.

The scanner knows packages, imports, classes, interfaces, enums, their members, local variables, calls and object
creations. Types of expressions don't matter here, so expressions are scanned for calls rather than parsed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from .parse_python import clip

INIT = "<init>"
#: Where grammars may differ: members of enums are taken, as are the interfaces that an interface extends.
ENUM_MEMBERS = True
INTERFACE_EXTENDS = True

_TOKEN = re.compile(
    r'(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<str>"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\')'
    r"|(?P<num>\.?\d(?:[\w.]|(?<=[eEpP])[+-])*)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|@|[{}()\[\];,.<>?&|=:+\-*/%!^~])",
    re.S,
)
_MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
_PRIMITIVES = set("byte short int long float double boolean char void".split())
_STATEMENTS = set(
    "if else for while do switch case return throw try catch finally break continue assert new instanceof yield synchronized default".split()
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class JavaError(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    doc: tuple[int, int] | None  # the comment right before it


class JavaFile:
    def __init__(self, source: bytes):
        self.text = source.decode("utf-8-sig")
        self.newlines = [m.start() for m in re.finditer("\n", self.text)]
        self.out: dict = {"package": "", "imports": [], "objects": [], "methods": [], "calls": [], "var_types": []}
        self.tokens = self._lex()
        self.match = self._brackets()

    def line(self, at: int) -> int:
        return bisect_right(self.newlines, at - 1) + 1

    def _lex(self) -> list[Token]:
        out, at, doc = [], 0, None
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise JavaError(f"no token at {at}")
            at = m.end()
            if m.lastgroup == "block":
                doc = (m.start(), m.end())
            elif m.lastgroup == "line":
                doc = None
            elif m.lastgroup != "space":
                out.append(Token(m.lastgroup, m[0], m.start(), m.end(), doc))
                doc = None
        return out

    def _brackets(self) -> dict[int, int]:
        match, stack = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]].text] != t.text:
                    raise JavaError("brackets don't match")
                match[stack.pop()] = i
        if stack:
            raise JavaError("brackets don't match")
        return match

    # -- small helpers on token positions

    def t(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) else ""

    def is_id(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "id"

    def raw(self, a: int, b: int) -> str:
        """Source from token a up to, not including, token b."""
        return self.text[self.tokens[a].start : self.tokens[b - 1].end] if b > a else ""

    def dotted(self, i: int) -> tuple[str, int]:
        parts = [self.t(i)]
        i += 1
        while self.t(i) == "." and self.is_id(i + 1):
            parts.append(self.t(i + 1))
            i += 2
        return ".".join(parts), i

    def skip_angles(self, i: int) -> int:
        """Behind the type arguments that open at i, or -1 if they are none."""
        depth = 0
        while i < len(self.tokens):
            x = self.t(i)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif x == "@":
                i = self.annotation(i)
                continue
            elif not (self.is_id(i) or x in (",", ".", "?", "&", "[", "]")):
                return -1
            i += 1
        return -1

    def annotation(self, i: int) -> int:
        _, i = self.dotted(i + 1)
        return self.match[i] + 1 if self.t(i) == "(" else i

    def modifiers(self, i: int) -> int:
        while True:
            if self.t(i) == "@" and self.t(i + 1) != "interface":
                i = self.annotation(i)
            elif self.t(i) in _MODIFIERS and not (self.t(i) == "default" and self.t(i + 1) in (":", "->")):
                i += 1
                if self.t(i) == "-" and self.t(i + 1) == "sealed":
                    i += 2
            else:
                return i

    def type_at(self, i: int) -> tuple[str, int]:
        """(root name without arguments and brackets, position behind the type), or ("", -1)."""
        while self.t(i) == "@":
            i = self.annotation(i)
        if not self.is_id(i) or self.t(i) in _STATEMENTS:
            return "", -1
        parts = []
        while True:
            parts.append(self.t(i))
            i += 1
            if self.t(i) == "<":
                i = self.skip_angles(i)
                if i < 0:
                    return "", -1
            if self.t(i) == "." and self.is_id(i + 1):
                i += 1
                continue
            break
        while self.t(i) == "@" or (self.t(i) == "[" and self.t(i + 1) == "]"):
            i = i + 2 if self.t(i) == "[" else self.annotation(i)
        return ".".join(parts), i

    def doc_of(self, i: int) -> str:
        span = self.tokens[i].doc
        text = self.text[span[0] : span[1]] if span else ""
        if not text.startswith("/**"):
            return ""
        for line in text[3:].removesuffix("*/").split("\n"):
            if s := line.strip().removeprefix("*").strip():
                return clip(s)
        return ""

    # -- declarations

    def parse(self) -> dict:
        i, end = 0, len(self.tokens)
        while i < end:
            x = self.t(i)
            if x == ";":
                i += 1
                continue
            start = i
            i = self.modifiers(i)
            x = self.t(i)
            if x == "package":
                self.out["package"], i = self.dotted(i + 1)
            elif x == "import":
                i = self._import(i + 1)
            else:
                i = self._type_declaration(start, i, "")
                continue
            if self.t(i) != ";":
                raise JavaError("; expected")
            i += 1
        return self.out

    def _import(self, i: int) -> int:
        if self.t(i) == "static":
            i += 1
        raw, i = self.dotted(i)
        if self.t(i) == "." and self.t(i + 1) == "*":
            i += 2
        self.out["imports"].append({"raw": raw, "alias": raw.rpartition(".")[2]})
        return i

    def _kind(self, i: int) -> str:
        x = self.t(i)
        if x in ("class", "interface", "enum"):
            return x
        if x == "@" and self.t(i + 1) == "interface":
            return "annotation"
        return "record" if x == "record" and self.is_id(i + 1) and self.t(i + 2) in ("(", "<") else ""

    def _type_declaration(self, start: int, i: int, parent: str) -> int:
        """A declaration of a type whose modifiers start at `start`; the position behind it."""
        kind = self._kind(i)
        if not kind:
            raise JavaError(f"declaration expected, found {self.t(i)!r}")
        i += 2 if kind == "annotation" else 1
        name, i = self.t(i), i + 1
        if self.t(i) == "<":
            i = self.skip_angles(i)
        if self.t(i) == "(":
            i = self.match[i] + 1
        bases = []
        while self.t(i) in ("extends", "implements", "permits"):
            word = self.t(i)
            while word == self.t(i) or self.t(i) == ",":
                base, i = self.type_at(i + 1)
                if i < 0:
                    raise JavaError("type expected")
                if word != "permits" and (kind != "interface" or INTERFACE_EXTENDS):
                    bases.append({"name": base, "relation": word})
        if self.t(i) != "{":
            raise JavaError("{ expected")
        close = self.match[i]
        if kind in ("record", "annotation"):
            return close + 1
        fqn = ".".join(x for x in (parent or self.out["package"], name) if x)
        self.out["objects"].append({
            "name": name, "fqn": fqn, "subkind": kind, "bases": bases, "doc": self.doc_of(start),
            "start_line": self.line(self.tokens[start].start), "end_line": self.line(self.tokens[close].start),
        })
        self._body(i, close, fqn, kind)
        return close + 1

    def _body(self, open_: int, close: int, fqn: str, kind: str) -> None:
        i = open_ + 1
        if kind == "enum":
            while i < close and self.t(i) != ";":  # constants with their arguments and bodies
                i = self.match[i] + 1 if i in self.match else i + 1
            if not ENUM_MEMBERS:
                return
        members, fields, inits = [], [], []
        while i < close:
            if self.t(i) == ";":
                i += 1
                continue
            start = i
            i = self.modifiers(i)
            if self.t(i) == "{":
                inits.append((i + 1, self.match[i]))
                i = self.match[i] + 1
            elif self._kind(i):
                end = self._skip_type(i)
                members.append(("type", start, i))
                i = end
            else:
                i = self._member(start, i, close, members, fields, inits)
        for kind_, name in fields:
            self.out["var_types"].append({"scope_fqn": fqn, "var_name": name, "type_name": kind_})
        for m in members:
            if m[0] == "type":
                self._type_declaration(m[1], m[2], fqn)
            else:
                self._method(fqn, *m[1:])
        seen: set = set()
        before = len(self.out["calls"])
        for a, b in sorted(inits):
            self._calls(a, b, f"{fqn}.{INIT}", seen)
        if len(self.out["calls"]) > before:
            self.out["methods"].append({
                "name": INIT, "fqn": f"{fqn}.{INIT}", "owner_fqn": fqn, "subkind": "init", "scope": "member", "signature": "", "doc": "",
                "start_line": self.line(self.tokens[open_].start), "end_line": self.line(self.tokens[close].start),
            })

    def _skip_type(self, i: int) -> int:
        while self.t(i) != "{":
            i = self.match[i] + 1 if self.t(i) == "(" else i + 1
            if i >= len(self.tokens):
                raise JavaError("{ expected")
        return self.match[i] + 1

    def _member(self, start: int, i: int, close: int, members: list, fields: list, inits: list) -> int:
        """A method, constructor or field; the position behind it."""
        if self.t(i) == "<":
            i = self.skip_angles(i)
            i = self.modifiers(i)
        if self.is_id(i) and self.t(i + 1) == "(":  # a constructor
            ret, name = None, i
        elif self.is_id(i) and self.t(i + 1) == "{":  # a compact constructor
            return self.match[i + 1] + 1
        else:
            kind, after = self.type_at(i)
            if after < 0 or not self.is_id(after):
                raise JavaError(f"member expected at {self.t(i)!r}")
            ret, name = (i, after), after
            if self.t(name + 1) != "(":
                return self._fields(kind, name, close, fields, inits)
        params = name + 1
        i = self.match[params] + 1
        while self.t(i) not in ("{", ";"):
            if self.t(i) == "default":  # the value of an annotation's element
                while self.t(i) != ";":
                    i = self.match[i] + 1 if i in self.match else i + 1
                break
            i += 1
            if i >= close:
                raise JavaError("body expected")
        body = (i + 1, self.match[i]) if self.t(i) == "{" else None
        end = self.match[i] if body else i
        members.append(("method", start, ret, name, params, body, end))
        return end + 1

    def _fields(self, kind: str, i: int, close: int, fields: list, inits: list) -> int:
        while True:
            fields.append((kind, self.t(i)))
            i += 1
            while self.t(i) == "[":
                i = self.match[i] + 1
            if self.t(i) == "=":
                a = i + 1
                i = self._expression_end(a, close)
                inits.append((a, i))
            if self.t(i) == ",":
                i += 1
                continue
            if self.t(i) != ";":
                raise JavaError("; expected")
            return i + 1

    def _expression_end(self, i: int, close: int) -> int:
        """The comma or semicolon that ends an initializer; commas between type arguments don't."""
        while i < close and self.t(i) not in (",", ";"):
            if i in self.match:
                i = self.match[i] + 1
            elif self.t(i) == "<" and (j := self.skip_angles(i)) > 0 and self.t(j) in ("(", "::", ".", "[", ")") or self.t(i) == "<" and j > 0 and self.is_id(j):
                i = j
            else:
                i += 1
        return i

    def _method(self, owner: str, start: int, ret, name: int, params: int, body, end: int) -> None:
        fqn = f"{owner}.{self.t(name)}"
        lead = self.raw(*ret) + " " if ret else ""
        self.out["methods"].append({
            "name": self.t(name), "fqn": fqn, "owner_fqn": owner, "subkind": "method" if ret else "ctor", "scope": "member",
            "signature": lead + self.t(name) + self.raw(params, self.match[params] + 1), "doc": self.doc_of(start),
            "start_line": self.line(self.tokens[start].start), "end_line": self.line(self.tokens[end].start),
        })
        i = params + 1
        while i < self.match[params]:
            i = self.modifiers(i)
            kind, after = self.type_at(i)
            if after < 0:
                break
            if self.is_id(after):
                self.out["var_types"].append({"scope_fqn": fqn, "var_name": self.t(after), "type_name": kind})
            while i < self.match[params] and self.t(i) != ",":
                i = self.match[i] + 1 if i in self.match else (self.skip_angles(i) if self.t(i) == "<" else i + 1)
            i += 1
        if body:
            self._calls(*body, fqn, set())

    # -- calls and local variables

    def _calls(self, a: int, b: int, caller: str, seen: set) -> None:
        """Calls and variables between two positions, in the order in which a tree walk meets them."""
        found: list[tuple] = []
        i = a
        while i < b:
            x = self.t(i)
            if x == "new" and self.tokens[i].kind == "id":
                kind, after = self.type_at(i + 1)
                if after > 0 and self.t(after) == "(" and kind not in _PRIMITIVES:
                    owner, _, name = kind.rpartition(".")
                    found.append((self.tokens[i].start, -self.match[after], name, owner, self.line(self.tokens[i].start)))
                i = max(after, i + 1)
                continue
            if self.is_id(i) and self.t(i + 1) == "(" and x not in _STATEMENTS and x not in ("this", "super") and not self._declares(i):
                first, owner = self._receiver(i)
                found.append((self.tokens[first].start, -self.match[i + 1], x, owner, self.line(self.tokens[first].start)))
            elif self.is_id(i) and self._starts_statement(i, a):
                i = self._local(i, b, caller)
                continue
            i += 1
        # an outer call starts no later than its receiver and ends behind it
        for _, _, name, owner, line in sorted(found):
            if (caller, owner, name) not in seen:
                seen.add((caller, owner, name))
                self.out["calls"].append({"caller_fqn": caller, "callee_name": name, "callee_owner": owner, "line": line})

    def _declares(self, i: int) -> bool:
        """True for the name of a method that an anonymous class declares."""
        return self.t(self.match[i + 1] + 1) in ("{", "throws") and self.t(i - 1) != "."

    def _starts_statement(self, i: int, a: int) -> bool:
        before = self.t(i - 1) if i > a else ";"
        return before in (";", "{", "}", "(", ":", "->", "final", ")") and self.t(i) not in _STATEMENTS

    def _local(self, i: int, b: int, caller: str) -> int:
        """Takes `Type name` followed by =, ; , or : as a variable; the position to go on from."""
        start = i
        i = self.modifiers(i)
        kind, after = self.type_at(i)
        before = self.t(start - 1)
        ends = ("=", ";", ",", ":") if before != "(" else ("=", ":")
        if after < 0 or after >= b or not self.is_id(after) or self.t(after) in _STATEMENTS or self.t(after + 1) not in ends or (self.t(after + 1) == ":" and before != "("):
            return start + 1
        if self.t(after + 1) == ":":  # the variable of an enhanced for is no declaration statement
            return after + 1
        i = after
        while True:
            self.out["var_types"].append({"scope_fqn": caller, "var_name": self.t(i), "type_name": kind})
            j = i + 1
            if self.t(j) == "=":
                j = self._expression_end(j + 1, b)
            if self.t(j) == "," and self.is_id(j + 1) and self.t(j + 2) in ("=", ",", ";"):
                i = j + 1
                continue
            return after + 1

    def _angle(self, i: int) -> int:
        """The angle that the closing one at i belongs to."""
        depth = 0
        while i > 0:
            depth += {">": 1, "<": -1}.get(self.t(i), 0)
            if not depth:
                break
            i -= 1
        return i

    def _before_type_arguments(self, i: int) -> int:
        """Where explicit type arguments before the name at i begin, as in list.<T>of; i where there are none."""
        if self.t(i - 1) == ">" and self.t(self._angle(i - 1) - 1) == ".":
            return self._angle(i - 1)
        return i

    def _receiver(self, i: int) -> tuple[int, str]:
        """(first token, owner text) of a call whose name is at i."""
        j = self._before_type_arguments(i) - 1
        if self.t(j) != ".":
            return i, ""
        back = {b: a for a, b in self.match.items()} if not hasattr(self, "_back") else self._back
        self._back = back
        end, k, parts = j, j - 1, 0
        while True:
            if self.t(k) == "}":  # the body of an anonymous class, or the values of an array
                k = back[k] - 1
            if self.t(k) in (")", "]"):
                k = back[k]
                # an index stands behind another bracket; a bracket that stands behind one begins anew, as behind a cast or an if
                while self.t(k) == "[" and self.t(k - 1) in (")", "]"):
                    k = back[k - 1]
                if self.is_id(k - 1) and self.t(k - 1) not in _STATEMENTS:
                    k = self._before_type_arguments(k - 1)
                elif self.t(k - 1) == ">":
                    k = self._angle(k - 1)
                    if self.is_id(k - 1):
                        k -= 1
            parts += 1
            if self.t(k - 1) == "." and (self.is_id(k - 2) or self.t(k - 2) in (")", "]", "}") or self.tokens[k - 2].kind == "str"):
                k -= 2
                continue
            break
        if self.t(k - 1) == "new":
            k -= 1
        first = k
        # simple receivers
        if end - first == 1:
            x = self.t(first)
            return first, "" if x in ("this", "super") else x
        if self.t(first) == "new":
            kind, after = self.type_at(first + 1)
            if after > 0 and self.t(after) == "(":
                close = self.match[after]
                if end - 1 in (close, self.match.get(close + 1)):  # with or without a class body
                    return first, kind
        if self.is_id(end - 1) and self.t(end - 2) == ".":
            return first, self.t(end - 1)
        return first, self.raw(first, end)


def parse_java(source: bytes) -> dict | None:
    """Symbols of a file, or nothing if it can't be parsed."""
    try:
        return JavaFile(source).parse()
    except (JavaError, IndexError, KeyError, ValueError, RecursionError, MemoryError):
        return None
