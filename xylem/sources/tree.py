"""A document in memory: its nodes in columns, changed and written without leaving the worker."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from ..errors import NamespaceError
from ..schema import XML_NS

TEXTUAL = ("text", "cdata", "entity_reference")
_UNCOUNTED = ("attribute", "namespace", "declaration", "doctype", "document")


class Tree:
    """Nodes in document order, a list for each of NODE_COLUMNS but ``pre``: a node is its place in them."""

    __slots__ = ("cache", "counts", "kinds", "levels", "names", "open", "ords", "parents", "prefixes", "scopes", "sizes", "texts", "uris", "values")

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.levels: list[int] = []
        self.parents: list[int | None] = []
        self.kinds: list[str] = []
        self.prefixes: list[str] = []
        self.names: list[str | None] = []
        self.uris: list[str | None] = []
        self.values: list[str | None] = []
        self.ords: list[int | None] = []
        self.open: list[int] = []
        self.counts: list[int] = []
        self.scopes: list[dict[str, str]] = [{"": "", "xml": XML_NS}]
        self.texts: list[list[str] | None] = []
        self.cache: dict = {}
        self.add("document")
        self._enter()

    def columns(self) -> tuple:
        """In the order of NODE_COLUMNS."""
        return range(len(self.kinds)), self.sizes, self.levels, self.parents, self.kinds, self.prefixes, self.names, self.uris, self.values, self.ords

    def row(self, i: int) -> tuple:
        return i, self.sizes[i], self.levels[i], self.parents[i], self.kinds[i], self.prefixes[i], self.names[i], self.uris[i], self.values[i], self.ords[i]

    def rows(self) -> list[list]:
        return [list(r) for r in zip(*self.columns(), strict=True)]

    # --- as a scanner fills it

    def add(self, kind: str, name: str | None = None, value: str | None = None, prefix: str = "", uri: str | None = None, counted: bool = True) -> int:
        pre = len(self.kinds)
        counted = counted and bool(self.open)
        if counted:
            self.counts[-1] += 1
        self.sizes.append(0)
        self.levels.append(len(self.open))
        self.parents.append(self.open[-1] if self.open else None)
        self.kinds.append(kind)
        self.prefixes.append(prefix)
        self.names.append(name)
        self.uris.append(uri)
        self.values.append(value)
        self.ords.append(self.counts[-1] if counted else None)
        return pre

    def _enter(self) -> None:
        self.open.append(len(self.kinds) - 1)
        self.counts.append(0)
        self.texts.append([])

    def start(self, name: str, flat: list[str], namespaces: bool = True) -> None:
        """An element; flat: names and values of its attributes in turn."""
        open_, pre, level = self.open, len(self.kinds), len(self.open)
        if level > 1:
            self.texts[-1] = None
        names = flat[::2]
        scope = self.scopes[-1]
        if namespaces and (":" in name or names and (":" in "".join(names) or "xmlns" in names)):
            self._start_qualified(name, flat, scope)
            return
        self.counts[-1] += 1
        n = len(names)
        # the element's row and those of its attributes
        self.sizes += [0] * (n + 1)
        self.levels.append(level)
        self.parents.append(open_[-1])
        self.kinds.append("element")
        self.prefixes += [""] * (n + 1)
        self.names.append(name)
        self.uris.append(scope[""] if namespaces else "")
        self.values.append(None)
        self.ords.append(self.counts[-1])
        if n:
            self.levels += [level + 1] * n
            self.parents += [pre] * n
            self.kinds += ["attribute"] * n
            self.names += names
            self.uris += [""] * n
            self.values += flat[1::2]
            self.ords += [None] * n
        open_.append(pre)
        self.counts.append(0)
        self.texts.append([])
        self.scopes.append(scope)

    def _start_qualified(self, name: str, flat: list[str], scope: dict[str, str]) -> None:
        attributes = list(zip(flat[::2], flat[1::2], strict=True))
        declared = [(k[6:], v) for k, v in attributes if k == "xmlns" or k.startswith("xmlns:")]
        if declared:
            scope = {**scope, **dict(declared)}

        def split(q: str, default: str) -> tuple[str, str, str]:
            p, colon, local = q.partition(":")
            if not colon:
                return "", q, default
            if p not in scope:
                raise NamespaceError("an undeclared prefix", prefix=p)
            return p, local, scope[p]

        prefix, local, uri = split(name, scope.get("", ""))
        self.add("element", local, None, prefix, uri)
        self._enter()
        self.scopes.append(scope)
        for p, u in declared:
            self.add("namespace", p, u, "", "", counted=False)
        for k, v in attributes:
            if k != "xmlns" and not k.startswith("xmlns:"):
                p, n, u = split(k, "")
                self.add("attribute", n, v, p, u, counted=False)

    def end(self) -> None:
        pre = self.open.pop()
        self.sizes[pre] = len(self.kinds) - pre - 1
        self.counts.pop()
        self.scopes.pop()
        t = self.texts.pop()
        self.values[pre] = None if t is None else "".join(t)

    def text(self, kind: str, value: str, name: str | None = None) -> None:
        """A text, cdata or entity_reference node; texts that follow one another become one."""
        if kind == "text" and self.kinds[-1] == "text" and self.parents[-1] == self.open[-1]:
            self.values[-1] += value  # type: ignore[operator]
        else:
            self.add(kind, name, value)
        t = self.texts[-1]
        if t is not None:
            t.append(value)

    def finish(self) -> Tree:
        while len(self.open) > 1:
            self.end()
        self.sizes[0] = len(self.kinds) - 1
        return self

    # --- as it is read

    def string(self, i: int) -> str:
        """The node's string value."""
        v = self.values[i]
        if v is not None:
            return v
        kinds, values = self.kinds, self.values
        return "".join(values[j] or "" for j in range(i + 1, i + self.sizes[i] + 1) if kinds[j] in TEXTUAL)

    def attribute(self, i: int, name: str) -> str | None:
        """The value of the node's attribute of this name in no namespace."""
        kinds, names = self.kinds, self.names
        for j in range(i + 1, i + self.sizes[i] + 1):
            kind = kinds[j]
            if kind == "attribute":
                if names[j] == name and not self.uris[j]:
                    return self.values[j] or ""
            elif kind != "namespace":
                break
        return None

    def qualified(self, i: int) -> str:
        p, n = self.prefixes[i], self.names[i] or ""
        return f"{p}:{n}" if p else n

    def attribute_maps(self) -> Iterator[tuple[int, list[tuple[str, str | None]]]]:
        """(element, its attributes by qualified name)"""
        kinds, values, n, i = self.kinds, self.values, len(self.kinds), 0
        while i < n:
            if kinds[i] != "element":
                i += 1
                continue
            held, e = [], i
            i += 1
            while i < n and kinds[i] in ("attribute", "namespace"):
                if kinds[i] == "attribute":
                    held.append((self.qualified(i), values[i]))
                i += 1
            yield e, held


# --- changes: each gives a new tree


def _columns_of(t: Tree, s: Tree, low: int, high: int, deeper: int) -> None:
    """Rows low to before high of s put at the end of t, so much deeper."""
    t.levels += [x + deeper for x in s.levels[low:high]] if deeper else s.levels[low:high]
    t.kinds += s.kinds[low:high]
    t.prefixes += s.prefixes[low:high]
    t.names += s.names[low:high]
    t.uris += s.uris[low:high]
    t.values += s.values[low:high]


def _built(pieces: Iterable[tuple[Tree, int, int, int]]) -> Tree:
    """A tree of pieces of trees (see _columns_of) in document order, the document's row first. Numbers are given and texts of elements gathered anew."""
    t = Tree()
    for column in (t.levels, t.kinds, t.prefixes, t.names, t.uris, t.values):
        column.clear()
    for p in pieces:
        _columns_of(t, *p)
    return _number(t)


def numbered(levels: list[int], kinds: list[str], prefixes: list[str], names: list[str | None], uris: list[str | None], values: list[str | None]) -> Tree:
    """A tree of the columns of a document's rows in document order."""
    t = Tree()
    t.levels, t.kinds, t.prefixes, t.names, t.uris, t.values = ([*c] for c in (levels, kinds, prefixes, names, uris, values))
    return _number(t)


def _number(t: Tree) -> Tree:
    """With sizes, parents, places and texts of elements as levels and kinds have it."""
    kinds, levels, values, n = t.kinds, t.levels, t.values, len(t.kinds)
    t.sizes, t.parents, t.ords = sizes, parents, ords = [0] * n, [None] * n, [None] * n
    open_: list[int] = []
    counts: list[int] = []
    texts: list[list[str] | None] = []

    def close(at: int) -> None:
        pre, held = open_.pop(), texts.pop()
        counts.pop()
        sizes[pre] = at - pre - 1
        if kinds[pre] == "element":
            values[pre] = None if held is None else "".join(held)

    for j, kind in enumerate(kinds):
        if kind == "attribute":  # it stands right after its element
            parents[j] = open_[-1] if open_ else None
            continue
        while len(open_) > levels[j]:
            close(j)
        if open_:
            parents[j] = open_[-1]
            if kind not in _UNCOUNTED:
                counts[-1] += 1
                ords[j] = counts[-1]
            if kind == "element":
                texts[-1] = None
            elif kind in TEXTUAL and texts[-1] is not None:
                texts[-1].append(values[j] or "")
        if kind in ("element", "document"):
            open_.append(j)
            counts.append(0)
            texts.append([])
    while open_:
        close(n)
    return t


def _outermost(t: Tree, targets: list[int]) -> Iterator[int]:
    """Of targets in document order those that aren't in another one."""
    until = -1
    for i in targets:
        if i > until:
            until = i + t.sizes[i]
            yield i


def replaced(t: Tree, targets: list[int], new: Tree | None) -> Tree:
    """``new`` in place of each target and all below it; a target in another one goes with it. None: nothing in its place."""

    def pieces() -> Iterator[tuple[Tree, int, int, int]]:
        at = 0
        for i in _outermost(t, [x for x in targets if x]):  # the document itself stays
            yield t, at, i, 0
            if new is not None:
                yield new, 1, len(new.kinds), t.levels[i] - 1
            at = i + t.sizes[i] + 1
        yield t, at, len(t.kinds), 0

    return _built(pieces())


def inserted(t: Tree, targets: list[int], new: Tree, where: str) -> Tree:
    """With ``new`` at each target: first or last inside, before, after. Where several end at one place the deepest comes first."""
    after: dict[int, list[int]] = {}
    for i in targets:
        at = i + t.sizes[i]
        if where == "before":
            at = i - 1
        elif where == "first":
            at = i
            while at < i + t.sizes[i] and t.kinds[at + 1] in ("attribute", "namespace"):
                at += 1
        after.setdefault(at, []).append(i)
    inside = where in ("first", "last")

    def pieces() -> Iterator[tuple[Tree, int, int, int]]:
        low = 0
        for at in sorted(after):
            yield t, low, at + 1, 0
            for i in sorted(after[at], reverse=True):
                yield new, 1, len(new.kinds), t.levels[i] - (not inside)
            low = at + 1
        yield t, low, len(t.kinds), 0

    return _built(pieces())


def with_attribute(t: Tree, targets: list[int], name: str, value: str) -> Tree:
    """With the attribute on each target element: changed where it stands, else before the others."""
    put, values = [], list(t.values)
    for i in targets:
        if t.kinds[i] != "element":
            continue
        held = next((j for j in _beside(t, i) if t.kinds[j] == "attribute" and t.names[j] == name and not t.prefixes[j]), None)
        if held is None:
            put.append(i)
        else:
            values[held] = value
    new = Tree()
    new.add("attribute", name, value, "", "", counted=False)

    def pieces() -> Iterator[tuple[Tree, int, int, int]]:
        low = 0
        for i in put:
            yield t, low, i + 1, 0
            yield new, 1, 2, t.levels[i]
            low = i + 1
        yield t, low, len(t.kinds), 0

    before, t.values = t.values, values
    made = _built(pieces())
    t.values = before
    return made


def _beside(t: Tree, i: int) -> Iterator[int]:
    """The attributes and namespaces of an element."""
    for j in range(i + 1, i + t.sizes[i] + 1):
        if t.kinds[j] not in ("attribute", "namespace"):
            return
        yield j


# --- markup


def _text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if "&" in s or "<" in s or ">" in s else s


def _quoted(s: str) -> str:
    return _text(s).replace('"', "&quot;")


def markup(t: Tree, declaration: bool | None = None, expand_empty: bool = True) -> str:
    """The document as the serializer of node tables writes it."""
    out: list[str] = []
    ends: list[tuple[int, str]] = []
    kinds, values, names, n, i = t.kinds, t.values, t.names, len(t.kinds), 1
    while i < n:
        while ends and ends[-1][0] < i:
            out.append(ends.pop()[1])
        kind, value = kinds[i], values[i] or ""
        if kind == "element":
            q, e = t.qualified(i), i
            out.append("<" + q)
            while i + 1 < n and kinds[i + 1] in ("attribute", "namespace"):
                i += 1
                name = t.qualified(i) if kinds[i] == "attribute" else "xmlns:" + names[i] if names[i] else "xmlns"  # type: ignore[operator]
                out.append(f' {name}="{_quoted(values[i] or "")}"')
            if i == e + t.sizes[e]:
                out.append(f"></{q}>" if expand_empty else "/>")
            else:
                out.append(">")
                ends.append((e + t.sizes[e], f"</{q}>"))
        elif kind == "text":
            out.append(_text(value))
        elif kind == "cdata":
            out.append("<![CDATA[" + value.replace("]]>", "]]]]><![CDATA[>") + "]]>")
        elif kind == "comment":
            out.append(f"<!--{value}-->")
        elif kind == "processing_instruction":
            out.append(f"<?{names[i]} {value}?>" if value else f"<?{names[i]}?>")
        elif kind == "entity_reference":
            out.append(f"&{names[i]};")
        elif kind == "doctype":
            out.append(f"<!DOCTYPE {names[i]} {value}>" if value else f"<!DOCTYPE {names[i]}>")
        elif kind == "declaration" and declaration is None:
            out.append(f"<?xml {value}?>")
        i += 1
    out += [s for _, s in reversed(ends)]
    return "".join(out)
