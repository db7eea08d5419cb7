"""A small DOM and CSS-selector subset for archived result pages (used inside mapInPandas).

Supported selectors: type, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``,
``[attr*=v]``, descendant (space), child (``>``), adjacent sibling (``+``),
``:has(> sel)`` and comma lists.  That is what the rule sets use.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "index")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.index = 0

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append("\n")
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def descendants(self):
        stack = list(reversed(self.elements()))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.elements()))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    for i, n in enumerate(b.root.descendants()):
        n.index = i
    return b.root


_ATTR = re.compile(r"""\[\s*([\w-]+)\s*(?:([*]?=)\s*(?:'([^']*)'|"([^"]*)"|([^\]\s]*)))?\s*\]""")
_TOKEN = re.compile(r"""([#.][\w-]+|\[[^\]]*\]|:has\(\s*>\s*[^)]*\)|\*|[\w-]+)""")


def _compound(s: str):
    """-> (tag or None, [predicate])"""
    tag, preds = None, []
    for tok in _TOKEN.findall(s):
        if tok == "*":
            continue
        if tok[0] == ".":
            cls = tok[1:]
            preds.append(lambda n, c=cls: c in n.attrs.get("class", "").split())
        elif tok[0] == "#":
            preds.append(lambda n, i=tok[1:]: n.attrs.get("id") == i)
        elif tok[0] == "[":
            m = _ATTR.match(tok)
            name, op = m.group(1), m.group(2)
            val = next((g for g in m.groups()[2:] if g is not None), None)
            if op is None:
                preds.append(lambda n, a=name: a in n.attrs)
            elif op == "=":
                preds.append(lambda n, a=name, v=val: n.attrs.get(a) == v)
            else:
                preds.append(lambda n, a=name, v=val: a in n.attrs and v in n.attrs[a])
        elif tok.startswith(":has"):
            inner = compile_selector(tok[tok.index(">") + 1:-1].strip())
            preds.append(lambda n, sel=inner: any(sel(c) for c in n.elements()))
        else:
            tag = tok.lower()
    return tag, preds


def compile_selector(sel: str):
    """-> predicate(node) for one complex selector or a comma list."""
    if "," in sel and ":has(" not in sel:
        alts = [compile_selector(p.strip()) for p in sel.split(",")]
        return lambda n: any(a(n) for a in alts)
    # ':has(> x)' holds '>' and spaces: swap it for a placeholder before splitting
    inners: list[str] = []

    def hide(m):
        inners.append(m.group(1).strip())
        return f":has{len(inners) - 1}"
    flat = re.sub(r":has\(\s*>\s*([^)]*)\)", hide, sel)
    parts = re.findall(r"[>+]|[^\s>+]+", flat)
    parts = [re.sub(r":has(\d+)", lambda m: f":has(> {inners[int(m.group(1))]})", p) for p in parts]
    seq, comb = [], []
    pending = " "
    for p in parts:
        if p in (">", "+"):
            pending = p
            continue
        comb.append(pending)
        seq.append(p)
        pending = " "
    comps = [_compound(s) for s in seq]

    def match_at(n, i):
        tag, preds = comps[i]
        if tag and n.tag != tag:
            return False
        if not all(p(n) for p in preds):
            return False
        if i == 0:
            return True
        c = comb[i]
        if c == ">":
            return n.parent is not None and n.parent.tag != "#root" and match_at(n.parent, i - 1)
        if c == "+":
            sibs = n.parent.elements() if n.parent is not None else []
            k = sibs.index(n)
            return k > 0 and match_at(sibs[k - 1], i - 1)
        a = n.parent
        while a is not None and a.tag != "#root":
            if match_at(a, i - 1):
                return True
            a = a.parent
        return False

    return lambda n: match_at(n, len(comps) - 1)


_CACHE: dict[str, object] = {}


def select(scope: Node, sel: str) -> list[Node]:
    fn = _CACHE.get(sel)
    if fn is None:
        fn = _CACHE[sel] = compile_selector(sel)
    return [n for n in scope.descendants() if fn(n)]


def select_one(scope: Node, sel: str):
    fn = _CACHE.get(sel)
    if fn is None:
        fn = _CACHE[sel] = compile_selector(sel)
    for n in scope.descendants():
        if fn(n):
            return n
    return None
