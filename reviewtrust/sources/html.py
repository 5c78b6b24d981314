"""Stored pages as node arrays: the only Python row code, run in Arrow batches.

A page becomes one array of nodes in document order. A node knows the index of the last
node inside it, so "inside" is a comparison of numbers and everything after parsing is
Spark expressions on the array, without a shuffle.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need only Spark's own Python: the parser travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = T.ArrayType(
    T.StructType(
        [
            T.StructField("i", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
            T.StructField("text", T.StringType()),
            # Selectors that the node matches: number in the list, and how many matched before it on the page.
            T.StructField("marks", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("nth", T.IntegerType())]))),
            # The innermost noise element that the node is or lies in; -1: none.
            T.StructField("noise", T.IntegerType()),
        ]
    )
)
PAGE = T.StructType([T.StructField("nodes", NODES), T.StructField("objects", T.ArrayType(T.StringType()))])
_ARROW_NODES = pa.list_(
    pa.struct(
        [
            ("i", pa.int32()),
            ("last", pa.int32()),
            ("tag", pa.string()),
            ("attrs", pa.map_(pa.string(), pa.string())),
            ("text", pa.string()),
            ("marks", pa.list_(pa.struct([("k", pa.int32()), ("nth", pa.int32())]))),
            ("noise", pa.int32()),
        ]
    )
)
_ARROW_PAGE = pa.struct([("nodes", _ARROW_NODES), ("objects", pa.list_(pa.string()))])
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

#: Start tag to the open elements it ends where their end tags were left out, and the elements that search stops at.
_ENDS = {
    **dict.fromkeys(["li"], ({"li"}, {"ul", "ol", "menu"})),
    **dict.fromkeys(["dt", "dd"], ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(["td", "th"], ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(["tr"], ({"tr"}, {"table"})),
    **dict.fromkeys(["thead", "tbody", "tfoot"], ({"thead", "tbody", "tfoot"}, {"table"})),
    **dict.fromkeys(["option", "optgroup"], ({"option"}, {"select", "datalist"})),
}
#: A paragraph ends before these.
_BLOCKS = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)


_COMPOUND = re.compile(
    r"""(?P<tag>^[a-z][a-z0-9]*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)
    |\[(?P<name>[\w:-]+)(?:(?P<op>[*^!~]?)=(?P<quote>["']?)(?P<value>.*?)(?P=quote)(?P<any>\s+i)?)?\]""",
    re.VERBOSE,
)


def css(selector: str) -> tuple:
    """A CSS selector as (tag, tests, ancestor's (tag, tests) or None).

    Known are tag, #id, .class, [a], [a="v"], [a*="v"] and [a^="v"] (both in any case), [a~="v"], [a!="v"] (has the
    attribute with another value), and one ancestor before a space.
    """

    def compound(text: str) -> tuple:
        tag, tests, at = None, [], 0
        while at < len(text):
            m = _COMPOUND.match(text, at) if at else _COMPOUND.match(text)
            if not m:
                raise ValueError(f"unknown selector {selector!r}")
            at = m.end()
            if m["tag"]:
                tag = m["tag"]
            elif m["id"] or m["class"]:
                tests.append(("id", "eq", m["id"]) if m["id"] else ("class", "word", m["class"]))
            else:
                kind = {"*": "like", "^": "start", "!": "other", "~": "word", "": "same" if m["any"] else "eq", None: "has"}[m["op"]]
                tests.append((m["name"], kind, m["value"]))
        return tag, tuple(tests)

    parts = re.split(r"\s+(?![^\[]*\])", selector.strip())
    if not 1 <= len(parts) <= 2 or not parts[0]:
        raise ValueError(f"unknown selector {selector!r}")
    return (*compound(parts[-1]), compound(parts[0]) if len(parts) == 2 else None)


def of_fields(tag: str | None, name: str | None = None, op: str | None = None, value: str | None = None, in_attr: str | None = None, in_value: str | None = None) -> tuple:
    """The same form of a selector given as fields (see ``selector_list``)."""
    within = (None, ((in_attr, "word" if in_attr == "class" else "eq", in_value),)) if in_attr else None
    return tag, ((name, op, value),) if op else (), within


def _holds(tests: tuple, attrs: dict[str, str]) -> bool:
    for name, op, value in tests:
        had = attrs.get(name)
        if op == "absent":
            if had is not None:
                return False
        elif had is None:
            return False
        elif op == "eq":
            if had != value:
                return False
        elif op == "like":
            if value.lower() not in had.lower():
                return False
        elif op == "start":
            if not had.lower().startswith(value.lower()):
                return False
        elif op == "word":
            if value not in had.split(" "):
                return False
        elif op == "same":
            if had.lower() != value.lower():
                return False
        elif op == "other" and had == value:
            return False
    return True


class Matcher:
    """Which of a list of selectors an element matches, by its tag, attributes and open ancestors.

    Selectors are filed under one attribute they ask for, or else their tag, so that an element is held against few of them.
    """

    def __init__(self, selectors: list[tuple], noise: frozenset[int] = frozenset()):
        self.selectors, self.noise = selectors, noise
        self.by_tag: dict[str | None, list[int]] = {}
        self.by_attr: dict[str, list[int]] = {}
        for k, (tag, tests, _) in enumerate(selectors):
            asked = [name for name, op, _ in tests if op != "absent"]
            if asked:
                self.by_attr.setdefault(asked[0], []).append(k)
            else:
                self.by_tag.setdefault(tag, []).append(k)

    def matches(self, tag: str, attrs: dict[str, str], ancestors) -> list[int]:
        tried = [*self.by_tag.get(tag, ()), *self.by_tag.get(None, ())]
        for name in attrs:
            tried += self.by_attr.get(name, ())
        found = []
        for k in tried:
            wanted, tests, within = self.selectors[k]
            if (wanted is None or wanted == tag) and _holds(tests, attrs):
                if within is None or any((within[0] is None or within[0] == t) and _holds(within[1], a) for t, a in ancestors()):
                    found.append(k)
        return sorted(found)


class _Nodes(HTMLParser):
    def __init__(self, matcher: Matcher) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.matcher, self.seen = matcher, {}

    def _ancestors(self):
        return ((self.nodes[i]["tag"], self.nodes[i]["had"]) for i in self.open)

    def _add(self, tag: str, attrs: list, text: str | None) -> int:
        i, marks = len(self.nodes), []
        noise = self.nodes[self.open[-1]]["noise"] if self.open else -1
        unique = {k: v or "" for k, v in reversed(attrs)}
        if text is None:
            for k in self.matcher.matches(tag, unique, self._ancestors):
                nth = self.seen.get(k, 0)
                self.seen[k] = nth + 1
                marks.append({"k": k, "nth": nth})
                noise = i if k in self.matcher.noise else noise
        self.nodes.append({"i": i, "last": i, "tag": tag, "attrs": list(unique.items()), "text": text, "marks": marks, "noise": noise, "had": unique})
        return i

    def end(self, depth: int) -> None:
        """End the open elements from ``depth`` on: all nodes since are inside them."""
        for i in self.open[depth:]:
            self.nodes[i]["last"] = len(self.nodes) - 1
        del self.open[depth:]

    def _end_implied(self, tag: str) -> None:
        if tag in _BLOCKS and self.open and self.nodes[self.open[-1]]["tag"] == "p":
            self.end(len(self.open) - 1)
        ended, scope = _ENDS.get(tag, ((), ()))
        if ended:
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.nodes[self.open[depth]]["tag"]
                if name in ended:
                    return self.end(depth)
                if name in scope:
                    return None
        return None

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        i = self._add(tag, attrs, None)
        if tag not in _VOID:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs, None)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                self.end(depth)
                return

    def handle_data(self, data):
        if data.strip():
            inside = self.nodes[self.open[-1]]["tag"] if self.open else ""
            self._add("#data" if inside in ("script", "style") else "#text", [], data)


_NO_SELECTORS = Matcher([])


def _parse(html: str | None, matcher: Matcher = _NO_SELECTORS) -> list[dict]:
    parser = _Nodes(matcher)
    parser.feed(html or "")
    parser.close()
    parser.end(0)
    return parser.nodes


#: Characters of pages whose nodes are Python objects at a time: a batch may hold thousands of pages.
SLICE_CHARS = 1 << 18


def _in_slices(pages: pa.Array, read, kind: pa.DataType) -> pa.Array:
    """``read`` of every page, as one Arrow array put together from slices of the batch."""
    parts, rows, chars = [], [], 0
    for page in pages:
        html = page.as_py()
        rows.append(read(html))
        chars += len(html or "")
        if chars >= SLICE_CHARS:
            parts.append(pa.array(rows, type=kind))
            rows, chars = [], 0
    return pa.concat_arrays([*parts, pa.array(rows, type=kind)])


@F.arrow_udf(NODES)
def dom_nodes(html: pa.Array) -> pa.Array:
    """All elements and texts of a page, in document order."""
    return _in_slices(html, _parse, _ARROW_NODES)


def walk(value, keys: list[str] | None, wanted) -> Iterator[dict]:
    """The wanted objects of a JSON value, outer ones first, to any depth; ``keys`` limits which fields are followed."""
    waiting = [value]
    while waiting:
        value = waiting.pop()
        if isinstance(value, list):
            waiting.extend(reversed(value))
        elif isinstance(value, dict):
            if wanted(value):
                yield value
            waiting.extend(value[k] for k in reversed(list(value) if keys is None else keys) if k in value)


def _wanted(types: str | None, fields: list[str]):
    """Objects whose @type, alone or in a list, matches a pattern, and that have one of ``fields`` at least."""
    shape = re.compile(types) if types else None

    def test(value: dict) -> bool:
        kinds = value.get("@type")
        kinds = kinds if isinstance(kinds, list) else [kinds]
        return (shape is None or any(isinstance(k, str) and shape.search(k) for k in kinds)) and (not fields or any(f in value for f in fields))

    return test


def _found(blocks: list[str], keys: list[str] | None, wanted) -> list[str]:
    """JSON text of the wanted objects; a malformed block has none."""
    found: list[str] = []
    for block in blocks:
        try:
            found += [json.dumps(o) for o in walk(json.loads(block), keys, wanted)]
        except (ValueError, RecursionError):
            continue
    return found


def json_objects(keys: list[str] | None, types: str | None = None, fields: list[str] | None = None):
    """A column function: JSON blocks to the objects reached in them, as JSON text (see ``walk`` and ``_wanted``)."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def objects(blocks: pa.Array) -> pa.Array:
        wanted = _wanted(types, fields or [])
        return pa.array([_found(page.as_py() or [], keys, wanted) for page in blocks], type=pa.list_(pa.string()))

    return objects


def parsed_pages(selectors: list[tuple], noise: list[int], script: tuple[str, str], keys: list[str] | None, types: str | None = None, fields: list[str] | None = None):
    """A column function: a page to its nodes, each with the selectors it matches, and the wanted JSON objects of its scripts.

    One parse of the page and one walk over its tags, whatever the number of selectors. ``script`` is an attribute of script elements
    and the pattern its value has where they hold JSON.
    """

    @F.arrow_udf(PAGE)
    def parse(html: pa.Array) -> pa.Array:
        matcher, wanted, shape = Matcher(selectors, frozenset(noise)), _wanted(types, fields or []), re.compile(script[1])

        def read(page: str | None) -> dict:
            nodes = _parse(page, matcher)
            blocks = [
                "".join(m["text"] or "" for m in nodes[n["i"] + 1 : n["last"] + 1])
                for n in nodes
                if n["tag"] == "script" and shape.search(n["had"].get(script[0], ""))
            ]
            return {"nodes": nodes, "objects": _found(blocks, keys, wanted)}

        return _in_slices(html, read, _ARROW_PAGE)

    return parse


LD_KEYS = ["@graph", "review", "reviews", "mainEntity", "itemListElement", "item"]
IDENTITY_KEYS = ["@graph", "mainEntity", "item"]
ld_products = json_objects(LD_KEYS, "(?i)^product$")
state_objects = json_objects(None, fields=["desc"])


# ---------------------------------------------------------------- expressions over node arrays


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that Spark computes once per row.

    Without this the optimizer may inline a costly array expression into every lambda that
    reads it. A generator over one element is a boundary it does not inline across.
    """
    one = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode_outer(one).alias("_once")).select(*kept, "_once.*")


def inside(nodes: Column, n: Column) -> Column:
    """The nodes below ``n``, none for null; ``nodes`` are all of the page, so they are a slice."""
    return F.when(n["i"].isNull(), F.slice(nodes, 1, 0)).otherwise(F.slice(nodes, n["i"] + 2, n["last"] - n["i"]))


def text_of(nodes: Column, n: Column) -> Column:
    texts = F.filter(
        nodes, lambda m: (m["tag"] == "#text") & (m["i"] > n["i"]) & (m["i"] <= n["last"])
    )
    joined = F.array_join(F.transform(texts, lambda m: m["text"]), " ")
    return F.trim(F.regexp_replace(joined, r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))


def attr(n: Column, name: str | Column) -> Column:
    return n["attrs"][name]


SELECTOR = "struct<tag:string,attr:string,op:string,value:string,in_attr:string,in_value:string>"


def selector_list(selectors: list[tuple]) -> Column:
    """Selectors as a literal array: (tag, attr, op, value[, ancestor attr, ancestor value]).

    ``op`` is has, absent, eq, like (contains, any case), start (begins, any case) or word
    (one of the space-separated words).
    """
    full = [tuple(s) + (None,) * (6 - len(s)) for s in selectors]
    names = ["tag", "attr", "op", "value", "in_attr", "in_value"]
    return F.array(
        *[
            F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(names, s)])
            for s in full
        ]
    ).cast(f"array<{SELECTOR}>")


def matches(nodes: Column, n: Column, s: Column) -> Column:
    value = n["attrs"][s["attr"]]
    test = (
        F.when(s["op"].isNull(), F.lit(True))
        .when(s["op"] == "has", value.isNotNull())
        .when(s["op"] == "absent", value.isNull())
        .when(s["op"] == "eq", value == s["value"])
        .when(s["op"] == "like", F.contains(F.lower(value), F.lower(s["value"])))
        .when(s["op"] == "start", F.startswith(F.lower(value), F.lower(s["value"])))
        .when(s["op"] == "word", F.array_contains(F.split(value, " "), s["value"]))
    )
    held = F.exists(
        nodes,
        lambda a: (a["i"] < n["i"])
        & (a["last"] >= n["last"])
        & F.coalesce(
            F.when(s["in_attr"] == "class", F.array_contains(F.split(a["attrs"]["class"], " "), s["in_value"])).otherwise(
                a["attrs"][s["in_attr"]] == s["in_value"]
            ),
            F.lit(False),
        ),
    )
    return (
        ~n["tag"].isin("#text", "#data")
        & (s["tag"].isNull() | (n["tag"] == s["tag"]))
        & F.coalesce(test, F.lit(False))
        & (s["in_attr"].isNull() | held)
    )


def select(nodes: Column, selectors: Column) -> Column:
    """Matching nodes, selector by selector, each in document order."""
    return F.flatten(
        F.transform(selectors, lambda s: F.filter(nodes, lambda n: matches(nodes, n, s)))
    )


def first_value(values: Column) -> Column:
    """The first non-empty string."""
    return F.get(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(0))


def pick_text(nodes: Column, selectors: Column) -> Column:
    return first_value(F.transform(select(nodes, selectors), lambda n: text_of(nodes, n)))


def pick_attr(nodes: Column, selectors: Column, name: str) -> Column:
    return first_value(F.transform(select(nodes, selectors), lambda n: attr(n, name)))


def marked(nodes: Column, first: int, count: int) -> Column:
    """Nodes that match one of ``count`` selectors of the parse, from number ``first`` on."""
    return F.filter(nodes, lambda n: F.exists(n["marks"], lambda m: (m["k"] >= first) & (m["k"] < first + count)))


def by_selector(nodes: Column, first: int, count: int) -> Column:
    """The same, selector by selector, each in document order; ``nodes`` is walked once."""
    few = F.array(marked(nodes, first, count))
    ranks = F.sequence(F.lit(first), F.lit(first + count - 1))
    each = F.transform(few, lambda f: F.flatten(F.transform(ranks, lambda k: F.filter(f, lambda n: F.exists(n["marks"], lambda m: m["k"] == k)))))
    return F.get(each, F.lit(0))


def script_blocks(nodes: Column, type_pattern: str) -> Column:
    scripts = F.filter(
        nodes,
        lambda n: (n["tag"] == "script") & F.coalesce(attr(n, "type").rlike(type_pattern), F.lit(False)),
    )
    return F.transform(
        scripts,
        lambda s: F.array_join(F.transform(inside(nodes, s), lambda m: F.coalesce(m["text"], F.lit(""))), ""),
    )
