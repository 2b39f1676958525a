"""Deeply nested records into related flat tables, by shared inlining.

A record type is described as a graph of elements.  ``plan_relations`` analyses the graph:

* an element that occurs at most once under a single parent is *inlined*: its scalars become
  columns of the nearest ancestor that has a table, prefixed with the path to it;
* an element that is repeated, shared (more than one parent) or recursive (on a cycle) gets a
  relation of its own, with the document key, its own path and ordinal, and a foreign key to
  the relation it hangs under.

``NestedShredder.shred`` walks every document once, to any depth, in one Arrow pass without a
shuffle.  The recursive element comes out as one row per object; relations that hang under it
travel in that row as arrays of structs, so the flat tables are plain ``explode``s of it and a
join along a foreign key needs no shuffle (``leaves``).

Documents are read to any depth: where the C reader runs out of stack, a reader without recursion
takes over.  A path is as long as its object is deep, so a chain of n objects has n * n characters of
paths; rows leave in batches bounded in bytes.

Cases: a null, empty or unreadable document gives no row; absent, null and empty children are
the same; of several copies of a document the earliest one that the reader can read whole counts,
ties are settled by the text's hash; extra columns of the input are ignored, so that their names
can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_BYTES = 8_000_000  # of paths in a batch of rows


@dataclass(frozen=True)
class Child:
    name: str
    element: str
    many: bool = False


@dataclass(frozen=True)
class Element:
    name: str
    scalars: tuple[tuple[str, str], ...] = ()  # (column, Spark type)
    children: tuple[Child, ...] = ()


@dataclass
class Relation:
    element: str
    reasons: tuple[str, ...]
    columns: list[tuple[str, str]] = field(default_factory=list)  # own and inlined scalars
    inlined: list[tuple[str, ...]] = field(default_factory=list)  # paths of inlined elements
    under: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)  # (parent relation, path of names)


def plan_relations(elements: dict[str, Element], root: str) -> dict[str, Relation]:
    """Decide which elements become relations and which are inlined; see the module's text."""
    parents: dict[str, set[str]] = {e: set() for e in elements}
    many: set[str] = set()
    for e in elements.values():
        for c in e.children:
            parents[c.element].add(e.name)
            if c.many:
                many.add(c.element)

    def reaches(a: str, b: str, seen: set[str]) -> bool:
        return any(c.element == b or (c.element not in seen and not seen.add(c.element) and reaches(c.element, b, seen)) for c in elements[a].children)

    reasons = {
        e: tuple(r for r, holds in (("root", e == root), ("repeated", e in many), ("shared", len(parents[e]) > 1), ("recursive", reaches(e, e, set()))) if holds)
        for e in elements
    }
    out = {e: Relation(e, why) for e, why in reasons.items() if why}

    def inline(into: Relation, e: str, path: tuple[str, ...]) -> None:
        into.columns += [("_".join((*path, c)), t) for c, t in elements[e].scalars]
        for c in elements[e].children:
            if c.element in out:
                out[c.element].under.append((into.element, (*path, c.name)))
            else:
                into.inlined.append((*path, c.name))
                inline(into, c.element, (*path, c.name))

    for e, rel in out.items():
        inline(rel, e, ())
    return out


# --- the graph of elements, observed in documents --------------------------------------------------

EDGES = 100_000  # pairs of parent and child element; a schema, not the data, bounds them


def _walk(value, fold: Callable[[str], str]) -> set[tuple[str, str, str, bool]]:
    """(parent, child, kind, repeated) of every place in a document; elements are named by their keys."""
    out: set[tuple[str, str, str, bool]] = set()
    work: list = [("document", "record", value, False)]
    while work:
        parent, name, v, many = work.pop()
        if isinstance(v, dict) and v and all(k.isdecimal() for k in v):
            v = list(v.values())  # a list keyed by position
        if isinstance(v, list):
            work += [(parent, name, x, True) for x in v]
        elif isinstance(v, dict):
            out.add((parent, name, "object", many))
            work += [(name, fold(k), x, False) for k, x in v.items()]
        elif v is not None:
            out.add((parent, name, {bool: "boolean", int: "bigint", float: "double"}.get(type(v), "string"), many))
    return out


def observed_edges(df: DataFrame, payload: str, fold: Callable[[str], str] = str.lower) -> DataFrame:
    """(parent, child, kind, repeated, documents): the schema graph of all documents, one Arrow pass and an aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, int] = {}
            for d in b.column(0):
                v = read_json(d.as_py())
                for edge in _walk(v, fold) if v is not None else ():
                    seen[edge] = seen.get(edge, 0) + 1
            if seen:
                cols = list(zip(*((*e, n) for e, n in seen.items())))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["parent", "child", "kind", "repeated", "documents"])

    edges = df.where(F.col(payload) != "").select(payload).mapInArrow(run, "parent string, child string, kind string, repeated boolean, documents bigint")
    return edges.groupBy("parent", "child", "kind").agg(F.max("repeated").alias("repeated"), F.sum("documents").alias("documents"))


def graph_of(edges: list[tuple[str, str, str, bool]]) -> dict[str, Element]:
    """Elements of observed edges (parent, child, kind, repeated).  Scalars of several types are text, repeated
    scalars are elements of their own with one column."""
    objects = {c for _, c, kind, _ in edges if kind == "object"} | {"document"}
    scalars: dict[str, dict[str, str]] = {e: {} for e in objects}
    children: dict[str, dict[str, bool]] = {e: {} for e in objects}
    lists: dict[str, str] = {}
    for parent, child, kind, many in sorted(edges):
        if kind == "object":
            children[parent][child] = children[parent].get(child, False) or many
        elif many:
            name = f"{child}[]"
            children[parent][name] = True
            lists[name] = kind if lists.get(name, kind) == kind else "string"
        else:
            scalars[parent][child] = kind if scalars[parent].get(child, kind) == kind else "string"
    out = {e: Element(e, tuple(scalars[e].items()), tuple(Child(n, n, many) for n, many in children[e].items())) for e in sorted(objects)}
    return out | {n: Element(n, (("value", kind),)) for n, kind in lists.items()}


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


class NestedShredder:
    """``decode`` turns one raw document into a list of logical root records (nested dicts named as in
    the graph), or None if the document can't be read whole; ``whole`` tells that for less work."""

    def __init__(self, elements: dict[str, Element], root: str, spine: str, decode: Callable[[str], list[dict] | None], whole: Callable[[str], bool] | None = None):
        self.elements, self.root, self.spine, self.decode = elements, root, spine, decode
        self.whole = whole or (lambda document: decode(document) is not None)
        self.relations = plan_relations(elements, root)
        if "recursive" not in self.relations[spine].reasons and spine != root:
            raise ValueError("the spine is the root or the recursive element")
        self.self_paths = [p for parent, p in self.relations[spine].under if parent == spine]

    def hanging(self, rel: str) -> list[tuple[str, str]]:
        """Relations directly under ``rel`` beside the spine itself: (column of the array, relation)."""
        return [("_".join(p), r.element) for r in self.relations.values() if r.element != self.spine for parent, p in r.under if parent == rel]

    def _ddl(self, rel: str) -> str:
        cols = [f"{c} {t}" for c, t in self.relations[rel].columns] + [f"{c} array<struct<ordinal int, {self._ddl_in(r)}>>" for c, r in self.hanging(rel)]
        return ", ".join(cols)

    def _ddl_in(self, rel: str) -> str:
        cols = [f"{c}: {t}" for c, t in self.relations[rel].columns] + [f"{c}: array<struct<ordinal: int, {self._ddl_in(r)}>>" for c, r in self.hanging(rel)]
        return ", ".join(cols)

    def _arrow(self, rel: str) -> list[tuple[str, pa.DataType]]:
        return [(c, _ARROW[t]) for c, t in self.relations[rel].columns] + [(c, pa.list_(pa.struct([("ordinal", pa.int32()), *self._arrow(r)]))) for c, r in self.hanging(rel)]

    def _row(self, rel: str, value: dict) -> dict:
        r = self.relations[rel]
        row: dict = {c: value.get(c) for c, _ in self.elements[rel].scalars}
        for path in r.inlined:
            at: dict | None = value
            for name in path:
                at = (at or {}).get(name)
            element = rel
            for name in path:
                element = next(c.element for c in self.elements[element].children if c.name == name)
            row |= {"_".join((*path, c)): (at or {}).get(c) for c, _ in self.elements[element].scalars}
        for col, child in self.hanging(rel):
            path = next(p for parent, p in self.relations[child].under if parent == rel and "_".join(p) == col)
            at = value
            for name in path[:-1]:
                at = (at or {}).get(name)
            found = (at or {}).get(path[-1])
            found = [] if found is None else found if isinstance(found, list) else [found]
            row[col] = [{"ordinal": i} | self._row(child, v) for i, v in enumerate(found)]
        return row

    def rows_of(self, document: str | None) -> Iterator[tuple[str, str, dict]]:
        """(path, parent path, row) of every spine object of a document, any depth, without recursion on it."""
        tops = self.decode(document) if document else None
        stack = [(str(i), "", t) for i, t in enumerate(tops or []) if t is not None][::-1]
        while stack:
            path, parent, value = stack.pop()
            yield path, parent, self._row(self.spine, value)
            kids: list = []
            for names in self.self_paths:
                at = value
                for name in names[:-1]:
                    at = (at or {}).get(name)
                found = (at or {}).get(names[-1])
                kids += [] if found is None else found if isinstance(found, list) else [found]
            stack += [(f"{path}.{i}", path, k) for i, k in enumerate(kids) if k is not None][::-1]

    def whole_copies(self, df: DataFrame, key: str, payload: str, delivered: str) -> DataFrame:
        """(key, document): of several copies of a key the earliest that can be read whole.

        The reader itself decides what is whole.  Every task keeps one copy of a key before the
        shuffle (the limit on the row number is pushed below it), so copies never pile up.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bad = [not self.whole(d.as_py()) for d in b.column(2)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bad, pa.bool_())], names=["k", "d", "p", "bad"])

        rows = df.where(F.col(payload) != "").select(F.col(key).cast("bigint").alias("k"), F.col(delivered).alias("d"), F.col(payload).alias("p"))
        kind = rows.schema["d"].dataType.simpleString()
        rows = rows.mapInArrow(run, f"k bigint, d {kind}, p string, bad boolean").where("not bad")
        first = Window.partitionBy("k").orderBy(F.col("d").asc_nulls_last(), F.xxhash64("p"), "p")
        return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("k").alias(key), F.col("p").alias("document"))

    def shred(self, df: DataFrame, key: str, payload: str, delivered: str) -> DataFrame:
        """One row per spine object: key, path, parent_path, columns, arrays of hanging relations."""
        cols = [("doc_key", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), *self._arrow(self.spine)]
        schema = pa.schema(cols)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            size = 0
            for b in batches:
                for k, d in zip(b.column(0).to_pylist(), b.column(1)):
                    for path, parent, row in self.rows_of(d.as_py()):
                        rows.append({"doc_key": k, "path": path, "parent_path": parent} | row)
                        size += 2 * len(path)
                        if len(rows) >= 5000 or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        one = self.whole_copies(df, key, payload, delivered)
        return one.mapInArrow(run, f"doc_key bigint, path string, parent_path string, {self._ddl(self.spine)}").withColumnRenamed("doc_key", key)

    def flat(self, shredded: DataFrame, key: str) -> dict[str, DataFrame]:
        """The flat tables: the spine and, per relation and place it hangs at, its rows with the foreign key."""
        out = {self.spine: shredded.drop(*[c for c, _ in self.hanging(self.spine)])}

        def under(df: DataFrame, ids: list[str], rel: str, prefix: str) -> None:
            for col, child in self.hanging(rel):
                name = f"{prefix}_{col}"
                rows = df.select(*ids, F.explode(col).alias("__x")).select(*ids, F.col("__x.ordinal").alias(f"{col}_no"), *[F.col(f"__x.{c}").alias(c) for c, _ in self.relations[child].columns], *[F.col(f"__x.{c}").alias(c) for c, _ in self.hanging(child)])
                out[name] = rows.drop(*[c for c, _ in self.hanging(child)])
                under(rows, [*ids, f"{col}_no"], child, name)

        under(shredded, [key, "path"], self.spine, self.spine)
        return out


def _long_int(digits: str) -> int | float:
    """An integer of more digits than Python reads at once is far beyond any type here."""
    return int(digits) if len(digits) < 400 else float(digits)


_MARK = re.compile(r'[ \t\r\n]*([\[\]{},:"]|[^ \t\r\n\[\]{},:"]+)')


def _read_deep(text: str):
    """The value of a JSON text of any depth; raises ValueError if it isn't one."""
    atom = json.JSONDecoder(parse_int=_long_int).decode
    open_: list = []  # containers around the place of reading, and the key a value is for
    value: list = []  # the finished value, once there is one
    at, key, want = 0, None, "value"  # what may come: value, value] (first of a list), key, key} (first of an object), colon, after
    end = len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _MARK.match(text, at)
        mark = m[1]
        at = m.end()
        if mark == '"':
            mark, at = json.decoder.scanstring(text, at)
            if want in ("key", "key}"):
                key, want = mark, "colon"
                continue
            got = mark
        elif mark in "[{" and want in ("value", "value]"):
            open_.append(([] if mark == "[" else {}, key))
            want = "value]" if mark == "[" else "key}"
            continue
        elif mark == ":" and want == "colon":
            want = "value"
            continue
        elif mark == "," and want == "after" and open_:
            want = "value" if isinstance(open_[-1][0], list) else "key"
            continue
        elif mark in "]}" and open_ and want in ("after", "value]" if mark == "]" else "key}") and isinstance(open_[-1][0], list if mark == "]" else dict):
            got, key = open_.pop()
            want = "value"
        elif mark not in '[]{},:"':
            got = atom(mark)
        else:
            raise ValueError("not JSON")
        if want not in ("value", "value]"):
            raise ValueError("not JSON")
        if not open_:
            value.append(got)
        elif isinstance(open_[-1][0], list):
            open_[-1][0].append(got)
        else:
            open_[-1][0][key] = got
        want = "after"
    if len(value) != 1 or open_:
        raise ValueError("not JSON")
    return value[0]


def read_json(text: str):
    """The value of a JSON text, or None if it isn't one (cut off, empty, garbage)."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None
    except (ValueError, RecursionError):  # numbers or nesting beyond the fast reader's limits
        try:
            return _read_deep(text)
        except ValueError:
            return None


def write_json(value) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    work: list = [(value,)]  # values in tuples, text as it is
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (v,) = x
        if isinstance(v, list):
            parts: list = ["["]
            for i, e in enumerate(v):
                parts += [", ", (e,)] if i else [(e,)]
            work += [*parts, "]"][::-1]
        elif isinstance(v, dict):
            parts = ["{"]
            for i, (k, e) in enumerate(v.items()):
                parts += [", "] * bool(i) + [json.dumps(k, ensure_ascii=False) + ": ", (e,)]
            work += [*parts, "}"][::-1]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)
