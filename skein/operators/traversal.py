"""Fluent traversals: each step turns one DataFrame of traversers into the next.

A row is a traverser. Its current object stands in `id` (a vertex; its label and properties are
joined only once a step reads them), in id, src, dst, label and properties (an edge), in `value`
(a scalar), or in named columns (a map). Columns that start with an underscore travel along:
`_n` the multiplicity, `_as_x` marked objects, `_ids` and `_path` the way so far, `_sack`, `_from`
the vertex that an edge was reached from, `_ord0`, `_ord1`… what the stream is ordered by, `_key1`,
`_key2`… the object that an inner traversal belongs to.

Inner traversals are functions of a Traversal (or made with `__`). They run once over the
distinct objects of the outer stream, all at the same time, and are joined back by the object:
semi and anti joins for filters, left joins for values. Within them, limits and reducing steps
work for each object.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.graph import EDGE_KEYS, PropertyGraph, key_of, union_all
from skein.operators.lineage import saved
from skein.operators.predicates import P, as_predicate

Inner = Callable[["Traversal"], "Traversal"]
#: A repeat that is still going after so many rounds is an error.
MOST_ROUNDS = 10_000
#: Results of so many rounds are saved as one frame, which keeps plans small.
PARTS = 50
#: The ends that a hop in a direction leaves from and leads to.
ENDS = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}
#: Comparisons, and what they are with their sides changed.
TURNED = {operator.lt: operator.gt, operator.gt: operator.lt, operator.le: operator.ge, operator.ge: operator.le, operator.eq: operator.eq, operator.ne: operator.ne}
#: Types whose values compare as they do once Spark has widened them to a common one.
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


class Anonymous:
    """`__.out("a").count()` as a function of a traversal."""

    def __init__(self, f: Inner = lambda t: t) -> None:
        self._f = f

    def __getattr__(self, name: str):
        return lambda *args, **named: Anonymous(lambda t: getattr(self._f(t), name)(*args, **named))

    def __call__(self, t: Traversal) -> Traversal:
        return self._f(t)


__ = Anonymous()


class T:
    """Tokens for by(): the id or the label of an element."""

    id, label = "~id", "~label"


@dataclass(frozen=True)
class Hop:
    """The last hop of a stream of vertices, as long as nothing but marks came after it."""

    before: Traversal
    direction: str
    labels: tuple[str, ...]
    marks: tuple[str, ...] = ()  # set since


@dataclass(frozen=True)
class Compared:
    """What where_marked compared: the stream that it filtered, and its arguments."""

    stream: Traversal
    a: str
    compare: Callable[[Any, Any], Any]
    b: str
    by: str | None


@dataclass(frozen=True)
class Traversal:
    graph: PropertyGraph
    df: DataFrame
    kind: str  # vertex, edge, value, property or map
    labels: tuple[str, ...] | None = None
    loaded: bool = False  # whether a vertex's label and properties stand in the frame
    names: dict[str, Traversal] = field(default_factory=dict)  # of marked objects: a traversal of their kind
    keys: tuple[str, ...] = ()  # of the inner traversals that this one is part of
    starts: DataFrame | None = None  # all keys of the innermost
    stores: dict[str, Traversal] = field(default_factory=dict)
    by_path: tuple[Any, ...] | None = None  # what path() shows of each object in turn
    passed: int = 0  # objects on the way so far
    ordering: tuple[tuple[str, bool], ...] = ()  # travelling columns that order() made, and whether they fall
    hop: Hop | None = None
    compared: Compared | None = None

    # --- basics ---

    def __getattr__(self, name: str):
        """camelCase names stand for those with underscores."""
        plain = "".join("_" + c.lower() if c.isupper() else c for c in name)
        for own in (plain, plain + "_"):
            if own != name and hasattr(type(self), own):
                return getattr(self, own)
        raise AttributeError(name)

    @property
    def travelling(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("_")]

    @property
    def object(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(("_", "~"))]

    def _on(self, df: DataFrame, kind: str | None = None, **other: Any) -> Traversal:
        if "ordering" not in other and not {c for c, _ in self.ordering} <= set(df.columns):
            other["ordering"] = ()
        if df is not self.df:  # other rows than those of the hop or the comparison
            other = {"hop": None, "compared": None} | other
        return replace(self, df=df, kind=kind or self.kind, **other)

    def _value(self, column: Column) -> Traversal:
        return self._on(self.df.select(*self.travelling, column.alias("value")), "value", labels=None, loaded=True)

    def _n(self) -> Column:
        return F.col("_n") if "_n" in self.df.columns else F.lit(1).cast("long")

    def load(self) -> Traversal:
        """With the label and properties of vertices. A join only if they aren't there yet."""
        if self.kind != "vertex" or self.loaded:
            return self
        return self._on(self.df.select(*self.travelling, "id").join(self.graph.vertex_frame(self.labels), "id"), loaded=True)

    def _identity(self) -> Column:
        """What tells the current object apart."""
        if self.kind in ("vertex", "edge"):
            return F.col("id")
        own = self.object
        return F.col("value") if own == ["value"] else F.struct(*own)

    def _by(self, by: Any) -> tuple[Traversal, Column]:
        """A traversal with what `by` names, and the column of it: null where there is none."""
        if by is None:
            return self, self._identity()
        if isinstance(by, Column):
            return self.load(), by
        if callable(by):
            return self._joined(by)
        if by == T.id:
            return self, F.col("id")
        own = self.load()
        name = "label" if by == T.label else by
        if name in own.df.columns:
            return own, F.col(name)
        if self.kind == "value" and dict(self.df.dtypes)["value"].startswith(("struct", "map")):
            return self, F.col("value")[name]
        return own, F.lit(None)

    # --- inner traversals ---

    def _inner(self, inner: Inner) -> tuple[Traversal, str]:
        """The inner traversal over the distinct objects, and the name of its key."""
        key = f"_key{int(self.keys[0][4:]) + 1 if self.keys else 1}"
        own = self if self.kind != "vertex" or self.loaded else self._on(self.df.select(*self.travelling, "id"))
        needed = [c for c in own.object if self.kind != "vertex" or c == "id" or self.loaded]
        # marked objects, the way and the sack are part of what an inner traversal sees, if it has them
        along = [c for c in own.travelling if c.startswith(("_as_", "_from"))]
        ident = own._identity() if not along else F.struct(own._identity().alias("o"), *along)
        start = own.df.select(ident.alias(key), *needed, *along).dropDuplicates([key])
        out = inner(own._on(start, keys=(key,), starts=start.select(key)))
        return out, key

    def _ident(self) -> Column:
        along = [c for c in self.travelling if c.startswith(("_as_", "_from"))]
        return self._identity() if not along else F.struct(self._identity().alias("o"), *along)

    def _matching(self, inner: Inner, how: str) -> Traversal:
        out, key = self._inner(inner)
        hits = out.df.select(F.col(key)).distinct()
        return self._on(self.df.join(hits, self._ident() == hits[key], how))

    def _joined(self, inner: Inner) -> tuple[Traversal, Column]:
        """The first value of the inner traversal for each object, beside the object: in its order, or the least."""
        out, key = self._inner(inner)
        name = f"~by{len(self.df.columns)}_{len(self.keys)}"
        value = out._identity() if out.kind != "map" or len(out.object) > 1 else F.col(out.object[0])
        if out.ordering:
            rank = F.row_number().over(Window.partitionBy(key).orderBy(*out._ordering))
            first = out.df.select(F.col(key), value.alias(name), rank.alias("~r")).where("`~r` = 1").drop("~r")
        elif out.kind == "map":
            first = out.df.select(F.col(key), value.alias(name)).dropDuplicates([key])
        else:
            first = out.df.select(F.col(key), value.alias(name)).groupBy(key).agg(F.min(name).alias(name))
        own = self.df.join(first, self._ident() == first[key], "left").drop(first[key])
        return self._on(own), F.col(name)

    def _flat(self, inner: Inner) -> Traversal:
        """Every result of the inner traversal for every traverser, with what travelled along."""
        out, key = self._inner(inner)
        out = out._on(out.df.drop(*(c for c, _ in out.ordering)), ordering=self.ordering)  # the outer order stays
        keep = [c for c in self.travelling if c not in out.travelling or c == "_n"]
        outer = self.df.select(self._ident().alias("~k"), *(F.col(c).alias("~n" if c == "_n" else c) for c in keep))
        joined = outer.join(out.df, outer["~k"] == out.df[key]).drop("~k", key)
        if "_n" in keep:
            joined = joined.withColumn("_n", F.col("~n") * out._n()).drop("~n")
        return out._on(joined, keys=self.keys, starts=self.starts, ordering=self.ordering)

    # --- filters ---

    def has(self, key: str, *test: Any) -> Traversal:
        """has(k), has(k, v), has(k, P) or has(label, k, v). Any value of a list may fit."""
        if len(test) == 2:
            return self.has_label(key).has(*test)
        own, c = self._by(key)
        if not test:
            return own._on(own.df.where(c.isNotNull() & (F.size(c) > 0 if _is_array(own, key) else F.lit(True))))
        p = as_predicate(test[0])
        return own._on(own.df.where(F.coalesce(F.exists(c, lambda x: p(x)), F.lit(False)) if _is_array(own, key) else p(c)))

    def has_not(self, key: str) -> Traversal:
        own, c = self._by(key)
        return own._on(own.df.where(c.isNull()))

    def has_label(self, *labels: str) -> Traversal:
        if self.kind == "vertex" and not self.loaded and self.labels and set(self.labels) <= set(labels):
            return self
        own = self.load()
        return own._on(own.df.where(F.col("label").isin(*labels)), labels=tuple(labels))

    def has_id(self, *ids: Any) -> Traversal:
        if len(ids) == 1 and isinstance(ids[0], P):
            return self._on(self.df.where(ids[0](F.col("id"))))
        return self._on(self.df.where(F.col("id").isin([key_of(i) for i in ids if i is not None])))

    def has_key(self, *keys: str) -> Traversal:
        return self._on(self.df.where(F.col("key").isin(*keys)))

    def has_value(self, *values: Any) -> Traversal:
        return self._on(self.df.where(F.col("value").isin(*[str(v) for v in values])))

    def is_(self, test: Any) -> Traversal:
        return self._on(self.df.where(as_predicate(test)(F.col("value"))))

    def where(self, inner: Inner | str | P, test: P | str | None = None, by: str | None = None) -> Traversal:
        """An inner traversal with a result; where(a, P.gt(b)) over marked objects, or where(P.neq(a))
        of the current object, each by a property (without by, the objects themselves)."""
        if isinstance(inner, P):
            if inner.pair is None:
                raise TypeError("where compares with a marked object: P.eq, neq, lt, lte, gt or gte of its name")
            here = self.as_("~here")
            return here.where_marked("~here", *inner.pair, by)._on_like(self)
        if isinstance(inner, str):
            compare, other = (operator.eq, test) if isinstance(test, str) else test.pair
            return self.where_marked(inner, compare, other, by)
        return self._matching(inner, "left_semi")

    def _on_like(self, before: Traversal) -> Traversal:
        return replace(before, df=self.df.select(*before.df.columns), hop=None, compared=self.compared)

    filter = where

    def where_marked(self, a: str, compare: Callable[[Column, Column], Column], b: str, by: str | None = None) -> Traversal:
        """Compares a property of two marked vertices (their ids without by)."""
        own = self.df
        for name, column in ((a, "~a"), (b, "~b")):
            own = self._with_mark(own, name, by, column)
        kept = self._on(own.where(compare(F.col("~a"), F.col("~b"))).select(*self.df.columns))
        return replace(kept, compared=Compared(self, a, compare, b, by))

    def _with_mark(self, df: DataFrame, name: str, by: str | None, column: str) -> DataFrame:
        """A frame with a property of a marked vertex (its id without by) as one more column."""
        if by is None:
            return df.withColumn(column, F.col(f"`_as_{name}`"))
        side = self.graph.vertex_frame(self.names[name].labels).select(F.col("id").alias("~i"), F.col(by).alias(column))
        return df.join(side, F.col(f"`_as_{name}`") == F.col("~i")).drop("~i")

    def _counted(self) -> Traversal:
        """For count(): as many traversers as are here, but after a comparison of marks at the two ends of
        the last hop those before the hop, each with the number of its matches as multiplicity.

        Pairs grow with the square of the edges that a vertex has. So they aren't made: the values at both
        ends are sorted for each vertex in between, and running sums count the matches. The far side's
        edges are read whole, and one task sorts those of a vertex. Other comparisons than by one
        operator, and values of types that don't sort as they compare, keep to the pairs.
        """
        if self.compared is None or self.compared.stream.hop is None:
            return self
        stream, hop, by = self.compared.stream, self.compared.stream.hop, self.compared.by
        near, far, how = self.compared.a, self.compared.b, _operator_of(self.compared.compare)
        if near in hop.marks:
            near, far, how = far, near, TURNED.get(how)
        if how is None or far not in hop.marks or near in hop.marks or stream.names[near].kind != "vertex":
            return self
        keys = list(self.keys)
        left = stream._with_mark(hop.before.df.withColumnsRenamed({"id": "~at"}), near, by, "~v").select(*keys, "~at", "~v", hop.before._n().alias("~n"), F.lit(0).alias("~side"))
        edges = self.graph.edge_frame(hop.labels)
        edges = union_all([edges.select(F.col(here).alias("~at"), F.col(there).alias(f"_as_{far}")) for here, there in ENDS[hop.direction]])
        right = stream._with_mark(edges, far, by, "~v").select("~at", "~v", F.lit(1).alias("~side"))
        types = {dict(x.dtypes)["~v"] for x in (left, right)}
        if not types <= NUMBERS and (len(types) > 1 or next(iter(types)).startswith(("array", "struct", "map", "variant"))):
            return self
        rows = union_all([left, right]).where("`~at` is not null and `~v` is not null")

        def far_ones(keys: list[str], *order: Column) -> Column:
            """How many values of the far side come up to this row."""
            upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return F.sum(F.col("~side").cast("long")).over(upto)

        first = F.col("~side").desc()  # the far side before the near one: equal values count
        if how in (operator.eq, operator.ne):
            n = far_ones(["~at", "~v"], first)
            n = n if how is operator.eq else far_ones(["~at"], first) - n
        else:
            falls, equal = how in (operator.lt, operator.le), how in (operator.le, operator.ge)
            n = far_ones(["~at"], _sorted(F.col("~v"), falls), first if equal else F.col("~side").asc())
        rows = rows.withColumn("~m", n).where("`~side` = 0 and `~m` > 0")
        return self._on(rows.select(*keys, (F.col("~n") * F.col("~m")).alias("_n")))

    def not_(self, inner: Inner) -> Traversal:
        return self._matching(inner, "left_anti")

    def and_(self, *inner: Inner) -> Traversal:
        out = self
        for f in inner:
            out = out.where(f)
        return out

    def or_(self, *inner: Inner) -> Traversal:
        """Objects for which any of the inner traversals has a result."""
        found = [self._inner(f) for f in inner]
        key = found[0][1]
        hits = union_all([out.df.select(key) for out, _ in found]).distinct()
        return self._on(self.df.join(hits, self._ident() == hits[key], "left_semi"))

    def dedup(self, *marks: str, by: Any = None) -> Traversal:
        """One traverser for each object, or each value of by, or each combination of marked objects."""
        if marks:
            columns = [*self.keys, *(f"_as_{m}" for m in marks)]
            return self._on(self._once().dropDuplicates(columns))
        own, c = self._by(by)
        if by is None:
            return self._on(self._once().dropDuplicates([*self.keys, *(["id"] if self.kind in ("vertex", "edge") else self.object)]))
        order = Window.partitionBy(*self.keys, c).orderBy(*self._order_key())
        first = own.df.where(c.isNotNull()).withColumn("~r", F.row_number().over(order)).where("`~r` = 1").drop("~r")
        return own._on(first if "_n" not in first.columns else first.withColumn("_n", F.lit(1).cast("long")))

    def _once(self) -> DataFrame:
        return self.df.withColumn("_n", F.lit(1).cast("long")) if "_n" in self.df.columns else self.df

    def dedup_local(self) -> Traversal:
        return self._value(F.array_distinct("value"))

    def _order_key(self) -> list[Column]:
        return [F.col("id")] if self.kind in ("vertex", "edge") else [F.col(c) for c in self.object]

    def _single(self) -> Traversal:
        """One row for each traverser, where rows stand for several."""
        if "_n" not in self.df.columns:
            return self
        return self._on(self.df.withColumn("~i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("~i", "_n"), ordering=self.ordering)

    def _sliced(self, lo: int, hi: int | None, order: list[Column]) -> Traversal:
        """Traversers lo to hi (without) of each inner start, or of all, in an order."""
        own = self._single()
        if not self.keys:
            df = own.df.orderBy(*order) if order else own.df
            df = df.offset(lo) if lo else df
            return own._on(df if hi is None else df.limit(hi - lo))
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(order or own._order_key())))
        ranked = own.df.withColumn("~r", rank).where((F.col("~r") > lo) & (F.lit(True) if hi is None else F.col("~r") <= hi))
        return own._on(ranked.drop("~r"))

    def limit(self, n: int) -> Traversal:
        return self.range_(0, n)

    def range_(self, lo: int, hi: int) -> Traversal:
        return self._sliced(lo, None if hi < 0 else hi, self._ordering)

    def skip(self, n: int) -> Traversal:
        return self._sliced(n, None, self._ordering)

    def tail(self, n: int = 1) -> Traversal:
        """The last n in the order that order() gave, in that order."""
        order = [(F.col(c), desc) for c, desc in self.ordering] or [(c, False) for c in self._order_key()]
        out = self._sliced(0, n, [_sorted(c, not desc) for c, desc in order])
        return out._on(out.df.orderBy(*(_sorted(c, desc) for c, desc in order))) if not self.keys else out

    @property
    def _ordering(self) -> list[Column]:
        return [_sorted(F.col(c), desc) for c, desc in self.ordering]

    def limit_local(self, n: int) -> Traversal:
        return self._value(F.slice("value", 1, n))

    def range_local(self, lo: int, hi: int) -> Traversal:
        return self._value(F.slice("value", lo + 1, hi - lo))

    def sample(self, n: int, seed: int = 0) -> Traversal:
        return self._sliced(0, n, [F.rand(seed)])

    def coin(self, probability: float, seed: int = 0) -> Traversal:
        own = self._single()
        return own._on(own.df.where(F.rand(seed) < probability))

    def simple_path(self) -> Traversal:
        """No object twice on the way; needs track()."""
        return self._on(self.df.where(F.size("_ids") == F.size(F.array_distinct("_ids"))))

    def cyclic_path(self) -> Traversal:
        return self._on(self.df.where(F.size("_ids") > F.size(F.array_distinct("_ids"))))

    def identity(self) -> Traversal:
        return self

    def none(self, test: P | None = None) -> Traversal:
        """Nothing; with a test, lists of which no item fits it."""
        return self._on(self.df.limit(0)) if test is None else self._on(self.df.where(~F.exists("value", lambda x: test(x))))

    def any_(self, test: P) -> Traversal:
        return self._on(self.df.where(F.exists("value", lambda x: test(x))))

    def all_(self, test: P) -> Traversal:
        return self._on(self.df.where(F.forall("value", lambda x: test(x))))

    def fail(self, message: str = "fail() step") -> Traversal:
        return self._on(self.df.where(F.raise_error(F.lit(message)).isNull()))

    def barrier(self) -> Traversal:
        """Merges equal traversers into one row with a multiplicity."""
        own = self.df if self.kind != "vertex" else self.df.select(*self.travelling, "id")
        own = own.drop(*(c for c, _ in self.ordering))
        columns = [c for c in own.columns if c != "_n"]
        n = F.sum("_n") if "_n" in own.columns else F.count("*")
        return self._on(own.groupBy(*columns).agg(n.alias("_n")), loaded=self.loaded and self.kind != "vertex")

    # --- hops ---

    def _hop(self, direction: str, labels: tuple[str, ...], to_edge: bool) -> Traversal:
        """Joins edges by one end. Vertices at the other end aren't read until a step needs them."""
        parts, ends = [], []
        for here, there in ENDS[direction]:
            e = self.graph.edge_frame(labels)
            base = self.df.select(*(F.col(c) for c in self.travelling if c != "_from"), F.col("id").alias("~at"))
            joined = base.join(e, base["~at"] == e[here])
            if to_edge:
                parts.append(joined.withColumnRenamed("~at", "_from"))
            else:
                parts.append(joined.select(*(c for c in self.travelling if c != "_from"), F.col(there).alias("id")))
            ends.append(self.graph.end_labels(labels, out=there == "src"))
        out = self._on(union_all(parts), "edge" if to_edge else "vertex", labels=tuple(labels) or None, loaded=to_edge)
        if to_edge:
            return out._tracked()
        known = None if None in ends else tuple(dict.fromkeys(x for own in ends for x in own))
        return out._on(out.df, labels=known, hop=Hop(replace(self, hop=None, compared=None), direction, labels))._tracked()

    def out(self, *labels: str) -> Traversal:
        return self._hop("out", labels, False)

    def in_(self, *labels: str) -> Traversal:
        return self._hop("in", labels, False)

    def both(self, *labels: str) -> Traversal:
        return self._hop("both", labels, False)

    def out_e(self, *labels: str) -> Traversal:
        return self._hop("out", labels, True)

    def in_e(self, *labels: str) -> Traversal:
        return self._hop("in", labels, True)

    def both_e(self, *labels: str) -> Traversal:
        return self._hop("both", labels, True)

    def to(self, direction: str, *labels: str) -> Traversal:
        return self._hop(direction, labels, False)

    def to_e(self, direction: str, *labels: str) -> Traversal:
        return self._hop(direction, labels, True)

    def _end(self, columns: list[Column], labels) -> Traversal:
        keep = [c for c in self.travelling if c != "_from"]
        df = union_all([self.df.select(*keep, c.alias("id")) for c in columns])
        return self._on(df, "vertex", labels=labels, loaded=False)._tracked()

    def out_v(self) -> Traversal:
        return self._end([F.col("src")], self.graph.end_labels(self.labels or (), True))

    def in_v(self) -> Traversal:
        return self._end([F.col("dst")], self.graph.end_labels(self.labels or (), False))

    def both_v(self) -> Traversal:
        return self._end([F.col("src"), F.col("dst")], None)

    def to_v(self, direction: str) -> Traversal:
        return {"out": self.out_v, "in": self.in_v, "both": self.both_v}[direction]()

    def other_v(self) -> Traversal:
        """The end of an edge that the traverser didn't come from."""
        return self._end([F.when(F.col("_from") == F.col("src"), F.col("dst")).otherwise(F.col("src"))], None)

    def V(self, *ids: Any, labels: Iterable[str] | None = None) -> Traversal:
        """Every traverser at every such vertex: the right side is the caller's to keep small."""
        side = self.graph.V(*ids, labels=labels)
        return side._on(self.df.select(*self.travelling).crossJoin(side.df), names=self.names, keys=self.keys, starts=self.starts)

    # --- the way ---

    def track(self, *by: Any) -> Traversal:
        """From here on keeps the vertices and edges passed, for path(): of each the property or token
        that `by` names, several in turn; ids without one. simple_path() looks at vertices alone."""
        own = self._on(self.df, by_path=by or (T.id,), passed=0)
        own, shown = own._shown()
        return own._on(own.df.withColumns({"_ids": F.array("id") if self.kind == "vertex" else F.array().cast("array<bigint>"), "_path": F.array(shown)}), passed=1)

    def _shown(self) -> tuple[Traversal, Column]:
        """The current object as the way shows it, as text."""
        own, c = self._by(self.by_path[self.passed % len(self.by_path)])
        return own, c.cast("string")

    def _tracked(self) -> Traversal:
        if self.by_path is None or "_ids" not in self.df.columns:
            return self
        own, shown = self._shown()
        ids = {"_ids": F.array_append("_ids", F.col("id"))} if self.kind == "vertex" else {}
        return own._on(own.df.withColumns({**ids, "_path": F.array_append("_path", shown)}), passed=self.passed + 1)

    def path(self) -> Traversal:
        return self._value(F.col("_path"))

    def with_sack(self, init: Any) -> Traversal:
        return self._on(self.df.withColumn("_sack", F.lit(init)))

    def sack(self, op: str | None = None, by: Any = None) -> Traversal:
        """Without an operator the sack's value, else the sack changed by a property of the object."""
        if op is None:
            return self._value(F.col("_sack"))
        own, c = self._by(by)
        new = {"sum": F.col("_sack") + c, "mult": F.col("_sack") * c, "min": F.least("_sack", c), "max": F.greatest("_sack", c), "assign": c, "minus": F.col("_sack") - c, "div": F.col("_sack") / c}[op]
        return own._on(own.df.withColumn("_sack", new))

    def as_(self, name: str) -> Traversal:
        c = F.col("id") if self.kind == "vertex" else F.struct(*self.object) if self.kind in ("edge", "map", "property") else F.col("value")
        hop = self.hop and replace(self.hop, marks=(*self.hop.marks, name))
        return self._on(self.df.withColumn(f"_as_{name}", c), names=self.names | {name: self._on(self.df.limit(0), loaded=self.kind != "vertex")}, hop=hop)

    def select(self, *names: str, by: Any = None) -> Traversal:
        """The object marked so; of several, a map with a column for each, by a property."""
        if self.kind == "map" and all(n in self.object for n in names):
            return self._value(F.col(names[0])) if len(names) == 1 else self._on(self.df.select(*self.travelling, *names))
        if len(names) == 1:
            was, c = self.names[names[0]], F.col(f"_as_{names[0]}")
            if was.kind == "vertex":
                out = self._on(self.df.select(*self.travelling, c.alias("id")), "vertex", labels=was.labels, loaded=False)
            elif was.kind == "value":
                out = self._value(c)
            else:
                out = self._on(self.df.select(*self.travelling, f"_as_{names[0]}.*"), was.kind, labels=was.labels, loaded=True)
            if by is None:
                return out
            own, column = out._by(by)
            return own._value(column)
        bys = by if isinstance(by, (list, tuple)) else [by] * len(names)
        df, columns = self.df, []
        for i, (name, own_by) in enumerate(zip(names, bys)):
            was, c = self.names[name], F.col(f"_as_{name}")
            if was.kind == "vertex" and own_by not in (None, T.id):
                side = self.graph.vertex_frame(was.labels).select(F.col("id").alias(f"~i{i}"), F.col("label" if own_by == T.label else own_by).alias(f"~v{i}"))
                df = df.join(side, F.col(f"_as_{name}") == F.col(f"~i{i}"))
                c = F.col(f"~v{i}")
            elif was.kind == "edge" and own_by is not None:
                c = c[own_by]
            columns.append(c.alias(name))
        return self._on(df.select(*self.travelling, *columns), "map", labels=None, loaded=True)

    def select_keys(self) -> Traversal:
        return self._value(F.map_keys("value") if self.kind == "value" else F.col("key"))

    def select_values(self) -> Traversal:
        return self._value(F.map_values("value") if self.kind == "value" else F.col("value"))

    # --- projections ---

    def id(self) -> Traversal:
        return self._value(F.col("id"))

    def label(self) -> Traversal:
        own = self.load()
        return own._value(F.col("label"))

    def key(self) -> Traversal:
        return self._value(F.col("key"))

    def value(self) -> Traversal:
        return self._value(F.col("value"))

    def _property_names(self) -> list[str]:
        return [c for c in self.load().object if c not in EDGE_KEYS]

    def values(self, *keys: str) -> Traversal:
        """Values of the properties, those of lists one by one; absent ones give nothing."""
        own = self.load()
        names = [k for k in (keys or self._property_names()) if k in own.df.columns]
        if not names:
            return own._value(F.lit(None).cast("string"))._on(own._value(F.lit(None).cast("string")).df.limit(0))
        parts = []
        for k in names:
            out = own._value(F.explode(k) if _is_array(own, k) else F.col(k))
            parts.append(out.df.where("value is not null"))
        if len({dict(p.dtypes)["value"] for p in parts}) > 1:
            parts = [p.withColumn("value", F.col("value").cast("string")) for p in parts]
        return own._on(union_all(parts), "value", labels=None, loaded=True)

    def properties(self, *keys: str) -> Traversal:
        """Rows of key and value (as text), one for each value, and the owner's id."""
        own = self.load()
        pairs = []
        for k in keys or self._property_names():
            if k in own.df.columns:
                v = F.col(k) if _is_array(own, k) else F.array(k)
                pairs.append(F.transform(v, _pair_with(k)))
        df = own.df.select(*own.travelling, F.col("id").alias("owner"), F.explode(F.concat(*pairs)).alias("~p")) if pairs else own.df.select(F.col("id").alias("owner")).limit(0)
        return own._on(df.select(*own.travelling, "owner", "~p.key", "~p.value").where("value is not null"), "property", loaded=True)

    def element(self) -> Traversal:
        """The vertex that a property belongs to."""
        return self._on(self.df.select(*self.travelling, F.col("owner").alias("id")), "vertex", loaded=False)

    def value_map(self, *keys: str) -> Traversal:
        """A map with a column for each property, its values as a list."""
        own = self.load()
        names = [k for k in (keys or self._property_names()) if k in own.df.columns]
        return own._on(own.df.select(*own.travelling, *(F.col(k) if _is_array(own, k) else F.when(F.col(k).isNotNull(), F.array(k)).alias(k) for k in names)), "map", loaded=True)

    def element_map(self, *keys: str) -> Traversal:
        """A map with id, label and single values; of edges also the ends."""
        own = self.load()
        names = [k for k in (keys or self._property_names()) if k in own.df.columns]
        head = ["id", "label", *(["src", "dst"] if self.kind == "edge" else [])]
        return own._on(own.df.select(*own.travelling, *head, *(F.get(k, 0).alias(k) if _is_array(own, k) else F.col(k) for k in names)), "map", loaded=True)

    def project(self, *names: str, by: list[Any]) -> Traversal:
        """A map with a column for each name: a property, a token, an expression or an inner traversal."""
        own, columns = self, []
        for name, b in zip(names, by):
            own, c = own._by(b)
            columns.append(c.alias(name))
        return own._on(own.df.select(*self.travelling, *columns), "map", labels=None, loaded=True)

    def map_(self, inner: Inner) -> Traversal:
        """The first result of the inner traversal."""
        own, c = self._joined(inner)
        return own._on(own.df.where(c.isNotNull()))._value(c)

    def flat_map(self, inner: Inner) -> Traversal:
        return self._flat(inner)

    def local(self, inner: Inner) -> Traversal:
        return self._flat(inner)

    def apply(self, f: Callable[[Column], Column]) -> Traversal:
        """A column function of the value; see skein.functions."""
        return self._value(f(F.col("value")))

    def constant(self, x: Any) -> Traversal:
        return self._value(F.lit(x))

    def math(self, expression: str, by: str | None = None) -> Traversal:
        """An arithmetic expression of `_`: digits, + - * / % ( ), and a few functions."""
        from skein.functions.maths import arithmetic

        own, c = self._by(by) if by else (self, F.col("value"))
        return own._value(arithmetic(expression, {"_": c}))

    def unfold(self) -> Traversal:
        """The items of a list one by one; entries of a map."""
        if self.kind == "map":
            return self._on(self.df.select(*self.travelling, F.struct(*self.object).alias("value")), "value")
        return self._value(F.explode("value"))

    def index(self) -> Traversal:
        """The items of a list with their places from 0: columns item and index."""
        return self._on(self.df.select(*self.travelling, F.posexplode("value").alias("index", "item")).select(*self.travelling, "item", F.col("index").cast("long").alias("index")), "map")

    # --- reducing steps ---

    def _reduced(self, *aggregates: Column, kind: str = "value", fill: dict[str, Any] | None = None) -> Traversal:
        """For each inner start, or for all. fill: values of starts without traversers."""
        if not self.keys:
            return self._on(self.df.agg(*aggregates), kind, labels=None, loaded=True, by_path=None)
        key = self.keys[-1]
        out = self.df.groupBy(*self.keys).agg(*aggregates)
        if fill is not None:
            out = self.starts.join(out, key, "left").fillna(fill) if not any(isinstance(v, Column) for v in fill.values()) else self.starts.join(out, key, "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})
        return self._on(out, kind, labels=None, loaded=True, by_path=None)

    def count(self) -> Traversal:
        own = self._counted()
        n = F.coalesce(F.sum("_n"), F.lit(0).cast("long")) if "_n" in own.df.columns else F.count("*")
        return own._reduced(n.alias("value"), fill={"value": 0})

    def _present(self, out: Traversal) -> Traversal:
        return out._on(out.df.where("value is not null"))

    def sum_(self) -> Traversal:
        return self._present(self._reduced(F.sum(F.col("value") * self._n()).alias("value")))

    def min_(self) -> Traversal:
        return self._present(self._reduced(F.min("value").alias("value")))

    def max_(self) -> Traversal:
        return self._present(self._reduced(F.max("value").alias("value")))

    def mean(self) -> Traversal:
        some = F.when(F.col("value").isNotNull(), self._n())
        return self._present(self._reduced((F.sum(F.col("value") * self._n()) / F.sum(some)).alias("value")))

    def count_local(self) -> Traversal:
        return self._value(F.size("value").cast("long"))

    def sum_local(self) -> Traversal:
        return self._value(F.aggregate("value", F.lit(0.0), lambda a, x: a + x))

    def min_local(self) -> Traversal:
        return self._value(F.array_min("value"))

    def max_local(self) -> Traversal:
        return self._value(F.array_max("value"))

    def mean_local(self) -> Traversal:
        return self._value(F.aggregate("value", F.lit(0.0), lambda a, x: a + x) / F.size("value"))

    def _listed(self, c: Column) -> Column:
        """An aggregate: the list of a column in the stream's order, or sorted."""
        if not self.ordering:
            return F.array_sort(F.collect_list(c))
        pairs = F.collect_list(F.when(c.isNotNull(), F.struct(*(F.col(k) for k, _ in self.ordering), c.alias("~v"))))

        def compare(x: Column, y: Column) -> Column:
            out = F.lit(0)
            for k, desc in reversed(self.ordering):
                less, more = (1, -1) if desc else (-1, 1)
                out = F.when(x[k] < y[k], less).when(x[k] > y[k], more).otherwise(out)
            return out

        return F.transform(F.array_sort(pairs, compare), lambda x: x["~v"])

    def fold(self, seed: Any = None, op: Callable[[Column, Column], Column] | None = None) -> Traversal:
        """All objects as one list, in the stream's order or sorted; with a seed and an operator, their reduction."""
        own = self._single()
        listed = own._reduced(own._listed(own._identity()).alias("value"), fill=None)
        if op is None:
            return listed
        return listed._value(F.aggregate("value", F.lit(seed), op))

    def group(self, by: Any = None, value: Any = None, reduce: Callable[[Column], Column] | None = None, within: Inner | None = None) -> Traversal:
        """A map of key and value: the values' reduction (F.sum, F.max…), or their list in the stream's
        order (sorted, without one). within: an inner traversal over each group's objects, whose
        first result is the value."""
        own, k = self._by(by)
        own = own._on(own.df.withColumn("~k", k))
        if within is not None:
            key = f"_key{int(self.keys[0][4:]) + 1 if self.keys else 1}"
            members = own._on(own.df.where(F.col("~k").isNotNull()).withColumnRenamed("~k", key), keys=(key,), starts=own.df.select(F.col("~k").alias(key)).where(F.col(key).isNotNull()).distinct())
            out = within(members)
            values = out._joined_to_key(key)
            return own._on(values.select(F.col(key).alias("key"), "value"), "map", labels=None, loaded=True, ordering=())
        own, v = own._by(value)
        agg = (reduce or own._listed)(v)
        out = own.df.where(F.col("~k").isNotNull()).groupBy(*self.keys, F.col("~k").alias("key")).agg(agg.alias("value"))
        return own._on(out, "map", labels=None, loaded=True)

    def _joined_to_key(self, key: str) -> DataFrame:
        """key and the first object of each."""
        own = self.df.select(key, *(c for c, _ in self.ordering), self._identity().alias("value"))
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*(self._ordering or ["value"])))
        return own.withColumn("~r", rank).where("`~r` = 1").select(key, "value")

    def group_count(self, by: Any = None) -> Traversal:
        own, k = self._by(by)
        n = F.sum("_n") if "_n" in own.df.columns else F.count("*")
        out = own.df.where(k.isNotNull()).groupBy(*self.keys, k.alias("key")).agg(n.alias("value"))
        return own._on(out, "map", labels=None, loaded=True)

    def store(self, name: str, by: Any = None) -> Traversal:
        """Keeps the objects seen here for cap(), and goes on."""
        own, c = self._by(by)
        return self._on(self.df, stores=self.stores | {name: own._value(c)})

    aggregate = store

    def group_count_as(self, name: str, by: Any = None) -> Traversal:
        return self._on(self.df, stores=self.stores | {name: self.group_count(by)})

    def cap(self, name: str) -> Traversal:
        """What store() or group_count_as() kept, as a stream of its own."""
        return self.stores[name]

    # --- order ---

    def order(self, *by: Any, desc: bool | list[bool] = False) -> Traversal:
        """By properties or inner traversals; a pair (by, "desc") turns one round. Objects without one
        go. What the stream is ordered by travels along until a reducing step."""
        own, columns = self._on(self.df.drop(*(c for c, _ in self.ordering)), ordering=()), []
        for i, b in enumerate(by or (None,)):
            down = desc
            if isinstance(b, tuple):
                b, down = b[0], b[1] == "desc"
            own, c = own._by(b)
            own = own._on(own.df.where(c.isNotNull()).withColumn(f"_ord{i}", c))
            columns.append((f"_ord{i}", bool(down)))
        df = own.df.orderBy(*(_sorted(F.col(c), down) for c, down in columns)) if not self.keys else own.df
        return own._on(df, ordering=tuple(columns))

    def order_shuffle(self, seed: int = 0) -> Traversal:
        return self._on(self.df.orderBy(F.rand(seed)))

    def order_local(self, desc: bool = False) -> Traversal:
        return self._value(F.sort_array("value", asc=not desc))

    # --- branches ---

    def union(self, *inner: Inner) -> Traversal:
        """All results of all branches; reducing steps in a branch see all traversers."""
        return _bag(self, [f(self) for f in inner])

    def coalesce(self, *inner: Inner) -> Traversal:
        """For each object the results of the first branch that has any."""
        left, parts = self, []
        for f in inner:
            parts.append(left._flat(f))
            left = left.not_(f)
        return _bag(self, parts)

    def optional(self, inner: Inner) -> Traversal:
        return self.coalesce(inner, lambda t: t)

    def choose(self, test: Inner | str, yes: Inner | None = None, no: Inner | None = None, options: dict[Any, Inner] | None = None) -> Traversal:
        """If the inner traversal has a result, yes, else no; or options by a property's value."""
        if options is not None:
            own, c = self._by(test)
            return _bag(self, [f(own._on(own.df.where(c == k))) for k, f in options.items()])
        return _bag(self, [yes(self.where(test)), (no or (lambda t: t))(self.not_(test))])

    # --- loops ---

    def repeat(self, step: Inner, times: int | None = None, until: Inner | None = None, emit: bool | Inner = False, until_first: bool = False, emit_first: bool = False) -> Traversal:
        """Applies a step again and again: so many times, or until an inner traversal has a result.

        With emit, what each round gives comes out too. Rows merge by multiplicity after each
        round, unless they differ in what travels along. Without times, rounds end when no
        traverser is left; some still on their way after MOST_ROUNDS, as on a cycle, are an error.
        """
        here, done = self, []
        plain = lambda t: t._on(t.df.select(*t.travelling, "id"), loaded=False) if t.kind == "vertex" else t
        if emit_first and emit:
            done.append(plain(here if emit is True else here.where(emit)))
        for k in range(MOST_ROUNDS if times is None else times):
            if until is not None and (until_first or k):
                done.append(plain(here.where(until)))
                here = here.not_(until)
            here = step(here).barrier()
            if times is None or k % 4 == 3:
                here = here._on(saved(here.df))
                if here.df.isEmpty():
                    break
                if times is None and k == MOST_ROUNDS - 1 and not (here if until is None else here.not_(until)).df.isEmpty():
                    raise RuntimeError(f"repeat: traversers are still on their way after {MOST_ROUNDS} rounds; give times to stop earlier")
                if len(done) > PARTS:
                    kept = _bag(self, done)
                    done = [kept._on(saved(kept.df))]
            if emit and not (times is not None and k == times - 1 and emit is True):
                done.append(plain(here if emit is True else here.where(emit)))
        if until is not None:
            done.append(plain(here.where(until)))
        elif times is not None and not (callable(emit) and emit):
            done.append(plain(here))
        return _bag(self, done)

    def match(self, *patterns: tuple[str, Inner, str]) -> Traversal:
        """Patterns (a, inner, b): the inner traversal leads from a to b. A map of all bindings, as ids
        or values, each as often as there are ways.

        The first pattern's a is an object of this stream. Another pattern starts from what is
        bound to its a already, or, if nothing is, from all vertices.
        """
        found: DataFrame | None = None
        kinds: dict[str, Traversal] = {patterns[0][0]: self}
        waiting = list(patterns)
        while waiting:
            at = next((i for i, (a, _, _) in enumerate(waiting) if a in kinds), 0)
            a, inner, b = waiting.pop(at)
            start = kinds.get(a) or self.graph.V()
            if found is None or a not in found.columns:
                start = start._on(start.df.select("id") if start.kind == "vertex" else start.df.select("value"), loaded=start.kind != "vertex")
            else:
                name = "id" if start.kind == "vertex" else "value"
                start = start._on(found.select(F.col(a).alias(name)).distinct(), loaded=start.kind != "vertex", labels=start.labels)
            start = replace(start, names={}, keys=(), starts=None, by_path=None, ordering=())
            out, key = start._inner(inner)
            out = out._single()
            pairs = out.df.select(F.col(key).alias(a), *([out._identity().alias(b)] if b != a else []))
            if b == a:
                pairs = out.df.where(F.col(key) == out._identity()).select(F.col(key).alias(a))
            if found is None and self.df.columns != ["id"]:
                pairs = self._single().df.select(self._identity().alias(a)).join(pairs, a)  # equal objects of the stream each
            kinds.setdefault(a, start)
            kinds.setdefault(b, out._on(out.df.limit(0), loaded=out.kind != "vertex") if out.kind != "vertex" else out)
            found = pairs if found is None else found.join(pairs, [c for c in dict.fromkeys((a, b)) if c in found.columns])
        return replace(self._on(found, "map", labels=None, loaded=True), names={}, by_path=None, ordering=())

    # --- ends ---

    def to_df(self) -> DataFrame:
        """The objects as a DataFrame, one row for each traverser."""
        own = self._single()
        if own.kind == "vertex" and not own.loaded:
            own = own.load()
        return own.df.select(*own.object)

    def to_list(self) -> list[Any]:
        rows = self.to_df().collect()
        return [r["value"] for r in rows] if self.kind == "value" else [r["id"] for r in rows] if self.kind in ("vertex", "edge") else [r.asDict(True) for r in rows]

    def subgraph(self) -> PropertyGraph:
        """The graph of the edges of this stream, and their ends."""
        ids = self.df.select("id").distinct()
        g = self.graph
        edges = {k: f.join(ids, "id", "left_semi") for k, f in g.edges.items() if not self.labels or k in self.labels}
        ends = union_all([f.select(F.col(c).alias("id")) for f in edges.values() for c in ("src", "dst")]).distinct()
        return replace(g, vertices={k: f.join(ends, "id", "left_semi") for k, f in g.vertices.items()}, edges=edges)

    def explain(self) -> None:
        """Prints Spark's plan."""
        self.df.explain("formatted")


def _is_array(t: Traversal, name: str) -> bool:
    return dict(t.df.dtypes).get(name, "").startswith("array")


def _pair_with(key: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(key).alias("key"), x.cast("string").alias("value"))


@dataclass(frozen=True, eq=False)
class _Side:
    """Stands for one of two columns, and tells by what operator they are compared."""

    first: bool

    def _made(self, other: Any, how: Callable) -> _Made:
        if not isinstance(other, _Side) or other.first == self.first:
            raise TypeError("not a comparison of the two")
        return _Made(how if self.first else TURNED[how])

    def __lt__(self, other):
        return self._made(other, operator.lt)

    def __le__(self, other):
        return self._made(other, operator.le)

    def __gt__(self, other):
        return self._made(other, operator.gt)

    def __ge__(self, other):
        return self._made(other, operator.ge)

    def __eq__(self, other):
        return self._made(other, operator.eq)

    def __ne__(self, other):
        return self._made(other, operator.ne)


@dataclass(frozen=True)
class _Made:
    how: Callable


def _operator_of(compare: Callable[[Any, Any], Any]) -> Callable | None:
    """The one operator that a function compares two columns by; None if it does anything else."""
    try:
        made = compare(_Side(True), _Side(False))
    except Exception:  # whatever a function of columns raises without columns
        return None
    return made.how if isinstance(made, _Made) else None


def _sorted(c: Column, desc: bool) -> Column:
    return c.desc() if desc else c.asc()


def _bag(start: Traversal, parts: list[Traversal]) -> Traversal:
    """All rows of several streams of one kind. Vertices are read anew only if one of them was."""
    if not parts:
        return start._on(start.df.limit(0))
    if {p.kind for p in parts} == {"vertex"} and not all(p.loaded for p in parts):
        parts = [p._on(p.df.select(*p.travelling, "id"), loaded=False) for p in parts]
    if any("_n" in p.df.columns for p in parts):
        parts = [p if "_n" in p.df.columns else p._on(p.df.withColumn("_n", F.lit(1).cast("long"))) for p in parts]
    labels = None if any(p.labels is None for p in parts) else tuple(dict.fromkeys(x for p in parts for x in p.labels))
    return parts[0]._on(union_all([p.df for p in parts]), labels=labels)
