"""Lookups in reference DataFrames as joins: one row for each document before and after.

Equality lookups reduce the table to the first row of each key and left join it; Catalyst sees plain
equality, and the table is broadcast only if its counted rows are few. CHOOSE is one such join for each pair. Lookups
by ranges or other conditions search the rows as an array where they are few. Larger tables are joined with the
distinct values looked up: by an equality among the conditions, or by bins of a range, with the other conditions as
a test; "at most" lookups by a sort within bins. Where the conditions have neither, every document is compared with every row,
which each task then reads as an array.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.config import EngineConfig
from ruleweave.functions import values as V
from ruleweave.functions.values import Val, num
from ruleweave.paths import dotted, segments
from ruleweave.plans.scope import Frame, Scope

INDEX = "_idx"
#: Tables of at most so many rows are searched as an array that is sent to every task.
ARRAY_ROWS = 5_000
#: Bins of about as many rows each, and levels of the tree over them.
LEVELS = 8
BINS = 1 << LEVELS


class JoinPlan:
    """Steps that add lookup columns to the documents. tables: name to DataFrame with an ``_idx`` column
    that numbers its rows from 0."""

    def __init__(self, df: DataFrame, tables: dict[str, DataFrame], config: EngineConfig) -> None:
        self.df, self.tables, self.config = df, tables, config
        self.made: dict[str, tuple[str, T.DataType]] = {}
        self.counts: dict[str, int] = {}
        self.added: list[str] = []

    def count(self, name: str) -> int:
        if name not in self.counts:
            self.counts[name] = self.tables[name].count()
        return self.counts[name]

    def _sized(self, name: str, side: DataFrame) -> DataFrame:
        return F.broadcast(side) if self.count(name) <= self.config.broadcast_rows else side

    def _row(self, name: str) -> T.StructType:
        return T.StructType([f for f in self.tables[name].schema if f.name != INDEX])

    def _column(self, kind: str) -> str:
        self.added.append(f"__{kind}{len(self.added)}")
        return self.added[-1]

    def rows(self, name: str) -> Val:
        """All rows, in order, as an array in every document; broadcast where they are few, else each task reads them."""
        kind = T.ArrayType(self._row(name))
        if (key := f"rows:{name}") not in self.made:
            at = self._column("rows")
            packed = self.tables[name].agg(F.array_sort(F.collect_list(F.struct(INDEX, F.struct(*self._row(name).names).alias("r")))).alias(at))
            packed = packed.select(F.transform(at, lambda x: x["r"]).alias(at))
            self.df = self.df.join(F.broadcast(packed) if self.count(name) <= ARRAY_ROWS else packed.hint("shuffle_replicate_nl"))
            self.made[key] = (at, kind)
        return Val(F.col(self.made[key][0]), kind)

    def last_row(self, name: str) -> Val:
        if (key := f"last:{name}") not in self.made:
            at = self._column("last")
            self.df = self.df.join(F.broadcast(self.tables[name].agg(F.max_by(F.struct(*self._row(name).names), INDEX).alias(at))))
            self.made[key] = (at, self._row(name))
        return Val(F.col(self.made[key][0]), self._row(name))

    def _cell(self, name: str, column: str) -> Val | None:
        schema = self._row(name)
        return Val(F.col(f"`{column}`"), schema[column].dataType) if column in schema.names else None

    def _keyed(self, name: str, pairs: list[tuple[Val, str]]) -> tuple[Column, str]:
        """Index and name of the struct column of the first row whose cells equal the values."""
        cells = [self._cell(name, c) for _, c in pairs]
        if None in cells:
            return F.lit(-1.0), ""
        at, side = self._column("hit"), self.tables[name]
        keys, probes = [], []
        for i, ((x, _), own) in enumerate(zip(pairs, cells, strict=True)):
            key, probe = _alike(own, x)
            keys.append((f"{at}k{i}", key))
            probes.append((f"{at}p{i}", probe))
        side = side.select(*[c.alias(k) for k, c in keys], INDEX, F.struct(*self._row(name).names).alias("r"))
        side = side.groupBy(*[k for k, _ in keys]).agg(F.min_by(F.struct(INDEX, "r"), INDEX).alias(at))
        base = self.df.withColumns(dict(probes))
        on = None
        for (k, _), (p, _) in zip(keys, probes, strict=True):
            test = F.col(p) == F.col(k)
            on = test if on is None else on & test
        self.df = base.join(self._sized(name, side), on, "left").drop(*[k for k, _ in keys], *[p for p, _ in probes])
        return F.coalesce(F.col(at)[INDEX].cast("double"), F.lit(-1.0)), at

    def index(self, name: str, how: tuple) -> Val:
        return num(self._search(name, how)[0], False)

    def _search(self, name: str, how: tuple) -> tuple[Column, str]:
        kind = how[0]
        if kind == "keys" and how[1]:
            return self._keyed(name, how[1])
        if kind == "any":
            hits = [self._keyed(name, [p])[0] for p in how[1]]
            some = [F.when(h >= 0, h) for h in hits]
            return F.coalesce(F.least(*some) if len(some) > 1 else some[0] if some else F.lit(None), F.lit(-1.0)), ""
        if kind == "range":
            return self._at_most(name, how[1], how[2]), ""
        if kind == "between" and self.count(name) > ARRAY_ROWS and how[1]:
            return self._between(name, how[1]), ""
        rows = self.rows(name)
        own = rows.type.elementType

        def test(r: Column) -> Column:
            out = F.lit(True)
            for lo, hi, x in how[1] if kind == "between" else []:
                low, high = (V.to_num(Val(r[c], own[c].dataType)) if c in own.names else F.lit(0.0) for c in (lo, hi))
                out = out & V.to_num(x).between(low, high)
            return out

        found = F.array_position(F.transform(rows.col, test), True) - 1
        return found.cast("double"), ""

    def _at_most(self, name: str, x: Val, column: str) -> Column:
        """First row whose cell is at most the value: only rows below all earlier ones can be first, and of these it is the
        greatest that is at most the value."""
        cell = self._cell(name, column)
        if cell is None:
            return F.lit(-1.0)
        at = self._column("least")
        part = self.tables[name].where(cell.col.isNotNull()).select(INDEX, V.to_num(cell).alias("x"))
        # a running minimum over all rows, by blocks: the least of each block first, then within blocks
        size = max(100_000, -(-self.count(name) // ARRAY_ROWS))  # so that there are few blocks
        blocks = part.withColumn("b", F.floor(F.col(INDEX) / size))
        before = blocks.groupBy("b").agg(F.min("x").alias("m"))
        order = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        before = before.withColumn("m", F.min("m").over(order))
        inside = Window.partitionBy("b").orderBy(INDEX).rowsBetween(Window.unboundedPreceding, -1)
        records = blocks.withColumn("own", F.min("x").over(inside)).join(F.broadcast(before), "b")
        records = records.where(F.coalesce(F.col("x") < F.least("own", "m"), F.lit(True))).select(INDEX, "x")
        if self.count(name) > ARRAY_ROWS and records.count() > ARRAY_ROWS:
            return self._latest(records, x)
        packed = records.agg(F.array_sort(F.collect_list(F.struct(INDEX, "x"))).alias(at))
        self.df = self.df.join(F.broadcast(packed))
        value = V.to_num(x)
        hits = F.filter(F.col(at), lambda r: r["x"] <= value)
        return F.coalesce(F.get(hits, F.lit(0))[INDEX].cast("double"), F.lit(-1.0))

    def _latest(self, records: DataFrame, x: Val) -> Column:
        """Index of the record with the greatest x that is at most the value: values and records are sorted together
        within bins, and each bin knows the last record below it."""
        at = self._column("least")
        place = _places(records, "x")
        tops = dict(records.groupBy(place(F.col("x")).alias("bin")).agg(F.max_by(INDEX, "x")).collect())
        below, last = [], None
        for b in range(BINS + 1):
            below.append(last)
            last = tops.get(b, last)
        probe = self.df.withColumn(f"{at}x", V.to_num(x))
        both = probe.select(F.col(f"{at}x").alias("x")).distinct().select(F.lit(None).cast("long").alias(INDEX), "x").unionByName(records)
        order = Window.partitionBy("bin").orderBy("x", F.col(INDEX).isNull())
        found = both.withColumn("bin", place(F.col("x"))).withColumn("hit", F.last(INDEX, ignorenulls=True).over(order)).where(f"{INDEX} is null")
        first = F.get(F.array(*[F.lit(b).cast("long") for b in below]), F.col("bin"))
        found = found.select(F.col("x").alias(f"{at}v"), F.coalesce("hit", first).alias(at))
        self.df = probe.join(found, F.col(f"{at}x") == F.col(f"{at}v"), "left").drop(f"{at}x", f"{at}v")
        return F.coalesce(F.col(at).cast("double"), F.lit(-1.0))

    def _between(self, name: str, ranges: list[tuple[str, str, Val]]) -> Column:
        """First row of a large table whose ranges hold the values."""
        from ruleweave.operators import boxes

        at, n = self._column("first"), len(ranges)
        cell = lambda c: V.to_num(self._cell(name, c) or Val(F.lit(0.0), T.DoubleType())).cast("double")
        own = [f"{at}x{i}" for i in range(n)]
        base = self.df.withColumns({c: V.to_num(x).cast("double") for c, (_, _, x) in zip(own, ranges, strict=True)})
        points = base.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(own)]).dropna().distinct()
        sides = [c.alias(f"{k}{i}") for i, (lo, hi, _) in enumerate(ranges) for k, c in (("lo", cell(lo)), ("hi", cell(hi)))]
        rows = self.tables[name].select(F.col(INDEX).cast("long").alias("i"), *sides).dropna()
        hits = boxes.first_boxes(points, rows, n, self.count(name) >= boxes.MANY_BOXES)
        hits = hits.withColumnsRenamed({f"x{i}": f"{at}v{i}" for i in range(n)} | {"at": at})
        same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{at}v{i}") for i, c in enumerate(own)])
        self.df = base.join(hits, same, "left").drop(*own, *[f"{at}v{i}" for i in range(n)])
        return F.coalesce(F.col(at).cast("double"), F.lit(-1.0))

    def _first(self, name: str, values: dict[str, Val], test, keys=None, span=None) -> Column:
        """First row that passes a test with values of the document. Rows and distinct values meet by equal keys, or
        where a span of the row holds a value: spans and values are given the nodes of a tree over bins, so that a row
        has few copies however wide its span. test, keys, span: functions of the row and the values."""
        at = self._column("first")
        own = {k: f"{at}{k}" for k in values}
        base = self.df.withColumns({own[k]: v.col for k, v in values.items()})
        held = {k: Val(F.col(own[k]), v.type) for k, v in values.items()}
        probe = base.select(*own.values()).distinct()
        side = self.tables[name].select(INDEX, F.struct(*self._row(name).names).alias("r"))
        if keys is not None:
            pairs = keys(F.col("r"), held)
            side = side.withColumns({f"{at}k{i}": k for i, (k, _) in enumerate(pairs)})
            probe = probe.withColumns({f"{at}q{i}": q for i, (_, q) in enumerate(pairs)})
            on = reduce(lambda x, y: x & y, [F.col(f"{at}k{i}") == F.col(f"{at}q{i}") for i in range(len(pairs))])
        else:
            lo, hi, x = span(F.col("r"), held)
            side = side.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
            place = _places(side, "lo")
            side = side.withColumns({"a": place(F.col("lo")), "b": place(F.col("hi"))}).withColumn(f"{at}k", F.explode(F.expr(_NODES_OF_SPAN)))
            probe = probe.withColumn("a", place(x)).withColumn(f"{at}q", F.explode(F.expr(_NODES_OF_PLACE)))
            on = F.col(f"{at}k") == F.col(f"{at}q")
            side, probe = side.drop("lo", "hi", "a", "b"), probe.drop("a")
        hits = probe.join(side, on).where(test(F.col("r"), held)).groupBy(*own.values()).agg(F.min(INDEX).alias(at))
        hits = hits.withColumnsRenamed({c: f"{c}v" for c in own.values()})
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}v")) for c in own.values()])
        self.df = base.join(hits, same, "left").drop(*own.values(), *[f"{c}v" for c in own.values()])
        return F.coalesce(F.col(at).cast("double"), F.lit(-1.0))

    def row_of(self, compiler, name: str, rule: Any, scope) -> Val:
        """The row at the index that a rule gives; a lookup in the same table gives its row at once."""
        from ruleweave.operators import lookups as L

        schema = self._row(name)
        head = next(iter(rule), None) if isinstance(rule, dict) else None
        given = rule[head] if head else None
        same = isinstance(given, list) and any(L.path_in(x) is not None and L.dotted(L.path_in(x)) == name for x in given[:2])
        if same and head in ("match", "MATCH") and len(given) > 1:
            index, at = self._keyed(name, L._pairs(compiler, given[1:], scope))
            return Val(F.col(at)["r"], schema) if at else V.NULL
        if same and head in ("indexat", "INDEXAT") and len(given) == 3:
            index, at = self._keyed(name, [(compiler.value(given[0], scope), L.column_name(compiler, given[2], scope))])
            return Val(F.col(at)["r"], schema) if at else V.NULL
        index = V.to_num(compiler.value(rule, scope))
        whole = Val(F.when(F.abs(index) < 9e18, F.when(index < 0, F.ceil(index)).otherwise(F.floor(index))).cast("long"), T.LongType())
        at, side = self._column("row"), self.tables[name].select(F.col(INDEX).alias("__i"), F.struct(*schema.names).alias("__r"))
        side = side.withColumnsRenamed({"__i": f"{at}i", "__r": at})
        self.df = self.df.withColumn(f"{at}p", whole.col).join(self._sized(name, side), F.col(f"{at}p") == F.col(f"{at}i"), "left").drop(f"{at}i", f"{at}p")
        return Val(F.col(at), schema)

    def find(self, compiler, name: str, conds: list, scope) -> Val:
        """FINDINDEX: equalities of a column with a value of the document become keys; else the rows are searched."""
        from ruleweave.operators import lookups as L

        schema = self._row(name)
        parts = self._conjuncts([L.condition(x) for x in conds])
        pairs = [self._equality(compiler, x, schema, scope) for x in parts]
        if pairs and None not in pairs:
            return self.index(name, ("keys", pairs))
        if self.count(name) > ARRAY_ROWS and (found := self._find_large(compiler, name, conds, parts, scope)) is not None:
            return num(found, False)
        return L.first_index(self.rows(name), L.row_test(compiler, conds, scope, schema))

    def _find_large(self, compiler, name: str, conds: list, parts: list, scope) -> Column | None:
        """FINDINDEX in a large table by an equality, or two bounds, among the conditions; all are tested on what meets."""
        from ruleweave.operators import lookups as L
        from ruleweave.plans.compiler import referenced

        schema, reads = self._row(name), {p: segments(p) for p in referenced(parts)}
        if any(not steps or dotted(p) in self.tables for p, steps in reads.items()):
            return None
        values = {p: v for p in reads if (v := scope.lookup(p)).kind != "null" and v.const is V.MISSING}
        names = {p: f"v{i}" for i, p in enumerate(values)}
        fixed = {".".join(reads[p]): scope.lookup(p) for p in reads if p not in values}

        def inner(held: dict[str, Val]) -> Scope:
            return Scope(_Held({".".join(reads[p]): held[names[p]] for p in values} | fixed), (), scope.config)

        sample = inner({n: values[p] for p, n in names.items()})
        same = [x for x in parts if self._equality(compiler, x, schema, sample) is not None]
        given = {names[p]: v for p, v in values.items()}
        test = lambda r, held: L.row_test(compiler, conds, inner(held), schema)(r)
        if same and given:

            def keys(r: Column, held: dict[str, Val]) -> list[tuple[Column, Column]]:
                out = []
                for x in same:
                    value, column = self._equality(compiler, x, schema, inner(held))
                    own = Val(r[column], schema[column].dataType)
                    out.append(_alike(own, value))
                return out

            return self._first(name, given, test, keys=keys)
        bounds = [b for x in parts if (b := self._bound(x, schema)) is not None]
        low, high = ([b for b in bounds if b[0] == side] for side in ("lo", "hi"))
        both = next(((a, b) for a in low for b in high if a[2] == b[2]), None)
        if both is None or not given:
            return None

        def span(r: Column, held: dict[str, Val]) -> tuple[Column, Column, Column]:
            lo, hi = (V.to_num(Val(r[b[1]], schema[b[1]].dataType)) for b in both)
            return lo, hi, V.to_num(compiler.value(both[0][2], inner(held)))

        return self._first(name, given, test, span=span)

    @staticmethod
    def _bound(x: Any, schema: T.StructType) -> tuple[str, str, Any] | None:
        """(lo or hi, column, value) of a condition by which a column bounds a value."""
        from ruleweave.operators import lookups as L
        from ruleweave.plans.compiler import referenced

        op = next(iter(x)) if isinstance(x, dict) and x else None
        if op not in ("<", "<=", ">", ">=") or len(x[op]) != 2:
            return None
        for (own, other), less in ((x[op], op[0] == "<"), (x[op][::-1], op[0] == ">")):
            path = L.path_in(own) if isinstance(own, dict) and "var" in own else None
            if path in schema.names and not set(referenced(other)) & set(schema.names):
                return ("lo" if less else "hi"), path, other
        return None

    @staticmethod
    def _conjuncts(rules: list) -> list:
        out = []
        for x in rules:
            out += JoinPlan._conjuncts(x["and"]) if isinstance(x, dict) and "and" in x else [x]
        return out

    @staticmethod
    def _equality(compiler, x: Any, schema: T.StructType, scope) -> tuple[Val, str] | None:
        from ruleweave.operators import lookups as L
        from ruleweave.plans.compiler import referenced

        if not (isinstance(x, dict) and next(iter(x)) in ("==", "===") and len(x[next(iter(x))]) == 2):
            return None
        sides = x[next(iter(x))]
        for own, other in (sides, sides[::-1]):
            path = L.path_in(own) if isinstance(own, dict) and "var" in own else None
            if path in schema.names and not set(referenced(other)) & set(schema.names):
                value = compiler.value(other, scope)
                strict = next(iter(x)) == "==="
                if strict and value.kind != Val(F.lit(None), schema[path].dataType).kind:
                    return None
                return value, path
        return None


def _alike(own: Val, x: Val) -> tuple[Column, Column]:
    """Keys that are equal where a cell and a value are loosely equal."""
    numeric = {x.kind, own.kind} & {"num", "bool"}
    as_key = (lambda v: v.col) if x.type == own.type else (_number_key if numeric else V.to_str)
    return as_key(own), as_key(x)


class _Held(Frame):
    """Values by their whole paths."""

    def find(self, steps: list[str]) -> Val | None:
        return self.names.get(".".join(steps))


#: A place among bins is in one node of each level: level * 2**20 + place >> level. A span of places a to b is the sum
#: of few nodes: those that stick out at its ends, level by level.
_NODES_OF_PLACE = f"transform(sequence(0, {LEVELS}), l -> l * 1048576L + shiftright(a, l))"
_NODES_OF_SPAN = f"""aggregate(sequence(0, {LEVELS}), named_struct('lo', cast(a as bigint), 'hi', b + 1L, 'out', cast(array() as array<bigint>)),
    (s, l) -> if(s.lo >= s.hi, s, named_struct('lo', (s.lo + s.lo % 2) div 2, 'hi', (s.hi - s.hi % 2) div 2, 'out',
        concat(s.out, if(s.lo % 2 = 1, array(l * 1048576L + s.lo), array()), if(s.hi % 2 = 1, array(l * 1048576L + s.hi - 1L), array())))), s -> s.out)"""


def _places(df: DataFrame, column: str):
    """A function from numbers to bins 0 to BINS that hold about as many rows each."""
    cuts = df.agg(F.percentile_approx(column, [i / BINS for i in range(1, BINS + 1)], 100 * BINS)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    return lambda x: F.size(F.filter(bounds, lambda b: b < x))


def _number_key(v: Val) -> Column:
    """The number by which loose equality compares; texts that are no numbers never match."""
    if v.kind == "str":
        return F.when(v.col == "", F.lit(0.0)).otherwise(V.parse_number(v.col))
    return v.col.cast("int").cast("double") if v.kind == "bool" else v.col.cast("double")


def numbered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A reference table with its rows numbered from 0 in the order given (else as read): small ids by
    counting the rows before each partition."""
    if INDEX in df.columns:
        return df
    if order:
        df = df.orderBy(*order)
    counts = dict(df.groupBy(F.spark_partition_id()).count().collect())
    before, starts = 0, []
    for part in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    first = F.get(F.array(*map(F.lit, starts or [0])), F.spark_partition_id())
    # the low 33 bits of these ids count the rows of a partition
    return df.withColumn(INDEX, first.cast("long") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
