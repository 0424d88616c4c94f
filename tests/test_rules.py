"""Each operator's results on small documents, compiled together over one row."""

import math

import pytest

from ruleweave.config import EngineConfig, RuleError
from ruleweave.plans.compiler import Compiler, compile_rule, referenced
from ruleweave.plans.engine import evaluate, plain, run_json

DATA = {
    "a": 1, "n": 42, "neg": -7.5, "t": True, "f": False, "s": "abc", "num": "123", "empty": "", "u": "Hello 世界 🌍", "csv": "a,b,c,d,e",
    "numbers": [1, 2, 3, 4, 5], "none": [], "words": ["x", "y"], "d": "1990-05-15T10:30:00Z", "e": "2024-02-29", "o": {"b": {"c": 5}},
    "users": [{"name": "Mira", "age": 30, "active": True}, {"name": "Tarek", "age": 25, "active": False}, {"name": "Ines", "age": 35, "active": True}],
    "rates": [{"lo": 0, "hi": 25, "rate": 0.1}, {"lo": 26, "hi": 40, "rate": 0.2}, {"lo": 41, "hi": 60, "rate": 0.3}],
    "ids": [{"id": 100, "name": "A"}, {"id": 200, "name": "B"}, {"id": 300, "name": "C"}],
    "age": 99, "one": [7],
}
U = {"var": "users"}

CASES = [
    # variables and utilities
    ({"var": "a"}, 1), ({"var": "o.b.c"}, 5), ({"var": "/o/b/c"}, 5), ({"var": "#/o/properties/b/properties/c"}, 5), ({"var": ["gone", 9]}, 9),
    ({"$ref": "s"}, "abc"), ({"var": "numbers.1"}, 2), ({"var": "numbers.9"}, None), ({"missing": ["a", "gone", "o.x"]}, ["gone", "o.x"]),
    ({"missing": "gone"}, ["gone"]), ({"missing_some": [1, ["a", "gone"]]}, []), ({"missing_some": [2, ["a", "gone"]]}, ["gone"]),
    ({"return": {"k": 1}}, {"k": 1}), ({"EMPTY": None}, ""), ({"isempty": {"var": "empty"}}, True), ({"ISEMPTY": {"var": "none"}}, False),
    ({"ifnull": [{"var": "gone"}, 3]}, 3), ({"IFNULL": [{"var": "empty"}, "z"]}, "z"), ({"ifnull": [{"var": "a"}, 3]}, 1),
    # logic
    ({"and": [1, "x", 3]}, "3"), ({"and": [1, 0, 3]}, 0), ({"or": [0, 2]}, 2), ({"or": []}, False), ({"and": []}, True), ({"or": ["", {"var": "empty"}]}, ""),
    ({"!": {"var": "none"}}, True), ({"!": [{"!": [{"var": "a"}]}]}, 1), ({"not": 0}, True), ({"if": [{"var": "t"}, "y", "n"]}, "y"), ({"if": [0, 1, 2, 3, 4]}, 2),
    ({"xor": [True, False]}, True), ({"xor": [1, "x"]}, False),
    # comparison
    ({"==": [0, False]}, True), ({"==": [1, True]}, True), ({"==": ["", False]}, True), ({"==": ["0", 0]}, True), ({"==": ["abc", 0]}, False), ({"==": [None, {"var": "gone"}]}, True),
    ({"==": [0, None]}, False), ({"===": [1, "1"]}, False), ({"===": [1, 1]}, True), ({"!==": [1, "1"]}, True), ({"!=": [1, "1"]}, False),
    ({"<": ["abc", "abd"]}, False), ({"<=": ["abc", "abd"]}, True), ({">": [{"var": "num"}, 100]}, True), ({">=": [{"var": "gone"}, 0]}, True),
    # arithmetic
    ({"+": ["", 5]}, 5), ({"+": ["abc", 5]}, 5), ({"+": ["123", 5]}, 128), ({"+": [True, False]}, 1), ({"+": [[10, 20], 5]}, 5), ({"+": [{"var": "one"}, 1]}, 8), ({"+": []}, 0),
    ({"+": [" 12 ", 0]}, 0), ({"+": ["1d", 0]}, 0), ({"-": [5]}, -5), ({"-": [10, 3, 2]}, 5), ({"*": [2, {"*": [3, 4]}]}, 24), ({"*": []}, 0), ({"/": [10, 0]}, None),
    ({"/": [12, 3, 2]}, 2), ({"%": [-7, 3]}, -1), ({"%": [7, 0]}, None), ({"^": [2, 10]}, 1024), ({"**": [-1, 0.5]}, None), ({"pow": [2, 3]}, 8),
    ({"abs": [{"var": "neg"}]}, 7.5), ({"max": [1, "7", 3]}, 7), ({"min": []}, None),
    ({"round": 2.5}, 3), ({"round": -2.5}, -3), ({"round": [1.005, 2]}, 1.0), ({"ROUND": [1234.5, -2]}, 1200), ({"roundup": [2.131, 2]}, 2.14), ({"ROUNDDOWN": [2.139, 2]}, 2.13),
    ({"roundup": -2.5}, -2), ({"rounddown": -2.5}, -3), ({"CEILING": [7, 5]}, 10), ({"ceiling": [7, 0]}, 0), ({"floor": [7, 5]}, 5), ({"trunc": -2.7}, -2), ({"TRUNC": [2.789, 1]}, 2.7), ({"MROUND": [7, 5]}, 5),
    # text
    ({"cat": ["a", 1, None, True, 2.5]}, "a1true2.5"), ({"CONCAT": ["x", {"cat": ["y"]}]}, "xy"), ({"substr": ["hello", 1, 3]}, "ell"), ({"substr": ["hello", -3]}, "llo"), ({"substr": ["hello", 1, -2]}, ""),
    ({"left": ["hello", 2]}, "he"), ({"RIGHT": ["hello", 2]}, "lo"), ({"left": "hello"}, "h"), ({"mid": ["hello", 2, 3]}, "ell"), ({"MID": ["hello", 9, 3]}, ""), ({"left": [{"var": "u"}, 8]}, "Hello 世界"),
    ({"length": {"var": "u"}}, 17), ({"length": [{"var": "numbers"}]}, 5), ({"len": 123}, 3), ({"LEN": {"var": "u"}}, 17), ({"search": ["LL", "hello"]}, 3), ({"SEARCH": ["z", "hello"]}, None),
    ({"splittext": [{"var": "csv"}, ",", 2]}, "c"), ({"splittext": ["a.b", ".", 5]}, ""), ({"SPLITVALUE": ["a|b|", "|"]}, ["a", "b", ""]), ({"splitvalue": ["ab", ""]}, ["", "a", "b", ""]),
    ({"stringformat": [1234567.891, 2, "$", " USD"]}, "$1,234,567.89 USD"), ({"stringformat": [2.675, 2]}, "2.67"), ({"STRINGFORMAT": [2.5]}, "3"), ({"stringformat": [1234, 0, "", "", ""]}, "1234"),
    # dates
    ({"year": {"var": "d"}}, 1990), ({"MONTH": [{"var": "d"}]}, 5), ({"day": {"var": "d"}}, 15), ({"year": "nonsense"}, None), ({"days": ["2024-01-31", "2024-01-01"]}, 30),
    ({"date": [2024, 13, 1]}, "2025-01-01T00:00:00.000Z"), ({"DATE": [2024, 1, 32]}, "2024-02-01T00:00:00.000Z"), ({"date": [2024, 0, 1]}, "2023-12-01T00:00:00.000Z"), ({"date": [2024, -11, 1]}, None),
    ({"dateformat": ["2024-03-05", "us"]}, "03/05/2024"), ({"DATEFORMAT": ["2024-03-05", "%d %B %Y"]}, "05 March 2024"), ({"dateformat": "3/5/2024"}, "2024-03-05"), ({"dateformat": ["25/12/2024", "eu"]}, "25/12/2024"),
    ({"YEARFRAC": ["2024-01-01", "2024-12-31", 3]}, 1.0), ({"yearfrac": ["2024-01-01", "2024-07-01"]}, 182 / 360), ({"DATEDIF": ["2024-01-31", "2024-02-29", "M"]}, 0), ({"DATEDIF": ["2020-02-15", "2024-02-14", "y"]}, 3),
    ({"DATEDIF": ["2024-01-31", "2024-03-01", "MD"]}, 0), ({"datedif": ["2023-11-05", "2024-02-10", "YM"]}, 3), ({"DATEDIF": ["2023-11-05", "2024-02-10", "D"]}, 97), ({"DATEDIF": ["2024-01-01", "2024-02-01", "Q"]}, None),
    # arrays
    ({"map": [{"var": "numbers"}, {"*": [{"var": ""}, 2]}]}, [2, 4, 6, 8, 10]), ({"map": [{"var": "a"}, 1]}, []), ({"filter": [{"var": "numbers"}, {">": [{"var": ""}, 3]}]}, [4, 5]),
    ({"map": [{"filter": [U, {"var": "active"}]}, {"var": "name"}]}, ["Mira", "Ines"]), ({"map": [{"var": "numbers"}, {"var": "n"}]}, [None] * 5),
    ({"reduce": [{"var": "numbers"}, {"+": [{"var": "current"}, {"var": "accumulator"}]}, 0]}, 15), ({"reduce": [{"var": "gone"}, {"var": "current"}, 7]}, 7),
    ({"all": [{"var": "numbers"}, {">": [{"var": ""}, 0]}]}, True), ({"all": [{"var": "none"}, 1]}, True), ({"all": [{"var": "gone"}, 1]}, False), ({"some": [U, {"==": [{"var": "age"}, 25]}]}, True), ({"none": [{"var": "gone"}, 1]}, True),
    ({"merge": [[1, 2], 3, [4]]}, [1, 2, 3, 4]), ({"in": [3, {"var": "numbers"}]}, True), ({"in": ["3", {"var": "numbers"}]}, True), ({"in": ["bc", "abcd"]}, True), ({"in": [True, [1, 2]]}, True), ({"in": ["z", ["x", "y"]]}, False),
    ({"sum": [{"var": "numbers"}]}, 15), ({"SUM": [U, "age"]}, 90), ({"sum": [{"var": "numbers"}, "", 1]}, 3), ({"sum": [U, "age", 0]}, 30), ({"sum": 5}, 5),
    ({"FOR": [0, 3, {"*": [{"var": "$loopIteration"}, {"var": "n"}]}]}, [0, 42, 84]), ({"for": [3, 0, 1]}, []), ({"MULTIPLIES": [{"var": "numbers"}, 2]}, 240), ({"MULTIPLIES": [[]]}, None),
    ({"MULTIPLIES": [{"FOR": [1, 4, {"var": "$loopIteration"}]}]}, 6), ({"DIVIDES": [100, 0, 5]}, 20),
    # tables
    ({"VALUEAT": [U, 1, "name"]}, "Tarek"), ({"valueat": [U, 1]}, {"name": "Tarek", "age": 25, "active": False}), ({"VALUEAT": [U, 9, "name"]}, None), ({"VALUEAT": [U, -1, "name"]}, None), ({"VALUEAT": [{"var": "gone"}, 0]}, None),
    ({"MAXAT": [U, "age"]}, 35), ({"INDEXAT": [200, {"var": "ids"}, "id"]}, 1), ({"INDEXAT": [250, {"var": "ids"}, "id", True]}, 0), ({"INDEXAT": [50, {"var": "ids"}, "id", True]}, -1), ({"INDEXAT": ["200", {"var": "ids"}, "id"]}, 1),
    ({"MATCH": [U, "Tarek", "name", 25, "age"]}, 1), ({"MATCH": [U, "Tarek", "name", 30, "age"]}, -1), ({"MATCHRANGE": [{"var": "rates"}, "lo", "hi", 30]}, 1), ({"MATCHRANGE": [{"var": "rates"}, "lo", "hi", 90]}, -1),
    ({"CHOOSE": [U, "Zed", "name", 35, "age"]}, 2), ({"FINDINDEX": [U, ["==", "Ines", "name"]]}, 2), ({"FINDINDEX": [U, ["&&", "active", [">", 30, "age"]]]}, 2), ({"FINDINDEX": [U, {">": [{"var": "age"}, 98]}]}, -1),
    ({"FINDINDEX": [U, "active"]}, 0), ({"FINDINDEX": [U]}, 0), ({"FINDINDEX": [U, ["||", ["==", "Tarek", "name"], ["==", 35, "age"]]]}, 1),
    ({"VALUEAT": [{"var": "rates"}, {"MATCHRANGE": [{"var": "rates"}, "lo", "hi", 50]}, "rate"]}, 0.3), ({"RANGEOPTIONS": [1, 2]}, [{"label": "1", "value": "1"}, {"label": "2", "value": "2"}]), ({"RANGEOPTIONS": [2, 1]}, []),
    ({"MAPOPTIONS": [{"var": "ids"}, "name", "id"]}, [{"label": "A", "value": 100}, {"label": "B", "value": 200}, {"label": "C", "value": 300}]),
    ({"MAPOPTIONSIF": [{"var": "ids"}, "name", "id", 200, "==", "id"]}, [{"label": "B", "value": 200}]), ({"MAPOPTIONSIF": [{"var": "ids"}, "name", "id", [150, "<", "id"]]}, [{"label": "B", "value": 200}, {"label": "C", "value": 300}]),
]


@pytest.fixture(scope="module")
def results(spark):
    from ruleweave.functions.values import literal

    df = spark.range(1).select(literal(DATA).col.alias("d")).select("d.*")
    out = {}
    for at in range(0, len(CASES), 40):
        made = evaluate(df, {f"r{i}": CASES[i][0] for i in range(at, min(at + 40, len(CASES)))})
        row = made.select(*[c for c in made.columns if c[0] == "r" and c[1:].isdigit()]).first().asDict()
        out |= {k: plain(v) for k, v in row.items()}
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_operator(results, i):
    rule, expected = CASES[i]
    got = results[f"r{i}"]
    if isinstance(expected, float):
        assert math.isclose(got, expected, rel_tol=1e-12)
    else:
        assert got == expected and isinstance(got, bool) == isinstance(expected, bool)


def test_unknown_and_malformed(spark):
    with pytest.raises(RuleError, match="unknown"):
        run_json(spark, {"nope": 1})
    with pytest.raises(RuleError):
        run_json(spark, {"if": [1, 2]})
    with pytest.raises(RuleError):
        run_json(spark, {"==": [1, 2, 3]})
    deep = 1
    for _ in range(20):
        deep = {"!": [{"+": [deep]}]}
    with pytest.raises(RuleError, match="recursion"):
        Compiler(EngineConfig(recursion_limit=10)).value(deep, None)


def test_config(spark):
    assert run_json(spark, {"/": [1, 0]}, config=EngineConfig()) is None
    assert run_json(spark, {"^": [-1, 0.5]}, config=EngineConfig(safe_nan=True)) == 0
    fixed = EngineConfig(now="2024-03-01T20:00:00Z", timezone_minutes=420)
    assert run_json(spark, {"TODAY": None}, config=fixed) == "2024-03-02T00:00:00.000Z"
    assert run_json(spark, {"NOW": None}, config=fixed) == "2024-03-02T03:00:00Z"
    assert run_json(spark, {"+": [0.1, 0.2, -0.3]}, clean=True) == 0
    assert run_json(spark, {"var": "$context.rate"}, {"a": 1}, context={"$context": {"rate": 3}}) == 3


def test_referenced():
    rule = {"+": [{"var": "a.b"}, {"if": [{"missing": ["c"]}, {"$ref": "d"}, {"return": {"var": "x"}}]}]}
    assert referenced(rule) == ["a.b", "c", "d"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as double) as q", "id % 7 as k", "'x' as wide").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = df.where(compile_rule({"and": [{"<": [{"var": "q"}, 24]}, {">=": [{"var": "k"}, 3]}]}, df)).select("q")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(q),LessThan(q,24.0))" in plan and "GreaterThanOrEqual(k,3)" in plan
    assert "wide" not in plan.split("ReadSchema")[1]
    assert kept.count() == sum(1 for i in range(24) if i % 7 >= 3)


def test_boxes_against_pairs(spark, monkeypatch):
    """First boxes that hold points: each point compared with each box; narrow, wide, empty and odd boxes, full cells in parts."""
    import numpy as np
    from ruleweave.operators import boxes as B

    monkeypatch.setattr(B, "CELL_POINTS", 40)
    rng = np.random.default_rng(5)
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    for dims in (1, 2, 3):
        x = np.unique(np.concatenate([rng.integers(0, 600, (900, dims)) / 20, rng.choice([*odd, 7.0], (30, dims))]), axis=0)
        lo = np.concatenate([rng.integers(-50, 600, (7000, dims)) / 20, rng.choice(odd, (50, dims))])
        hi = np.concatenate([lo[:7000] + rng.choice([-0.5, 0.0, 0.5, 4.0, 30.0], (7000, dims), p=[0.1, 0.5, 0.3, 0.08, 0.02]), rng.choice(odd, (50, dims))])
        i = rng.permutation(len(lo))
        le = lambda a, b: (a <= b) | np.isnan(b)  # noqa: E731  NaN is above all others
        expected = {}
        for p in x:
            held = i[(le(lo, p) & le(p, hi)).all(axis=1)]
            if len(held):
                expected[tuple(map(repr, p + 0.0))] = held.min()
        points = spark.createDataFrame(x.tolist(), ", ".join(f"x{d} double" for d in range(dims))).distinct()
        names = "i long, " + ", ".join(f"lo{d} double, hi{d} double" for d in range(dims))
        rows = [(int(k), *[float(v) for pair in zip(a, b, strict=True) for v in pair]) for k, a, b in zip(i, lo, hi, strict=True)]
        out = B.first_boxes(points, spark.createDataFrame(rows, names), dims).collect()
        assert {tuple(repr(np.float64(v) + 0.0) for v in r[:dims]): r["at"] for r in out} == expected
        assert len(out) == len(expected) > 100


def test_many_boxes_deal_few(spark, monkeypatch):
    """Boxes of low indices come first; of the others only those that may hold a point that is left are dealt. Odd values too."""
    import numpy as np
    from ruleweave.operators import boxes as B

    monkeypatch.setattr(B, "MANY_BOXES", 1, raising=False)
    monkeypatch.setattr(B, "CELL_POINTS", 100)
    met, frame = [], type(spark.range(0))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, kind, *a, **b: (met.append((self, kind)), plain(self, f, kind, *a, **b))[1])
    rng = np.random.default_rng(11)
    le = lambda a, b: (a <= b) | np.isnan(b)  # noqa: E731  NaN is above all others
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    for dims, strange in ((1, True), (2, True), (3, True), (2, False)):
        n = 3000 if strange else 20_000
        x = rng.uniform(0, 1000, (2000, dims))
        price = rng.uniform(1, 1000, n)
        # as a price and its share more, and as a key and the price: points above the diagonal are never held
        lo, hi = np.stack([price, *[rng.uniform(0, 30, n)] * (dims - 1)], axis=1), np.stack([price * 1.02, *[price] * (dims - 1)], axis=1)
        if strange:
            x[:40], lo[:40], hi[-40:] = (rng.choice([*odd, 7.0], (40, dims)) for _ in range(3))
        x, i = np.unique(x, axis=0), rng.permutation(n) * 3
        expected = {}
        for p in x:
            held = i[(le(lo, p) & le(p, hi)).all(axis=1)]
            if len(held):
                expected[tuple(map(repr, p + 0.0))] = held.min()
        points = spark.createDataFrame(x.tolist(), ", ".join(f"x{d} double" for d in range(dims))).distinct()
        names = "i long, " + ", ".join(f"lo{d} double, hi{d} double" for d in range(dims))
        rows = [(int(k), *[float(v) for pair in zip(a, b, strict=True) for v in pair]) for k, a, b in zip(i, lo, hi, strict=True)]
        out = B.first_boxes(points, spark.createDataFrame(rows, names), dims).collect()
        assert {tuple(repr(np.float64(v) + 0.0) for v in r[:dims]): r["at"] for r in out} == expected
        assert len(out) == len(expected) > 100
    both, kind = met[-1]
    assert kind.endswith("at long") and both.where("i is not null").count() < n / 2
    assert B.first_boxes(points.where("x0 < 0"), spark.createDataFrame(rows, names), dims).collect() == []
