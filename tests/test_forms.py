"""Schemas over documents: paths, order, validation, propagation, sub-forms, layout, sources."""

import json

import pytest
from pyspark.sql import functions as F

from ruleweave import paths
from ruleweave.config import EngineConfig, RuleError
from ruleweave.plans.engine import evaluate, run_json
from ruleweave.plans.joins import JoinPlan
from ruleweave.plans.schema import FormEngine, FormSchema


def ev(x):
    return {"$evaluation": x}


def v(x):
    return {"var": x}


@pytest.mark.parametrize(
    ("given", "pointer"),
    [("a.b", "/a/b"), ("#/a/b", "/a/b"), ("/a.b/c", "/a.b/c"), ("a//b", "/a/b"), ("", ""), ("/", ""), ("#", ""), ("a", "/a")],
)
def test_pointers(given, pointer):
    assert paths.to_pointer(given) == pointer


def test_schema_paths():
    assert paths.segments("#/properties/a/properties/b") == ["a", "b"]
    assert paths.data_pointer("#/properties/a/properties/b") == "/a/b"
    assert paths.schema_pointer("a.b") == "#/a/properties/b"
    assert paths.schema_pointer("$params.x.y") == "#/$params/x/y"
    assert paths.dotted("#/a/properties/b") == "a.b"


def test_order_and_cycles(spark):
    schema = {"properties": {"c": {"value": ev({"+": [v("b"), 1]})}, "b": {"value": ev({"+": [v("a"), 1]})}, "a": {"type": "number"}}}
    assert FormSchema.of(schema).batches() == [["b"], ["c"]]
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert [r.c for r in FormEngine(schema, df).evaluate().df.orderBy("a").collect()] == [3.0, 4.0]
    bad = {"properties": {"x": {"value": ev(v("y"))}, "y": {"value": ev(v("x"))}}}
    with pytest.raises(RuleError, match="Circular dependency"):
        FormSchema.of(bad).batches()


def test_nested_documents_params_context(spark):
    schema = {
        "$params": {"constants": {"RATE": 0.5}, "twice": ev({"*": [{"$ref": "$params.constants.RATE"}, 2]})},
        "properties": {"form": {"type": "object", "properties": {"age": {"type": "number"}, "fee": {"type": "number", "value": ev({"*": [v("form.age"), {"$ref": "$params.twice"}, v("$context.k")]})}}}},
    }
    df = spark.sql("select 1 as id, named_struct('age', 20, 'name', 'x') as form")
    e = FormEngine(schema, df, context={"k": 3}).evaluate()
    assert e.df.select("`form.fee`").first()[0] == 60.0


def test_validation(spark):
    schema = {"properties": {
        "email": {"type": "string", "rules": {"required": {"value": True, "message": "needed"}, "pattern": {"value": "^[^@]+@[^@]+$", "code": "P", "message": "bad mail"}}},
        "age": {"type": "number", "rules": {"minValue": {"value": 1}, "maxValue": {"value": ev({"+": [50, 50]})}}},
        "tags": {"type": "array", "rules": {"maxLength": {"value": 2}}},
        "off": {"type": "string", "condition": {"disabled": True}, "rules": {"required": {"value": True}}},
        "gone": {"type": "string", "condition": {"hidden": True}, "rules": {"required": {"value": True}}},
        "kin": {"type": "string", "rules": {"evaluation": {"value": [{"code": "K1", "message": "odd kin", "value": ev({"!=": [v("kin"), "self"]})}, {"code": "K2", "value": ev(False)}]}}},
    }}
    rows = [(1, "a@b", "50", ["x"], "", "", "self"), (2, "", "0", ["x", "y", "z"], "", "", "other"), (3, "nope", None, None, None, None, None), (4, "a@b", "101", [], "", "", "x")]
    df = spark.createDataFrame(rows, "id int, email string, age string, tags array<string>, off string, gone string, kin string")
    e = FormEngine(schema, df)
    got = {(r.id, r.field, r.type, r.code, r.message) for r in e.validate(["id"]).collect()}
    assert {g for g in got if g[1] != "kin"} == {
        (2, "email", "required", "email.required", "needed"), (2, "age", "minValue", "age.minValue", "Validation failed"), (2, "tags", "maxLength", "tags.maxLength", "Validation failed"),
        (3, "email", "pattern", "P", "bad mail"), (4, "age", "maxValue", "age.maxValue", "Validation failed"),
    }
    assert (1, "kin", "evaluation", "K1", "odd kin") in got and (2, "kin", "evaluation", "K2", "Validation failed") in got
    assert {r.id: r.n_errors for r in e.validation_summary(["id"]).collect()} == {1: 1, 2: 4, 3: 2, 4: 2}


def test_propagation_stops_on_cycles(spark):
    schema = {"properties": {
        "a": {"type": "string", "dependents": [{"$ref": "b", "value": ev({"cat": [{"$ref": "$value"}, "!"]})}]},
        "b": {"type": "string", "dependents": [{"$ref": "a", "value": ev({"$ref": "$value"})}, {"$ref": "c", "clear": ev({"==": [{"$ref": "$value"}, "x!"]})}]},
        "c": {"type": "string"},
    }}
    out = FormEngine(schema, spark.createDataFrame([("x", "o", "keep"), ("y", "o", "keep")], "a string, b string, c string")).dependents(["a"]).orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in out] == [("x", "x!", None), ("y", "y!", "keep")]
    assert [[(c.ref, c.transitive) for c in r.changes] for r in out] == [[("b", False), ("c", True)], [("b", False)]]


def test_changes_lead_on_only_where_something_changed(spark):
    schema = {"properties": {
        "a": {"type": "string", "dependents": [{"$ref": "b", "value": ev({"if": [{"==": [{"$ref": "$value"}, "x"]}, "new", ""]})}]},
        "b": {"type": "string", "dependents": [{"$ref": "c", "clear": True}]}, "c": {"type": "string"},
    }}
    df = spark.createDataFrame([("x", "o", "keep"), ("y", "o", "keep"), ("x", "new", "keep")], "a string, b string, c string")
    out = FormEngine(schema, df).dependents(["a"]).orderBy("a", "b", "c").collect()
    assert [(r.a, r.b, r.c, [(c.ref, c.transitive, c.clear) for c in r.changes]) for r in out] == [
        ("x", "new", None, [("b", False, False), ("c", True, True)]), ("x", "new", "keep", []), ("y", "o", "keep", []),
    ]
    # a target that is cleared and then given the value it had stays cleared, and leads on even if it was null
    schema = {"properties": {"a": {"type": "string", "dependents": [{"$ref": "b", "clear": True, "value": ev(v("$value"))}]}, "b": {"type": "string", "dependents": [{"$ref": "c", "clear": True}]}, "c": {"type": "string"}}}
    df = spark.createDataFrame([("x", "x", "c"), ("x", None, "c"), (None, None, "c")], "a string, b string, c string")
    out = FormEngine(schema, df).dependents(["a"]).collect()
    assert [(r.a, r.b, r.c, len(r.changes)) for r in out] == [("x", None, None, 2), ("x", "x", None, 2), (None, None, None, 2)]


def test_formulas_call_their_fields_back(spark):
    group = {
        "size": {"type": "number"}, "kind": {"type": "string"}, "label": {"type": "string"},
        "name": {"type": "string", "dependents": [{"$ref": "f.kind", "value": "never"}, {"$ref": "f.label", "value": ev({"cat": [{"$ref": "$value"}, v("f.size")]})}]},
    }
    df = spark.sql("select named_struct('size', 3.0D, 'kind', 'k', 'label', 'l', 'name', 'n') as f")
    e = FormEngine({"properties": {"f": {"type": "object", "properties": group}}}, df)
    r = e.dependents(["f.size"]).first()
    assert (r["f.kind"], r["f.label"], [(c.ref, c.value, c.transitive) for c in r.changes]) == ("k", "n3", [("f.label", "n3", True)])
    # the field itself runs all of its dependents, also after some were called back
    r = FormEngine({"properties": {"f": {"type": "object", "properties": group}}}, df).dependents(["f.name", "f.size"]).first()
    assert (r["f.kind"], r["f.label"]) == ("never", "n3")
    shown = e.described(e.df.select(F.explode("changes").alias("c")).select("c.*")).first()
    assert json.loads(shown.field_schema) == {"type": "string"} and json.loads(shown.parent_schema) == {"type": "object"}


def test_given_values_stay_where_they_are_the_users(spark):
    schema = {
        "$layout": {"elements": [{"$ref": "a"}, {"$ref": "off"}]},
        "properties": {"a": {"type": "string", "value": ev("comp")}, "off": {"type": "string", "value": ev("comp"), "condition": {"disabled": True}}, "free": {"type": "string", "value": ev("comp")}},
    }
    df = spark.createDataFrame([(1, "ab", "ab", "ab"), (2, None, None, None)], "id int, a string, off string, free string")
    got = FormEngine(schema, df).evaluate().schema_value(["id"]).orderBy("id").collect()
    assert [tuple(r.value) for r in got] == [("ab", "comp", "comp"), ("comp", "comp", "comp")]
    assert [(x.path, x.value) for x in FormEngine(schema, df).evaluate().schema_value(["id"], "array").orderBy("id").first().value][0] == ("a", "ab")


def test_fields_hidden_by_all_their_layout_elements(spark):
    rule = {"rules": {"required": {"value": True}}, "type": "string"}
    schema = {
        "$layout": {"elements": [{"condition": {"hidden": True}, "elements": [{"$ref": "a"}, {"$ref": "b"}]}, {"$ref": "b"}, {"$ref": "g"}, {"hideLayout": {"all": True}, "elements": [{"$ref": "d"}]}]},
        "properties": {"a": rule, "b": rule, "g": {"type": "object", "condition": {"hidden": ev({"==": [v("id"), 1]})}, "$layout": {"elements": [{"$ref": "g.c"}]}, "properties": {"c": rule}}, "d": rule},
    }
    df = spark.sql("select 1 as id, '' as a, '' as b, named_struct('c', 'x') as g, 'keep' as d union all select 2, '', '', named_struct('c', ''), ''")
    assert {(r.id, r.field) for r in FormEngine(schema, df).validate(["id"]).collect()} == {(1, "b"), (2, "b"), (2, "g.c")}
    laid = {(r.fullpath, r.path, r.hidden, r.parent_hide) for r in FormEngine(schema, df).layout(["id"]).where("id = 1").collect()}
    assert laid == {
        ("$layout.elements.0", "0", True, False), ("a", "a", True, True), ("b", "b", True, True), ("b", "b", False, False), ("g", "g", True, False), ("g.c", "c", True, True),
        ("$layout.elements.3", "3", True, False), ("d", "d", True, True),
    }
    from ruleweave.plans.schema import merged_layout

    merged = merged_layout(schema, FormEngine(schema, df).layout(["id"]).where("id = 1").collect())[""]
    assert merged[0]["elements"][0] == {"$ref": "a", "$fullpath": "a", "$path": "a", "$parentHide": True, "condition": {"hidden": True, "disabled": False}}
    assert merged[1]["condition"] == {"hidden": False, "disabled": False} and merged[2]["condition"]["hidden"] is True
    # what is hidden by conditions is emptied, what a hidden layout only does not show is not
    hidden = {r.id: (r["g.c"], r.d) for r in FormEngine(schema, df).hide().df.collect()}
    assert hidden == {1: (None, "keep"), 2: ("", "")}


@pytest.mark.parametrize(
    ("pattern", "text", "fits"),
    [("(?P<x>a)b", "ab", True), ("(?P<x>a)b", "ac", False), ("[", "any", True), ("(?=a)b", "x", True), (r"(a)\1", "b", True), ("a$", "a\n", False), ("^[$]$", "$", True), (r"^\d+$", "٣", True), ("a.b", "a\rb", True), ("(?m)a$", "a\nb", True)],
)
def test_patterns(spark, pattern, text, fits):
    e = FormEngine({"properties": {"t": {"type": "string", "rules": {"pattern": {"value": pattern}}}}}, spark.createDataFrame([(text,)], "t string"))
    assert (e.validate(["t"]).count() == 0) == fits


def test_refresh(spark):
    schema = {"properties": {
        "kind": {"type": "string", "dependents": [{"$ref": "size", "value": ev({"if": [{"==": [{"$ref": "$value"}, "big"]}, 10, 1]})}]},
        "size": {"type": "number", "rules": {"maxValue": {"value": 5}}},
        "double": {"type": "number", "value": ev({"*": [v("size"), 2]})},
        "fixed": {"type": "string", "value": "yes", "condition": {"disabled": True}},
        "extra": {"type": "string", "condition": {"hidden": ev({">": [v("size"), 5]})}},
        "rows": {"$table": [{"$repeat": [1, ev(v("size")), {"n": ev({"$ref": "$iteration"})}]}]},
    }}
    df = spark.createDataFrame([(1, "big", 3.0, "no", "e"), (2, "small", 3.0, "no", "e")], "id int, kind string, size double, fixed string, extra string")
    e = FormEngine(schema, df)
    got = {(r.id, r.ref): (r.value, r.cleared) for r in e.refresh(["kind"], ["id"]).collect()}
    assert got == {
        (1, "size"): ("10.0", False), (1, "double"): ("20.0", False), (1, "fixed"): ("yes", False), (1, "extra"): (None, True),
        (2, "size"): ("1.0", False), (2, "double"): ("2.0", False), (2, "fixed"): ("yes", False),
    }
    assert {r.id: len(r.rows) for r in e.df.collect()} == {1: 0, 2: 1}  # a size over 5 breaks its rule
    assert [r.size for r in e.at(["id"], ["size"]).orderBy("id").collect()] == [10.0, 1.0]
    flags = {(r.ref, r.readonly, r.hidden, r.transitive) for r in FormEngine(schema, df).refresh(["kind"], ["id"]).where("id = 1").collect()}
    assert flags == {("size", False, False, False), ("double", False, False, None), ("fixed", True, False, None), ("extra", False, True, None)}


def test_read_only_and_hidden_fields_lead_on(spark):
    schema = {"properties": {
        "go": {"type": "string"},
        "fixed": {"type": "string", "value": "yes", "condition": {"disabled": True}, "dependents": [{"$ref": "told", "value": ev({"cat": ["told ", {"$ref": "$value"}]})}]},
        "told": {"type": "string"},
        "extra": {"type": "string", "condition": {"hidden": ev({"==": [v("told"), "told yes"]})}, "dependents": [{"$ref": "last", "clear": True}]}, "last": {"type": "string"},
    }}
    df = spark.createDataFrame([(1, "", "no", "", "e", "l"), (2, "", "yes", "", "e", "l")], "id int, go string, fixed string, told string, extra string, last string")
    e = FormEngine(schema, df)
    got = {(r.id, r.ref, r.value) for r in e.refresh(["go"], ["id"]).collect()}
    assert got == {(1, "fixed", "yes"), (1, "told", "told yes"), (1, "extra", None), (1, "last", None), (2, "fixed", "yes")}
    assert {r.id: (r.told, r.extra, r["last"]) for r in e.df.collect()} == {1: ("told yes", None, None), 2: ("", "e", "l")}


def test_subform_items_and_layout(spark):
    schema = {
        "$params": {"LOAD": 2},
        "$layout": {"hideLayout": {"all": False}, "elements": [{"$ref": "#/properties/riders"}]},
        "properties": {"riders": {"type": "array", "items": {"type": "object", "properties": {"premium": {"type": "number"}, "loaded": {"type": "number", "value": ev({"*": [v("riders.premium"), {"$ref": "$params.LOAD"}]})}}}}},
    }
    df = spark.sql("select 1 as id, array(named_struct('premium', 10.0D), named_struct('premium', 20.0D)) as riders union all select 2, array()")
    e = FormEngine(schema, df)
    sub = e.subform("riders", ["id"]).evaluate()
    assert sorted((r["id"], r["_pos"], r["riders.loaded"]) for r in sub.df.collect()) == [(1, 0, 20.0), (1, 1, 40.0)]
    whole = {r.id: r.riders for r in e.with_items("riders", ["id"], sub).df.collect()}
    assert [x.loaded for x in whole[1]] == [20.0, 40.0] and whole[2] is None
    inside = {r.id: r.riders for r in FormEngine(schema, df).evaluate_items("riders").df.collect()}
    assert [x.loaded for x in inside[1]] == [20.0, 40.0] and inside[2] == []
    rows = {(r.id, r.fullpath, r.hidden) for r in sub.layout(["id"]).collect()}
    assert rows == set()


def test_generated_tables(spark):
    node = {"$table": [{"$repeat": [0, 2, {"PREM": ev({"$ref": "$iteration"})}]}, {"PREM": 9}]}
    e = FormEngine({"properties": {"t": node}}, spark.range(1)).evaluate()
    assert [r.PREM for r in e.df.first().t] == [0.0, 1.0, 2.0, 9.0]
    back = {"$table": [{"$repeat": [1, 0, {"x": 1}]}]}
    assert FormEngine({"properties": {"t": back}}, spark.range(1)).evaluate().df.first().t == []


def test_tables_that_read_both_ways_take_any_operator(spark):
    at = lambda by, c: {"VALUEAT": [v("t"), {"+": [{"$ref": "$iteration"}, by]}, c]}
    node = {"$table": [{"$repeat": [0, ev(v("n")), {
        "name": ev({"cat": [{"ifnull": [at(-1, "name"), "<"]}, {"$ref": "$iteration"}]}), "rest": ev({"cat": [{"$ref": "$iteration"}, {"ifnull": [at(1, "rest"), ">"]}]}),
        "kind": ev({"if": [{"in": ["2", {"var": "$rest"}]}, {"CONCAT": [{"var": "$name"}, "!"]}, "late"]}), "day": ev({"DATEFORMAT": ["2024-01-15", "iso"]}),
    }]}]}
    got = {r.n: [tuple(x) for x in r.t] for r in FormEngine({"properties": {"n": {"type": "number"}, "t": node}}, spark.createDataFrame([(3.0,), (0.0,), (-1.0,)], "n double")).evaluate().df.collect()}
    assert got == {
        3.0: [("<0", "0123>", "<0!", "2024-01-15"), ("<01", "123>", "<01!", "2024-01-15"), ("<012", "23>", "<012!", "2024-01-15"), ("<0123", "3>", "late", "2024-01-15")],
        0.0: [("<0", "0>", "late", "2024-01-15")], -1.0: [],
    }


def test_large_tables(spark, monkeypatch):
    import ruleweave.plans.joins as J

    columns = ["id as _idx", "cast(pmod(hash(id), 500) * 10 as double) as lo", "cast(pmod(hash(id), 500) * 10 + pow(2, id % 13) as double) as hi", "cast(id % 50 as string) as k", "cast(5000 - id * 3 as double) as falls"]
    table = spark.range(12_000).selectExpr(*columns)
    docs = spark.range(120).selectExpr("id", "if(id = 7, null, cast(id * 41.5 as double)) as x", "id % 60 as k", "named_struct('y', id * 7.0D) as deep")
    rules = {
        "at": {"MATCHRANGE": [v("t"), "lo", "hi", v("x")]}, "two": {"MATCHRANGE": [v("t"), "lo", "hi", v("x"), "lo", "hi", v("deep.y")]},
        "key": {"MATCH": [v("t"), v("k"), "k"]}, "low": {"INDEXAT": [v("x"), v("t"), "lo", True]}, "fall": {"INDEXAT": [v("x"), v("t"), "falls", True]},
        "mixed": {"FINDINDEX": [v("t"), ["==", {"$ref": "k"}, "k"], [">", v("x"), "lo"]]},
        "span": {"FINDINDEX": [v("t"), ["<=", {"$ref": "deep.y"}, "lo"], [">=", {"$ref": "deep.y"}, "hi"], ["!=", "3", "k"]]},
        "theta": {"FINDINDEX": [v("t"), [">", {"$ref": "x"}, "lo"], ["!=", "0", "k"]]},
        "options": {"length": [{"MAPOPTIONSIF": [v("t"), "k", "lo", [v("x"), ">=", "lo"]]}]}, "all": {"length": [{"MAPOPTIONS": [v("t"), "k", "lo"]}]},
    }
    with monkeypatch.context() as m:
        m.setattr(J, "ARRAY_ROWS", 20_000)
        few = sorted(map(tuple, evaluate(docs, rules, tables={"t": table}).collect()), key=str)
    many = evaluate(docs, rules, tables={"t": table}, config=EngineConfig(broadcast_rows=1))
    assert sorted(map(tuple, many.collect()), key=str) == few and len(few) == 120
    # against plain loops
    t, names = table.orderBy("_idx").collect(), evaluate(docs, rules, tables={"t": table}).columns
    for r in many.collect():
        x, y, k = r.x or 0.0, r.deep.y, r.k
        tests = {
            "at": lambda q: q.lo <= x <= q.hi, "two": lambda q: q.lo <= x <= q.hi and q.lo <= y <= q.hi, "low": lambda q: q.lo <= x, "fall": lambda q: q.falls <= x,
            "mixed": lambda q: q.k == str(k) and q.lo > x, "span": lambda q: q.lo <= y <= q.hi and q.k != "3", "theta": lambda q: q.lo > x and q.k != "0",
        }
        assert {n: next((q["_idx"] for q in t if f(q)), -1) for n, f in tests.items()} == {n: r[n] for n in tests}, r
        assert r.all == 12_000 and r.options == sum(x >= q.lo for q in t) and "at" in names
    assert JoinPlan(docs, {"t": table}, EngineConfig()).count("t") == 12_000


def test_numbered_tables(spark):
    from ruleweave.plans.joins import numbered

    t = spark.range(0, 1000, 1, 7).selectExpr("id", "cast(id as string) as name")
    assert numbered(t).where("_idx != id").count() == 0
    out = evaluate(spark.range(5), {"name": {"VALUEAT": [v("t"), {"+": [v("id"), 500]}, "name"]}}, tables={"t": t})
    assert sorted((r.id, r.name) for r in out.collect()) == [(i, str(i + 500)) for i in range(5)]


def test_sources(spark, tmp_path, capsys):
    from ruleweave.__main__ import main
    from ruleweave.sources.documents import parse_documents, read_documents, write_documents

    (tmp_path / "d.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    (tmp_path / "s.json").write_text(json.dumps({"properties": {"a": {"type": "number", "rules": {"maxValue": {"value": 1}}}, "c": {"value": ev({"+": [v("a"), 1]})}}}))
    df = read_documents(spark, str(tmp_path / "d.json"))
    write_documents(df, str(tmp_path / "out"))
    assert read_documents(spark, str(tmp_path / "out")).count() == 2
    texts = spark.createDataFrame([(1, '{"a": 5}'), (2, "broken")], "id int, j string")
    assert [r.a for r in parse_documents(texts, "j", "a int").orderBy("id").collect()] == [5, None]
    main(["-r", '{"+": [{"var": "a"}, 1]}', "-d", str(tmp_path / "d.json")])
    assert [json.loads(x)["result"] for x in capsys.readouterr().out.splitlines()] == [2, 3]
    main(["-s", str(tmp_path / "s.json"), "-d", str(tmp_path / "d.json")])
    assert [json.loads(x)["c"] for x in capsys.readouterr().out.splitlines()] == [2, 3]
    main(["-s", str(tmp_path / "s.json"), "-d", str(tmp_path / "d.json"), "--validate"])
    assert [json.loads(x)["code"] for x in capsys.readouterr().out.splitlines()] == ["a.maxValue"]


def test_command_line_compares_and_prints(spark, tmp_path, capsys):
    from ruleweave.__main__ import main

    (tmp_path / "d.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "s.json").write_text(json.dumps({"properties": {"a": {"type": "number"}, "c": {"value": ev({"+": [v("a"), 1]})}}}))
    (tmp_path / "ok.json").write_text('{"a": 1, "c": 2}\n{"a": 2, "c": 3}\n')
    (tmp_path / "bad.json").write_text('{"a": 1, "c": 2}\n{"a": 2, "c": 4}\n')
    given = ["-s", str(tmp_path / "s.json"), "-d", str(tmp_path / "d.json")]
    main([*given, "--compare", str(tmp_path / "ok.json"), "--no-output", "-i", "2", "--print-all"])
    shown = capsys.readouterr()
    printed = {k: x for line in shown.out.splitlines() for k, x in json.loads(line).items()}
    assert printed["sorted-evaluations"] == [["c"]] and printed["dependencies"] == {"c": []} and shown.err.count("iteration") == 2
    with pytest.raises(SystemExit):
        main([*given, "--compare", str(tmp_path / "bad.json"), "--compare-path", "c", "--no-output"])
    assert json.loads(capsys.readouterr().out) == {"document": 1, "expected": 4, "got": 3}


def test_messagepack(spark, tmp_path):
    from ruleweave.sources.msgpack import pack, read_msgpack, read_packed_schema, unpack, unpack_all

    x = {"a": [1, -1, 127, 128, -33, 2**40, 1.5, True, None], "é" * 40: "t" * 70_000, "deep": [{"k": i} for i in range(20)], "m": {str(i): i for i in range(17)}}
    assert unpack(pack(x)) == x and list(unpack_all(pack(1) + pack("b"))) == [1, "b"]
    # one of each kind, as the format's description writes them
    assert list(unpack_all(bytes.fromhex("cc80 cdffff ce00010000 d080 d18000 ca3fc00000 d90161 c40101 dc000101 de0001a16101 e0 c3".replace(" ", "")))) == [128, 65535, 65536, -128, -32768, 1.5, "a", "01", [1], {"a": 1}, -32, True]
    for bad in (b"\xdb\x00\x00", b"\xc1"):
        with pytest.raises(ValueError):
            unpack(bad)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp").write_bytes(pack({"id": 1, "x": 2.5}) + pack({"id": 2}))
    (tmp_path / "in" / "b.mp").write_bytes(pack({"id": 3, "x": 1}))
    got = read_msgpack(spark, str(tmp_path / "in"), "id int, x double").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (2, None), (3, 1.0)]
    (tmp_path / "s.mp").write_bytes(pack({"properties": {"y": {"value": ev({"*": [v("x"), 2]})}}}))
    e = FormEngine(read_packed_schema(spark, str(tmp_path / "s.mp")), spark.createDataFrame(got, "id int, x double")).evaluate()
    assert [r.y for r in e.df.orderBy("id").collect()] == [5.0, 0.0, 2.0]


def test_logic_store(spark):
    from ruleweave.plans.engine import LogicStore

    store = LogicStore()
    a = store.compile({"+": [v("x"), {"var": "y.z"}]})
    assert store.compile('{"+":[{"var":"x"},{"var":"y.z"}]}') == a == 1 and store.compile({"-": [v("x")]}) == 2 and store.reads(a) == ["x", "y.z"]
    with pytest.raises(RuleError):
        store.compile({"no such": 1})


def test_resolved_schema(spark):
    schema = {"$params": {"k": ev({"+": [1, 2]}), "list": [1, "a", None]}, "properties": {
        "a": {"type": "number", "title": "A \"x\""}, "b": {"type": "number", "value": ev({"*": [v("a"), 2]}), "condition": {"hidden": ev({">": [v("a"), 1]})}},
        "t": {"$table": [{"$repeat": [0, 1, {"i": ev({"$ref": "$iteration"}), "s": "x"}]}]}, "c": {"type": "string", "rules": {"minLength": {"value": ev({"+": [v("a"), 0.5]})}}},
    }}
    e = FormEngine(schema, spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, a double")).evaluate()
    got = {r.id: json.loads(r.schema) for r in e.resolved_schema(["id"]).collect()}
    assert got[2] == {"$params": {"k": 3, "list": [1, "a", None]}, "properties": {
        "a": {"type": "number", "title": "A \"x\""}, "b": {"type": "number", "value": 4, "condition": {"hidden": True}},
        "t": [{"i": 0.0, "s": "x"}, {"i": 1.0, "s": "x"}], "c": {"type": "string", "rules": {"minLength": {"value": 2.5}}},
    }}
    assert got[1]["properties"]["b"]["condition"] == {"hidden": False}
    assert {r.id: r.schema for r in e.resolved_schema(["id"], "b.value").collect()} == {1: "2", 2: "4"}
    assert set(json.loads(e.resolved_schema(["id"], params=False).first().schema)) == {"properties"}
    again = e.reload({"properties": {"b": {"value": ev({"-": [v("a")]})}}}).evaluate()
    assert [r.b for r in again.df.orderBy("id").collect()] == [-1.0, -2.0]


def test_custom_operator(spark):
    from pyspark.sql import types as T

    from ruleweave.plans.compiler import OPERATORS, register_operator

    register_operator("shout", lambda c: F.upper(c), T.StringType())
    try:
        assert run_json(spark, {"shout": [v("s")]}, {"s": "hi"}) == "HI"
    finally:
        del OPERATORS["shout"]


def test_cascade_formulas_once(spark):
    """What items read of the document is computed once a row; formulas do not multiply as they are nested."""
    v = lambda p: {"var": p}
    ev = lambda r: {"$evaluation": r}
    fields = {"cost": {"type": "number", "value": ev({"*": [v("lines.qty"), 2]})}, "share": {"type": "number", "value": ev({"-": [v("lines.cost"), v("form.top")]})}}
    top = {"type": "number", "value": ev({"reduce": [v("lines"), {"max": [v("accumulator"), {"ifnull": [v("current.cost"), 0]}]}, 0]})}
    schema = {"properties": {"form": {"type": "object", "properties": {"top": top}}, "lines": {"type": "array", "items": {"type": "object", "properties": {"qty": {"type": "number"}} | fields}}}}
    df = spark.createDataFrame([(1, [(3.0,), (5.0,)]), (2, []), (3, None)], "id int, lines array<struct<qty: double>>")
    out = FormEngine(schema, df).cascade().df.select("id", "lines")
    assert {r.id: None if r.lines is None else [(x.cost, x.share) for x in r.lines] for r in out.collect()} == {1: [(6.0, -4.0), (10.0, 0.0)], 2: [], 3: None}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2
