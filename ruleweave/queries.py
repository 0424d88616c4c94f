"""The engine's queries over the test tables, each with DuckDB SQL for the same rows.

Most are rules over one table: the keys, and a column for each rule. SQL is given column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.config import EngineConfig
from ruleweave.plans.engine import evaluate, is_in, keep
from ruleweave.plans.schema import FormEngine
from ruleweave.sources.session import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def v(path: str) -> dict:
    return {"var": path}


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents with an array of their lines."""
    # dealt by the order alone, so that both groupings share one shuffle
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), "l_quantity", "l_extendedprice", "l_returnflag")
    lines = lines.repartition("o_orderkey").groupBy("o_orderkey", "n").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.max("l_returnflag").alias("flag")
    )
    return lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "qty", "price", "flag"))).alias("items"))


_ITEMS_SQL = """(SELECT l_orderkey AS o_orderkey, l_linenumber AS n, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, max(l_returnflag) AS flag
FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _doclabels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


_DOCLABELS_SQL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"

#: Tables of documents for rules: how to read them, SQL for them, their keys.
BASES: dict[str, tuple[Query, str, list[str]]] = {
    "lineitem": (lambda s, d: table(s, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]),
    "orders": (lambda s, d: table(s, d, "orders"), "orders", ["o_orderkey"]),
    "customer": (lambda s, d: table(s, d, "customer"), "customer", ["c_custkey"]),
    "part": (lambda s, d: table(s, d, "part"), "part", ["p_partkey"]),
    "documents": (lambda s, d: table(s, d, "documents"), "documents", ["doc_id"]),
    "events": (lambda s, d: table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k")), "(SELECT *, json_extract_string(props, '$.k') AS k FROM events)", ["event_id"]),
    "doclabels": (_doclabels, _DOCLABELS_SQL, ["doc_id"]),
}


def rules(name: str, base: str, made: dict[str, tuple], config: EngineConfig | None = None) -> None:
    """Register a query of rules: column -> (rule, SQL)."""
    read, source, keys = BASES[base]

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = evaluate(read(spark, d), {c: r for c, (r, _) in made.items()}, config=config or EngineConfig())
        return df.select(*keys, *made)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{sql} AS {c}' for c, (_, sql) in made.items())} FROM {source} t"


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# variables and logic
rules("var_default", "doclabels", {"q": ({"var": ["quality", -1]}, "coalesce(quality, -1)::DOUBLE"), "gone": ({"var": ["no.such", "none"]}, "'none'")})
rules("missing_keys", "doclabels", {"n": ({"length": [{"missing": ["doc_id", "quality", "toxic", "zip"]}]}, "((quality IS NULL)::INT + (toxic IS NULL)::INT + 1)::DOUBLE")})
rules("missing_some", "doclabels", {"n": ({"length": [{"missing_some": [2, ["lang", "quality", "toxic"]]}]}, "CASE WHEN quality IS NULL AND toxic IS NULL THEN 2.0 WHEN quality IS NULL OR toxic IS NULL THEN 0.0 ELSE 0.0 END")})
rules("return_raw", "customer", {"label": ({"return": "fixed"}, "'fixed'"), "n": ({"return": 7}, "7.0")})
rules("isempty_empty", "doclabels", {"e": ({"isempty": [v("quality")]}, "quality IS NULL"), "x": ({"EMPTY": []}, "''")})
rules("ifnull", "doclabels", {"q": ({"ifnull": [v("quality"), 9]}, "coalesce(quality, 9)::DOUBLE")})
rules("and_or_value", "lineitem", {
    "a": ({"and": [v("l_tax"), v("l_quantity")]}, "CASE WHEN l_tax = 0 THEN l_tax + 0.0 ELSE l_quantity END"),
    "o": ({"or": [v("l_tax"), 0.5]}, "CASE WHEN l_tax <> 0 THEN l_tax ELSE 0.5 END"),
})
rules("not_double", "lineitem", {"n": ({"!": [v("l_tax")]}, "l_tax = 0"), "nn": ({"!": [{"!": [v("l_quantity")]}]}, "l_quantity")})
rules("if_band", "lineitem", {"band": ({"if": [{"<": [v("l_quantity"), 10]}, "small", {"if": [{"<": [v("l_quantity"), 30]}, "medium", "large"]}]}, "CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END")})
rules("xor_flags", "lineitem", {"x": ({"xor": [{"==": [v("l_returnflag"), "R"]}, {"==": [v("l_linestatus"), "F"]}]}, "(l_returnflag = 'R') <> (l_linestatus = 'F')")})

# comparison and arithmetic
rules("eq_loose", "events", {"e": ({"==": [v("k"), 50]}, "coalesce(k::DOUBLE = 50, false)"), "s": ({"==": [v("event_type"), "click"]}, "event_type = 'click'"), "n": ({"!=": [v("k"), "50"]}, "k IS NULL OR k <> '50'")})
rules("eq_strict", "events", {"e": ({"===": [v("k"), 50]}, "false"), "s": ({"===": [v("k"), "50"]}, "coalesce(k = '50', false)"), "n": ({"!==": [v("event_type"), "view"]}, "event_type <> 'view'")})
rules("cmp_numeric", "events", {
    "lt": ({"<": [v("k"), 40]}, "coalesce(k::DOUBLE, 0) < 40"), "le": ({"<=": [v("value"), v("k")]}, "value <= coalesce(k::DOUBLE, 0)"),
    "gt": ({">": [v("event_type"), "a"]}, "false"), "ge": ({">=": [v("user_id"), 100]}, "user_id >= 100"),
})
rules("add", "lineitem", {"x": ({"+": [v("l_quantity"), {"+": [v("l_tax"), "5"]}, True]}, "0.0 + l_quantity + l_tax + 5.0 + 1.0")})
rules("sub_unary", "lineitem", {"x": ({"-": [v("l_quantity"), v("l_discount"), 1]}, "l_quantity - l_discount - 1"), "u": ({"-": [v("l_quantity")]}, "-l_quantity")})
rules("mul", "lineitem", {"x": ({"*": [v("l_extendedprice"), {"-": [1, v("l_discount")]}]}, "l_extendedprice * (1 - l_discount)")})
rules("div_zero_null", "lineitem", {"x": ({"/": [v("l_extendedprice"), v("l_tax")]}, "CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END")})
rules("mod_trunc", "customer", {"x": ({"%": [v("c_acctbal"), 7]}, "c_acctbal % 7"), "k": ({"%": [{"-": [v("c_custkey")]}, 5]}, "(-c_custkey::DOUBLE) % 5.0")})
rules("pow", "part", {"x": ({"^": [v("p_size"), 2]}, "pow(p_size::DOUBLE, 2)"), "bad": ({"**": [{"-": [v("p_size")]}, 0.5]}, "NULL::DOUBLE")})
rules("abs", "customer", {"x": ({"abs": [v("c_acctbal")]}, "abs(c_acctbal)")})
rules("min_max", "lineitem", {"hi": ({"max": [v("l_quantity"), v("l_linenumber"), 3]}, "greatest(l_quantity, l_linenumber::DOUBLE, 3.0)"), "lo": ({"min": [v("l_quantity"), "20"]}, "least(l_quantity, 20.0)")})


def _half(x: str) -> str:
    return f"(sign({x}) * (floor(abs({x})) + CASE WHEN abs({x}) - floor(abs({x})) >= 0.5 THEN 1.0 ELSE 0.0 END) + 0.0)"


_BAL = "(c_acctbal * 100.0)"
rules("round_pos_neg", "customer", {"r": ({"round": v("c_acctbal")}, _half("c_acctbal")), "h": ({"ROUND": [v("c_acctbal"), 1]}, f"{_half('(c_acctbal * 10.0)')} / 10.0"), "t": ({"round": [v("c_acctbal"), -2]}, f"{_half('(c_acctbal * 0.01)')} / 0.01")})
rules("roundup", "customer", {"r": ({"roundup": [v("c_acctbal"), 1]}, "(ceil(c_acctbal * 10.0) + 0.0) / 10.0 + 0.0")})
rules("rounddown", "customer", {"r": ({"ROUNDDOWN": [v("c_acctbal"), 1]}, "floor(c_acctbal * 10.0) / 10.0")})
rules("ceiling_sig", "customer", {"r": ({"CEILING": [v("c_acctbal"), 50]}, "ceil(c_acctbal / 50) * 50 + 0.0")})
rules("floor_sig", "customer", {"r": ({"floor": [v("c_acctbal"), 50]}, "floor(c_acctbal / 50) * 50")})
rules("trunc", "customer", {"r": ({"trunc": [v("c_acctbal"), 1]}, "(sign(c_acctbal * 10.0) * floor(abs(c_acctbal * 10.0)) + 0.0) / 10.0")})
rules("mround", "customer", {"r": ({"MROUND": [v("c_acctbal"), 25]}, f"{_half('(c_acctbal / 25.0)')} * 25.0")})

# text
rules("cat", "part", {"x": ({"cat": [v("p_brand"), "/", v("p_size"), "/", True, None]}, "p_brand || '/' || p_size || '/true'")})
rules("concat", "part", {"x": ({"CONCAT": [v("p_name"), " ", {"cat": [v("p_type"), "."]}]}, "p_name || ' ' || p_type || '.'")})
rules("substr", "part", {"x": ({"substr": [v("p_name"), 2, 4]}, "substring(p_name, 3, 4)"), "e": ({"substr": [v("p_name"), -3]}, "right(p_name, 3)")})
rules("left", "documents", {"x": ({"LEFT": [v("text"), 7]}, "left(text, 7)")})
rules("right", "documents", {"x": ({"right": [v("text"), 5]}, "right(text, 5)"), "one": ({"RIGHT": v("lang")}, "right(lang, 1)")})
rules("mid", "documents", {"x": ({"MID": [v("text"), 3, 6]}, "substring(text, 3, 6)")})
rules("length_bytes", "documents", {"n": ({"length": v("text")}, "strlen(text)::DOUBLE")})
rules("len", "documents", {"n": ({"LEN": [v("n_chars")]}, "strlen(n_chars::VARCHAR)::DOUBLE"), "t": ({"len": v("text")}, "strlen(text)::DOUBLE")})
rules("search", "part", {"at": ({"SEARCH": ["A", v("p_name")]}, "CASE WHEN position('a' IN lower(p_name)) > 0 THEN position('a' IN lower(p_name))::DOUBLE END"),
                         "after": ({"SEARCH": ["É", {"cat": ["aé-", v("p_name")]}]}, "2.0"), "bytes": ({"SEARCH": ["-", {"cat": ["aé-", v("p_name")]}]}, "4.0")})
rules("splittext", "part", {"x": ({"SPLITTEXT": [v("p_name"), " ", 1]}, "coalesce(string_split(p_name, ' ')[2], '')")})
rules("splitvalue", "part", {"n": ({"length": [{"SPLITVALUE": [v("p_name"), " "]}]}, "len(string_split(p_name, ' '))::DOUBLE"), "has": ({"in": ["large", {"SPLITVALUE": [v("p_name"), " "]}]}, "list_contains(string_split(p_name, ' '), 'large')"), "parts": ({"SPLITVALUE": [v("p_type"), "A"]}, "string_split(p_type, 'A')")})
rules("stringformat", "orders", {"x": ({"STRINGFORMAT": [v("o_totalprice"), 0, "$", "", ","]}, "'$' || format('{:,}', round(o_totalprice)::BIGINT)"), "two": ({"STRINGFORMAT": [{"/": [v("o_totalprice"), 8]}, 2]}, "format('{:,.2f}', o_totalprice / 8)")})

# dates
_F = EngineConfig(now="2024-03-01T12:30:00Z", timezone_minutes=420)
rules("today_fixed", "customer", {"x": ({"TODAY": None}, "'2024-03-01T00:00:00.000Z'")}, _F)
rules("now_fixed", "customer", {"x": ({"NOW": None}, "'2024-03-01T19:30:00Z'")}, _F)
rules("year_month_day", "orders", {"y": ({"year": v("o_orderdate")}, "year(o_orderdate)::DOUBLE"), "m": ({"MONTH": v("o_orderdate")}, "month(o_orderdate)::DOUBLE"), "d": ({"day": [v("o_orderdate")]}, "day(o_orderdate)::DOUBLE")})
rules("date_normalize", "orders", {"x": ({"DATE": [{"year": v("o_orderdate")}, {"+": [{"month": v("o_orderdate")}, 14]}, 40]},
      "strftime(make_date(year(o_orderdate), 1, 1) + to_months((month(o_orderdate) + 13)::INT) + INTERVAL 39 DAY, '%Y-%m-%dT00:00:00.000Z')")})
rules("days", "lineitem", {"n": ({"DAYS": [v("l_shipdate"), "1995-06-17"]}, "date_diff('day', DATE '1995-06-17', l_shipdate::DATE)::DOUBLE")})
rules("dateformat_named", "orders", {"us": ({"dateformat": [v("o_orderdate"), "us"]}, "strftime(o_orderdate, '%m/%d/%Y')"), "long": ({"DATEFORMAT": [v("o_orderdate"), "long"]}, "strftime(o_orderdate, '%B %d, %Y')"), "own": ({"dateformat": [v("o_orderdate"), "%Y.%j"]}, "strftime(o_orderdate, '%Y.%j')")})
_NAMED_SQL = {"short": "%m/%d/%Y", "long": "%B %d, %Y", "iso": "%Y-%m-%d", "us": "%m/%d/%Y", "eu": "%d/%m/%Y", "full": "%A, %B %d, %Y", "monthday": "%B %d", "yearmonth": "%Y-%m", "ddmmyyyy": "%d/%m/%Y",
              "mmddyyyy": "%m/%d/%Y", "yyyymmdd": "%Y-%m-%d", "dd-mm-yyyy": "%d-%m-%Y", "mm-dd-yyyy": "%m-%d-%Y", "yyyy-mm-dd": "%Y-%m-%d", "dd.mm.yyyy": "%d.%m.%Y"}
rules("dateformat_all_named", "orders", {f"f{i}": ({"dateformat": [v("o_orderdate"), n]}, f"strftime(o_orderdate, '{f}')") for i, (n, f) in enumerate(_NAMED_SQL.items())})


@query("dateformat_by_column", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, 'day %j of ''%Y''') ELSE strftime(o_orderdate, '100%% %-d.%-m. %A') END AS x FROM orders")
def dateformat_by_column(spark: SparkSession, d: str) -> DataFrame:
    style = F.element_at(F.array(F.lit("EU"), F.lit("day %j of '%Y'"), F.lit("100%% %-d.%-m. %A")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    docs = table(spark, d, "orders").select("o_orderkey", "o_orderdate", style.alias("style"))
    return evaluate(docs, {"x": {"dateformat": [v("o_orderdate"), v("style")]}}).select("o_orderkey", "x")


rules("yearfrac_bases", "orders", {f"b{b}": ({"YEARFRAC": ["1992-01-01", v("o_orderdate"), b]}, f"date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / {d}") for b, d in ((0, "360.0"), (1, "365.25"), (2, "360.0"), (3, "365.0"), (4, "360.0"))})
rules("datedif_units", "orders", {
    "d": ({"DATEDIF": ["1992-01-15", v("o_orderdate"), "D"]}, "date_diff('day', DATE '1992-01-15', o_orderdate::DATE)::DOUBLE"),
    "m": ({"DATEDIF": ["1992-01-15", v("o_orderdate"), "M"]}, "((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 - (day(o_orderdate) < 15)::INT)::DOUBLE"),
    "y": ({"DATEDIF": ["1992-01-15", v("o_orderdate"), "Y"]}, "(year(o_orderdate) - 1992 - (month(o_orderdate) = 1 AND day(o_orderdate) < 15)::INT)::DOUBLE"),
    "ym": ({"DATEDIF": ["1992-01-15", v("o_orderdate"), "YM"]}, "(((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 - (day(o_orderdate) < 15)::INT) % 12)::DOUBLE"),
    "yd": ({"DATEDIF": ["1992-01-15", v("o_orderdate"), "YD"]}, "date_diff('day', make_date(year(o_orderdate) - (month(o_orderdate) = 1 AND day(o_orderdate) < 15)::INT, 1, 15), o_orderdate::DATE)::DOUBLE"),
    "md": ({"DATEDIF": ["1992-01-15", v("o_orderdate"), "MD"]}, "(CASE WHEN day(o_orderdate) < 15 THEN day(o_orderdate) + 15 ELSE day(o_orderdate) - 15 END)::DOUBLE"),
})


@query("date_parse_formats", "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS a, month(o_orderdate)::DOUBLE AS b, day(o_orderdate)::DOUBLE AS c FROM orders")
def date_parse_formats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", *[F.date_format("o_orderdate", f).alias(n) for n, f in (("x", "yyyy/M/d"), ("y", "MM/dd/yyyy"), ("z", "yyyy-MM-dd'T'HH:mm:ss"))])
    return evaluate(o, {"a": {"year": v("x")}, "b": {"month": v("y")}, "c": {"day": v("z")}}).select("o_orderkey", "a", "b", "c")


# arrays
def items(name: str, made: dict[str, tuple]) -> None:
    """Rules over the lines of an order; SQL aggregates over them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return evaluate(_items(spark, d), {c: r for c, (r, _) in made.items()}).select("o_orderkey", *made)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT o_orderkey, {', '.join(f'{sql} AS {c}' for c, (_, sql) in made.items())} FROM {_ITEMS_SQL} GROUP BY o_orderkey"


_I = v("items")
items("map", {"x": ({"sum": [{"map": [_I, {"*": [v("qty"), 2]}]}]}, "sum(qty * 2)")})
items("filter", {"n": ({"length": [{"filter": [_I, {">": [v("qty"), 20]}]}]}, "count(*) FILTER (qty > 20)::DOUBLE")})
items("reduce", {"x": ({"reduce": [_I, {"max": [v("accumulator"), v("current.qty")]}, 0]}, "greatest(0.0, max(qty))")})
items("all_some_none", {"a": ({"all": [_I, {">": [v("qty"), 5]}]}, "bool_and(qty > 5)"), "s": ({"some": [_I, {">": [v("qty"), 45]}]}, "bool_or(qty > 45)"), "n": ({"none": [_I, {"==": [v("flag"), "R"]}]}, "NOT bool_or(flag = 'R')")})
items("merge", {"n": ({"length": [{"merge": [{"map": [_I, v("qty")]}, {"map": [_I, v("n")]}, 1]}]}, "(2 * count(*) + 1)::DOUBLE"), "s": ({"sum": [{"merge": [{"map": [_I, v("qty")]}, {"map": [_I, v("n")]}, 1]}]}, "sum(qty) + sum(n) + 1.0")})
items("in_array", {"x": ({"in": ["R", {"map": [_I, v("flag")]}]}, "bool_or(flag = 'R')"), "y": ({"in": ["7", {"map": [_I, v("n")]}]}, "bool_or(n = 7)")})
rules("in_string", "part", {"x": ({"in": ["an", v("p_name")]}, "contains(p_name, 'an')"), "y": ({"in": [v("p_size"), [1, 5, 9]]}, "p_size IN (1, 5, 9)")})
items("sum_field_threshold", {"x": ({"sum": [_I, "qty", 1]}, "coalesce(arg_min(qty, n), 0) + coalesce(list(qty ORDER BY n)[2], 0)"), "all": ({"SUM": [_I, "qty"]}, "sum(qty)")})
rules("for_loop", "part", {"x": ({"sum": [{"FOR": [0, v("p_size"), {"*": [v("$loopIteration"), v("p_size")]}]}]}, "p_size::DOUBLE * (p_size * (p_size - 1) / 2)")})
rules("multiplies", "part", {"x": ({"MULTIPLIES": [{"FOR": [1, 5, v("$loopIteration")]}, v("p_size")]}, "24.0 * p_size")})
rules("divides", "part", {"x": ({"DIVIDES": [v("p_retailprice"), 0, 4]}, "p_retailprice / 4")})


@query("embedding_dot_reduce", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x > 0)::INT))::DOUBLE AS positive, len(embedding)::DOUBLE AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * 1e6) / 1e6 AS norm FROM embeddings")
def embedding_dot_reduce(spark: SparkSession, d: str) -> DataFrame:
    rule = {"reduce": [v("embedding"), {"+": [v("accumulator"), {"if": [{">": [v("current"), 0]}, 1, 0]}]}, 0]}
    norm = {"round": [{"reduce": [v("embedding"), {"+": [v("accumulator"), {"*": [v("current"), v("current")]}]}, 0]}, 6]}
    return evaluate(table(spark, d, "embeddings"), {"positive": rule, "dims": {"length": v("embedding")}, "norm": norm}).select("vec_id", "positive", "dims", "norm")


@query("in_semi_join_df", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_semi_join_df(spark: SparkSession, d: str) -> DataFrame:
    chosen = keep(table(spark, d, "customer"), {"==": [v("c_mktsegment"), "BUILDING"]})
    return is_in(table(spark, d, "orders"), "o_custkey", chosen, "c_custkey").select("o_orderkey")


# lookups
def _nation(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").withColumn("_idx", F.col("n_nationkey").cast("long"))


def _part(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "part")
    return n.withColumn("_idx", F.col("p_partkey").cast("long"))


def _order_table(s: SparkSession, d: str) -> DataFrame:
    """Orders as a large reference table of price ranges."""
    price = F.col("o_totalprice")
    return table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("_idx"), "o_custkey", "o_totalprice", (price * 1.02).alias("upto"), F.col("o_orderstatus").alias("status"))


def _brackets(s: SparkSession) -> DataFrame:
    rows = [(0, 0.0, 999.99, "low"), (1, 1000.0, 4999.99, "mid"), (2, 5000.0, 1e9, "high"), (3, -1e9, -0.01, "debt")]
    return s.createDataFrame(rows, "_idx long, lo double, hi double, name string")


_BRACKETS_SQL = "(VALUES (0, 0.0, 999.99, 'low'), (1, 1000.0, 4999.99, 'mid'), (2, 5000.0, 1e9, 'high'), (3, -1e9, -0.01, 'debt')) b(i, lo, hi, name)"

#: name: base, tables, rules, SQL
_LOOKUPS = {
    "valueat": ("customer", lambda s, d: {"nations": _nation(s, d)}, {"name": {"VALUEAT": [v("nations"), v("c_nationkey"), "n_name"]}},
                "SELECT c_custkey, n_name AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "maxat": ("customer", lambda s, d: {"nations": _nation(s, d)}, {"last": {"MAXAT": [v("nations"), "n_name"]}},
              "SELECT c_custkey, (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1) AS last FROM customer"),
    "indexat_exact": ("customer", lambda s, d: {"nations": _nation(s, d)}, {"at": {"INDEXAT": [v("c_nationkey"), v("nations"), "n_regionkey"]}},
                      "SELECT c_custkey, coalesce((SELECT min(n_nationkey) FROM nation WHERE n_regionkey = c_nationkey), -1)::DOUBLE AS at FROM customer"),
    "indexat_range": ("customer", lambda s, d: {"brackets": _brackets(s)}, {"at": {"INDEXAT": [v("c_acctbal"), v("brackets"), "lo", True]}},
                      f"SELECT c_custkey, coalesce((SELECT min(i) FROM {_BRACKETS_SQL} WHERE lo <= c_acctbal), -1)::DOUBLE AS at FROM customer"),
    "match_multi_df": ("lineitem", lambda s, d: {"parts": _part(s, d)}, {"at": {"MATCH": [v("parts"), v("l_partkey"), "p_partkey", {"if": [{">": [v("l_quantity"), 25]}, "Brand#11", "Brand#12"]}, "p_brand"]}},
                       "SELECT l_orderkey, l_linenumber, coalesce((SELECT p_partkey FROM part WHERE p_partkey = l_partkey AND p_brand = CASE WHEN l_quantity > 25 THEN 'Brand#11' ELSE 'Brand#12' END), -1)::DOUBLE AS at FROM lineitem"),
    "matchrange_df": ("customer", lambda s, d: {"brackets": _brackets(s)}, {"at": {"MATCHRANGE": [v("brackets"), "lo", "hi", v("c_acctbal")]}},
                      f"SELECT c_custkey, coalesce((SELECT min(i) FROM {_BRACKETS_SQL} WHERE c_acctbal BETWEEN lo AND hi), -1)::DOUBLE AS at FROM customer"),
    "choose_df": ("customer", lambda s, d: {"nations": _nation(s, d)}, {"at": {"CHOOSE": [v("nations"), v("c_nationkey"), "n_regionkey", v("c_nationkey"), "n_nationkey"]}},
                  "SELECT c_custkey, coalesce((SELECT min(n_nationkey) FROM nation WHERE n_regionkey = c_nationkey OR n_nationkey = c_nationkey), -1)::DOUBLE AS at FROM customer"),
    "findindex_and_df": ("lineitem", lambda s, d: {"parts": _part(s, d)}, {"at": {"FINDINDEX": [v("parts"), ["&&", ["==", v("l_partkey"), "p_partkey"], ["==", "Brand#13", "p_brand"]]]}},
                         "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN -1.0 ELSE p_partkey::DOUBLE END AS at FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_brand = 'Brand#13'"),
    "findindex_theta_df": ("customer", lambda s, d: {"brackets": _brackets(s)}, {"at": {"FINDINDEX": [v("brackets"), ["<", v("c_acctbal"), "lo"], ["!=", "debt", "name"]]}},
                           f"SELECT c_custkey, coalesce((SELECT min(i) FROM {_BRACKETS_SQL} WHERE lo < c_acctbal AND name <> 'debt'), -1)::DOUBLE AS at FROM customer"),
    "indexat_range_large_df": ("customer", lambda s, d: {"orders": _order_table(s, d)}, {"at": {"INDEXAT": [{"*": [v("c_acctbal"), 10]}, v("orders"), "o_totalprice", True]}},
                               "SELECT c_custkey, coalesce(min(o_orderkey), -1)::DOUBLE AS at FROM customer LEFT JOIN orders ON o_totalprice <= c_acctbal * 10 GROUP BY c_custkey"),
    "matchrange_large_df": ("customer", lambda s, d: {"orders": _order_table(s, d)}, {"at": {"MATCHRANGE": [v("orders"), "o_totalprice", "upto", {"*": [v("c_acctbal"), 30]}]}},
                            "SELECT c_custkey, coalesce(min(o_orderkey), -1)::DOUBLE AS at FROM customer LEFT JOIN orders ON c_acctbal * 30 BETWEEN o_totalprice AND o_totalprice * 1.02 GROUP BY c_custkey"),
    "matchrange_two_large_df": ("customer", lambda s, d: {"orders": _order_table(s, d)}, {"at": {"MATCHRANGE": [v("orders"), "o_totalprice", "upto", {"*": [v("c_acctbal"), 30]}, "o_custkey", "o_totalprice", v("c_custkey")]}},
                                "SELECT c_custkey, coalesce(min(o_orderkey), -1)::DOUBLE AS at FROM customer LEFT JOIN orders ON c_acctbal * 30 BETWEEN o_totalprice AND o_totalprice * 1.02 AND c_custkey BETWEEN o_custkey AND o_totalprice GROUP BY c_custkey"),
    "findindex_large_df": ("customer", lambda s, d: {"orders": _order_table(s, d)}, {"at": {"FINDINDEX": [v("orders"), ["==", v("c_custkey"), "o_custkey"], [">", {"*": [v("c_acctbal"), 10]}, "o_totalprice"], ["!=", "P", "status"]]}},
                           "SELECT c_custkey, coalesce(min(o_orderkey), -1)::DOUBLE AS at FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10 AND o_orderstatus <> 'P' GROUP BY c_custkey"),
    "valueat_match_fused_df": ("lineitem", lambda s, d: {"parts": _part(s, d)}, {"brand": {"VALUEAT": [v("parts"), {"MATCH": [v("parts"), v("l_partkey"), "p_partkey"]}, "p_brand"]}},
                               "SELECT l_orderkey, l_linenumber, p_brand AS brand FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"),
    "mapoptions": ("part", lambda s, d: {"nations": _nation(s, d)}, {"n": {"length": [{"MAPOPTIONS": [v("nations"), "n_name", "n_regionkey"]}]}, "label": {"VALUEAT": [{"MAPOPTIONS": [v("nations"), "n_name", "n_regionkey"]}, {"%": [v("p_size"), 30]}, "label"]}, "value": {"VALUEAT": [{"MAPOPTIONS": [v("nations"), "n_name", "n_regionkey"]}, {"%": [v("p_size"), 30]}, "value"]}},
                   "SELECT p_partkey, (SELECT count(*) FROM nation)::DOUBLE AS n, n_name AS label, n_regionkey AS value FROM part LEFT JOIN nation ON n_nationkey = p_size % 30"),
    "mapoptionsif": ("customer", lambda s, d: {"brackets": _brackets(s)}, {"n": {"length": [{"MAPOPTIONSIF": [v("brackets"), "name", "lo", [v("c_acctbal"), ">=", "lo"]]}]}},
                     f"SELECT c_custkey, (SELECT count(*) FROM {_BRACKETS_SQL} WHERE c_acctbal >= lo)::DOUBLE AS n FROM customer"),
}


def _lookup(name: str, base: str, tables: Callable, made: dict, sql: str) -> None:
    read, _, keys = BASES[base]
    query(name, sql)(lambda s, d: evaluate(read(s, d), made, tables=tables(s, d)).select(*keys, *made))


for _name, _spec in _LOOKUPS.items():
    _lookup(_name, *_spec)
rules("rangeoptions", "part", {"n": ({"length": [{"RANGEOPTIONS": [1, v("p_size")]}]}, "p_size::DOUBLE"), "first": ({"VALUEAT": [{"RANGEOPTIONS": [1, v("p_size")]}, 0, "label"]}, "'1'")})


# generated tables
def _form(spark: SparkSession, d: str, base: str, schema: dict, **more) -> FormEngine:
    return FormEngine(schema, BASES[base][0](spark, d), **more)


def generated(name: str, base: str, node: dict, out: dict[str, Callable], sql: str) -> None:
    """A generated table for each document, as rows."""
    keys = BASES[base][2]

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _form(spark, d, base, {"properties": {"t": node}}).evaluate()
        rows = e.df.select(*keys, F.posexplode("t").alias("row", "cells"))
        return rows.select(*keys, F.col("row").cast("long").alias("row"), *[f(F.col("cells")).alias(c) for c, f in out.items()])

    query(name, sql)(run)


def _col(c: str) -> Callable:
    return lambda cells: cells[c]


def ev(rule) -> dict:
    return {"$evaluation": rule}


_IT = {"$ref": "$iteration"}
_SELF = lambda by, c: {"VALUEAT": [v("t"), {"+" if by > 0 else "-": [_IT, abs(by)]}, c]}
generated("table_static", "part", {"$table": [{"a": ev(v("p_size")), "b": ev({"*": [v("$a"), 2]})}, {"a": 1, "b": 2}]}, {"a": _col("a"), "b": _col("b")},
          "SELECT p_partkey, 0::BIGINT AS row, p_size::DOUBLE AS a, p_size * 2.0 AS b FROM part UNION ALL SELECT p_partkey, 1::BIGINT, 1.0, 2.0 FROM part")
generated("table_repeat", "part", {"$table": [{"$repeat": [0, ev({"%": [v("p_size"), 4]}), {"i": ev(_IT), "left": ev({"-": [v("$threshold"), _IT]})}]}]}, {"i": _col("i"), "left": _col("left")},
          "SELECT p_partkey, i AS row, i::DOUBLE AS i, (p_size % 4 - i)::DOUBLE AS left FROM (SELECT p_partkey, p_size, unnest(range(0, p_size % 4 + 1)) AS i FROM part)")
generated("table_repeat_lag", "part", {"$table": [{"$repeat": [0, 4, {"x": ev({"*": [_IT, v("p_size")]}), "before": ev(_SELF(-1, "x"))}]}]}, {"x": _col("x"), "before": _col("before")},
          "SELECT p_partkey, i AS row, (i * p_size)::DOUBLE AS x, CASE WHEN i > 0 THEN ((i - 1) * p_size)::DOUBLE END AS before FROM (SELECT p_partkey, p_size, unnest(range(0, 5)) AS i FROM part)")
generated("table_recurrence_fold", "customer", {"$table": [{"$repeat": [0, 5, {"balance": ev({"if": [{"==": [_IT, 0]}, v("c_custkey"), {"+": [{"*": [_SELF(-1, "balance"), 2]}, 1]}]})}]}]}, {"balance": _col("balance")},
          "SELECT c_custkey, i AS row, ((c_custkey + 1) * pow(2, i) - 1)::DOUBLE AS balance FROM (SELECT c_custkey, unnest(range(0, 6)) AS i FROM customer)")
generated("table_forward_ref", "part", {"$table": [{"$repeat": [0, 3, {"x": ev(_IT), "rest": ev({"+": [v("$x"), {"ifnull": [_SELF(1, "rest"), 0]}]})}]}]}, {"x": _col("x"), "rest": _col("rest")},
          "SELECT p_partkey, i AS row, i::DOUBLE AS x, (6 - i * (i - 1) / 2)::DOUBLE AS rest FROM (SELECT p_partkey, unnest(range(0, 4)) AS i FROM part)")
generated("table_sweeps_both_ways", "part", {"$table": [{"$repeat": [0, 2, {"up": ev({"+": [_SELF(-1, "up"), 1]}), "down": ev({"+": [_SELF(1, "down"), v("p_size")]})}]}]}, {"up": _col("up"), "down": _col("down")},
          "SELECT p_partkey, i AS row, (i + 1)::DOUBLE AS up, ((3 - i) * p_size)::DOUBLE AS down FROM (SELECT p_partkey, p_size, unnest(range(0, 3)) AS i FROM part)")
generated("table_datas_skip_clear", "part", {"$datas": [{"name": "base", "data": ev({"*": [v("p_size"), 10]})}], "$skip": ev({">": [v("p_size"), 25]}), "$table": [{"x": ev({"+": [v("base"), 1]})}]}, {"x": _col("x")},
          "SELECT p_partkey, 0::BIGINT AS row, p_size * 10.0 + 1 AS x FROM part WHERE p_size <= 25")

# schemas
_FIELDS = {
    "$params": {"RATE": 0.05, "LIMIT": 100000},
    "properties": {
        "o_totalprice": {"type": "number", "rules": {"maxValue": {"value": 300000, "message": "too much"}, "minValue": {"value": 1000}}},
        "tax": {"type": "number", "value": ev({"*": [v("o_totalprice"), {"$ref": "$params.RATE"}]})},
        "total": {"type": "number", "value": ev({"+": [v("tax"), v("o_totalprice")]})},
        "large": {"type": "boolean", "value": ev({">": [v("total"), {"$ref": "$params.LIMIT"}]})},
        "note": {"type": "string", "value": "none", "condition": {"hidden": ev({"!": [v("large")]})}},
        "comment": {"type": "string", "condition": {"disabled": ev(v("large"))}, "value": "locked"},
    },
}
_TOTAL = "(0.0 + (o_totalprice * 0.05) + o_totalprice)"


@query("schema_topo_fields", f"SELECT o_orderkey, o_totalprice * 0.05 AS tax, {_TOTAL} AS total, {_TOTAL} > 100000 AS large FROM orders")
def schema_topo_fields(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, "orders", _FIELDS).evaluate().df.select("o_orderkey", "tax", "total", "large")


@query("selective_paths", f"SELECT o_orderkey, {_TOTAL} AS total FROM orders")
def selective_paths(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, "orders", _FIELDS).evaluate(["total"]).df.select("o_orderkey", "total")


@query("static_defaults", f"SELECT o_orderkey, CASE WHEN {_TOTAL} > 100000 THEN 'none' END AS note FROM orders")
def static_defaults(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, "orders", _FIELDS).evaluate().defaults().df.select("o_orderkey", "note")


@query("visibility_cascade", f"SELECT o_orderkey, NOT ({_TOTAL} > 100000) AS hidden FROM orders")
def visibility_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, "orders", _FIELDS).evaluate().visibility().select("o_orderkey", F.col("`note#hidden`").alias("hidden"))


@query("readonly_sync", f"SELECT o_orderkey, CASE WHEN {_TOTAL} > 100000 THEN 'locked' END AS comment FROM orders")
def readonly_sync(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, "orders", _FIELDS).evaluate().readonly().df.select("o_orderkey", "comment")


@query("hide_cascade", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal >= 0 AND c_mktsegment = 'BUILDING' THEN c_name END AS c_name FROM customer")
def hide_cascade(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {
        "c_name": {"type": "string", "condition": {"hidden": ev({"!=": [v("c_mktsegment"), "BUILDING"]})}},
        "c_mktsegment": {"type": "string", "condition": {"hidden": ev({"<": [v("c_acctbal"), 0]})}},
    }}
    return _form(spark, d, "customer", schema).hide().df.select("c_custkey", "c_mktsegment", "c_name")


_CHECKED = {
    "properties": {
        "c_acctbal": {"type": "number", "rules": {"minValue": {"value": 0, "message": "negative", "code": "E1"}, "maxValue": {"value": 9000}}},
        "c_name": {"type": "string", "rules": {"required": {"value": True}, "pattern": {"value": "[05]$", "message": "not by five"}}},
        "c_mktsegment": {"type": "string", "rules": {"minLength": {"value": 9}, "maxLength": {"value": 9}}},
        "c_phone": {"type": "string", "rules": {"required": {"value": True, "message": "phone is needed"}}},
        "c_nationkey": {"type": "integer", "rules": {"evaluation": {"value": [{"code": "R1", "message": "odd", "value": ev({"==": [{"%": [v("c_nationkey"), 2]}, 0]})}]}, "small": {"value": ev({"<": [v("c_nationkey"), 20]})}}},
    }
}
_ERR = "c_custkey, '{f}' AS field, '{t}' AS type, '{m}' AS message, '{c}' AS code"


def _err(f: str, t: str, m: str, c: str, where: str) -> str:
    return f"SELECT {_ERR.format(f=f, t=t, m=m, c=c)} FROM customer WHERE {where}"


_VALIDATIONS = {
    "validate_range": ("c_acctbal", [("minValue", "negative", "E1", "c_acctbal < 0"), ("maxValue", "Validation failed", "c_acctbal.maxValue", "c_acctbal > 9000")]),
    "validate_pattern": ("c_name", [("pattern", "not by five", "c_name.pattern", "NOT regexp_matches(c_name, '[05]$')")]),
    "validate_length": ("c_mktsegment", [("minLength", "Validation failed", "c_mktsegment.minLength", "strlen(c_mktsegment) < 9"), ("maxLength", "Validation failed", "c_mktsegment.maxLength", "strlen(c_mktsegment) > 9")]),
    "validate_required": ("c_mktsegment", [("required", "segment is needed", "c_mktsegment.required", "c_nationkey % 3 = 0")]),
    "validate_custom": ("c_nationkey", [("evaluation", "odd", "R1", "c_nationkey % 2 = 1"), ("evaluation", "Validation failed", "c_nationkey.small", "c_nationkey % 2 = 0 AND c_nationkey >= 20")]),
}


def _validation(name: str, path: str, parts: list) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        if name == "validate_required":
            docs = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_nationkey") % 2 == 0, "")))
            schema = {"properties": {path: {"type": "string", "rules": {"required": {"value": True, "message": "segment is needed"}}}}}
            return FormEngine(schema, docs).validate(["c_custkey"]).select("c_custkey", "field", "type", "message", "code")
        schema = {"properties": {path: _CHECKED["properties"][path]}}
        return _form(spark, d, "customer", schema).validate(["c_custkey"]).select("c_custkey", "field", "type", "message", "code")

    query(name, " UNION ALL ".join(_err(path, *p) for p in parts))(run)


for _name, (_path, _parts) in _VALIDATIONS.items():
    _validation(_name, _path, _parts)


@query("validate_summary", "SELECT c_custkey, ((c_acctbal < 0 OR c_acctbal > 9000)::INT + (NOT regexp_matches(c_name, '[05]$'))::INT + (strlen(c_mktsegment) <> 9)::INT + 1 + (c_nationkey % 2 = 1 OR c_nationkey >= 20)::INT) AS n_errors, true AS has_error FROM customer")
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, "customer", _CHECKED).validation_summary(["c_custkey"]).select("c_custkey", "n_errors", "has_error")


@query("dependents_chain", "SELECT p_partkey, p_size * 2.0 AS double_size, 'size ' || (p_size * 2) AS label, NULL::VARCHAR AS p_brand, CASE WHEN p_brand IS NULL THEN 2 ELSE 3 END AS n FROM part")
def dependents_chain(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {
        "p_size": {"type": "integer", "dependents": [{"$ref": "#/properties/double_size", "value": ev({"*": [{"$ref": "$value"}, 2]})}, {"$ref": "#/properties/p_brand", "clear": True}]},
        "double_size": {"type": "number", "dependents": [{"$ref": "#/properties/label", "value": ev({"cat": ["size ", {"$ref": "$value"}]})}]},
        "label": {"type": "string"}, "p_brand": {"type": "string"},
    }}
    out = _form(spark, d, "part", schema).dependents(["p_size"])
    return out.select("p_partkey", "double_size", "label", "p_brand", F.size("changes").alias("n"))


_SUB = {"properties": {"items": {"type": "array", "items": {"type": "object", "properties": {
    "qty": {"type": "number"}, "price": {"type": "number"}, "unit": {"type": "number", "value": ev({"/": [v("items.price"), v("items.qty")]})}}}}}}


@query("dependents_gated", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END AS p_brand, CASE WHEN p_size <= 25 THEN p_type END AS p_type, CASE WHEN p_size > 25 THEN 'p_brand,p_type' ELSE '' END AS changed FROM part")
def dependents_gated(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {
        "p_size": {"type": "integer", "dependents": [{"$ref": "#/properties/p_brand", "value": ev({"if": [{">": [{"$ref": "$value"}, 25]}, "big", ""]})}]},
        "p_brand": {"type": "string", "dependents": [{"$ref": "#/properties/p_type", "clear": True}]}, "p_type": {"type": "string"},
    }}
    out = _form(spark, d, "part", schema).dependents(["p_size"])
    return out.select("p_partkey", "p_brand", "p_type", F.array_join(F.transform("changes", lambda c: c["ref"]), ",").alias("changed"))


@query("dependents_requeue", "SELECT p_partkey, p_brand || '-' || p_size AS label, CASE WHEN p_size > 25 THEN 'XL' ELSE p_type END AS kind, 1 + (p_size > 25)::INT AS n FROM part")
def dependents_requeue(spark: SparkSession, d: str) -> DataFrame:
    # a change of form.size runs the dependent of form.brand whose formula reads it, and no other of its dependents
    group = {"size": {"type": "integer", "dependents": [{"$ref": "form.kind", "value": ev({"if": [{">": [{"$ref": "$value"}, 25]}, "XL", ""]})}]},
             "brand": {"type": "string", "dependents": [{"$ref": "form.kind", "value": "never"}, {"$ref": "form.label", "value": ev({"cat": [{"$ref": "$value"}, "-", v("form.size")]})}]},
             "label": {"type": "string"}, "kind": {"type": "string"}}
    docs = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.lit("").alias("label"), F.col("p_type").alias("kind")).alias("form"))
    out = FormEngine({"properties": {"form": {"type": "object", "properties": group}}}, docs).dependents(["form.size"])
    return out.select("p_partkey", F.col("`form.label`").alias("label"), F.col("`form.kind`").alias("kind"), F.size("changes").alias("n"))


_OWNED = {
    "$layout": {"elements": [{"$ref": "#/properties/c_name"}, {"$ref": "#/properties/c_phone"}]},
    "properties": {
        "c_name": {"type": "string", "value": ev({"cat": ["computed ", v("c_custkey")]})},
        "c_phone": {"type": "string", "value": ev({"cat": ["no ", v("c_custkey")]}), "condition": {"disabled": ev({"<": [v("c_acctbal"), 0]})}},
        "c_mktsegment": {"type": "string", "value": ev({"cat": ["segment ", v("c_nationkey")]})},
    },
}


@query("schema_value_owned", "SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'no ' || c_custkey ELSE c_phone END AS phone, 'segment ' || c_nationkey AS segment FROM (SELECT *, '12-' || c_custkey AS c_phone FROM customer)")
def schema_value_owned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").withColumn("c_phone", F.concat(F.lit("12-"), F.col("c_custkey")))
    out = FormEngine(_OWNED, docs).evaluate().schema_value(["c_custkey"], "flat")
    return out.select("c_custkey", *[F.col("value")[f"c_{n}"].alias("segment" if n == "mktsegment" else n) for n in ("name", "phone", "mktsegment")])


_PLACED = {
    "$layout": {"elements": [
        {"condition": {"hidden": ev({"<": [v("c_acctbal"), 0]})}, "elements": [{"$ref": "#/properties/c_name"}, {"$ref": "#/properties/c_mktsegment"}]},
        {"$ref": "#/properties/c_name", "condition": {"hidden": ev({">": [v("c_nationkey"), 12]})}},
    ]},
    "properties": {n: {"type": "string", "rules": {"pattern": {"value": "^never$"}}} for n in ("c_name", "c_mktsegment")},
}


@query("layout_hidden_validate", "SELECT c_custkey, 'c_name' AS field FROM customer WHERE NOT (c_acctbal < 0 AND c_nationkey > 12) UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_acctbal >= 0")
def layout_hidden_validate(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, "customer", _PLACED).validate(["c_custkey"]).select("c_custkey", "field")


def _subform(spark: SparkSession, d: str) -> tuple[FormEngine, FormEngine]:
    e = FormEngine(_SUB, _items(spark, d))
    sub = e.subform("items", ["o_orderkey"])
    return e, sub


@query("subform_items", f"SELECT o_orderkey, n::BIGINT AS n, CASE WHEN qty <> 0 THEN price / qty END AS unit FROM {_ITEMS_SQL}")
def subform_items(spark: SparkSession, d: str) -> DataFrame:
    _, sub = _subform(spark, d)
    sub.add({"items.unit": _SUB["properties"]["items"]["items"]["properties"]["unit"]["value"]["$evaluation"]}, clean=False)
    return sub.df.select("o_orderkey", F.col("`items.n`").cast("long").alias("n"), F.col("`items.unit`").alias("unit"))


_RIDERS = {"properties": {
    "top": {"type": "number", "value": ev({"reduce": [v("items"), {"max": [v("accumulator"), {"ifnull": [v("current.cost"), 0]}]}, 0]})},
    "items": {"type": "array", "items": {"type": "object", "properties": {
        "qty": {"type": "number", "rules": {"maxValue": {"value": 45, "message": "too many", "code": "Q"}}, "dependents": [{"$ref": "#/properties/items/properties/flag", "value": ev({"if": [{">": [{"$ref": "$value"}, 45]}, "H", ""]})}]},
        "flag": {"type": "string", "dependents": [{"$ref": "#/properties/items/properties/price", "clear": True}]}, "price": {"type": "number"},
        "cost": {"type": "number", "value": ev({"*": [v("items.qty"), 2]})}, "share": {"type": "number", "value": ev({"-": [v("items.cost"), v("top")]})}}}},
}}


@query("subform_validate", f"SELECT o_orderkey, n::BIGINT AS n, 'items.qty' AS field, 'Q' AS code FROM {_ITEMS_SQL} WHERE qty > 45")
def subform_validate(spark: SparkSession, d: str) -> DataFrame:
    sub = FormEngine(_RIDERS, _items(spark, d)).subform("items", ["o_orderkey"])
    return sub.validate(["o_orderkey", "items.n"]).select("o_orderkey", F.col("`items.n`").cast("long").alias("n"), "field", "code")


@query("subform_dependents", f"SELECT o_orderkey, n::BIGINT AS n, CASE WHEN qty > 45 THEN 'H' ELSE flag END AS flag, CASE WHEN qty <= 45 THEN price END AS price, CASE WHEN qty > 45 THEN 2 ELSE 0 END AS changes FROM {_ITEMS_SQL}")
def subform_dependents(spark: SparkSession, d: str) -> DataFrame:
    out = FormEngine(_RIDERS, _items(spark, d)).subform("items", ["o_orderkey"]).dependents(["items.qty"])
    return out.select("o_orderkey", F.col("`items.n`").cast("long").alias("n"), F.col("`items.flag`").alias("flag"), F.col("`items.price`").alias("price"), F.size("changes").alias("changes"))


@query("subform_cascade", f"SELECT o_orderkey, n::BIGINT AS n, qty * 2 - max(qty * 2) OVER (PARTITION BY o_orderkey) AS share FROM {_ITEMS_SQL}")
def subform_cascade(spark: SparkSession, d: str) -> DataFrame:
    e = FormEngine(_RIDERS, _items(spark, d)).cascade()
    # explode would put a filter on its array, and so its formulas again, below the computed columns
    rows = e.df.select("o_orderkey", F.explode_outer("items").alias("i")).where("i is not null")
    return rows.select("o_orderkey", F.col("i.n").cast("long").alias("n"), F.col("i.share").alias("share"))


@query("subform_rollup", f"SELECT o_orderkey, count(*)::DOUBLE AS n, max(price / qty) AS most FROM {_ITEMS_SQL} GROUP BY o_orderkey")
def subform_rollup(spark: SparkSession, d: str) -> DataFrame:
    whole = FormEngine(_SUB, _items(spark, d)).evaluate_items("items").df
    most = {"reduce": [v("items"), {"max": [v("accumulator"), v("current.unit")]}, 0]}
    return evaluate(whole, {"n": {"length": v("items")}, "most": most}).select("o_orderkey", "n", "most")


@query("schema_value_flat", "SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer")
def schema_value_flat(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {"c_name": {"type": "string"}, "c_mktsegment": {"type": "string", "condition": {"hidden": ev({"<": [v("c_acctbal"), 0]})}}}}
    out = _form(spark, d, "customer", schema).schema_value(["c_custkey"], "flat")
    return out.select("c_custkey", F.col("value")["c_name"].alias("name"), F.col("value")["c_mktsegment"].alias("segment"))


@query("options_url_template", "SELECT c_custkey, 'c_nationkey' AS field, '/nations/' || c_nationkey || '?s=' || c_mktsegment AS url FROM customer")
def options_url_template(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {"c_nationkey": {"type": "integer", "options": {"url": "/nations/{id}?s={seg}", "params": {"id": ev(v("c_nationkey")), "seg": ev(v("c_mktsegment"))}}}}}
    return _form(spark, d, "customer", schema).option_urls(["c_custkey"])


@query("layout_flags", "SELECT c_custkey, 'c_name' AS ref, c_acctbal < 0 AS hidden FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_acctbal < 0 OR c_nationkey = 3 FROM customer")
def layout_flags(spark: SparkSession, d: str) -> DataFrame:
    schema = {
        "$layout": {"elements": [{"condition": {"hidden": ev({"<": [v("c_acctbal"), 0]})}, "elements": [{"$ref": "#/properties/c_name"}, {"$ref": "#/properties/c_mktsegment"}]}]},
        "properties": {"c_name": {"type": "string"}, "c_mktsegment": {"type": "string", "condition": {"hidden": ev({"==": [v("c_nationkey"), 3]})}}},
    }
    out = _form(spark, d, "customer", schema).layout(["c_custkey"])
    return out.where("ref is not null").select("c_custkey", "ref", "hidden")


@query("rule_filter_revenue", "SELECT count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05")
def rule_filter_revenue(spark: SparkSession, d: str) -> DataFrame:
    kept = keep(table(spark, d, "lineitem"), {"and": [{"<": [v("l_quantity"), 24]}, {">=": [v("l_discount"), 0.05]}]})
    made = evaluate(kept, {"revenue": {"*": [v("l_extendedprice"), {"-": [1, v("l_discount")]}]}})
    return made.agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"))


@query("grouped_conditional_sum", "SELECT l_returnflag, sum(CASE WHEN l_quantity > 30 THEN l_quantity ELSE 0 END) AS large FROM lineitem GROUP BY l_returnflag")
def grouped_conditional_sum(spark: SparkSession, d: str) -> DataFrame:
    made = evaluate(table(spark, d, "lineitem"), {"x": {"if": [{">": [v("l_quantity"), 30]}, v("l_quantity"), 0]}})
    return made.groupBy("l_returnflag").agg(F.sum("x").alias("large"))


@query("events_foreach_batch", "SELECT event_id, value > 50 AS high, 'e:' || event_type AS kind FROM events")
def events_foreach_batch(spark: SparkSession, d: str) -> DataFrame:
    from ruleweave.streaming.increments import run_increments

    return run_increments(spark, f"{d}/events.parquet", {"high": {">": [v("value"), 50]}, "kind": {"cat": ["e:", v("event_type")]}}, ["event_id"])


# tables, schemas and documents in their rarer forms
generated("table_clear", "customer", {"$clear": ev({"<": [v("c_acctbal"), 0]}), "$table": [{"$repeat": [0, 1, {"x": ev({"+": [_IT, v("c_nationkey")]})}]}]}, {"x": _col("x")},
          "SELECT c_custkey, i AS row, (i + c_nationkey)::DOUBLE AS x FROM (SELECT *, unnest(range(0, 2)) AS i FROM customer WHERE c_acctbal >= 0)")


@query("table_gate", "SELECT p_partkey, CASE WHEN p_size <= 25 THEN 2 ELSE 0 END AS n FROM part")
def table_gate(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {"p_size": {"type": "integer", "rules": {"maxValue": {"value": 25}}}, "t": {"$table": [{"$repeat": [0, 1, {"x": ev({"*": [v("p_size"), _IT]})}]}]}}}
    return _form(spark, d, "part", schema).evaluate().df.select("p_partkey", F.size("t").alias("n"))


@query("findindex_scope", f"SELECT o_orderkey, coalesce(min(i) FILTER (qty > o_orderkey % 50), -1)::DOUBLE AS at FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n) - 1 AS i FROM {_ITEMS_SQL}) GROUP BY o_orderkey")
def findindex_scope(spark: SparkSession, d: str) -> DataFrame:
    # qty of the document is not the row's: $ref asks the document
    docs = _items(spark, d).withColumn("qty", F.col("o_orderkey") % 50)
    return evaluate(docs, {"at": {"FINDINDEX": [v("items"), [">", {"$ref": "qty"}, "qty"]]}}).select("o_orderkey", "at")


@query("schema_value_pairs", "SELECT c_custkey, 'c_name' AS path, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_acctbal >= 0 THEN c_mktsegment END FROM customer UNION ALL SELECT c_custkey, 'twice', (c_nationkey * 2)::VARCHAR FROM customer")
def schema_value_pairs(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {"c_name": {"type": "string"}, "c_mktsegment": {"type": "string", "condition": {"hidden": ev({"<": [v("c_acctbal"), 0]})}}, "twice": {"type": "number", "value": ev({"*": [v("c_nationkey"), 2]})}}}
    pairs = _form(spark, d, "customer", schema).evaluate().schema_value(["c_custkey"], "array")
    return pairs.select("c_custkey", F.explode("value").alias("x")).select("c_custkey", "x.path", "x.value")


@query("schema_value_nested", "SELECT p_partkey, p_brand AS brand, p_size * 2.0 AS twice FROM part")
def schema_value_nested(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size")).alias("measure")).alias("form"))
    group = {"brand": {"type": "string"}, "measure": {"type": "object", "properties": {"size": {"type": "integer"}, "twice": {"type": "number", "value": ev({"*": [v("form.measure.size"), 2]})}}}}
    out = FormEngine({"properties": {"form": {"type": "object", "properties": group}}}, docs).evaluate().schema_value(["p_partkey"])
    return out.select("p_partkey", F.col("value.form.brand").alias("brand"), F.col("value.form.measure.twice").alias("twice"))


@query("json_texts", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::DOUBLE, 0) + 1 AS x FROM events")
def json_texts(spark: SparkSession, d: str) -> DataFrame:
    from ruleweave.sources.documents import parse_documents

    return evaluate(parse_documents(table(spark, d, "events"), "props", "k string"), {"x": {"+": [v("k"), 1]}}).select("event_id", "x")


@query("in_anti_join_df", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def in_anti_join_df(spark: SparkSession, d: str) -> DataFrame:
    large = keep(table(spark, d, "orders"), {">": [v("o_totalprice"), 200000]})
    return is_in(table(spark, d, "customer"), "c_custkey", large, "o_custkey", absent=True).select("c_custkey")


@query("custom_operator", "SELECT p_partkey, reverse(p_brand) || '!' AS x FROM part")
def custom_operator(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    from ruleweave.plans.compiler import register_operator

    register_operator("BACKWARD", F.reverse, T.StringType())
    return evaluate(table(spark, d, "part"), {"x": {"cat": [{"BACKWARD": v("p_brand")}, "!"]}}).select("p_partkey", "x")


@query("logic_store", "SELECT p_partkey, p_size * 2.0 AS a, p_size * 2.0 AS b, 2 AS rules FROM part")
def logic_store(spark: SparkSession, d: str) -> DataFrame:
    from ruleweave.plans.engine import LogicStore

    store = LogicStore()
    first, again, _ = store.compile({"*": [v("p_size"), 2]}), store.compile('{ "*" : [{"var": "p_size"}, 2] }'), store.compile({"+": [1, 2]})
    return store.run(table(spark, d, "part"), {"a": first, "b": again}).select("p_partkey", "a", "b", F.lit(len(store.rules)).alias("rules"))


_PASS = {"properties": {
    "c_nationkey": {"type": "integer", "dependents": [{"$ref": "#/properties/c_mktsegment", "value": ev({"if": [{">": [{"$ref": "$value"}, 12]}, "FAR", ""]})}]},
    "c_mktsegment": {"type": "string"}, "fee": {"type": "number", "value": ev({"if": [{"==": [v("c_mktsegment"), "FAR"]}, 10, 1]})},
    "fixed": {"type": "string", "value": "yes", "condition": {"disabled": ev({"<": [v("c_acctbal"), 0]})}}, "c_name": {"type": "string", "condition": {"hidden": ev({"==": [v("fixed"), "yes"]})}},
}}


@query("refresh_pass", """SELECT c_custkey, 'c_mktsegment' AS ref, 'FAR' AS value, false AS readonly, false AS hidden FROM customer WHERE c_nationkey > 12
UNION ALL SELECT c_custkey, 'fee', CASE WHEN c_nationkey > 12 THEN '10.0' ELSE '1.0' END, false, false FROM customer UNION ALL SELECT c_custkey, 'fixed', 'yes', true, false FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_name', NULL, false, true FROM customer""")
def refresh_pass(spark: SparkSession, d: str) -> DataFrame:
    # the static value of "fixed" is the default of all rows, and hides the name
    return _form(spark, d, "customer", _PASS).refresh(["c_nationkey"], ["c_custkey"]).select("c_custkey", "ref", "value", "readonly", "hidden")


@query("resolved_schema", """SELECT p_partkey, '{"properties":{"p_size":{"type":"integer"},"d":{"type":"number","value":' || p_size * 2 || ',"condition":{"hidden":' || (p_size > 25)::VARCHAR || '}}}}' AS schema FROM part""")
def resolved_schema(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {"p_size": {"type": "integer"}, "d": {"type": "number", "value": ev({"*": [v("p_size"), 2]}), "condition": {"hidden": ev({">": [v("p_size"), 25]})}}}}
    made = _form(spark, d, "part", schema).evaluate().resolved_schema(["p_partkey"])
    return made.select("p_partkey", F.replace("schema", F.lit(": "), F.lit(":")).alias("schema"))


@query("values_at_paths", "SELECT p_partkey, p_size * 2.0 AS d, p_brand FROM part")
def values_at_paths(spark: SparkSession, d: str) -> DataFrame:
    schema = {"properties": {"d": {"type": "number", "value": ev({"*": [v("p_size"), 2]})}}}
    return _form(spark, d, "part", schema).evaluate().at(["p_partkey"], ["#/properties/d", "p_brand"])
