"""Do the numbers match? Comparisons, attribution and visual queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import Both, Comparison, Field, In, Not, TopN, compiled
from ..functions.lineage import cut_lineage
from ..operators import compare as C
from ..operators import visual_query as V

#: Money in whole cents: sums do not depend on their order.
CENTS = "CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)"
FINE = C.Tolerance(0.0, 0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revenue(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sum(F.expr(CENTS)).alias("revenue"), F.count("*").alias("lines"))


def _flag_sides(spark, d):
    lines = table(spark, d, "lineitem")
    return revenue(lines, "l_returnflag", "l_linestatus"), revenue(lines.where("l_quantity > 1"), "l_returnflag", "l_linestatus")


def compare_revenue_summary(spark, d):
    old, new = _flag_sides(spark, d)
    return C.compare_tables("sales/by_flag", old, new, ["l_returnflag", "l_linestatus"], ["revenue", "lines"])[0]


def compare_revenue_findings(spark, d):
    old, new = _flag_sides(spark, d)
    return C.compare_tables("sales/by_flag", old, new, ["l_returnflag", "l_linestatus"], ["revenue", "lines"], show_values=True)[1]


def _customer_sides(spark, d):
    orders = table(spark, d, "orders").withColumn("cust", F.expr("nullif(o_custkey, 3)"))
    return orders.groupBy("cust").agg(F.count("*").alias("n")), orders.where("o_orderkey % 7 <> 0").groupBy("cust").agg(F.count("*").alias("n"))


def compare_masked_findings(spark, d):
    old, new = _customer_sides(spark, d)
    return C.compare_tables("sales/customers", old, new, ["cust"], ["n"], max_findings=15)[1].select("path", "change", "old", "new")


def compare_null_keys(spark, d):
    old, new = _customer_sides(spark, d)
    return C.compare_tables("sales/customers", old, new, ["cust"], ["n"], FINE)[0]


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def perturbed(lines: DataFrame) -> DataFrame:
    """A copy with some rows gone, one quantity in fifty a little off, and one in a hundred blank."""
    q = F.when(F.col("l_orderkey") % 100 == 3, F.lit(None).cast("double")).when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity"))
    return lines.where("l_suppkey % 11 <> 0").withColumn("l_quantity", q).withColumn("l_extendedprice", F.col("l_extendedprice") * F.lit(1 + 1e-12))


def compare_lineitem_rows(spark, d):
    lines = table(spark, d, "lineitem").select(*LINE_KEYS, "l_quantity", "l_extendedprice", "l_returnflag")
    return C.compare_tables("lines/rows", lines, perturbed(lines), LINE_KEYS, ["l_quantity", "l_extendedprice", "l_returnflag"])[0]


def compare_tolerance(spark, d):
    lines = table(spark, d, "lineitem").select(*LINE_KEYS, "l_quantity", "l_extendedprice", "l_returnflag")
    return C.compare_tables("lines/tolerant", lines, perturbed(lines), LINE_KEYS, ["l_quantity"], C.Tolerance(0.5, 0.0))[0]


def compare_card(spark, d):
    lines = table(spark, d, "lineitem")
    old, new = lines.agg(F.sum(F.expr(CENTS)).alias("total")), lines.where("l_discount > 0").agg(F.sum(F.expr(CENTS)).alias("amount"))
    return C.compare_tables("sales/total", old, new, [], [("total", "amount")])[0]


def compare_repeated_keys(spark, d):
    lines = table(spark, d, "lineitem")
    return C.compare_tables("lines/repeated", lines, lines, ["l_orderkey", "l_linenumber"], ["l_quantity"])[0]


def compare_other_kinds(spark, d):
    """Keys and values of different kinds never meet: one side's numbers are text."""
    orders = table(spark, d, "orders")
    old = orders.select("o_orderkey", F.col("o_custkey").alias("v"))
    new = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("v"))
    return C.compare_tables("orders/kinds", old, new, ["o_orderkey"], ["v"])[0]


def _by_brand(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = ["p_brand", "p_type", "l_returnflag"]
    return revenue(lines, *keys), revenue(lines.where("l_quantity > 2"), *keys)


def _brand_rows(spark, d):
    old, new = _by_brand(spark, d)
    keys = [(k, k) for k in ("p_type", "l_returnflag")]
    return C.compared(C.align({"old": old, "new": new}, keys, [("revenue", "revenue")], ["p_brand"]), 1, FINE)


def compare_by_brand(spark, d):
    """All brands' results aligned and summarised at once."""
    return C.summarise(_brand_rows(spark, d), True, ["p_brand"])


def positions_by_brand(spark, d):
    rows = C.row_positions(_brand_rows(spark, d), ["p_brand"], ["k0", "k1"])
    return rows.where("differing OR only_old OR only_new").select("p_brand", "k0", "k1", "position")


def _segment_lines(spark, d):
    lines, orders, customers = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "c_nationkey", "l_quantity", "l_discount", "l_extendedprice")


def attribution_by_segment(spark, d):
    """Old, crossed and new sides of every segment out of one pass over the lines: the filter changes for some segments, the measure for others."""
    by = ["c_mktsegment", "c_nationkey"]
    keep = F.expr("c_mktsegment IN ('BUILDING', 'MACHINERY') OR l_quantity > 1")
    cents = F.expr(CENTS)
    changed = F.expr(f"CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 2 ELSE 1 END * {CENTS}")
    sums = cut_lineage(_segment_lines(spark, d).groupBy(*by).agg(F.sum(cents).alias("old"), F.sum(F.when(keep, cents)).alias("cross"), F.sum(F.when(keep, changed)).alias("new"), F.count_if(keep).alias("kept")))
    side = lambda name, rows: rows.select(*by, F.col(name).alias("v"))
    kept = sums.where("kept > 0")
    return C.attribute(side("old", sums), side("cross", kept), side("new", kept), ["c_nationkey"], ["v"], FINE, ["c_mktsegment"])


def partly_compared(spark, d):
    both, only_old, only_new = C.paired_values(["revenue", "lines", "gone"], ["revenue", "rows", "come"], {"lines": "rows"})
    old, new = _flag_sides(spark, d)
    new = new.withColumnRenamed("lines", "rows")
    summary = C.compare_tables("sales/partly", old, old.withColumnRenamed("lines", "rows"), ["l_returnflag", "l_linestatus"], both)[0].unionByName(C.compare_tables("sales/partly_new", old, new, ["l_returnflag", "l_linestatus"], both)[0])
    return C.partly_compared(summary, F.lit(", ".join([*only_old, *only_new])))


def completeness(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("columns", (F.col("user_id") % 5 + 1).cast("int"))
    return C.completeness(counts, "n", "columns", max_rows=40, max_values=150)


def completeness_by_size(spark, d):
    """The same with the bytes of what is returned."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes")).withColumn("columns", F.lit(2))
    return C.completeness(counts, "n", "columns", size="bytes", near_bytes=300)


def status_overview(spark, d):
    from ..operators.findings import status_overview as overview

    return overview(compare_by_brand(spark, d))


# ------------------------------------------------------------------ visual queries


def star(spark, d) -> V.Star:
    """Lines with their orders and parts; orders with customers, nations and regions."""
    orders, customer, nation, region = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    places = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return V.Star(table(spark, d, "lineitem"), (V.Dimension(places, "l_orderkey", "o_orderkey"), V.Dimension(table(spark, d, "part"), "l_partkey", "p_partkey")))


def visual_by_region(spark, d):
    report = (Not(In((Field("part", "p_type"),), (("ECONOMY",), ("SMALL",)))),)
    page = (Comparison(Field("lineitem", "l_quantity"), ">=", 5),)
    slicers = (In((Field("region", "r_name"), Field("orders", "o_orderstatus")), (("ASIA", "O"), ("EUROPE", "F"), ("AMERICA", "O"))),)
    visual = V.Visual(("r_name", "p_type"), {"Revenue": F.sum(F.expr(CENTS)), "Lines": F.count("*")}, (V.context(report, page, (), slicers),))
    return V.visual_query(star(spark, d), visual)


def visual_aggregations(spark, d):
    """Every aggregation, over a column with blanks."""
    lines = table(spark, d, "lineitem").withColumn("q", F.expr("CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_quantity AS BIGINT) END"))
    values = {f"{name}_q": make(F.col("q")) for name, make in V.AGGREGATIONS.items()}
    return V.visual_query(lines.withColumn("year", F.year("l_shipdate")), V.Visual(("year",), values))


def visual_two_valued(spark, d):
    """Blank rows survive a negated list; a blank in the list is a member."""
    f = Field("orders", "cust")
    orders = table(spark, d, "orders").withColumn("cust", F.expr("nullif(o_custkey % 10, 3)"))
    conditions = {"in_list": In((f,), ((1,), (2,))), "not_in_list": Not(In((f,), ((1,), (2,)))), "in_with_blank": In((f,), ((1,), (None,))), "is_blank": Comparison(f, "=", None), "not_blank": Not(Comparison(f, "=", None)), "either": Both((Comparison(f, ">", 7), Comparison(f, "=", None)), "or"), "not_greater": Not(Comparison(f, ">", 7))}
    return orders.groupBy("o_orderstatus").agg(*[F.count_if(compiled(c)).alias(n) for n, c in conditions.items()])


def visual_top_brands(spark, d):
    visual = V.Visual(("p_brand",), {"Revenue": F.sum(F.expr(CENTS))}, (TopN(Field("part", "p_brand"), 5, "revenue"),))
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return V.visual_query(rows, visual, {"revenue": F.sum(F.expr(CENTS))})


def visual_card(spark, d):
    visual = V.Visual((), {"Lines": F.count("*"), "Lines ": F.sum(F.col("l_linenumber"))}, (Comparison(Field("part", "p_size"), "<", 10),))
    return V.visual_query(star(spark, d), visual)


def visual_keys_only(spark, d):
    return V.visual_query(star(spark, d), V.Visual(("r_name", "o_orderpriority", "r_name"), {}))


def visual_blank_groups(spark, d):
    """Groups whose every value is blank are left out; lines without a partner form the blank group."""
    orders = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    s = V.Star(table(spark, d, "lineitem"), (V.Dimension(orders, "l_orderkey", "o_orderkey"),))
    return V.visual_query(s, V.Visual(("o_orderpriority", "l_linenumber"), {"V": F.sum(F.expr("CASE WHEN l_linenumber < 3 THEN CAST(l_quantity AS BIGINT) END"))}))


def visual_long_list(spark, d):
    """A list of values too long for the plan is joined instead."""
    wanted = tuple((x,) for x in range(0, 3000, 2))
    return V.visual_query(table(spark, d, "lineitem"), V.Visual(("l_returnflag",), {"n": F.count("*")}, (In((Field("lineitem", "l_partkey"),), wanted),)))


def supported_visuals(spark, d):
    parts = table(spark, d, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("card", "tableEx", "lineChart", "map", "slicer")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    catalog = parts.select("p_partkey", (kind == "slicer").alias("is_slicer"), kind.alias("visual_type"), (F.col("p_size") % 4).alias("n_fields"), (F.col("p_size") % 7).cast("int").alias("n_unread"))
    return V.supported_visuals(catalog.withColumn("n_unread", F.when(F.col("n_unread") == 6, 1).otherwise(0))).select("p_partkey", "supported", "reason")


QUERIES = {f.__name__: f for f in (compare_revenue_summary, compare_revenue_findings, compare_masked_findings, compare_null_keys, compare_lineitem_rows, compare_tolerance, compare_card, compare_repeated_keys, compare_other_kinds, compare_by_brand, positions_by_brand, attribution_by_segment, partly_compared, completeness, completeness_by_size, status_overview, visual_by_region, visual_aggregations, visual_two_valued, visual_top_brands, visual_card, visual_keys_only, visual_blank_groups, visual_long_list, supported_visuals)}

# ------------------------------------------------------------------ the same in SQL

_SIDES = f"""
old AS (SELECT l_returnflag, l_linestatus, sum({CENTS})::BIGINT AS revenue, count(*) AS lines FROM lineitem GROUP BY ALL),
new AS (SELECT l_returnflag, l_linestatus, sum({CENTS})::BIGINT AS revenue, count(*) AS lines FROM lineitem WHERE l_quantity > 1 GROUP BY ALL),
j AS (SELECT coalesce(old.l_returnflag, new.l_returnflag) AS k0, coalesce(old.l_linestatus, new.l_linestatus) AS k1,
             old.revenue AS r0, new.revenue AS r1, old.lines AS n0, new.lines AS n1, old.lines IS NOT NULL AS o, new.lines IS NOT NULL AS n
      FROM old FULL JOIN new ON old.l_returnflag IS NOT DISTINCT FROM new.l_returnflag AND old.l_linestatus IS NOT DISTINCT FROM new.l_linestatus)"""


def _differ(a: str, b: str, absolute: float = 0.0, relative: float = 1e-9) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN abs({a}::DOUBLE - {b}::DOUBLE) > greatest({absolute!r}::DOUBLE, {relative!r}::DOUBLE * greatest(abs({a}::DOUBLE), abs({b}::DOUBLE))) ELSE ({a} IS NULL) <> ({b} IS NULL) END)"


def _summary(path: str | None, source: str, differing: str, delta: str, group: str = "") -> str:
    """A summary over rows with o, n (present on a side)."""
    head = f"'{path}' AS path," if path else f"{group},"
    return f"""
SELECT {head} CASE WHEN rows_differing + rows_only_old + rows_only_new > 0 THEN 'different' ELSE 'same' END AS status, rows_old, rows_new, rows_matched, rows_differing, rows_only_old, rows_only_new, max_abs_delta, NULL::VARCHAR AS reason
FROM (SELECT {group + ',' if group else ''} count(*) FILTER (WHERE o) AS rows_old, count(*) FILTER (WHERE n) AS rows_new, count(*) FILTER (WHERE o AND n) AS rows_matched,
        count(*) FILTER (WHERE o AND n AND ({differing})) AS rows_differing, count(*) FILTER (WHERE NOT n) AS rows_only_old, count(*) FILTER (WHERE NOT o) AS rows_only_new,
        max({delta}) FILTER (WHERE o AND n) AS max_abs_delta FROM {source} {'GROUP BY ' + group if group else ''})"""


def _unless_repeated(keys: str, ctes: str, summary: str) -> str:
    """The summary, or the refusal where keys of lineitem repeat."""
    counts = ", ".join(f"CASE WHEN NOT d THEN {c} END AS {c}" for c in ("rows_old", "rows_new", "rows_matched", "rows_differing", "rows_only_old", "rows_only_new", "max_abs_delta"))
    return f"WITH {ctes}, s AS ({summary}), r AS (SELECT count(*) > 0 AS d FROM (SELECT 1 FROM lineitem GROUP BY {keys} HAVING count(*) > 1)) SELECT path, CASE WHEN d THEN 'not_validated' ELSE status END AS status, {counts}, CASE WHEN d THEN 'old result repeats a key' END AS reason FROM s, r"


_CUSTOMERS = """
base AS (SELECT nullif(o_custkey, 3) AS cust, o_orderkey FROM orders),
old AS (SELECT cust, count(*) AS v FROM base GROUP BY cust),
new AS (SELECT cust, count(*) AS v FROM base WHERE o_orderkey % 7 <> 0 GROUP BY cust),
j AS (SELECT coalesce(old.cust, new.cust) AS k, old.v AS a, new.v AS b, old.v IS NOT NULL AS o, new.v IS NOT NULL AS n FROM old FULL JOIN new ON old.cust IS NOT DISTINCT FROM new.cust)"""
_LINES = """
old AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS q, l_extendedprice AS p FROM lineitem),
new AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 100 = 3 THEN NULL WHEN l_partkey % 50 = 0 THEN l_quantity + 0.5 ELSE l_quantity END AS q, l_extendedprice * (1 + 1e-12) AS p FROM lineitem WHERE l_suppkey % 11 <> 0),
j AS (SELECT old.q AS q0, new.q AS q1, old.p AS p0, new.p AS p1, old.l_orderkey IS NOT NULL AS o, new.l_orderkey IS NOT NULL AS n FROM old FULL JOIN new USING (l_orderkey, l_partkey, l_suppkey, l_linenumber))"""
_BRANDS = f"""
b AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
old AS (SELECT p_brand, p_type, l_returnflag, sum({CENTS})::BIGINT AS v FROM b GROUP BY ALL),
new AS (SELECT p_brand, p_type, l_returnflag, sum({CENTS})::BIGINT AS v FROM b WHERE l_quantity > 2 GROUP BY ALL),
j AS (SELECT p_brand, p_type AS k0, l_returnflag AS k1, old.v AS a, new.v AS b, old.v IS NOT NULL AS o, new.v IS NOT NULL AS n FROM old FULL JOIN new USING (p_brand, p_type, l_returnflag))"""
_STAR = """
s AS (SELECT * FROM lineitem LEFT JOIN (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey) ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""

ORACLE = {
    "compare_revenue_summary": f"WITH {_SIDES}" + _summary("sales/by_flag", "j", f"{_differ('r0', 'r1')} OR {_differ('n0', 'n1')}", "greatest(abs(r0 - r1), abs(n0 - n1))::DOUBLE"),
    "compare_revenue_findings": f"""WITH {_SIDES},
f AS (SELECT k0, k1, 0 AS i, 'revenue' AS name, r0::VARCHAR AS old, r1::VARCHAR AS new FROM j WHERE o AND n AND {_differ('r0', 'r1')}
      UNION ALL SELECT k0, k1, 1, 'lines', n0::VARCHAR, n1::VARCHAR FROM j WHERE o AND n AND {_differ('n0', 'n1')}
      UNION ALL SELECT k0, k1, -1, CASE WHEN o THEN 'removed' ELSE 'added' END, NULL, NULL FROM j WHERE NOT (o AND n))
SELECT 'sales/by_flag/data/l_returnflag=' || k0 || ', l_linestatus=' || k1 || CASE WHEN i >= 0 THEN '/' || name ELSE '' END AS path,
       CASE WHEN i >= 0 THEN 'modified' ELSE name END AS change,
       CASE WHEN i >= 0 THEN name || ' changed at l_returnflag=' || k0 || ', l_linestatus=' || k1 ELSE 'Row l_returnflag=' || k0 || ', l_linestatus=' || k1 || ' stands on the ' || CASE name WHEN 'added' THEN 'new' ELSE 'old' END || ' side alone' END AS message, old, new
FROM f ORDER BY k0, k1, i LIMIT 20""",
    "compare_masked_findings": f"""WITH {_CUSTOMERS}, p AS (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST) AS pos FROM j)
SELECT 'sales/customers/data/row ' || pos || CASE WHEN o AND n THEN '/n' ELSE '' END AS path, CASE WHEN o AND n THEN 'modified' WHEN o THEN 'removed' ELSE 'added' END AS change,
       CASE WHEN o AND n THEN '(masked)' END AS old, CASE WHEN o AND n THEN '(masked)' END AS new
FROM p WHERE NOT (o AND n) OR {_differ('a', 'b')} ORDER BY k NULLS FIRST LIMIT 15""",
    "compare_null_keys": f"WITH {_CUSTOMERS}" + _summary("sales/customers", "j", "a <> b", "abs(a - b)::DOUBLE"),
    "compare_lineitem_rows": _unless_repeated(", ".join(LINE_KEYS), _LINES, _summary("lines/rows", "j", f"{_differ('q0', 'q1')} OR {_differ('p0', 'p1')}", "greatest(abs(q0 - q1), abs(p0 - p1))")),
    "compare_tolerance": _unless_repeated(", ".join(LINE_KEYS), _LINES, _summary("lines/tolerant", "j", _differ("q0", "q1", 0.5, 0.0), "abs(q0 - q1)")),
    "compare_card": f"WITH j AS (SELECT sum({CENTS})::BIGINT AS a, sum({CENTS}) FILTER (WHERE l_discount > 0)::BIGINT AS b, true AS o, true AS n FROM lineitem)" + _summary("sales/total", "j", _differ("a", "b"), "abs(a - b)::DOUBLE"),
    "compare_repeated_keys": "SELECT 'lines/repeated' AS path, 'not_validated' AS status, NULL::BIGINT AS rows_old, NULL::BIGINT AS rows_new, NULL::BIGINT AS rows_matched, NULL::BIGINT AS rows_differing, NULL::BIGINT AS rows_only_old, NULL::BIGINT AS rows_only_new, NULL::DOUBLE AS max_abs_delta, 'old result repeats a key' AS reason FROM (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE m > 1",
    "compare_other_kinds": "WITH j AS (SELECT o_custkey IS NOT NULL AS d, true AS o, true AS n FROM orders)" + _summary("orders/kinds", "j", "d", "NULL::DOUBLE"),
    "compare_by_brand": f"WITH {_BRANDS}" + _summary(None, "j", _differ("a", "b", 0.0, 0.0), "abs(a - b)::DOUBLE", "p_brand"),
    "positions_by_brand": f"WITH {_BRANDS} SELECT p_brand, k0, k1, position FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k0 NULLS FIRST, k1 NULLS FIRST) AS position FROM j) WHERE NOT (o AND n) OR a <> b",
    "attribution_by_segment": f"""WITH r AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
g AS (SELECT c_mktsegment, c_nationkey, sum({CENTS}) AS a, sum({CENTS}) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR l_quantity > 1) AS b,
             sum(CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 2 ELSE 1 END * {CENTS}) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR l_quantity > 1) AS c FROM r GROUP BY ALL),
f AS (SELECT c_mktsegment, bool_or(a IS DISTINCT FROM b) AS report, bool_or(b IS DISTINCT FROM c) AS model FROM g GROUP BY ALL)
SELECT c_mktsegment, CASE WHEN report AND model THEN 'both' WHEN report THEN 'report' WHEN model THEN 'model' ELSE 'unknown' END AS attribution,
       CASE WHEN NOT report AND NOT model THEN 'neither change alone reproduces the difference' END AS attribution_reason FROM f""",
    "partly_compared": f"""WITH {_SIDES}, s AS ({_summary('sales/partly_new', 'j', f"{_differ('r0', 'r1')} OR {_differ('n0', 'n1')}", 'greatest(abs(r0 - r1), abs(n0 - n1))::DOUBLE')}
UNION ALL SELECT 'sales/partly', 'same', count(*), count(*), count(*), 0, 0, 0, 0.0, NULL FROM old)
SELECT path, CASE status WHEN 'same' THEN 'not_validated' ELSE status END AS status, rows_old, rows_new, rows_matched, rows_differing, rows_only_old, rows_only_new, max_abs_delta, 'not compared: gone, come' AS reason FROM s""",
    "completeness_by_size": "SELECT user_id, n, bytes, 2::INTEGER AS columns, n >= 100000 OR (n + 1) * 2 > 1000000 OR bytes >= 300 AS truncated FROM (SELECT user_id, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY user_id)",
    "completeness": "SELECT user_id, n, columns, n >= 40 OR (n + 1) * columns > 150 AS truncated FROM (SELECT user_id, count(*) AS n, (user_id % 5 + 1)::INTEGER AS columns FROM events GROUP BY user_id)",
    "status_overview": f"WITH {_BRANDS}, s AS (SELECT p_brand, bool_or(NOT (o AND n) OR a <> b) AS d FROM j GROUP BY p_brand) SELECT count(*) FILTER (WHERE NOT d) AS same, count(*) FILTER (WHERE d) AS different, 0::BIGINT AS not_validated FROM s",
    "visual_by_region": f"WITH {_STAR} SELECT r_name, p_type, sum({CENTS})::BIGINT AS \"Revenue\", count(*) AS \"Lines\" FROM s WHERE (p_type IS NULL OR p_type NOT IN ('ECONOMY', 'SMALL')) AND l_quantity >= 5 AND (r_name, o_orderstatus) IN (('ASIA', 'O'), ('EUROPE', 'F'), ('AMERICA', 'O')) GROUP BY ALL",
    "visual_aggregations": """SELECT year(l_shipdate) AS year, sum(q)::BIGINT AS "Sum_q", avg(q) AS "Avg_q", (count(DISTINCT q) + coalesce(max(CASE WHEN q IS NULL THEN 1 END), 0))::BIGINT AS "DistinctCount_q", min(q) AS "Min_q", max(q) AS "Max_q", count(q) AS "Count_q", median(q) AS "Median_q"
FROM (SELECT *, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity::BIGINT END AS q FROM lineitem) GROUP BY 1""",
    "visual_two_valued": """SELECT o_orderstatus, count(*) FILTER (WHERE c IN (1, 2)) AS in_list, count(*) FILTER (WHERE c IS NULL OR c NOT IN (1, 2)) AS not_in_list, count(*) FILTER (WHERE c = 1 OR c IS NULL) AS in_with_blank,
count(*) FILTER (WHERE c IS NULL) AS is_blank, count(*) FILTER (WHERE c IS NOT NULL) AS not_blank, count(*) FILTER (WHERE c > 7 OR c IS NULL) AS either, count(*) FILTER (WHERE c IS NULL OR c <= 7) AS not_greater
FROM (SELECT o_orderstatus, nullif(o_custkey % 10, 3) AS c FROM orders) GROUP BY 1""",
    "visual_top_brands": f"WITH g AS (SELECT p_brand, sum({CENTS})::BIGINT AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, v AS \"Revenue\" FROM (SELECT *, rank() OVER (ORDER BY v DESC) AS r FROM g) WHERE r <= 5",
    "visual_card": f"WITH {_STAR} SELECT count(*) AS \"Lines\", sum(l_linenumber)::BIGINT AS \"Lines \" FROM s WHERE p_size < 10",
    "visual_keys_only": f"WITH {_STAR} SELECT DISTINCT r_name, o_orderpriority FROM s",
    "visual_blank_groups": "SELECT o_orderpriority, l_linenumber, sum(CASE WHEN l_linenumber < 3 THEN l_quantity::BIGINT END)::BIGINT AS \"V\" FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON l_orderkey = o_orderkey GROUP BY ALL HAVING \"V\" IS NOT NULL",
    "visual_long_list": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey < 3000 AND l_partkey % 2 = 0 GROUP BY 1",
    "supported_visuals": """SELECT p_partkey, reason IS NULL AS supported, reason FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'slicers have no data of their own' WHEN p_partkey % 5 = 3 THEN 'visual type map is not supported'
WHEN p_size % 4 = 0 THEN 'the visual has no fields' WHEN p_size % 7 = 6 THEN 'a filter could not be read' END AS reason FROM part)""",
}
