"""Visual queries on a star with known answers, and conditions."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.conditions import All, Both, Comparison, Field, In, Not, TopN, compiled, filtered, rendered, renamed
from tallyspark.operators.visual_query import AGGREGATIONS, Dimension, Star, Visual, context, refusal, unique_names, visual_query


@pytest.fixture(scope="module")
def star(spark):
    sales = spark.createDataFrame([(1, 20250115, "North", 1200, 800), (2, 20250115, "South", 80, 40), (3, 20250210, "North", 45, 20), (1, 20240310, "West", 1100, 760)], "ProductKey long, DateKey long, Region string, Amount long, Cost long")
    product = spark.createDataFrame([(1, "Road Bike", "Bikes"), (2, "Jersey", "Clothing"), (3, "Bottle", "Accessories")], "PK long, Product string, Category string")
    date = spark.createDataFrame([(20240310, 2024, "2024-03"), (20250115, 2025, "2025-01"), (20250210, 2025, "2025-02")], "DK long, Year long, Month string")
    return Star(sales, (Dimension(product, "ProductKey", "PK"), Dimension(date, "DateKey", "DK")))


YEARS = In((Field("Date", "Year"),), ((2024,), (2025,)))
NOT_ACCESSORIES = Not(In((Field("Product", "Category"),), (("Accessories",),)))


def total():
    return F.sum("Amount")


def margin_of():
    return F.try_divide(F.sum("Amount") - F.sum("Cost"), F.sum("Amount"))



def rows(df):
    return sorted(tuple(r) for r in df.collect())


def year(n):
    return Comparison(Field("Date", "Year"), "=", n)


def test_cards(star):
    for n, amount, margin in ((2025, 1280, 0.34375), (2024, 1100, 0.3090909090909091)):
        f = (context((YEARS,), (NOT_ACCESSORIES,), (), (year(n),)),)
        assert rows(visual_query(star, Visual((), {"t": total()}, f))) == [(amount,)]
        assert rows(visual_query(star, Visual((), {"m": margin_of()}, f))) == [(pytest.approx(margin),)]


def test_by_month_and_region(star):
    f = (context((YEARS,), (NOT_ACCESSORIES,), (), (year(2025),)),)
    assert rows(visual_query(star, Visual(("Month",), {"t": total()}, f))) == [("2025-01", 1280)]
    assert rows(visual_query(star, Visual(("Region",), {"t": total()}, (YEARS,)))) == [("North", 1245), ("South", 80), ("West", 1100)]


def test_table_with_two_values(star):
    kept = In((Field("Product", "Category"),), (("Bikes",), ("Clothing",)))
    v = Visual(("Category", "Product"), {"t": total(), "m": margin_of()}, (YEARS, kept))
    assert rows(visual_query(star, v)) == [("Bikes", "Road Bike", 2300, pytest.approx(0.3217391304347826)), ("Clothing", "Jersey", 80, 0.5)]


def test_top_n_and_no_values(star):
    top = TopN(Field("Product", "Product"), 1, "total")
    assert rows(visual_query(star, Visual(("Product",), {"t": total()}, (top,)), {"total": total()})) == [("Road Bike", 2300)]
    assert rows(visual_query(star, Visual(("Year",)))) == [(2024,), (2025,)]


def test_unmatched_facts_form_a_blank_group(spark, star):
    lost = Star(star.fact.unionByName(spark.createDataFrame([(9, 20250115, "North", 5, 1)], star.fact.schema)), star.dimensions)
    got = {r[0]: r[1] for r in visual_query(lost, Visual(("Category",), {"t": total()}, (NOT_ACCESSORIES,))).collect()}
    assert got[None] == 5 and "Accessories" not in got


def test_aggregations_with_blanks(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 3), ("b", None)], "k string, v long")
    got = {r.k: r for r in visual_query(df, Visual(("k",), {n: f(F.col("v")) for n, f in AGGREGATIONS.items()})).collect()}
    assert (got["a"].Sum, got["a"].Avg, got["a"].DistinctCount, got["a"].Count, got["a"].Median) == (4, 2.0, 3, 2, 2.0)
    assert (got["b"].DistinctCount, got["b"].Count) == (1, 0)


@pytest.mark.parametrize("condition, kept", [(In((Field("t", "k"),), ((1,),)), [1]), (Not(In((Field("t", "k"),), ((1,),))), [None, 0, 2]), (Comparison(Field("t", "k"), "=", None), [None]), (Not(Comparison(Field("t", "k"), ">", 0)), [None, 0]), (All(), [None, 0, 1, 2]), (In((Field("t", "k"),), ((None,), (2,))), [None, 2]), (Both((Comparison(Field("t", "k"), ">=", 1), Not(Comparison(Field("t", "k"), "=", 2)))), [1])])
def test_two_valued_logic(spark, condition, kept):
    df = spark.createDataFrame([(None,), (0,), (1,), (2,)], "k int")
    assert sorted((r.k for r in df.where(compiled(condition)).collect()), key=lambda x: (x is not None, x)) == kept


def test_blank_orders_refused_and_long_lists_joined(spark):
    with pytest.raises(ValueError):
        compiled(Comparison(Field("t", "k"), ">", None))
    with pytest.raises(ValueError):
        compiled(In((Field("t", "k"),), ()))
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert filtered(df, In((Field("t", "k"),), tuple((i,) for i in range(2000)))).count() == 2000


def test_rendering_and_renaming():
    c = In((Field("S", "K"),), ((3,), ("b",), (None,), (10,), (3,)))
    assert rendered(c) == "S[K] in (blank, 3, 10, 'b')"
    moved = renamed(Not(c), {("S", "K"): ("T", "L"), ("T", "L"): ("U", "M")})
    assert rendered(moved).startswith("not T[L] in")


def test_refusals():
    assert refusal(Visual(("a",)), is_slicer=True)
    assert "map" in refusal(Visual(("a",), visual_type="map"))
    assert refusal(Visual(()))
    assert refusal(Visual(("a",)), aggregations=("Variance",))
    assert refusal(Visual(("a",), filters=(In((Field("a", "x"), Field("b", "y")), ((1, 2),)),)))
    assert refusal(Visual(("a",), filters=(Not(In((Field("a", "x"),), ())),)))
    assert refusal(Visual(("a",), filters=(YEARS,))) is None
    assert refusal(Visual(("a",), visual_type="cardVisual")) is None and refusal(Visual(("a",), visual_type="scatterChart"))
    assert refusal(Visual(("a",)), field_kinds=("column", "hierarchy level"))
    assert refusal(Visual(("a",), filters=(Not(In((Field("m", "Total"),), ((1,),))),)), measures=frozenset({("m", "Total")})) == "a filter on a measure"
    assert unique_names(["Amount", "Amount", "Cost"]) == ["Amount", "Amount (2)", "Cost"]
