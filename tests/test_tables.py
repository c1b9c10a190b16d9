"""Wide rows printed on a page, read back per area."""

from helpers import rows

from tallyroom.sources.tables_on_pages import footer_controls, service_rows

AREAS = ["a", "b"]


def test_rows_parse_or_carry_a_reason(spark):
    lines = [
        "Police  Service (2)   1,234  $1,000  12.5% $10  3% $2,000",
        "Recovery (50) $(40) 1.0% $(5) 2.0% $6",
        "Roads 1 $2 3% 4 5% $6",
        "Subtotal",
        "Transit 1,900 900 10.0 $1 20.5 22",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string")
    got = rows(service_rows(df, "line", AREAS), "id", "label", "net", "levy", "area", "pct", "household", "reason")
    assert got == [
        (0, "Police Service", 1234, 1000, "a", "12.5", 10, None), (0, "Police Service", 1234, 1000, "b", "3", 2000, None),
        (1, "Recovery", -50, -40, "a", "1.0", -5, None), (1, "Recovery", -50, -40, "b", "2.0", 6, None),
        (2, "Roads", 1, 2, "a", "3", 4, None), (2, "Roads", 1, 2, "b", "5", 6, None),
        (3, None, None, None, None, None, None, "could not parse the table row"),
        (4, "Transit", 1900, 900, "a", "10.0", 1, None), (4, "Transit", 1900, 900, "b", "20.5", 22, None),
    ]


def test_footer_controls(spark):
    df = spark.createDataFrame([(1, "Total 100% $1,234 100%  $56"), (2, "Total 100% $1"), (3, "Roads 1 2 3 4 5 6")], "id int, line string")
    assert rows(footer_controls(df, "line", AREAS), "id", "area", "control") == [(1, "a", 1234), (1, "b", 56)]
