"""A small table of positioned characters, with two headers, a page break inside a row and a tall cell."""

from rosterlake.operators.statute_table import table_rows
from rosterlake.plans import list_queries, lists  # noqa: F401
from rosterlake.plans.registry import QUERIES


def line(page, y, *cells):
    """Cells (x, text) in one line; a layout character without a place stands between them."""
    chars = []
    for x, t in cells:
        if chars:
            chars.append((None, " "))
        chars += [(x + 5.0 * i, c) for i, c in enumerate(t)]
    return ("p", page, float(y), float(cells[0][0]), " ".join(t for _, t in cells), chars)


def header(page, y, shift=0):
    return line(page, y, (10 + shift, "Sanction Name"), (100 + shift, "Entity"), (200 + shift, "Location of Entity"), (310 + shift, "Date Imposed"), (400 + shift, "Status"), (500 + shift, "Federal Register"))


LINES = [
    line(0, 760, (10, "Master Sanctions List")), line(0, 740, (10, "Table 1: Act A")), header(0, 720),
    line(0, 700, (10, "Act A"), (100, "Acme"), (200, "China"), (310, "1/2/98"), (400, "Active"), (500, "63 FR 1")),
    line(0, 690, (100, "Corp")),
    line(0, 660, (10, "Act A"), (100, "Beta [aka B1]"), (200, "Iran"), (310, "3/4/2020"), (400, "Active"), (500, "85 FR 2")),
    line(0, 648, (10, "Act A"), (100, "Gamma"), (200, "Syria"), (310, "5/6/2021"), (400, "Active"), (500, "86 FR 3")),
    line(0, 40, (10, "Page 1 of 2")),
    line(1, 700, (100, "Holding")),
    header(1, 680, 20), line(1, 660, (30, "Act A"), (120, "Delta"), (220, "Russia"), (330, "7/8/2022"), (420, "Active"), (520, "87 FR 4")),
    line(1, 630, (30, "Other act"), (120, "Eps"), (220, "Iran"), (330, "9/9/2022"), (420, "Active"), (520, "87 FR 5")),
]


def test_rows_and_records(spark):
    df = spark.createDataFrame(LINES, "path string, page int, y0 double, x0 double, text string, chars array<struct<x0:double,ch:string>>")
    rows = table_rows(df)
    got = [(r["statute"], r["entity"], r["location"], r["date"], r["fr"]) for r in rows.orderBy("ord").collect()]
    assert got == [
        ("Act A", "Acme Corp", "China", "1/2/98", "63 FR 1"),
        ("Act A", "Beta [aka B1]", "Iran", "3/4/2020", "85 FR 2"),
        ("Act A", "Gamma Holding", "Syria", "5/6/2021", "86 FR 3"),
        ("Act A", "Delta", "Russia", "7/8/2022", "87 FR 4"),
        ("Other act", "Eps", "Iran", "9/9/2022", "87 FR 5"),
    ]
    assert lists.sanctions(rows).count() == 5


def test_lines_are_never_joined_or_broadcast(spark):
    plan = QUERIES["list_statute_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_a_line_that_is_there_twice_is_read_twice(spark):
    """Not four times; lines without a place are left out, and headers may stand in several lines of a band."""
    twice = line(0, 690, (100, "Corp"))
    parts = [line(2, 700, (10, "Sanction Name"), (100, "Entity")), line(2, 691, (200, "Location of Entity"), (310, "Date Imposed")), line(2, 682, (400, "Status"), (500, "Federal Register"))]
    row = line(2, 660, (10, "Act A"), (100, "Zeta"), (197, "Cuba"), (310, "1/1/2023"), (400, "Active"), (500, "88 FR 6"))
    lost = ("p", 2, None, 10.0, "Sanction", row[5])
    df = spark.createDataFrame([*LINES, twice, *parts, row, lost], "path string, page int, y0 double, x0 double, text string, chars array<struct<x0:double,ch:string>>")
    got = [(r["entity"], r["location"]) for r in table_rows(df).orderBy("ord").collect()]
    assert got == [("Acme Corp Corp", "China"), ("Beta [aka B1]", "Iran"), ("Gamma Holding", "Syria"), ("Delta", "Russia"), ("Eps", "Iran"), ("Zeta", "Cuba")]
