"""Price rows and opening hours."""

import time
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import pages, tuples
from pagesieve.operators import RowPattern, class_rows, opening_hours, price_rows

ROWS = class_rows(("li", "r"), ("b", "n"), ("i", "v"))

# A price list and opening hours as a page writes them.
PRICES = [
    ("תספורת נשים", "₪120", "120.00", False),
    ("תספורת + פן", "₪180", "180.00", False),
    ("צביעה מלאה", "₪280", "280.00", False),
    ("גוונים / הבהרות", "₪350+", "350.00", True),
    ("החלקה ברזילאית", "₪450+", "450.00", True),
    ("טיפול ומסכת שיער", "₪150", "150.00", False),
]
HOURS = [("א׳–ה׳", "09–19"), ("שישי", "09–14"), ("שבת", "סגור")]


def _markup(rows):
    return "<ul>" + "\n".join(
        f'<li class="r"><b class="n">{name}</b> <i class="v">{value}</i></li>'
        for name, value in rows
    ) + "</ul>"


def test_price_list(spark):
    df = pages(spark, _markup((n, v) for n, v, _, _ in PRICES))
    result = price_rows(df, ROWS)
    assert dict(result.dtypes) == {
        "page_id": "bigint", "pos": "int", "name": "string", "currency": "string",
        "amount": "decimal(30,6)", "open_ended": "boolean",
    }
    assert tuples(result) == [
        (0, i, name, "₪", Decimal(amount), more)
        for i, (name, _, amount, more) in enumerate(PRICES)
    ]


def test_price_forms(spark):
    forms = {
        "120 ₪": ("₪", "120.00", False),
        "&#8362;1,350.5 +": ("₪", "1350.50", True),
        "USD 5": ("USD", "5.00", False),
        "99": (None, "99.00", False),
        "ask + us": (None, None, None),
        "1-2": (None, None, None),
        "99999999999": (None, "99999999999", False),
        "": (None, None, None),
        "12,50 €": ("€", "12.50", False),
        "12,345 €": ("€", "12345", False),
        "1,2,3": (None, None, None),
        "$5 each": (None, None, None),
        "5 min": (None, None, None),
        "$5 USD": (None, None, None),
        "1.350,50 €": ("€", "1350.50", False),
        "1.350 €": ("€", "1.35", False),
        "1 200 ₪": ("₪", "1200", False),
        "1 200,5&nbsp;₪+": ("₪", "1200.5", True),
        "¥120000000": ("¥", "120000000", False),
        "$0.125": ("$", "0.125", False),
        "$0.1234567": (None, None, None),
    }
    df = pages(spark, _markup((str(i), v) for i, v in enumerate(forms)))
    expected = [
        (0, i, str(i), c, a and Decimal(a), o) for i, (c, a, o) in enumerate(forms.values())
    ]
    assert tuples(price_rows(df, ROWS)) == sorted(expected, key=repr)


def test_rows_are_found_in_untidy_markup(spark):
    df = pages(
        spark,
        """<!-- <li class="r"><b class="n">no</b><i class="v">$1</i> -->
        <script>'<li class="r"><b class="n">no</b><i class="v">$1</i>'</script>
        <p title="<!-- <li class='r'>"><p title='<script>'>
        <LI id=x CLASS='big r'><div><b class=n>one<br>two</b></div><div><i class="v w">$<u>2</u></i></div>
        <li class="rr"><b class="n">no</b><li class="r-x"><b class="n">no</b>
        <li class=r><b class="nn">no</b><b class="n">three <i class="v">$3+</i>""",
        "<p>no rows</p>",
        None,
    )
    # A name that is never closed runs to the end of its row.
    assert tuples(price_rows(df, ROWS)) == [
        (0, 0, "one two", "$", Decimal("2.00"), False),
        (0, 1, "three $3+", "$", Decimal("3.00"), True),
    ]


def test_patterns_are_free(spark):
    pattern = RowPattern(r"<tr>|<row>", r"<td>([^<]*)</td>", r"<td>[^<]*</td><td>([^<]*)</td>")
    df = pages(spark, "<tr><td>a</td><td>€7</td></tr><row><td>b</td><td>€8</td></row>")
    assert tuples(price_rows(df, pattern)) == [
        (0, 0, "a", "€", Decimal("7.00"), False), (0, 1, "b", "€", Decimal("8.00"), False),
    ]


def test_opening_hours(spark):
    result = opening_hours(pages(spark, _markup(HOURS)), ROWS)
    assert dict(result.dtypes) == {
        "page_id": "bigint", "dow": "int", "open_hour": "int", "close_hour": "int",
        "closed": "boolean", "open_minute": "int", "close_minute": "int",
    }
    assert tuples(result.drop("open_minute", "close_minute")) == [
        *((0, day, 9, 19, False) for day in range(1, 6)),
        (0, 6, 9, 14, False),
        (0, 7, None, None, True),
    ]


def test_hours_forms(spark):
    nothing = (None, None, False, None, None)
    forms = [
        ("ו׳ – א׳", "9:00 - 14:00", [(d, 9, 14, False, 0, 0) for d in (6, 7, 1)]),
        ("שני", "9", [(2, *nothing)]),
        ("holiday", "10–12", [(None, 10, 12, False, 0, 0)]),
        ("ג׳–holiday", "10–12", [(None, 10, 12, False, 0, 0)]),
        ("א'–ב'", "09:30–18:00", [(d, 9, 18, False, 30, 0) for d in (1, 2)]),
        ("א-ב", "9—13", [(d, 9, 13, False, 0, 0) for d in (1, 2)]),
        ("יום ראשון", "9–24", [(1, 9, 24, False, 0, 0)]),
        ("ב׳, ד׳", "09–13, 16–19", [(d, o, c, False, 0, 0) for d in (2, 4) for o, c in ((9, 13), (16, 19))]),
        ("שבת", "9:00–99", [(7, *nothing)]),
        ("שבת", "10:00:11:00", [(7, *nothing)]),
        ("שבת", "9:75–10, סגור", [(7, *nothing), (7, None, None, True, None, None)]),
    ]
    rows = opening_hours(pages(spark, *(_markup([(d, t)]) for d, t, _ in forms)), ROWS)
    assert tuples(rows) == sorted(
        ((i, *row) for i, (_, _, expected) in enumerate(forms) for row in expected), key=repr
    )


def test_other_languages_by_parameter(spark):
    df = pages(spark, _markup([("Mon–Tue", "8–12"), ("Wed", "closed")]))
    days = {"Mon": 2, "Tue": 3, "Wed": 4}
    assert tuples(opening_hours(df, ROWS, days, "closed").select("dow", "open_hour", "closed")) == [
        (2, 8, False), (3, 8, False), (4, None, True),
    ]


def test_a_row_does_not_depend_on_its_neighbours(spark):
    broken, good = '<li<!-- x --> class="r"><b class="n">no</b>', _markup([("x", "1")])
    rows = price_rows(pages(spark, broken, good + broken), ROWS)
    assert [(r.page_id, r.name) for r in rows.collect()] == [(1, "x")]


def test_many_open_tags_take_linear_time(spark):
    n = 200_000
    df = pages(spark, "<li " * n, "<li/x=" * n, "<li x='" * n, '<li class="r" x="' * n, "<li class=r'" * n)
    started = time.time()
    for rows in (price_rows(df, ROWS), opening_hours(df, ROWS)):
        rows.agg(*(F.count(c) for c in rows.columns)).first()
    assert time.time() - started < 60


def test_hostile_rows_take_linear_time(spark):
    n = 50_000
    df = pages(
        spark,
        '<li class="r">' * n,
        '<li class="' * n,
        "<li " + "x " * n,
        '<li class="' + " r" * n,
        '<li class="r"><b class="n">' + "<b " * n,
        _markup([("x", "1")] * n),
        _markup([("x", "1" + "," * n + "x1"), ("x", "$" * n), ("x", "1 " * n)]),
    )
    started = time.time()
    result = price_rows(df, ROWS)
    # Ask for every column, or the patterns for it are never run.
    counted = result.agg(F.count("*"), *(F.count(c) for c in result.columns)).first()
    # n + 1 + n + 3 rows; a class whose quote never closes is none.
    assert counted[0] == 2 * n + 4
    assert time.time() - started < 60
