"""Rules for numbers, dates and their support, on sentences put together from the rules."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from groundwork.functions.numbers import dates, number_errors, passage_errors, quantities, read_passage
from groundwork.functions.text import nfkc
from groundwork.operators import grounding

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def scaled_money():
    """A sum is the same in rupees, lakh and crore, however it is grouped or marked."""
    for crore in (3, 47, 905):
        rupees = crore * 10_000_000
        forms = [f"₹{crore} crore", f"Rs {crore * 100} lakh", f"Rs. {rupees}", f"₹{rupees:,}", f"INR {crore}.0 crore"]
        for a, b in itertools.permutations(forms, 2):
            yield f"The ferry line owes {a}.", f"Owed by the line: {b}.", True
        yield f"The ferry line owes ₹{crore} lakh.", f"Owed by the line: ₹{crore} crore.", False
        yield f"The ferry line owes ₹{crore + 1} crore.", f"Owed by the line: ₹{crore} crore.", False


def kinds():
    """Percent, basis points, times, rupees and plain counts never support each other."""
    shown = {"percent": "38%", "points": "38 bps", "times": "38x", "money": "₹38", "count": "38 boats"}
    for a, b in itertools.product(shown, repeat=2):
        yield f"The figure is {shown[a]}.", f"We saw {shown[b]}.", a == b
    yield "The figure is 38 percent.", "We saw 38%.", True
    yield "The figure is 38 basis points.", "We saw 38 bps.", True
    yield "The figure is 38 times.", "We saw 38x.", True
    yield "The figure is .75 times.", "We saw 0.75x.", True


def signs():
    """A direction word gives its number a sign, which the evidence has to share."""
    up, down = ("up", "rose", "a growth of", "an increase of"), ("down", "fell", "a decline of", "a drop of")
    for words, sign, other in ((up, "+", "-"), (down, "-", "+")):
        for word in words:
            yield f"Crossings {word} 64 bps.", f"Crossings: {sign}64 bps.", True
            yield f"Crossings {word} 64 bps.", f"Crossings: {other}64 bps.", False
    yield "Crossings moved −64 bps.", "Crossings: -64 bps.", True


def rounding():
    """Only a claim marked as approximate may round, half up at its last digit, at any length."""
    for mark in ("about ", "around ", "roughly ", "approximately ", "~"):
        yield f"Fuel took {mark}7%.", "Fuel: 6.5%.", True
        yield f"Fuel took {mark}7%.", "Fuel: 7.49%.", True
        yield f"Fuel took {mark}7%.", "Fuel: 6.49%.", False
        yield f"Fuel took {mark}7%.", "Fuel: 7.5%.", False
    yield "Fuel took 7%.", "Fuel: 6.9%.", False
    yield "Fuel took about 7.30%.", "Fuel: 7.304%.", True
    yield "Fuel took about 7.30%.", "Fuel: 7.305%.", False
    yield "Fuel took about 10%.", "Fuel: 9.5%.", True
    yield "Fuel took about 100%.", "Fuel: 99.96%.", True
    yield "Fuel took about -7%.", "Fuel: -6.5%.", True
    yield "Fuel took about -7%.", "Fuel: -7.5%.", False
    yield "Fuel took about 0%.", "Fuel: 0.4%.", True
    yield "Fuel took about 0%.", "Fuel: 0.5%.", False
    yield "The hull cost about ₹3.2 crore.", "The hull: ₹3,15,00,000.", True
    yield "The hull cost about ₹3.2 crore.", "The hull: ₹3,14,99,999.", False
    nines = "9" * 45
    yield f"It weighs about 1{'0' * 45} grams.", f"It weighs {nines}.5 grams.", True
    yield f"It weighs about 1.{'0' * 20}1 percent.", f"It weighs 1.{'0' * 20}12 percent.", True
    yield f"It weighs about 1.{'0' * 20}1 percent.", f"It weighs 1.{'0' * 20}16 percent.", False


def ranges():
    """Both bounds of a range carry its unit."""
    for link in ("-", " - ", "–", " – ", " to "):
        yield "It takes 21% or 24% more.", f"It takes 21{link}24% more.", True
        yield f"It takes 21{link}24% more.", "It takes 21% to 24% more.", True
        yield "It takes 21 or 24% more.", f"It takes 21{link}24% more.", False


def days():
    """A day is the same in any notation; a day that cannot be has no support."""
    for day, month, year in ((7, 2, 2025), (28, 11, 2024), (1, 5, 2026)):
        name = MONTHS[month - 1]
        forms = [f"{day} {name} {year}", f"{name} {day}, {year}", f"{year}-{month:02d}-{day:02d}", f"{day} {name[:3].upper()} {year}"]
        for a, b in itertools.permutations(forms, 2):
            yield f"The pier opened on {a}.", f"Opened {b}.", True
        for form in forms:
            yield f"The pier opened on {form}.", f"Opened {year}-{month:02d}-{day + 1:02d}." if day < 28 else "Opened.", False
    yield "The pier opened on 30 February 2025.", "Opened 2025-02-28, it is said on 30 February 2025.", False
    yield "There were 7 piers.", "Opened 7 February 2025.", False


def labels():
    """Quarters, halves, fiscal years and bare years are no numbers; scaled years are."""
    for label in ("Q3 FY25", "H1 FY2024", "FY2024", "q2", "2019", "1987"):
        yield f"In {label} the pier was shut.", "The pier was shut.", True
    yield "In FY25 it carried 5% more.", "In FY25 it carried 6% more.", False
    yield "It cost ₹2019 crore.", "It cost ₹2018 crore.", False


TABLE = "| ₹ lakh | 2025 | Change |\n|---|---|---|\n| Tickets | 412 | +3.5% |\n| Freight | 77 | -1.2% |"


def tables():
    """Cells take the currency of their own table, and of no other; years in its head are no sums."""
    yield "Tickets brought ₹412 lakh.", TABLE, True
    yield "Tickets brought ₹412 crore.", TABLE, False
    yield "Tickets rose 3.5%.", TABLE, True
    yield "Freight fell 1.2%.", TABLE, True
    yield "Freight rose 1.2%.", TABLE, False
    yield "Tickets brought ₹2025 lakh.", TABLE, False
    other = TABLE + "\n\n| Boat | Seats |\n|---|---|\n| Heron | 90 |"
    yield "The Heron cost ₹90 lakh.", other, False
    yield "The Heron has 90 seats.", other, True
    after = TABLE + "\n\nThe crew numbers 31."
    yield "The crew numbers 31.", after, True
    yield "The crew cost ₹31 lakh.", after, False


RULES = (scaled_money, kinds, signs, rounding, ranges, days, labels, tables)


@pytest.mark.parametrize("rule", RULES, ids=lambda rule: rule.__name__)
def test_support_of_numbers_and_dates(spark, rule):
    rows = spark.createDataFrame(list(rule()), "claim string, evidence string, supported boolean")
    rows = rows.withColumns({"c": nfkc(F.col("claim")), "e": nfkc(F.col("evidence"))})
    errors = number_errors(F.col("c"), F.col("e"), F.lit(""))
    wrong = rows.select("claim", "evidence", "supported", errors.alias("errors")).filter(
        F.col("supported") != (F.size("errors") == 0)).collect()
    assert wrong == []


def _values(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(quantities(F.col("t")).alias("q")).first()
    return [(q.text, q.dimension, q.key, q.approx) for q in row.q]


@pytest.mark.parametrize("text, expected", [
    ("Rs.61 then Rs. 61", [("61", "rupees", "61e0", False)]),
    ("lost Rs 8", [("8", "rupees", "8e0", False)]),
    ("fell 4.20%", [("4.20", "percent", "-42e-1", False)]),
    ("release 3.4.5 of B7", []),
    ("around Rs 3,00,000", [("3,00,000", "rupees", "3e5", True)]),
    ("0 or -0.0", [("0", "scalar", "0", False), ("-0.0", "scalar", "0", False)]),
    ("७५ percent", [("७५", "percent", "75e0", False)]),
    ("9" * 50, [("9" * 50, "scalar", "9" * 50 + "e0", False)]),
    ("", []),
    ("none at all", []),
])
def test_quantities(spark, text, expected):
    assert _values(spark, text) == expected


def test_dates_and_their_faults(spark):
    text = "From 31 April 2025 and 2025-13-01 to 9 Feb 2026 and July 14, 2023; not 12 Brumaire 2024."
    row = spark.createDataFrame([(text,)], "t string").select(dates(F.col("t")).alias("d")).first()
    found = [(d.raw, str(d.value)) for d in row.d]
    assert found[0] == ("31 April 2025", "None") and ("9 Feb 2026", "2026-02-09") in found and ("July 14, 2023", "2023-07-14") in found
    assert all("Brumaire" not in raw for raw, _ in found)


def _joined_cases():
    """Passages whose ends and beginnings belong together in every way the rules know."""
    ends = ("It cost Rs", "It cost Rs.", "Paid ₹", "Sales fell", "Sales fell by", "a decline", "a decline of", "Lost about", "approx.", "spent ~", "A sum of 15", "15 to",
            "15 basis", "On 5 March", "On 5 Mar.", "March 5,", "Seen in Q", "Seen in FY", "**Amounts in ₹ crore**", "| Metric | ₹ lakh |", "| Metric | Now |", "Plain end.", "", "  ", "until 2021-0")
    starts = ("15 crore was due.", "15", "by 15 lakh", "of 15%", "to 17 percent", "points more", "percent of all", "lakh in all", "crore", "x the old rate", "March 2024 began", "2024 began", "3 was", "24 was",
              "|---|---|\n| Fuel | 15 |", "| Fuel | 15 | 2,000 |", "Rs 15 more", "~15", "-15 bps", "Plain start 15.", "", ".5 times", "8 April 2024")
    claims = ("It cost Rs 15 crore and 15 lakh, 15%, 17 percent, 15 bps, -15 lakh, 15, 2000 crore, 2,000.", "On 5 March 2024 and 8 April 2024 and 2024-03-05.", "About 15 times; fell by 15%; 3 or 24; Rs 15; .5 times; 15 basis points.")
    for k, (a, b) in enumerate(itertools.product(ends, starts)):
        yield claims[k % 3], [a, b]
        yield claims[(k + 1) % 3], [f"First. {a}", b, ends[(7 * k + 3) % len(ends)], starts[(5 * k) % len(starts)]]


def test_passages_read_once_give_what_the_joined_text_gives(spark):
    cases = [(k, text, quotes) for k, (text, quotes) in enumerate(_joined_cases())]
    titles = ("Results 5 March", "Notes", "April", "2024")
    day = datetime.date(2024, 2, 3)
    quotes = [(k, at, q, titles[(k + at) % 4], None if k % 11 == at else day) for k, _, qs in cases for at, q in enumerate(qs)]
    rows = spark.createDataFrame(quotes, "k int, at int, quote string, title string, published date")
    rows = rows.withColumns(read_passage(F.col("quote"), F.col("title"), F.col("published")))
    cited = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "quote", "published", "values", "days", "context", "context_days", "joint"))).alias("p"))
    claims = spark.createDataFrame([(k, t, "\n".join(qs)) for k, t, qs in cases], "k int, t string, e string").join(cited, "k")
    context = F.array_join(F.col("p.context"), "\n")
    both = claims.select("e", passage_errors(F.col("t"), F.col("p")).alias("once"), number_errors(F.col("t"), F.col("e"), context).alias("joined"))
    assert [r for r in both.collect() if r.once != r.joined] == []
    assert both.filter(F.size("once") > 0).count() > 300


def test_hot_passage_is_read_once(spark):
    """Thousands of claims cite one passage: the passages that are read stay two."""
    units = spark.createDataFrame([("p", f"S1.u0{k}", "S1", True, f"Rs {k} crore", "T", datetime.date(2024, 1, 1), 10) for k in (1, 2, 3)],
                                  "pack_id string, uid string, sid string, admitted boolean, quote string, title string, published date, age_days int")
    claims = spark.range(4000).selectExpr("'p' as pack_id", "id as claim_id", "'bull' as section", "'It had Rs 1 crore.' as text", "'reported_fact' as kind",
                                          "array('S1.u01', if(id = 7, 'S1.u02', 'S9.u01')) as cites")
    assert grounding.read_passages(claims, units).count() == 2
    errors = grounding.check_claims(claims, units).groupBy("code_errors").count().collect()
    assert sorted((tuple(r["code_errors"]), r["count"]) for r in errors) == [((), 1), (("Unknown cited unit: S9.u01",), 3999)]
