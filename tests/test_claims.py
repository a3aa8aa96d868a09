"""Golden rows for the claim rules, verdicts and routing."""

import datetime

import pytest
from pyspark.sql import functions as F

from groundwork import fixed
from groundwork.functions.text import host, safe_code, seconds, source_ids, words_before_sources
from groundwork.operators import grounding, routing, verdicts

UNITS = ("pack_id string, uid string, sid string, admitted boolean, quote string, title string, published date, "
         "age_days int, tier int")


def unit(text="Fares brought Rs 64 crore.", sid="S1", admitted=True, title="Results", published="2026-08-01", age=30, tier=1):
    return ("p", f"{sid}.u01", sid, admitted, text, title, datetime.date.fromisoformat(published), age, tier)


def claim(text="Fares brought Rs 64 crore.", cites=("S1.u01",), kind="reported_fact", section="bull"):
    return section, text, kind, list(cites)


def check(spark, cases):
    """cases: (claim, units) -> error lists, each case in a pack of its own and one Spark run."""
    claims, units = [], []
    for i, (one, its_units) in enumerate(cases):
        claims.append((f"p{i}", i, *one))
        units += [(f"p{i}", *u[1:]) for u in its_units]
    c = spark.createDataFrame(claims, "pack_id string, claim_id int, section string, text string, kind string, cites array<string>")
    rows = grounding.check_claims(c, spark.createDataFrame(units or [unit()], UNITS)).collect()
    return [r.code_errors for r in sorted(rows, key=lambda r: r.claim_id)]


# Advice names a rating or tells the reader to deal; facts say who holds or buys what.
ADVICE = ("A hold rating.", 'Keeps a "buy" recommendation.', "A buy call.", "A strong sell.", "The stock is a hold.", "The rating is sell.",
          "The broker rated it a sell.", "We recommend selling.", "Investors should sell the shares.", "Sell HERON shares.",
          "We recommend investors sell the stock.", "Hold this stock.", "Buy the shares.", "Sell now.", "The price target was cut.",
          "Much upside remains.", "The next multibagger.", "We recommend buy.")
FACTS = ("Founders hold 31.4% of the shares.", "Founders hold shares.", "The ferry line plans to buy diesel and sell old hulls.",
         "Management recommends selling old engines.", "The line will buy HERON shares for its pension fund.", "Founders hold HERON shares.",
         "The line may buy HERON shares.", "We recommend travellers buy day passes.", "The crew set a punctuality target.",
         "The target is fewer delays.", "The holding grew for target_line.")


def test_claim_rules(spark):
    pledge = unit("Founders own 47%.", "S2", title="Register of 31 May 2026", published="2026-07-15")
    demand = unit("The port was closed.", "S8", title="Notice under Rule 41", published="2026-08-04")
    old = unit("Founders own 47%.", age=700, published="2024-03-18")
    table_a = unit("| ₹ crore | Q1 |", "S1"), unit("| Fares | 64 |", "S3")
    cases = [
        (claim(section="snapshot"), [unit()], None),
        (claim(cites=()), [unit()], "Claim must cite at least one unit"),
        (claim(cites=("S1.u99",)), [unit()],
         ["Unknown cited unit: S1.u99", "Number 64 (rupees) is not supported by the cited quotes"]),
        (claim(), [unit(admitted=False)],
         ["Cited unit S1.u01 belongs to an excluded document", "Number 64 (rupees) is not supported by the cited quotes"]),
        (claim(), [unit("The line runs ferries.")], "Number 64 (rupees) is not supported by the cited quotes"),
        (claim("By 31 May 2026, founders own 47%.", ("S2.u01",)), [pledge], None),
        (claim("The port was closed on August 4, 2026.", ("S8.u01",)), [demand], None),
        (claim("The port was closed on 2026-08-04.", ("S8.u01",)), [demand], None),
        (claim("The port was closed on 5 August 2026.", ("S8.u01",)), [demand],
         "Date 5 August 2026 is not found in the cited source"),
        (claim("The port had 41 closures.", ("S8.u01",)), [demand], "Number 41 (scalar) is not supported by the cited quotes"),
        (claim("They own 47%."), [old], "Claim citing stale source S1 must include its month or year"),
        (claim("In 2024, they own 47%."), [old], None),
        (claim("In March, they own 47%."), [old], None),
        (claim("In Mar, they own 47%."), [old], None),
        (claim("In April, they own 47%."), [old], "Claim citing stale source S1 must include its month or year"),
        (claim("They own 47%.", ("S1.u01", "S1.u01")), [old], "Claim citing stale source S1 must include its month or year"),
        (claim(), [unit(age=365)], None),
        (claim(), [unit(age=366)], "Claim citing stale source S1 must include its month or year"),
        (claim("Fares brought \x1564 crore."), [unit("Fares brought 64 crore.")],
         "Claim contains a nonprinting control character; use plain words or a valid currency symbol"),
        (claim("Fares brought\t₹64 crore.\r\n", section="snapshot"), [unit()], None),
        (claim("   "), [unit()], "Claim text must be a nonempty string"),
        (claim("Fares brought Rs 64 crore — up."), [unit()], "Use a comma or period instead of an em dash"),
        (claim(kind="guess"), [unit()], "Claim kind is invalid"),
        (claim("The master expects fog.", kind="management_view_or_forecast", section="snapshot"), [unit("x")],
         "Snapshot claims must be reported_fact"),
        (claim("Fares brought ₹64 crore.", ("S1.u01", "S3.u01")), list(table_a), None),
        (claim("Fares brought ₹64 crore.", ("S3.u01", "S1.u01")), list(table_a), "Number 64 (rupees) is not supported by the cited quotes"),
    ]
    cases += [(claim(t), [unit(t)], "Claim contains an investment-advice phrase") for t in ADVICE]
    cases += [(claim(t), [unit(t)], None) for t in FACTS]
    got = check(spark, [(c, u) for c, u, _ in cases])
    wrong = [(c, g, want) for (c, _, want), g in zip(cases, got) if g != ([want] if isinstance(want, str) else want or [])]
    assert wrong == []


def test_number_of_rows_survives_a_hot_passage(spark):
    """Two thirds of the claims cite one passage; every claim keeps its own result."""
    claims = spark.range(3000).select(
        F.lit("p").alias("pack_id"), F.col("id").alias("claim_id"), F.lit("bull").alias("section"),
        F.concat(F.lit("Fares brought Rs "), F.when(F.col("id") % 2 == 0, 64).otherwise(65), F.lit(" crore.")).alias("text"),
        F.lit("reported_fact").alias("kind"), F.array(F.when(F.col("id") % 3 < 2, "S1.u01").otherwise("S2.u01")).alias("cites"))
    units = spark.createDataFrame([unit(), unit("Fares brought Rs 65 crore.", "S2")], UNITS)
    rows = grounding.check_claims(claims, units).groupBy((F.size("code_errors") == 0).alias("ok")).count().collect()
    assert {r.ok: r["count"] for r in rows} == {True: 1500, False: 1500}


ANSWERS = "pack_id string, claim_key string, stage string, question string, attempt int, choice string, confidence double, asked_no int"


def test_confidence_gate(spark):
    rows = []
    for key, first, again in [("sure", ("supports", .8), None), ("agrees", ("supports", .5), ("supports", .8)),
                              ("weak", ("supports", .5), ("supports", .79)), ("flips", ("supports", .5), ("contradicts", .99)),
                              ("lost", ("supports", .5), None)]:
        rows.append(("p", key, "cited_evidence", "relation", 1, *first, 1))
        if again:
            rows.append(("p", key, "cited_evidence", "relation", 2, *again, 1))
    # Asked again later: other answers, however sure, change nothing and lend nothing.
    rows += [("p", key, "cited_evidence", "relation", attempt, "contradicts", .95, 2) for key in ("sure", "weak", "lost") for attempt in (1, 2)]
    got = {r.claim_key: (r.accepted, r.unanswered) for r in verdicts.gated(spark.createDataFrame(rows, ANSWERS), ["claim_key"]).collect()}
    assert got == {"sure": ("supports", False), "agrees": ("supports", False), "weak": (None, False), "flips": (None, False),
                   "lost": (None, True)}


def test_cross_tier_needs_every_comparison(spark):
    units = spark.createDataFrame([unit(sid="S4", tier=4), unit(sid="S1", tier=1)], UNITS)
    claims = spark.createDataFrame([("p", 1, "a", ["S4.u01"]), ("p", 2, "b", ["S4.u01"]), ("p", 3, "c", ["S1.u01", "S4.u01"])],
                                   "pack_id string, claim_id int, claim_key string, cites array<string>")
    docs = spark.createDataFrame([("p", "S1", "evidence", 1), ("p", "S2", "evidence", 2), ("p", "S3", "excluded", 1), ("p", "S4", "evidence", 4)],
                                 "pack_id string, sid string, status string, tier int")
    rows = [("p", "a", "higher_tier:S1", "relation", 1, "contradicts", .9, 1), ("p", "a", "higher_tier:S2", "relation", 1, "says_nothing", .9, 1),
            ("p", "a", "higher_tier:S3", "relation", 1, "contradicts", .9, 1), ("p", "b", "higher_tier:S1", "relation", 1, "supports", .9, 1)]
    claims = claims.withColumns({"section": F.lit("bull"), "text": F.lit("Text."), "kind": F.lit("reported_fact")})
    per_claim, findings = verdicts.cross_tier(grounding.check_claims(claims, units), docs, spark.createDataFrame(rows, ANSWERS))
    assert {r.claim_id: (r.contradictions, r.unresolved, r.tier_unavailable) for r in per_claim.collect()} == {
        1: (1, 0, False), 2: (0, 0, True)}
    assert [(r.claim_id, r.higher_tier_source, r.cited_sources, r.error) for r in findings.collect()] == [
        (1, "S1", ["S4"], "Higher-tier source S1 contradicts the claim.")]


def _route(spark, score=None, promo=0.0, directed=0.0, raw=0.0, body="Text.", age=5, removals=0, answered=True):
    docs = spark.createDataFrame([("p", "S1", body, "https://a.example/x", age, [("html_comment", 1)] * removals)],
                                 "pack_id string, sid string, body string, url string, age_days int, removals array<struct<kind:string,count:int>>")
    targets = spark.createDataFrame([("p", "HERON")], "pack_id string, ticker string")
    answers = spark.createDataFrame([("p", "S1", promo, directed, raw, score)] if answered else [],
                                    "pack_id string, sid string, promotional double, ai_directed double, raw_ai_directed double, same_company double")
    return routing.route(routing.hard_identifiers(docs, targets), answers).first()


@pytest.mark.parametrize("score, status", [(0.49, "excluded"), (0.5, "unclear"), (1.0, "unclear"), (1.5, "unclear"), (1.51, "evidence")])
def test_company_score_limits(spark, score, status):
    assert _route(spark, score).status == status


def test_routing_precedence(spark):
    assert _route(spark, 2.0, age=-1).reason == "Published after the requested as-of date"
    assert _route(spark, 2.0, promo=0.5, directed=0.5).reason == (
        "Promotional stock-tip content; AI-directed instructions remain after hidden-content removal")
    assert _route(spark, promo=0.5, body="From HERON pier.").status == "excluded"
    assert _route(spark, body="From HERON pier.").reason == "Company matched by ticker; document screening passed"
    assert _route(spark, 0.2, body="From HERONS and x_HERON pier.").status == "excluded"
    assert (_route(spark, answered=False).status, _route(spark, None).status) == ("unclear", "unclear")
    row = _route(spark, 2.0, raw=0.9, removals=1)
    assert (row.raw_ai_directed, row.raw_screen_reused, row.status) == (0.9, False, "evidence")
    assert _route(spark, 2.0, directed=0.1, raw=0.9).raw_ai_directed == 0.1


def test_small_functions(spark):
    row = spark.sql("select 1").select(
        *[seconds(F.lit(v)).alias(f"s{i}") for i, v in enumerate(
            ("7.66s", "500ms", "2m59.56s", "23h59m", "12.5", "", "nan", "-3", "5 s", "1d"))],
        host(F.lit("HTTPS://me:pw@IR.Example.com:443/x?y#z")).alias("h0"), host(F.lit("no scheme/x")).alias("h1"),
        source_ids(F.array(*map(F.lit, ("S10.u01", "S2.u03", "S10.u02")))).alias("ids"),
        safe_code(F.lit("rate_limit")).alias("c0"), safe_code(F.lit("org_1")).alias("c1"), safe_code(F.lit("project_x")).alias("c2"),
        words_before_sources(F.lit("## Snapshot\nTwo words.\n## Sources\nMany source details here.")).alias("w")).first()
    assert [None if row[f"s{i}"] is None else round(row[f"s{i}"], 6) for i in range(10)] == [
        7.66, 0.5, 179.56, 86340.0, 12.5, None, None, None, None, 86400.0]
    assert (row.h0, row.h1, row.ids, row.c0, row.c1, row.c2, row.w) == ("ir.example.com", None, ["S2", "S10"], "rate_limit", None, None, 4)
    assert len(fixed.TOPICS) == 10
