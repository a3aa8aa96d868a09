"""Queries about claims and the passages they cite."""

from pyspark.sql import functions as F

from groundwork import fixed, session
from groundwork.functions.numbers import decimal_of, number_errors, quantities, undated, unsupported
from groundwork.functions.text import claim_key, source_ids
from groundwork.operators import grounding
from groundwork.plans import corpus
from groundwork.plans.corpus import BASE_SQL, CLAIM_SQL
from groundwork.plans.registry import joined, registry
from groundwork.sources import artifacts
from groundwork.sources.tables import read, spread

QUERIES, ORACLES, query = registry()


@query("claim_check", "WITH " + CLAIM_SQL + "SELECT k AS claim_id, section, errors FROM er")
def claim_check(spark, sf):
    """All rules that need no outside judgement, over one claim per order."""
    docs = corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct")))
    units = corpus.filing_units(docs, keep=("pack_id", "sid", "admitted", "title", "published", "age_days"))
    checked = grounding.check_claims(corpus.claims(docs), units)
    return checked.select("claim_id", "section", joined("code_errors").alias("errors"))


LINES_SQL = """
l AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS ln, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
        CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc,
        CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag AS rf, CAST(l_shipdate AS DATE) AS d FROM lineitem),
g AS (SELECT k, ln, min(cents) AS lo, max(cents) AS hi, min(qty) AS qlo, max(qty) AS qhi, min(disc) AS dlo, max(disc) AS dhi,
        min(d) AS first, max(d) AS last, min(rf) AS rf FROM l GROUP BY k, ln)
"""


def lines(spark, sf):
    li = read(spark, sf, "lineitem")
    def whole(column, factor=100):
        return F.round(F.col(column) * factor).cast("bigint")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("ln"),
                     whole("l_extendedprice").alias("cents"), whole("l_quantity", 1).alias("qty"),
                     whole("l_discount").alias("disc"), whole("l_tax").alias("tax"), F.col("l_returnflag").alias("rf"),
                     F.col("l_shipdate").cast("date").alias("d"))


def ranges(spark, sf):
    """Lowest and highest values per order line; repeated line keys make them differ."""
    return lines(spark, sf).groupBy("k", "ln").agg(
        F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.min("qty").alias("qlo"), F.max("qty").alias("qhi"),
        F.min("disc").alias("dlo"), F.max("disc").alias("dhi"), F.min("d").alias("first"), F.max("d").alias("last"),
        F.min("rf").alias("rf"))


@query("number_grounding", "WITH " + LINES_SQL + """
SELECT k, ln, concat_ws(' | ',
  CASE WHEN hi <> lo THEN 'Number ' || hi || ' (rupees) is not supported by the cited quotes' END,
  CASE WHEN qhi <> qlo THEN 'Number ' || qhi || ' (ratio) is not supported by the cited quotes' END,
  CASE WHEN dhi <> dlo THEN 'Number ' || dhi || ' (percent) is not supported by the cited quotes' END) AS errors
FROM g""")
def number_grounding(spark, sf):
    """Highest values stated, lowest values as evidence: equal only where they agree."""
    rows = ranges(spark, sf).withColumns({
        "claim": F.format_string("Priced at Rs %d crore, %dx the unit, less %d percent.", "hi", "qhi", "dhi"),
        "evidence": F.format_string("Less %d%%. Price: ₹%d00 lakh for %d times the unit.", "dlo", "lo", "qlo")})
    return rows.select("k", "ln", joined(number_errors(F.col("claim"), F.col("evidence"), F.lit(""))).alias("errors"))


@query("approx_grounding", "WITH " + LINES_SQL + """
SELECT k, ln, (lo + 50000) // 100000 = (hi + 50000) // 100000 AS supported FROM g""")
def approx_grounding(spark, sf):
    """A claim rounded half up to hundredths of a crore, marked as approximate."""
    shown = F.format_string("%d.%02d", F.expr("(hi + 50000) div 10000000"), F.expr("((hi + 50000) div 100000) % 100"))
    rows = ranges(spark, sf).withColumns({
        "claim": F.concat(F.lit("The price was about Rs "), shown, F.lit(" crore.")),
        "evidence": F.format_string("Priced at Rs %d.", "lo")})
    return rows.select("k", "ln", (F.size(unsupported(F.col("claim"), F.col("evidence"))) == 0).alias("supported"))


@query("direction_sign", "WITH " + LINES_SQL + """
SELECT k, ln, dhi = dlo AND (dhi = 0 OR rf <> 'N') AS supported FROM g""")
def direction_sign(spark, sf):
    """Words give a sign; the evidence writes it. The wrong word is used for one return flag."""
    word = F.when(F.col("rf") == "A", "up").when(F.col("rf") == "R", "a decline of").otherwise("fell by")
    sign = F.when(F.col("rf") == "R", "-").otherwise("+")
    rows = ranges(spark, sf).withColumns({
        "claim": F.concat(F.lit("Discounts "), word, F.lit(" "), "dhi", F.lit(" basis points.")),
        "evidence": F.concat(F.lit("Change: "), sign, "dlo", F.lit(" bps."))})
    return rows.select("k", "ln", (F.size(unsupported(F.col("claim"), F.col("evidence"))) == 0).alias("supported"))


@query("date_grounding", "WITH " + LINES_SQL + """
SELECT k, ln, CASE WHEN last = first OR last = first + 1 THEN '' ELSE
  CAST(day(last) AS VARCHAR) || ' ' || monthname(last) || ' ' || year(last) END || ' | 31 June ' || year(last) AS unsupported FROM g""")
def date_grounding(spark, sf):
    """Claimed days against days in the evidence and in its metadata; an impossible day is never found."""
    rows = ranges(spark, sf).withColumns({
        "claim": F.concat(F.lit("Shipped on "), F.date_format("last", "d MMMM yyyy"), F.lit(", paid 31 June "),
                          F.date_format("last", "yyyy"), F.lit(".")),
        "evidence": F.concat(F.lit("Shipment of "), F.date_format("first", "MMM d, yyyy"), F.lit(".")),
        "context": F.date_add("first", 1).cast("string")})
    rows = rows.withColumn("missing", undated(F.col("claim"), F.col("evidence"), F.col("context")))
    missing = F.col("missing")
    shown = F.when(F.size(missing) == 2, joined(missing)).otherwise(F.concat(F.lit(" | "), joined(missing)))
    return rows.select("k", "ln", shown.alias("unsupported"))


@query("number_tokens", "WITH " + LINES_SQL + """
SELECT dimension, CAST(count(*) AS BIGINT) AS numbers, CAST(sum(v) AS BIGINT) AS total, CAST(count(DISTINCT v) AS BIGINT) AS different FROM (
  SELECT 'rupees' AS dimension, cents AS v FROM l UNION ALL SELECT 'scalar', qty FROM l UNION ALL SELECT 'percent', disc FROM l
  UNION ALL SELECT 'bps', tax FROM l UNION ALL SELECT 'ratio', ln FROM l) GROUP BY dimension""")
def number_tokens(spark, sf):
    """Every number of a text per line item, by dimension; periods, dates and bare years are none."""
    rows = spread(lines(spark, sf))
    text = F.concat(F.lit("Rs "), "cents", F.lit(" for "), "qty", F.lit(" items in Q3 FY99 of "), F.date_format("d", "yyyy"),
                    F.lit(", shipped "), F.col("d").cast("string"), F.lit(", off "), "disc", F.lit("%, tax "), "tax",
                    F.lit(" bps, line "), "ln", F.lit("x."))
    found = rows.select(F.explode(quantities(text)).alias("q"))
    return found.groupBy(F.col("q.dimension").alias("dimension")).agg(
        F.count("*").alias("numbers"), F.sum(decimal_of(F.col("q.key")).cast("bigint")).alias("total"),
        F.count_distinct("q.key").alias("different"))


@query("range_units", "WITH " + LINES_SQL + """
SELECT dimension, CAST(v AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'percent' AS dimension, disc AS v FROM l UNION ALL SELECT 'percent', disc + tax FROM l
  UNION ALL SELECT 'rupees', qty * 100000 FROM l UNION ALL SELECT 'rupees', (qty + ln) * 100000 FROM l) GROUP BY 1, 2""")
def range_units(spark, sf):
    """Both bounds of a range carry the unit written after the second."""
    rows = spread(lines(spark, sf))
    text = F.concat(F.lit("Between "), "disc", F.lit(" to "), F.col("disc") + F.col("tax"), F.lit(" percent and "), "qty",
                    F.lit(" – "), F.col("qty") + F.col("ln"), F.lit(" lakh."))
    found = rows.select(F.explode(quantities(text)).alias("q"))
    return found.groupBy(F.col("q.dimension").alias("dimension"), decimal_of(F.col("q.key")).cast("bigint").alias("value")).agg(
        F.count("*").alias("n"))


@query("number_anti_join", "WITH " + LINES_SQL + """
, claimed AS (SELECT k, v FROM (SELECT k, hi AS v FROM g UNION ALL SELECT k, qhi FROM g) GROUP BY 1, 2),
known AS (SELECT k, lo AS v FROM g UNION SELECT k, qlo FROM g)
SELECT k, CAST(count(*) AS BIGINT) AS unsupported FROM claimed c
WHERE NOT EXISTS (SELECT 1 FROM known e WHERE e.k = c.k AND e.v = c.v) GROUP BY k""")
def number_anti_join(spark, sf):
    """The exploded form: numbers of an order's claims without an equal number in its evidence."""
    rows = ranges(spark, sf).withColumnRenamed("k", "claim_id")
    claimed = rows.select("claim_id", F.explode(quantities(F.format_string("%d units at %d.", "qhi", "hi"))).alias("q")).select(
        "claim_id", "q.*").select("claim_id", "dimension", "key").distinct()
    known = rows.select("claim_id", F.explode(quantities(F.format_string("%d units at %d.", "qlo", "lo"))).alias("q")).select("claim_id", "q.*")
    return grounding.ungrounded_numbers(claimed, known).groupBy(F.col("claim_id").alias("k")).agg(
        F.count("*").alias("unsupported"))


@query("table_currency", "WITH " + BASE_SQL + """
SELECT k, cents * 10000000 AS revenue, debt * 10000000 AS debt, pct AS up, -pct AS down FROM n""")
def table_currency(spark, sf):
    """Numbers in table rows take the currency of their own caption or header."""
    rows = corpus.orders(spark, sf)
    text = F.concat(F.lit("**Amounts in ₹ crore**\n| Metric | 2026 | Change |\n|---|---|---|\n| Revenue | "), "cents", F.lit(" | +"),
                    "pct", F.lit("% |\n| Debt | "), "debt", F.lit(" | -"), "pct", F.lit("% |\n\nIn 1999 nothing."))
    rows = rows.select("k", quantities(text).alias("q"))
    def nth(i):
        return decimal_of(F.get("q", F.lit(i))["key"]).cast("bigint")
    return rows.select("k", nth(0).alias("revenue"), nth(2).alias("debt"), nth(1).alias("up"), nth(3).alias("down"))


@query("period_labels", "WITH " + BASE_SQL + "SELECT k, pct || ',' || debt AS numbers FROM n")
def period_labels(spark, sf):
    """Quarters, halves, fiscal years and bare years leave only the real numbers."""
    year = F.date_format("published", "yyyy")
    text = F.concat(F.lit("Q1 FY"), year, F.lit(" and H2 FY27 in "), year, F.lit(" had "), "pct", F.lit(" orders worth Rs. "), "debt",
                    F.lit(" by "), F.date_format("published", "MMMM d, yyyy"))
    return corpus.orders(spark, sf).select("k", joined(F.transform(quantities(text), lambda q: q["text"]), ",").alias("numbers"))


@query("advice_screen", """
SELECT o_orderpriority AS phrase, o_orderstatus AS kind, CAST(count(*) AS BIGINT) AS claims,
  CAST(count(*) FILTER (WHERE o_orderpriority NOT IN ('2-HIGH', '4-NOT SPECIFIED')) AS BIGINT) AS advice FROM orders GROUP BY 1, 2""")
def advice_screen(spark, sf):
    """Recommendation wording against factual uses of the same words."""
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    p, key = F.col("o_orderpriority"), F.col("o_orderkey")
    text = (F.when(p == "1-URGENT", F.concat(F.lit("Order "), key, F.lit(": we recommend investors buy the stock.")))
            .when(p == "2-HIGH", F.concat(F.lit("The company plans to buy copper for order "), key, F.lit(".")))
            .when(p == "3-MEDIUM", F.concat(F.lit("Maintain a \"hold\" recommendation on "), key, F.lit(".")))
            .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Promoters hold shares of "), key, F.lit(".")))
            .otherwise(F.concat(F.lit("The price target of "), key, F.lit(" is higher."))))
    return rows.groupBy(p.alias("phrase"), F.col("o_orderstatus").alias("kind")).agg(
        F.count("*").alias("claims"), F.count_if(text.rlike(fixed.ADVICE)).alias("advice"))


@query("cite_join", "WITH " + CLAIM_SQL + """
SELECT pack_id, CAST(count(*) AS BIGINT) AS cites, CAST(count(*) FILTER (WHERE known) AS BIGINT) AS known, CAST(count(*) FILTER (WHERE known AND admitted) AS BIGINT) AS admitted
FROM (SELECT pack_id, true AS known, admitted FROM cl WHERE pct <> 50
      UNION ALL SELECT pack_id, false, false FROM cl WHERE pct BETWEEN 51 AND 60) GROUP BY pack_id""")
def cite_join(spark, sf):
    """Cites joined to the units they name."""
    docs = corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct")))
    units = corpus.filing_units(docs, keep=("pack_id", "sid", "admitted"))
    rows = grounding.cited_passages(corpus.claims(docs), units)
    return rows.groupBy("pack_id").agg(F.count("*").alias("cites"), F.count_if("known").alias("known"),
                                       F.count_if("admitted").alias("admitted"))


@query("evidence_text", "WITH " + CLAIM_SQL + """
SELECT k AS claim_id, '[' || sid || '.u03]' || chr(10) || 'Source: Order desk ' || s || chr(10) || 'Source type: ' || lower(type) || chr(10) ||
  'Published: ' || ds || ' (publication date, not necessarily the event date)' || chr(10) || chr(10) || 'Order ' || k || ' results' || chr(10) || chr(10) ||
  'Trading' || chr(10) || chr(10) || '**Amounts in ₹ crore**' || chr(10) || '| Metric | Current | Change |' || chr(10) || '|---|---|---|' || chr(10) ||
  '| Debt | ' || debt || ' | -' || pct || '% |' || chr(10) || chr(10) || 'Revenue was Rs ' || cents || ' crore, up ' || pct || ' percent.' || chr(10) || chr(10) ||
  'Profit fell ' || pct || '% on ' || longdate || '.' AS evidence
FROM cl WHERE pct <> 50 AND admitted""")
def evidence_text(spark, sf):
    """What a judge reads for each claim: labelled passages with their context."""
    docs = corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct")))
    units = corpus.filing_units(docs, windows=True, keep=("pack_id", "sid", "admitted", "title", "published", "age_days", "source", "source_type"))
    return grounding.evidence_text(corpus.claims(docs), units).select("claim_id", "evidence")


@query("evidence_attached", "WITH " + CLAIM_SQL + """
SELECT k AS claim_id, CAST(CASE WHEN pct = 50 THEN 0 ELSE 1 END AS BIGINT) AS passages,
  CASE WHEN pct = 50 THEN '' ELSE 'Revenue was Rs ' || cents || ' crore, up ' || pct || ' percent.' END AS quotes FROM cl""")
def evidence_attached(spark, sf):
    """Quotes of existing passages beside each claim, in cite order."""
    def quoted(docs):
        rows = grounding.attached(corpus.claims(docs), corpus.filing_units(docs, keep=("pack_id", "sid")))
        return rows.select("claim_id", F.greatest(F.coalesce(F.size("evidence"), F.lit(0)), F.lit(0)).cast("bigint").alias("passages"),
                           F.coalesce(joined(F.transform("evidence", lambda e: e["quote"]), "\n"), F.lit("")).alias("quotes"))
    docs = corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct")))
    return session.in_slices(quoted, "pack_id", docs)


def drafts(spark, sf):
    """One stored draft per order as JSON text; some lack a section or hold misshapen claims."""
    rows = corpus.orders(spark, sf)
    claim = F.concat(F.lit('{"text":"Order '), "k", F.lit(' grew","kind":"reported_fact","cites":["S1.u01","S'), "pct", F.lit('.u02"]}'))
    odd = (F.when(F.col("s") == "O", '{"text":5,"kind":"reported_fact","cites":[]}')
           .when(F.col("s") == "P", '{"text":"x","kind":"rumour","cites":["a"]}').otherwise('{"text":"y","kind":"third_party_view","cites":[]}'))
    bear = F.when(F.col("p") == "2-HIGH", '"none"').otherwise(F.concat(F.lit("["), odd, F.lit("]")))
    rest = F.when(F.col("p") == "1-URGENT", "}").otherwise(',"open_questions":[]}')
    return rows.select(F.col("k").alias("run_id"), F.concat(
        F.lit('{"snapshot":['), claim, F.lit(","), claim, F.lit('],"bull":['), claim, F.lit('],"bear":'), bear, rest).alias("json"))


@query("draft_claims", "WITH " + BASE_SQL + """
SELECT k AS run_id, section, CAST(idx AS BIGINT) AS idx, 'Order ' || k || ' grew' AS text, 'reported_fact' AS kind, 'S1.u01,S' || pct || '.u02' AS cites FROM n,
  (VALUES ('snapshot', 0), ('snapshot', 1), ('bull', 0)) v(section, idx)
UNION ALL SELECT k, 'bear', 0, CASE s WHEN 'O' THEN '5' WHEN 'P' THEN 'x' ELSE 'y' END,
  CASE s WHEN 'O' THEN 'reported_fact' WHEN 'P' THEN 'rumour' ELSE 'third_party_view' END, CASE s WHEN 'P' THEN 'a' ELSE '' END
FROM n WHERE p <> '2-HIGH'""")
def draft_claims(spark, sf):
    """Stored drafts as claim rows in section and list order."""
    from groundwork import schemas
    rows = artifacts.read(drafts(spark, sf).withColumn("too_large", F.lit(False)), schemas.DRAFT, "draft").select("run_id", "draft")
    rows = artifacts.draft_claims(rows)
    return rows.select("run_id", "section", F.col("idx").cast("bigint").alias("idx"), "text", "kind", joined("cites", ",").alias("cites"))


@query("draft_shape", "WITH " + BASE_SQL + """
SELECT k AS run_id, 'Output must contain exactly the four section arrays.' AS fault FROM n WHERE p = '1-URGENT'
UNION ALL SELECT k, 'bear: expected an array' FROM n WHERE p = '2-HIGH'
UNION ALL SELECT k, 'bear[0]: invalid claim shape' FROM n WHERE p NOT IN ('1-URGENT', '2-HIGH') AND s <> 'F'""")
def draft_shape(spark, sf):
    """Drafts that break the closed claim schema, with the place of each fault."""
    return artifacts.shape_faults(drafts(spark, sf)).select("run_id", "fault")


@query("claim_keys", "WITH " + CLAIM_SQL + """
SELECT section, kind, CAST(count(*) AS BIGINT) AS claims, CAST(count(DISTINCT section || '|' || stated || '|' || pct || '|' || kind) AS BIGINT) AS different
FROM cl GROUP BY section, kind""")
def claim_keys(spark, sf):
    """One key per distinct claim with its section, for reuse of answers."""
    docs = corpus.orders(spark, sf).withColumn("sid", F.lit("S1"))
    rows = corpus.claims(docs).drop("cites", "text").join(docs.select(F.col("k").alias("claim_id"), F.concat_ws(
        " ", F.when(F.col("s") == "O", F.col("cents") + 100).otherwise(F.col("cents")), "pct").alias("text")), "claim_id")
    key = claim_key(F.col("section"), F.col("text"), F.col("kind"), F.array(F.lit("S1.u01")))
    return rows.groupBy("section", "kind").agg(F.count("*").alias("claims"), F.count_distinct(key).alias("different"))


@query("source_tags", """
SELECT k, CASE WHEN a = b THEN 'S' || a WHEN a < b THEN 'S' || a || ',S' || b ELSE 'S' || b || ',S' || a END AS sources
FROM (SELECT o_orderkey AS k, o_custkey % 12 + 1 AS a, o_orderkey % 12 + 1 AS b FROM orders)""")
def source_tags(spark, sf):
    """Distinct source ids of a claim's cites in numeric order."""
    rows = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    a, b = F.col("o_custkey") % 12 + 1, F.col("o_orderkey") % 12 + 1
    cites = F.array(F.concat(F.lit("S"), a, F.lit(".u09")), F.concat(F.lit("S"), b, F.lit(".u10")), F.concat(F.lit("S"), a, F.lit(".u02")))
    return rows.select(F.col("o_orderkey").alias("k"), joined(source_ids(cites), ",").alias("sources"))
