"""Documents and claims made from the star-schema tables, in Spark and as SQL.

Every order becomes one Markdown filing of its customer's pack, and one claim about
it. The texts are plain functions of the row, so SQL can state what must come out.
"""

from pyspark.sql import functions as F

from groundwork import session
from groundwork.functions.text import hidden_counts, without_hidden
from groundwork.operators import segment
from groundwork.sources import packs
from groundwork.sources.tables import read, spread

AS_OF = "2001-08-02"

# Shared by all oracles: one row per order with the values its texts are made of.
def base_sql(as_of=AS_OF, pack="'pack' || c"):
    return f"""
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p,
        CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT *, {pack} AS pack_id, cents % 97 + 1 AS pct, cents % 1000003 + 3000 AS debt,
        'https://ir.cust' || c || '.example.com/' || k AS url, CAST(d AS VARCHAR) AS ds,
        CAST(day(d) AS VARCHAR) || ' ' || monthname(d) || ' ' || CAST(year(d) AS VARCHAR) AS longdate,
        date_diff('day', d, DATE '{as_of}') AS age,
        CASE p WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 3 END AS tier,
        CASE p WHEN '1-URGENT' THEN 'official exchange filing' WHEN '2-HIGH' THEN 'official company filing'
               WHEN '3-MEDIUM' THEN 'Official Company Transcript' WHEN '4-NOT SPECIFIED' THEN 'news article' ELSE 'interview' END AS type
      FROM o),
n AS (SELECT *, 'S' || row_number() OVER (PARTITION BY pack_id ORDER BY d, url) AS sid FROM f)
"""


BASE_SQL = base_sql()


def orders(spark, sf):
    """Order rows with the values their texts are made of."""
    rows = spread(read(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    p = F.col("o_orderpriority")
    kind = (F.when(p == "1-URGENT", "official exchange filing").when(p == "2-HIGH", "official company filing")
            .when(p == "3-MEDIUM", "Official Company Transcript").when(p == "4-NOT SPECIFIED", "news article").otherwise("interview"))
    return rows.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), p.alias("p"),
        cents.alias("cents"), F.col("o_orderdate").cast("date").alias("published"), kind.alias("type")).withColumns({
            "pack_id": F.concat(F.lit("pack"), "c"), "filename": F.concat("k", F.lit(".md")),
            "pct": F.col("cents") % 97 + 1, "debt": F.col("cents") % 1000003 + 3000,
            "url": F.concat(F.lit("https://ir.cust"), "c", F.lit(".example.com/"), "k")})


def body_text():
    """Markdown body of an order's filing; open orders carry a hidden comment."""
    return F.concat(
        F.lit("# Order "), "k", F.lit(" results\n\n## Trading\n\n**Amounts in ₹ crore**\n\n| Metric | Current | Change |\n"
                                      "|---|---|---|\n| Revenue | "), "cents", F.lit(" | +"), "pct", F.lit("% |\n| Debt | "), "debt",
        F.lit(" | -"), "pct", F.lit("% |\n\nRevenue was Rs "), "cents", F.lit(" crore, up "), "pct",
        F.lit(" percent. Profit fell "), "pct", F.lit("% on "), F.date_format("published", "d MMMM yyyy"),
        F.lit(".\n"), F.when(F.col("s") == "P", F.concat(F.lit("<!-- note "), "k", F.lit(" -->\n"))).otherwise(""),
        F.lit("\n## Outlook\n\n- Management expects margins to improve. Promoters hold shares."))


def file_text():
    return F.concat(F.lit("---\nsource: \"Order desk "), "s", F.lit("\"\nurl: "), "url", F.lit("\npublished: "),
                    F.col("published").cast("string"), F.lit("\ntype: "), "type", F.lit("\n---\n\n"), body_text(), F.lit("\n"))


def files(spark, sf):
    """Filings as a file scan would give them."""
    rows = orders(spark, sf)
    content = file_text().cast("binary")
    return rows.select("pack_id", "filename", F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))


def filings(spark, sf, keep=(), as_of=AS_OF, pack=None):
    """Filings as parsed, numbered and aged documents, without going through files."""
    rows = orders(spark, sf)
    if pack is not None:
        rows = rows.withColumn("pack_id", pack)
    raw = F.col("_raw")
    kept = [c for c in ("k", "c", "s", "p", "cents", "pct", "debt") if c in keep or c == "k"]

    def made():
        # Numbered before the texts are made, so only small rows are sorted; a hash takes half its length as bytes.
        numbered = packs.numbered(rows.withColumn("sha256", F.unhex(F.sha2(F.concat("pack_id", "filename"), 256))))
        # A column of its own, or Spark puts the text together again wherever it is named.
        found = numbered.withColumn("_raw", body_text()).select(
            "pack_id", "filename", "sid", F.concat(F.lit("Order desk "), "s").alias("source"), "url", "published",
            F.lower("type").alias("source_type"), "sha256", hidden_counts(raw).alias("removals"), without_hidden(raw).alias("body"), *kept)
        return packs.aged(found, as_of)
    return session.settled(made).withColumn("sha256", F.lower(F.hex("sha256")))


def with_route(documents):
    """Everything but the lowest priority is admitted (type ``interview``)."""
    status = F.when(F.col("source_type") == "interview", "excluded").otherwise("evidence")
    reason = F.when(F.col("source_type") == "interview", "Interviews are not used").otherwise("")
    return documents.withColumns({"status": status, "reason": reason, "admitted": status == "evidence"})


UNIT_KEEP = ("pack_id", "sid", "admitted", "title", "published", "age_days", "tier", "status", "source", "source_type")


def filing_units(documents, windows=False, keep=UNIT_KEEP):
    return segment.units(segment.with_outline(documents), keep=keep, windows=windows)


def claims(documents, also=()):
    """One claim per filing, with faults that depend on its values. Needs k, s, p, cents, pct; ``also`` names further columns to keep."""
    stated = F.when(F.col("s") == "O", F.col("cents") + 100).otherwise(F.col("cents"))
    text = F.concat(
        F.lit("Revenue was Rs "), stated, F.lit(" crore, up "), "pct", F.lit(" percent"),
        F.when(F.col("pct") % 2 == 0, F.concat(F.lit(" in "), F.date_format("published", "yyyy"))).otherwise(""),
        F.when(F.col("pct") == 33, " — again").otherwise(""), F.when(F.col("pct") == 66, "\x15").otherwise(""), F.lit("."),
        F.when(F.col("pct") == 77, " Buy this stock.").otherwise(""))
    p = F.col("p")
    section = (F.when(p.isin("1-URGENT", "5-LOW"), "snapshot").when(p == "2-HIGH", "bull").when(p == "3-MEDIUM", "bear")
               .otherwise("open_questions"))
    kind = (F.when(F.col("pct") > 90, "opinion").when(F.col("s") == "F", "reported_fact")
            .when(F.col("s") == "O", "management_view_or_forecast").otherwise("third_party_view"))
    own = F.concat("sid", F.lit(".u03"))
    cites = (F.when(F.col("pct") == 50, F.expr("cast(array() as array<string>)"))
             .when(F.col("pct").between(51, 60), F.array(own, F.lit("S99999.u01"))).otherwise(F.array(own)))
    return documents.select("pack_id", F.col("k").alias("claim_id"), section.alias("section"), text.alias("text"),
                            kind.alias("kind"), cites.alias("cites"), *also)


def claim_sql(base):
    """The same claims in SQL, with the errors each must get."""
    return base + """,
cl AS (SELECT *,
   CASE WHEN s = 'O' THEN cents + 100 ELSE cents END AS stated,
   CASE WHEN p IN ('1-URGENT', '5-LOW') THEN 'snapshot' WHEN p = '2-HIGH' THEN 'bull' WHEN p = '3-MEDIUM' THEN 'bear' ELSE 'open_questions' END AS section,
   CASE WHEN pct > 90 THEN 'opinion' WHEN s = 'F' THEN 'reported_fact' WHEN s = 'O' THEN 'management_view_or_forecast' ELSE 'third_party_view' END AS kind,
   p <> '5-LOW' AS admitted
   FROM n),
er AS (SELECT *,
   'Revenue was Rs ' || stated || ' crore, up ' || pct || ' percent' ||
     CASE WHEN pct % 2 = 0 THEN ' in ' || year(d) ELSE '' END || CASE WHEN pct = 33 THEN ' — again' ELSE '' END ||
     CASE WHEN pct = 66 THEN chr(21) ELSE '' END || '.' || CASE WHEN pct = 77 THEN ' Buy this stock.' ELSE '' END AS text,
   concat_ws(' | ',
   CASE WHEN pct = 66 THEN 'Claim contains a nonprinting control character; use plain words or a valid currency symbol' END,
   CASE WHEN pct > 90 THEN 'Claim kind is invalid' END,
   CASE WHEN section = 'snapshot' AND kind <> 'reported_fact' THEN 'Snapshot claims must be reported_fact' END,
   CASE WHEN pct = 77 THEN 'Claim contains an investment-advice phrase' END,
   CASE WHEN pct = 50 THEN 'Claim must cite at least one unit' END,
   CASE WHEN pct <> 50 AND NOT admitted THEN 'Cited unit ' || sid || '.u03 belongs to an excluded document' END,
   CASE WHEN pct <> 50 AND admitted AND age > 365 AND pct % 2 = 1 THEN 'Claim citing stale source ' || sid || ' must include its month or year' END,
   CASE WHEN pct BETWEEN 51 AND 60 THEN 'Unknown cited unit: S99999.u01' END,
   CASE WHEN pct <> 50 AND (s = 'O' OR NOT admitted) THEN 'Number ' || stated || ' (rupees) is not supported by the cited quotes' END,
   CASE WHEN pct <> 50 AND NOT admitted THEN 'Number ' || pct || ' (percent) is not supported by the cited quotes' END,
   CASE WHEN pct = 33 THEN 'Use a comma or period instead of an em dash' END) AS errors
   FROM cl)
"""


CLAIM_SQL = claim_sql(BASE_SQL)
