"""Queries about topics and figures of sources against claims."""

from pyspark.sql import functions as F

from groundwork.functions.text import nfkc
from groundwork.functions.topics import figures, topics
from groundwork.operators import coverage
from groundwork.plans import corpus
from groundwork.plans.corpus import BASE_SQL, CLAIM_SQL
from groundwork.plans.registry import joined, registry
from groundwork.sources.tables import read, spread

QUERIES, ORACLES, query = registry()

KEEP = ("pack_id", "sid", "status", "tier", "age_days")


@query("topic_cues", "WITH " + BASE_SQL + """
SELECT k, CASE p
  WHEN '1-URGENT' THEN 'revenue_level,revenue_growth'
  WHEN '2-HIGH' THEN 'revenue_growth,guidance_outlook'
  WHEN '3-MEDIUM' THEN 'profit_level,profit_growth,margins'
  WHEN '4-NOT SPECIFIED' THEN CASE WHEN s = 'F' THEN 'ownership_pledges' WHEN s = 'O' THEN 'material_legal_risk' ELSE 'cash_collection,debt_funding' END
  ELSE CASE WHEN s = 'F' THEN 'guidance_outlook' ELSE '' END END AS topics FROM n""")
def topic_cues(spark, sf):
    """Topics of prose and table passages, one wording per priority."""
    p, s = F.col("p"), F.col("s")
    text = (F.when(p == "1-URGENT", F.concat(F.lit("**Revenue** was Rs "), "cents", F.lit(" crore, up "), "pct", F.lit("%")))
            .when(p == "2-HIGH", F.concat(F.lit("Sales grew "), "pct", F.lit(" percent and management expects profit to rise "), "pct", F.lit("%")))
            .when(p == "3-MEDIUM", F.concat(F.lit("| Metric | Current | Change |\n|---|---|---|\n| Net profit | "), "debt", F.lit(" | +"), "pct",
                                            F.lit("% |\n| EBITDA margin | "), "pct", F.lit("% | 2 |")))
            .when((p == "4-NOT SPECIFIED") & (s == "F"), F.concat(F.lit("Promoters pledged "), "pct", F.lit("% of "), "debt"))
            .when((p == "4-NOT SPECIFIED") & (s == "O"), F.concat(F.lit("Sales volume rose "), "pct", F.lit("%; a tax demand of "), "debt", F.lit(" came")))
            .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Receivables fell and capex was "), "debt", F.lit(" or "), "pct", F.lit("% of revenue, up from 2%")))
            .when(s == "F", F.concat(F.lit("Profit would rise "), "pct", F.lit("% to Rs "), "debt", F.lit(" crore; it would improve")))
            .otherwise(F.concat(F.lit("Order "), "k", F.lit(" shipped"))))
    return corpus.orders(spark, sf).select("k", joined(topics(text), ",").alias("topics"))


#: Parts of sentences about a metric, chosen by columns of a line item: every metric meets every verb, amount, frame and neighbour.
METRICS = (("Revenue", "revenue"), ("turnover", "revenue"), ("Net **sales**", "revenue"), ("EBITDA", "profit"), ("Net profit", "profit"), ("Ferry count", None))
VERBS = (("was", False), ("reached", False), ("rose", True), ("fell", True), ("grew", True))
AMOUNTS = (("Rs %d crore", True, False), ("%d%%", False, True), ("₹%d lakh", True, False), ("by %d percent", False, True))
TAILS = (("", False, False), (" to Rs 77 crore", True, False), (", up 9%", False, True), (" on Monday", False, False))
FRAMES = ("", "Management expects this: ", "As the board forecast, ")
NEIGHBOURS = ((". Debtor days shrank.", "cash_collection"), ("; the MARGINS held", "margins"), (". A marginal shareholding", "ownership_pledges"), (". No legally binding riskier finery", None), (" at dawn", None))


def _sentence_sql():
    """Topics of such a sentence from its parts: money states a level unless growth is stated of it, growth needs a sum or a share beside its word."""
    def picked(parts, column, *fields):
        rows = ", ".join(f"({k}, " + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v).upper() for v in (f(part) for f in fields)) + ")" for k, part in enumerate(parts))
        return f"(VALUES {rows})", f"{column} % {len(parts)}"
    m, mk = picked(METRICS, "l_partkey", lambda x: x[1])
    v, vk = picked(VERBS, "l_suppkey", lambda x: x[1])
    a, ak = picked(AMOUNTS, "l_linenumber", lambda x: x[1], lambda x: x[2])
    t, tk = picked(TAILS, "CAST(l_quantity AS BIGINT)", lambda x: x[1], lambda x: x[2])
    n, nk = picked(NEIGHBOURS, "l_orderkey", lambda x: x[1])
    return f"""
WITH c AS (SELECT metric, grows, money, share, to_money, up, beside, (CAST(l_quantity AS BIGINT) + l_linenumber) % {len(FRAMES)} > 0 AS forecast FROM lineitem
  JOIN {m} m(i, metric) ON m.i = {mk} JOIN {v} v(i, grows) ON v.i = {vk} JOIN {a} a(i, money, share) ON a.i = {ak} JOIN {t} t(i, to_money, up) ON t.i = {tk} JOIN {n} n(i, beside) ON n.i = {nk}),
f AS (SELECT metric || '_level' AS topic FROM c WHERE metric IS NOT NULL AND NOT forecast AND ((money OR to_money) AND (NOT (grows OR up) OR to_money OR (money AND NOT grows)))
  UNION ALL SELECT metric || '_growth' FROM c WHERE metric IS NOT NULL AND NOT forecast AND (grows OR up) AND (money OR share OR to_money OR up)
  UNION ALL SELECT beside FROM c WHERE beside IS NOT NULL
  UNION ALL SELECT 'guidance_outlook' FROM c WHERE forecast)
SELECT topic, count(*) AS sentences FROM f GROUP BY topic"""


@query("topic_sentences", _sentence_sql())
def topic_sentences(spark, sf):
    """Topics of sentences put together from parts, one per line item; the SQL has the rules of the parts, not the wordings."""
    def picked(parts, column, field=lambda x: x[0]):
        return F.get(F.array(*[F.lit(field(x)) for x in parts]), (column % len(parts)).cast("int"))
    quantity = F.col("l_quantity").cast("bigint")
    amount = F.replace(F.replace(picked(AMOUNTS, F.col("l_linenumber")), F.lit("%d"), (quantity + 5).cast("string")), F.lit("%%"), F.lit("%"))
    text = F.concat(picked(FRAMES, quantity + F.col("l_linenumber"), lambda x: x), picked(METRICS, F.col("l_partkey")), F.lit(" "), picked(VERBS, F.col("l_suppkey")),
                    F.lit(" "), amount, picked(TAILS, quantity), picked(NEIGHBOURS, F.col("l_orderkey")))
    rows = spread(read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return rows.select(F.explode(topics(text)).alias("topic")).groupBy("topic").agg(F.count("*").alias("sentences"))


@query("document_figures", r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\*\*|`', '', 'g'),
    '\b(?:(?:(?:[Qq]\s*[1-4]|[Hh]\s*[12])\s*)?[Ff][Yy]\s*\d{2,4}(?:\s*[-–]\s*\d{2,4})?|[Qq]\s*[1-4]|[Hh]\s*[12])\b', ' ', 'g'),
    '\b\d{1,2}\s+[A-Za-z]{2,}\.?\s+\d{4}\b|\b[A-Za-z]{2,}\.?\s+\d{1,2},?\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b', ' ', 'g') AS t FROM documents),
f AS (SELECT doc_id, ltrim(replace(unnest(regexp_extract_all(t, '[-+−]?\d[\d,]*(?:\.\d+)?')), ',', ''), '+-−') AS v FROM c),
g AS (SELECT DISTINCT doc_id, CASE WHEN contains(v, '.') THEN rtrim(rtrim(v, '0'), '.') ELSE v END AS figure FROM f WHERE NOT regexp_full_match(v, '(?:19|20)\d{2}'))
SELECT doc_id, figure FROM g""")
def document_figures(spark, sf):
    """Numeric tokens of whole documents."""
    rows = spread(read(spark, sf, "documents").select("doc_id", "text")).withColumn("t", nfkc(F.col("text")))
    return rows.select("doc_id", F.explode(figures(F.col("t"))).alias("figure"))


@query("figure_difference", "WITH d AS (" + ORACLES["document_figures"] + """),
b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?')) AS figure FROM benchmark)
SELECT figure, CAST(count(*) AS BIGINT) AS documents FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.figure = d.figure) GROUP BY figure""")
def figure_difference(spark, sf):
    """Figures of documents that no benchmark passage states; counted before they are compared."""
    mine = document_figures(spark, sf).groupBy("figure").agg(F.count("*").alias("documents"))
    theirs = read(spark, sf, "benchmark").select(F.explode(figures(F.col("text"))).alias("figure")).distinct()
    return mine.join(theirs, "figure", "left_anti")


@query("coverage_exclusions", "WITH " + BASE_SQL + """
SELECT pack_id, reason, CAST(count(*) AS BIGINT) AS documents FROM (SELECT pack_id, CASE WHEN p = '5-LOW' THEN 'not_admitted' WHEN tier > 2 THEN 'not_primary' WHEN s = 'P' AND pct < 20 THEN 'unknown_age'
  WHEN age - 300 < 0 THEN 'future' WHEN age - 300 > 365 THEN 'older' END AS reason FROM n) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def coverage_exclusions(spark, sf):
    """Documents outside the topic check, each under its first reason."""
    docs = corpus.with_route(corpus.filings(spark, sf, keep=("s", "pct")))
    docs = docs.withColumn("age_days", F.when((F.col("s") != "P") | (F.col("pct") >= 20), F.col("age_days") - 300))
    return coverage.exclusion_counts(docs)


# Coverage of a pack: its fresh primary filings against the claims made about shipped orders.
COVER_SQL = CLAIM_SQL + """,
e AS (SELECT * FROM er WHERE admitted AND tier <= 2 AND age BETWEEN 0 AND 365),
h AS (SELECT pack_id, k, sid, 'revenue_level' AS topic, '.u01' AS u, [cents, pct] AS fig FROM e UNION ALL SELECT pack_id, k, sid, 'revenue_growth', '.u01', [cents, pct] FROM e
  UNION ALL SELECT pack_id, k, sid, 'debt_funding', '.u02', [debt, pct] FROM e
  UNION ALL SELECT pack_id, k, sid, 'revenue_level', '.u03', [cents, pct] FROM e UNION ALL SELECT pack_id, k, sid, 'revenue_growth', '.u03', [cents, pct] FROM e
  UNION ALL SELECT pack_id, k, sid, 'profit_growth', '.u04', [pct] FROM e WHERE month(d) <> 5 -- "May" reads as a forecast
  UNION ALL SELECT pack_id, k, sid, unnest(['margins', 'ownership_pledges', 'guidance_outlook']), '.u05', [] FROM e),
ac AS (SELECT * FROM er WHERE s = 'F'),
said AS (SELECT pack_id, k, unnest(['revenue_level', 'revenue_growth']) AS topic FROM ac),
stated AS (SELECT DISTINCT pack_id, unnest([stated, pct]) AS figure FROM ac),
cited AS (SELECT DISTINCT pack_id, sid FROM ac WHERE pct <> 50),
hf AS (SELECT h.pack_id, topic, h.u = '.u03' AND c.sid IS NOT NULL AS is_cited, unnest(fig) AS figure FROM h LEFT JOIN cited c ON c.pack_id = h.pack_id AND c.sid = h.sid),
mf AS (SELECT pack_id, topic, figure, bool_or(NOT is_cited) AS uncited FROM hf WHERE NOT EXISTS (SELECT 1 FROM stated x WHERE x.pack_id = hf.pack_id AND x.figure = hf.figure) GROUP BY 1, 2, 3),
tt AS (SELECT pack_id, t.topic, t.i FROM (SELECT DISTINCT pack_id FROM n), (VALUES ('revenue_level', 0), ('revenue_growth', 1), ('profit_level', 2), ('profit_growth', 3), ('margins', 4), ('cash_collection', 5),
  ('debt_funding', 6), ('ownership_pledges', 7), ('guidance_outlook', 8), ('material_legal_risk', 9)) t(topic, i)),
sm AS (SELECT tt.pack_id, tt.topic, i, (SELECT count(*) FROM h WHERE h.pack_id = tt.pack_id AND h.topic = tt.topic) AS hits, (SELECT count(*) FROM said WHERE said.pack_id = tt.pack_id AND said.topic = tt.topic) AS claims,
  (SELECT count(*) FROM mf WHERE mf.pack_id = tt.pack_id AND mf.topic = tt.topic) AS alls, (SELECT count(*) FROM mf WHERE mf.pack_id = tt.pack_id AND mf.topic = tt.topic AND uncited) AS unc FROM tt),
cv AS (SELECT pack_id, topic, i, hits, claims, CASE WHEN claims > 0 THEN unc ELSE alls END AS missing,
  CASE WHEN hits > 0 AND claims > 0 AND unc > 0 THEN 'partial' WHEN hits > 0 AND claims > 0 THEN 'mentioned' WHEN hits > 0 THEN 'review_needed' ELSE 'not_found' END AS status FROM sm)
"""


def inputs(spark, sf):
    """(packs, units, claims): all filings, and claims accepted for shipped orders."""
    docs = corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct", "debt")))
    units = corpus.filing_units(docs, keep=KEEP)
    claims = corpus.claims(docs, also=((F.col("s") == "F").alias("accepted"),))
    return docs.select("pack_id").distinct(), units, claims


@query("coverage_topics", "WITH " + COVER_SQL + """
SELECT pack_id, topic, CAST(hits AS BIGINT) AS source_hits, CAST(claims AS BIGINT) AS claims, CAST(missing AS BIGINT) AS missing_figures, status FROM cv""")
def coverage_topics(spark, sf):
    """All topics of every pack with hits, mentions, missing figures and status."""
    return coverage.topic_summary(*inputs(spark, sf)).select("pack_id", "topic", "source_hits", "claims", "missing_figures", "status")


@query("coverage_missing", "WITH " + COVER_SQL + """
SELECT mf.pack_id, mf.topic, CAST(figure AS VARCHAR) AS figure, s.topic IS NOT NULL AS mentioned FROM mf LEFT JOIN (SELECT DISTINCT pack_id, topic FROM said) s ON s.pack_id = mf.pack_id AND s.topic = mf.topic
WHERE s.topic IS NULL OR uncited""")
def coverage_missing(spark, sf):
    """Figures of source passages that no accepted claim of the pack states."""
    _, units, claims = inputs(spark, sf)
    return coverage.missing_figures(units, claims).select("pack_id", "topic", "figure", "mentioned")


@query("coverage_order", "WITH " + COVER_SQL + """
SELECT pack_id, topic, CAST(row_number() OVER (PARTITION BY pack_id ORDER BY CASE status WHEN 'partial' THEN 0 WHEN 'review_needed' THEN 1 WHEN 'mentioned' THEN 2 ELSE 3 END, i) AS BIGINT) AS place FROM cv""")
def coverage_order(spark, sf):
    """Topics that need a look first (ten rows per pack)."""
    from pyspark.sql import Window
    rows = coverage.topic_summary(*inputs(spark, sf)).withColumn("_rank", coverage.attention(F.col("status")))
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("_rank", "topic_no"))
    return rows.select("pack_id", "topic", place.cast("bigint").alias("place"))


@query("source_hits", "WITH " + COVER_SQL + """
SELECT pack_id, topic, sid || u AS uid, CASE WHEN len(fig) = 2 AND fig[1] = fig[2] THEN CAST(fig[1] AS VARCHAR) ELSE array_to_string(fig, ',') END AS figures FROM h""")
def source_hits(spark, sf):
    """Every passage that mentions a topic, with its figures."""
    _, units, _ = inputs(spark, sf)
    return coverage.source_hits(units).select("pack_id", "topic", "uid", joined("figures", ",").alias("figures"))


@query("coverage_notes", "WITH " + COVER_SQL + """,
w AS (SELECT hf.pack_id, hf.topic, hf.figure, min((hf.sn, hf.u, hf.figure)) AS place FROM (
  SELECT h.pack_id, topic, CAST(substr(h.sid, 2) AS BIGINT) AS sn, h.u, h.u = '.u03' AND c.sid IS NOT NULL AS is_cited, unnest(fig) AS figure FROM h LEFT JOIN cited c ON c.pack_id = h.pack_id AND c.sid = h.sid) hf
  WHERE NOT is_cited GROUP BY 1, 2, 3),
fl AS (SELECT mf.pack_id, mf.topic, string_agg(CAST(mf.figure AS VARCHAR), ', ' ORDER BY w.place) AS list FROM mf JOIN w USING (pack_id, topic, figure) GROUP BY 1, 2)
SELECT cv.pack_id, cv.topic, CASE status WHEN 'partial' THEN 'Figures to review in uncited passages: ' || list || '. These numeric tokens did not match accepted claim text; compare their meaning and units.'
  WHEN 'mentioned' THEN 'Wording matched in source text and the brief. Review whether figures, periods and scope align.'
  WHEN 'review_needed' THEN 'Source wording matched, but no keyword match was found in accepted claim text. Review these passages; leaving them out may be justified.'
  ELSE 'No keyword match in eligible source text; this does not establish that the topic is absent.' || CASE WHEN claims > 0 THEN ' Brief wording did match, so inspect its evidence separately.' ELSE '' END END AS note
FROM cv LEFT JOIN fl ON fl.pack_id = cv.pack_id AND fl.topic = cv.topic
UNION ALL SELECT pack_id, 'all', 'Checked ' || count(*) FILTER (why IS NULL) || ' admitted primary source(s) aged 0 to 365 days. These keyword cues suggest review topics, not completeness, factual accuracy or materiality. '
  || 'Citations alone do not count as mentions. Paraphrases and mixed statements may be missed. Figure matching compares numeric tokens across all claims, without aligning metrics, signs, units or scale. '
  || 'Older unresolved issues can still matter and need separate review.' || CASE WHEN count(why) > 0 THEN ' Sources outside this check: ' || concat_ws(', ',
  CASE WHEN count(*) FILTER (why = 'a') > 0 THEN count(*) FILTER (why = 'a') || ' not admitted' END, CASE WHEN count(*) FILTER (why = 'b') > 0 THEN count(*) FILTER (why = 'b') || ' not primary' END,
  CASE WHEN count(*) FILTER (why = 'd') > 0 THEN count(*) FILTER (why = 'd') || ' future' END, CASE WHEN count(*) FILTER (why = 'e') > 0 THEN count(*) FILTER (why = 'e') || ' older' END) || '.' ELSE '' END
FROM (SELECT pack_id, CASE WHEN p = '5-LOW' THEN 'a' WHEN tier > 2 THEN 'b' WHEN age < 0 THEN 'd' WHEN age > 365 THEN 'e' END AS why FROM n) GROUP BY pack_id""")
def coverage_notes(spark, sf):
    """What to say about every topic of a pack, the list of missing figures in it, and what the check of the pack covered."""
    docs = corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct", "debt")))
    units = corpus.filing_units(docs, keep=KEEP)
    claims = corpus.claims(docs, also=((F.col("s") == "F").alias("accepted"),))
    both = coverage.compared(units, claims)
    summary = coverage.topic_summary(docs.select("pack_id").distinct(), units, claims, both)
    lines = coverage.notes(summary, coverage.missing_figures(units, claims, both)).groupBy("pack_id", "topic").agg(F.array_sort(F.collect_list(F.struct("part", "note"))).alias("n"))
    lines = lines.select("pack_id", "topic", F.array_join("n.note", "").alias("note"))
    return lines.unionByName(coverage.pack_notices(docs).select("pack_id", F.lit("all").alias("topic"), F.col("notice").alias("note")))
