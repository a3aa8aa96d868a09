"""Queries about admitting documents and about stored verdicts."""

from pyspark.sql import functions as F

from groundwork import fixed, session
from groundwork.functions.text import host
from groundwork.operators import grounding, routing, segment, verdicts
from groundwork.plans import corpus
from groundwork.plans.corpus import CLAIM_SQL, base_sql, claim_sql
from groundwork.plans.registry import joined, registry
from groundwork.sources.tables import read

QUERIES, ORACLES, query = registry()

SCREEN_DAY = "2000-01-01"

SCREEN_SQL = base_sql(SCREEN_DAY) + """,
m AS (SELECT *, p = '1-URGENT' AS marker, pct >= 50 AS promo, debt % 100 >= 50 AS ai,
   CASE WHEN s = 'P' THEN (cents % 100) ELSE debt % 100 END AS raw100, cents % 201 AS score FROM n),
hosts AS (SELECT DISTINCT c, s FROM m WHERE marker AND age >= 0),
hd AS (SELECT m.*, CASE WHEN age < 0 THEN NULL WHEN marker THEN 'ticker' WHEN h.c IS NOT NULL THEN 'issuer_host' END AS hard
   FROM m LEFT JOIN hosts h ON h.c = m.c AND h.s = m.s),
rt AS (SELECT *, CASE WHEN age < 0 THEN 'excluded' WHEN pct = 13 THEN 'unclear' WHEN promo OR ai THEN 'excluded' WHEN hard IS NOT NULL THEN 'evidence'
     WHEN score < 50 THEN 'excluded' WHEN score <= 150 THEN 'unclear' ELSE 'evidence' END AS status,
   CASE WHEN age < 0 THEN 'Published after the requested as-of date' WHEN pct = 13 THEN 'Document screening unavailable'
     WHEN promo OR ai THEN concat_ws('; ', CASE WHEN promo THEN 'Promotional stock-tip content' END, CASE WHEN ai THEN 'AI-directed instructions remain after hidden-content removal' END)
     WHEN hard IS NOT NULL THEN 'Company matched by ' || hard || '; document screening passed' WHEN score < 50 THEN 'Different company or business'
     WHEN score <= 150 THEN 'Company identity could not be confirmed' ELSE 'Company identity and document screening passed' END AS reason FROM hd)
"""


def screened_documents(spark, sf):
    """Filings with listings named in urgent ones, and hosts shared by customer and status."""
    docs = corpus.filings(spark, sf, keep=("c", "s", "p", "cents", "pct", "debt"), as_of=SCREEN_DAY)
    tail = F.when(F.col("p") == "1-URGENT", F.concat(F.lit("\n\nListed (NSE: tk"), "c", F.lit(").")))
    tail = tail.otherwise(F.concat(F.lit("\n\nNot TK"), "c", F.lit("9 nor XTK"), "c", F.lit(".")))
    return docs.withColumns({"body": F.concat("body", tail), "url": F.concat(
        F.lit("https://IR-"), "s", F.lit(".cust"), "c", F.lit(".example.com:443/"), "k")})


def targets(docs):
    return docs.select("pack_id", F.concat(F.lit("TK"), "c").alias("ticker")).distinct()


def screen_answers(docs):
    def answer(question, form, noul, score, asked_no=1):
        return F.struct(F.lit(question).alias("question"), F.lit(form).alias("form"), noul.cast("double").alias("noul"),
                        score.cast("double").alias("score"), F.lit(asked_no).alias("asked_no"))
    none = F.lit(None)
    rows = docs.filter(F.col("pct") != 13).select("pack_id", "sid", F.explode(F.array(
        answer("promotional_stock_tip", "clean", F.col("pct") / 100, none),
        answer("addresses_ai_tools", "clean", F.col("debt") % 100 / 100, none),
        answer("addresses_ai_tools", "raw", F.col("cents") % 100 / 100, none),
        answer("same_company", "clean", none, F.col("cents") % 201 / 100),
        # Later answers, higher and lower, that must not count.
        answer("promotional_stock_tip", "clean", F.lit(1.0), none, 2), answer("same_company", "clean", none, F.lit(2.0), 2))).alias("_a"))
    return routing.document_answers(rows.select("pack_id", "sid", "_a.*"))


def routed(docs):
    return routing.route(routing.hard_identifiers(docs, targets(docs)), screen_answers(docs))


@query("tier_age_routing", "WITH " + SCREEN_SQL + """
SELECT k, pack_id, sid, CAST(tier AS BIGINT) AS tier, CAST(age AS BIGINT) AS age_days, hard AS hard_identifier, status, reason,
  s <> 'P' AS raw_screen_reused, CAST(CASE WHEN age >= 0 AND pct <> 13 THEN raw100 END AS BIGINT) AS raw_percent FROM rt""")
def tier_age_routing(spark, sf):
    """Tier, age, hard identifiers and threshold routing of every filing."""
    return routed(screened_documents(spark, sf)).select(
        "k", "pack_id", "sid", F.col("tier").cast("bigint").alias("tier"), F.col("age_days").cast("bigint").alias("age_days"),
        "hard_identifier", "status", "reason", "raw_screen_reused",
        F.round(F.col("raw_ai_directed") * 100).cast("bigint").alias("raw_percent"))


@query("unscreened_routing", "WITH " + SCREEN_SQL + """
SELECT k, CASE WHEN age < 0 THEN 'excluded' ELSE 'evidence' END AS status, CASE WHEN age < 0 THEN 'Published after the requested as-of date'
  WHEN hard IS NOT NULL THEN 'Company matched by ' || hard || '; semantic screening not run' ELSE 'Entity not checked; semantic screening not run' END AS reason FROM hd""")
def unscreened_routing(spark, sf):
    """Routing when nobody judged the documents."""
    docs = screened_documents(spark, sf)
    return routing.route(routing.hard_identifiers(docs, targets(docs))).select("k", "status", "reason")


@query("evidence_payload", "WITH " + SCREEN_SQL + """
SELECT pack_id, CAST(count(*) FILTER (WHERE status = 'evidence') AS BIGINT) AS admitted, CAST(6 * count(*) FILTER (WHERE status = 'evidence') AS BIGINT) AS passages,
  CAST(count(*) FILTER (WHERE status <> 'evidence') AS BIGINT) AS withheld FROM rt GROUP BY pack_id""")
def evidence_payload(spark, sf):
    """Admitted documents with passages, and the withheld ones by name."""
    def counted(docs):
        admitted, withheld = routing.payload(segment.with_outline(session.stage(routed(docs))))
        a = admitted.groupBy("pack_id").agg(F.count("*").alias("admitted"), F.sum(F.size("passages")).alias("passages"))
        b = withheld.groupBy("pack_id").agg(F.count("reason").alias("withheld"))
        return a.join(b, "pack_id", "full_outer").na.fill(0)
    return session.in_slices(counted, "pack_id", screened_documents(spark, sf))


@query("source_notices", "WITH " + SCREEN_SQL + """
SELECT pack_id, 'Could not confirm whether source ' || sid || ' concerns this company: ' || reason || '.' AS notice FROM rt WHERE status = 'unclear'
UNION ALL SELECT pack_id, 'No documents were admitted as evidence; the company brief could not be verified.' FROM rt GROUP BY pack_id HAVING NOT bool_or(status = 'evidence')""")
def source_notices(spark, sf):
    """Notices for unclear sources and for packs without evidence."""
    return routing.notices(routed(screened_documents(spark, sf)))


@query("host_semi_join", """
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, html LIKE '%%%%' || '***' || '%' AS marked FROM pages)
SELECT page_id, host FROM h WHERE host IN (SELECT host FROM h WHERE marked)""".replace("'%%%%' || '***' || '%'", "'%***%'"))
def host_semi_join(spark, sf):
    """Pages on a host where some page carries a marker; hosts are made distinct first."""
    pages = read(spark, sf, "pages").select("page_id", host(F.col("url")).alias("host"), F.col("html").contains("***").alias("marked"))
    return pages.join(pages.filter("marked").select("host").distinct(), "host", "left_semi").select("page_id", "host")


EVENT_SQL = """
e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)
"""


def events(spark, sf):
    return read(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"))


@query("verdict_gate", "WITH " + EVENT_SQL + """,
a AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'supports' WHEN event_type = 'error' THEN 'contradicts' ELSE 'says_nothing' END AS c1,
  v % 101 AS p1, k, k < 90 AS retried FROM e),
b AS (SELECT *, CASE WHEN k % 2 = 0 THEN c1 ELSE 'supports' END AS c2, k AS p2 FROM a)
SELECT event_id, CASE WHEN p1 >= 80 THEN c1 WHEN retried AND c2 = c1 AND p2 >= 80 THEN c1 END AS accepted,
  CAST(CASE WHEN p1 >= 80 THEN p1 WHEN retried AND c2 = c1 AND p2 >= 80 THEN p2 END AS BIGINT) AS percent,
  p1 < 80 AS rechecked, p1 < 80 AND NOT retried AS unanswered FROM b""")
def verdict_gate(spark, sf):
    """Confidence gate with one reversed re-check; questions are asked twice, and the first asking counts."""
    e = events(spark, sf)
    c1 = (F.when(F.col("event_type").isin("click", "view"), "supports").when(F.col("event_type") == "error", "contradicts")
          .otherwise("says_nothing"))
    question = F.when(F.col("user_id") % 2 == 0, "kind").otherwise("relation")
    def answer(asked_no, attempt, choice, confidence):
        return F.struct(F.lit(asked_no).alias("asked_no"), F.lit(attempt).alias("attempt"), choice.alias("choice"), confidence.cast("double").alias("confidence"))
    first = answer(1, 1, c1, F.col("v") % 101 / 100)
    again = answer(1, 2, F.when(F.col("k") % 2 == 0, c1).otherwise("supports"), F.col("k") / 100)
    # The same question asked once more, with another answer that is surer: it must not count.
    later = [answer(2, 1, F.lit("undermines"), F.lit(0.99)), answer(2, 2, c1, F.lit(0.98))]
    rows = e.select("event_id", question.alias("question"), F.explode(F.array_compact(
        F.array(first, F.when(F.col("k") < 90, again), *later))).alias("_a")).select("event_id", "question", "_a.*")
    return verdicts.gated(rows, ["event_id"]).select(
        "event_id", "accepted", F.round(F.col("confidence") * 100).cast("bigint").alias("percent"), "rechecked", "unanswered")


@query("verdict_validation", "WITH " + EVENT_SQL + """
SELECT event_id FROM e WHERE NOT CASE event_type WHEN 'click' THEN v <= 10000 AND k <> 5 WHEN 'view' THEN v <= 20000 AND k <> 5 AND k <= 80
  WHEN 'purchase' THEN k % 4 <> 3 AND k <= 80 ELSE false END""")
def verdict_validation(spark, sf):
    """Answers out of range, not finite, of the wrong type or outside the choices."""
    t = F.col("event_type")
    kind = F.when(t == "click", "noul").when(t.isin("view", "signup"), "score").when(t == "purchase", "choice").otherwise("other")
    number = F.when(F.col("k") == 5, F.lit(float("nan"))).otherwise(F.col("v") / 10000)
    choices = F.array(*map(F.lit, fixed.RELATIONS))
    rows = events(spark, sf).select(
        "event_id", kind.alias("type"), F.when(t == "signup", "noul").otherwise(kind).alias("expected_type"),
        number.alias("noul"), number.alias("score"), F.coalesce(F.get(choices, (F.col("k") % 4).cast("int")), F.lit("maybe")).alias("choice"),
        F.when(F.col("k") <= 80, F.col("k") / 100).otherwise(F.col("k") + 0.5).alias("confidence"), choices.alias("choices"))
    return verdicts.invalid_answers(rows).select("event_id")


@query("question_sets", "WITH " + EVENT_SQL + """,
g AS (SELECT DISTINCT user_id, event_type AS question FROM e WHERE k < 40),
a AS (SELECT DISTINCT user_id, unnest(['click', 'view', 'poll']) AS question FROM e)
SELECT user_id, question, 'missing' AS problem FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = a.user_id AND g.question = a.question)
UNION ALL SELECT user_id, question, 'unexpected' FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE g.user_id = a.user_id AND g.question = a.question)""")
def question_sets(spark, sf):
    """Questions asked and not answered, or answered and not asked, per user."""
    e = events(spark, sf)
    given = e.filter("k < 40").withColumnRenamed("event_type", "question")
    asked = e.select("user_id", F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("poll"))).alias("question"))
    return verdicts.unexpected_questions(given, asked, ["user_id"])


SMALL_PACK_SQL = "'pack' || c || '-' || s || '-' || year(d)"

VERDICT_SQL = claim_sql(base_sql(pack=SMALL_PACK_SQL)) + """,
hi AS (SELECT pack_id, count(*) AS expected, max(k) AS pick FROM cl WHERE p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY pack_id),
a1 AS (SELECT er.*, expected, pick, hsid,
   CASE WHEN debt % 4 < 2 THEN 'supports' WHEN debt % 4 = 2 THEN 'contradicts' ELSE 'says_nothing' END AS c1, debt % 50 + 50 AS p1,
   debt % 11 <> 0 AS retried, cents % 50 + 50 AS p2,
   CASE cents % 3 WHEN 0 THEN 'reported_fact' WHEN 1 THEN 'management_view_or_forecast' ELSE 'third_party_view' END AS kc, debt % 5 <> 0 AS ksure,
   CASE WHEN cents % 5 = 0 THEN 'contradicts' ELSE 'supports' END AS hc, CASE WHEN cents % 7 = 0 THEN 60 ELSE 90 END AS hp
   FROM er LEFT JOIN hi ON hi.pack_id = er.pack_id LEFT JOIN (SELECT k AS hk, sid AS hsid FROM n) hs ON hs.hk = hi.pick),
a2 AS (SELECT *, CASE WHEN cents % 2 = 0 THEN c1 ELSE 'supports' END AS c2 FROM a1),
a3 AS (SELECT *, errors = '' AS judged, p1 >= 80 OR retried AS ranswered,
   CASE WHEN p1 >= 80 THEN c1 WHEN retried AND c2 = c1 AND p2 >= 80 THEN c1 END AS relation, CASE WHEN ksure THEN kc END AS kchoice,
   p = '4-NOT SPECIFIED' AND pct <> 50 AND pct NOT BETWEEN 51 AND 60 AND expected IS NOT NULL AS low FROM a2),
a4 AS (SELECT *, low AND expected > 1 AS tlost, low AND hp >= 80 AND hc = 'contradicts' AS tconflict, low AND hp < 80 AS topen FROM a3),
a5 AS (SELECT *, judged AND (NOT ranswered OR tlost) AS unavailable, CASE WHEN judged AND ranswered THEN coalesce(kchoice, kind) ELSE kind END AS kind2 FROM a4),
rs AS (SELECT *, CASE WHEN NOT judged THEN errors ELSE concat_ws(' | ',
     CASE WHEN ranswered THEN CASE WHEN relation IS NULL THEN 'Evidence support is unresolved after an order check.' WHEN relation <> 'supports' THEN 'Cited evidence relation: ' || relation || '.' END END,
     CASE WHEN ranswered AND section = 'snapshot' THEN CASE WHEN kchoice IS NULL THEN 'Snapshot statement kind is unresolved after an order check.' WHEN kchoice <> 'reported_fact' THEN 'Snapshot statements must be reported facts.' END END,
     CASE WHEN unavailable THEN 'Verification unavailable; claim cannot be accepted.' END,
     CASE WHEN section = 'snapshot' AND kind2 <> 'reported_fact' THEN 'Snapshot claims must be reported_fact' END) END AS final_errors,
   CASE WHEN judged THEN ranswered AND kchoice IS NOT NULL END AS confirmed FROM a5),
fin AS (SELECT *, final_errors = '' AND NOT (judged AND ranswered AND (tconflict OR topen)) AS accepted FROM rs)
"""


def small_packs(spark, sf):
    """Routed filings in packs of a customer, a status and a year."""
    small = F.concat(F.lit("pack"), "c", F.lit("-"), "s", F.lit("-"), F.date_format("published", "yyyy"))
    return corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct", "debt"), pack=small))


def judged_claims(docs):
    """Claims of ``small_packs``, or of some of them, with their answers: (claims, units, answers)."""
    units = corpus.filing_units(docs, keep=("pack_id", "sid", "admitted", "title", "published", "age_days", "tier"))
    keyed = session.stage(verdicts.with_key(corpus.claims(docs, also=("cents", "debt"))))
    high = docs.filter((F.col("status") == "evidence") & (F.col("tier") <= 2))
    pick = high.groupBy("pack_id").agg(F.max_by("sid", "k").alias("pick"))
    rows = keyed.join(pick, "pack_id", "left")
    c1 = (F.when(F.col("debt") % 4 < 2, "supports").when(F.col("debt") % 4 == 2, "contradicts").otherwise("says_nothing"))
    p1 = F.col("debt") % 50 + 50

    def answer(stage, question, attempt, choice, percent, only=None, asked_no=1):
        entry = F.struct(stage.alias("stage"), F.lit(question).alias("question"), F.lit(attempt).alias("attempt"),
                         choice.alias("choice"), (percent / 100).cast("double").alias("confidence"), F.lit(asked_no).alias("asked_no"))
        return entry if only is None else F.when(only, entry)

    own, higher = F.lit("cited_evidence"), F.concat(F.lit("higher_tier:"), "pick")
    kind = (F.when(F.col("cents") % 3 == 0, "reported_fact").when(F.col("cents") % 3 == 1, "management_view_or_forecast")
            .otherwise("third_party_view"))
    sure = F.when(F.col("debt") % 5 != 0, 90).otherwise(50)
    against = F.when(F.col("cents") % 5 == 0, "contradicts").otherwise("supports")
    strong = F.when(F.col("cents") % 7 == 0, 60).otherwise(90)
    entries = F.array_compact(F.array(
        answer(own, "relation", 1, c1, p1),
        answer(own, "relation", 2, F.when(F.col("cents") % 2 == 0, c1).otherwise("supports"), F.col("cents") % 50 + 50,
               (p1 < 80) & (F.col("debt") % 11 != 0)),
        answer(own, "kind", 1, kind, sure), answer(own, "kind", 2, kind, F.lit(50), sure < 80),
        answer(higher, "relation", 1, against, strong, F.col("pick").isNotNull()),
        answer(higher, "relation", 2, against, F.lit(70), F.col("pick").isNotNull() & (strong < 80)),
        # A repair asks for the same claims again and gets other, surer answers.
        answer(own, "relation", 1, F.lit("supports"), F.lit(99), asked_no=2), answer(own, "kind", 1, F.lit("reported_fact"), F.lit(99), asked_no=2),
        answer(higher, "relation", 1, F.lit("contradicts"), F.lit(99), F.col("pick").isNotNull(), asked_no=2)))
    answers = rows.select("pack_id", "claim_key", F.explode(entries).alias("_a")).select("pack_id", "claim_key", "_a.*")
    return keyed.drop("cents", "debt"), units, answers


def resolved_claims(docs, findings_too=False):
    """(resolved, findings); what both are made of is staged, so no claim is checked twice."""
    keyed, units, answers = judged_claims(docs)
    checked = session.stage(grounding.check_claims(keyed, units))
    per_claim, findings = verdicts.cross_tier(checked, docs, answers, findings_too)
    return verdicts.resolve(checked, verdicts.cited_evidence(answers), per_claim), findings


@query("verdict_resolution", "WITH " + VERDICT_SQL + """
SELECT k AS claim_id, section, kind AS writer_kind, kind2 AS kind, confirmed AS kind_confirmed, final_errors AS errors, accepted, unavailable FROM fin""")
def verdict_resolution(spark, sf):
    """Final state of every claim after code rules, own passages and higher-tier sources."""
    def final(docs):
        rows, _ = resolved_claims(docs)
        return rows.select("claim_id", "section", "writer_kind", "kind", "kind_confirmed", joined("errors").alias("errors"), "accepted", "unavailable")
    return session.in_slices(final, "pack_id", small_packs(spark, sf))


@query("cross_tier", "WITH " + VERDICT_SQL + """
SELECT k AS claim_id, CAST(tconflict AS BIGINT) AS contradictions, CAST(topen AS BIGINT) AS unresolved, tlost AS tier_unavailable FROM a4 WHERE low""")
def cross_tier(spark, sf):
    """Low-tier claims against the admitted high-tier documents of their pack."""
    def compared(docs):
        keyed, units, answers = judged_claims(docs)
        per_claim, _ = verdicts.cross_tier(grounding.check_claims(keyed, units), docs, answers)
        return per_claim.drop("pack_id")
    return session.in_slices(compared, "pack_id", small_packs(spark, sf))


@query("tier_conflicts", "WITH " + VERDICT_SQL + """
SELECT pack_id, k AS claim_id, hsid AS higher_tier_source, sid AS cited_sources, tconflict AS conflict, CASE WHEN topen THEN 'Comparison with higher-tier source ' || hsid || ' is unresolved.'
  ELSE 'Higher-tier source ' || hsid || ' contradicts the claim.' END AS error FROM a4 WHERE tconflict OR topen""")
def tier_conflicts(spark, sf):
    """The comparisons that contradict or stay open, one row each."""
    def found(docs):
        keyed, units, answers = judged_claims(docs)
        _, findings = verdicts.cross_tier(grounding.check_claims(keyed, units), docs, answers)
        return findings.select("pack_id", "claim_id", "higher_tier_source", joined("cited_sources", ",").alias("cited_sources"), "conflict", "error")
    return session.in_slices(found, "pack_id", small_packs(spark, sf))


@query("claim_error_rows", "WITH " + VERDICT_SQL + """
SELECT error, CAST(count(*) AS BIGINT) AS claims FROM (
  SELECT unnest(string_split(final_errors, ' | ')) AS error FROM fin WHERE final_errors <> ''
  UNION ALL SELECT CASE WHEN topen THEN 'Comparison with higher-tier source ' || hsid || ' is unresolved.' ELSE 'Higher-tier source ' || hsid || ' contradicts the claim.' END
    FROM fin WHERE judged AND ranswered AND (tconflict OR topen)) GROUP BY error""")
def claim_error_rows(spark, sf):
    """How often each message was given."""
    def given(docs):
        rows, findings = resolved_claims(docs, findings_too=True)
        rows = verdicts.error_rows(session.stage(rows.select("pack_id", "claim_id", "errors", "compared")), findings)
        return rows.groupBy("error").agg(F.count("*").alias("claims"))
    # A message may stand in claims of several slices.
    return session.in_slices(given, "pack_id", small_packs(spark, sf)).groupBy("error").agg(F.sum("claims").alias("claims"))


@query("conflict_notices", "WITH " + VERDICT_SQL + """
SELECT pack_id, 'Verification was unavailable for a proposed statement from [' || sid || ']; see checks.json before using that statement.' AS notice FROM fin WHERE unavailable
UNION ALL SELECT pack_id, 'Sources disagree on a proposed statement; reconcile ' || array_to_string(list_sort(['[' || sid || ']', '[' || hsid || ']']), ', ') ||
  ' before relying on it. See checks.json for the exact statement.' FROM fin WHERE judged AND ranswered AND tconflict""")
def conflict_notices(spark, sf):
    """Lines for readers where sources disagree or judging failed."""
    def noticed(docs):
        rows, findings = resolved_claims(docs, findings_too=True)
        return verdicts.conflict_notices(session.stage(rows.select("pack_id", "claim_id", "cites", "unavailable", "compared")), findings)
    return session.in_slices(noticed, "pack_id", small_packs(spark, sf))


@query("repair_requests", "WITH " + VERDICT_SQL + """
SELECT k AS claim_id FROM fin WHERE accepted AND section <> 'snapshot' AND NOT confirmed""")
def repair_requests(spark, sf):
    """Accepted draft claims whose kind no verdict confirmed."""
    def requested(docs):
        rows, _ = resolved_claims(docs)
        return verdicts.repair_requests(rows.withColumn("stage", F.lit("draft"))).select("claim_id")
    return session.in_slices(requested, "pack_id", small_packs(spark, sf))


@query("verdict_reuse", "WITH " + EVENT_SQL + """
SELECT claim_key, choice, CAST(k AS BIGINT) AS percent FROM (SELECT event_type || '-' || user_id AS claim_key, CASE WHEN k % 2 = 0 THEN 'supports' ELSE 'contradicts' END AS choice, k,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM e) WHERE r = 1""")
def verdict_reuse(spark, sf):
    """Repeated claims take the first answer given."""
    rows = events(spark, sf).select(
        F.lit("p").alias("pack_id"), F.concat_ws("-", "event_type", "user_id").alias("claim_key"), F.lit("cited_evidence").alias("stage"),
        F.lit("relation").alias("question"), F.lit(1).alias("attempt"), F.when(F.col("k") % 2 == 0, "supports").otherwise("contradicts").alias("choice"),
        (F.col("k") / 100).alias("confidence"), F.col("event_id").alias("asked_no"))
    return verdicts.first_answers(rows).select("claim_key", "choice", F.round(F.col("confidence") * 100).cast("bigint").alias("percent"))


@query("unjudged_claims", "WITH " + CLAIM_SQL + """
SELECT k AS claim_id, section, kind, errors, errors = '' AS accepted FROM er""")
def unjudged_claims(spark, sf):
    """Final state of every claim in a design without a judge."""
    def final(docs):
        units = corpus.filing_units(docs, keep=("pack_id", "sid", "admitted", "title", "published", "age_days", "tier"))
        rows = verdicts.unjudged(grounding.check_claims(verdicts.with_key(corpus.claims(docs)), units))
        return rows.select("claim_id", "section", "kind", joined("errors").alias("errors"), "accepted")
    return session.in_slices(final, "pack_id", corpus.with_route(corpus.filings(spark, sf, keep=("s", "p", "cents", "pct"))))
