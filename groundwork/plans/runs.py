"""Queries about passes and saved runs. A customer is a run; its orders are the claims. A supplier is a run without claims."""

from pyspark.sql import functions as F

from groundwork import schemas
from groundwork.functions import text as tx
from groundwork.functions.stats import interval_text, wilson
from groundwork.operators import ordering, passes, runs
from groundwork.plans.registry import joined, registry
from groundwork.plans.routing import EVENT_SQL, events
from groundwork.sources import artifacts
from groundwork.sources.tables import read, spread

QUERIES, ORACLES, query = registry()

RESULT_SQL = """
r AS (SELECT o_orderkey AS k, o_custkey AS run_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS s, o_orderpriority AS p,
  CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'snapshot' WHEN o_orderpriority = '2-HIGH' THEN 'bull' WHEN o_orderpriority = '3-MEDIUM' THEN 'bear' ELSE 'open_questions' END AS section,
  CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS stage_no FROM orders),
runs AS (SELECT DISTINCT o_custkey AS run_id FROM orders UNION ALL SELECT -1 - s_suppkey FROM supplier),
st AS (SELECT DISTINCT run_id, CASE stage_no WHEN 1 THEN 'draft' ELSE 'repair' END AS stage, stage_no, stage_no = 1 OR run_id % 3 <> 0 AS succeeded, false AS shape FROM r
  UNION ALL SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'format_repair' ELSE 'draft' END, 1, run_id % 4 <> -1, run_id % 2 <> 0 FROM runs WHERE run_id < 0),
q AS (SELECT *, cents % 5 = 0 AS bad_cite, cents % 7 = 0 AS bad_number, cents % 11 = 0 AS bad_kind FROM r),
w AS (SELECT *, NOT bad_cite AND NOT bad_number AND NOT bad_kind AS accepted FROM q),
last AS (SELECT run_id, max(stage_no) AS stage_no FROM st WHERE succeeded GROUP BY run_id),
fr AS (SELECT w.* FROM w JOIN last USING (run_id, stage_no))
"""


def all_runs(spark, sf):
    """Every run: those of customers with orders, and those of suppliers, which have no claim."""
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("run_id")).distinct().unionByName(claimless_runs(spark, sf))


def claimless_runs(spark, sf):
    return read(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("run_id"))


def results(spark, sf):
    """Checked claims: partly shipped orders are a repair, the others the draft."""
    o = read(spark, sf, "orders")
    p = F.col("o_orderpriority")
    section = (F.when(p.isin("1-URGENT", "5-LOW"), "snapshot").when(p == "2-HIGH", "bull").when(p == "3-MEDIUM", "bear")
               .otherwise("open_questions"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    repair = F.col("o_orderstatus") == "P"
    rows = o.select(F.col("o_custkey").alias("run_id"), F.when(repair, "repair").otherwise("draft").alias("stage"),
                    F.when(repair, 2).otherwise(1).alias("stage_no"), section.alias("section"), F.col("o_orderkey").alias("idx"),
                    F.concat(F.lit("Order "), "o_orderkey").alias("text"), cents.alias("cents"))
    errors = F.array_compact(F.array(
        F.when(F.col("cents") % 5 == 0, F.concat(F.lit("Unknown cited unit: S"), "idx")),
        F.when(F.col("cents") % 7 == 0, F.concat(F.lit("Number "), "cents", F.lit(" (scalar) is not supported by the cited quotes"))),
        F.when(F.col("cents") % 11 == 0, "Claim kind is invalid")))
    return rows.withColumns({"code_errors": errors, "errors": errors, "accepted": F.size(errors) == 0,
                             "kind_confirmed": F.when(F.size(errors) == 0, F.col("cents") % 2 == 0)})


def stages(rows):
    done = (F.col("stage_no") == 1) | (F.col("run_id") % 3 != 0)
    return rows.select("run_id", "stage", "stage_no", done.alias("succeeded")).distinct()


def all_stages(spark, sf, rows):
    """Stages of all runs: a run without claims had an empty format repair, or an output of the wrong shape."""
    run = F.col("run_id")
    empty = claimless_runs(spark, sf).select(
        "run_id", F.when(run % 2 == 0, "format_repair").otherwise("draft").alias("stage"), F.lit(1).alias("stage_no"), (run % 4 != -1).alias("succeeded"))
    return stages(rows).unionByName(empty)


def shape_faults(spark, sf):
    return claimless_runs(spark, sf).filter("run_id % 2 <> 0").select(
        "run_id", F.lit("draft").alias("stage"), F.lit(1).alias("stage_no"), F.lit("Output must contain exactly the four section arrays.").alias("error"))


def notices(rows):
    """System notices of a run; many repeat."""
    return rows.select("run_id", F.concat(F.lit("Notice about "), "section").alias("notice"), F.col("idx").alias("place"))


WILSON_SQL = """CASE WHEN {n} > 0 THEN round({side}({bound}, ({k}::DOUBLE / {n}::DOUBLE + {z2} / (2 * {n}::DOUBLE)) / (1 + {z2} / {n}::DOUBLE) {sign}
  1.959963984540054 * sqrt(({k}::DOUBLE / {n}::DOUBLE) * (1 - {k}::DOUBLE / {n}::DOUBLE) / {n}::DOUBLE + {z2} / (4 * {n}::DOUBLE * {n}::DOUBLE)) / (1 + {z2} / {n}::DOUBLE)), 9) END"""


def wilson_sql(k, n, low):
    return WILSON_SQL.format(k=k, n=n, z2="(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE)", side="greatest" if low else "least",
                             bound="0.0::DOUBLE" if low else "1.0::DOUBLE", sign="-" if low else "+")


@query("run_metrics", "WITH " + RESULT_SQL + """,
m AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE NOT bad_cite) AS c, count(*) FILTER (WHERE NOT bad_number) AS u,
   count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS d FROM fr GROUP BY run_id),
s AS (SELECT run_id, count(DISTINCT section) AS q FROM r GROUP BY run_id)
SELECT run_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(c, 0) AS BIGINT) AS cited_ok, CAST(coalesce(u, 0) AS BIGINT) AS numbers_ok, CAST(coalesce(a, 0) AS BIGINT) AS accepted_claims,
  CAST(coalesce(d, 0) AS BIGINT) AS dropped_claims, CAST(coalesce(q, 0) AS BIGINT) AS system_open_questions, """ + wilson_sql("c", "n", True) + " AS cited_low, " + wilson_sql("c", "n", False) + """ AS cited_high,
  """ + wilson_sql("u", "n", True) + " AS numbers_low, " + wilson_sql("u", "n", False) + """ AS numbers_high FROM runs LEFT JOIN m USING (run_id) LEFT JOIN s USING (run_id)""")
def run_metrics(spark, sf):
    """Counts, both pass ratios and their intervals over each run's final stage."""
    rows = results(spark, sf)
    out = passes.run_metrics(all_runs(spark, sf), passes.final_results(rows, stages(rows)), notices(rows))
    return out.withColumns({c: F.round(c, 9) for c in ("cited_low", "cited_high", "numbers_low", "numbers_high")})


@query("run_status", "WITH " + RESULT_SQL + """,
m AS (SELECT run_id, count(*) FILTER (WHERE section = 'snapshot' AND accepted) AS a, count(*) FILTER (WHERE section = 'bull' AND accepted) AS b,
  count(*) FILTER (WHERE section = 'bear' AND accepted) AS c, count(*) FILTER (WHERE section = 'open_questions' AND accepted) AS d,
  count(*) FILTER (WHERE NOT accepted) AS dropped FROM fr GROUP BY run_id),
u AS (SELECT run_id, bool_or(cents % 101 = 0) AS lost, sum(cents % 100) AS words FROM r GROUP BY run_id),
x AS (SELECT run_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(dropped, 0) AS dropped, coalesce(lost, run_id % 3 = 0) AS lost, words
  FROM runs LEFT JOIN m USING (run_id) LEFT JOIN u USING (run_id))
SELECT run_id, CASE WHEN lost THEN 'verification_unavailable' WHEN least(a, b, c, d) = 0 OR a NOT IN (3, 4) THEN 'incomplete' WHEN dropped > 0 THEN 'completed_with_drops' ELSE 'completed' END AS status,
  CAST(words AS BIGINT) AS word_count, concat_ws(' | ', CASE WHEN a = 0 THEN 'No accepted claims in required section: snapshot' END, CASE WHEN b = 0 THEN 'No accepted claims in required section: bull' END,
  CASE WHEN c = 0 THEN 'No accepted claims in required section: bear' END, CASE WHEN d = 0 THEN 'No accepted claims in required section: open_questions' END,
  CASE WHEN words > 600 THEN 'Body exceeds 600 words' END, CASE WHEN a NOT IN (3, 4) THEN 'Snapshot does not contain three or four items' END) AS warnings
FROM x""")
def run_status(spark, sf):
    """Status and warnings of every run."""
    rows = results(spark, sf)
    lost = rows.select("run_id", (F.col("cents") % 101 == 0).alias("unavailable")).unionByName(
        claimless_runs(spark, sf).filter("run_id % 3 = 0").select("run_id", F.lit(True).alias("unavailable")))  # screening outages
    words = rows.groupBy("run_id").agg(F.sum(F.col("cents") % 100).alias("word_count"))
    out = passes.run_status(all_runs(spark, sf), passes.final_results(rows, stages(rows)), lost, words)
    return out.withColumn("warnings", joined("warnings"))


@query("section_counts", "WITH " + RESULT_SQL + """
SELECT run_id, section, CAST(count(*) AS BIGINT) AS claims, CAST(count(*) FILTER (WHERE accepted) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE NOT accepted) AS BIGINT) AS dropped
FROM fr GROUP BY run_id, section""")
def section_counts(spark, sf):
    """Claims per run and section."""
    rows = results(spark, sf)
    return passes.section_counts(passes.final_results(rows, stages(rows)))


@query("dropped_claims", "WITH " + RESULT_SQL + """
SELECT run_id, section, CAST(k AS BIGINT) AS idx, concat_ws(' | ', CASE WHEN bad_cite THEN 'Unknown cited unit: S' || k END,
  CASE WHEN bad_number THEN 'Number ' || cents || ' (scalar) is not supported by the cited quotes' END, CASE WHEN bad_kind THEN 'Claim kind is invalid' END) AS errors FROM fr WHERE NOT accepted""")
def dropped_claims(spark, sf):
    """Claims the final stage dropped, with their messages."""
    rows = results(spark, sf)
    out = passes.dropped(passes.final_results(rows, stages(rows)))
    return out.select("run_id", "section", "idx", joined("errors").alias("errors"))


@query("stage_summary", "WITH " + RESULT_SQL + """,
g AS (SELECT run_id, stage_no, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS f, count(*) FILTER (WHERE accepted AND section = 'snapshot') AS kept,
  count(*) FILTER (WHERE stage_no = 1 AND accepted AND section <> 'snapshot' AND cents % 2 <> 0) AS q FROM w GROUP BY 1, 2)
SELECT run_id, stage, CAST(coalesce(a, 0) AS BIGINT) AS accepted, CAST(coalesce(f, 0) + CASE WHEN shape OR (coalesce(kept, 0) NOT IN (3, 4) AND succeeded) THEN 1 ELSE 0 END AS BIGINT) AS failed,
  CAST(coalesce(q, 0) AS BIGINT) AS repair_requested FROM st LEFT JOIN g USING (run_id, stage_no)""")
def stage_summary(spark, sf):
    """Accepted, failed and repair-requested claims per pass, structure failures included."""
    rows = results(spark, sf)
    known = all_stages(spark, sf, rows)
    return passes.stage_summary(known, rows, passes.structure_failures(rows, known, shape_faults(spark, sf))).select(
        "run_id", "stage", "accepted", F.col("failed").cast("bigint").alias("failed"), "repair_requested")


@query("structure_failures", "WITH " + RESULT_SQL + """
SELECT run_id, stage, CASE WHEN shape THEN 'Output must contain exactly the four section arrays.' ELSE
  'Snapshot retained ' || coalesce(kept, 0) || ' supported items; it requires three or four. Return three or four supported reported facts without inventing evidence.' END AS error
FROM st LEFT JOIN (SELECT run_id, stage_no, count(*) FILTER (WHERE accepted AND section = 'snapshot') AS kept FROM w GROUP BY 1, 2) USING (run_id, stage_no) WHERE shape OR (succeeded AND coalesce(kept, 0) NOT IN (3, 4))""")
def structure_failures(spark, sf):
    """Stages whose snapshot has the wrong size; no claim is blamed for it."""
    rows = results(spark, sf)
    return passes.structure_failures(rows, all_stages(spark, sf, rows), shape_faults(spark, sf)).select("run_id", "stage", "error")


@query("stage_latest", """
SELECT conv_id AS run_id, CAST(turn AS BIGINT) AS stage_no, role, CAST(length(text) AS BIGINT) AS chars FROM (
  SELECT *, rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'user') WHERE r = 1""")
def stage_latest(spark, sf):
    """Last successful turn of every conversation, text included."""
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("stage_no"), "role", "text")
    done = rows.select("run_id", F.col("role").alias("stage"), "stage_no", (F.col("role") != "user").alias("succeeded"))
    return passes.final_results(rows, done).select("run_id", "stage_no", "role", F.length("text").cast("bigint").alias("chars"))


@query("latest_rank", """
SELECT doc_id, source FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS r FROM documents) WHERE r = 1""")
def latest_rank(spark, sf):
    """All rows that share the highest value of their key."""
    return ordering.latest(read(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["source"], "n_chars").select("doc_id", "source")


@query("check_records", "WITH " + RESULT_SQL + """,
a AS (SELECT run_id, section, max(stage_no) AS stage_no FROM w WHERE accepted GROUP BY 1, 2),
c AS (SELECT run_id, section, min(cents % 3) AS judged FROM w JOIN a USING (run_id, section, stage_no) WHERE accepted GROUP BY 1, 2),
e AS (SELECT DISTINCT run_id, section FROM r)
SELECT e.run_id, e.section, CASE WHEN c.run_id IS NULL THEN 'not_run' ELSE 'passed' END AS code, CASE WHEN c.run_id IS NULL OR judged = 2 THEN 'not_run' WHEN judged = 1 THEN 'unavailable' ELSE 'supported' END AS support
FROM e LEFT JOIN c ON c.run_id = e.run_id AND c.section = e.section""")
def check_records(spark, sf):
    """Check record behind each accepted claim: the latest stage wins for equal claims."""
    rows = results(spark, sf).filter("accepted").groupBy("run_id", "section", "stage_no").agg(F.min(F.col("cents") % 3).alias("j"))
    rows = rows.withColumns({"claim_key": F.col("section"), "code_errors": F.array().cast("array<string>"), "errors": F.array().cast("array<string>"),
                             "judged": F.col("j") != 2, "unavailable": F.col("j") == 1, "kind_confirmed": F.lit(True), "accepted": F.lit(True)})
    asked = results(spark, sf).select("run_id", "section", F.col("section").alias("claim_key")).distinct()
    return passes.check_records(rows, asked).select("run_id", "section", "code", "support")


@query("token_totals", "WITH " + EVENT_SQL + """,
t AS (SELECT user_id AS run_id, coalesce(CASE WHEN event_id % 3 = 0 THEN v END, CASE WHEN event_id % 2 = 0 THEN v + 1 END) AS i,
   coalesce(CASE WHEN event_id % 3 = 1 THEN k END, CASE WHEN event_id % 5 < 3 THEN k + 1 END) AS o, CASE WHEN event_id % 7 = 0 THEN v + k END AS tt FROM e),
s AS (SELECT run_id, i, o, coalesce(tt, i + o) AS tot FROM t),
g AS (SELECT run_id, sum(i) AS i, sum(o) AS o, sum(tot) AS tot, least(count(i), count(o), count(tot)) AS seen, count(*) AS n FROM s GROUP BY run_id)
SELECT run_id, CAST(i AS BIGINT) AS input, CAST(o AS BIGINT) AS output, CAST(tot AS BIGINT) AS total, seen < n + run_id % 2 AS partial FROM g""")
def token_totals(spark, sf):
    """Token totals per run with alias preference; unreported stays unknown."""
    e = events(spark, sf)
    i = F.col("event_id")
    rows = e.select(F.col("user_id").alias("run_id"), F.when(i % 3 == 0, F.col("v")).when(i % 2 == 0, -1).alias("prompt_tokens"),
                    F.when(i % 3 == 1, F.col("k")).alias("completion_tokens"), F.when(i % 2 == 0, F.col("v") + 1).alias("input_tokens"),
                    F.when(i % 5 < 3, F.col("k") + 1).alias("output_tokens"), F.when(i % 7 == 0, F.col("v") + F.col("k")).alias("total_tokens"))
    attempts = e.groupBy(F.col("user_id").alias("run_id")).agg((F.count("*") + F.first("user_id") % 2).alias("attempts"))
    return runs.usage_totals(rows, attempts)


VERSION_SQL = """'[{"key":"a.py","value":"' || {a} || '"},{"key":"b.py","value":"' || {b} || '"}]'"""


@query("version_counts", """
WITH v AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE substr(sha256('[{"key":"a.py","value":"' || o_orderpriority || '"},{"key":"b.py","value":"' || year(o_orderdate) || '"}]'), 1, 12) END AS version,
  CASE WHEN o_orderstatus <> 'P' THEN CASE o_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'unfinished' END ELSE 'unfinished' END AS arm FROM orders)
SELECT version, CAST(count(*) FILTER (WHERE arm = 'A') AS BIGINT) AS "A", CAST(count(*) FILTER (WHERE arm = 'B') AS BIGINT) AS "B", CAST(count(*) FILTER (WHERE arm = 'C') AS BIGINT) AS "C",
  CAST(count(*) FILTER (WHERE arm = 'D') AS BIGINT) AS "D", CAST(count(*) FILTER (WHERE arm = 'unfinished') AS BIGINT) AS unfinished FROM v GROUP BY version""")
def version_counts(spark, sf):
    """Runs per source version and design."""
    manifest = F.create_map(F.lit("b.py"), F.date_format("o_orderdate", "yyyy"), F.lit("a.py"), F.col("o_orderpriority"))
    arm = F.get(F.array(*map(F.lit, "ABCD")), (F.col("o_custkey") % 5).cast("int"))
    rows = read(spark, sf, "orders").select(
        runs.version_of(F.when(F.col("o_orderpriority") != "5-LOW", manifest)).alias("version"), arm.alias("arm"),
        F.when(F.col("o_orderstatus") != "P", "completed").alias("status"))
    return runs.version_counts(rows)


@query("human_review", """
WITH x AS (SELECT d.doc_id, l.quality, l.toxic, d.lang, (l.quality IS NOT NULL)::INT + 1 AS n, coalesce(l.quality, 0) + 1 AS k FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id AS run_id, CASE WHEN doc_id % 7 = 0 THEN 'pending' WHEN lang = 'fr' THEN 'pending (reviewer missing)' WHEN lang = 'de' THEN 'pending (human review required)' WHEN lang = 'es' THEN 'invalid duplicate/missing sample IDs'
  WHEN n = 1 THEN '1/1 [20.7%, 100.0%]; 2 pending' WHEN k = 1 THEN '1/2 [9.5%, 90.5%]; 1 pending' ELSE '2/2 [34.2%, 100.0%]; 1 pending' END AS support,
  CASE WHEN doc_id % 7 = 0 OR lang <> 'en' OR toxic IS NULL THEN 'pending' ELSE toxic || '/1 reviewed; 6 pending' END AS traps,
  CASE WHEN doc_id % 7 = 0 OR lang <> 'en' OR toxic IS NULL THEN 'pending' ELSE CAST(toxic AS VARCHAR) END AS rounding FROM x""")
def human_review(spark, sf):
    """Support, trap and rounding results from label files; only human booleans count."""
    docs, labels = read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels")
    rows = docs.join(labels, "doc_id", "left")
    def item(i, ok):
        return F.struct(i.alias("id"), F.lit("A claim.").alias("text"), ok.alias("pass"), F.lit("").alias("note"))
    twice = F.when(F.col("lang") == "es", "a").otherwise("b")
    sample = F.array(item(F.lit("a"), F.lit(True)), item(twice, F.col("quality") == 1), item(F.lit("c"), F.lit(None).cast("boolean")))
    traps = F.create_map(F.lit("scope"), F.struct((F.col("toxic") == 1).alias("pass"), F.lit("").alias("note")))
    stored = F.col("doc_id") % 7 != 0  # the others have no label file
    return runs.human_review(rows.select(
        F.col("doc_id").alias("run_id"), F.when(stored, F.when(F.col("lang") != "fr", "R").otherwise("\t\n")).alias("reviewer"),
        F.when(stored, F.when(F.col("lang") == "de", "model").otherwise("human")).alias("reviewer_type"), F.when(stored, sample).alias("supported_sample"),
        F.when(stored, traps).alias("traps"),
        F.when(stored, F.struct(F.coalesce(F.col("toxic").cast("bigint"), F.lit(-1).cast("bigint")).alias("count"))).alias("rounding_false_alarms")))


@query("wilson_intervals", """
WITH g AS (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS k FROM documents GROUP BY 1, 2)
SELECT source, lang, """ + wilson_sql("k", "n", True) + " AS low, " + wilson_sql("k", "n", False) + """ AS high FROM g""")
def wilson_intervals(spark, sf):
    """Share of long documents per source and language with its interval."""
    rows = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("k"))
    bounds = wilson(F.col("k"), F.col("n"))
    return rows.select("source", "lang", F.round(bounds["low"], 9).alias("low"), F.round(bounds["high"], 9).alias("high"))


@query("interval_texts", """
WITH g AS (SELECT CAST(o_custkey AS BIGINT) AS run_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS k, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n FROM orders GROUP BY 1)
SELECT run_id, CASE WHEN n = 0 THEN 'not measured' ELSE k || '/' || n || ' [' || printf('%.1f', 100 * """ + wilson_sql("k", "n", True) + """) || '%, ' || printf('%.1f', 100 * """ + wilson_sql("k", "n", False) + """) || '%]' END AS ratio FROM g""")
def interval_texts(spark, sf):
    """Ratio with its interval as text per run."""
    rows = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count_if(F.col("o_orderstatus") != "P").alias("n"))
    return rows.select("run_id", interval_text(F.col("k"), F.col("n")).alias("ratio"))


ATTEMPT_SQL = EVENT_SQL + """,
t AS (SELECT event_id, user_id AS run_id, CASE WHEN event_type IN ('click', 'view') THEN 'writer' ELSE 'verifier' END AS provider, CASE WHEN k < 30 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN k < 10 THEN 'minute_window_cooldown' WHEN k < 30 THEN 'server_error_backoff' END AS retry_reason, CASE WHEN k < 10 THEN 60 WHEN k < 30 THEN 1 END AS delay, v,
  CASE WHEN k < 30 THEN NULL ELSE 'model-' || k % 3 END AS model, CASE WHEN event_type = 'error' THEN 'rate_limit' WHEN event_type = 'view' THEN 'bad_' || event_type ELSE NULL END AS code FROM e)
"""


def attempts(spark, sf):
    """Attempt logs of both providers, one stored array per event."""
    e = events(spark, sf)
    k, t = F.col("k"), F.col("event_type")
    code = F.when(t == "error", "rate_limit").when(t == "view", "bad_view").when(t == "click", "org_1234").otherwise("HTTP 500")
    log = F.struct(
        F.lit(1).cast("bigint").alias("attempt"), F.when(k < 30, "error").otherwise("ok").alias("status"), F.lit("E").alias("error_type"),
        F.lit(429).cast("bigint").alias("http_status"), code.alias("provider_error_code"),
        F.when(k < 10, "minute_window_cooldown").when(k < 30, "server_error_backoff").alias("retry_reason"),
        F.when(k < 10, 60.0).when(k < 30, 1.0).alias("retry_delay_s"), F.lit(None).cast("double").alias("provider_requested_wait_s"),
        F.col("v").cast("double").alias("elapsed_s"), F.lit("m").alias("requested_model"),
        F.when(k >= 30, F.concat(F.lit("model-"), k % 3)).alias("model"), F.lit("").alias("request_sha256"))
    rows = e.select(F.col("user_id").alias("run_id"), "event_type", F.array(log).alias("value"))
    written = F.col("event_type").isin("click", "view")
    return runs.attempt_rows(rows.filter(written), rows.filter(~written))


@query("attempt_summary", "WITH " + ATTEMPT_SQL + """
SELECT provider, status, retry_reason, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(delay) AS BIGINT) AS waited_s, CAST(sum(v) AS BIGINT) AS elapsed_s FROM t GROUP BY 1, 2, 3""")
def attempt_summary(spark, sf):
    """Attempts and waits by provider, status and reason."""
    out = runs.attempt_summary(attempts(spark, sf))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("waited_s", "elapsed_s")})


@query("transport_errors", "WITH " + ATTEMPT_SQL + """
SELECT run_id, provider, code AS provider_error_code, CAST(count(*) AS BIGINT) AS errors FROM t WHERE status = 'error' GROUP BY 1, 2, 3""")
def transport_errors(spark, sf):
    """Failed attempts per run with the codes that are safe to keep."""
    return runs.transport_errors(attempts(spark, sf)).groupBy("run_id", "provider", "provider_error_code").agg(F.count("*").alias("errors"))


@query("returned_models", "WITH " + ATTEMPT_SQL + """
SELECT run_id, provider, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM t WHERE model IS NOT NULL GROUP BY 1, 2""")
def returned_models(spark, sf):
    """Model ids each provider returned per run."""
    return runs.returned_models(attempts(spark, sf)).withColumn("models", joined("models", ","))


@query("wait_durations", "WITH " + EVENT_SQL + """
SELECT event_id, CASE event_type WHEN 'click' THEN CAST(k * 60000 + v * 10 AS BIGINT) WHEN 'view' THEN v WHEN 'purchase' THEN CAST(k * 3600000 + 59 * 60000 AS BIGINT) WHEN 'signup' THEN CAST(v * 10 AS BIGINT) END AS milliseconds FROM e""")
def wait_durations(spark, sf):
    """Waits in provider notation as milliseconds; broken ones give none."""
    v, k, t = F.col("v"), F.col("k"), F.col("event_type")
    shown = F.format_string("%d.%02d", F.expr("v div 100"), v % 100)
    text = (F.when(t == "click", F.concat(k.cast("string"), F.lit("M"), shown, F.lit("s "))).when(t == "view", F.concat(v.cast("string"), F.lit("ms")))
            .when(t == "purchase", F.concat(k.cast("string"), F.lit("h59m"))).when(t == "signup", shown).otherwise(F.concat(F.lit("-"), shown, F.lit("x"))))
    return events(spark, sf).select("event_id", F.round(tx.seconds(text) * 1000).cast("bigint").alias("milliseconds"))


@query("manifest_identity", """
WITH s AS (SELECT source AS run_id, CAST(doc_id AS VARCHAR) AS name, sha256(text) AS h FROM documents),
p AS (SELECT source AS run_id, CAST(doc_id AS VARCHAR) AS name, sha256(CASE WHEN toxic = 1 THEN text || '.' ELSE text END) AS h FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT DISTINCT source, 'extra', 'x' FROM documents WHERE lang = 'fr')
SELECT coalesce(s.run_id, p.run_id) AS run_id, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE s.h IS DISTINCT FROM p.h) AS BIGINT) AS different, bool_and(s.h IS NOT DISTINCT FROM p.h) AS evidence_available
FROM s FULL JOIN p ON s.run_id = p.run_id AND s.name = p.name GROUP BY 1""")
def manifest_identity(spark, sf):
    """Saved file hashes against the files at hand."""
    docs = spread(read(spark, sf, "documents").select("doc_id", "source", "lang", "text"))
    name = F.col("doc_id").cast("string").alias("name")
    saved = docs.select(F.col("source").alias("run_id"), name, F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    present = docs.join(read(spark, sf, "labels"), "doc_id").select(F.col("source").alias("run_id"), name, F.sha2(changed, 256).alias("sha256"))
    extra = docs.filter("lang = 'fr'").select(F.col("source").alias("run_id"), F.lit("extra").alias("name"), F.lit("x").alias("sha256")).distinct()
    return runs.manifest_identity(saved, present.unionByName(extra))


def stored(spark, sf):
    """Artifacts of one run per order as JSON text; some are broken, missing or of a wrong type."""
    o = spread(read(spark, sf, "orders"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = o.select(F.concat(F.lit("run-"), "o_orderkey").alias("run_id"), "o_custkey", F.col("o_orderstatus").alias("s"),
                    F.col("o_orderpriority").alias("p"), cents.alias("cents"))
    arm = F.get(F.array(*map(F.lit, "ABCD")), (F.col("o_custkey") % 4).cast("int"))
    config = F.when(F.col("p") == "5-LOW", '{"arm":').otherwise(F.concat(
        F.lit('{"arm":"'), arm, F.lit('","ticker":"T'), "o_custkey", F.lit('","as_of":"2026-01-01","writer_requested_model":"w|1","source_manifest":{"a.py":"'), "p", F.lit('"}}')))
    checks = F.when(F.col("s") != "P", F.concat(
        F.lit('{"status":"completed","word_count":'), F.when(F.col("s") == "O", "true").otherwise((F.col("cents") % 500).cast("string")),
        F.lit(',"metrics":{"cited_ids_valid":{"k":'), F.col("cents") % 3, F.lit(',"n":2},"accepted_claims":'), F.col("cents") % 9,
        F.lit('},"accepted":{"snapshot":[{"text":"x","kind":"reported_fact","cites":[]}],"bull":[],"bear":[],"open_questions":[]}}')))
    timings = F.concat(F.lit('{"elapsed_s":1.5,"writer_attempts":1,"jev_attempts":1,"usage":[{"provider":"writer","usage":{"prompt_tokens":'),
                       F.col("cents") % 1000, F.lit(',"completion_tokens":5}},{"provider":"jev","usage":{"input_tokens":7,"output_tokens":3}}]}'))
    def table(text, schema):
        files = rows.select("run_id", F.lit(False).alias("too_large"), text.alias("json")).filter(F.col("json").isNotNull())
        return artifacts.read(files, schema)
    labels = F.when(F.col("p") == "1-URGENT", '{"run":"another","reviewer":"R"}')
    return runs.run_artifacts(rows, table(config, schemas.CONFIG), table(checks, schemas.CHECKS), table(timings, schemas.TIMINGS),
                              table(labels, schemas.LABELS))


STORED_SQL = """
a AS (SELECT 'run-' || o_orderkey AS run_id, ['A', 'B', 'C', 'D'][o_custkey % 4 + 1] AS arm, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
"""


@query("metrics_report", "WITH " + STORED_SQL + """
SELECT '| ' || run_id || ' | ' || CASE WHEN p = '5-LOW' THEN '? | unknown | unreadable artifacts | ' || array_to_string(list_transform(range(7), lambda x: 'not measured'), ' | ') ELSE
  arm || ' | ' || substr(sha256('[{"key":"a.py","value":"' || p || '"}]'), 1, 12) || ' | ' || CASE WHEN s = 'P' THEN 'missing checks' ELSE 'completed' END || ' | ' ||
  CASE WHEN s = 'P' OR arm = 'A' THEN 'not measured' WHEN cents % 3 = 0 THEN '0/2 [0.0%, 65.8%]' WHEN cents % 3 = 1 THEN '1/2 [9.5%, 90.5%]' ELSE '2/2 [34.2%, 100.0%]' END || ' | not measured | ' ||
  CASE WHEN s = 'P' OR arm = 'A' THEN 'not measured' ELSE CAST(cents % 9 AS VARCHAR) END || ' | not measured | ' || CASE WHEN s <> 'F' THEN '?' ELSE CAST(cents % 500 AS VARCHAR) END || ' | 1.50 | ' ||
  (cents % 1000 + 7) || '/8/' || (cents % 1000 + 15) END || ' |' AS line FROM a""")
def metrics_report(spark, sf):
    """Report table over saved artifacts, as Markdown rows."""
    return runs.markdown_rows(runs.metrics_rows(stored(spark, sf)))


@query("artifact_notices", "WITH " + STORED_SQL + """
SELECT run_id, CASE WHEN p = '5-LOW' THEN run_id || ': an artifact could not be summarized; inspect that run''s JSON files.' ELSE run_id || ': review labels name another run and were ignored.' END AS notice
FROM a WHERE p IN ('5-LOW', '1-URGENT')""")
def artifact_notices(spark, sf):
    """Runs with unreadable artifacts or foreign labels."""
    return stored(spark, sf).filter("notice is not null").select("run_id", "notice")


@query("run_history", "WITH " + STORED_SQL + """
SELECT run_id AS id, CASE WHEN p = '5-LOW' THEN '' ELSE 'T' || c END AS company, CASE WHEN s = 'P' THEN 'incomplete' ELSE 'completed' END AS status, CAST(CASE WHEN s = 'P' THEN 0 ELSE 1 END AS BIGINT) AS claims_count,
  CASE WHEN p <> '5-LOW' AND arm = 'C' THEN 'w|1' END AS verifier_model FROM a WHERE contains(lower(run_id), 't1') OR (p <> '5-LOW' AND contains(lower('T' || c), 't1'))""")
def run_history(spark, sf):
    """Run summaries found by a search text in id, company or ticker."""
    return runs.search(runs.run_summary(stored(spark, sf)), " T1").select("id", "company", "status", "claims_count", "verifier_model")


@query("run_listing", "WITH " + STORED_SQL + """
SELECT run_id AS id, 'T' || c AS company, arm FROM a WHERE p <> '5-LOW' AND run_id NOT LIKE '%0' AND run_id NOT LIKE '%1'""")
def run_listing(spark, sf):
    """Runs fit for a history: some have no plain name, no config, or a damaged artifact."""
    rows = stored(spark, sf)
    rows = rows.withColumn("config", F.when(~F.col("run_id").endswith("1"), F.col("config"))).withColumn(
        "run_id", F.when(F.col("run_id").endswith("0"), F.concat(F.lit("."), "run_id")).otherwise(F.col("run_id")))
    return runs.run_summary(runs.listed(rows)).select("id", "company", "arm")


@query("history_shortlist", """
SELECT o_custkey AS c, o_orderkey AS id, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC,
  o_orderpriority = '1-URGENT' OR o_orderstatus <> 'P' DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3 OR c % 2 = 0""".replace("c % 2", "o_custkey % 2"))
def history_shortlist(spark, sf):
    """Runs of each customer: pinned, newest completed, then the others; three of them, or all where a search is on."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "completed_with_drops").otherwise("failed")
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), status.alias("status"),
                                            (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), F.col("o_orderdate").alias("created_at"))
    plain, searched = rows.filter("c % 2 <> 0"), rows.filter("c % 2 = 0")
    out = runs.shortlist(plain, 3, keys=("c",)).unionByName(runs.shortlist(searched, None, keys=("c",)))
    return out.select("c", "id", F.col("rank").cast("bigint").alias("rank"))


@query("newest_runs", """
SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS place FROM orders""")
def newest_runs(spark, sf):
    """All runs with their place, newest first."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return runs.newest_first(rows).select("id", "place")


@query("review_templates", "WITH " + RESULT_SQL + """,
b AS (SELECT * FROM fr WHERE accepted AND run_id NOT IN (SELECT run_id FROM r WHERE s = 'P' AND section = 'snapshot'))
SELECT run_id, 'claim' AS part, section || '.' || (k + 1) AS id, 'Order ' || k AS text FROM b
UNION ALL SELECT run_id, 'trap', t, NULL FROM (SELECT DISTINCT run_id FROM b), unnest(['prompt_injection', 'company_identity', 'source_conflict', 'stale_pledge', 'forecast_vs_result', 'scope', 'legal_management_view']) x(t)""")
def review_templates(spark, sf):
    """Unlabelled review rows for runs without a template."""
    rows = results(spark, sf)
    accepted = passes.final_results(rows, stages(rows)).filter("accepted")
    existing = rows.filter((F.col("stage") == "repair") & (F.col("section") == "snapshot")).select("run_id")
    out = runs.review_templates(accepted.withColumn("section_no", F.lit(0)), existing)
    return out.select("run_id", "part", "id", F.when(F.col("part") == "claim", F.col("text")).alias("text"))


@query("persisted_calls", "WITH " + EVENT_SQL + """
SELECT event_id, sha256('{"a":"' || k || '","model":"' || event_type || '","z":"x\\"' || v || '"}') AS request_sha256 FROM e""")
def persisted_calls(spark, sf):
    """Requests in a log replaced by the hash of their canonical JSON; credentials go first."""
    from groundwork.operators import report
    request = F.create_map(F.lit("model"), F.col("event_type"), F.lit("z"), F.concat(F.lit('x"'), F.col("v").cast("string")),
                           F.lit("Authorization"), F.lit("secret"), F.lit("a"), F.col("k").cast("string"))
    rows = events(spark, sf).select("event_id", tx.without_secret_keys(request).alias("request"))
    return report.persisted_calls(rows)


@query("masked_logs", "WITH " + EVENT_SQL + """
SELECT event_id, 'key [redacted] of ' || CASE WHEN k < 10 THEN 'public' ELSE '[redacted]' END || ' user' AS message FROM (SELECT * FROM e) WHERE k >= 10
UNION ALL SELECT event_id, 'key public of public user' FROM e WHERE k < 10""")
def masked_logs(spark, sf):
    """Known secrets masked in log messages; the public key is none."""
    secret = F.when(F.col("k") < 10, "public").otherwise(F.concat(F.lit("sk-"), "event_id"))
    rows = events(spark, sf).select("event_id", secret.alias("s"))
    return rows.select("event_id", tx.masked(F.concat(F.lit("key "), "s", F.lit(" of "), "s", F.lit(" user")), F.col("s")).alias("message"))


@query("withheld_evidence", """
WITH f AS (SELECT doc_id, source, lang, sha256(text) AS h, CASE WHEN toxic = 1 AND source IN ('src1', 'src2') THEN sha256(text || '.') ELSE sha256(text) END AS p,
  CASE WHEN source = 'src3' AND doc_id % 50 = 0 THEN 'x/' ELSE '' END || doc_id AS name FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT source, bool_and(h = p) AND NOT bool_or(name LIKE 'x/%') AND source NOT IN ('src4', 'src5') AND source <> 'src6' AS ok FROM f GROUP BY source)
SELECT doc_id, source AS run_id, ok AS available FROM f JOIN g USING (source)""")
def withheld_evidence(spark, sf):
    """Passages shown only where a run's saved files are at hand unchanged, with plain names and read by this parser."""
    docs = spread(read(spark, sf, "documents").select("doc_id", F.col("source").alias("run_id"), "text")).join(read(spark, sf, "labels"), "doc_id", "left")
    name = F.concat(F.when((F.col("run_id") == "src3") & (F.col("doc_id") % 50 == 0), "x/").otherwise(""), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", "run_id", name.alias("name"), F.sha2("text", 256).alias("sha256"), F.sha2(F.when(
        (F.col("toxic") == 1) & F.col("run_id").isin("src1", "src2"), F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("now"))
    saved = files.filter("run_id <> 'src6'").select("run_id", "name", "sha256")  # src6 saved no files
    parsers = files.select("run_id").distinct().filter("run_id <> 'src4'").withColumn("parser_sha256", F.when(F.col("run_id") == "src5", "old").otherwise("new"))
    return runs.withheld(files.select("doc_id", "run_id"), saved, files.select("run_id", "name", F.col("now").alias("sha256")), parsers, "new")


@query("run_conflicts", "WITH " + RESULT_SQL + """
SELECT run_id, 'Order ' || k AS text, 'S1' AS higher_tier_source, 'S' || k AS cited_sources FROM r WHERE cents % 13 = 0""")
def run_conflicts(spark, sf):
    """Conflicts of all passes of a run, replaced drafts included."""
    conflict = F.struct(F.lit("S1").alias("higher_tier_source"), F.array(F.concat(F.lit("S"), "idx")).alias("cited_sources"), F.lit(0.9).alias("confidence"))
    rows = results(spark, sf).withColumn("conflicts", F.when(F.col("cents") % 13 == 0, F.array(conflict)))
    return passes.conflicts(rows).withColumn("cited_sources", joined("cited_sources", ","))


@query("stored_attempts", "WITH " + EVENT_SQL + """
SELECT user_id AS run_id, CASE WHEN event_type IN ('click', 'view') THEN 'writer' ELSE 'verifier' END AS provider, count(*) FILTER (k >= 5) AS attempts, count(*) FILTER (k < 5) AS unreadable,
  count(*) FILTER (k >= 5 AND k < 40) AS failed FROM e GROUP BY 1, 2""")
def stored_attempts(spark, sf):
    """Attempt logs read from their JSON text; a broken log is counted and stops nothing."""
    log = F.concat(F.lit('[{"attempt":1,"status":"'), F.when(F.col("k") < 40, "error").otherwise("ok"), F.lit('","http_status":'), F.col("k").cast("string"),
                   F.lit(',"elapsed_s":1.5,"model":"m","other":[1]}'), F.when(F.col("k") >= 5, "]").otherwise(""))
    writes = F.col("event_type").isin("click", "view")
    files = events(spark, sf).select(F.col("user_id").alias("run_id"), writes.alias("writer"), log.alias("json"), F.lit(False).alias("too_large"))
    stored = artifacts.read(files, schemas.ATTEMPTS)
    rows = runs.attempt_rows(stored.filter("writer"), stored.filter("not writer"))
    good = rows.groupBy("run_id", "provider").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "error").alias("failed"))
    bad = stored.groupBy("run_id", F.when(F.col("writer"), "writer").otherwise("verifier").alias("provider")).agg(F.count_if("unreadable").alias("unreadable"))
    return bad.join(good, ["run_id", "provider"], "left").select("run_id", "provider", F.coalesce("attempts", F.lit(0)).alias("attempts"), "unreadable", F.coalesce("failed", F.lit(0)).alias("failed"))


@query("nested_redaction", "WITH " + EVENT_SQL + """
SELECT event_id, '{"body":{"list":[{"n":' || k || '},"[redacted] ' || event_type || '"],"model":"m"},"id":' || v || '}' AS request FROM e""")
def nested_redaction(spark, sf):
    """Nested requests without credentials at any depth, in canonical form, with known secrets masked."""
    secret = F.concat(F.lit("sk-"), "event_id")
    request = F.concat(F.lit('{"id":'), F.col("v").cast("string"), F.lit(',"headers":{"x":[1,2]},"body":{"model":"m","api_key":"'), secret, F.lit('","list":[{"n":'), F.col("k").cast("string"),
                       F.lit(',"Authorization":{"a":"b"}},"'), secret, F.lit(' '), "event_type", F.lit('"]}}'))
    rows = events(spark, sf).select("event_id", request.alias("request"), secret.alias("secret"))
    return rows.select("event_id", tx.redacted_json(F.col("request"), F.col("secret")).alias("request"))
