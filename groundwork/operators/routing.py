"""Which documents may serve as evidence."""

from pyspark.sql import functions as F

from groundwork import fixed
from groundwork.functions.text import exchange_marker, host, whole_token


def hard_identifiers(documents, targets):
    """Documents with ``hard_identifier``: the ticker in body or URL, or a host the issuer uses.

    Issuer hosts come from documents of the pack that carry the exchange marker and
    are not from the future. They are made distinct per (pack, host) before the join.
    """
    rows = documents.join(targets.select("pack_id", "ticker"), "pack_id", "left").withColumn("_host", host(F.col("url")))
    present = F.col("age_days") >= 0
    anchors = rows.filter(present & F.col("_host").isNotNull() & exchange_marker(F.col("body"), F.col("ticker")))
    hosts = anchors.select("pack_id", "_host").distinct().withColumn("_issuer", F.lit(True))
    rows = rows.join(hosts, ["pack_id", "_host"], "left")
    token = whole_token(F.col("body"), F.col("ticker")) | whole_token(F.col("url"), F.col("ticker"))
    found = F.when(present, F.when(token, "ticker").when(F.col("_issuer"), "issuer_host"))
    return rows.select(*[F.col(c) for c in documents.columns], found.alias("hard_identifier"))


def document_answers(verdicts):
    """Answers about documents, one row each: (pack_id, sid, promotional, ai_directed, raw_ai_directed, same_company).

    A question asked more than once keeps its first answer (least ``asked_no``).
    """
    def answer(question, form, column):
        return F.min(F.when((F.col("question") == question) & (F.col("form") == form), F.struct("asked_no", column)))[column]
    return verdicts.groupBy("pack_id", "sid").agg(
        answer("promotional_stock_tip", "clean", "noul").alias("promotional"),
        answer("addresses_ai_tools", "clean", "noul").alias("ai_directed"),
        answer("addresses_ai_tools", "raw", "noul").alias("raw_ai_directed"),
        answer("same_company", "clean", "score").alias("same_company"))


def route(documents, answers=None, thresholds=fixed.THRESHOLDS):
    """Documents with ``status`` (evidence, unclear, excluded), ``reason`` and the screening notes.

    Precedence: future date, failed screening, exclusion by content, hard identifier,
    company score. Without ``answers`` nothing was screened and present documents pass.
    """
    hard, future = F.col("hard_identifier"), F.col("age_days") < 0
    if answers is None:
        reason = (F.when(future, "Published after the requested as-of date")
                  .when(hard.isNotNull(), F.concat(F.lit("Company matched by "), hard, F.lit("; semantic screening not run")))
                  .otherwise("Entity not checked; semantic screening not run"))
        return documents.withColumns({"status": F.when(future, "excluded").otherwise("evidence"), "reason": reason})

    rows = documents.join(answers, ["pack_id", "sid"], "left")
    removed = F.size("removals") > 0
    raw = F.when(removed, F.col("raw_ai_directed")).otherwise(F.col("ai_directed"))
    answered = (F.col("promotional").isNotNull() & F.col("ai_directed").isNotNull() & raw.isNotNull()
                & (hard.isNotNull() | F.col("same_company").isNotNull()))
    exclusions = F.concat_ws(
        "; ", F.when(F.col("promotional") >= thresholds["promotional"], "Promotional stock-tip content"),
        F.when(F.col("ai_directed") >= thresholds["ai_directed"],
               "AI-directed instructions remain after hidden-content removal"))
    score = F.col("same_company")
    status = (F.when(future, "excluded").when(~answered, "unclear").when(exclusions != "", "excluded")
              .when(hard.isNotNull(), "evidence").when(score < thresholds["same_company_low"], "excluded")
              .when(score <= thresholds["same_company_high"], "unclear").otherwise("evidence"))
    reason = (F.when(future, "Published after the requested as-of date").when(~answered, "Document screening unavailable")
              .when(exclusions != "", exclusions)
              .when(hard.isNotNull(), F.concat(F.lit("Company matched by "), hard, F.lit("; document screening passed")))
              .when(score < thresholds["same_company_low"], "Different company or business")
              .when(score <= thresholds["same_company_high"], "Company identity could not be confirmed")
              .otherwise("Company identity and document screening passed"))
    return rows.select(*[F.col(c) for c in documents.columns], status.alias("status"), reason.alias("reason"),
                       F.when(~future, raw).alias("raw_ai_directed"), (~removed).alias("raw_screen_reused"),
                       (~future & ~answered).alias("screening_unavailable"))


def payload(documents):
    """What a writer is given: admitted documents with their passages, the others by name and reason."""
    admitted = documents.filter(F.col("status") == "evidence").select(
        "pack_id", "sid", "source", "url", "source_type", "tier", "published", "age_days", "title", "passages")
    excluded = documents.filter(F.col("status") != "evidence").select("pack_id", "filename", "reason")
    return admitted, excluded


def notices(documents):
    """One line per source whose company could not be confirmed, and one per pack without evidence."""
    unclear = documents.filter(F.col("status") == "unclear").select("pack_id", F.format_string(
        "Could not confirm whether source %s concerns this company: %s.", "sid", "reason").alias("notice"))
    empty = documents.groupBy("pack_id").agg(F.max((F.col("status") == "evidence").cast("int")).alias("_any"))
    empty = empty.filter(F.col("_any") == 0).select("pack_id", F.lit(
        "No documents were admitted as evidence; the company brief could not be verified.").alias("notice"))
    return unclear.unionByName(empty)
