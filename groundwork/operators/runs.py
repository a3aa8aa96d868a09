"""Saved runs: their artifacts joined, and the figures reported about them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwork import fixed, schemas
from groundwork.functions.stats import count_or_null, interval_text
from groundwork.functions.text import safe_code, strip
from groundwork.operators import ordering
from groundwork.sources.artifacts import valid_runs


def run_artifacts(runs, config, checks, timings, labels):
    """One row per run folder with its artifacts; a missing file leaves NULL.

    Labels that name another run are set aside and noted. Each input: run_id, value,
    unreadable.
    """
    rows = runs.select("run_id")
    for name, table in (("config", config), ("checks", checks), ("timings", timings), ("labels", labels)):
        rows = rows.join(table.select("run_id", F.col("value").alias(name), F.col("unreadable").alias(f"_{name}")), "run_id", "left")
    foreign = F.col("labels").isNotNull() & ~F.coalesce(F.col("labels.run") == F.col("run_id"), F.lit(False))
    broken = F.coalesce("_config", F.lit(False)) | F.coalesce("_checks", F.lit(False)) | F.coalesce(
        "_timings", F.lit(False)) | F.coalesce("_labels", F.lit(False))
    damaged = F.coalesce("_config", F.lit(False)) | F.coalesce("_checks", F.lit(False)) | F.coalesce("_timings", F.lit(False))
    notice = (F.when(broken, F.concat("run_id", F.lit(": an artifact could not be summarized; inspect that run's JSON files.")))
              .when(foreign, F.concat("run_id", F.lit(": review labels name another run and were ignored."))))
    return rows.select("run_id", "config", "checks", "timings", F.when(~foreign, F.col("labels")).alias("labels"),
                       broken.alias("unreadable"), damaged.alias("damaged"), notice.alias("notice"))


def _tokens(call):
    """Input, output and total of a call, each under the first alias it reports."""
    incoming = F.coalesce(count_or_null(call("prompt_tokens")), count_or_null(call("input_tokens")))
    outgoing = F.coalesce(count_or_null(call("completion_tokens")), count_or_null(call("output_tokens")))
    return incoming, outgoing, F.coalesce(count_or_null(call("total_tokens")), incoming + outgoing)


def usage_text(calls, attempts):
    """The totals of ``usage_totals`` for calls kept as an array of a run's row, as text; nothing is exploded or joined."""
    calls = F.coalesce(calls, F.expr(f"cast(array() as array<{schemas.USAGE}>)"))
    read = F.transform(calls, lambda c: F.struct(*[x.alias(n) for n, x in zip(("i", "o", "t"), _tokens(lambda name: c[name]))]))

    def sum_of(name):
        known = F.filter(F.transform("_read", lambda r: r[name]), lambda v: v.isNotNull())
        return F.size(known), F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, v: a + v))
    parts = [sum_of(name) for name in ("i", "o", "t")]
    seen = F.least(*[n for n, _ in parts])
    partial = (F.size("_read") > 0) & (seen < F.greatest(F.size("_read"), attempts))
    return read, token_text(*[total for _, total in parts], partial)


def usage_totals(calls, attempts):
    """Token totals per run; each call counts once, under the first alias it reports.

    ``calls``: run_id and the five token columns. ``attempts``: run_id, attempts.
    A total nothing reported stays NULL; ``partial`` marks runs with unreported calls.
    """
    incoming, outgoing, total = _tokens(F.col)
    rows = calls.select("run_id", incoming.alias("input"), outgoing.alias("output"), total.alias("total"))
    sums = rows.groupBy("run_id").agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("total").alias("total"),
        F.count("*").alias("_n"), F.least(F.count("input"), F.count("output"), F.count("total")).alias("_seen"))
    rows = attempts.select("run_id", "attempts").join(sums, "run_id", "full_outer")
    calls_n, tried = F.coalesce("_n", F.lit(0)), F.coalesce(count_or_null(F.col("attempts")), F.lit(0))
    return rows.select("run_id", "input", "output", "total",
                       ((calls_n > 0) & (F.col("_seen") < F.greatest(calls_n, tried))).alias("partial"))


def token_text(input, output, total, partial):
    shown = [F.coalesce(c.cast("string"), F.lit("?")) for c in (input, output, total)]
    return F.concat(F.concat_ws("/", *shown), F.when(partial, " (partial)").otherwise(""))


def version_of(manifest):
    """First 12 hex digits of the hash of a manifest's sorted (path, hash) entries; NULL stays unknown."""
    entries = F.array_sort(F.map_entries(manifest))
    return F.when(manifest.isNull() | (F.size(manifest) == 0), "unknown").otherwise(
        F.substring(F.sha2(F.to_json(entries), 256), 1, 12))


def version_counts(runs):
    """Runs per source version and design; a run without checks or design is unfinished.

    ``runs``: version, arm, status.
    """
    finished = F.col("status").isNotNull() & F.col("arm").isin(*fixed.ARMS)
    rows = runs.withColumn("_arm", F.when(F.coalesce(finished, F.lit(False)), F.col("arm")).otherwise("unfinished"))
    counted = rows.groupBy("version").pivot("_arm", [*fixed.ARMS, "unfinished"]).count()
    return counted.na.fill(0, [*fixed.ARMS, "unfinished"])


def human_review(labels):
    """Supported-sample ratio, trap score and rounding count per run, from human labels only.

    ``labels``: run_id and the stored fields. Ids must be present and unique; only
    real booleans on items with text count as reviewed.
    """
    sample = F.coalesce("supported_sample", F.expr(
        "cast(array() as array<struct<id:string,text:string,pass:boolean,note:string>>)"))
    ids = F.transform(sample, lambda i: i["id"])
    clean = (F.size(F.filter(ids, lambda i: i.isNotNull() & (i != ""))) == F.size(sample)) & (
        F.size(F.array_distinct(ids)) == F.size(sample))
    judged = F.filter(sample, lambda i: i["pass"].isNotNull() & (strip(F.coalesce(i["text"], F.lit(""))) != ""))
    n, k = F.size(judged).cast("bigint"), F.size(F.filter(judged, lambda i: i["pass"])).cast("bigint")
    open_n = F.size(sample) - n
    support = F.concat(F.when(n > 0, interval_text(k, n)).otherwise("pending"),
                       F.when(open_n > 0, F.format_string("; %d pending", open_n)).otherwise(""))
    passes = F.array_compact(F.array(*[F.element_at("traps", F.lit(t))["pass"] for t in fixed.TRAPS]))
    reviewed = F.size(passes)
    traps = F.when(reviewed > 0, F.format_string(
        "%d/%d reviewed; %d pending", F.size(F.filter(passes, lambda p: p)), reviewed,
        F.lit(len(fixed.TRAPS)) - reviewed)).otherwise("pending")
    rounding = F.coalesce(count_or_null(F.col("rounding_false_alarms.count")).cast("string"), F.lit("pending"))
    named = strip(F.coalesce("reviewer", F.lit(""))) != ""
    stored = F.coalesce("reviewer", "reviewer_type").isNotNull() | F.col("supported_sample").isNotNull() | F.col("traps").isNotNull()
    human = F.coalesce(F.col("reviewer_type") == "human", F.lit(False))
    usable = named & human & clean
    return labels.select(
        "run_id", F.when(~stored, "pending").when(~named, "pending (reviewer missing)").when(~human, "pending (human review required)")
        .when(~clean, "invalid duplicate/missing sample IDs").otherwise(support).alias("support"),
        F.when(usable, traps).otherwise("pending").alias("traps"),
        F.when(usable, rounding).otherwise("pending").alias("rounding"))


def metrics_rows(artifacts):
    """The eleven columns reported per run; an unreadable run stays visible."""
    def tries(name):
        return F.coalesce(count_or_null(F.col(f"timings.{name}")), F.lit(0))
    read, tokens = usage_text(F.transform("timings.usage", lambda u: u["usage"]), tries("writer_attempts") + tries("jev_attempts"))
    rows = artifacts.withColumn("_read", read).withColumn("tokens", tokens)
    checked = F.coalesce(F.col("config.arm"), F.lit("")) != "A"
    def ratio(name):
        return interval_text(F.when(checked, F.col(f"checks.metrics.{name}.k")), F.when(checked, F.col(f"checks.metrics.{name}.n")))
    def number(name):
        return F.coalesce(F.when(checked, F.col(f"checks.metrics.{name}")).cast("string"), F.lit("not measured"))
    bad = F.col("unreadable")
    def shown(column, otherwise="not measured"):
        return F.when(bad, otherwise).otherwise(column)
    return rows.select(
        "run_id", shown(F.coalesce("config.arm", F.lit("?")), "?").alias("arm"),
        shown(version_of(F.col("config.source_manifest")), "unknown").alias("version"),
        shown(F.coalesce("checks.status", F.lit("missing checks")), "unreadable artifacts").alias("status"),
        shown(ratio("cited_ids_valid")).alias("cited_ids"), shown(ratio("numbers_matched")).alias("numbers"),
        shown(number("accepted_claims")).alias("accepted"), shown(number("dropped_claims")).alias("dropped"),
        shown(F.coalesce(F.col("checks.word_count").cast("string"), F.lit("?"))).alias("words"),
        shown(F.coalesce(F.format_string("%.2f", F.col("timings.elapsed_s")), F.lit("?"))).alias("seconds"),
        shown(F.col("tokens")).alias("tokens"))


def markdown_rows(table):
    """A table as Markdown rows, with pipes and line ends escaped in every cell."""
    cells = [F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"[\n\r]", " ")
             for c in table.columns]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def review_templates(accepted, existing):
    """Unlabelled review rows for runs that have no template yet: accepted claims, then traps.

    ``accepted``: run_id, section_no, section, idx, text. ``existing``: run_id.
    """
    todo = accepted.join(existing.select("run_id").distinct(), "run_id", "left_anti")
    claims = todo.select("run_id", F.lit("claim").alias("part"), F.concat(
        "section", F.lit("."), (F.col("idx") + 1).cast("string")).alias("id"), "text")
    traps = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("text")) for k, v in fixed.TRAPS.items()])
    rows = todo.select("run_id").distinct().select("run_id", F.explode(traps).alias("_t"))
    return claims.unionByName(rows.select("run_id", F.lit("trap").alias("part"), "_t.id", "_t.text")).withColumns(
        {"pass": F.lit(None).cast("boolean"), "note": F.lit("")})


def attempt_rows(writer, verifier):
    """Attempts of both providers as one table, reduced to the fields that may be shown."""
    def rows(table, provider):
        exploded = table.select("run_id", F.explode("value").alias("_a")).select("run_id", "_a.*")
        return exploded.withColumn("provider", F.lit(provider)).withColumn(
            "provider_error_code", safe_code(F.col("provider_error_code")))
    return rows(writer, "writer").unionByName(rows(verifier, "verifier")).select(
        "run_id", "provider", "status", "model", "requested_model", *fixed.ATTEMPT_FIELDS)


def transport_errors(attempts):
    return attempts.filter(F.col("status") == "error").select("run_id", "provider", *fixed.ATTEMPT_FIELDS)


def attempt_summary(attempts):
    """Attempts, waits and elapsed time by provider, status and retry reason."""
    return attempts.groupBy("provider", "status", "retry_reason").agg(
        F.count("*").alias("attempts"), F.sum("retry_delay_s").alias("waited_s"), F.sum("elapsed_s").alias("elapsed_s"))


def returned_models(attempts):
    """Distinct model ids each provider returned per run."""
    return attempts.filter(F.col("model").isNotNull()).groupBy("run_id", "provider").agg(
        F.array_sort(F.collect_set("model")).alias("models"))


def withheld(evidence, saved, present, parsers, parser_hash):
    """Evidence rows with ``available``: only where the run's saved files are the files at hand, read by the same parser.

    ``evidence``: run_id and any columns. ``parsers``: (run_id, parser_sha256) as saved.
    A run without saved files, with a saved name that is a path, or read by another
    parser (or an unknown one) shows no evidence.
    """
    same = manifest_identity(saved, present).select("run_id", "evidence_available")
    names = saved.groupBy("run_id").agg(F.count(F.lit(1)).alias("_saved"), F.bool_or(F.col("name").rlike(r"[/\\\\]|^\.{0,2}$")).alias("_path"))
    checks = names.join(same, "run_id").join(parsers.groupBy("run_id").agg(F.min("parser_sha256").alias("_parser")), "run_id", "left")
    good = F.col("evidence_available") & ~F.col("_path") & F.coalesce(F.col("_parser") == parser_hash, F.lit(False))
    return evidence.join(checks.select("run_id", good.alias("_good")), "run_id", "left").withColumn(
        "available", F.coalesce("_good", F.lit(False))).drop("_good")


def manifest_identity(saved, present):
    """Whether each run's saved files are the files at hand: same names, same hashes.

    A full outer join keeps names that only one side has; one mismatch withholds the run's evidence.
    """
    left = saved.select("run_id", "name", F.col("sha256").alias("_saved"))
    right = present.select("run_id", "name", F.col("sha256").alias("_present"))
    rows = left.join(right, ["run_id", "name"], "full_outer")
    return rows.groupBy("run_id").agg(
        F.count("*").alias("files"), F.count_if(~F.col("_saved").eqNullSafe(F.col("_present"))).alias("different"),
        F.bool_and(F.col("_saved").eqNullSafe(F.col("_present"))).alias("evidence_available"))


def run_summary(artifacts):
    """What a list of runs shows of each."""
    claims = sum((F.coalesce(F.size(F.col(f"checks.accepted.{s}")), F.lit(0)) for s in fixed.SECTIONS), F.lit(0))
    ticker = F.coalesce("config.ticker", F.lit(""))
    verifier = F.coalesce("config.jev_requested_model", F.when(F.col("config.arm") == "C", F.col("config.writer_requested_model")))
    return artifacts.select(
        F.col("run_id").alias("id"), ticker.alias("ticker"),
        F.coalesce(F.nullif(F.col("checks.profile.name"), F.lit("")), ticker).alias("company"),
        F.coalesce("config.as_of", F.lit("")).alias("as_of"), F.coalesce("checks.status", F.lit("incomplete")).alias("status"),
        F.col("checks.word_count").alias("word_count"), claims.cast("bigint").alias("claims_count"),
        F.col("timings.elapsed_s").alias("elapsed_s"), F.col("config.arm").alias("arm"),
        F.col("config.writer_requested_model").alias("writer_model"), verifier.alias("verifier_model"))


def listed(artifacts):
    """Runs that a history shows: a plain folder name, a config, and no damaged artifact among those it reads."""
    return valid_runs(artifacts).filter(F.col("config").isNotNull() & ~F.col("damaged"))


def newest_first(runs):
    """All runs with their ``place``, newest first; equal times go by id, highest first.

    Places come from range partitions and their sizes, so no task sorts all runs.
    """
    keyed = runs.withColumns({"_all": F.lit(0), "_t": -F.unix_micros(F.col("created_at").cast("timestamp")), "_i": -F.col("id")})
    return ordering.number_rows(keyed, ["_all"], ["_t", "_i"], "place").drop("_all", "_t", "_i")


def search(runs, text):
    """Runs whose id, company or ticker contains the text, in any case."""
    q = text.strip().lower()
    fields = [F.lower(F.coalesce(c, F.lit(""))).contains(q) for c in ("id", "company", "ticker")]
    return runs.filter(fields[0] | fields[1] | fields[2])


def shortlist(runs, n, keys=()):
    """Pinned runs, then completed ones, then the others, each newest first; the first ``n`` overall or per key.

    ``runs`` needs pinned and created_at. With a limit Spark keeps only ``n`` rows per
    task before anything is moved; a search shows all its matches (``n`` is None).
    """
    done = F.col("status").isin("completed", "completed_with_drops")
    order = [F.desc("pinned"), F.desc(F.col("pinned") | done), F.desc("created_at"), F.desc("id")]
    if not keys:
        rows = runs.orderBy(*order)
        return rows if n is None else rows.limit(n)
    ranked = runs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)
