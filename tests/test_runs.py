"""Golden rows for coverage, run metrics, reports, sinks and the stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from groundwork import schemas, session
from groundwork.functions.stats import interval_text, wilson
from groundwork.functions.text import canonical_json
from groundwork.functions.topics import figures, topics
from groundwork.operators import assembly, coverage, passes, report, runs
from groundwork.sources import artifacts
from groundwork.streaming import drop_folder

SHEET = "**Sums in lakh**\n| Item | This year | Last year | YoY |\n|---|---|---|---|\n| EBIT | 72 | 60 | +20% |"
# One sentence or more for each topic rule: a level states a sum, growth states a change, outlook speaks of what is to come.
TOPIC_CASES = {
    "| EBIT | 72 | 60 | +20% |": ["profit_level", "profit_growth"],
    SHEET: ["profit_level", "profit_growth"],
    "Earnings were Rs 72 lakh.": ["profit_level"],
    "Turnover reached Rs 810 lakh, up 9%.": ["revenue_level", "revenue_growth"],
    "Turnover rose 9%.": ["revenue_growth"],
    "Sales growth of Rs 70 lakh was seen.": ["revenue_growth"],
    "EBITDA fell 4.5% to Rs 72 lakh.": ["profit_level", "profit_growth"],
    "EBIT was Rs 72 lakh, while turnover rose 9%.": ["revenue_growth", "profit_level"],
    "The harbour board forecasts turnover growth of 6% in spring.": ["guidance_outlook"],
    "| EBIT margin | 11% | 9% | +200 bps |": ["margins"],
    "The margin fell to 11%.": ["margins"],
    "Ferry exports made 18% of turnover, up from 12%.": [],
    "Ticket numbers rose 9% to 4,100 passes.": [],
    "EBITDA could rise 8% once the new pier opens.": ["guidance_outlook"],
    "Turnover in 2025.": [],
    "**Turnover** rose `9%`. The board expects more.": ["revenue_growth", "guidance_outlook"],
    "The line sails at dawn.": [],
    "Debtor days shrank. Borrowings paid for capex. Stakes were pledged. The board gave an outlook. A fine is under investigation.": [
        "cash_collection", "debt_funding", "ownership_pledges", "guidance_outlook", "material_legal_risk"],
    "The second pier is on track to open.": ["guidance_outlook"],
    "": [],
}
FIGURE_CASES = {
    "Turnover of Rs 810 lakh in Q3FY25.": ["810"], "Rs 2,50,000.250 and -9.0": ["250000.25", "9"], "over H2FY2025 and q1fy2024-25": [],
    "By 31 MAY 2025, May 31, 2025 and 2025-05-31 it was 430.": ["430"], "from 1987 to 2150": ["2150"], "−8% or +8%": ["8"],
    # A date word has two letters at least.
    "Carried 5 x 2700 and 14 B 1600 crates": ["5", "2700", "14", "1600"], "on 14 Mb 1600 none": [],
}


def test_topics_and_figures(spark):
    rows = spark.createDataFrame(list(TOPIC_CASES.items()), "t string, want array<string>")
    assert rows.select("t", topics(F.col("t")).alias("got"), "want").filter("got <> want").collect() == []
    rows = spark.createDataFrame(list(FIGURE_CASES.items()), "t string, want array<string>")
    assert rows.select("t", figures(F.col("t")).alias("got"), "want").filter("got <> want").collect() == []


def _coverage(spark, sources, claims):
    units = spark.createDataFrame(
        [("p", s.get("sid", "S1"), i + 1, s.get("uid", "S1.u01"), s["quote"], s.get("status", "evidence"), s.get("tier", 2), s.get("age", 20))
         for i, s in enumerate(sources)],
        "pack_id string, sid string, unit_no int, uid string, quote string, status string, tier int, age_days int")
    made = spark.createDataFrame([("p", f"claim-{i}", c[0], c[1], c[2] if len(c) > 2 else None) for i, c in enumerate(claims)],
                                 "pack_id string, claim_id string, text string, cites array<string>, accepted boolean")
    packs = spark.createDataFrame([("p",)], "pack_id string")
    summary = {r.topic: r for r in coverage.topic_summary(packs, units, made).collect()}
    order = ["topic", "place", "size"]
    missing = coverage.missing_figures(units, made).orderBy(*order).collect()
    return summary, {t: [m.figure for m in missing if m.topic == t] for t in summary}


def test_partial_coverage_lists_uncited_figures(spark):
    pier = "The second pier is on track to open."
    summary, missing = _coverage(
        spark, [{"quote": "The board expects turnover growth of 6 to 8 percent in FY26."}, {"quote": pier, "uid": "S1.u02"}],
        [(pier, ["S1.u02"])])
    assert len(summary) == 10
    assert (summary["guidance_outlook"].status, missing["guidance_outlook"]) == ("partial", ["6", "8"])
    assert summary["guidance_outlook"].source_hits == 2


def test_coverage_states(spark):
    """Only admitted, present, fresh, high-tier passages count; claims that were not accepted do not."""
    docs = [{"quote": "EBIT was Rs 72 lakh.", "status": "excluded"}, {"quote": "Debt grew.", "age": -1},
            {"quote": "Stakes were sold.", "age": 500}, {"quote": "An outlook was given.", "tier": 3},
            {"quote": "A lawsuit is pending.", "age": None}, {"quote": "Turnover was 810.", "age": 365},
            {"quote": "Turnover was 810.", "sid": "S2", "uid": "S2.u03", "age": 0, "tier": 1}]
    summary, missing = _coverage(spark, docs, [("Turnover was 810.", ["S1.u01"]), ("EBIT fell 4.5%.", []), ("A fine of 3.", [], False)])
    assert {t: r.status for t, r in summary.items() if r.status != "not_found"} == {"revenue_level": "mentioned"}
    assert summary["profit_growth"].claims == 1 and missing["revenue_level"] == []
    summary, missing = _coverage(spark, [{"quote": "Turnover was Rs 810 lakh, then Rs 95 lakh."}], [("Nothing.", ["S1.u01"])])
    assert (summary["revenue_level"].status, missing["revenue_level"]) == ("review_needed", ["95", "810"])


def test_wilson(spark):
    rows = spark.createDataFrame([(5, 10), (0, 0), (3, 2), (0, 4), (4, 4)], "k long, n long")
    got = rows.select("k", "n", wilson(F.col("k"), F.col("n")).alias("w"), interval_text(F.col("k"), F.col("n")).alias("t")).collect()
    assert abs(got[0].w.low - 0.236593) < 1e-5 and abs(got[0].w.high - 0.763407) < 1e-5 and got[0].t == "5/10 [23.7%, 76.3%]"
    assert [(r.w.low, r.w.high, r.t) for r in got[1:3]] == [(None, None, "not measured")] * 2
    for r in got[3:]:
        assert 0 <= r.w.low <= r.k / r.n <= r.w.high <= 1


def test_usage_totals(spark):
    calls = spark.createDataFrame(
        [("a", 10, 5, 10, 5, 15), ("a", None, None, 7, 3, None), ("b", None, None, None, None, 14), ("c", 0, 0, None, None, 0)],
        "run_id string, prompt_tokens long, completion_tokens long, input_tokens long, output_tokens long, total_tokens long")
    tried = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 0)], "run_id string, attempts long")
    got = {r.run_id: tuple(r)[1:] for r in runs.usage_totals(calls, tried).collect()}
    assert got == {"a": (17, 8, 25, False), "b": (None, None, 14, True), "c": (0, 0, 0, False), "d": (None, None, None, False)}


def _write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_run_folders_to_metrics(spark, tmp_path):
    root = tmp_path / "runs"
    _write(root / "broken/config.json", "{")
    _write(root / "healthy/config.json", {"arm": "D", "source_manifest": {"f.py": "one"}, "ticker": "T"})
    _write(root / "healthy/checks.json", {"status": "completed", "word_count": True, "metrics": {"cited_ids_valid": {"k": 2, "n": 3}, "accepted_claims": 4}})
    _write(root / "healthy/timings-usage.json", {"elapsed_s": 1.234, "writer_attempts": 1, "usage": [{"usage": {"prompt_tokens": 1, "completion_tokens": 2}}]})
    _write(root / "plain/config.json", {"arm": "A"})
    _write(root / "plain/checks.json", {"status": "completed_unchecked", "word_count": 123, "metrics": {"numbers_matched": {"k": 7, "n": 7}}})
    _write(root / "plain/review-labels.json", {"run": "other", "reviewer": "R", "supported_sample": [{"id": "a", "text": "A.", "pass": True}]})
    tables = []
    for name, schema in artifacts.ARTIFACTS.items():
        tables.append(artifacts.read(artifacts.named(artifacts.scan(spark, str(root), name)), schema))
    rows = runs.run_artifacts(tables[0], *tables)
    got = {r.run_id: r for r in runs.metrics_rows(rows).collect()}
    assert (got["healthy"].cited_ids, got["healthy"].seconds, got["healthy"].tokens, got["healthy"].words, got["healthy"].accepted) == (
        "2/3 [20.8%, 93.9%]", "1.23", "1/2/3", "?", "4")
    assert got["plain"].numbers == "not measured" and got["plain"].words == "123" and got["plain"].version == "unknown"
    assert got["broken"].status == "unreadable artifacts" and len(got) == 3
    assert {r.run_id for r in rows.filter("notice like '%another run%'").collect()} == {"plain"}
    assert all(r.line.count("|") == 12 for r in runs.markdown_rows(runs.metrics_rows(rows)).collect())


def test_human_review(spark):
    item = lambda i, t, p: (i, t, p, "")
    rows = [("none", None, None, None, None, None), ("blank", "\t\n", "human", [], {}, None),
            ("a", None, "human", [item("a", "A claim.", True)], {}, None), ("b", "R", "model", [item("a", "A.", True)], {}, None),
            ("c", "R", "human", [item("a", "A.", True), item("a", "A.", True)], {}, None),
            ("d", "R", "human", [item("a", "A claim.", True), item("b", "B", None), item("c", "\t\n", True), item("d", "D", False)],
             {"scope": (True, ""), "unknown": (True, "")}, (2,))]
    labels = spark.createDataFrame(rows, "run_id string, reviewer string, reviewer_type string, "
                                   "supported_sample array<struct<id:string,text:string,pass:boolean,note:string>>, "
                                   "traps map<string,struct<pass:boolean,note:string>>, rounding_false_alarms struct<count:bigint>")
    got = {r.run_id: tuple(r)[1:] for r in runs.human_review(labels).collect()}
    assert got["none"] == ("pending", "pending", "pending") and got["blank"][0] == "pending (reviewer missing)"
    assert got["a"] == ("pending (reviewer missing)", "pending", "pending") and got["b"][0] == "pending (human review required)"
    assert got["c"][0].startswith("invalid") and got["d"] == ("1/2 [9.5%, 90.5%]; 2 pending", "1/1 reviewed; 6 pending", "2")


def test_canonical_json_is_sorted(spark):
    row = spark.sql("select map('b', 'x\"y', 'a', '1') m").select(canonical_json(F.col("m")).alias("j")).first()
    assert row.j == '{"a":"1","b":"x\\"y"}'


def test_brief_files_are_in_order_and_never_overwritten(spark, tmp_path):
    run = spark.createDataFrame([("r1", "T", "2026-01-01", False), ("r2", "U", "2026-01-02", True)],
                                "run_id string, ticker string, as_of string, unavailable boolean")
    claims = spark.createDataFrame([("r1", "snapshot", i, f"Fact {i} of the order book.", ["S10.u01", "S2.u01"]) for i in range(3)],
                                   "run_id string, section string, place int, text string, cites array<string>")
    docs = spark.createDataFrame([("r1", "S2", "IR", "official", "2026-01-01", "u", "evidence", "", [("html_comment", 3)])],
                                 "run_id string, sid string, source string, source_type string, published string, url string, "
                                 "status string, reason string, removals array<struct<kind:string,count:int>>")
    notices = spark.createDataFrame([("r1", "Look.", 1), ("r1", "Look.", 2)], "run_id string, notice string, place int")
    lines = report.brief_lines(run, claims, docs, notices)
    path = str(tmp_path / "briefs")
    report.write_brief(lines, path, partitions=5)
    files = sorted((tmp_path / "briefs" / "run_id=r1").glob("part-*"))
    text = "".join(f.read_text(encoding="utf-8") for f in files)
    assert text == (
        "# T research brief\n\n## Snapshot\n\n- Fact 0 of the order book. [S2] [S10]\n- Fact 1 of the order book. [S2] [S10]\n"
        "- Fact 2 of the order book. [S2] [S10]\n\n## Bull case\n\nNo verified item available.\n\n## Bear case\n\nNo verified item available.\n\n"
        "## Open questions\n\n- Look.\n\n## Sources\n\n- [S2] IR. official. Published 2026-01-01. u.\n\n"
        "**Terms used (general definitions):** Order book: orders received but not yet completed.\n\n"
        "Data handling: hidden content was removed from 1 source document(s) before writing and verification. "
        "Removal details are recorded in checks.json.\n\nAs of 2026-01-01. Not investment advice.\n\n")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        report.write_brief(lines, path)


def test_a_report_is_published_whole_or_not_at_all(spark, tmp_path):
    claims = spark.createDataFrame([("r1", "bull", 1, ["S1.u01"]), ("r2", "bear", 2, [])], "run_id string, section string, place int, cites array<string>")
    sources = spark.range(3).selectExpr("'r1' as run_id", "id", "cast(null as string) as note")
    broken = sources.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    path = str(tmp_path / "report")
    with pytest.raises(Exception, match="lost"):
        report.write_report({"claims": claims, "broken": broken, "sources": sources}, path)
    assert report.published(spark, path) is None
    with pytest.raises(FileNotFoundError):
        report.read_report(spark, path)
    report.write_report({"claims": claims, "sources": sources}, path)  # what failed left nothing in the way
    found = report.read_report(spark, path)
    assert sorted(found) == ["claims", "sources"] and found["claims"].schema.simpleString() == claims.schema.simpleString()
    assert sorted(map(tuple, found["claims"].collect())) == sorted(map(tuple, claims.collect())) and found["sources"].count() == 3
    with pytest.raises(FileExistsError):
        report.write_report({"claims": claims}, path)



def test_final_stage_falls_back_to_the_draft(spark):
    rows = spark.createDataFrame([("r", "draft", 1, "a"), ("r", "repair", 2, "b"), ("s", "draft", 1, "c")], "run_id string, stage string, stage_no int, text string")
    stages = spark.createDataFrame([("r", "draft", 1, True), ("r", "repair", 2, False), ("s", "draft", 1, True)],
                                   "run_id string, stage string, stage_no int, succeeded boolean")
    assert sorted(r.text for r in passes.final_results(rows, stages).collect()) == ["a", "c"]
    assert {(r.run_id, r.stage) for r in passes.structure_failures(
        rows.withColumns({"section": F.lit("bull"), "accepted": F.lit(True)}), stages).collect()} == {("r", "draft"), ("s", "draft")}


def test_runs_and_stages_without_claims_keep_their_rows(spark):
    results = spark.createDataFrame([("full", "draft", 1, "bull", 0, [], True, False)],
                                    "run_id string, stage string, stage_no int, section string, idx int, code_errors array<string>, accepted boolean, kind_confirmed boolean")
    every = spark.createDataFrame([("full",), ("bare",), ("out",)], "run_id string")
    stages = spark.createDataFrame([("full", "draft", 1, True), ("bare", "draft", 1, True), ("bare", "format_repair", 2, True), ("out", "draft", 1, False)],
                                   "run_id string, stage string, stage_no int, succeeded boolean")
    notices = spark.createDataFrame([("out", "Screening failed.")], "run_id string, notice string")
    final = passes.final_results(results, stages)
    got = {r.run_id: (r.n, r.cited_low, r.accepted_claims, r.system_open_questions) for r in passes.run_metrics(every, final, notices).collect()}
    assert got["bare"] == (0, None, 0, 0) and got["out"] == (0, None, 0, 1) and got["full"][0] == 1
    lost = spark.createDataFrame([("out", True)], "run_id string, unavailable boolean")
    words = spark.createDataFrame([("full", 9)], "run_id string, word_count int")
    status = {r.run_id: (r.status, len(r.warnings)) for r in passes.run_status(every, final, lost, words).collect()}
    assert status == {"full": ("incomplete", 4), "bare": ("incomplete", 5), "out": ("verification_unavailable", 5)}
    faults = spark.createDataFrame([("bare", "draft", 1, "No arrays.")], "run_id string, stage string, stage_no int, error string")
    failures = passes.structure_failures(results, stages, faults)
    assert sorted((r.run_id, r.stage, r.error[:8]) for r in failures.collect()) == [
        ("bare", "draft", "No array"), ("bare", "format_repair", "Snapshot"), ("full", "draft", "Snapshot")]
    summary = {(r.run_id, r.stage): (r.accepted, r.failed, r.repair_requested) for r in passes.stage_summary(stages, results, failures).collect()}
    assert summary == {("full", "draft"): (1, 1, 1), ("bare", "draft"): (0, 1, 0), ("bare", "format_repair"): (0, 1, 0), ("out", "draft"): (0, 0, 0)}


def test_broken_bytes_make_an_artifact_unreadable_and_size_only_a_display(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "config.json").write_bytes(b'{"arm":"B\xff"}')
    _write(tmp_path / "r2" / "config.json", {"arm": "C", "ticker": "x" * 200})
    files = artifacts.scan(spark, str(tmp_path), "config.json")
    got = {r.run_id: r.unreadable for r in artifacts.read(artifacts.named(files), schemas.CONFIG).collect()}
    assert got == {"r1": True, "r2": False}
    assert all(r.unreadable for r in artifacts.read(artifacts.named(files, most_bytes=50), schemas.CONFIG).collect())


def test_draft_schema_is_closed(spark):
    good = '{"text":"t","kind":"reported_fact","cites":["a"]}'
    cases = {
        "fine": ('{"snapshot":[%s],"bull":[],"bear":[],"open_questions":[]}' % good, []),
        "section missing": ('{"snapshot":[],"bull":[],"bear":[]}', ["Output must contain exactly the four section arrays."]),
        "no object": ("[]", ["Output must contain exactly the four section arrays."]),
        "no json": ("{", ["Output must contain exactly the four section arrays."]),
        "no list": ('{"snapshot":{},"bull":[],"bear":[],"open_questions":[]}', ["snapshot: expected an array"]),
        "extra key": ('{"snapshot":[{"text":"t","kind":"reported_fact","cites":[],"x":1}],"bull":[],"bear":[],"open_questions":[]}', ["snapshot[0]: invalid claim shape"]),
        "number cite": ('{"snapshot":[],"bull":[%s,{"text":"t","kind":"reported_fact","cites":[1]}],"bear":[],"open_questions":[]}' % good, ["bull[1]: invalid claim shape"]),
        "blank": ('{"snapshot":[],"bull":[{"text":"\\n\\t","kind":"reported_fact","cites":[]}],"bear":[null],"open_questions":[]}',
                  ["bull[0]: invalid claim shape", "bear[0]: invalid claim shape"]),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "run_id string, json string")
    got = {}
    for r in artifacts.shape_faults(rows).orderBy("run_id", "section_no", "idx").collect():
        got.setdefault(r.run_id, []).append(r.fault)
    assert got == {k: v[1] for k, v in cases.items() if v[1]}


def test_drop_folder_stream(spark, tmp_path):
    pack = tmp_path / "in" / "pack"
    body = "---\nsource: IR\nurl: u\npublished: 2026-01-10\ntype: blog post\n---\n\nText {}.\n"
    _write(pack / "a.md", body.format(1))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name, n in (("b", 2), ("c", 3)):
        drop_folder.start(drop_folder.parsed(drop_folder.stream(spark, str(pack), 1)), out, state).awaitTermination(120)
        _write(pack / f"{name}.md", body.format(n) if n == 2 else "# none")
    drop_folder.start(drop_folder.parsed(drop_folder.stream(spark, str(pack), 1)), out, state).awaitTermination(120)
    rows = {r.filename: (r.body, r.fault) for r in spark.read.parquet(out).collect()}
    assert rows["a.md"] == ("Text 1.", None) and rows["b.md"] == ("Text 2.", None) and rows["c.md"][1].startswith("missing")


def test_stage_keeps_rows_and_names_its_folder(spark):
    rows = session.stage(spark.range(10).withColumn("a", F.array(F.struct("id"))))
    assert rows.count() == 10 and Path(spark.sparkContext.getCheckpointDir()).name in rows.inputFiles()[0]
    assert schemas.FILES.startswith("path")


def test_report_parts_are_bounded_and_in_order(spark):
    """A run of thousands of entries comes in parts of a fixed size; no part is larger, none is lost."""
    many = spark.range(2500).select(F.when(F.col("id") % 5 == 0, "small").otherwise("large").alias("run_id"), (2500 - F.col("id")).alias("at"), F.concat(F.lit("w"), "id").alias("warning"))
    few = spark.createDataFrame([("small", "completed"), ("empty", None)], "run_id string, status string")
    found = assembly.parts({"warnings": (many, ["at"], "warning"), "run": (few, [], "status")}, 300).collect()
    sizes = {(r.run_id, r.part, r.chunk): r.entries for r in found}
    assert sizes == {**{("large", "warnings", k): 300 for k in range(6)}, ("large", "warnings", 6): 200, ("small", "warnings", 0): 300, ("small", "warnings", 1): 200,
                     ("small", "run", 0): 1, ("empty", "run", 0): 1}
    first = next(r for r in found if (r.run_id, r.part, r.chunk) == ("large", "warnings", 0))
    assert first.labels[:2] == ["w2499", "w2498"] and json.loads(first.items[0]) == {"at": 1, "warning": "w2499"}


def test_long_notes_go_on_in_parts(spark):
    summary = spark.createDataFrame([("p", "margins", "partial", 2), ("p", "debt_funding", "not_found", 1), ("p", "cash_collection", "mentioned", 3), ("p", "revenue_level", "review_needed", 0)],
                                    "pack_id string, topic string, status string, claims int")
    missing = spark.createDataFrame([("p", "margins", str(k), (1, k, float(k), str(k)), float(k)) for k in range(7)],
                                    "pack_id string, topic string, figure string, place struct<n:int,u:int,v:double,f:string>, size double")
    found = {(r.topic, r.part): r.note for r in coverage.notes(summary, missing, 3).collect()}
    assert "".join(found["margins", k] for k in range(3)) == (
        "Figures to review in uncited passages: 0, 1, 2, 3, 4, 5, 6. These numeric tokens did not match accepted claim text; compare their meaning and units.")
    assert found["debt_funding", 0].endswith(" Brief wording did match, so inspect its evidence separately.")
    assert found["cash_collection", 0].startswith("Wording matched in source text and the brief.") and found["revenue_level", 0].startswith("Source wording matched")
    assert len(found) == 6
