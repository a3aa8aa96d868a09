"""Queries about files, cleaning and cutting text."""

import uuid

from pyspark.sql import functions as F

from groundwork import session
from groundwork.functions import text as tx
from groundwork.operators import ordering, passes, segment
from groundwork.plans import corpus
from groundwork.plans.corpus import BASE_SQL
from groundwork.plans.registry import joined, registry
from groundwork.sources import packs
from groundwork.sources.tables import read, spread

QUERIES, ORACLES, query = registry()

# Cut text into sentences with patterns that need no look-around: abbreviations are
# protected first, then every sentence gap becomes a mark.
SENTENCES_SQL = r"""
d AS (SELECT doc_id, source, lang, list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ' ') AS t FROM documents),
sn AS (SELECT doc_id, source, lang, list_transform(string_split(regexp_replace(regexp_replace(t,
   '((?:Mr|Ms|Mrs|Dr|No|Ltd|Rs)\.["”*]?)\s+([A-Z0-9"“*])', '\1' || chr(31) || '\2', 'g'),
   '([.!?]["”*]?)\s+([A-Z0-9"“*])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: replace(x, chr(31), ' ')) AS s FROM d)
"""


def documents(spark, sf, *columns):
    return spread(read(spark, sf, "documents").select("doc_id", "text", *columns))


@query("hidden_content", """
SELECT page_id, CAST(length(html) - length(b) AS BIGINT) AS comment_chars, CAST(length(b) - length(c) AS BIGINT) AS invisible_chars, CAST(length(c) AS BIGINT) AS chars
FROM (SELECT *, regexp_replace(b, '[\\p{Cf}\\p{Co}]', '', 'g') AS c FROM (SELECT *, regexp_replace(html, '<!--.*?(?:-->|$)', '', 'gs') AS b FROM pages))""".replace("\\\\", "\\"))
def hidden_content(spark, sf):
    """Comments and invisible characters of whole pages, removed and counted."""
    rows = spread(read(spark, sf, "pages").select("page_id", "html"))
    rows = rows.select("page_id", F.inline(F.array(F.struct(
        tx.hidden_counts(F.col("html")).alias("r"), tx.without_hidden(F.col("html")).alias("t")))))
    def count(test):
        return F.aggregate(F.filter("r", test), F.lit(0).cast("bigint"), lambda a, r: a + r["count"])
    return rows.select("page_id", count(lambda r: r["kind"] == "html_comment").alias("comment_chars"),
                       count(lambda r: r["kind"] != "html_comment").alias("invisible_chars"),
                       F.length(tx.nfkc(F.col("t"))).cast("bigint").alias("chars"))


@query("removal_totals", """
SELECT pack_id, 'html_comment' AS kind, CAST(sum(n) AS BIGINT) AS characters, CAST(count(*) AS BIGINT) AS documents FROM (
  SELECT regexp_extract(url, '^https?://([^/?#:]*)', 1) AS pack_id, length(html) - length(regexp_replace(html, '<!--.*?(?:-->|$)', '', 'gs')) AS n FROM pages)
WHERE n > 0 GROUP BY 1""")
def removal_totals(spark, sf):
    """Removed characters per site and kind."""
    rows = spread(read(spark, sf, "pages")).select(tx.host(F.col("url")).alias("pack_id"), tx.hidden_counts(F.col("html")).alias("removals"))
    return passes.removal_totals(rows)


@query("url_hosts", """
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages""")
def url_hosts(spark, sf):
    """Host of every page, behind a user name and a port and in upper case."""
    loud = F.concat(F.regexp_replace("url", "^(https?)://([^/]*).*$", "$1://me@"), F.upper(F.regexp_extract("url", "^https?://([^/?#]*)", 1)),
                    F.lit(":8080"), F.regexp_extract("url", "^https?://[^/?#]*(.*)$", 1))
    return read(spark, sf, "pages").select("page_id", tx.host(loud).alias("host"))


FILE_SQL = """
t AS (SELECT *, '# Order ' || k || ' results' || repeat(chr(10), 2) || '## Trading' || repeat(chr(10), 2) || '**Amounts in ₹ crore**' || repeat(chr(10), 2) ||
   '| Metric | Current | Change |' || chr(10) || '|---|---|---|' || chr(10) || '| Revenue | ' || cents || ' | +' || pct || '% |' || chr(10) ||
   '| Debt | ' || debt || ' | -' || pct || '% |' || repeat(chr(10), 2) || 'Revenue was Rs ' || cents || ' crore, up ' || pct || ' percent. Profit fell ' || pct || '% on ' || longdate || '.' || chr(10) AS body1,
   CASE WHEN s = 'P' THEN '<!-- note ' || k || ' -->' || chr(10) ELSE '' END AS hidden,
   chr(10) || '## Outlook' || repeat(chr(10), 2) || '- Management expects margins to improve. Promoters hold shares.' AS body2 FROM f),
w AS (SELECT *, '---' || chr(10) || 'source: "Order desk ' || s || '"' || chr(10) || 'url: ' || url || chr(10) || 'published: ' || ds || chr(10) || 'type: ' || type || chr(10) || '---' || repeat(chr(10), 2) || body1 || hidden || body2 || chr(10) AS content FROM t),
h AS (SELECT *, sha256(content) AS sha, 'S' || row_number() OVER (PARTITION BY c ORDER BY ds, url, sha256(content), k || '.md') AS sid FROM w)
"""


@query("pack_documents", "WITH " + BASE_SQL + ", " + FILE_SQL + """
SELECT pack_id, k || '.md' AS filename, sid, sha AS sha256, 'Order desk ' || s AS source, lower(type) AS source_type, CAST(tier AS BIGINT) AS tier,
  CAST(age AS BIGINT) AS age_days, 'Order ' || k || ' results' AS title, CAST(5 AS BIGINT) AS units, CAST(CASE WHEN s = 'P' THEN length(hidden) - 1 ELSE 0 END AS BIGINT) AS removed,
  CAST(length(body1 || hidden || body2) AS BIGINT) AS raw_chars, CAST(CASE WHEN p = '5-LOW' THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM h""")
def pack_documents(spark, sf):
    """Markdown files to numbered documents: hash, decode, clean, front matter, tier, age, cut."""
    docs = packs.documents(corpus.files(spark, sf), corpus.AS_OF)
    removed = F.aggregate("removals", F.lit(0).cast("bigint"), lambda a, r: a + r["count"])
    return docs.select("pack_id", "filename", "sid", "sha256", "source", "source_type", F.col("tier").cast("bigint").alias("tier"),
                       F.col("age_days").cast("bigint").alias("age_days"), "title", F.size("passages").cast("bigint").alias("units"),
                       removed.alias("removed"), F.length("raw_body").cast("bigint").alias("raw_chars"),
                       F.size("warnings").cast("bigint").alias("warnings"))


@query("file_manifest", "WITH " + BASE_SQL + ", " + FILE_SQL + "SELECT pack_id, k || '.md' AS filename, sha AS sha256 FROM h")
def file_manifest(spark, sf):
    """Hash of every file's bytes."""
    return corpus.files(spark, sf).select("pack_id", "filename", packs.fingerprint(F.col("content")).alias("sha256"))


@query("front_matter_rejects", """
SELECT o_orderkey || '.md: ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'missing or unterminated front matter'
  WHEN '2-HIGH' THEN 'duplicate front matter field url' WHEN '3-MEDIUM' THEN 'missing front matter fields: published, type'
  ELSE 'published must be an ISO date' END AS reason FROM orders WHERE o_orderpriority <> '5-LOW'""")
def front_matter_rejects(spark, sf):
    """Files with a fault in their front matter, one kind per priority."""
    p = F.col("p")
    head = F.concat(F.lit("---\nsource: x\nurl: u"), "k", F.lit("\n"))
    day = F.date_format("published", "yyyy-MM-dd")
    rest = (F.when(p == "2-HIGH", F.concat(F.lit("url: again\npublished: "), day, F.lit("\ntype: t\n---\n")))
            .when(p == "3-MEDIUM", "# no date\n---\n")
            .when(p == "4-NOT SPECIFIED", F.concat(F.lit("published: "), F.date_format("published", "yyyyMMdd"), F.lit("\ntype: t\n---\n")))
            .otherwise(F.concat(F.lit("published: '"), day, F.lit("'\ntype: t\n---\n"))))
    text = F.when(p == "1-URGENT", F.concat(F.lit("# Order "), "k")).otherwise(F.concat(head, rest, F.lit("Text of "), "k"))
    files = corpus.orders(spark, sf).select("pack_id", "filename", F.lit(0).alias("length"), text.cast("binary").alias("content"))
    return packs.rejects(packs.parsed(files)).select("reason")


@query("sentence_units", "WITH " + SENTENCES_SQL + """
SELECT doc_id, CAST(len(s) AS BIGINT) AS units, md5(array_to_string(s, chr(10))) AS digest FROM sn""")
def sentence_units(spark, sf):
    """Whole documents cut into sentences."""
    rows = segment.with_outline(documents(spark, sf), body="text")
    return rows.select("doc_id", F.size("passages").cast("bigint").alias("units"),
                       F.md5(joined(F.transform("passages", lambda u: u["text"]), "\n").cast("binary")).alias("digest"))


@query("unit_windows", "WITH " + SENTENCES_SQL + """,
u AS (SELECT doc_id, unnest(s) AS q, generate_subscripts(s, 1) AS i FROM sn),
v AS (SELECT doc_id, i, concat_ws(chr(10) || chr(10), lag(q) OVER w, q, lead(q) OVER w) AS win FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(count(*) AS BIGINT) AS units, CAST(sum(length(win)) AS BIGINT) AS chars,
   CAST(sum(ascii(substr(md5(win), 1, 1)) * i) AS BIGINT) AS checksum FROM v GROUP BY doc_id""")
def unit_windows(spark, sf):
    """Numbered units of whole documents with the window around each."""
    docs = segment.with_outline(documents(spark, sf), body="text").withColumn("sid", F.concat(F.lit("S"), "doc_id"))
    units = segment.units(docs, keep=("doc_id", "sid"), windows=True)
    return units.groupBy("doc_id").agg(
        F.count("*").alias("units"), F.sum(F.length("window")).alias("chars"),
        F.sum(F.ascii(F.substring(F.md5(F.col("window").cast("binary")), 1, 1)) * F.col("unit_no")).alias("checksum"))


@query("unit_ids", "WITH " + SENTENCES_SQL + """,
u AS (SELECT source, doc_id, unnest(s) AS q, generate_subscripts(s, 1) AS i FROM sn)
SELECT source, CAST(count(*) AS BIGINT) AS units, CAST(count(DISTINCT 'S' || doc_id || '.u' || lpad(CAST(i AS VARCHAR), CAST(greatest(2, length(CAST(i AS VARCHAR))) AS INTEGER), '0')) AS BIGINT) AS ids,
  max('S' || doc_id || '.u' || lpad(CAST(i AS VARCHAR), CAST(greatest(2, length(CAST(i AS VARCHAR))) AS INTEGER), '0')) AS last_id FROM u GROUP BY source""")
def unit_ids(spark, sf):
    """Unit ids over all sources."""
    docs = segment.with_outline(documents(spark, sf, "source"), body="text").withColumn("sid", F.concat(F.lit("S"), "doc_id"))
    units = segment.units(docs, keep=("source", "sid"))
    return units.groupBy("source").agg(F.count("*").alias("units"), F.count_distinct("uid").alias("ids"), F.max("uid").alias("last_id"))


UNIT_SQL = """
u AS (SELECT pack_id, sid, k, unnest([1, 2, 3, 4, 5]) AS i, unnest(['| Revenue | ' || cents || ' | +' || pct || '% |', '| Debt | ' || debt || ' | -' || pct || '% |',
    'Revenue was Rs ' || cents || ' crore, up ' || pct || ' percent.', 'Profit fell ' || pct || '% on ' || longdate || '.',
    '- Management expects margins to improve. Promoters hold shares.']) AS text FROM n),
q AS (SELECT *, CASE WHEN i < 5 THEN 'Trading' ELSE 'Outlook' END AS section, i <= 2 AS is_table,
    CASE WHEN i <= 2 THEN '**Amounts in ₹ crore**' || chr(10) || '| Metric | Current | Change |' || chr(10) || '|---|---|---|' || chr(10) || text ELSE text END AS quote FROM u),
x AS (SELECT *, lag(quote) OVER w AS before, lead(quote) OVER w AS after FROM q WINDOW w AS (PARTITION BY k ORDER BY i))
"""


@query("markdown_units", "WITH " + BASE_SQL + ", " + UNIT_SQL + """
SELECT pack_id, sid || '.u0' || i AS uid, section, is_table, text, md5(quote) AS quote,
  md5('Order ' || k || ' results' || repeat(chr(10), 2) || CASE WHEN is_table THEN 'Trading' || repeat(chr(10), 2) || quote
    WHEN i < 4 THEN concat_ws(repeat(chr(10), 2), 'Trading', before, quote, after)
    WHEN i = 4 THEN concat_ws(repeat(chr(10), 2), 'Trading', before, quote, 'Outlook', after)
    ELSE concat_ws(repeat(chr(10), 2), 'Trading', before, 'Outlook', quote) END) AS window_digest FROM x""")
def markdown_units(spark, sf):
    """Headings, captions, tables, sentences and bullets of one filing per order."""
    units = corpus.filing_units(corpus.filings(spark, sf), windows=True, keep=("pack_id", "sid"))
    def digest(c):
        return F.md5(F.col(c).cast("binary"))
    return units.select("pack_id", "uid", "section", "is_table", "text", digest("quote").alias("quote"), digest("window").alias("window_digest"))


@query("line_classes", "WITH " + BASE_SQL + """
SELECT cls, CAST(n * t AS BIGINT) AS lines FROM (SELECT count(*) AS n FROM n), (VALUES ('h', 3), ('t', 4), ('p', 2), ('b', 1)) v(cls, t)
UNION ALL SELECT '', CAST(count(*) * 6 + count(*) FILTER (WHERE s = 'P') AS BIGINT) FROM n""")
def line_classes(spark, sf):
    """Lines of all filings by class."""
    body = tx.without_hidden(corpus.body_text())
    rows = corpus.orders(spark, sf).select(F.explode(segment.classified(body)).alias("r"))
    return rows.groupBy(F.col("r.cls").alias("cls")).agg(F.count("*").alias("lines"))


@query("table_cells", "WITH " + BASE_SQL + """
SELECT uid, CAST(v.row AS BIGINT) AS row, CAST(v.col AS BIGINT) AS col, v.cell, 'Amounts in ₹ crore' AS caption FROM (
  SELECT sid || '.u01' AS uid, pack_id, [['Metric', 'Current', 'Change'], ['Revenue', CAST(cents AS VARCHAR), '+' || pct || '%']] AS cells FROM n
  UNION ALL SELECT sid || '.u02', pack_id, [['Metric', 'Current', 'Change'], ['Debt', CAST(debt AS VARCHAR), '-' || pct || '%']] FROM n) x,
  LATERAL (SELECT r AS row, cc AS col, cells[r + 1][cc + 1] AS cell FROM range(2) a(r), range(3) b(cc)) v""")
def table_cells(spark, sf):
    """Cells of every table passage."""
    units = corpus.filing_units(corpus.filings(spark, sf), keep=("pack_id", "sid"))
    return segment.table_cells(units).select("uid", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"),
                                             "cell", "caption")


@query("brief_word_counts", """
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents""")
def brief_word_counts(spark, sf):
    """Words before the Sources heading; each text is followed by a second copy under it."""
    doubled = F.concat("text", F.lit("\n## Sources \n"), "text")
    return documents(spark, sf).select("doc_id", tx.words_before_sources(doubled).alias("words"))


@query("source_numbers", """
SELECT doc_id, source, 'S' || row_number() OVER (PARTITION BY source ORDER BY lang, n_chars, sha256(text), doc_id) AS sid FROM documents""")
def source_numbers(spark, sf):
    """Stable source ids per pack, spread over tasks whatever the size of a pack."""
    rows = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("sha"))
    rows = ordering.number_rows(rows, ["source"], ["lang", "n_chars", "sha", "doc_id"], "n")
    return rows.select("doc_id", "source", F.concat(F.lit("S"), "n").alias("sid"))


@query("upload_batches", """
SELECT source AS pack_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, CAST(max(strlen(text)) AS BIGINT) AS largest_bytes,
  concat_ws(' | ', CASE WHEN bool_or(lang = 'fr') THEN 'Document names must be Markdown basenames, without folders.' END,
    CASE WHEN count(*) > 24 OR max(strlen(text)) > 200000 THEN 'Document count or size exceeds the upload limits.' END,
    CASE WHEN sum(strlen(text)) > 1000000 THEN 'Documents exceed the total upload limit.' END,
    CASE WHEN count(*) > count(DISTINCT CASE WHEN lang = 'de' THEN 'name.md' ELSE CAST(doc_id AS VARCHAR) END) THEN 'Document names must be unique.' END) AS faults
FROM documents GROUP BY source""")
def upload_batches(spark, sf):
    """Packs that break an upload limit; names clash for one language and are folders for another."""
    name = F.when(F.col("lang") == "fr", F.concat(F.lit("a/"), "doc_id", F.lit(".md"))).when(
        F.col("lang") == "de", F.when(F.col("doc_id") % 2 == 0, "Name.md").otherwise("name.md")).otherwise(F.concat("doc_id", F.lit(".md")))
    rows = read(spark, sf, "documents").select(F.col("source").alias("pack_id"), name.alias("name"), F.col("text").alias("content"))
    return packs.batch_faults(rows).select("pack_id", "files", "total_bytes", F.col("largest_bytes").cast("bigint").alias("largest_bytes"),
                                           joined("faults").alias("faults"))


@query("profiles", "WITH " + BASE_SQL + """
SELECT pack_id, 'CUST' || c AS ticker, 'Acme Order' || k || ' of Trade Ltd' AS name, 'a dealer in ' || cents || ' goods and services' AS business
FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tier, sid) AS r FROM n) WHERE r = 1""")
def profiles(spark, sf):
    """Company name and business per pack, from the best-ranked document that names its listing."""
    docs = corpus.filings(spark, sf, keep=("c", "cents"))
    body = F.concat(F.lit("By the board. Acme Order"), "k", F.lit(" of Trade Ltd (nse: cust"), "c", F.lit(" ), a dealer in "), "cents",
                    F.lit(" goods and services, today announced results of Example (NSE: CUST"), "c", F.lit("), a copy. End."))
    targets = docs.select("pack_id", F.concat(F.lit("CUST"), "c").alias("ticker")).distinct()
    return packs.profiles(docs.withColumn("body", body), targets)


@query("pack_scan", """
WITH f AS (SELECT 'nation-' || s_nationkey AS pack_id, s_suppkey AS k, '# ' || s_name || chr(10) || chr(10) || 'Balance of Rs ' || CAST(round(s_acctbal * 100) AS BIGINT) || '.' || chr(10) AS text FROM supplier)
SELECT pack_id, k || '.md' AS filename, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, k % 2 = 1 AS changed FROM f""")
def pack_scan(spark, sf):
    """Packs written as files and scanned again; a second scan opens only files that an older manifest has with another length."""
    text = F.concat(F.lit("# "), "s_name", F.lit("\n\nBalance of Rs "), F.round(F.col("s_acctbal") * 100).cast("bigint"), F.lit(".\n"))
    rows = read(spark, sf, "supplier").select(F.concat(F.lit("nation-"), "s_nationkey").alias("pack_id"), F.concat("s_suppkey", F.lit(".md")).alias("filename"), text.cast("binary").alias("content"))
    session.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/packs-{uuid.uuid4().hex}"
    packs.export(rows, folder)
    packs.export(rows.limit(1).select("pack_id", F.lit("notes.txt").alias("filename"), "content"), folder)  # no Markdown, so not scanned
    files = packs.scan(spark, f"{folder}/*")
    name = F.element_at(F.split("path", "/"), -1)
    odd = F.split(name, r"\.")[0].cast("bigint") % 2 == 1
    known = session.stage(packs.manifest(files)).withColumn("length", F.when(odd, F.col("length") + 1).otherwise(F.col("length")))
    new = packs.named(packs.changed(files, known)).select("pack_id", "filename", F.lit(True).alias("changed"))
    found = packs.named(files).select("pack_id", "filename", F.col("length").alias("bytes"), packs.fingerprint(F.col("content")).alias("sha256"))
    return found.join(new, ["pack_id", "filename"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
