"""Markdown packs: files to documents, with rejects kept as rows."""

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from groundwork import fixed, session
from groundwork.functions.bind import let
from groundwork.functions.text import hidden_counts, lines, nfkc, strip, without_hidden
from groundwork.operators import ordering, segment


def scan(spark, folder):
    """Markdown files directly in pack folders; ``folder`` may be a glob such as ``packs/*``. Spark lists no file of zero bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)


def export(files, folder):
    """Write packs as a scan reads them: a folder per pack, a file per row of (pack_id, filename, content). Returns the number of files.

    Tasks write by themselves, through the store the folder's URI names, so nothing passes the driver; a task that
    runs again writes the same files again.
    """
    def written(batches):
        store, top = FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        n = 0
        for batch in batches:
            for pack_id, filename, content in zip(*(batch.column(c).to_pylist() for c in ("pack_id", "filename", "content"))):
                store.create_dir(f"{top}/{pack_id}", recursive=True)
                with store.open_output_stream(f"{top}/{pack_id}/{filename}", compression=None) as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])
    return files.select("pack_id", "filename", "content").mapInArrow(written, "files long").agg(F.sum("files")).first()[0] or 0


KNOWN = ("path", "modificationTime", "length")


def manifest(files):
    """What a later scan needs to tell which files have changed."""
    return files.select(*KNOWN, fingerprint(F.col("content")).alias("sha256"))


def changed(files, known):
    """Files of a scan that a manifest does not know with their time and length.

    The listing alone tells which; times of the new files then bound the second read, and the scan opens no
    file outside those times. Nothing is opened where nothing changed.
    """
    new = files.select(*KNOWN).join(known.select(*KNOWN), list(KNOWN), "left_anti")
    first, last = new.agg(F.min("modificationTime"), F.max("modificationTime")).first()
    if first is None:
        return files.limit(0)
    return files.filter(F.col("modificationTime").between(F.lit(first), F.lit(last))).join(known.select(*KNOWN), list(KNOWN), "left_anti")


def named(files):
    """Pack and file names from the paths of a scan."""
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("pack_id"), F.element_at(parts, -1).alias("filename"),
                        "length", "content")


def fingerprint(content):
    return F.sha2(content, 256)


def decoded(content):
    """Text of a file with plain line ends; NULL where its bytes are not UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.replace(F.regexp_replace(text, r"\A\ufeff", ""), F.lit("\r\n"), F.lit("\n"))


def _entries(block):
    """Key, value and fault of every front-matter line that is not blank or a comment."""
    used = F.filter(F.transform(lines(block), strip), lambda t: (t != "") & ~t.startswith("#"))

    def entry(t):
        key = strip(F.substring_index(t, ":", 1))
        value = strip(F.regexp_replace(t, r"(?s)\A[^:]*:?", ""))
        return F.struct(key.alias("key"), F.regexp_replace(value, r"""(?s)\A(["'])(.*)\1\z""", "$2").alias("value"),
                        (~t.contains(":") | (key == "")).alias("bad"))

    return F.transform(used, entry)


def _first_fault(entries):
    keys = F.transform(entries, lambda e: e["key"])
    faults = let(keys, lambda names: F.transform(entries, lambda e, i: F.when(
        e["bad"], "invalid front matter entry").when(
        F.array_position(names, e["key"]) <= i, F.concat(F.lit("duplicate front matter field "), e["key"]))))
    return F.get(F.array_compact(faults), 0)


def _field(entries, name):
    return F.get(F.filter(entries, lambda e: e["key"] == name), 0)["value"]


def with_front_matter(documents, text="text"):
    """Split cleaned text into the four required fields, a body, and a fault if any.

    The first fault found is kept, in the order a reader of the file meets them.
    """
    block = F.when(F.col(text).rlike(fixed.FRONT_MATTER), F.regexp_extract(F.col(text), fixed.FRONT_MATTER, 1))
    read = let(block, lambda b: let(_entries(b), lambda e: F.struct(
        F.when(b.isNull(), "missing or unterminated front matter").otherwise(_first_fault(e)).alias("_fault"),
        *[_field(e, name).alias(f"_{name}") for name in fixed.REQUIRED_FIELDS])))
    # The generator row keeps Spark from parsing once per field.
    rows = documents.select("*", F.inline(F.array(read)))
    missing = F.array_join(F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(f"_{name}"), F.lit("")) == "", name) for name in fixed.REQUIRED_FIELDS])), ", ")
    published = F.col("_published")
    day = F.when(published.rlike(fixed.ISO_DATE) & ~published.startswith("0000"), published.try_cast("date"))
    fault = F.coalesce(F.col("_fault"), F.when(missing != "", F.concat(F.lit("missing front matter fields: "), missing)),
                       F.when(day.isNull(), "published must be an ISO date"))
    body = strip(F.regexp_replace(F.col(text), fixed.FRONT_MATTER, ""))
    keep = [c for c in documents.columns if c != text]
    return rows.select(*keep, F.col("_source").alias("source"), F.col("_url").alias("url"), day.alias("published"),
                       F.lower("_type").alias("source_type"), body.alias("body"), fault.alias("fault"))


def cleaned(files):
    """Hidden content out, counted by kind; the raw body is kept beside the cleaned text."""
    rows = files.withColumn("_raw", decoded(F.col("content")))
    return rows.select(
        "pack_id", "filename", fingerprint(F.col("content")).alias("sha256"),
        strip(F.regexp_replace("_raw", fixed.FRONT_MATTER, "")).alias("raw_body"),
        hidden_counts(F.col("_raw")).alias("removals"), nfkc(without_hidden(F.col("_raw"))).alias("text"),
        F.col("_raw").isNull().alias("_no_text"))


def parsed(files):
    """Cleaned files with fields and fault; no numbering yet, so nothing is shuffled."""
    rows = with_front_matter(cleaned(files))
    return rows.withColumn("fault", F.when(F.col("_no_text"), "not UTF-8").otherwise(F.col("fault"))).drop("_no_text")


def rejects(parsed_files):
    """Files that cannot be documents, with the reason."""
    return parsed_files.filter(F.col("fault").isNotNull()).select(
        "pack_id", "filename", F.concat("filename", F.lit(": "), "fault").alias("reason"))


def tier(source_type):
    pairs = [F.lit(x) for pair in fixed.SOURCE_TIERS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[source_type], F.lit(fixed.DEFAULT_TIER))


def aged(documents, as_of):
    """Tier, age in days and warnings. ``as_of`` is a column or an ISO date."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    age = F.datediff(day, F.col("published"))
    known = F.col("source_type").isin(*fixed.SOURCE_TIERS)
    warnings = F.array_compact(F.array(
        F.when(~known, F.concat(F.lit("Unknown source type '"), "source_type", F.lit("'; defaulted to tier 3"))),
        F.when(age < 0, "Publication date is after the requested as-of date")))
    return documents.withColumns({"age_days": age, "tier": tier(F.col("source_type")), "warnings": warnings})


def numbered(documents):
    """Source ids that do not depend on file names: S1, S2, ... by date, URL and hash in each pack."""
    rows = ordering.number_rows(documents, ["pack_id"], ["published", "url", "sha256", "filename"], "_n")
    return rows.withColumn("sid", F.concat(F.lit("S"), F.col("_n").cast("string"))).drop("_n")


def documents(files, as_of):
    """Accepted documents of a scan: numbered, aged, with title and passages."""
    # Parsing costs far more than one write, and numbering reads the parsed rows twice.
    good = session.stage(parsed(files).filter(F.col("fault").isNull()).drop("fault"))
    return segment.with_outline(aged(numbered(good), as_of))


def batch_faults(uploads):
    """Upload batches that break a limit: one row per pack with the rules broken.

    ``uploads`` has pack_id, name and content; every rule is a plain aggregate.
    """
    name = F.col("name")
    bad_name = (~name.endswith(".md") | (F.length(name) > fixed.UPLOAD_LIMITS["name_chars"])
                | name.rlike(r"[/\\\x00-\x1f]"))
    size = F.octet_length("content")
    # Distinct names are counted on a grouping of their own, so no pack is gathered whole.
    per_name = uploads.groupBy("pack_id", F.lower("name").alias("_name")).agg(
        F.count("*").alias("_n"), F.sum(size).alias("_bytes"), F.max(size).alias("_largest"),
        F.max(bad_name.cast("int")).alias("_bad"))
    per_pack = per_name.groupBy("pack_id").agg(
        F.sum("_n").alias("files"), F.sum("_bytes").alias("total_bytes"), F.max("_largest").alias("largest_bytes"),
        F.max("_n").alias("_copies"), F.max("_bad").alias("_bad"))
    limits = fixed.UPLOAD_LIMITS
    rules = F.array_compact(F.array(
        F.when(F.col("_bad") == 1, "Document names must be Markdown basenames, without folders."),
        F.when((F.col("files") > limits["files"]) | (F.col("largest_bytes") > limits["file_bytes"]),
               "Document count or size exceeds the upload limits."),
        F.when(F.col("total_bytes") > limits["total_bytes"], "Documents exceed the total upload limit."),
        F.when(F.col("_copies") > 1, "Document names must be unique.")))
    return per_pack.select("pack_id", "files", "total_bytes", "largest_bytes", rules.alias("faults"))


def profiles(documents, targets):
    """Company name and business of each pack, from the first document that names its listing.

    First means lowest tier, then source id as text (S10 before S2). The choice is
    a ``min_by`` with a partial step on the map side, so pack size does not matter.
    """
    rows = documents.join(targets, "pack_id")
    marker = F.concat(F.lit(rf"(?iu)\(NSE:{fixed.SPACE}*\Q"), F.col("ticker"), F.lit(rf"\E{fixed.SPACE}*\)"))
    parts = F.split("body", marker, 2)
    rows = rows.filter(F.contains(F.lower("body"), F.lit("(nse:"))).withColumn("_parts", parts).filter(F.size("_parts") == 2)
    before, after = F.regexp_replace(F.col("_parts")[0], rf"{fixed.SPACE}+\z", ""), F.col("_parts")[1]
    piece = r"[\p{L}\p{N}_&'’.-]*"
    name = F.regexp_extract(before, rf"([A-Z]{piece}(?:[ \t]+(?:[A-Z]{piece}|of|and|the)){{0,12}})\z", 1)
    business = F.regexp_extract(
        after, rf"(?isu)\A,{fixed.SPACE}*(an?{fixed.SPACE}+.+?)(?:,{fixed.SPACE}*(?:today|has|announced|reported){fixed.END}|\.{fixed.SPACE}|\Z)", 1)
    business = F.regexp_replace(strip(business), r"\.+\z", "")
    rows = rows.select("pack_id", F.struct("tier", "sid").alias("_order"), name.alias("name"), business.alias("business"))
    chosen = rows.groupBy("pack_id").agg(F.min_by(F.struct("name", "business"), "_order").alias("_p"))
    return targets.join(chosen, "pack_id", "left").select(
        "pack_id", "ticker", F.coalesce("_p.name", F.lit("")).alias("name"),
        F.coalesce("_p.business", F.lit("")).alias("business"))
