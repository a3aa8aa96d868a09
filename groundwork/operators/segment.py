"""Documents to citeable units.

A document is one row and stays one row until its units are ready: cutting text moves
no data between tasks and a long document costs time in proportion to its length.
Blocks, sections, sentences and neighbour windows are read in Arrow batches and come back
as array columns, since array functions would be interpreted element by element.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork import fixed
from groundwork.functions.text import compiled, lines, strip

_UNIT = T.StructType().add("text", "string").add("quote", "string").add("section", "string").add("is_table", "boolean")
_OUTLINE = T.StructType().add("title", "string").add("units", T.ArrayType(_UNIT))
_TABLE = T.StructType().add("caption", "string").add("cells", T.ArrayType(T.ArrayType(T.StringType())))

_HEADING, _BULLET, _RULE = compiled(fixed.HEADING), compiled(fixed.BULLET), compiled(fixed.TABLE_RULE)
_ABBREVIATED = "|".join(map(re.escape, fixed.ABBREVIATIONS))
# Whitespace after an abbreviation never ends a sentence; it becomes one space. A gap is tested from its
# first blank on, so that places without one are passed over in one scan.
_NO_GAP = re.compile(rf'((?:{_ABBREVIATED})["”*]?){fixed.SPACE}+(?=[A-Z0-9"“*])')
_GAP = re.compile(
    fixed.SPACE + rf'(?:(?<=[.!?]{fixed.SPACE})|(?<=[.!?]["”*]{fixed.SPACE}))'
    + "".join(rf'(?<!{re.escape(a)}{fixed.SPACE})(?<!{re.escape(a)}["”*]{fixed.SPACE})' for a in fixed.ABBREVIATIONS)
    + rf'{fixed.SPACE}*(?=[A-Z0-9"“*])')


def _sentences(paragraph):
    if any(a in paragraph for a in fixed.ABBREVIATIONS):
        paragraph = _NO_GAP.sub(r"\1 ", paragraph)
    return _GAP.split(paragraph)


@F.arrow_udf(T.ArrayType(T.StringType()))
def sentences(paragraphs: pa.Array) -> pa.Array:
    """The sentences of a paragraph; its line ends are blanks."""
    return pa.array([None if p is None else _sentences(p.replace("\n", " ")) for p in paragraphs.to_pylist()], pa.list_(pa.string()))


def line_class(line):
    """h(eading), t(able), b(ullet), p(aragraph) or '' of one stripped line."""
    return (F.when(line == "", "").when(line.startswith("#") & line.rlike(fixed.HEADING), "h").when(line.startswith("|"), "t")
            .when(line.rlike(fixed.BULLET), "b").otherwise("p"))


def classified(body):
    return F.transform(F.transform(lines(body), strip), lambda t: F.struct(line_class(t).alias("cls"), t.alias("line")))


def _class(line):
    """``line_class`` of one line that is not empty."""
    first = line[0]
    if first == "|":
        return "t"
    if first == "#":
        return "h" if _HEADING.match(line) else "p"
    # No letter begins a bullet, and most lines begin with one.
    return "p" if first.isalpha() or not _BULLET.match(line) else "b"


def _blocks(body):
    """Runs of table or paragraph lines, single headings and bullets, in order, as (class, lines)."""
    out, run, before = [], None, ""
    for line in body.splitlines():
        line = line.strip(fixed.SPACE_CHARS)
        if not line:
            before = ""
            continue
        cls = _class(line)
        if cls == before and cls in "tp":
            run.append(line)
        else:
            run = [line]
            out.append((cls, run))
        before = cls
    return out


def _is_rule(line):
    return "---" in line and _RULE.match(line) is not None


def _outline_into(body, texts, quotes, sections, tables):
    """Append the units of a body to the four columns and return its title.

    Each unit stands under the latest heading that is not the title. A unit is made per table row; its
    quote repeats the caption and, above a rule, the header. A bold line right before a table is its caption and no unit of its own.
    """
    blocks = _blocks(body)
    title, section, caption, last = None, "", "", len(blocks) - 1
    for at, (cls, rows) in enumerate(blocks):
        first = rows[0]
        if cls == "h":
            marks, text = _HEADING.match(first).groups()
            if title is None and len(marks) == 1:
                title = text
            else:
                section = text
            caption = ""
            continue
        if cls == "t":
            head = f"{caption}\n" if caption else ""
            if len(rows) > 1 and _is_rule(rows[1]):
                head, rows = f"{head}{first}\n{rows[1]}\n", rows[2:]
            found = [row for row in rows if not _is_rule(row)]
            quotes += [head + row for row in found] if head else found
        elif cls == "p" and len(rows) == 1 and first.startswith("**") and first.endswith("**") and at < last and blocks[at + 1][0] == "t":
            caption = first
            continue
        else:
            found = rows if cls == "b" else _sentences(" ".join(rows))
            quotes += found
        texts += found
        sections += [section] * len(found)
        tables += [cls == "t"] * len(found)
        caption = ""
    return title or ""


@F.arrow_udf(_OUTLINE)
def outline(bodies: pa.Array) -> pa.Array:
    """(title, units) of a document body, as one struct column."""
    titles, offsets, columns = [], [], ([], [], [], [])
    for body in bodies.to_pylist():
        # A NULL offset makes a NULL list.
        offsets.append(None if body is None else len(columns[0]))
        titles.append("" if body is None else _outline_into(body, *columns))
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
    units = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["text", "quote", "section", "is_table"])
    lists = pa.ListArray.from_arrays(pa.array([*offsets, len(columns[0])], pa.int32()), units)
    return pa.StructArray.from_arrays([pa.array(titles, pa.string()), lists], ["title", "units"])


def _window(near, at, title):
    """Title and neighbours; a section name goes in where it changes. Tables stand alone. ``near[at]`` is the unit itself."""
    parts = [title] if title else []
    quote, section, is_table = near[at]
    if is_table:
        return "\n\n".join([*parts, *(t for t in (section, quote) if t)])
    before = None
    for quote, section, _ in near:
        if section and section != before:
            parts.append(section)
        parts.append(quote)
        before = section
    return "\n\n".join(parts)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _windows(titles: pa.Array, quotes: pa.Array, sections: pa.Array, tables: pa.Array) -> pa.Array:
    out = []
    for title, *columns in zip(*(x.to_pylist() for x in (titles, quotes, sections, tables))):
        units = list(zip(*columns)) if columns[0] is not None else []
        out.append([_window(units[max(i - 1, 0):i + 2], min(i, 1), title) for i in range(len(units))])
    return pa.array(out, pa.list_(pa.string()))


def with_outline(documents, body="body"):
    """Add ``title`` and ``passages`` (array of units) to documents."""
    rows = documents.withColumn("_outline", outline(F.col(body)))
    return rows.select(*documents.columns, F.col("_outline.title").alias("title"), F.col("_outline.units").alias("passages"))


def units(documents, keep=("pack_id", "sid"), windows=False):
    """One row per unit, numbered in document order: ``uid`` is ``S3.u07``.

    ``documents`` needs ``sid``, ``title`` and ``passages``. Windows repeat each
    quote up to three times, so they are only made on request.
    """
    # Only what is kept goes along; windows are a second array, zipped with the units.
    rows = documents.select(*dict.fromkeys((*keep, "sid", "title", "passages")))
    passages = F.col("passages")
    if windows:
        rows = rows.withColumn("_windows", _windows(F.col("title"), passages["quote"], passages["section"], passages["is_table"]))
        passages = F.arrays_zip("passages", "_windows")
    rows = rows.select(*keep, F.posexplode(passages).alias("_at", "_u"))
    number = (F.col("_at") + 1).cast("int")
    # Two digits at least; a formatter would cost more than cutting the text.
    uid = F.concat("sid", F.when(number < 10, ".u0").otherwise(".u"), number.cast("string"))
    unit = "_u.passages" if windows else "_u"
    columns = [F.col(f"{unit}.{c}").alias(c) for c in ("text", "quote", "section", "is_table")]
    if windows:
        columns.append(F.col("_u._windows").alias("window"))
    return rows.select(*keep, number.alias("unit_no"), uid.alias("uid"), *columns)


_CELL_RULE = re.compile(r":?-{3,}:?\Z")


def _cells(line):
    return [c.strip(fixed.SPACE_CHARS).replace("**", "") for c in line.removeprefix("|").removesuffix("|").split("|")]


def _table(quote):
    """Caption and rows of cells of a passage that is a well-formed table, else None."""
    found = [t for t in (line.strip(fixed.SPACE_CHARS) for line in quote.split("\n")) if t]
    first = next((i for i, t in enumerate(found[:2]) if t[0] == "|"), None)
    if first is None or not all(t[0] == "|" and t[-1] == "|" for t in found[first:]):
        return None
    rows = [_cells(t) for t in found[first:]]
    rules = [all(map(_CELL_RULE.match, row)) for row in rows]
    if len(rows) < 3 or len(rows[0]) < 2 or {*map(len, rows)} != {len(rows[0])} or not rules[1] or any(rules[2:]):
        return None
    return {"caption": found[0].replace("**", "") if first else None, "cells": rows[:1] + rows[2:]}


@F.arrow_udf(_TABLE)
def _passage_table(quotes: pa.Array) -> pa.Array:
    """(caption, rows of cells) of passages that are well-formed tables, else NULL."""
    return pa.array([None if quote is None else _table(quote) for quote in quotes.to_pylist()],
                    pa.struct([("caption", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))]))


def table_cells(passages, quote="quote"):
    """Cells of table passages as (row, col, cell, header, caption); other passages give no rows.

    A passage is a table when it has a rule under its first row, every line is
    closed by pipes, and all rows have the same width of two or more.
    """
    keep = [c for c in passages.columns]
    text = F.col(quote)
    rows = passages.filter(text.contains("|") & ~text.contains("\\|")).withColumn("_table", _passage_table(text))
    rows = rows.filter(F.col("_table").isNotNull())
    rows = rows.select(*keep, F.col("_table.caption").alias("caption"), F.posexplode("_table.cells").alias("row", "_cells"))
    return rows.select(*keep, "caption", "row", (F.col("row") == 0).alias("header"), F.posexplode("_cells").alias("col", "cell"))
