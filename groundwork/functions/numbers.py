"""Numbers and dates in text, and whether one text's numbers are in another's.

Everything here works inside one row: a text gives an array of values, and a
claim is compared with its evidence array to array. No text is shuffled or
exploded to be read. Patterns run in the JVM and mark each number with its parts in
one pass; the marks are read, and values compared, in Arrow batches, since array
functions would be interpreted element by element.
"""

import datetime
import re
import unicodedata
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork import fixed
from groundwork.functions.bind import empty
from groundwork.functions.text import compiled, plain_minus

# Private characters used as marks. They are first taken out of the text itself.
_CRORE, _LAKH, _FOUND, _FIELD, _REST, _OTHER = "\uf8f0", "\uf8f1", "\uf8f2", "\uf8f3", "\uf8f4", "\uf8f5"
_MARKS = _CRORE + _LAKH + _FOUND + _FIELD + _REST

_STRINGS = T.ArrayType(T.StringType())
_DATES = T.ArrayType(T.StructType().add("raw", "string").add("value", "date"))
_QUANTITIES = T.ArrayType(T.StructType().add("text", "string").add("dimension", "string").add("key", "string").add("exponent", "integer").add("prec", "integer").add("approx", "boolean"))

_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd")
_ASCII = "".join(str(unicodedata.digit(c)) for c in _DIGITS)
_TO_ASCII = str.maketrans(_DIGITS, _ASCII)

# Groups: 1 downward word, 2 and 5 approximation, 3, 4, 6 and 7 currency, 8 number, 9 table
# currency, 10 unit. The leading class turns most positions away before any look-behind.
# No group sits inside a possessive quantifier: Java would keep its text from a failed start.
_WORDS = "dfcruigeaDFCRUIGEAıİ"  # first letters; a class without (?iu) is tested far faster
_QUANTITY = (
    rf"(?=[-+.~₹\p{{Nd}}{_WORDS}])(?iu)(?:(?=(?-iu:[{_WORDS}])){fixed.START}(?:"
    rf"(?:({fixed.DOWN_WORDS})|{fixed.UP_WORDS}){fixed.SPACE}*+"
    rf"|({fixed.APPROX_WORDS}){fixed.SPACE}*+(?:(₹|Rs\.?){fixed.SPACE}*+)?"
    rf"|(Rs\.?){fixed.SPACE}*+)"
    rf"|(~){fixed.SPACE}*+(?:(₹|Rs\.?){fixed.SPACE}*+)?|(₹){fixed.SPACE}*+)?"
    rf"((?=[-+.\p{{Nd}}]){fixed.NUMBER})([{_CRORE}{_LAKH}]?+)(?:{fixed.SPACE}*+({fixed.UNIT}))?"
)
_TAGGED = _FOUND + _FIELD.join(("$1", "$2$5", "$3$4$6$7", "$8", "$9", "$10")) + _REST


def ascii_digits(text):
    """Decimal digits of any script as 0 to 9."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(F.translate(text, _DIGITS, _ASCII))


def raw_dates(text):
    """Full dates as they are written."""
    return F.regexp_extract_all(plain_minus(text), F.lit(fixed.FULL_DATE), F.lit(0))


@lru_cache(1 << 16)
def _day(raw):
    """The day a written date names; None where there is no such day."""
    parts = (raw.split("-") if "-" in raw else raw.replace(",", " ").replace(".", " ").split())
    numbers = [p.translate(_TO_ASCII) for p in parts]
    if "-" in raw:  # only a date in ASCII digits counts in this form
        year, month, day = (int(p) if p.isascii() else 0 for p in parts)
    else:
        name, day = (parts[1], numbers[0]) if len(parts[0]) <= 2 else (parts[0], numbers[1])
        year, month, day = int(numbers[2]), _MONTH_NUMBERS.get(name.casefold()[:3], 0), int(day)
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


_MONTH_NUMBERS = {name.lower(): k for k, name in enumerate(fixed.MONTH_ABBREVIATIONS, 1)}


@F.arrow_udf(_DATES)
def _days(raws: pa.Array) -> pa.Array:
    return pa.array([None if row is None else [{"raw": raw, "value": _day(raw)} for raw in row] for row in raws.to_pylist()],
                    pa.list_(pa.struct([("raw", pa.string()), ("value", pa.date32())])))


def dates(text):
    """Full dates in a text as an array of (raw, value); impossible dates have no value."""
    return _days(raw_dates(text))


_BREAK, _ROW, _RULE = compiled(fixed.LINE_BREAK), compiled(rf"{fixed.SPACE}*\|"), compiled(fixed.TABLE_RULE)
_MONEY, _NUMBER = compiled(fixed.TABLE_MONEY, re.IGNORECASE), compiled(fixed.NUMBER)


def _marked_tables(text):
    """The text with a mark behind each number in table rows below a header that names crore or lakh."""
    out, caption = [], ""
    for is_table, run in groupby(_BREAK.split(text), lambda line: bool(_ROW.match(line))):
        rows = list(run)
        if is_table:
            heads = [k for k, row in enumerate(rows) if _MONEY.search(row) or any(map(_RULE.match, rows[k + 1:k + 2]))]
            for head, end in zip(heads, [*heads[1:], len(rows)]):
                named = _MONEY.search(f"{'' if head else caption}\n{rows[head]}")
                if named:
                    mark = _CRORE if named[1].lower() == "crore" else _LAKH
                    rows[head + 1:end] = [_NUMBER.sub(lambda m, mark=mark: m[0] + mark, row) for row in rows[head + 1:end]]
        caption = rows[-1]
        out += rows
    return "\n".join(out)


@F.arrow_udf(T.StringType())
def _tables(texts: pa.Array) -> pa.Array:
    return pa.array([None if text is None else _marked_tables(text) for text in texts.to_pylist()], pa.string())


def _masked(text):
    """A text without dates and period labels, its ranges opened."""
    t = F.regexp_replace(plain_minus(text), f"[{_MARKS[0]}-{_MARKS[-1]}]", _OTHER)
    t = F.regexp_replace(t, fixed.FULL_DATE, " ")
    t = F.regexp_replace(t, fixed.PERIOD, " ")
    t = F.regexp_replace(t, fixed.RANGE_HYPHEN, " ")
    return F.regexp_replace(t, fixed.RANGE_UNIT, " $1")


def marks(text):
    """A text whose numbers are marked with their parts; '' where it has none.

    Only texts that may hold a table with its currency cross to Python here. The test reads the
    text as it is, so every text goes through the patterns once.
    """
    table = text.contains("|") & text.rlike(r"(?iu)₹|Rs") & text.rlike("(?iu)crore|lakh")
    marked = F.when(table, _tables(F.when(table, _masked(text)))).otherwise(_masked(text))
    return F.when(text.rlike(r"\p{Nd}"), F.regexp_replace(marked, _QUANTITY, _TAGGED)).otherwise("")


_YEARS = ("19", "20", "21")
_DIMENSIONS = {"%": "percent", "percent": "percent", "bps": "bps", "times": "ratio", "x": "ratio"}


@lru_cache(1 << 16)
def _quantity(piece):
    """(text, dimension, key, exponent, decimals, approximate) of one marked number; None for a bare year."""
    down, approx, money, number, table, label = piece.split(_FIELD)
    label = label.lower()
    if label:
        dimension = _DIMENSIONS.get(label) or ("bps" if label.startswith("basis") else "rupees")
        exponent = fixed.CRORE_EXPONENT if label.startswith("crore") else fixed.LAKH_EXPONENT if label.startswith("lakh") else 0
    else:
        dimension = "rupees" if money or table else "scalar"
        exponent = 0 if money or not table else fixed.CRORE_EXPONENT if table == _CRORE else fixed.LAKH_EXPONENT
    bare = number.translate(_TO_ASCII) if not number.isascii() else number
    if dimension == "scalar" and len(number) == 4 and bare.isdigit() and number[:2] in _YEARS:
        return None
    whole, _, decimals = bare.lstrip("+-").replace(",", "").partition(".")
    digits = (whole + decimals).lstrip("0")
    short = digits.rstrip("0")
    sign = "-" if number[0] == "-" or down and number[0] != "+" else ""
    key = f"{sign}{short}e{exponent - len(decimals) + len(digits) - len(short)}" if short else "0"
    return number, dimension, key, exponent, len(decimals), bool(approx)


def _read(marked):
    """Quantities of a marked text."""
    found = (_quantity(part.partition(_REST)[0]) for part in marked.split(_FOUND)[1:])
    return [q for q in found if q is not None]


_FIELDS = {"text": pa.string(), "dimension": pa.string(), "key": pa.string(), "exponent": pa.int32(), "prec": pa.int32(), "approx": pa.bool_()}


@F.arrow_udf(_QUANTITIES)
def _quantities(marked: pa.Array) -> pa.Array:
    rows = [[] if row is None else _read(row) for row in marked.to_pylist()]
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    columns = list(zip(*(q for row in rows for q in row))) or [()] * len(_FIELDS)
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _FIELDS.values())], list(_FIELDS))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def quantities(text):
    """Numbers in a text with unit, sign and approximation, as an array of structs.

    ``key`` is the exact value written canonically (sign, digits, exponent), so
    equality is a string test at any length; ``decimal_of`` gives it as a decimal. Dates, period labels and bare years are no numbers.
    """
    return _quantities(marks(text))


def _value(q):
    """Dimension and exact value as one string."""
    return f"{q[1]} {q[2]}"


@F.arrow_udf(_STRINGS)
def _values(marked: pa.Array) -> pa.Array:
    return pa.array([[] if row is None else sorted({_value(q) for q in _read(row)}) for row in marked.to_pylist()], pa.list_(pa.string()))


def values(text):
    """The different values of a text, each as dimension and canonical key: all that evidence is asked for."""
    return _values(marks(text))


def decimal_of(key):
    """A canonical key as a decimal, for sums; NULL where it does not fit."""
    return key.try_cast("decimal(38,12)")


def _parts(key):
    """Sign, digits and power of ten of a canonical key; zero has no digits."""
    if key == "0":
        return "", "", 0
    digits, _, power = key.lstrip("-").partition("e")
    return "-" if key[0] == "-" else "", digits, int(power)


def _plus_one(digits):
    """A whole number as digits, raised by one, at any length."""
    head = digits.rstrip("9")
    return f"{head[:-1]}{int(head[-1:] or 0) + 1}{'0' * (len(digits) - len(head))}"


def rounds_to(value, shown, prec, exponent):
    """Whether a value rounds half up (away from zero) to ``shown``, displayed with
    ``prec`` decimals of a unit of ten to the ``exponent``.

    Both are canonical keys. The value is cut at the last displayed place, digit by
    digit, so any number of digits is exact.
    """
    sign, digits, power = _parts(value)
    shown_sign, shown_digits, shown_power = _parts(shown)
    place = exponent - prec
    moved = power - place
    if moved >= 0:
        rounded = digits + "0" * moved
    else:
        cut = len(digits) + moved  # below 0 the first digit cut off is a 0
        rounded = digits[:max(cut, 0)]
        if cut >= 0 and digits[cut:cut + 1] >= "5":
            rounded = _plus_one(rounded)
    rounded, wanted = rounded.lstrip("0"), (shown_digits + "0" * max(shown_power - place, 0)).lstrip("0")
    return rounded == wanted and (sign == shown_sign or not wanted)


def _missing(claimed, known):
    """The claimed quantities that no known value supports.

    Exact values match on their key; a claim marked approximate may also match
    a value that rounds to what it displays.
    """
    def supported(q):
        _, dimension, key, exponent, prec, approx = q
        if _value(q) in known:
            return True
        return approx and any(rounds_to(v.partition(" ")[2], key, prec, exponent) for v in known if v.startswith(dimension + " "))
    return [q for q in claimed if not supported(q)]


def _known(found, reread):
    return {_value(q) for q in _read(reread)} if reread is not None else set(found or ())


@F.arrow_udf(_STRINGS)
def _unsupported(claimed: pa.Array, known: pa.Array) -> pa.Array:
    return pa.array([[q[0] for q in _missing(_read(c or ""), _known((), k or ""))] for c, k in zip(claimed.to_pylist(), known.to_pylist())], pa.list_(pa.string()))


def unsupported(text, evidence):
    """The numbers of a text, as written, that no number of the evidence supports."""
    return _unsupported(marks(text), marks(evidence))


@F.arrow_udf(_STRINGS)
def _undated(claimed: pa.Array, known: pa.Array) -> pa.Array:
    rows = zip(claimed.to_pylist(), known.to_pylist())
    return pa.array([_lost(c or (), k or ()) for c, k in rows], pa.list_(pa.string()))


def _lost(claimed, known):
    days = {_day(raw) for raw in known} - {None}
    return [raw for raw in claimed if _day(raw) not in days]


def undated(text, *evidence):
    """The dates of a text, as written, that are impossible or in none of the evidence texts."""
    return _undated(raw_dates(text), F.concat(*[raw_dates(e) for e in evidence]))


@F.arrow_udf(_STRINGS)
def _errors(claimed: pa.Array, days: pa.Array, known: pa.Array, reread: pa.Array, known_days: pa.Array) -> pa.Array:
    out = []
    for c, d, k, again, kd in zip(*(x.to_pylist() for x in (claimed, days, known, reread, known_days))):
        messages = [f"Date {raw} is not found in the cited source" for raw in _lost(d or (), kd or ())] if d else []
        numbers = _read(c or "")
        if numbers:
            messages += [f"Number {q[0]} ({q[1]}) is not supported by the cited quotes" for q in _missing(numbers, _known(k, again))]
        out.append(messages)
    return pa.array(out, pa.list_(pa.string()))


def number_errors(text, evidence, date_context):
    """Messages for dates and numbers of a claim that its evidence does not hold.

    ``text`` and ``evidence`` are normalised already; ``date_context`` adds days
    (titles, publication dates) and no numbers.
    """
    # An empty list, not NULL: with each row of a batch Spark fills the offsets of the NULL lists before it anew.
    return _errors(marks(text), raw_dates(text), empty("string"), marks(evidence), F.concat(raw_dates(evidence), raw_dates(date_context)))


# Whether a match could cross the line end between two passages: what may stand before it, and what behind.
_LEADS = (rf"(?iu)(?:[₹~]|{fixed.DIGIT},?|{fixed.START}(?:Rs\.?|Q|H|FY|basis|by|of|to|{fixed.APPROX_WORDS}|{fixed.DOWN_WORDS}|{fixed.UP_WORDS}"
          rf"|decrease|decline|drop|fall|contraction|reduction|increase|rise|growth|(?:{fixed.MONTH_NAME})\.?)){fixed.SPACE}*\z")
# What every match of _LEADS ends with, before blanks: most passages end otherwise, and the last characters tell.
_LEAD_END = rf"(?iu)(?:[₹~,\p{{Nd}}\p{{L}}]|(?:Rs|approx|{fixed.MONTH_NAME})\.)\z"
_FOLLOWS = rf"(?iu)\A{fixed.SPACE}*(?:[-+.₹%|{fixed.DIGIT}]|(?:Rs|by|of|to|points?|percent|bps|basis|crores?|lakhs?|times|x|{fixed.MONTH_NAME}){fixed.END}|Rs\.|\z)"


def read_passage(quote, title, published):
    """What claims ask of a passage, read once: its values, its days and those of its context, and how it may join with others."""
    context = F.concat_ws("\n", title, published.cast("string"))
    leads = F.right(F.rtrim(quote, F.lit(fixed.SPACE_CHARS)), F.lit(12)).rlike(_LEAD_END) & quote.rlike(_LEADS)
    blank = ~quote.rlike(rf"[^{fixed.SPACE[1:-1]}]")
    joint = F.concat(F.when(quote.rlike(_FOLLOWS), "f").otherwise(""), F.when(quote.rlike(rf"\A{fixed.SPACE}*\|"), "t").otherwise(""),
                     F.when(leads | blank, "l").otherwise(""))
    return {"values": values(quote), "days": raw_dates(quote), "context": context, "context_days": raw_dates(context), "joint": joint}


def passage_errors(text, passages):
    """``number_errors`` of a claim over passages that ``read_passage`` has read, in their order.

    Numbers and dates are read again, from the joined quotes, only where a match could cross from one
    passage into the next; titles and days of publication only where a passage has no day.
    """
    crosses = F.array_join(passages["joint"], "|").rlike(r"l\|f|\|f?t")
    quotes, context = F.array_join(passages["quote"], "\n"), F.array_join(passages["context"], "\n")
    undated = (F.size(passages) > 1) & (F.size(F.array_compact(passages["published"])) < F.size(passages))
    days = F.when(crosses, raw_dates(quotes)).otherwise(F.flatten(passages["days"]))
    context_days = F.when(undated, raw_dates(context)).otherwise(F.flatten(passages["context_days"]))
    return _errors(marks(text), raw_dates(text), F.flatten(passages["values"]), F.when(crosses, marks(quotes)), F.concat(days, context_days))
