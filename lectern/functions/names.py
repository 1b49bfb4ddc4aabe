"""Names, labels and display strings: titles from file names, keys, sizes, durations, settings limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of raw text, as a character class.
SPACE_CLASS = " \\t\\n\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ANY_SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
ANY_SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
UNITS = ("KB", "MB", "GB", "TB")
LESSON_LENGTHS, LESSON_DEFAULT = (100, 125, 150, 175, 200), 100
VISIBLE_LINES, VISIBLE_DEFAULT = (2, 8), 3


def once(value: Column, use) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_class(col: Column) -> Column:
    """Raw text without white space at its ends."""
    return F.regexp_replace(col, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def any_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(ANY_SPACES))


def squeezed(col: Column) -> Column:
    """A label: runs of white space are one space, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), f"{ANY_SPACE}+", " "))


def decoded(col: Column) -> Column:
    """Percent-decoded; what is not valid stays as it is. A plus sign is no space."""
    out = F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))
    return F.when(out.isNull() | out.contains("�"), col).otherwise(out)


def file_title(name: Column) -> Column:
    """Without extension, percent-decoded, underscores and hyphens as spaces."""
    title = squeezed(F.regexp_replace(decoded(F.regexp_replace(name, "\\.[^.]+$", "")), "[_-]+", " "))
    return F.when(title == "", "Untitled book").otherwise(title)


def section_title(name: Column) -> Column:
    """The same of a section's file, with camel case parted."""
    title = squeezed(F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), "([a-z])([A-Z])", "$1 $2"))
    return F.when(title == "", "Untitled section").otherwise(title)


def edge_key(line: Column) -> Column:
    return squeezed(F.lower(line))


def ends_sentence(line: Column) -> Column:
    return any_trim(line).rlike("[.!?][\"')\\]]?$")


def begins_uppercase(line: Column) -> Column:
    return any_trim(line).rlike("^[\"'(\\[]*[A-Z]")


def is_edge_number(line: Column) -> Column:
    """One to five digits or one to eight roman letters."""
    return any_trim(line).rlike("^([0-9]{1,5}|[IVXLCDMivxlcdm]{1,8})$")


def word_start(text: Column, index: Column) -> Column:
    """Place of the first character of the word that holds the character before `index`."""
    before = F.left(text, F.greatest(index, F.lit(0)))
    return F.when(index <= 0, 0).otherwise(F.length(before) - F.length(F.substring_index(before, " ", -1)))


def clamped(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def whole(value: Column) -> Column:
    """Floor of a finite positive number, else 0."""
    fine = value.isNotNull() & ~F.isnan(value.cast("double")) & (value > 0) & (value < float("inf"))
    return F.when(fine, F.floor(value)).otherwise(F.lit(0)).cast("long")


def distance(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(100.0 * done / total + 0.5)).cast("int")).otherwise(0)


def size_label(size: Column) -> Column:
    """Bytes; from 1024 in the largest unit up to TB, one digit after the point below 10."""
    value, label = size.cast("double"), F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS):
        own = value / float(1024 ** (k + 1))
        tenths = F.floor(own * 10 + 0.5)
        short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
        label = F.when(size >= 1024 ** (k + 1), F.concat(F.when(own >= 10, F.floor(own + 0.5).cast("string")).otherwise(short), F.lit(f" {unit}"))).otherwise(label)
    return label


def duration_label(millis: Column) -> Column:
    seconds = F.floor(millis / 1000.0 + 0.5)
    minutes = F.floor(seconds / 60)
    long = F.concat(minutes.cast("string"), F.lit("m "), F.lpad(F.pmod(seconds, F.lit(60)).cast("string"), 2, "0"), F.lit("s"))
    return F.when(minutes == 0, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(long)


def percent_label(value: Column) -> Column:
    return F.concat(F.floor(value + 0.5).cast("string"), F.lit("%"))


def lesson_length(value: Column) -> Column:
    return F.when(value.isin(*LESSON_LENGTHS), value.cast("int")).otherwise(LESSON_DEFAULT)


def visible_lines(value: Column) -> Column:
    return F.when(value.between(*VISIBLE_LINES) & (value == F.floor(value)), value.cast("int")).otherwise(VISIBLE_DEFAULT)


def with_override(overrides: Column, section: Column, included: Column, default: Column) -> Column:
    """One choice set, or cleared where it equals a known default."""
    others = F.map_filter(overrides, lambda k, v: k != section)
    return F.when(default.isNotNull() & (included == default), others).otherwise(F.map_concat(others, F.create_map(section, included)))


def with_choices(overrides: Column, defaults: Column, choices: Column, touched: Column) -> Column:
    """Choices of the touched sections only: set where they differ from the default, else cleared."""
    known = F.filter(touched, lambda s: F.map_contains_key(defaults, s))
    others = F.map_filter(overrides, lambda k, v: ~F.array_contains(known, k))
    chosen = F.map_filter(F.map_from_arrays(known, F.transform(known, lambda s: F.coalesce(F.try_element_at(choices, s), F.try_element_at(defaults, s)))), lambda k, v: v != F.try_element_at(defaults, k))
    return F.map_concat(others, chosen)


def metadata_text(value: Column) -> Column:
    """A metadata value, bare or JSON: a string squeezed, an array joined by ", ", of an object the first known field; null if empty."""
    kinds = ("x-default", "#text", "value")

    def plain(v):
        out = squeezed(v)
        return F.when(out != "", out)

    item = lambda v: F.coalesce(plain(F.when(~v.rlike("^[\\[{]"), v)), *[plain(F.get_json_object(v, f"$['{k}']")) for k in kinds])
    items = F.from_json(value, "array<string>")
    joined = F.array_join(F.filter(F.transform(items, item), lambda v: v.isNotNull()), ", ")
    text = F.when(value.startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)
    return F.when(value.startswith("["), F.when(joined != "", joined)).otherwise(item(text))


def cover_size(content: Column) -> Column:
    """struct(width, height) of a PNG's first chunk or a JPEG's frame header; null for other bytes.

    The JPEG markers are walked by a fold over at most 64 segments of the hex string.
    """
    digits = F.hex(content)

    def number(at, n):
        return F.conv(F.substring(digits, at * 2 + 1, n * 2), 16, 10).cast("int")

    png = F.when(digits.startswith("89504E470D0A1A0A") & (F.substring(digits, 25, 8) == "49484452"), F.struct(number(F.lit(16), 4).alias("width"), number(F.lit(20), 4).alias("height")))
    start = F.struct(F.lit(2).alias("at"), F.lit(False).alias("done"))

    def step(acc, _):
        at = acc["at"]
        marker = F.substring(digits, at * 2 + 1, 4)
        frame = marker.rlike("^FF(C[0-3]|C[5-7]|C[9-B]|C[D-F])$")
        fill = marker == "FFFF"
        over = acc["done"] | frame | ~marker.startswith("FF")
        return F.struct(F.when(over, at).when(fill, at + 1).otherwise(at + 2 + F.coalesce(number(at + 2, 2), F.lit(0))).alias("at"), over.alias("done"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["at"]
    jpeg = F.when(digits.startswith("FFD8") & F.substring(digits, end * 2 + 1, 4).rlike("^FFC[0-35-79-BD-F]$"), F.struct(number(end + 7, 2).alias("width"), number(end + 5, 2).alias("height")))
    return F.coalesce(png, jpeg)


def data_url(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))
