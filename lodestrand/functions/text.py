"""String functions with the source language's semantics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the source semantics, for a character class in Java and in RE2.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EDGES = rf"^[{WS}]+|[{WS}]+$"
LEFT_EDGE = rf"^[{WS}]+"
#: The same characters as a string, and all but the line feed for a character class.
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_IN_LINE = WS.replace(r"\n", "")
#: Accepted file names, and short month names of the display dates.
ACCEPTED = r"(?i)\.(pdf|doc|docx|pptx?|xlsx?|txt|md|html|ipynb|tex)$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def line_count(c: Column) -> Column:
    return F.size(lines(c))


#: Characters that are two units of UTF-16.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def units(c: Column) -> Column:
    """Length in units of UTF-16, in which the source semantics count."""
    return F.length(c) + F.regexp_count(c, F.lit(ASTRAL))


def has_units(c: Column, n: int) -> Column:
    """Whether there are n units at least. Only a text of fewer characters is looked at for pairs of units."""
    return F.when(F.length(c) >= n, True).otherwise(units(c) >= n)


def first_units(c: Column, n: int) -> Column:
    """The characters whose units are all among the first n: of a pair that the cut divides, nothing stays."""
    head = F.substr(c, F.lit(1), F.lit(n))
    width = lambda x: F.when(F.octet_length(x) == 4, 2).otherwise(1)
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("kept"))

    def add(done: Column, x: Column) -> Column:
        upto = done["units"] + width(x)
        return F.struct(upto.alias("units"), F.when(upto <= n, done["kept"] + 1).otherwise(done["kept"]).alias("kept"))

    kept = F.aggregate(F.regexp_extract_all(head, F.lit("(?s)."), F.lit(0)), start, add)["kept"]
    return F.when(head.rlike(ASTRAL), F.substr(head, F.lit(1), kept)).otherwise(head)


def one_json_object(c: Column) -> Column:
    """Whether nothing but blanks stands around the text's first JSON value, an object, by the depth of brackets outside strings.

    What is inside the brackets is left to the parser.
    """
    bare = F.regexp_replace(c, r'(?s)"(?:[^"\\]|\\.)*+"', '""')
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))

    def step(done: Column, bracket: Column) -> Column:
        depth = done["depth"] + F.when(bracket.isin("{", "["), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (done["ends"] + (depth == 0).cast("int")).alias("ends"))

    scan = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(r"[\[\]{}]"), F.lit(0)), start, step)
    framed = lambda x: x.rlike(r"\A[ \t\n\r]*+\{") & x.rlike(r"\}[ \t\n\r]*+\z")
    return F.transform(F.array(bare), lambda x: framed(x) & (scan(x) == F.struct(F.lit(0).alias("depth"), F.lit(1).alias("ends"))))[0]


def first_truthy(*cs: Column) -> Column:
    """The first that is neither null nor empty; the last one as it is."""
    return F.coalesce(*(F.when(c != "", c) for c in cs[:-1]), cs[-1])


def file_ext(name: Column) -> Column:
    """What follows the last dot, lower-cased; all of a name without one."""
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def accepted(name: Column) -> Column:
    return F.coalesce(name.rlike(ACCEPTED), F.lit(False))


def size_kb(size: Column) -> Column:
    return F.format_string("%.1f", size / F.lit(1024.0))


def display_name(name: Column, email: Column) -> Column:
    return first_truthy(F.coalesce(trim(name), F.lit("")), F.coalesce(F.split(email, "@", -1)[0], F.lit("")), F.lit("Pengguna"))


def cookie_millis(cookies: Column, key: str = "splash_at") -> Column:
    """The number that a cookie string has under key, or 0."""
    return F.coalesce(F.regexp_extract(cookies, rf"{key}=([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def expired(last_millis: Column, now_millis: Column, ttl_millis: int = 3_600_000) -> Column:
    return now_millis - last_millis > ttl_millis


def display_date(day: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), month, F.lit(" "), F.year(day).cast("string"))
