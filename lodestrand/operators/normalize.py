"""Cleaning of extracted code.

Rules are those of single lines, but each is one pass over the whole text, with white space that holds no line feed; a
pass that a cheap search rules out isn't made. Quantifiers are possessive, so long runs of blanks cost no backtracking.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS, WS_CHARS, WS_IN_LINE, lines, trim, trim_start

#: Fixed values, in order of application: pattern and replacement of one line.
LINE_RULES = (
    (rf"[{WS}]*<[{WS}]*-[{WS}]*", " <- "),
    (rf"[{WS}]*\$[{WS}]*", r"\$"),
    (r"[ \t]{2,}", " "),
)
PAGE_NUMBER = r"^[0-9]+\z"


#: White space in a line: all of it, and for texts without any beyond ASCII, where the small class is much faster.
WIDE, NARROW = rf"[{WS_IN_LINE}]", r"[ \t\x0B\f\r]"


def _has_wide(text: Column) -> Column:
    return reduce(or_, (text.contains(c) for c in WS_CHARS if not c.isascii()))


def normalize(code: Column) -> Column:
    """Lines with repaired arrows and dollars, single blanks and no page numbers or printed output."""
    arrow, dollar, blanks = (to for _, to in LINE_RULES)
    around = lambda x, core, to: F.when(_has_wide(x), F.regexp_replace(x, core(WIDE), to)).otherwise(F.regexp_replace(x, core(NARROW), to))
    steps = (
        lambda x: F.when(x.contains("<") & x.contains("-"), around(x, lambda b: rf"{b}*+<{b}*+-{b}*+", arrow)).otherwise(x),
        lambda x: F.when(x.contains("$"), around(x, lambda b: rf"{b}*+\${b}*+", dollar)).otherwise(x),
        lambda x: F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, r"[ \t]{2,}+", blanks)).otherwise(x),
        lambda x: F.when(x.contains("\n"), around(x, lambda b: rf"{b}*+\n{b}*+", "\n")).otherwise(x),
        trim,
        # Only lines of digits alone and of printed output are left to look for.
        lambda x: F.when(x.rlike(r"(?:^|\n)(?:##|[0-9]+(?:\n|\z))"), F.array_join(F.filter(lines(x), _is_code), "\n")).otherwise(x),
        trim,
    )
    for step in steps:
        code = once(code, step)
    return code


def once(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _is_code(line: Column) -> Column:
    return ~line.rlike(PAGE_NUMBER) & ~line.startswith("##")


def drop_output_lines(code: Column) -> Column:
    """Without lines that begin with ## but for blanks."""
    kept = lambda x: F.array_join(F.filter(lines(x), lambda y: ~trim_start(y).startswith("##")), "\n")
    return trim(once(code, lambda x: F.when(x.contains("##"), kept(x)).otherwise(x)))
