"""The three ways in which blocks are found: labels in prose, fences, notebook cells.

Each gives array<struct<lang, code>>. All are built-in expressions: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS, first_truthy, first_units, has_units, one_json_object, trim
from .detect import SHORTEST, detect, known
from .normalize import drop_output_lines, normalize, once

#: Beginnings and ends of labelled code, and fences.
ANCHOR = rf"(?i)kode[{WS}]++[\w{WS}]*+:|syntax[{WS}]*+:|script[{WS}]*+:|program[{WS}]*+:"
ANCHOR_END = rf"(?im)output[{WS}]+yang[{WS}]+dihasilkan|interpretasi[{WS}]|^contoh[{WS}]+[0-9]|penugasan"
FENCE = r"```(\w*)\n?([\s\S]*?)```|~~~(\w*)\n?([\s\S]*?)~~~"
#: A label ends with the first colon behind its beginning, and but for the colon it has only letters, digits, low lines and blanks.
#: So a colon ends one if the words right before it are such: whether they do takes one pass, however many words begin one.
BEFORE_WORDS, LABEL = rf"(?s)\A.*[^\w{WS}]", rf"(?i)kode[{WS}]|(?:syntax|script|program)[{WS}]*+\z"
#: Words of which each label has one.
LABEL_WORDS = ("kode", "syntax", "script", "program")
#: Units taken after a label without an end, and characters of the shortest label.
REACH, SHORTEST_LABEL = 2000, 6
#: Parts in which an end mark is looked for at first.
NEAR = 64
NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"


def _labelled(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.struct(detect(c).alias("lang"), c.alias("code")))


def _recognised(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["lang"] != "unknown")


def _long(codes: Column) -> Column:
    return F.filter(codes, lambda c: has_units(c, SHORTEST))


def _rest(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.size(array))


def anchor_candidates(text: Column) -> Column:
    """Of each label the text that it heads: up to the next end mark, or REACH units. Labels don't end blocks.

    The text is cut once, at its colons; those that end a label begin a part, which reaches to the end of the next label, so
    no end mark crosses two parts. A block is the beginning of its label's part, or that part and the following ones up to the first
    with an end mark, so only what is given is ever copied.
    """
    none = F.array().cast("array<string>")
    has_word = lambda x: once(F.lower(x), lambda low: reduce(or_, (low.contains(word) for word in LABEL_WORDS)))
    is_label = lambda x: F.when(has_word(x), F.regexp_replace(x, BEFORE_WORDS, "").rlike(LABEL)).otherwise(False)
    # Of each label the number, from 1, of the stretch before its colon; the last stretch has none behind it.
    at = lambda cut: F.filter(F.transform(cut, lambda x, i: F.when((i + 1 < F.size(cut)) & is_label(x), i + 1)), lambda i: i.isNotNull())
    upto = lambda x, i, j: F.array_join(F.slice(x["cut"], i + 1, F.coalesce(j, F.size(x["cut"])) - i), ":")
    parts = lambda x: F.zip_with(x["at"], _rest(x["at"]), lambda i, j: F.concat(upto(x, i, j), F.when(j.isNotNull(), ":").otherwise("")))
    pieces = lambda cut: once(F.struct(cut.alias("cut"), at(cut).alias("at")), parts)
    cut = F.when(text.contains(":") & has_word(text), once(F.split(text, ":", -1), pieces)).otherwise(none)
    # Where a part's first end mark begins, from 1; 0 without. Only for the part's own label is its beginning one of a line.
    own = lambda p: F.regexp_instr(p, F.lit(ANCHOR_END))
    later = lambda p, n: F.when(n != 1, n).otherwise(F.greatest(F.regexp_instr(F.concat(F.lit(":"), p), F.lit(ANCHOR_END)) - 1, F.lit(0)))
    ends = lambda p: F.struct(p.alias("parts"), F.transform(p, own).alias("own"))
    both = lambda x: F.struct(x["parts"], x["own"], F.zip_with(x["parts"], x["own"], later).alias("later"))
    with_flag = lambda x: F.struct(x["parts"], x["own"], x["later"], F.transform(x["later"], lambda n: n > 0).alias("ended"), (F.array_max(x["later"]) > 0).alias("some"))
    return once(once(once(once(cut, ends), both), with_flag), lambda x: F.transform(x["parts"], lambda p, i: trim(_block(x, p, i))))


def _block(x: Column, part: Column, i: Column) -> Column:
    """The block of label i, from the parts and the places of end marks in them."""
    own = F.get(x["own"], i)
    # The next part with an end mark, counted from 1 behind this one; 0 without. Mostly it is near.
    ahead = lambda many: F.array_position(F.slice(x["ended"], i + 2, many), F.lit(True)).cast("int")
    near = F.when(x["some"], once(ahead(F.lit(NEAR)), lambda n: F.when(n > 0, n).otherwise(ahead(F.size(x["ended"])))))
    upto = lambda n: F.concat(
        F.array_join(F.slice(x["parts"], i + 1, n), ""), F.substr(F.get(x["parts"], i + n), F.lit(1), F.get(x["later"], i + n) - 1)
    )
    reach = first_units(F.array_join(F.slice(x["parts"], i + 1, F.lit(REACH // SHORTEST_LABEL + 1)), ""), REACH)
    far = once(F.coalesce(near, F.lit(0)), lambda n: F.when(n > 0, upto(n)).otherwise(reach))
    return F.when(own > 0, F.substr(part, F.lit(1), own - 1)).otherwise(far)


def anchor_blocks(text: Column) -> Column:
    cleaned = _long(F.transform(_long(anchor_candidates(text)), drop_output_lines))
    return _recognised(_labelled(F.transform(cleaned, normalize)))


def fence_sections(text: Column) -> Column:
    """array<struct<hint, code>> of all fences whose code is long enough."""
    group = lambda k: F.regexp_extract_all(text, F.lit(FENCE), F.lit(k))
    fenced = text.contains("```") | text.contains("~~~")
    zipped = F.when(fenced, F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("d")))
    sections = F.transform(
        zipped, lambda x: F.struct(F.lower(first_truthy(x["a"], x["c"])).alias("hint"), trim(first_truthy(x["b"], x["d"])).alias("code"))
    )
    none = F.array().cast("array<struct<hint:string,code:string>>")
    return F.when(text.isNotNull(), F.coalesce(F.filter(sections, lambda x: has_units(x["code"], SHORTEST)), none))


def fence_blocks(text: Column) -> Column:
    return F.transform(
        fence_sections(text), lambda x: F.struct(F.when(known(x["hint"]), x["hint"]).otherwise(detect(x["code"])).alias("lang"), x["code"].alias("code"))
    )


def notebook_codes(text: Column) -> Column:
    """Trimmed code of notebook cells, up to the first that can't be read. Null for other texts."""
    gate = F.when(text.contains('"source"') & text.contains('"cell_type"'), one_json_object(text))
    cells = F.from_json(F.when(gate, text), NOTEBOOK, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})["cells"]
    broken = F.transform(cells, lambda c: c.isNull() | (F.coalesce(c["cell_type"] == "code", F.lit(False)) & c["source"].isNull()))
    first = F.array_position(broken, F.lit(True)).cast("int")
    whole = F.when(first > 0, F.slice(cells, 1, F.greatest(first - 1, F.lit(0)))).otherwise(cells)
    code = F.filter(whole, lambda c: c["cell_type"] == "code")
    return _long(F.transform(code, lambda c: trim(F.array_join(c["source"], ""))))


def notebook_blocks(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return _recognised(_labelled(F.coalesce(notebook_codes(text), none)))
