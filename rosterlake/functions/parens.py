"""Names with parentheses in parentheses, as Columns, to any depth.

A running count over a text's parentheses gives each its depth, which is then written into the text, so that plain patterns find what
belongs together: outlined() marks the outermost parentheses, numbered() writes its depth behind each one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import scanned
from .text import collapse_ws, let, strip_chars

#: Marks, of no meaning in a text (blanks if it has them): outermost parentheses, a semicolon outside all, what follows a depth.
OPEN, CLOSE, SEMICOLON, MARK = "\ue000", "\ue001", "\ue002", "\ue003"
#: Parentheses that belong to a name, and what opens an alias clause. Fixed values.
OF_NAME = r"limited|ltd|ltd\.|group|holdings"
ALIAS_LEAD = r"and\s+\w+\s+alias(?:es)?:|including\s+\w+\s+alias(?:es)?:|also\s+known\s+as|formerly\s+known\s+as|a/?k/?a\.?|f/?k/?a\.?"


#: An outermost group in an outlined text.
GROUP = f"{OPEN}[^{OPEN}{CLOSE}]*{CLOSE}"


def _with_depths(s: Column, write: Callable[[Column, Column], Column]) -> Column:
    """The text with each parenthesis and semicolon as write(it, the depth outside it) gives it."""
    tokens = F.regexp_extract_all(F.translate(s, OPEN + CLOSE + SEMICOLON + MARK, "    "), F.lit(r"[^();]+|[();]"), F.lit(0))

    def of(all_: Column) -> Column:
        behind = scanned(all_, F.lit(0), lambda d, x: d + F.when(x == "(", 1).when(x == ")", -1).otherwise(0), "int")
        outside = lambda x, d: d - F.when(x == "(", 1).otherwise(0)
        return F.array_join(F.zip_with(all_, behind, lambda x, d: F.when(x.isin("(", ")", ";"), write(x, outside(x, d))).otherwise(x)), "")

    return let(tokens, of)


def outlined(s: Column) -> Column:
    """Outermost parentheses, and semicolons outside all, as marks of their own."""
    return _with_depths(s, lambda x, d: F.when(d == 0, F.translate(x, "();", OPEN + CLOSE + SEMICOLON)).otherwise(x))


def numbered(s: Column) -> Column:
    """Each parenthesis with its depth and MARK behind it: the two of a pair have the same, and none between them has."""
    return _with_depths(s, lambda x, d: F.when(x == ";", x).otherwise(F.concat(x, d.cast("string"), F.lit(MARK))))


def plain(s: Column) -> Column:
    """Without the marks of outlined() or numbered()."""
    return F.translate(F.regexp_replace(s, f"([()])-?\\d+{MARK}", "$1"), OPEN + CLOSE + SEMICOLON, "();")


def pair(begin: str) -> str:
    """A pattern for a numbered text: from a parenthesis that `begin` (without groups) follows to its partner, or to the end; group 2 is what is inside behind `begin`."""
    return rf"(?is)\((-?\d+){MARK}{begin}(.*?)(?:\)\1{MARK}|$)"


def not_empty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def trailing_groups(heading: Column) -> Column:
    """struct(name, groups): the top-level parentheses behind a name; those that belong to a name stay in it."""
    whole = rf"(?is)^(.*?(?:\s*{OPEN}\s*(?:{OF_NAME})\s*{CLOSE})*)((?:\s*{GROUP})*)\s*$"

    def of(h: Column) -> Column:
        groups = F.regexp_extract_all(F.regexp_extract(h, whole, 2), F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))
        return F.struct(collapse_ws(plain(F.regexp_extract(h, whole, 1))).alias("name"), F.transform(groups, lambda g: collapse_ws(plain(g))).alias("groups"))

    return let(outlined(heading), of)


def heading_parts(heading: Column) -> Column:
    """struct(name, aliases, subsidiaries) of a heading: aliases ("formerly", "also known as" or bare), "and X subsidiaries: ..."."""
    parts = trailing_groups(F.coalesce(heading, F.lit("")))
    of_others = lambda g: g.rlike("(?i)^and [^:]*subsidiar")
    others = F.filter(parts["groups"], of_others)
    aliases = F.transform(F.filter(parts["groups"], lambda g: ~of_others(g)), lambda g: collapse_ws(F.regexp_replace(g, "(?i)^(?:formerly|also known as) ", "")))
    listed = F.trim(F.regexp_replace(F.try_element_at(others, F.lit(-1)), "(?s)^[^:]*:", ""))
    return F.struct(parts["name"].alias("name"), aliases.alias("aliases"), listed.alias("subsidiaries"))


def live_name(raw: Column) -> Column:
    """struct(name, aliases, extra): a name without its alias clauses, the aliases, and an "and its ..." tail."""
    clause = pair(rf"(?:{ALIAS_LEAD})\s*")
    raw = numbered(F.coalesce(raw, F.lit("")))
    inner = F.transform(F.regexp_extract_all(raw, F.lit(clause), F.lit(2)), plain)
    pieces = F.flatten(F.transform(inner, lambda x: F.split(x, r"(?i);|,\s+and\s+", -1)))
    aliases = not_empty(F.transform(pieces, lambda p: F.regexp_replace(strip_chars(p, " .;"), r"(?i)^and\s+", "")))
    bare = F.trim(plain(F.regexp_replace(raw, clause, " ")))
    tail = r"(?i)\b(and its .*)$"
    name = F.when(bare.rlike(tail), strip_chars(F.regexp_replace(bare, tail, ""), " ,;")).otherwise(bare)
    return F.struct(strip_chars(collapse_ws(name), " ,;.").alias("name"), aliases.alias("aliases"), strip_chars(F.regexp_extract(bare, tail, 1), " .").alias("extra"))
