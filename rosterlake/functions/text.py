"""Text cleaning as Columns: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends that a text reader may split a quoted field at; they vanish inside fields. Fixed values.
LINE_ENDS = r"[\r\n\x0b\x0c\x1c-\x1e\u0085  ]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once and written once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(s: Column) -> Column:
    """Search key: no diacritics, lower case, other than a-z 0-9 blank; "" for null. Stays in the JVM."""
    wide = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(s, F.lit("")), F.lit(True))
    plain = F.regexp_replace(wide, r"\p{Mn}", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))


def typography(s: Column) -> Column:
    """Curly quotes straight, two single quotes one double, en dash a hyphen."""
    return F.replace(F.translate(s, "‘’“”–", "''\"\"-"), F.lit("''"), F.lit('"'))


def collapse_ws(s: Column) -> Column:
    """Runs of Unicode white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def dehyphenate(s: Column) -> Column:
    """Joins a word that a line end cut; keeps the hyphen before a capital or digit."""
    joined = F.regexp_replace(s, r"(?U)(\w)-\s+(?=[a-z])", "$1")
    return F.regexp_replace(joined, r"(?U)(\w)-\s+(?=[A-Z0-9])", "$1-")


def clean_text(s: Column) -> Column:
    return dehyphenate(collapse_ws(typography(s)))


def clean(s: Column) -> Column:
    """Collapsed, null if empty."""
    return F.nullif(collapse_ws(s), F.lit(""))


def strip_chars(s: Column, chars: str) -> Column:
    return F.btrim(s, F.lit(chars))


def rstrip_chars(s: Column, chars: str) -> Column:
    return F.rtrim(s, F.lit(chars))


def clean_name(s: Column) -> Column:
    """Collapsed, without quotes around and commas or semicolons behind; "" if empty."""
    return F.trim(rstrip_chars(strip_chars(F.coalesce(clean(s), F.lit("")), " \t\"'"), ",;"))


def _cut(s: Column, limit: int) -> Column:
    """Place of the last blank before `limit`; -1 without one."""
    back = F.locate(" ", F.reverse(F.left(s, F.lit(limit))))
    return F.when(back > 0, limit - back).otherwise(-1)


def truncate_note(s: Column, limit: int = 250) -> Column:
    """Cut at the last blank within 40 characters of the limit, else at the limit; three dots."""
    c = collapse_ws(s)
    at = F.when(_cut(c, limit) < limit - 40, limit).otherwise(_cut(c, limit))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip_chars(F.left(c, at), " ,;"), F.lit("...")))


def truncate(s: Column, n: int = 250) -> Column:
    """The first n - 1 characters up to the last blank, and an ellipsis."""
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.regexp_replace(F.left(s, F.lit(n - 1)), " [^ ]*$", ""), F.lit("…")))


def license_note(s: Column) -> Column:
    c = collapse_ws(s)
    return F.when(F.length(c) <= 200, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(197))), F.lit("...")))


def citation(s: Column) -> Column:
    """A register citation up to its first full stop with a blank, null if nothing is left."""
    return F.nullif(rstrip_chars(F.trim(F.substring_index(F.trim(s), ". ", 1)), "."), F.lit(""))


def title_country(s: Column, small: tuple[str, ...]) -> Column:
    """The part before the first comma with capitals, small words but the first in lower case."""
    parts = F.split(collapse_ws(F.substring_index(s, ",", 1)), " ")
    cased = F.transform(parts, lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20)))))
    return F.array_join(cased, " ")


def strip_footnote(s: Column) -> Column:
    """Without a footnote digit 1 to 5 (or 45) behind, unless the word before it is one that numbers things."""
    head = F.regexp_extract(s, r"^(.*[A-Za-z).])\s(45|[1-5])$", 1)
    numbered = head.rlike(r"(?i)(No\.|Unit|Factory|Institute|Base|Bureau|Academy|Team|Group|Number|District|Type|Zavod|Plant)$")
    return F.when((head != "") & ~numbered, F.trim(head)).otherwise(s)


def drop_superscript(s: Column) -> Column:
    """Without the note that a broken bookmark leaves and a digit glued to a small letter or parenthesis behind."""
    return F.trim(F.regexp_replace(clean_text(F.replace(s, F.lit("Error! Bookmark not defined."), F.lit(""))), r"(?<=[)a-z])\d$", ""))


def alnum_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def variant_key(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), r"(?U)\W", "")


def escape_html(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def basic_unescape(s: Column) -> Column:
    """The five references of escape_html and the no-break space, in the JVM."""
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), (" ", "&nbsp;"), ("&", "&amp;")):
        s = F.replace(s, F.lit(safe), F.lit(raw))
    return s


def _code_point(n: Column) -> Column:
    """The character of a numeric reference; what no text may hold is left out, what is no character at all is a mark."""
    c1 = F.create_map(*[F.lit(x) for k in range(0x80, 0xA0) for x in (k, bytes([k]).decode("cp1252", "ignore") or chr(k))])
    control = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    wrong = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(wrong, "\ufffd").when(n.between(0x80, 0x9F), F.try_element_at(c1, n.cast("int"))).when(control, "").otherwise(plain)


def _reference(r: Column) -> Column:
    """What a reference (without its ampersand) stands for; of a name that is none, its longest beginning that is one."""
    names = F.create_map(*[F.lit(x) for kv in html5.items() for x in kv])
    digits = F.ltrim(F.regexp_extract(r, "^#[xX]?([0-9a-fA-F]*)", 1), F.lit("0"))
    short = F.when(F.length(digits) <= 8, F.when(digits == "", "0").otherwise(digits))
    number = F.when(r.rlike("^#[xX]"), F.conv(short, 16, 10)).otherwise(short).cast("long")
    begins = F.when(F.length(r) > 1, F.transform(F.sequence(F.length(r), F.lit(2), F.lit(-1)), lambda i: F.left(r, i))).otherwise(F.array().cast("array<string>"))
    known = F.get(F.filter(begins, lambda b: F.map_contains_key(names, b)), F.lit(0))
    named = let(known, lambda k: F.when(k.isNull(), F.concat(F.lit("&"), r)).otherwise(F.concat(F.try_element_at(names, k), F.substr(r, F.length(k) + 1))))
    return F.when(r.startswith("#"), _code_point(number)).otherwise(named)


def html_unescape(s: Column) -> Column:
    """Character references decoded as browsers do, in the JVM."""
    pattern = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    found = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), _reference)
    parts = F.zip_with(F.split(s, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(s.contains("&"), F.array_join(parts, "")).otherwise(s)


def strip_tags(s: Column) -> Column:
    """Tags to blanks, then references decoded, then collapsed."""
    return collapse_ws(html_unescape(F.regexp_replace(s, "<[^>]+>", " ")))


def status_class(s: Column, *, exact: bool = False) -> Column:
    """active or revoked; by default, as users of the site see it, "Inactive" counts as active too."""
    found = s.rlike(r"(?i)^\s*active") if exact else s.rlike("(?i)active")
    return F.when(F.coalesce(s, F.lit("")) == "", None).when(found, "active").otherwise("revoked")
