"""Splitting names, aliases, addresses and countries, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, clean_name, collapse_ws, let, rstrip_chars, strip_chars

#: Patterns and word lists that results must follow. Fixed values.
INLINE_AKA = r"(?i)\s*(?:,\s*)?\b(?:a/k/a|a\.\s?k\.\s?a\.?|aka)\b[.:]?\s*"
PAREN_AKA = r"(?i)\s*\(\s*(?:a/k/a|a\.\s?k\.\s?a\.?|aka)\b[.:]?\s*(.+?)\)\s*"
AKA_CUT = r",?\s+(?:a\.?k\.?a\.?|f\.?k\.?a\.?),?\s"
LIST_ALIAS = r"(?i)\s*[;(,]?\s*(?:\ba/k/a\b|\baka\b|\balso known as\b|\bformerly known as\b|\bf/k/a\b|\bfka\b)[.:]?\s*"
SUBSIDIARIES = r"(?i)\s*[,;(]?\s*including\s+(?:its\s+|their\s+)?.*?subsidiar.*$"
NATIONALITY = r"\s*\([A-Za-z. ]{2,24}\s+(?:entity|entities|national|company)\)$"
SUCCESSORS = r"(?i)[;,]?\s*(?:and\s+)?any successors?, sub-?units?, or subsidiar(?:y|ies) thereof\.?$"
#: What may follow a comma inside a name, tested as plain prefixes. Fixed values.
SUFFIXES = [
    "Ltd", "LTD", "Ltda", "Limited", "Inc", "INC", "Incorporated", "LLC", "L.L.C", "LLP", "L.P", "LP", "Co.", "Co ", "Co,", "Corp", "Company", "S.A", "S.L", "S.R.L", "s.r.o", "S.p.A", "SpA", "SA", "SL", "GmbH", "A.G", "AG", "B.V", "BV", "N.V", "NV", "Pte", "Pvt", "PVT", "Sdn", "Bhd", "JSC", "PJSC", "OJSC", "CJSC", "OOO", "AO", "PAO", "ZAO", "FZE", "FZC", "FZCO", "L.L.C.", "PLC", "plc", "Jr", "Sr", "II", "III", "d.o.o", "a.s", "A.S", "A.Ş", "Lda", "C.A", "K.K", "S.A.S", "SAS", "S.A.R.L", "SARL", "SRL", "M.M.C", "MMC", "LLC.",
]
MILITARY_SUFFIXES = ["Ltd", "LTD", "Limited", "Inc", "LLC", "L.L.C", "Co.", "Co ", "Co,", "Corp", "Company", "S.A", "GmbH", "B.V", "N.V", "Pte", "Pvt", "Sdn", "Bhd", "JSC", "PJSC", "OJSC", "CJSC", "OOO", "AO", "PLC"]
UNIT_WORDS = r"(Institute|Institution|Plant|Bureau|Design|Concern|Company|Corporation|\bJSC\b|\bAO\b|\bOAO\b|\bPAO\b|\bNPO\b|\bGNPP\b|\bTMKB\b|Center|Centre|Factory|Academy|University|Works|Association|Enterprise|Laborator)"
ADDRESS_START = r"^(No\.|P\.?O\.?\s?Box|Room|Rm\b|Building|Bldg|Floor|Flat|Unit\b|House\b|Suite|Office\b|Plot|Km\b|Street|Ulitsa|ul\.|\d)"
MILITARY_UNITS = r"^(Institute|Institution|Ministry|Academy|Bureau|Corporation|Research Center)\b"
MILITARY_ADDRESS = r"^(No\.|P\.?O\.?\s?Box|Room|Rm\b|Building|Bldg|Floor|Flat|Unit\b|Suite|\d)"
GLUED_ADDRESS = r"^(.*\b(?:Ltd|Limited|Inc|Corp|Co)\.?,?)\s+((?:No\.\s?\S+|Floor\s+\S+|Room\s+\S+|\d+\S*).*)$"
#: Two-letter codes in address slots. Fixed values (ISO 3166 names as the lists print them).
COUNTRY_CODES = {
    "AE": "United Arab Emirates", "AF": "Afghanistan", "AL": "Albania", "AR": "Argentina", "AT": "Austria", "AU": "Australia", "BE": "Belgium", "BG": "Bulgaria", "BR": "Brazil", "BY": "Belarus", "CA": "Canada", "CH": "Switzerland", "CL": "Chile", "CN": "China", "CO": "Colombia", "CU": "Cuba", "CY": "Cyprus", "CZ": "Czechia", "DE": "Germany", "DK": "Denmark", "DZ": "Algeria", "EG": "Egypt", "ES": "Spain", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GR": "Greece", "HK": "Hong Kong", "HU": "Hungary", "ID": "Indonesia", "IE": "Ireland", "IL": "Israel", "IN": "India", "IQ": "Iraq", "IR": "Iran", "IT": "Italy", "JO": "Jordan", "JP": "Japan", "KP": "North Korea", "KR": "South Korea", "KW": "Kuwait", "KZ": "Kazakhstan", "LB": "Lebanon", "LI": "Liechtenstein", "LK": "Sri Lanka", "LT": "Lithuania", "LU": "Luxembourg", "LV": "Latvia", "LY": "Libya", "MO": "Macau", "MT": "Malta", "MX": "Mexico", "MY": "Malaysia", "NG": "Nigeria", "NL": "Netherlands", "NO": "Norway", "NZ": "New Zealand", "OM": "Oman", "PA": "Panama", "PE": "Peru", "PH": "Philippines", "PK": "Pakistan", "PL": "Poland", "PT": "Portugal", "QA": "Qatar", "RO": "Romania", "RS": "Serbia", "RU": "Russia", "SA": "Saudi Arabia", "SE": "Sweden", "SG": "Singapore", "SK": "Slovakia", "SY": "Syria", "TH": "Thailand", "TR": "Turkey", "TW": "Taiwan", "UA": "Ukraine", "US": "United States", "UZ": "Uzbekistan", "VE": "Venezuela", "VN": "Vietnam", "YE": "Yemen", "ZA": "South Africa",
}
STATE_CODES = ["AK", "AZ", "AR", "CT", "DC", "FL", "HI", "IA", "KS", "KY", "MA", "MI", "MN", "MS", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "RI", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY"]
#: Locations of sanctioned parties by their country. Fixed values.
LOCATIONS = {
    "people's republic of china": "China", "china": "China", "russia": "Russia", "russian federation": "Russia", "north korea": "North Korea", "dprk": "North Korea", "south korea": "South Korea", "iran": "Iran", "syria": "Syria", "burma": "Burma", "myanmar": "Burma", "united arab emirates": "United Arab Emirates", "uae": "United Arab Emirates", "czech republic": "Czech Republic",
}


def _not_empty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def split_akas(s: Column) -> Column:
    """struct(name, aliases) of an inline chain "X, a/k/a Y, a/k/a Z"."""
    parts = _not_empty(F.transform(F.split(s, INLINE_AKA, -1), lambda p: strip_chars(p, " ,;")))
    many = F.size(parts) > 1
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), clean_name)
    return F.struct(F.when(many, clean_name(F.get(parts, F.lit(0)))).otherwise(clean_name(s)).alias("name"), F.when(many, rest).otherwise(F.array().cast("array<string>")).alias("aliases"))


def paren_akas(s: Column) -> Column:
    """struct(name, aliases) of "X (a.k.a. Y; Z)"."""
    inner = F.regexp_extract_all(s, F.lit(PAREN_AKA), F.lit(1))
    aliases = _not_empty(F.transform(F.flatten(F.transform(inner, lambda x: F.split(x, ";", -1))), clean_name))
    return F.struct(clean_name(F.regexp_replace(s, PAREN_AKA, " ")).alias("name"), aliases.alias("aliases"))


def country_of_code(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in COUNTRY_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), F.when(code.isin(*STATE_CODES), "United States"))


def country_of_address(segments: Column) -> Column:
    """From the segments after the name: the code slot before the last, a bare ZIP, else the last known code."""
    segs = F.transform(segments, lambda x: F.trim(x))
    full = _not_empty(segs)
    slot = F.when(F.size(segs) >= 2, F.get(segs, F.size(segs) - 2))
    last = F.when(F.size(full) > 0, F.get(full, F.size(full) - 1))
    known = F.filter(F.reverse(full), lambda x: x.rlike("^[A-Z]{2}$") & country_of_code(x).isNotNull())
    return F.coalesce(F.when(slot.rlike("^[A-Z]{2}$"), country_of_code(slot)), F.when(last.rlike(r"^\d{5}(-\d{4})?$"), "United States"), country_of_code(F.get(known, F.lit(0))))


def name_and_address(s: Column) -> Column:
    """struct(name, rest): first comma segment with a generational suffix put back, and the segments after it."""
    segs = F.split(F.coalesce(s, F.lit("")), ",", -1)
    tail = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    first = clean_name(F.get(segs, F.lit(0)))
    suffix = F.coalesce(F.get(tail, F.lit(0)).rlike(r"(?i)^\s*(JR|SR|II|III|IV)\.?\s*$"), F.lit(False))
    name = F.when(suffix, F.concat(first, F.lit(", "), clean_name(F.get(tail, F.lit(0))))).otherwise(first)
    return F.struct(name.alias("name"), F.when(suffix, F.slice(tail, 2, F.greatest(F.size(tail) - 1, F.lit(0)))).otherwise(tail).alias("rest"))


def address_of(segments: Column) -> Column:
    """Cleaned segments joined by commas, empty ones closed up; null if none."""
    joined = F.array_join(F.transform(segments, lambda x: F.coalesce(clean(x), F.lit(""))), ", ")
    return F.nullif(strip_chars(F.regexp_replace(joined, r"(,\s*)+", ", "), " ,"), F.lit(""))


def _literal(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def suffix_split(s: Column, suffixes: list[str]) -> Column:
    """struct(name, rest): cut at an aka, else at the first comma that no company suffix follows."""
    aka = F.split(s, AKA_CUT, 2)
    pattern = rf"(?s)^(.*?),(?!\s*(?:{_literal(suffixes)}))(.*)$"
    cut = s.rlike(pattern)
    name = F.when(s.rlike(AKA_CUT), rstrip_chars(F.trim(F.get(aka, F.lit(0))), ",;")).when(cut, F.trim(F.regexp_extract(s, pattern, 1))).otherwise(rstrip_chars(F.trim(s), "."))
    return F.struct(name.alias("name"), F.when(~s.rlike(AKA_CUT) & cut, F.trim(F.regexp_extract(s, pattern, 2))).otherwise(F.lit("")).alias("rest"))


def absorb_units(nr: Column, units: str, addresses: str, times: int = 2, when: Column | None = None) -> Column:
    """Takes up to `times` comma segments that name a sub-unit, not an address, from rest into name."""

    def once(nr: Column) -> Column:
        seg = F.trim(F.substring_index(nr["rest"], ",", 1))
        tail = F.trim(F.regexp_replace(nr["rest"], r"(?s)^[^,]*,?", ""))
        take = (seg != "") & ~seg.rlike(addresses) & seg.rlike(units)
        take = take if when is None else take & when
        return F.when(take, F.struct(F.concat(nr["name"], F.lit(", "), seg).alias("name"), tail.alias("rest"))).otherwise(nr)

    for _ in range(times):  # a segment that is not taken ends it: from then on the same segment fails again
        nr = let(nr, once)
    return nr


def military_split(s: Column) -> Column:
    """struct(name, rest) by the military end-user list's rules: sub-units in, glued addresses out."""
    number = r"^(.*\S)\s+(No\.\s?[A-Z]?\d+)$"
    behind = lambda x, rest: F.trim(F.concat(x, F.when(rest != "", F.concat(F.lit(", "), rest)).otherwise(F.lit(""))))

    def unglued(nr: Column) -> Column:
        name, address = (F.trim(rstrip_chars(F.regexp_extract(nr["name"], GLUED_ADDRESS, 1), ",")), F.trim(F.regexp_extract(nr["name"], GLUED_ADDRESS, 2)))
        return F.when(nr["name"].rlike(GLUED_ADDRESS), F.struct(name.alias("name"), behind(address, nr["rest"]).alias("rest"))).otherwise(nr)

    def numbered(nr: Column) -> Column:
        moved = F.struct(rstrip_chars(F.regexp_extract(nr["name"], number, 1), ",").alias("name"), F.concat(F.regexp_extract(nr["name"], number, 2), F.lit(", "), nr["rest"]).alias("rest"))
        return F.when(nr["name"].rlike(number) & (nr["rest"] != ""), moved).otherwise(nr)

    def whole(nr: Column) -> Column:
        return F.when(s.rlike(AKA_CUT), nr).otherwise(let(let(absorb_units(nr, MILITARY_UNITS, MILITARY_ADDRESS), unglued), numbered))

    return let(suffix_split(s, MILITARY_SUFFIXES), whole)


def list_alias(s: Column, *, military: bool = False) -> Column:
    """An alias line without its dashes, tails and final stop (kept behind an abbreviation)."""
    a = F.trim(F.ltrim(s, F.lit("—–")))
    if not military:
        a = F.regexp_replace(a, r"(?i);?\s*and the following [a-z]+ (?:aliases|subordinate|affiliated).*$", "")
    a = F.trim(F.regexp_replace(a, r"(?i),?\s*(?:and\s+)?to include the following.*$", ""))
    a = F.trim(rstrip_chars(F.trim(F.regexp_replace(a, r";?\s*and$", "")), ";,"))
    kept = r"\b(?:Ltd|Inc|Corp|Co|Jr|Sr)\.$" if military else r"(?:Ltd|Inc|Corp|Co|S\.A|B\.V|N\.V|L\.L\.C|LLC|Jr|Sr|a\.s|\b[A-Z])\.$"
    a = F.when(a.endswith(".") & ~a.rlike(kept), F.regexp_replace(a, r"\.$", "")).otherwise(a)
    return F.trim(rstrip_chars(a, ";,"))


def list_entity(s: Column) -> Column:
    """struct(name, aliases, extra) of a saved page's item: subsidiaries to extra, known-as parts to aliases."""
    extra = F.when(s.rlike(SUBSIDIARIES), collapse_ws(rstrip_chars(F.ltrim(F.regexp_extract(s, SUBSIDIARIES, 0), F.lit(",;( ")), ")")))
    body = F.regexp_replace(s, SUBSIDIARIES, "")
    parts = F.split(body, LIST_ALIAS, -1)
    name = rstrip_chars(collapse_ws(F.get(parts, F.lit(0))), ";,")
    pieces = F.flatten(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, r"\s*[;]\s*|\s+and\s+", -1)))
    aliases = _not_empty(F.transform(pieces, lambda p: rstrip_chars(strip_chars(collapse_ws(p), "()"), ";,.")))
    ok = name != ""
    return F.struct(F.when(ok, name).otherwise(collapse_ws(body)).alias("name"), F.when(ok, aliases).otherwise(F.array().cast("array<string>")).alias("aliases"), extra.alias("extra"))


def country_of_location(s: Column) -> Column:
    """A known location's country, else a short text without words of residence, else null."""
    names = F.create_map(*[F.lit(x) for kv in LOCATIONS.items() for x in kv])
    plain = F.trim(rstrip_chars(s, "."))
    free = (F.length(s) <= 30) & ~s.contains(";") & ~s.rlike(r"(?i)\b(previously|believed|originally|operating|based|residing)\b")
    return F.when(F.coalesce(s, F.lit("")) != "", F.coalesce(F.try_element_at(names, F.lower(plain)), F.when(free, plain)))


def country_of_tail(address: Column) -> Column:
    """Last comma part of the first address, unless it holds a digit."""
    tail = F.trim(F.regexp_extract(rstrip_chars(F.substring_index(address, ";", 1), "."), r"([^,]*)$", 1))
    got = F.when((tail != "") & ~tail.rlike(r"\d"), tail)
    return F.when((got == "British") & address.contains("Virgin Islands"), "British Virgin Islands").otherwise(got)


def is_country_header(s: Column) -> Column:
    return ~s.contains("\n") & F.length(s).between(4, 50) & ~s.rlike(r"\d") & (s == F.upper(s)) & s.rlike(r"\p{L}")


def parties(s: Column) -> Column:
    """array of struct(name, aliases) of "Name [aka A; B] Name2 [aka C]"; a block without a name extends the one before."""
    prefix = r"^\s*(?:and\s+)?(?:aka:?|AKA:?|a\.k\.a\.:?|F\.?K\.?A\.?:?|f\.k\.a\.:?)\s*"
    blocks = F.transform(
        F.arrays_zip(F.regexp_extract_all(s, F.lit(r"([^\[]*)\[([^\]]*)\]?"), F.lit(1)).alias("n"), F.regexp_extract_all(s, F.lit(r"([^\[]*)\[([^\]]*)\]?"), F.lit(2)).alias("b")),
        lambda x: F.struct(rstrip_chars(F.regexp_replace(strip_chars(collapse_ws(x["n"]), " ;,"), " and$", ""), " ,;").alias("name"), _not_empty(F.transform(F.split(x["b"], ";", -1), lambda p: strip_chars(collapse_ws(F.regexp_replace(p, prefix, "")), " ,"))).alias("aliases")),
    )
    tail = strip_chars(collapse_ws(F.regexp_extract(s, r"(?:^|\])([^\[\]]*)$", 1)), " ;,")
    none = F.array().cast("array<struct<name:string,aliases:array<string>>>")
    folded = F.aggregate(
        blocks.cast("array<struct<name:string,aliases:array<string>>>"),
        none,
        lambda acc, x: F.when(x["name"] != "", F.array_append(acc, x)).when(
            F.size(acc) > 0, F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(F.get(acc, F.size(acc) - 1)["name"].alias("name"), F.concat(F.get(acc, F.size(acc) - 1)["aliases"], x["aliases"]).alias("aliases")))
        ).otherwise(acc),
    )
    whole = F.when(F.length(tail) > 2, F.array_append(folded, F.struct(tail.alias("name"), F.array().cast("array<string>").alias("aliases")))).otherwise(folded)
    return F.when(F.size(whole) > 0, whole).otherwise(F.array(F.struct(collapse_ws(s).alias("name"), F.array().cast("array<string>").alias("aliases"))))
