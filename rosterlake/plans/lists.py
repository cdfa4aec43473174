"""One pipeline for each list: from its source's rows to entity rows (the eight fields, list_id and ord).

All take and give DataFrames; none collects. Order-dependent steps work within a file, page or country block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import dates, names, text
from rosterlake.functions.company import smart_title, with_entry
from rosterlake.functions.parens import heading_parts, live_name
from rosterlake.operators import checks, merge, ordered
from rosterlake.schema import entity
from rosterlake.sources.files import column


def _listed(df: DataFrame, list_id: str, **given: Column) -> DataFrame:
    return df.select(F.lit(list_id).alias("list_id"), "ord", *entity(**given))


def labelled(label: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(label), c))


def notes_of(*parts: Column, sep: str = "; ") -> Column:
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))


def _with(df: DataFrame, *needed: str) -> DataFrame:
    """The rows with every needed column, null where the file lacks it."""
    return df.withColumns({c: column(df, c) for c in needed})


# --- CSV lists ----------------------------------------------------------------------------------------------------


def release_orders(rows: DataFrame) -> DataFrame:
    df = _with(rows, "Entity", "WRO/Finding", "Industry", "Merchandise", "Remarks", "Country", "Status", "Effective Date")
    raw = text.clean(F.col("Entity"))
    df = df.filter(raw.isNotNull()).withColumn("s", names.split_akas(raw))
    notes = notes_of(text.clean(F.col("WRO/Finding")), *[labelled(f"{c}: ", text.clean(F.col(c))) for c in ("Industry", "Merchandise", "Remarks")])
    return _listed(df, "cbp-wro", name=F.col("s.name"), aliases=F.col("s.aliases"), country=text.clean(F.col("Country")), status=text.clean(F.col("Status")), effective_date=dates.slash_date(F.col("Effective Date")), notes=notes)


def denied_persons(rows: DataFrame) -> DataFrame:
    df = _with(rows, "Name_and_Address", "Type of Denial", "Expiration_Date", "Effective_Date", "Appropriate Federal Register Citations")
    df = df.withColumn("s", names.name_and_address(F.col("Name_and_Address"))).filter("s.name <> ''")
    df = df.withColumn("p", names.paren_akas(F.col("s.name"))).withColumn("q", names.split_akas(F.col("p.name")))
    notes = notes_of(labelled("Type of denial: ", text.clean(F.col("Type of Denial"))), labelled("Expires: ", dates.slash_date(F.col("Expiration_Date"))))
    return _listed(df, "bis-dpl", name=F.col("q.name"), aliases=F.concat("p.aliases", "q.aliases"), country=names.country_of_address(F.col("s.rest")), address=names.address_of(F.col("s.rest")), effective_date=dates.slash_date(F.col("Effective_Date")), federal_register=text.clean(F.col("Appropriate Federal Register Citations")), notes=notes)


def statutory_debarments(rows: DataFrame) -> DataFrame:
    df = _with(rows, "Party Name", "Federal Register Notice", "Corrected Notice", "Corrected Notice Date", "Date Of Birth", "Notice Date")
    raw = text.clean(F.col("Party Name"))
    df = df.filter(raw.isNotNull()).withColumn("p", names.paren_akas(raw))
    notice, fixed = text.clean(F.col("Federal Register Notice")), text.clean(F.col("Corrected Notice"))
    by = F.concat(F.coalesce(notice, F.lit("")), F.lit(" (corrected by "), F.concat_ws(", ", fixed, dates.slash_date(F.col("Corrected Notice Date"))), F.lit(")"))
    return _listed(df, "state-debarred-statutory", name=F.col("p.name"), aliases=F.col("p.aliases"), effective_date=dates.slash_date(F.col("Notice Date")), federal_register=F.when(fixed.isNotNull(), F.trim(by)).otherwise(notice), notes=labelled("Date of birth: ", text.clean(F.col("Date Of Birth"))))


def administrative_debarments(rows: DataFrame) -> DataFrame:
    """The status is that of the last column whose name speaks of reinstatement or status."""
    found = [c for c in rows.columns if "reinstat" in c.lower() or "status" in c.lower()]
    df = _with(rows, "Name", "Charging Letter", "Debarment Order", "Date", "Federal Register Notice")
    raw = text.clean(F.col("Name"))
    df = df.filter(raw.isNotNull()).withColumn("p", names.paren_akas(raw))
    notes = notes_of(F.when(text.clean(F.col("Charging Letter")).isNotNull(), "Charging letter on file"), F.when(text.clean(F.col("Debarment Order")).isNotNull(), "Debarment order on file"))
    status = text.clean(F.col(f"`{found[-1]}`")) if found else F.lit(None)
    return _listed(df, "state-debarred-admin", name=F.col("p.name"), aliases=F.col("p.aliases"), status=status, effective_date=dates.slash_date(F.col("Date")), federal_register=text.clean(F.col("Federal Register Notice")), notes=notes)


# --- tabbed text: the entity list ---------------------------------------------------------------------------------

#: What a cell does, given the state it is met in.
_NOTHING, _OPENS, _ADDS, _LICENSE, _CITATION = range(5)
#: States of a country's block: no row is open, one waits for its license, for its citation, or is whole but may go on.
_NONE, _NAMED, _LICENSED, _WHOLE = range(4)
#: Kinds of cells, each with what it does in these states.
_KINDS = {
    "stop": (_NOTHING, _NOTHING, _NOTHING, _NOTHING),
    "more": (_OPENS, _ADDS, _NOTHING, _ADDS),
    "more, licensed": (_OPENS, _LICENSE, _NOTHING, _ADDS),
    "fr": (_OPENS, _ADDS, _CITATION, _OPENS),
    "fr, licensed": (_OPENS, _LICENSE, _CITATION, _OPENS),
    "": (_OPENS, _ADDS, _NOTHING, _OPENS),
    ", licensed": (_OPENS, _LICENSE, _NOTHING, _OPENS),
}


def _next(kind: str, state: int, act: int) -> int:
    return _NONE if kind == "stop" else {_OPENS: _NAMED, _LICENSE: _LICENSED, _CITATION: _WHOLE}.get(act, state)


def entity_list_rows(cells: DataFrame) -> DataFrame:
    """Rows of the table from cells (path, cell, lines, text): in a country's block, cells go name, license, policy, citation.

    What a cell does depends on the cells before it in its block, by four states and seven kinds of cells: a finite machine, which
    is run over the kinds (not the texts) chunk by chunk, so a block may be in many tasks; the rest is windows and aggregations.
    """
    full = cells.filter("text <> ''")
    blocks = ordered.block_number_in_chunks(full, names.is_country_header(F.col("text")), by=["path"], ord="cell")
    headers = blocks.filter(names.is_country_header(F.col("text"))).select("path", "blk", text.title_country(F.col("text"), ("of", "and", "the", "for", "de", "la")).alias("country"))
    body = blocks.filter(~names.is_country_header(F.col("text")) & (F.col("blk") > 0))
    first = F.substring_index("text", "\n", 1)
    kind = (
        F.when(F.col("text").rlike(r"^\d{1,2} (For this entity|Cybersecurity)") | F.col("text").startswith("["), "stop")
        .when(F.col("text").rlike(r"^\d{1,3} FR \d{3,}"), "fr")
        .when(first.rlike("^(Subordinate institu|Affiliated entities|The following addresses apply|Addresses for|—|–)"), "more")
        .otherwise("")
    )
    licensed = F.lower("text").contains("subject to the ear") | F.lower("text").rlike("^(for |all items|see §)")
    named = F.concat(kind, F.when((kind != "stop") & licensed, ", licensed").otherwise(""))
    number = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), named).cast("int") - 1
    table = [[_next(k, s, act) for s, act in enumerate(acts)] for k, acts in _KINDS.items()]
    kinds = ordered.run_machine(body.select("path", "blk", "cell", number.alias("kind")), F.col("kind"), table, by=["path", "blk"], ord="cell")
    act = F.get(F.array(*[F.lit(a) for acts in _KINDS.values() for a in acts]), F.col("kind") * 4 + F.col("state"))
    acts = kinds.select("path", "blk", "cell", act.alias("act")).filter(F.col("act") != _NOTHING)
    numbered = ordered.block_number_in_chunks(acts, F.col("act") == _OPENS, by=["path", "blk"], ord="cell", name="row_no")
    rows = body.join(numbered, ["path", "blk", "cell"])
    lines = F.flatten(merge.in_order(F.when(F.col("act").isin(_OPENS, _ADDS), F.col("lines")).otherwise(F.array().cast("array<string>")), "cell"))
    of = lambda act: F.max(F.when(F.col("act") == act, F.col("text")))
    return rows.groupBy("path", "blk", "row_no").agg(lines.alias("lines"), of(_LICENSE).alias("license"), of(_CITATION).alias("fr")).join(headers, ["path", "blk"])


def entity_list(cells: DataFrame) -> DataFrame:
    """Names that occur twice in a country take their sub-units in; that needs a first pass over all rows."""
    rows = entity_list_rows(cells).filter(F.size("lines") > 0)
    first = F.get("lines", F.lit(0))
    group = F.regexp_extract(first, "^The following (.+?) entities:$", 1)

    def named(split: Column) -> Column:
        """struct(name, rest) with a semicolon's rest moved to the address and footnote digits gone."""
        def of(nr: Column) -> Column:
            semi = nr["name"].contains("; ")
            after = F.regexp_replace(nr["name"], r"(?s)^.*?; ", "")
            rest = F.when(semi, F.trim(F.concat(after, F.when(nr["rest"] != "", F.concat(F.lit(", "), nr["rest"])).otherwise("")))).otherwise(nr["rest"])
            name = F.when(semi, F.trim(F.substring_index(nr["name"], "; ", 1))).otherwise(nr["name"])
            return F.struct(text.let(name, text.strip_footnote).alias("name"), rest.alias("rest"))

        return text.let(F.when(group != "", F.struct(group.alias("name"), F.lit("").alias("rest"))).otherwise(split), of)

    plain = names.suffix_split(first, names.SUFFIXES)
    prelim = rows.withColumn("prelim", named(plain)).withColumn("raw", plain)
    joined = checks.with_repeated(prelim, "again", F.col("prelim.name"), F.col("country"), match=F.col("raw.name"))
    final = joined.withColumn("s", named(names.absorb_units(F.col("raw"), names.UNIT_WORDS, names.ADDRESS_START, when=F.col("again") & ~first.rlike(names.AKA_CUT))))
    tail = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    dashed = lambda x: x.rlike("^[—–]")
    aliases = F.filter(F.transform(F.filter(tail, dashed), lambda x: names.list_alias(x)), lambda a: (a != "") & ~F.lower(a).isin("and", "the following"))
    marker = lambda x: x.isin("Subordinate institution", "Subordinate institution:", "Subordinate instituion:", "Affiliated entities:") | x.rlike("(aliases:|alias:)$")
    address = F.nullif(F.trim(F.concat_ws(" ", F.nullif("s.rest", F.lit("")), F.filter(tail, lambda x: ~dashed(x) & ~marker(x)))), F.lit(""))
    out = final.withColumn("ord", F.col("blk") * (1 << 20) + F.col("row_no"))
    return _listed(out, "bis-entity-list", name=F.col("s.name"), aliases=aliases, country=F.col("country"), address=address, federal_register=text.citation(F.col("fr")), notes=text.license_note(F.col("license")))


# --- document table: military end users -----------------------------------------------------------------------------

_NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen"]


def military_end_users(table: DataFrame) -> DataFrame:
    """From (path, row_ord, c0 country, c1 entity, c2 citation); country and citation are carried forward within a document."""
    df = table.filter("row_ord > 0").withColumnRenamed("path", "doc")
    df = ordered.block_number(df, F.col("c0") != "", by=["doc"], ord=["row_ord"])
    df = ordered.carry_forward(df, F.when(F.col("c0") != "", text.title_country(F.col("c0"), ("of", "and", "the", "for"))), by=["doc"], ord=["row_ord"], name="country")
    filled = (F.col("c1") != "") & (F.col("c1") != "[Reserved]")
    df = ordered.carry_forward(df, F.when(filled & (F.col("c2") != "") & (F.col("c2") != "[Reserved]"), text.collapse_ws(F.col("c2"))), by=["doc", "blk"], ord=["row_ord"], name="last_fr").filter(filled)
    first = F.trim(F.substring_index("c1", "\n", 1))
    head = r"^The following (\w+) subordinate institutions? of (.+?):$"
    df = df.withColumn("first", first).withColumn("is_head", first.rlike(head))
    df = ordered.block_number(df, F.col("is_head"), by=["doc", "blk"], ord=["row_ord"], name="grp")
    number = F.array_position(F.array(*[F.lit(n) for n in _NUMBERS]), F.lower(F.regexp_extract("first", head, 1))).cast("int")
    df = ordered.carry_forward(df, F.when(F.col("is_head"), F.struct(F.trim(F.regexp_extract("first", head, 2)).alias("parent"), number.alias("n"))), by=["doc", "blk"], ord=["row_ord"], name="head")
    member = ~F.col("is_head") & ~F.col("first").rlike(r"^Subordinate institu\w*:?$")
    df = ordered.first_members(df.withColumn("member", member), F.col("member"), F.coalesce("head.n", F.lit(0)), by=["doc", "blk", "grp"], ord=["row_ord"]).filter("member")
    lines = F.filter(F.transform(F.split("c1", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    tail = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    df = df.withColumn("s", names.military_split(F.get(lines, F.lit(0)))).withColumn("ord", F.col("row_ord").cast("long"))
    aliases = F.filter(F.transform(F.filter(tail, lambda x: x.rlike("^[—–]")), lambda x: names.list_alias(x, military=True)), lambda a: a != "")
    address = F.nullif(F.trim(F.concat_ws(" ", F.nullif("s.rest", F.lit("")), F.filter(tail, lambda x: ~x.rlike("^[—–]")))), F.lit(""))
    return _listed(df, "bis-meu", name=F.col("s.name"), aliases=aliases, country=F.col("country"), address=address, federal_register=text.citation(F.col("last_fr")), notes=F.when(F.col("tagged") & F.col("head.parent").isNotNull(), F.concat(F.lit("Subordinate institution of "), "head.parent")))


# --- text lines: the annex, and the notice of military companies ------------------------------------------------------

_FURNITURE = r"Federal Register\s*/\s*Vol\.|^VerDate |Billing code|^\[FR Doc|Filed \d|Presidential Documents|</GPH>|^khammond|^Annex$|^\d+$"
_CAPITALS = r"^[A-Z][A-Z0-9 &().,'’-]+$"


def annex(lines: DataFrame) -> DataFrame:
    """From (path, page, ord, line): names in capitals on the pages of the annex, after its heading."""
    df = lines.filter(F.col("page").between(3, 4)).withColumn("line", F.trim("line"))
    start = Window.partitionBy("path")
    df = df.withColumn("_at", F.min(F.when(F.col("line") == "Annex", F.struct("page", "ord"))).over(start)).filter(F.struct("page", "ord") > F.col("_at"))
    df = df.filter(~F.col("line").rlike(_FURNITURE) & F.col("line").rlike(_CAPITALS)).withColumn("ord", F.col("page") * (1 << 20) + F.col("ord"))
    return _listed(df, "ofac-eo14032", name=text.clean_text(F.col("line")), country=F.lit("China"), effective_date=F.lit("2021-08-02"), federal_register=F.lit("86 FR 30145 (June 7, 2021)"), notes=F.lit("Listed in the Annex to E.O. 14032 (replacing the Annex to E.O. 13959)"))


def _loose(marker: str) -> str:
    return r"\s+".join(f"\\Q{w}\\E" for w in marker.split())


_START, _REMOVED = "in accordance with section 1260H:", "The Deputy Secretary of Defense has determined that the following previously listed entities should be removed"


def notice_text(lines: DataFrame) -> DataFrame:
    """(path, text) of a notice from (path, ord, line), page furniture left out."""
    kept = lines.filter(~F.col("line").rlike(r"^\d{5}\s+Federal Register\s*/\s*Vol\.") & ~F.col("line").contains("VerDate Sep"))
    return kept.groupBy("path").agg(text.typography(merge.joined("line", "\n")).alias("text"))


def military_companies(notice: DataFrame) -> DataFrame:
    """Additions of a notice: headings and bulleted findings between the two markers; a notice without them in order is an error."""
    marked = F.col("text").rlike(f"(?s){_loose(_START)}.*?{_loose(_REMOVED)}")
    notice = notice.withColumn("text", F.when(marked, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("the markers are missing or out of order in "), "path"))))
    body = notice.select("path", text.clean_text(F.regexp_extract("text", f"(?s){_loose(_START)}(.*?){_loose(_REMOVED)}", 1)).alias("body"))
    parts = ordered.bullets(body, "body")
    parts = ordered.block_number(parts.withColumn("starts", F.col("heading") != ""), F.col("starts"), by=["path"], ord=["pos"], name="blk")
    # a part's bullet belongs to the heading before it, its heading opens the next entry
    heads = parts.filter("starts").select("path", "blk", "heading")
    found = parts.filter("pos > 0").select("path", "pos", (F.col("blk") - F.col("starts").cast("int")).alias("blk"), "bullet").filter("bullet <> ''")
    notes = found.groupBy("path", "blk").agg(text.truncate_note(F.array_join(merge.in_order("bullet", "pos"), " ")).alias("why"))
    df = heads.join(notes, ["path", "blk"], "left").withColumn("h", heading_parts(F.col("heading"))).withColumn("ord", F.col("blk"))
    subs = F.when(F.col("h.subsidiaries").isNotNull(), F.concat(F.lit("Listed together with subsidiaries: "), text.rstrip_chars(F.col("h.subsidiaries"), "."), F.lit(".")))
    return _listed(df, "dow-1260h", name=F.col("h.name"), aliases=F.col("h.aliases"), country=F.lit("China"), effective_date=F.lit("2026-06-10"), federal_register=F.lit("91 FR 35189 (June 10, 2026)"), notes=notes_of(subs, F.col("why"), sep=" | "))


def removals(notice: DataFrame) -> DataFrame:
    """(path, no, name): entries a notice takes off the list; kept apart, not in the output."""
    block = F.regexp_extract("text", rf"(?s){_loose(_REMOVED)}[^:]*:(.*?)(?:The list of entities designated|\z)", 1)
    lines = notice.select("path", F.posexplode(F.split(block, "\n", -1)).alias("ord", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    order = Window.partitionBy("path").orderBy("ord")
    ends = F.coalesce(F.lag(F.col("line").rlike(r"[.)]$")).over(order), F.lit(True)) & ~F.col("line").startswith("(")
    numbered = lines.withColumn("_e", ends.cast("int")).withColumn("no", F.sum("_e").over(order))
    return numbered.groupBy("path", "no").agg(text.clean_text(merge.joined("line", " ")).alias("name"))


# --- positioned fragments ---------------------------------------------------------------------------------------------


def research_list(fragments: DataFrame) -> DataFrame:
    """From (path, page, y0, x0, text): entries at the left edge, bullets and wrapped lines indented; two tables."""
    rows = ordered.anchor_clusters(fragments, "y0", 3.0, by=["path", "page"]).groupBy("path", "page", "cluster").agg(
        F.max("y0").alias("y0"), F.min("x0").alias("x0"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text")
    )
    rows = rows.filter((F.col("page") > 0) & ~((F.col("page") == 1) & (F.col("y0") > 640)) & ~F.col("text").rlike(r"^\d{1,2}$"))
    order, doc = ["page", F.desc("y0")], ["path"]
    rows = ordered.block_number(rows, F.col("text").startswith("Table 2"), by=doc, ord=order, name="second")
    rows = ordered.block_number(rows, F.col("text").startswith("Any program that meets"), by=doc, ord=order, name="over").filter("over = 0")
    rows = rows.filter(~F.col("text").startswith("Table 2"))
    main = (F.col("x0") < 85.0) & ~((F.col("second") > 0) & (F.col("text") == "Interests"))
    rows = ordered.block_number(rows.withColumn("main", main), F.col("main"), by=doc, ord=order, name="entry")
    rows = ordered.block_number(rows.withColumn("first_of_table", F.col("second")), F.col("main"), by=["path", "second"], ord=order, name="begun").filter("begun > 0 AND entry > 0")
    bullet = ~F.col("main") & (F.col("x0") < 106.0) & F.col("text").startswith("•")
    rows = ordered.block_number(rows.withColumn("bullet", bullet), F.col("bullet"), by=["path", "entry"], ord=order, name="item")
    seq = F.row_number().over(Window.partitionBy("path", "entry").orderBy(*order))
    rows = rows.withColumn("ord", seq).withColumn("text", F.when(F.col("bullet"), F.trim(F.ltrim("text", F.lit("• ")))).otherwise(F.col("text")))
    items = rows.groupBy("path", "second", "entry", "item").agg(F.array_join(F.filter(merge.in_order("text"), lambda x: x != ""), " ").alias("raw"))
    by_entry = items.groupBy("path", "second", "entry").agg(
        F.max(F.when(F.col("item") == 0, F.col("raw"))).alias("raw"), F.transform(F.sort_array(F.collect_list(F.when(F.col("item") > 0, F.struct("item", "raw")))), lambda x: text.drop_superscript(x["raw"])).alias("aliases")
    )
    hang = r"^(\([^)]*\))\s*(.*)$"
    last = lambda acc: F.get(acc, F.size(acc) - 1)

    def attach(acc: Column, a: Column) -> Column:
        head = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.concat(last(acc), F.lit(" "), F.regexp_extract(a, hang, 1)))
        rest = F.regexp_extract(a, hang, 2)
        return F.when(a.rlike(hang) & (F.size(acc) > 0), F.when(rest != "", F.array_append(head, rest)).otherwise(head)).otherwise(F.array_append(acc, a))

    aliases = F.aggregate(F.filter("aliases", lambda a: a != ""), F.array().cast("array<string>"), attach)
    name = text.drop_superscript(F.regexp_replace(text.clean_text(F.col("raw")), r"\s*a\.k\.a\.?\s*$", ""))
    notes = F.when(F.col("second") == 0, "FY2024 Section 1286 list, Table 1: institutions with specified characteristics (PRC, Russian Federation, and other countries)").otherwise("FY2024 Section 1286 list, Table 2: foreign talent recruitment programs that pose a threat to national security interests")
    return _listed(by_entry.withColumn("ord", F.col("entry")), "dow-1286", name=name, aliases=aliases, notes=notes)


_ENTRY_END = r"\[CMIC-[A-Z0-9]+\](?:\s*\(Linked To:[^)]*\))?\s*\."


def column_text(fragments: DataFrame) -> DataFrame:
    """(path, text) of three-column pages in reading order: header and footer bands dropped, columns by x0, then downward."""
    top = F.when(F.col("page") == 0, 685.0).otherwise(745.0)
    t = text.collapse_ws(F.col("text"))
    kept = fragments.filter((t != "") & (F.col("y0") <= top) & (F.col("y0") >= 40.0))
    col = F.when(F.col("x0") < 150.0, 0).when(F.col("x0") < 310.0, 1).otherwise(2)
    runs = F.sort_array(F.collect_list(F.struct("page", col.alias("col"), (-F.col("y0")).alias("y"), t.alias("t"))))
    out = kept.groupBy("path").agg(F.array_join(F.transform(runs, lambda x: x["t"]), " ").alias("text"))
    fixed = F.regexp_replace("text", r"(?U)(\w)-\s+(?=[A-Z0-9])", "$1-")
    return out.withColumn("text", F.regexp_replace(fixed, r"\[\s*CMIC\s*-\s*EO\s*(\d+)\s*\]\s*\.", "[CMIC-EO$1]."))


def investment_list(texts: DataFrame) -> DataFrame:
    """From (path, text): entries end in a program tag; entries with the same set of names are one company."""
    body = F.regexp_replace("text", r"(?s)^.*?country in which the equity ticker is\s*registered\.", "")
    entries = ordered.segments(texts.select("path", body.alias("body")), "body", _ENTRY_END)
    # entries of several files are in the order of their paths; the window sees a row for each file
    order = texts.select("path").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    e = with_entry(entries.join(order, "path").select((F.col("file_no") * (1 << 32) + F.col("pos")).alias("ord"), "segment"), "segment").drop("segment")
    e = e.withColumn("variants", F.concat(F.array("name"), "aliases")).withColumn("key", F.coalesce(F.array_join(merge.set_key(F.transform("variants", text.variant_key)), "\x1f"), F.lit("")))
    groups = e.groupBy("key").agg(
        F.min("ord").alias("ord"), merge.distinct_ignoring_case(F.flatten(merge.in_order("variants"))).alias("variants"), F.array_distinct(F.flatten(merge.in_order("former"))).alias("former"),
        merge.first_filled("address").alias("address"), merge.first_filled("tag").alias("tag"), merge.first_filled("linked").alias("linked"), *[merge.last_filled(c).alias(c) for c in ("issuer", "target", "effective", "listing", "uscc")],
    )
    each = groups.select("key", F.explode(F.array_distinct(F.transform("variants", text.variant_key))).alias("v"))
    shared = each.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v")
    own = each.join(shared, "v", "left_semi").groupBy("key").agg(F.collect_set("v").alias("shared"))
    g = groups.join(own, "key", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    either = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    current = either(F.filter("variants", lambda v: ~F.array_contains("former", F.upper(v))), F.col("variants"))
    g = g.withColumn("current", current).withColumn("current", either(F.filter("current", lambda v: ~F.array_contains("shared", text.variant_key(v))), F.col("current")))
    g = g.withColumn("full", either(F.filter("current", lambda v: F.length(v) > 4), F.col("current")))
    longest = F.aggregate("full", F.lit(""), lambda acc, v: F.when(F.length(v) > F.length(acc), v).otherwise(acc))
    squeezed = lambda v: F.left(F.replace(F.upper(v), F.lit(" "), F.lit("")), F.lit(12))
    g = g.withColumn("longest", longest)
    fits = (F.length("issuer") >= 0.8 * F.length("longest")) & F.exists("current", lambda v: squeezed(v) == squeezed(F.col("issuer")))
    g = g.withColumn("canon", F.when(fits, F.col("issuer")).otherwise(F.col("longest")))
    g = g.withColumn("canon", F.when((F.col("canon") == F.upper("canon")) & F.col("canon").rlike("[A-Z]") | ~F.coalesce(fits, F.lit(False)), smart_title(F.col("canon"))).otherwise(F.col("canon")))
    notes = notes_of(labelled("Target Type: ", F.col("target")), labelled("Listing Date (CMIC): ", F.col("listing")), labelled("USCC: ", F.col("uscc")), labelled("Program: ", text.strip_chars(F.col("tag"), "[]")), labelled("Linked To: ", F.col("linked")))
    return _listed(g, "ofac-nscmic", name=F.col("canon"), aliases=F.filter("variants", lambda v: F.upper(v) != F.upper("canon")), country=names.country_of_tail(F.col("address")), address=F.col("address"), effective_date=dates.day_month_date(F.col("effective")), notes=notes)


# --- sanction actions -------------------------------------------------------------------------------------------------


def sanctions(rows: DataFrame) -> DataFrame:
    """From table rows (ord, statute, entity, location, date, status, fr): parties exploded, then one record for each party."""
    c = {k: text.collapse_ws(F.coalesce(k, F.lit(""))) for k in ("statute", "entity", "location", "date", "status", "fr")}
    df = rows.select("ord", *[v.alias(k) for k, v in c.items()]).filter("entity <> ''")
    df = df.select("ord", "statute", "location", "status", "fr", F.coalesce(F.nullif(F.regexp_extract("date", r"\d{1,2}/\d{1,2}/\d{2,4}", 0), F.lit("")), F.nullif("date", F.lit(""))).alias("date"), F.posexplode(names.parties(F.col("entity"))).alias("pos", "p"))
    clause = r"\s*\((?:aka|a\.k\.a\.)[:\s]+([^)]*)\)"
    name = text.dehyphenate(F.col("p.name"))
    inner = F.filter(F.transform(F.split(F.regexp_extract(name, clause, 1), r";|,\s*(?:and\s+)?|\s+and\s+", -1), text.collapse_ws), lambda x: x != "")
    df = df.withColumn("aliases", merge.distinct_ignoring_case(F.concat(F.transform("p.aliases", text.dehyphenate), inner)))
    # only the first clause is taken out
    df = df.withColumn("name", text.collapse_ws(F.concat(F.regexp_extract(name, rf"(?s)^(.*?)(?:{clause}|$)", 1), F.regexp_replace(name, rf"(?s)^.*?(?:{clause}|$)", ""))))
    df = df.withColumn("extra", F.when(F.col("name").rlike(names.SUCCESSORS), "Designation includes any successor, sub-unit, or subsidiary thereof"))
    df = df.withColumn("name", text.rstrip_chars(F.regexp_replace("name", names.SUCCESSORS, ""), " ;,."))
    df = df.withColumn("name", text.collapse_ws(F.regexp_replace("name", names.NATIONALITY, "")))
    bits = notes_of(F.coalesce(F.nullif("statute", F.lit("")), F.lit("unknown authority")), labelled("imposed ", F.col("date")), labelled("status: ", F.nullif("status", F.lit(""))), F.nullif("fr", F.lit("")))
    acts = df.select("name", "aliases", "location", "date", F.nullif("fr", F.lit("")).alias("fr"), F.concat(F.lit("Authority: "), bits).alias("note"), "extra", F.struct("ord", "pos").alias("ord"))
    merged = merge.merge_actions(acts, text.alnum_key(F.col("name")))
    country = names.country_of_location(F.col("location"))
    notes = F.concat_ws(" | ", F.col("notes"), F.col("extra"), F.when(country.isNull(), labelled("Location: ", F.col("location"))))
    return _listed(merged.withColumn("ord", F.col("ord.ord") * 1024 + F.col("ord.pos")), "state-nonproliferation", name=F.col("name"), aliases=F.col("aliases"), country=country, effective_date=dates.checked_date(F.col("date")), federal_register=F.col("federal_register"), notes=notes)


# --- HTML lists -------------------------------------------------------------------------------------------------------

_MADE_IN_CHINA = ["Huawei", "ZTE", "Hytera", "Hikvision", "Dahua", "China Mobile", "China Telecom", "China Unicom", "Pacific Networks", "ComNet"]


def covered_equipment(table: DataFrame) -> DataFrame:
    """From (row_ord, cells): the names in strong, or a category where there are none."""
    df = table.filter((F.size("cells") >= 2) & (F.col("cells")[0]["text"] != "") & ~F.col("cells")[0]["text"].startswith("Covered Equipment or Services"))
    desc, when_ = F.col("cells")[0]["text"], F.col("cells")[1]["text"]
    again = dates.updates(when_)
    df = df.select("row_ord", desc.alias("desc"), F.col("cells")[0]["strongs"].alias("strongs"), dates.named_date(when_).alias("eff"), F.when(again.isNotNull(), F.concat(text.truncate(desc, 200), F.lit(" "), again)).otherwise(text.truncate(desc)).alias("note"))
    df = df.select("*", F.posexplode_outer("strongs").alias("pos", "strong"))
    named = F.trim(text.rstrip_chars(F.col("strong"), ",;: "))
    named = F.when(named.rlike(r"\b(Inc|Corp)$"), F.concat(named, F.lit("."))).otherwise(named)
    short = text.collapse_ws(F.regexp_replace(F.trim(F.substring_index(F.trim(F.substring_index("desc", ",", 1)), "—", 1)), r"[\^†#*]+", ""))
    name = F.when(F.col("strong").isNull(), short).otherwise(named)
    country = F.when(F.col("strong").isNull(), None).when(name.contains("Kaspersky"), "Russia").when(name.rlike("|".join(_MADE_IN_CHINA)), "China")
    notes = F.when(F.col("strong").isNull(), F.concat(F.lit("Category listing (not a named company). "), "note")).otherwise(F.col("note"))
    return _listed(df.withColumn("ord", F.col("row_ord").cast("long") * 1024 + F.coalesce("pos", F.lit(0))), "fcc-covered", name=name, country=country, effective_date=F.col("eff"), notes=notes)


_CATEGORY = "mine, produce, or manufacture|working with the government of xinjiang|labor transfer|exported products|source material|poverty alleviation|pairing assistance"
_BOILERPLATE = r"skip to|how do i|sign up|subscribe|privacy|foia|accessibility|site links|dhs\.gov|http"


def forced_labor_saved(sections: DataFrame) -> DataFrame:
    """From (path, ord, section_ord, heading, item): items of category sections, or of list-like sections with three good items."""
    good = F.length("item").between(4, 300) & ~F.lower("item").rlike(_BOILERPLATE)
    heading = F.lower("heading")
    df = sections.filter(good).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path", "section_ord")))
    df = df.filter(heading.rlike(_CATEGORY) | ((F.col("n") >= 3) & heading.rlike("entit|list|xinjiang|uflpa")))
    df = df.withColumn("s", names.list_entity(F.col("item")))
    bits = F.filter(F.array(F.when(F.col("heading") != "", F.concat(F.lit("UFLPA category: "), "heading")), F.col("s.extra")), lambda x: x.isNotNull())
    merged = merge.merge_saved(df.select("s.name", "s.aliases", bits.alias("notes"), F.col("ord").cast("long").alias("ord")))
    return _listed(merged, "dhs-uflpa", name=F.col("name"), aliases=F.col("aliases"), country=F.lit("China"), notes=F.col("notes"))


_SECTIONS = ["UFLPA Sec. 2(d)(2)(B)(i): mines, produces, or manufactures goods in Xinjiang with forced labor", "UFLPA Sec. 2(d)(2)(B)(ii): works with the XUAR government to recruit or transfer forced labor", "UFLPA Sec. 2(d)(2)(B)(v): sources material from Xinjiang via government labor schemes"]


def forced_labor_live(tables: DataFrame) -> DataFrame:
    """From (table_no, row_no, cells): three tables, one for each category."""
    df = tables.filter((F.size("cells") >= 2) & ~F.lower(F.get("cells", F.lit(0))).isin("name of entity", "entity name"))
    df = df.select(live_name(F.col("cells")[0]).alias("s"), F.nullif(F.col("cells")[1], F.lit("")).alias("effective_date"), F.get(F.array(*[F.lit(x) for x in _SECTIONS]), F.col("table_no")).alias("category"), (F.col("table_no").cast("long") * (1 << 20) + F.col("row_no")).alias("ord"))
    merged = merge.merge_live(df.select("s.name", "s.aliases", "s.extra", "effective_date", "category", "ord").filter("name <> ''"))
    return _listed(merged, "dhs-uflpa", name=F.col("name"), aliases=F.col("aliases"), country=F.lit("China"), effective_date=F.col("effective_date"), notes=F.col("notes"))
