"""Registered queries that run every list's pipeline on rows in its source's form, made of the customers, and their SQL.

The SQL states the entities that the customers stand for; the pipelines must find them in the sources' notation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import ordered, statute_table
from rosterlake.plans import lists
from rosterlake.plans.registry import dealt, query
from rosterlake.sources import files


def _key() -> Column:
    return F.col("c_custkey")


def _letters(name: Column) -> Column:
    """A customer's name with letters for its digits."""
    return F.translate(name, "#0123456789", " ABCDEFGHIJ")


def _name() -> Column:
    return _letters(F.col("c_name"))


NM_SQL = "translate(c_name, '#0123456789', ' ABCDEFGHIJ')"


def _half() -> Column:
    """The same for customer k // 2: two customers are one party."""
    return _letters(F.concat(F.lit("Customer#"), F.lpad(F.floor(_key() / 2).cast("string"), 9, "0")))


HALF_SQL = "translate('Customer#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0'), '#0123456789', ' ABCDEFGHIJ')"


def _nation() -> Column:
    return F.translate(F.concat(F.lit("NATION "), F.col("c_nationkey").cast("string")), "0123456789", "ABCDEFGHIJ")


NATION_SQL = "'Nation ' || CASE WHEN c_nationkey < 10 THEN chr(65 + c_nationkey) ELSE chr(65 + c_nationkey // 10) || lower(chr(65 + c_nationkey % 10)) END"


def _text(*parts) -> Column:
    """Texts joined; strings stand for themselves."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _every(n: int, value, rest: int = 0) -> Column:
    return F.when(_key() % n == rest, value if isinstance(value, Column) else F.lit(value))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("aliases", F.array_join("aliases", "|")).select(*columns)


@query("list_release_orders", f"""SELECT c_custkey AS ord, c_name AS name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment || '|Alt ' || c_custkey ELSE '' END AS aliases, 'China' AS country, 'Active' AS status,
  '2020-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS effective_date,
  concat_ws('; ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'Industry: Textiles' END, CASE WHEN c_custkey % 5 = 0 THEN 'Remarks: see note' END) AS notes FROM customer WHERE c_custkey % 7 <> 6""")
def _(t):
    entity = F.when(_key() % 7 == 6, "  ").when(_key() % 2 == 1, _text(F.col("c_name"), ", A/K/A ", F.col("c_mktsegment"), "; aka: 'Alt ", _key(), "'")).otherwise(_text('"', F.col("c_name"), '" '))
    date = _text(_key() % 12 + 1, "/", _key() % 28 + 1, "/2020")
    rows = t("customer").select(_key().alias("ord"), entity.alias("Entity"), F.col("c_mktsegment").alias("WRO/Finding"), _every(3, " Textiles").alias("Industry"), _every(5, "see  note").alias("Remarks"), F.lit("China ").alias("Country"), F.lit("Active").alias("Status"), date.alias("Effective Date"))
    return _shown(lists.release_orders(rows), "ord", "name", "aliases", "country", "status", "effective_date", "notes")


@query("list_denied_persons", """SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 1 THEN c_name || ', JR.' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS aliases,
  ['United States', 'Taiwan', 'China'][c_custkey % 3 + 1] AS country, CASE c_custkey % 3 WHEN 0 THEN '1 ROAD, MONTGOMERY, AL, 36112' WHEN 1 THEN 'BOX ' || c_custkey || ', TAIPEI, TW, 100' ELSE 'BOX 9, CN' END AS address,
  '2020-01-02' AS effective_date, '85 FR ' || c_custkey AS federal_register, 'Type of denial: Standard; Expires: 2030-03-04' AS notes FROM customer""")
def _(t):
    who = F.when(_key() % 3 == 0, _text(F.col("c_name"), " (A.K.A. ", F.col("c_mktsegment"), "), 1 ROAD, MONTGOMERY, AL, , 36112")).when(_key() % 3 == 1, _text(F.col("c_name"), ", JR., BOX ", _key(), ", TAIPEI, TW, 100")).otherwise(_text(F.col("c_name"), " A/K/A ", F.col("c_mktsegment"), ", BOX 9, , CN, ,"))
    rows = t("customer").select(_key().alias("ord"), who.alias("Name_and_Address"), F.lit("Standard").alias("Type of Denial"), F.lit("3/4/2030").alias("Expiration_Date"), F.lit("1/2/2020").alias("Effective_Date"), _text("85 FR ", _key()).alias("Appropriate Federal Register Citations"))
    return _shown(lists.denied_persons(rows), "ord", "name", "aliases", "country", "address", "effective_date", "federal_register", "notes")


@query("list_statutory_debarments", """SELECT c_custkey AS ord, c_name AS name, c_mktsegment || '|X' AS aliases, '2021-05-06' AS effective_date, 'Date of birth: 1/1/70' AS notes,
  '79 FR ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' (corrected by 80 FR ' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN ', 2020-03-04' ELSE '' END || ')' ELSE '' END AS federal_register FROM customer""")
def _(t):
    rows = t("customer").select(_key().alias("ord"), _text(F.col("c_name"), " (a.k.a. ", F.col("c_mktsegment"), "; X)").alias("Party Name"), _text("79 FR ", _key()).alias("Federal Register Notice"), _every(2, _text("80 FR ", _key())).alias("Corrected Notice"), _every(4, "3/4/2020").alias("Corrected Notice Date"), F.lit("1/1/70").alias("Date Of Birth"), F.lit("5/6/2021").alias("Notice Date"))
    return _shown(lists.statutory_debarments(rows), "ord", "name", "aliases", "effective_date", "federal_register", "notes")


@query("list_administrative_debarments", """SELECT c_custkey AS ord, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'Reinstated' END AS status, '2021-02-03' AS effective_date,
  nullif(concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'Charging letter on file' END, CASE WHEN c_custkey % 3 = 0 THEN 'Debarment order on file' END), '') AS notes FROM customer""")
def _(t):
    rows = t("customer").select(_key().alias("ord"), F.col("c_name").alias("Name"), _every(2, "yes").alias("Charging Letter"), _every(3, "x").alias("Debarment Order"), _every(5, " Reinstated ").alias("Reinstatement"), F.lit("2/3/2021").alias("Date"))
    return _shown(lists.administrative_debarments(rows), "ord", "name", "status", "effective_date", "notes")


@query("list_entity_list", f"""WITH c AS (SELECT *, {NM_SQL} AS nm, {NATION_SQL} AS nation, count(*) FILTER (c_custkey % 4 = 0) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT nation AS country, CASE c_custkey % 4 WHEN 0 THEN 'Academy ' || nation || CASE WHEN n > 1 THEN ', Institute ' || nm ELSE '' END WHEN 1 THEN nm || ' Co., Ltd.' WHEN 2 THEN nm ELSE c_mktsegment END AS name,
  CASE c_custkey % 4 WHEN 1 THEN 'Alt ' || c_mktsegment ELSE '' END AS aliases,
  CASE c_custkey % 4 WHEN 0 THEN CASE WHEN n > 1 THEN '' ELSE 'Institute ' || nm || ', ' END || '2 Road.' WHEN 1 THEN '1 Road, Kabul.' || CASE WHEN c_custkey % 8 = 1 THEN ' 3 Road' ELSE '' END WHEN 2 THEN 'Street 5' END AS address,
  '79 FR 1234, 1/1/20' AS federal_register, 'For all items subject to the EAR.' AS notes FROM c""")
def _(t):
    title = F.initcap(_nation())
    name = F.when(_key() % 4 == 0, F.array(_text("Academy ", title, ", Institute ", _name(), ", 2 Road."))).when(_key() % 4 == 1, F.array(_text(_name(), " Co., Ltd., a.k.a., the following alias:"), _text("—Alt ", F.col("c_mktsegment"), "; and"), F.lit("1 Road, Kabul."))).when(_key() % 4 == 2, F.array(_text(_name(), ", Street 5"))).otherwise(F.array(_text("The following ", F.col("c_mktsegment"), " entities:")))
    more = F.when(_key() % 8 == 1, F.array(F.lit("Subordinate institution"), F.lit("3 Road"))).otherwise(F.array(F.lit("[Reserved]")))
    row = F.array(name, *[F.array(F.lit(x)) for x in ("For all items subject to the EAR.", "Presumption of denial.", "79 FR 1234, 1/1/20. 80 FR 1.")], more)
    at = F.col("c_nationkey").cast("long") * (1 << 40)
    of = t("customer").select((F.col("c_nationkey") % 5).cast("string").alias("path"), at.alias("at"), F.posexplode(row).alias("j", "lines"), _key().alias("k")).select("path", (F.col("at") + (F.col("k") + 1) * 8 + F.col("j")).alias("cell"), "lines")
    heads = t("customer").select((F.col("c_nationkey") % 5).cast("string").alias("path"), at.alias("cell"), F.array(_nation()).alias("lines")).distinct()
    cells = of.unionByName(heads).withColumn("text", F.array_join("lines", "\n"))
    return _shown(lists.entity_list(cells), "country", "name", "aliases", "address", "federal_register", "notes")


@query("list_military_end_users", f"""WITH c AS (SELECT *, {NM_SQL} AS nm, {NATION_SQL} AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
SELECT nation AS country, nm || [' Tech. Co., Ltd.', '', ', Institute of A'][c_custkey % 3 + 1] AS name, CASE c_custkey % 3 WHEN 1 THEN 'LT' ELSE '' END AS aliases, ['No. C22, Yu An Rd.', '2 Road', '1 Road'][c_custkey % 3 + 1] AS address,
  last_value(CASE WHEN c_custkey % 2 = 0 THEN '85 FR ' || c_custkey || ', 1/1/20' END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS federal_register,
  CASE WHEN c_nationkey % 2 = 0 AND i <= 2 THEN 'Subordinate institution of Big Lab' END AS notes FROM c""")
def _(t):
    path = (F.col("c_nationkey") % 5).cast("string").alias("path")
    at = F.col("c_nationkey").cast("long") * (1 << 40)
    entity = F.when(_key() % 3 == 0, _text(_name(), " Tech. Co., Ltd. No. C22, Yu An Rd.")).when(_key() % 3 == 1, _text(_name(), ", a.k.a., the following one alias:\n—LT.\n2 Road")).otherwise(_text(_name(), ", Institute of A, 1 Road"))
    rows = t("customer").select(path, (at + _key() + 2).alias("row_ord"), F.lit("").alias("c0"), entity.alias("c1"), F.when(_key() % 2 == 0, _text("85 FR ", _key(), ", 1/1/20. x")).otherwise("").alias("c2"))
    heads = t("customer").select(path, (at + 1).alias("row_ord"), _nation().alias("c0"), F.when(F.col("c_nationkey") % 2 == 0, "The following two subordinate institutions of Big Lab:").otherwise("[Reserved]").alias("c1"), F.lit("").alias("c2")).distinct()
    top = heads.select("path", F.lit(0).cast("long").alias("row_ord"), F.lit("Country").alias("c0"), F.lit("Entity").alias("c1"), F.lit("FR").alias("c2")).distinct()
    return _shown(lists.military_end_users(rows.unionByName(heads).unionByName(top)), "country", "name", "aliases", "address", "federal_register", "notes")


@query("list_annex", f"SELECT upper({NM_SQL}) AS name, 'China' AS country, '2021-08-02' AS effective_date FROM customer WHERE c_custkey % 4 < 2")
def _(t):
    path = (F.col("c_nationkey") % 5).cast("string").alias("path")
    lines = t("customer").select(path, F.element_at(F.array(*map(F.lit, (3, 4, 5, 3))), (_key() % 4 + 1).cast("int")).alias("page"), _key().alias("ord"), F.when(_key() % 4 == 3, _name()).otherwise(F.upper(_name())).alias("line"))
    marks = t("customer").select(path, F.lit(3).alias("page"), F.lit(-1).cast("long").alias("ord"), F.lit(" Annex").alias("line")).distinct()
    before = marks.select("path", "page", F.lit(-2).cast("long").alias("ord"), F.lit("BEFORE CORP").alias("line"))
    return _shown(lists.annex(lines.unionByName(marks).unionByName(before)), "name", "country", "effective_date")


_REMOVED = "\nThe Deputy Secretary of Defense has determined that the following\npreviously listed entities should be removed today:\nGone Co.\n(GC)\nOther\nInc.\nThe list of entities designated as"


def _notices(t) -> DataFrame:
    entry = _text(_name(), " (Limited) (formerly Old ", _key(), " (Group))", F.coalesce(_every(3, _text(" (and ", _name(), " subsidiaries: A; B)")), F.lit("")), " • Because of ", F.col("c_mktsegment"), " (Section 1).")
    rows = t("customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct(_key(), entry.alias("e")))).alias("es"))
    return rows.select("path", _text("intro in accordance with\nsection 1260H: ", F.array_join(F.transform("es", lambda x: x["e"]), " "), _REMOVED).alias("text"))


@query("list_military_companies", f"SELECT {NM_SQL} || ' (Limited)' AS name, 'Old ' || c_custkey || ' (Group)' AS aliases, 'China' AS country, concat_ws(' | ', CASE WHEN c_custkey % 3 = 0 THEN 'Listed together with subsidiaries: A; B.' END, 'Because of ' || c_mktsegment || ' (Section 1).') AS notes FROM customer")
def _(t):
    return _shown(lists.military_companies(_notices(t)), "name", "aliases", "country", "notes")


@query("list_removals", "SELECT CAST(c_nationkey AS VARCHAR) AS path, CAST(no AS BIGINT) AS no, name FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES (1, 'Gone Co. (GC)'), (2, 'Other Inc.')) v(no, name)")
def _(t):
    return lists.removals(_notices(t)).select("path", "no", "name")


@query("list_research", f"SELECT {NM_SQL} AS name, 'Alias ' || c_custkey || ' (X)' AS aliases FROM customer")
def _(t):
    at = F.row_number().over(ordered.Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = t("customer").select(F.col("c_nationkey").cast("string").alias("path"), _name().alias("nm"), _key().alias("k"), at.alias("i"))
    place = rows.select("path", (F.floor(F.col("i") / 10) + 1).cast("int").alias("page"), (F.lit(630.0) - 40 * (F.col("i") % 10)).alias("y"), "nm", "k")
    part = lambda down, x, s: F.struct((F.col("y") - down).alias("y0"), F.lit(x).alias("x0"), s.alias("text"))
    parts = F.array(part(0.0, 77.0, _text(F.col("nm"), " a.k.a.")), part(10.0, 95.0, F.lit("•")), part(11.0, 100.0, _text("Alias ", F.col("k"))), part(20.0, 114.0, F.lit("(X)")))
    return _shown(lists.research_list(place.select("path", "page", F.inline(parts))), "name", "aliases")


@query("list_investment", f"""SELECT 'Customer ' || upper(nm[10]) || lower(nm[11:]) || ' Co Ltd' AS name, 'ALT ' || upper(nm[10:]) || '|OLD ' || upper(nm[10:]) || '|中' AS aliases, 'China' AS country, 'Box ' || c_custkey || ', China; Shanghai' AS address, '2021-08-02' AS effective_date,
  'Target Type: Entity; Program: CMIC-EO13959' || CASE WHEN c_custkey % 2 = 0 THEN '; Linked To: BIG LTD' ELSE '' END AS notes FROM (SELECT *, {NM_SQL} AS nm FROM customer)""")
def _(t):
    short = F.upper(F.substring_index(_name(), " ", -1))
    entry = _text(F.upper(_name()), ' CO LTD (Chinese Simplified: 中) (a.k.a. ALT ', short, '; f.k.a. "OLD ', short, '"), Box ', _key(), ", China; Shanghai; Target Type Entity; Effective Date (CMIC) 02 Aug 2021 [CMIC-EO13959]", F.when(_key() % 2 == 0, " (Linked To: BIG LTD). ").otherwise(". "))
    texts = t("customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(_key(), entry.alias("e")))), lambda x: x["e"]), "").alias("text"))
    got = lists.investment_list(texts)
    return _shown(got, "name", "aliases", "country", "address", "effective_date", "notes")


@query("list_sanctions", f"""WITH c AS (SELECT *, {HALF_SQL} AS nm, 'Authority: Act ' || c_custkey % 7 || '; imposed 1/2/98; status: Active; 63 FR ' || c_custkey AS act FROM customer)
SELECT nm || ' Corp' AS name, string_agg('A' || c_custkey || '|B' || c_custkey, '|' ORDER BY c_custkey) AS aliases, 'Iran' AS country, '1998-01-02' AS effective_date, '63 FR ' || min(c_custkey) AS federal_register, string_agg(act, ' | ' ORDER BY c_custkey) AS notes FROM c GROUP BY nm
UNION ALL SELECT 'Second ' || nm, '', 'Iran', '1998-01-02', '63 FR ' || min(c_custkey), string_agg(act, ' | ' ORDER BY c_custkey) FROM c GROUP BY nm""")
def _(t):
    entity = _text(_half(), " Corp [aka A", _key(), "; a.k.a. B", _key(), "] Second ", _half(), " (Chinese entity)")
    rows = t("customer").select(_key().alias("ord"), _text("Act ", _key() % 7).alias("statute"), entity.alias("entity"), F.lit("Iran.").alias("location"), F.lit("1/2/98").alias("date"), F.lit("Active").alias("status"), _text("63 FR ", _key()).alias("fr"))
    return _shown(lists.sanctions(rows), "name", "aliases", "country", "effective_date", "federal_register", "notes")


@query("list_covered_equipment", f"""WITH c AS (SELECT *, {NM_SQL} AS nm FROM customer), v AS (SELECT *, 'Gear by ' || nm || ' Inc, and Kaspersky [Entry updated 1 time(s), most recently May 3, 2022]' AS note FROM c WHERE c_custkey % 4 <> 0)
SELECT nm || ' Inc.' AS name, NULL AS country, '2021-03-12' AS effective_date, note AS notes FROM v UNION ALL SELECT 'Kaspersky ' || nm, 'Russia', '2021-03-12', note FROM v
UNION ALL SELECT 'Drones ' || nm, NULL, NULL, 'Category listing (not a named company). Drones ' || nm || '^, all—kinds' FROM c WHERE c_custkey % 4 = 0""")
def _(t):
    named = F.array(F.struct(_text("Gear by ", _name(), " Inc, and Kaspersky").alias("text"), F.array(_text(_name(), " Inc,"), _text("Kaspersky ", _name(), ":")).alias("strongs")), F.struct(F.lit("March 12, 2021 and May 3, 2022").alias("text"), F.array().cast("array<string>").alias("strongs")))
    sort = F.array(F.struct(_text("Drones ", _name(), "^, all—kinds").alias("text"), F.array().cast("array<string>").alias("strongs")), F.struct(F.lit("none").alias("text"), F.array().cast("array<string>").alias("strongs")))
    return _shown(lists.covered_equipment(t("customer").select(_key().alias("row_ord"), F.when(_key() % 4 == 0, sort).otherwise(named).alias("cells"))), "name", "country", "effective_date", "notes")


@query("list_forced_labor_saved", f"""WITH c AS (SELECT *, {HALF_SQL} AS nm, count(*) FILTER (c_custkey % 2 = 1) OVER (PARTITION BY c_custkey // 2 % 5) AS n FROM customer)
SELECT nm AS name, coalesce(string_agg('Alt ' || c_custkey || '|Zwei', '|') FILTER (c_custkey % 2 = 0), '') AS aliases, 'China' AS country,
  string_agg(CASE WHEN c_custkey % 2 = 0 THEN 'UFLPA category: Labor transfer' ELSE 'UFLPA category: UFLPA Entity List | including its subsidiary X' END, ' | ' ORDER BY c_custkey) AS notes FROM c WHERE c_custkey % 2 = 0 OR n >= 3 GROUP BY nm""")
def _(t):
    item = F.when(_key() % 2 == 0, _text(_half(), " aka Alt ", _key(), "; Zwei")).otherwise(_text(_half(), ", including its subsidiary X"))
    rows = t("customer").select((F.floor(_key() / 2) % 5).cast("string").alias("path"), _key().alias("ord"), (_key() % 2).alias("section_ord"), F.when(_key() % 2 == 0, "Labor transfer").otherwise("UFLPA Entity List").alias("heading"), item.alias("item"))
    return _shown(lists.forced_labor_saved(rows), "name", "aliases", "country", "notes")


@query("list_forced_labor_live", f"""WITH c AS (SELECT *, {HALF_SQL} AS nm, [{', '.join(repr(x) for x in lists._SECTIONS)}][c_custkey % 3 + 1] AS category FROM customer),
each AS (SELECT nm, unnest(['A' || c_custkey || ' (Old)', 'B']) AS alias, (c_custkey % 3) * 1000000000 + c_custkey * 2 + unnest([0, 1]) AS at_ FROM c),
seen AS (SELECT nm, alias, min(at_) AS at_ FROM each GROUP BY ALL),
a AS (SELECT nm, string_agg(alias, '|' ORDER BY at_) AS aliases FROM seen GROUP BY nm),
n AS (SELECT nm, string_agg(category, '; ' ORDER BY at_) AS notes FROM (SELECT nm, category, min((c_custkey % 3) * 1000000000 + c_custkey) AS at_ FROM c GROUP BY ALL) GROUP BY nm)
SELECT nm AS name, aliases, 'June 1, 2022' AS effective_date, notes || '; and its affiliates' AS notes FROM a JOIN n USING (nm)""")
def _(t):
    cells = F.array(_text(_half(), " (also known as A", _key(), " (Old); and B) and its affiliates."), F.lit("June 1, 2022"))
    rows = t("customer").select((_key() % 3).cast("int").alias("table_no"), _key().alias("row_no"), cells.alias("cells"))
    return _shown(lists.forced_labor_live(rows), "name", "aliases", "effective_date", "notes")


def _line(page: Column, y: Column, *cells: tuple[float, Column]) -> Column:
    """A line of cells (x, text): its characters five apart, a layout character without a place between the cells."""
    def placed(x: float, s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.struct((F.lit(x) + 5.0 * (i - 1)).alias("x0"), F.substr(s, i, F.lit(1)).alias("ch")))

    gap = F.array(F.struct(F.lit(None).cast("double").alias("x0"), F.lit(" ").alias("ch")))
    chars = [c for x, s in cells for c in (gap, placed(x, s))][1:]
    return F.struct(page.cast("int").alias("page"), y.cast("double").alias("y0"), F.lit(float(cells[0][0])).alias("x0"), F.concat_ws(" ", *[s for _, s in cells]).alias("text"), F.concat(*chars).alias("chars"))


@query("list_statute_table", "SELECT 'Act A' AS statute, 'E' || c_custkey || ' Corp' AS entity, 'Iran' AS location, '1/2/98' AS date, 'Active' AS status, '63 FR ' || c_custkey AS fr FROM customer")
def _(t):
    at = F.row_number().over(ordered.Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = t("customer").select(F.col("c_nationkey").cast("string").alias("path"), _key().alias("k"), at.alias("i"))
    page, y, k = F.floor(F.col("i") / 10), F.lit(690.0) - 40 * (F.col("i") % 10), F.col("k")
    xs = (10.0, 100.0, 200.0, 310.0, 400.0, 500.0)
    row = _line(page, y, *zip(xs, (F.lit("Act A"), _text("E", k), F.lit("Iran"), F.lit("1/2/98"), F.lit("Active"), _text("63 FR ", k)), strict=True))
    more = _line(page, y - 10, (100.0, F.lit("Corp")))
    head = _line(page, F.lit(720.0), *zip(xs, map(F.lit, ("Sanction Name", "Entity", "Location of Entity", "Date Imposed", "Status", "Federal Register")), strict=True))
    first = F.filter(F.array(_line(page, F.lit(740.0), (10.0, F.lit("Table 1: Act A"))), head), lambda x: (F.col("i") % 10 == 0) & ((F.col("i") == 0) | (x["y0"] < 730)))
    return statute_table.table_rows(rows.select("path", F.inline(F.concat(F.array(row, more), first)))).select("statute", "entity", "location", "date", "status", "fr")


@query("html_sections", r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) - 1 AS i FROM pages)
SELECT CAST(page_id AS VARCHAR) AS path, CAST(i AS INTEGER) AS ord, 0 AS section_ord, '' AS heading, trim(regexp_replace(raw, '<[^>]+>', '', 'g')) AS item FROM p""")
def _(t):
    return files.html_sections(t("pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))).select("path", "ord", "section_ord", "heading", "item")


@query("html_sections_tables", f"""WITH c AS (SELECT *, {NM_SQL} AS nm FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS path, CAST(i AS INTEGER) AS ord, CAST(no AS INTEGER) AS section_ord, heading, item FROM c, LATERAL (VALUES (0, 0, '', 'before ' || nm), (1, 1, 'Labor & ' || c_mktsegment, nm), (2, 1, 'Labor & ' || c_mktsegment, 'first of ' || c_custkey), (3, 2, 'Next', 'last')) v(i, no, heading, item)""")
def _(t):
    """Sections by headings of any rank; list items and first cells, not the second ones, and no empty ones."""
    page = _text("<ul><li>before ", _name(), "</li><li> </li></ul><h2>Labor &amp; <b>", F.col("c_mktsegment"), "</b></h2><ul><li><a href=x>", _name(), "</a></li></ul><table><tr><td>first of\n", _key(), "</td><td>second</td></tr></table><h5> Next</h5><table><tr><th>no</th></tr><tr><td>last</td></tr></table>")
    return files.html_sections(dealt(t("customer")).select(_key().cast("string").alias("path"), page.cast("binary").alias("content"))).select("path", "ord", "section_ord", "heading", "item")


@query("list_investment_shared", """WITH c AS (SELECT c_custkey // 4 AS g, c_custkey % 4 AS r, translate(lpad(CAST(c_custkey // 4 AS VARCHAR), 6, '0'), '0123456789', 'BCDFGHJKLM') AS b FROM customer),
h AS (SELECT *, bool_or(r = 0) OVER w AS has0, bool_or(r = 2) OVER w AS has2, bool_or(r = 3) OVER w AS has3 FROM c WINDOW w AS (PARTITION BY g))
SELECT CASE r WHEN 0 THEN b || ' Co Ltd' WHEN 1 THEN CASE WHEN has0 THEN b || ' Group' ELSE 'Shared ' || b END WHEN 2 THEN b || ' Gas' ELSE b || ' Oil' END AS name,
  CASE r WHEN 0 THEN 'SHARED ' || b || '|LONG FORMER ' || b || ' HOLDINGS' WHEN 1 THEN CASE WHEN has0 THEN 'SHARED ' || b ELSE b || ' GROUP' END WHEN 2 THEN b || ' OIL' ELSE b || ' GAS' END AS aliases,
  ['1 Road, Beijing, China', '2 Road, Shanghai, China', '3 Road, China', '4 Road, China'][r + 1] AS address,
  'Target Type: Entity; ' || CASE WHEN r = 3 OR r = 2 AND has3 THEN 'Listing Date (CMIC): 03 Jun 2021; ' ELSE '' END || 'Program: CMIC-EO13959' AS notes FROM h WHERE r < 3 OR NOT has2""")
def _(t):
    """Names that two companies share, former names, and an issuer's spelling decide the canonical name; entries with the same names are one."""
    base, k = F.translate(F.lpad(F.floor(_key() / 4).cast("string"), 6, "0"), "0123456789", "BCDFGHJKLM"), _key() % 4
    entry = (
        F.when(k == 0, _text(base, " CO LTD (a.k.a. SHARED ", base, "; f.k.a. LONG FORMER ", base, " HOLDINGS), 1 Road, Beijing, China; Target Type Entity [CMIC-EO13959]. "))
        .when(k == 1, _text("SHARED ", base, " (a.k.a. ", base, " GROUP), 2 Road, Shanghai, China; Target Type Entity [CMIC-EO13959]. "))
        .when(k == 2, _text(base, " GAS (a.k.a. ", base, " OIL), 3 Road, China; Issuer Name ", base, " Gas; Target Type Entity [CMIC-EO13959]. "))
        .otherwise(_text(base, " OIL (a.k.a. ", base, " GAS), 4 Road, China; Target Type Entity; Listing Date (CMIC) 03 Jun 2021 [CMIC-EO13959]. "))
    )
    rows = t("customer").groupBy(F.floor(_key() / 64).cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct(_key(), entry.alias("e")))).alias("es"))
    got = lists.investment_list(rows.select("path", F.array_join(F.transform("es", lambda x: x["e"]), "").alias("text")))
    return _shown(got, "name", "aliases", "address", "notes")


@query("html_tables", "SELECT CAST(c_nationkey AS VARCHAR) AS path, CAST(c_custkey % 3 AS INTEGER) AS table_no, c_custkey AS k, c_name || ' & <Co> of ' || c_mktsegment AS a, 'x' AS b FROM customer")
def _(t):
    """A page for each nation, of three tables."""
    row = _text("<tr class='r'><td><b>", F.col("c_name"), "</b> &amp; &lt;Co&gt;&nbsp;<i>of</i> ", F.col("c_mktsegment"), "</td><td id=", _key(), ">", _key(), "</td><th> x </th></tr>")
    of = lambda n: _text("<table border=1>", F.array_join(F.transform(F.filter("rs", lambda x: x["n"] == n), lambda x: x["r"]), "\n"), "</table>")
    pages = t("customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct((_key() % 3).alias("n"), _key(), row.alias("r")))).alias("rs"))
    got = files.html_tables(pages.select("path", F.concat_ws("<p>", of(0), of(1), of(2)).alias("value")))
    return got.select("path", "table_no", F.col("cells")[1].cast("long").alias("k"), F.col("cells")[0].alias("a"), F.col("cells")[2].alias("b"))
