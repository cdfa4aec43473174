"""Registered queries of the list engine over the test tables, and the SQL that must give the same rows.

The tables stand in for lists: part is an entity list (p_name name, p_brand list, p_type country), documents and
pages hold texts, events are ordered rows. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import dates, names, text
from rosterlake.operators import checks, merge, ordered, postings, search
from rosterlake.plans import lists
from rosterlake.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from rosterlake.session import fresh_path

NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(coalesce({0}, ''), 'ł', ' '), 'Ł', ' '))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
WS = r"trim(regexp_replace({0}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0b]+', ' ', 'g'))"
TYPO = "replace(translate({0}, '‘’“”–', '''''\"\"-'), '''''', '\"')"


def _parts(t) -> DataFrame:
    """part as entity rows: the brand's number parts the lists, every third part has an alias."""
    p = t("part")
    alias = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat_ws(" ", F.lit("aka"), "p_type"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        F.col("p_name").alias("name"), alias.alias("aliases"), F.col("p_type").alias("country"), F.concat_ws(" ", F.lit("Lot"), F.col("p_size").cast("string")).alias("address"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("effective_date"), F.lit("").alias("federal_register"), F.concat_ws("; ", F.lit("Size:"), F.col("p_size").cast("string")).alias("notes"), F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("ord"),
    )


PARTS_SQL = f"""ent AS (SELECT p_partkey AS ord, p_name AS n, p_brand AS l, CASE WHEN p_partkey % 3 = 0 THEN 'aka ' || p_type END AS a, p_type AS c, 'Lot ' || p_size AS ad, 'Size:; ' || p_size AS no_ FROM part),
idx AS (SELECT *, {NORM.format("n")} AS nn, {NORM.format("n || coalesce(' | ' || a, '')")} AS k, {NORM.format("c || ' ' || ad || ' ' || no_")} AS x FROM ent)"""


def _score_sql(q: str) -> str:
    tokens = q.split(" ")
    every = lambda *cols: " AND ".join("(" + " OR ".join(f"contains({c}, '{t}')" for c in cols) + ")" for t in tokens)
    return f"CASE WHEN nn = '{q}' THEN 100 WHEN starts_with(nn, '{q}') THEN 85 WHEN {every('k')} THEN CASE WHEN {every('nn')} THEN 70 ELSE 55 END WHEN {every('k', 'x')} THEN 25 ELSE 0 END"


# --- search -----------------------------------------------------------------------------------------------------


@query("index_projection", f"WITH {PARTS_SQL} SELECT ord, n, l, coalesce(a, '') AS a, c, ad, CAST(NULL AS VARCHAR) AS fr, no_ AS no, k, nn FROM idx")
def _(t):
    return search.index(_parts(t)).select("ord", "n", "l", F.coalesce(F.array_join("a", "|"), F.lit("")).alias("a"), "c", "ad", "fr", "no", "k", "nn")


@query("search_score", f"WITH {PARTS_SQL}, s AS (SELECT ord, n, l, {_score_sql('red bolt')} AS score FROM idx) SELECT ord, n, l, CAST(score AS INTEGER) AS score FROM s WHERE score > 0")
def _(t):
    idx = search.index(_parts(t))
    return idx.select("ord", "n", "l", search.score(F.lit("red bolt"), F.col("nn"), F.col("k"), F.col("x")).alias("score")).filter("score > 0")



@query("search_grouped", f"WITH {PARTS_SQL}, m AS (SELECT * FROM (SELECT *, {_score_sql('bolt')} AS score FROM idx) WHERE score > 0) SELECT nn, arg_min(n, ord) AS name, CAST(max(score) AS INTEGER) AS score, count(*) AS n_recs, count(DISTINCT l) AS n_lists, count(DISTINCT c) AS n_countries FROM m GROUP BY nn")
def _(t):
    return search.search(search.index(_parts(t)), "Bólt!").select("nn", "name", "score", "n_recs", "n_lists", F.size("countries").cast("long").alias("n_countries"))


@query("search_topk", f"WITH {PARTS_SQL}, m AS (SELECT * FROM (SELECT *, {_score_sql('small')} AS score FROM idx) WHERE score > 0) SELECT arg_min(n, ord) AS name, CAST(max(score) AS INTEGER) AS score, count(*) AS n_recs FROM m GROUP BY nn ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40")
def _(t):
    return search.ranked(search.search(search.index(_parts(t)), "small")).select("name", "score", "n_recs")


@query("search_aliases", f"WITH {PARTS_SQL}, m AS (SELECT * FROM (SELECT *, {_score_sql('aka economy')} AS score FROM idx) WHERE score > 0) SELECT ord, n, CAST(score AS INTEGER) AS score FROM m")
def _(t):
    idx = search.index(_parts(t))
    return idx.select("ord", "n", search.score(F.lit("aka economy"), F.col("nn"), F.col("k"), F.col("x")).alias("score")).filter("score > 0")


@query("browse_list", f"WITH {PARTS_SQL} SELECT nn, arg_min(n, ord) AS name, 50 AS score, count(*) AS n_recs FROM idx WHERE l = 'Brand#7' GROUP BY nn")
def _(t):
    return search.search(search.index(_parts(t)), "", list_id="Brand#7").select("nn", "name", "score", "n_recs")


@query("agency_filter", "SELECT s_suppkey, 'State' AS family FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def _(t):
    lists = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    agency = F.when(F.col("r_name").startswith("A"), F.concat(F.lit("State/"), "r_name")).otherwise(F.col("r_name"))
    of = t("supplier").join(lists, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", search.family(agency).alias("family"))
    return of.filter("family = 'State'")


@query("agency_search", f"WITH {PARTS_SQL}, m AS (SELECT * FROM (SELECT *, {_score_sql('gear')} AS score FROM idx WHERE l LIKE 'Brand#1%') WHERE score > 0) SELECT nn, CAST(max(score) AS INTEGER) AS score, count(*) AS n_recs FROM m GROUP BY nn")
def _(t):
    lists = t("part").select(F.col("p_brand").alias("id")).distinct().withColumn("agency_short", F.when(F.col("id").startswith("Brand#1"), "State/X").otherwise(F.col("id")))
    return search.search(search.index(_parts(t)), "gear", lists=lists, agency="State").select("nn", "score", "n_recs")


SCREEN_SQL = f"WITH {PARTS_SQL}, q AS (SELECT DISTINCT {NORM.format('p_name')} AS q FROM part), j AS (SELECT q.q AS qid, idx.ord, CASE WHEN nn = q THEN 100 WHEN starts_with(nn, q) THEN 85 WHEN list_bool_and(list_transform(string_split(q, ' '), lambda u: contains(k, u))) THEN CASE WHEN list_bool_and(list_transform(string_split(q, ' '), lambda u: contains(nn, u))) THEN 70 ELSE 55 END WHEN list_bool_and(list_transform(string_split(q, ' '), lambda u: contains(k, u) OR contains(x, u))) THEN 25 ELSE 0 END AS score FROM q, idx) SELECT qid, CAST(score AS INTEGER) AS score, count(*) AS n FROM j WHERE score > 0 GROUP BY ALL"


@query("screen_names", SCREEN_SQL)
def _(t):
    asked = t("part").select(F.col("p_name").alias("q")).distinct().select(text.norm(F.col("q")).alias("qid"), "q").distinct()
    return search.screen(search.index(_parts(t)), asked).groupBy("qid", "score").agg(F.count(F.lit(1)).alias("n"))


def _inverted(t) -> postings.Inverted:
    """The parts' index, written as an inverted one to the shared folder and read again."""
    idx = search.index(_parts(t))
    path = fresh_path(idx.sparkSession, "inverted")
    postings.write(idx, path, buckets=8)
    return postings.read(idx.sparkSession, path)


@query("screen_inverted", SCREEN_SQL)
def _(t):
    asked = t("part").select(F.col("p_name").alias("q")).distinct().select(text.norm(F.col("q")).alias("qid"), "q").distinct()
    return search.screen(_inverted(t), asked).groupBy("qid", "score").agg(F.count(F.lit(1)).alias("n"))


@query("search_inverted", f"WITH {PARTS_SQL}, m AS (SELECT * FROM (SELECT *, {_score_sql('ol all')} AS score FROM idx) WHERE score > 0) SELECT nn, arg_min(n, ord) AS name, CAST(max(score) AS INTEGER) AS score, count(*) AS n_recs, count(DISTINCT l) AS n_lists, count(DISTINCT c) AS n_countries FROM m GROUP BY nn")
def _(t):
    """Words inside words: "ol all" is in "bolt small"."""
    return search.search(_inverted(t), "Öl  all").select("nn", "name", "score", "n_recs", "n_lists", F.size("countries").cast("long").alias("n_countries"))


@query("search_page", f"WITH {PARTS_SQL}, m AS (SELECT * FROM (SELECT *, {_score_sql('a')} AS score FROM idx) WHERE score > 0), g AS (SELECT nn, arg_min(n, ord) AS name, CAST(max(score) AS INTEGER) AS score, count(*) AS n_recs FROM m GROUP BY nn) SELECT name, score, n_recs, (SELECT count(*) FROM g) - 15 AS remaining FROM g ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10 OFFSET 5")
def _(t):
    """The second page, of ten groups, behind a first one of five."""
    idx = search.index(_parts(t))
    groups = search.grouped(idx.withColumn("score", search.score(F.lit("a"), F.col("nn"), F.col("k"), F.col("x"))).filter("score > 0"))
    first, _seen = search.page_after(groups, page=5)
    second, seen = search.page_after(groups, first.tail(1)[0], page=10)
    rows = second.select("name", "score", "n_recs").collect()
    return idx.sparkSession.createDataFrame(rows, "name string, score int, n_recs long").withColumn("remaining", F.lit(search.remaining(seen, 10)).cast("long"))


@query("list_counts", "SELECT p_brand AS l, count(*) AS n_records FROM part GROUP BY p_brand")
def _(t):
    return search.counts_by_list(search.index(_parts(t)))


@query("list_cards", "SELECT CAST(r_regionkey AS INTEGER) AS pos, n_name AS id, CASE WHEN count(s_suppkey) > 0 THEN format('{:,}', count(s_suppkey)) ELSE '—' END AS shown FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    order = t("nation").select(F.col("n_regionkey").alias("pos"), F.col("n_name").alias("list_id"))
    lists = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("n_name").alias("short_name"), F.col("r_name").alias("agency_short"))
    counts = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("l")).agg(F.count(F.lit(1)).alias("n_records"))
    return search.list_cards(order, lists, counts).select("pos", "id", "shown")


@query("orphan_check", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def _(t):
    docs = t("orders").select("o_orderkey", F.col("o_custkey").alias("list_id"))
    return search.unknown_lists(docs, t("customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("id"))).select("o_orderkey")


@query("distinct_aliases_top8", "WITH o AS (SELECT p_brand, p_name, min(p_partkey) AS f FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY f) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM o) SELECT p_brand AS nn, string_agg(p_name, '; ' ORDER BY f) FILTER (i <= 8) AS aliases, any_value(n) > 8 AS more_aliases FROM r GROUP BY p_brand")
def _(t):
    rows = t("part").select(F.col("p_brand").alias("nn"), F.col("p_brand").alias("n"), F.lit(1).alias("score"), F.col("p_brand").alias("l"), F.col("p_type").alias("c"), F.array("p_name").alias("a"), F.col("p_partkey").alias("ord"), *[F.lit("").alias(x) for x in ("ad", "s", "d", "fr", "no")])
    return search.cards(rows, search.grouped(rows)).select("nn", F.array_join("aliases", "; ").alias("aliases"), "more_aliases")


@query("checklist_progress", "SELECT toxic AS \"group\", count(*) FILTER (quality = 1) AS done, count(*) AS total FROM labels GROUP BY toxic")
def _(t):
    return search.progress(t("labels").select(F.col("toxic").alias("group"), (F.col("quality") == 1).alias("checked")))


@query("benchmark_containment", f"WITH d AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents), b AS (SELECT item_id, {NORM.format('text')} AS q FROM benchmark) SELECT item_id, doc_id FROM b JOIN d ON contains(t, q)")
def _(t):
    """The benchmark's items are the stated queries, against all documents."""
    return search.containing(t("documents").select("doc_id", text.norm(F.col("text")).alias("t")), t("benchmark").select("item_id", text.norm(F.col("text")).alias("q")))


# --- text, dates and names --------------------------------------------------------------------------------------


@query("norm_documents", f"SELECT doc_id, {NORM.format('text')} AS k FROM documents")
def _(t):
    return t("documents").select("doc_id", text.norm(F.col("text")).alias("k"))


@query("norm_pages", f"SELECT page_id, {NORM.format('html')} AS k FROM pages")
def _(t):
    return t("pages").select("page_id", text.norm(F.col("html")).alias("k"))


@query("typography", "SELECT doc_id, " + TYPO.format("'“' || text || '” – ‘x’ ''''y'") + " AS s FROM documents")
def _(t):
    return t("documents").select("doc_id", text.typography(F.concat(F.lit("“"), "text", F.lit("” – ‘x’ ''y"))).alias("s"))


@query("collapse_ws", f"SELECT doc_id, {WS.format('text')} AS s FROM documents")
def _(t):
    return t("documents").select("doc_id", text.collapse_ws(F.col("text")).alias("s"))


_DASHED = "replace(text, 'th', 'x- \n th')"


@query("dehyphenate", rf"SELECT doc_id, regexp_replace(regexp_replace({_DASHED}, '([\p{{L}}\p{{N}}\p{{M}}_])-\s+([a-z])', '\1\2', 'g'), '([\p{{L}}\p{{N}}\p{{M}}_])-\s+([A-Z0-9])', '\1-\2', 'g') AS s FROM documents")
def _(t):
    return t("documents").select("doc_id", text.dehyphenate(F.replace("text", F.lit("th"), F.lit("x- \n th"))).alias("s"))


@query("clean_text", rf"WITH d AS (SELECT doc_id, {WS.format(TYPO.format("replace(text, 'th', 'x- ‘th')"))} AS s FROM documents) SELECT doc_id, regexp_replace(regexp_replace(s, '([\p{{L}}\p{{N}}\p{{M}}_])-\s+([a-z])', '\1\2', 'g'), '([\p{{L}}\p{{N}}\p{{M}}_])-\s+([A-Z0-9])', '\1-\2', 'g') AS s FROM d")
def _(t):
    return t("documents").select("doc_id", text.clean_text(F.replace("text", F.lit("th"), F.lit("x- ‘th"))).alias("s"))


@query("clean_name", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE '\"' || c_name || ' ,;' END AS cleaned FROM customer")
def _(t):
    raw = F.when(F.col("c_custkey") % 3 == 2, "  \t ").otherwise(F.concat(F.lit(' "'), "c_name", F.lit("  ,; ")))
    return t("customer").select("c_custkey", text.clean_name(raw).alias("name"), text.clean(raw).alias("cleaned"))


@query("superscripts", "SELECT c_custkey, 'Uni (' || c_name || ')' || CASE WHEN c_custkey % 2 = 0 THEN ' x' ELSE '' END AS s FROM customer")
def _(t):
    raw = F.concat(F.lit("Uni  ("), "c_name", F.lit(")"), F.when(F.col("c_custkey") % 2 == 0, " x").otherwise(""), (F.col("c_custkey") % 10).cast("string"), F.lit(" Error! Bookmark not defined."))
    return t("customer").select("c_custkey", text.drop_superscript(raw).alias("s"))


@query("sorted_countries", "SELECT string_agg(p_type, '|' ORDER BY p_type) AS countries FROM (SELECT DISTINCT p_type FROM part)")
def _(t):
    return checks.countries(_parts(t)).select(F.array_join("countries", "|").alias("countries"))


@query("probes", "SELECT n_name AS name, count(s_suppkey) AS hits FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    entities = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return checks.probes(entities, t("nation").select(F.col("n_name").alias("name")))


@query("strip_tags", "SELECT page_id, '<' || CAST(page_id AS VARCHAR) || '> & “é” €' AS s FROM pages")
def _(t):
    return t("pages").select("page_id", text.strip_tags(F.concat(F.lit("<p class='a'>&lt;"), F.col("page_id").cast("string"), F.lit("&gt;</p>&amp;<b> &ldquo;&eacute&rdquo;&nbsp;&#x20ac;</b>"))).alias("s"))


_CUT = "CASE WHEN contains(left({0}, {1}), ' ') THEN {1} - instr(reverse(left({0}, {1})), ' ') ELSE -1 END"


@query("truncate_note", f"WITH d AS (SELECT doc_id, {WS.format('text')} AS c FROM documents), e AS (SELECT *, {_CUT.format('c', 250)} AS b FROM d) SELECT doc_id, CASE WHEN length(c) <= 250 THEN c ELSE rtrim(left(c, CAST(CASE WHEN b < 210 THEN 250 ELSE b END AS BIGINT)), ' ,;') || '...' END AS s FROM e")
def _(t):
    return t("documents").select("doc_id", text.truncate_note(F.col("text")).alias("s"))


@query("truncate_ellipsis", "SELECT doc_id, CASE WHEN length(text) <= 250 THEN text ELSE regexp_replace(left(text, 249), ' [^ ]*$', '') || '…' END AS s FROM documents")
def _(t):
    return t("documents").select("doc_id", text.truncate(F.col("text")).alias("s"))


@query("license_trunc", f"WITH d AS (SELECT doc_id, {WS.format('text')} AS c FROM documents) SELECT doc_id, CASE WHEN length(c) <= 200 THEN c ELSE rtrim(left(c, 197)) || '...' END AS s FROM d")
def _(t):
    return t("documents").select("doc_id", text.license_note(F.col("text")).alias("s"))


@query("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS s FROM pages")
def _(t):
    return t("pages").select("page_id", text.escape_html(F.col("html")).alias("s"))


@query("title_country", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Republic of The ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) ELSE upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' and Sons' END AS s FROM customer")
def _(t):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("REPUBLIC OF THE "), "c_mktsegment", F.lit(", X"))).otherwise(F.concat("c_mktsegment", F.lit(" AND SONS")))
    cased = text.title_country(raw, ("of", "and", "for"))
    return t("customer").select("c_custkey", cased.alias("s"))


@query("footnote_digits", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 5 OR p_size = 45 THEN CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' Unit ' || p_size END ELSE CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_size ELSE p_name || ' Unit ' || p_size END END AS s FROM part")
def _(t):
    raw = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 2 == 1, "Unit"), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", text.strip_footnote(raw).alias("s"))


@query("variant_keys", r"SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS alnum, regexp_replace(upper(c_name), '\W', '', 'g') AS variant FROM customer")
def _(t):
    return t("customer").select("c_custkey", text.alnum_key(F.col("c_name")).alias("alnum"), text.variant_key(F.col("c_name")).alias("variant"))


_DATES = "SELECT o_orderkey, o_orderdate, month(o_orderdate) AS m, day(o_orderdate) AS d, year(o_orderdate) AS y FROM orders"


@query("date_norm", f"WITH o AS ({_DATES}) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown ' || m ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM o")
def _(t):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" unknown  "), F.month("o_orderdate").cast("string"))).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return t("orders").select("o_orderkey", dates.slash_date(raw).alias("d"))


@query("date_2digit_pivot", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "13/45/99").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.concat(F.date_format("o_orderdate", "MM/dd/"), F.substring(F.year("o_orderdate").cast("string"), 3, 2)))
    return t("orders").select("o_orderkey", dates.checked_date(raw).alias("d"))


@query("date_month_name", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d') AS e, CASE WHEN o_orderkey % 3 = 0 THEN '[Entry updated 1 time(s), most recently May 7, 2020]' END AS u FROM orders")
def _(t):
    named = F.concat(F.lit("on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.when(F.col("o_orderkey") % 3 == 0, " and May 7, 2020").otherwise("."))
    return t("orders").select("o_orderkey", dates.named_date(named).alias("d"), dates.day_month_date(F.date_format("o_orderdate", "d MMM yyyy")).alias("e"), dates.updates(named).alias("u"))


@query("alias_split", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || '|X Co.' END AS aliases FROM customer")
def _(t):
    raw = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(", a/k/a "), "c_mktsegment")).otherwise(F.concat(F.lit(" A.K.A. "), "c_mktsegment", F.lit("; aka: X Co."))))
    got = t("customer").select("c_custkey", names.split_akas(raw).alias("s"))
    return got.select("c_custkey", "s.name", F.array_join("s.aliases", "|").alias("aliases"))


@query("paren_alias", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '|X' ELSE '' END AS aliases FROM customer")
def _(t):
    raw = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" (a.k.a. "), "c_mktsegment", F.lit("; X)"))).otherwise(""))
    got = t("customer").select("c_custkey", names.paren_akas(raw).alias("s"))
    return got.select("c_custkey", "s.name", F.array_join("s.aliases", "|").alias("aliases"))


@query("suffix_comma_split", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ', Ltd.' ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN '1 Road, City' ELSE 'City, Land' END AS rest FROM supplier")
def _(t):
    raw = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ", Ltd., 1 Road, City").otherwise(", City, Land"))
    return t("supplier").select("s_suppkey", names.suffix_split(raw, names.SUFFIXES).alias("s")).select("s_suppkey", "s.name", "s.rest")


@query("absorb_units", "SELECT s_suppkey, s_name || ', Institute ' || s_suppkey AS name, '9 Road' AS rest FROM supplier")
def _(t):
    raw = F.concat("s_name", F.lit(", Institute "), F.col("s_suppkey").cast("string"), F.lit(", 9 Road"))
    return t("supplier").select("s_suppkey", names.absorb_units(names.suffix_split(raw, names.SUFFIXES), names.UNIT_WORDS, names.ADDRESS_START).alias("s")).select("s_suppkey", "s.name", "s.rest")


_CODES = ["US", "CN", "NM", "ZZ"]


@query("country_code_lookup", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'United States' WHEN 1 THEN 'China' WHEN 2 THEN 'United States' ELSE CASE WHEN n_nationkey % 8 = 3 THEN 'United States' ELSE NULL END END AS country FROM nation")
def _(t):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    segs = F.array(F.lit(" 1 Road"), code, F.when(F.col("n_nationkey") % 8 == 3, "12345").otherwise("x"))
    return t("nation").select("n_nationkey", names.country_of_address(segs).alias("country"))


@query("name_address", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ', JR.' ELSE c_name END AS name, '1 ROAD, CITY' AS address FROM customer")
def _(t):
    raw = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ", JR., 1  ROAD,, CITY, ,").otherwise(",1 ROAD , CITY,"))
    got = t("customer").select("c_custkey", names.name_and_address(raw).alias("s"))
    return got.select("c_custkey", "s.name", names.address_of(F.col("s.rest")).alias("address"))


@query("party_blocks", "SELECT c_custkey, c_name || '=A,' || c_mktsegment || '|Second=' AS parties FROM customer")
def _(t):
    raw = F.concat("c_name", F.lit(" [aka A; a.k.a. "), "c_mktsegment", F.lit("] Second"))
    got = t("customer").select("c_custkey", names.parties(raw).alias("p"))
    return got.select("c_custkey", F.array_join(F.transform("p", lambda x: F.concat(x["name"], F.lit("="), F.array_join(x["aliases"], ","))), "|").alias("parties"))


@query("notes_assembly", "SELECT o_orderkey, nullif(concat_ws('; ', CASE WHEN o_orderstatus <> 'O' THEN 'Status: ' || o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN 'Priority: ' || o_orderpriority END), '') AS notes FROM orders")
def _(t):
    status, priority = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", lists.notes_of(lists.labelled("Status: ", status), lists.labelled("Priority: ", priority)).alias("notes"))


@query("fr_trim", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey || ' FR ' || o_custkey END AS fr FROM orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 4 == 0, " . x").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(" FR "), F.col("o_custkey").cast("string"), F.lit(". 1/2/20.")))
    return t("orders").select("o_orderkey", text.citation(raw).alias("fr"))


# --- merges, order and segments -----------------------------------------------------------------------------------


@query("merge_first_seen", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_min(event_id, event_id) FILTER (event_type = 'click') AS first_click, (SELECT string_agg(event_type, '|' ORDER BY f) FROM (SELECT event_type, min(event_id) AS f FROM events i WHERE i.user_id = o.user_id GROUP BY event_type)) AS types FROM events o GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(merge.first_value("event_type", "event_id").alias("first_type"), F.min_by("event_id", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("first_click"), F.array_join(F.array_distinct(merge.in_order("event_type", "event_id")), "|").alias("types"))


@query("merge_last_nonempty", "SELECT user_id, arg_max(props, event_id) FILTER (event_type <> 'error') AS props FROM events GROUP BY user_id")
def _(t):
    filled = t("events").withColumn("v", F.when(F.col("event_type") != "error", F.col("props")).otherwise(""))
    return filled.groupBy("user_id").agg(merge.last_filled("v", "event_id").alias("props"))


@query("argmax_len", "SELECT source, sha256(max_by(text, (length(text), -doc_id))) AS longest FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.sha2(merge.longest("text", "doc_id"), 256).alias("longest"))


@query("merge_actions", "SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k, arg_min(p_name, p_partkey) AS name, arg_min(p_type, p_partkey) FILTER (p_size > 10) AS location, string_agg(p_brand, ' | ' ORDER BY p_partkey) AS notes, count(DISTINCT lower(p_type)) AS n_aliases FROM part GROUP BY 1")
def _(t):
    acts = t("part").select(F.col("p_name").alias("name"), F.array(F.upper("p_type"), F.lower("p_type")).alias("aliases"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("").alias("location"), F.lit("x").alias("date"), F.lit("y").alias("fr"), F.col("p_brand").alias("note"), F.lit("").alias("extra"), F.col("p_partkey").alias("ord"))
    got = merge.merge_actions(acts, text.alnum_key(F.col("name")))
    return got.select(text.alnum_key(F.col("name")).alias("k"), "name", "location", F.array_join("notes", " | ").alias("notes"), F.size("aliases").cast("long").alias("n_aliases"))


@query("set_key_dedup", "WITH d AS (SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ') AS k FROM documents) SELECT min(doc_id) AS first_id, count(*) AS n FROM d GROUP BY k")
def _(t):
    k = F.sha2(F.array_join(merge.set_key(F.split(F.lower("text"), " ", -1)), " "), 256)
    return t("documents").select("doc_id", k.alias("k")).groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("carry_forward", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events")
def _(t):
    return ordered.carry_forward(t("events"), F.when(F.col("event_type") == "click", F.col("props")), by=["user_id"], ord=["ts", "event_id"], name="last_click").select("event_id", "user_id", "last_click")


@query("block_rownum", "WITH b AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS blk FROM events), m AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, blk ORDER BY event_id) AS r FROM b) SELECT event_id, CAST(blk AS BIGINT) AS blk, event_type = 'view' AND r <= 2 AS tagged FROM m")
def _(t):
    blocks = ordered.block_number(t("events"), F.col("event_type") == "purchase", by=["user_id"], ord=["event_id"])
    return ordered.first_members(blocks, F.col("event_type") == "view", F.lit(2), by=["user_id", "blk"], ord=["event_id"]).select("event_id", "blk", "tagged")


_MINUTES = "CAST(floor(epoch(ts) / 60) AS BIGINT)"


@query("gap_cluster", f"WITH e AS (SELECT event_id, user_id, -{_MINUTES} AS y FROM events), g AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY user_id ORDER BY y DESC) - y > 600 THEN 1 ELSE 0 END AS w FROM e) SELECT event_id, CAST(sum(w) OVER (PARTITION BY user_id ORDER BY y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cluster FROM g")
def _(t):
    y = (-F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)).alias("y")
    return ordered.gap_clusters(t("events").select("event_id", "user_id", y), "y", 600, by=["user_id"]).select("event_id", "cluster")


@query("anchor_cluster", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(-{_MINUTES} AS DOUBLE) AS y FROM events), n AS (SELECT DISTINCT user_id, y, max(y) OVER (PARTITION BY user_id ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND 2000 PRECEDING) AS nx FROM e),
a AS (SELECT user_id, max(y) AS y FROM e GROUP BY user_id UNION ALL SELECT a.user_id, n.nx FROM a JOIN n ON n.user_id = a.user_id AND n.y = a.y WHERE n.nx IS NOT NULL)
SELECT event_id, e.user_id, CAST(count(*) AS INTEGER) AS cluster FROM e JOIN a ON a.user_id = e.user_id AND a.y >= e.y GROUP BY event_id, e.user_id""")
def _(t):
    y = (-F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)).cast("double").alias("y")
    return ordered.anchor_clusters(t("events").select("event_id", "user_id", y), "y", 2000, by=["user_id"]).select("event_id", "user_id", "cluster")


@query("largest_gap", f"WITH e AS (SELECT user_id, event_id, event_type, -CAST(event_id AS DOUBLE) AS y FROM events), n AS (SELECT *, lead(y) OVER w AS nx, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y DESC) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY y DESC)), m AS (SELECT *, max(a) OVER (PARTITION BY user_id) AS k FROM n) SELECT user_id, CAST(a AS BIGINT) AS anchor_no, arg_max((y + nx) / 2, (y - nx, y)) AS boundary FROM m WHERE a > 0 AND a < k AND nx IS NOT NULL GROUP BY user_id, a")
def _(t):
    rows = t("events").select("user_id", "event_type", (-F.col("event_id").cast("double")).alias("y"))
    return ordered.largest_gap(rows, "y", F.col("event_type") == "purchase", by=["user_id"])


@query("tab_cells", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents), c AS (SELECT *, sum(CASE WHEN ord % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS cell FROM l) SELECT doc_id, CAST(cell AS BIGINT) AS cell, coalesce(string_agg(trim(regexp_replace(line, '[\t\r]', ' ', 'g')), chr(10) ORDER BY ord) FILTER (trim(regexp_replace(line, '[\t\r]', ' ', 'g')) <> ''), '') AS text FROM c GROUP BY doc_id, cell")
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).withColumn("line", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("\t"), "line")).otherwise(F.col("line")))
    return ordered.cells(lines, by=["doc_id"]).select("doc_id", "cell", "text")


@query("bullet_segments", r"WITH p AS (SELECT doc_id, unnest(string_split(replace(text, '. ', ').• '), '•')) AS s, generate_subscripts(string_split(replace(text, '. ', ').• '), '•'), 1) - 1 AS pos FROM documents) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = 0 THEN '' WHEN regexp_matches(s, '(?s)^(.*\)\.)(.*)$') THEN trim(regexp_extract(s, '(?s)^(.*\)\.)(.*)$', 1)) ELSE trim(s) END AS bullet, CASE WHEN pos = 0 THEN trim(s) ELSE trim(regexp_extract(s, '(?s)^(.*\)\.)(.*)$', 2)) END AS heading FROM p")
def _(t):
    marked = t("documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(").• ")).alias("t"))
    return ordered.bullets(marked, "t").select("doc_id", "pos", "bullet", "heading")


@query("entry_segments", r"WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?[a-z]\.') AS s FROM documents) SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS segment FROM p")
def _(t):
    return ordered.segments(t("documents").select("doc_id", "text"), "text", r"[a-z]\.").select("doc_id", "pos", "segment")


@query("html_list_items", r"WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS s FROM pages) SELECT page_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, trim(regexp_replace(unnest(s), '<[^>]+>', ' ', 'g')) AS item FROM p")
def _(t):
    items = t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1))).alias("pos", "raw"))
    return items.select("page_id", "pos", F.trim(F.regexp_replace("raw", "<[^>]+>", " ")).alias("item"))


@query("html_title_unescape", f"SELECT page_id, replace({WS.format(chr(39).join(['replace(replace(replace(replace(regexp_extract(html, ', '(?s)<title>(.*?)</title>', ', 1), ', '&lt;', ', ', '<', '), ', '&gt;', ', ', '>', '), ', '&quot;', ', ', chr(34), '), ', '&nbsp;', ', ', ' ', ')']))}, '&amp;', '&') AS title FROM pages")
def _(t):
    return t("pages").select("page_id", text.collapse_ws(text.basic_unescape(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))).alias("title"))


@query("doc_freq", "SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY w")
def _(t):
    return checks.document_frequency(t("documents"), "doc_id", F.split(F.lower("text"), " ", -1))


@query("quality_counts", r"SELECT count(*) AS n, count(DISTINCT p_type) AS countries, count(*) FILTER (p_partkey % 3 = 0) AS with_alias, count(*) FILTER (regexp_matches(p_name, '\s\d{1,2}$')) AS ends_in_digits FROM part")
def _(t):
    return checks.quality(_parts(t)).select("n", "countries", "with_alias", "ends_in_digits")


@query("dup_names", "SELECT p_name AS name, p_type AS country, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return checks.repeated(_parts(t), "name", "country")


@query("semi_dupes", "SELECT p_partkey, p_name IN (SELECT p_name FROM (SELECT p_name, p_type, p_size FROM part GROUP BY ALL HAVING count(*) > 1)) AS again FROM part")
def _(t):
    return checks.with_repeated(t("part"), "again", F.col("p_name"), F.col("p_type"), F.col("p_size")).select("p_partkey", "again")


@query("status_class", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'revoked' END AS cls FROM orders")
def _(t):
    status = F.when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "Active").otherwise("Inactive-Pending Litigation")).otherwise("Revoked")
    return t("orders").select("o_orderkey", text.status_class(status).alias("cls"))


@query("sample_rows", "SELECT p_partkey, p_name FROM part ORDER BY md5('4|' || p_partkey), p_partkey LIMIT 6")
def _(t):
    return checks.sample(t("part"), key=F.col("p_partkey")).select("p_partkey", "p_name")


@query("first_and_last", "(SELECT p_partkey, p_name, 'first' AS \"end\" FROM part ORDER BY p_partkey LIMIT 3) UNION ALL (SELECT p_partkey, p_name, 'last' FROM part ORDER BY p_partkey DESC LIMIT 3)")
def _(t):
    return checks.ends(t("part"), ord="p_partkey").select("p_partkey", "p_name", "end")
