"""The search index and tiered search over it.

An index row has n (name), l (list), optional a, c, ad, s, d, fr, no, the key k over name and aliases, and, computed once
so that no query pays for them, nn (normalized name) and x (normalized country, address and notes).
"""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from rosterlake.functions.text import let, norm
from rosterlake.operators import postings
from rosterlake.operators.postings import Inverted

_PLAIN = set(string.ascii_lowercase + string.digits)
EXACT, PREFIX, IN_NAME, IN_ALIASES, IN_DETAILS, BROWSE = 100, 85, 70, 55, 25, 50


def index(entities: DataFrame) -> DataFrame:
    """The sparse index of entity rows with list_id and ord: empty fields null, long ones cut at 300, 120 and 300."""
    cut = lambda c, n: F.left(F.nullif(c, F.lit("")), F.lit(n))
    rows = entities.select(
        F.col("name").alias("n"), F.col("list_id").alias("l"), F.when(F.size("aliases") > 0, F.col("aliases")).alias("a"), F.nullif("country", F.lit("")).alias("c"), cut("address", 300).alias("ad"),
        F.nullif("status", F.lit("")).alias("s"), F.nullif("effective_date", F.lit("")).alias("d"), cut("federal_register", 120).alias("fr"), cut("notes", 300).alias("no"),
        norm(F.concat_ws(" | ", "name", "aliases")).alias("k"), norm(F.col("name")).alias("nn"), "ord",
    )
    return rows.withColumn("x", norm(F.concat(*[x for c in ("c", "ad", "no") for x in (F.coalesce(c, F.lit("")), F.lit(" "))])))


def unknown_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents whose list is not among the known ones; must be empty before an index is built."""
    return docs.join(lists.select(F.col("id").alias("list_id")), "list_id", "left_anti")


def score(query: Column, name: Column, key: Column, details: Column) -> Column:
    """Tier of a normalized query against normalized fields; 0 for no match."""
    tokens = F.split(query, " ")
    every = lambda *places: F.forall(tokens, lambda t: F.greatest(*[F.contains(p, t).cast("int") for p in places]) == 1) if len(places) > 1 else F.forall(tokens, lambda t: F.contains(places[0], t))
    return F.when(name == query, EXACT).when(F.startswith(name, query), PREFIX).when(every(key), F.when(every(name), IN_NAME).otherwise(IN_ALIASES)).when(every(key, details), IN_DETAILS).otherwise(0)


def family(agency_short: Column) -> Column:
    return F.when(agency_short.startswith("State"), "State").otherwise(agency_short)


def grouped(matches: DataFrame) -> DataFrame:
    """One row for each normalized name: first name seen, best score, records, lists and countries in order of appearance.

    Rows are summed by name, list and country before they meet by name, so a name on any number of rows is a few rows there. Its aliases and
    records are those of a page's groups, see cards() and records().
    """
    parts = matches.groupBy("nn", "l", "c").agg(F.min(F.struct("ord", "n")).alias("first"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    countries = F.transform(F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("first.ord", "c")))), lambda x: x["c"])
    groups = parts.groupBy("nn").agg(F.min("first")["n"].alias("name"), F.max("score").alias("score"), F.sum("n").alias("n_recs"), F.size(F.collect_set("l")).cast("long").alias("n_lists"), countries.alias("countries"))
    return groups.withColumn("countries", F.array_distinct("countries"))


def cards(matches: DataFrame, groups: DataFrame, *, shown: int = 8) -> DataFrame:
    """The groups (a page of them, or all) with their first `shown` distinct aliases in order of appearance, and whether there are more.

    Aliases are made distinct, ranked and cut in every task before they meet.
    """
    each = matches.join(groups.select("nn"), "nn", "left_semi").filter(F.size("a") > 0).select("nn", "ord", F.posexplode("a").alias("pos", "alias"))
    first = each.groupBy("nn", "alias").agg(F.min(F.struct("ord", "pos")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("nn").orderBy("first", "alias"))
    few = first.withColumn("nth", nth).filter(F.col("nth") <= shown + 1).groupBy("nn").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "alias")))), lambda x: x["alias"]).alias("aliases"), (F.max("nth") > shown).alias("more_aliases")
    )
    out = groups.join(few, "nn", "left")
    return out.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "more_aliases": F.coalesce("more_aliases", F.lit(False))})


def records(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """The records of groups as rows, in order: nn, ord and the index fields. No group is gathered."""
    return matches.join(groups.select("nn"), "nn", "left_semi").select("nn", "ord", "l", "n", "a", "c", "ad", "s", "d", "fr", "no").orderBy("nn", "ord")


def ranked(groups: DataFrame, *, page: int = 40, pages: int = 1) -> DataFrame:
    """The first pages of groups: score, then size, then name as a reader would sort it. A top-k, not a full sort."""
    return groups.orderBy(F.desc("score"), F.desc("n_recs"), F.collate("name", "UNICODE"), "nn").limit(page * pages)


def page_after(groups: DataFrame, last: Row | None = None, *, page: int = 40) -> tuple[DataFrame, Observation]:
    """The page of groups behind `last`, the last row of the page before (None: the first), and what counts the rest in the same job.

    Groups before `last` are left out by its place in the order, not ranked again: what a page costs does not grow with the pages before. Once
    the page was read, remaining() tells from the observation how many groups follow it.
    """
    rest = groups
    if last is not None:
        name, seen = F.collate("name", "UNICODE"), F.collate(F.lit(last["name"]), "UNICODE")
        after = (name > seen) | ((name == seen) & (F.col("nn") > last["nn"]))
        after = (F.col("n_recs") < last["n_recs"]) | ((F.col("n_recs") == last["n_recs"]) & after)
        rest = groups.filter((F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & after))
    seen = Observation()
    return ranked(rest.observe(seen, F.count(F.lit(1)).alias("n")), page=page), seen


def remaining(seen: Observation, page: int = 40) -> int:
    """How many groups follow the page whose observation this is."""
    return max(0, seen.get["n"] - page)


def normalized(query: str) -> str:
    """norm of one query, where no table is at hand."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", query) if unicodedata.category(c) != "Mn").lower()
    return " ".join("".join(c if c in _PLAIN else " " for c in plain).split())


def search(idx: DataFrame | Inverted, query: str, *, lists: DataFrame | None = None, list_id: str | None = None, agency: str = "all") -> DataFrame | None:
    """Groups that match; None where matching() is."""
    rows = matching(idx, query, lists=lists, list_id=list_id, agency=agency)
    return None if rows is None else grouped(rows)


def matching(idx: DataFrame | Inverted, query: str, *, lists: DataFrame | None = None, list_id: str | None = None, agency: str = "all") -> DataFrame | None:
    """Index rows that match, with their score; None if the normalized query is shorter than 2 and no list is chosen, whose rows are browsed then.

    Of a written inverted index only the rows that hold the query's rarest word are read.
    """
    plain = normalized(query)
    rows = idx if not isinstance(idx, Inverted) else idx.rows if len(plain) < 2 or not idx.buckets else postings.candidates(idx, list(dict.fromkeys(plain.split())))
    if list_id is not None and lists is None:
        rows = rows.filter(F.col("l") == list_id)
    elif list_id is not None and len(plain) < 2 and lists.filter(F.col("id") == list_id).isEmpty():
        return None  # nothing to browse
    elif list_id is not None or agency != "all":
        # a list nobody knows is no filter
        known = lists.agg((F.count_if(F.col("id") == list_id) > 0).alias("known")).scalar() if list_id is not None else F.lit(False)
        if agency == "all":
            rows = rows.filter((F.col("l") == list_id) | ~known)
        else:
            rows = rows.join(lists.filter(F.when(known, F.col("id") == list_id).otherwise(family(F.col("agency_short")) == agency)).select(F.col("id").alias("l")), "l", "left_semi")
    if len(plain) < 2:
        return rows.withColumn("score", F.lit(BROWSE)) if list_id is not None else None
    return rows.withColumn("score", score(F.lit(plain), F.col("nn"), F.col("k"), F.col("x"))).filter("score > 0")


def screen(idx: DataFrame | Inverted, queries: DataFrame) -> DataFrame:
    """(qid, n, l, ord, score) of many queries (qid, q) at once: index rows, or an inverted index of them, meet the queries by words (see
    postings), and what meets is scored once."""
    of = idx if isinstance(idx, Inverted) else postings.invert(idx)
    asked = queries.select("qid", norm(F.col("q")).alias("q")).filter("length(q) >= 2")
    met = postings.meetings(of, asked)
    key = ["l", "ord"]
    if of.buckets:
        met, key = met.withColumn("b", postings.bucket(of.buckets, "l", "ord")), ["b", "l", "ord"]
    tiers = of.rows.join(met, key).withColumn("score", score(F.col("q"), F.col("nn"), F.col("k"), F.col("x")))
    return tiers.filter("score > 0").select("qid", "n", "l", "ord", "score")


#: Words in the pieces of a text that are looked up.
WINDOW = 4


def _hashes(words: Column, *sizes: int) -> Column:
    """Distinct hashes of each n words in a row, for each n of sizes."""

    def of(ws: Column, n: int) -> Column:
        at = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(ws, i + j) for j in range(n)]))

    return let(words, lambda ws: F.array_distinct(F.concat(*[of(ws, n) for n in sizes])))


def small(df: DataFrame, most: int) -> bool:
    """Whether df has `most` rows or fewer; no more than these are counted."""
    return df.limit(most + 1).count() <= most


def containing(docs: DataFrame, items: DataFrame, *, broadcast_rows: int = 1 << 20) -> DataFrame:
    """(item_id, doc_id): which of the normalized texts docs (doc_id, t) contain which of items (item_id, q), anywhere; a row for each pair of rows.

    The words of an item but its first and last are whole words of a text that contains it. So hashes of WINDOW of them in a row
    (of all, where they are fewer) are looked up among the items' while the texts are read, and only (doc_id, hash) of what is
    found goes on; the hash of an item that fewest texts hold brings it together with them. Items of one or two words are looked up
    by the corpus's words that contain their longer one. What meets is verified once on the text. Texts are neither
    copied nor shuffled, but for those that a pair needs. An item without words is in no text; ids may repeat or be null.
    """
    items = items.filter("q <> ''").select("item_id", "q")
    words = F.split("q", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    asked = items.select("q").distinct().select("q", inner.alias("inner"), F.least(F.size(inner), F.lit(WINDOW)).alias("n"))
    sizes = sorted(r[0] for r in asked.select("n").distinct().collect())  # WINDOW + 1 at most
    wanted = [asked.filter(F.col("n") == n).select("q", F.explode(_hashes(F.col("inner"), n)).alias("h")) for n in sizes if n]
    if 0 in sizes:
        short = asked.filter("n = 0").select("q", F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("tok"))
        pieces = postings.pieces_of(postings.vocabulary(docs.select(F.explode(F.split("t", " ")).alias("w")).filter("w <> ''")))
        met = postings.holding(Inverted(None, None, pieces, postings.frequencies(pieces)), short.select("tok").distinct())
        wanted.append(short.join(met, "tok").select("q", F.xxhash64("w").alias("h")))
        sizes = sorted({*sizes, 1} - {0})
    if not wanted:
        return items.join(docs, F.lit(False)).select("item_id", "doc_id")
    keys = reduce(DataFrame.unionByName, wanted)
    known = keys.select("h").distinct()
    known = F.broadcast(known) if small(known, broadcast_rows) else known
    found = docs.select("doc_id", F.explode(_hashes(F.split("t", " "), *sizes)).alias("h")).join(known, "h", "left_semi")
    return _verified(docs, items, keys, found.distinct())


def _verified(docs: DataFrame, items: DataFrame, keys: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of docs and items for which the item is in the text, from keys (q, h) and found (doc_id, h); all hashes of a q of three words or more must be found."""
    frequency = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counted = keys.join(frequency, "h", "left").withColumn("several", F.size(F.split("q", " ")) > 2)
    # every word that holds a short item is an alternative; of a longer item's hashes each must be there, so the rarest will do
    best = counted.filter("several").groupBy("q").agg(F.min_by("h", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("h"))
    chosen = best.unionByName(counted.filter("NOT several").select("q", "h"))
    pairs = found.join(chosen, "h").select("doc_id", "q").distinct()
    # the semi-join goes below what makes t, so that only texts that a pair needs are normalized again
    some = docs.join(pairs.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    met = some.join(pairs.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).filter(F.contains("t", F.col("q"))).select("doc_id", "q")
    return met.join(items, "q").select("item_id", "doc_id")


def summary(groups: DataFrame | None, shown: int = 40) -> str:
    """What a page says above its results."""
    if groups is None:
        return "Type at least 2 characters."
    n = groups.count()
    if not n:
        return "No matches."
    return f"{n:,} {'match' if n == 1 else 'matches'}" + (f", {n - shown:,} more" if n > shown else "")


#: Badge of each agency. Fixed values.
BADGES = {"DoW": "dow", "Commerce/BIS": "bis", "Treasury/OFAC": "ofac", "State/DDTC": "state", "State/ISN": "state", "FCC": "fcc", "DHS": "dhs", "CBP": "cbp"}


def badge(agency_short: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv]), agency_short), F.lit(""))


def counts_by_list(idx: DataFrame) -> DataFrame:
    return idx.groupBy("l").agg(F.count(F.lit(1)).alias("n_records"))


def list_cards(order: DataFrame, lists: DataFrame, counts: DataFrame) -> DataFrame:
    """Lists in a fixed order with their counts; a list without metadata is left out, one without records has a dash."""
    got = order.join(lists, order["list_id"] == lists["id"]).join(counts, F.col("id") == F.col("l"), "left")
    return got.select("pos", "id", "short_name", "agency_short", F.when(F.coalesce("n_records", F.lit(0)) > 0, F.format_number("n_records", 0)).otherwise("—").alias("shown")).orderBy("pos")


def progress(boxes: DataFrame) -> DataFrame:
    """Checked of all boxes for each group: (group, box_id, checked)."""
    return boxes.groupBy("group").agg(F.count_if("checked").alias("done"), F.count(F.lit(1)).alias("total"))
