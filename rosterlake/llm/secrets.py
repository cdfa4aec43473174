"""Secret scans with corpus-wide ownership, in DataFrame operations alone.

Base spans: three patterns, leftmost and non-overlapping each, found by splitting the text at the matches and adding
up the lengths of the pieces, in time linear in the text. The method adds spans of kind `owned`: candidate tokens (runs of 16 or more with letters
and digits, and the values of base spans) are hashed and aggregated over the corpus by distinct owners and distinct
repositories. A candidate that at most `max_owners` owners and at most `max_repos` repositories hold is live-looking;
one that more hold, be it inside one owner, is a copied example and is left alone. OP8_SQL has the bound on owners only:
it gives the same rows as long as no candidate of so few owners stands in more than `max_repos` distinct texts.

Owners are the documents' sources, repositories their distinct texts, so an exact copy is no second witness.

Skew: distinct (candidate, owner) and (candidate, repository) pairs are made first, with map-side combining, so a
candidate that a third of all rows hold is a few rows when it is counted. Copied candidates that hold more than 1/4096
of the pairs are dropped by a broadcast of their (at most 4096) hashes before spans are joined. The text is scanned
once and written as narrow rows; only documents with candidates are joined, by the digest of their text, where the
digests that more than 1/4096 of these rows have are joined by broadcast.

Defined cases: null and empty texts have no spans and the digest of the empty string; repeated rows are scanned each;
matches too short for their pattern are consumed and dropped; an empty table gives no rows; a null owner is one owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, let, pieces, running, stored, table

#: kind: (pattern, group whose length counts, its least length, cheap test of a whole text). Fixed by the contract.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
}
#: The same matches with the least length inside the pattern: a run too short for it holds no other match.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Whole runs of 16 or more that hold a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}"
ORDER = [*KINDS, "owned"]
_SPAN = "array<struct<start:int,kind:int,end:int,value:string,value_start:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def spans_of(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Spans of the matches whose group has `least` characters; offsets count code points, ends are exclusive.

    For group 1 the value ends the match, as in every pattern here.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.length)
    steps = F.zip_with(gaps, whole, lambda g, m: g + F.length(m))
    ends = let(running(steps, lambda a, x: a + x), lambda sums: F.slice(sums, 2, F.size(sums)))
    rows = F.arrays_zip(ends.alias("end"), whole.alias("m"), value.alias("v"))
    long = F.filter(rows, lambda x: F.length(x["v"]) >= least)
    return F.transform(long, lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(ORDER.index(kind)).alias("kind"), x["end"].alias("end"), x["v"].alias("value"), (x["end"] - F.length(x["v"])).alias("value_start"))).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """All base spans; a cheap test of the whole text goes before the walk over its matches."""
    return F.concat(*[F.when(text.rlike(hint), spans_of(text, LONG.get(kind, pattern), group, least, kind)).otherwise(_none()) for kind, (pattern, group, least, hint) in KINDS.items()])


def candidate_spans(text: Column) -> Column:
    return F.when(text.rlike(CANDIDATE), spans_of(text, CANDIDATE, 0, 16, "owned")).otherwise(_none())


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spotted(docs: DataFrame, *, text: str, owner: str, keep: list[Column]) -> DataFrame:
    """`keep` as struct row, with the text's digest, owner, base spans and candidates. Narrow, no shuffle."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = docs.select(F.struct(*keep).alias("row"), F.col(owner).cast("string").alias("owner"), body.alias("text"))
    base = given.select("row", "owner", F.sha2("text", 256).alias("repo"), base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("loose"))
    of_base = F.transform("base", lambda s: F.struct(s["value_start"].alias("start"), F.lit(ORDER.index("owned")).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["value_start"].alias("value_start")))
    return base.select("row", "owner", "repo", "base", F.concat(of_base.cast(_SPAN), "loose").alias("candidates"))


def owned_spans(found: DataFrame, max_owners: int, max_repos: int, *, parts: int = 4096) -> DataFrame:
    """(repo, added): for each text with live-looking candidates, their spans."""
    each = found.filter(F.size("candidates") > 0).select("owner", "repo", F.explode("candidates").alias("s")).withColumn("k", F.sha2("s.value", 256))
    owners = each.select("k", "owner").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("owners"))
    repos = each.select("k", "repo").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("repos"))
    counts = stored(owners.join(repos, "k"), "ownership")
    live = counts.filter((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("k")
    often = counts.agg((F.sum("repos") / parts).alias("n")).scalar()
    copied = counts.filter((F.col("repos") > max_repos) & (F.col("repos") > often)).select("k")  # fewer than `parts`
    rest = each.join(F.broadcast(copied), "k", "left_anti").select("repo", "k", "s").distinct()
    return rest.join(live, "k").groupBy("repo").agg(F.collect_list("s").alias("added"))


def _scanned(docs: DataFrame, text: str, owner: str, keep: list[Column], max_owners: int, max_repos: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What spotted gives, the added spans by repo, and the repos that many rows with candidates have."""
    found = stored(spotted(docs, text=text, owner=owner, keep=keep), "spotted")
    added = stored(owned_spans(found, max_owners, max_repos), "owned")
    return found, added, stored(hot_keys(found.filter(F.size("candidates") > 0), "repo"), "hot-repos")


def scan(docs: DataFrame, *, text: str = "text", owner: str = "source", keep: list[Column] | None = None, max_owners: int = 3, max_repos: int = 10) -> DataFrame:
    """`keep` (default: all columns) as struct row, with the text's digest `repo`, and the arrays base and added."""
    found, added, hot = _scanned(docs, text, owner, [docs[c] for c in docs.columns] if keep is None else keep, max_owners, max_repos)
    without = found.filter(F.size("candidates") == 0).select("row", "repo", "base", _none().alias("added"))
    having = hot_join(found.filter(F.size("candidates") > 0), added, "repo", hot).select("row", "repo", "base", F.coalesce("added", _none()).alias("added"))
    return having.unionByName(without)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans (sorted) replaced by `mark`."""

    def of(reach: Column) -> Column:
        opens = F.filter(F.zip_with(spans, F.slice(reach, 1, F.size(spans)), lambda s, at: F.struct(at.alias("start"), s["start"].alias("end"))), lambda c: c["end"] >= c["start"])
        kept = pieces(text, F.concat(opens, F.array(F.struct(F.element_at(reach, -1).alias("start"), F.length(text).alias("end")))))
        return F.array_join(kept, mark)

    return let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), of)


def redact(docs: DataFrame, *, text: str = "text", owner: str = "source", mark: str = "[SECRET]", max_owners: int = 3, max_repos: int = 10) -> DataFrame:
    """The documents with base and owned spans replaced by `mark`; overlapping spans are one. Columns stay as given."""
    found, added, hot = _scanned(docs, text, owner, [F.lit(0).alias("none")], max_owners, max_repos)
    base = found.filter(F.size("candidates") > 0).select("repo", "base").dropDuplicates(["repo"])  # base spans are candidates too
    marked = base.join(added, "repo", "left").select("repo", F.array_sort(F.concat("base", F.coalesce("added", _none()))).alias("spans")).filter(F.size("spans") > 0)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(text)}"
    named = plain.withColumn("body", F.coalesce(F.col(own).cast("string"), F.lit("")))
    suspect = F.lit(False)
    for _, _, _, hint in KINDS.values():
        suspect = suspect | F.col("body").rlike(hint)
    suspect = suspect | F.col("body").rlike(CANDIDATE)
    clean = named.filter(~suspect)
    got = hot_join(named.filter(suspect).withColumn("repo", F.sha2("body", 256)), stored(marked, "secret-spans"), "repo", hot)
    got = got.withColumn(own, F.when(F.col("spans").isNull(), F.col(own)).otherwise(redacted(F.col("body"), F.col("spans"), mark))).select(*plain.columns)
    return got.unionByName(clean.select(*plain.columns)).toDF(*names)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scan(docs, keep=[F.col("doc_id")])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == ORDER.index(k))).cast("long")
    return got.select("row.doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "added")).alias("spans"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, 0 AS kind, 6 AS least_, string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gap, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS v FROM d
  UNION ALL SELECT r, 1, 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, 24, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT r, 3, 16, string_split_regex(t, '[A-Za-z0-9_-]+'), regexp_extract_all(t, '[A-Za-z0-9_-]+'), regexp_extract_all(t, '[A-Za-z0-9_-]+') FROM d),
e AS (SELECT r, kind, least_, i, len(gap[i]) AS g, m[i] AS m, v[i] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a)),
f AS (SELECT r, kind, least_, m, v, sum(g + len(m)) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_ FROM e),
s AS (SELECT r, kind, CAST(end_ - len(m) AS BIGINT) AS start_, CAST(end_ AS BIGINT) AS end_, v FROM f WHERE len(v) >= least_ AND (kind < 3 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))),
cand AS (SELECT DISTINCT r, end_ - len(v) AS start_, end_, v FROM s),
live AS (SELECT v FROM cand JOIN d USING (r) GROUP BY v HAVING count(DISTINCT coalesce('x' || source, 'null')) <= 3 AND count(DISTINCT t) <= 10),
al AS (SELECT r, kind, start_, end_ FROM s WHERE kind < 3 UNION ALL SELECT r, 3, start_, end_ FROM cand WHERE v IN (SELECT v FROM live)),
txt AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start_ || ':' || end_, ',' ORDER BY start_, kind, end_) AS every,
  string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start_ || ':' || end_, ',' ORDER BY start_, kind, end_) FILTER (kind < 3) AS base FROM al GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN txt USING (r)
"""
