"""Cleaning, dates, names, search and ordered operators: examples, properties and plain-Python twins."""

import html
import json
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.functions import company, dates, names, parens, text
from rosterlake.operators import checks, merge, ordered, search
from rosterlake.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.norm, "Zürich & Søn — “Ł”", "zurich s n"),
        (text.norm, None, ""),
        (text.typography, "‘a’ “b” ''c'' – —", "'a' \"b\" \"c\" - —"),
        (text.collapse_ws, " a  b\t\n c ", "a b c"),
        (text.dehyphenate, "Tech- nology TP- Link é- b", "Technology TP-Link éb"),
        (text.clean, "   ", None),
        (text.clean_name, ' "Acme Co.,;" ', "Acme Co."),
        (text.norm, "Đ ² ﬁ", "2 fi"),
        (text.citation, "79 FR 1, 1/1/20. 80 FR 2.", "79 FR 1, 1/1/20"),
        (text.citation, ". ", None),
        (text.strip_footnote, "Acme Ltd 3", "Acme Ltd"),
        (text.strip_footnote, "Unit 3", "Unit 3"),
        (text.drop_superscript, "Uni (A)1 Error! Bookmark not defined.", "Uni (A)"),
        (text.variant_key, "中国 Co., Ltd", "中国COLTD"),
        (text.escape_html, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"),
        (text.strip_tags, "<b>a&amp;b</b>&nbsp;<i>c</i>", "a&b c"),
        (dates.slash_date, "13/45/2020", "2020-13-45"),
        (dates.slash_date, "1/2/2020 ", "2020-01-02"),
        (dates.named_date, "on March 3, 2021.", "2021-03-03"),
        (dates.day_month_date, "16 Dec 2021", "2021-12-16"),
        (dates.checked_date, "2/30/2020", None),
        (dates.checked_date, "1/2/68", "2068-01-02"),
        (dates.checked_date, "1/2/69", "1969-01-02"),
        (names.country_of_location, "Iran.", "Iran"),
        (names.country_of_location, "based in Iran", None),
        (names.country_of_tail, "Road 1, Tortola, British; Virgin Islands", "British Virgin Islands"),
        (lambda s: text.title_country(s, ("of", "the")), "CRIMEA REGION OF UKRAINE, X", "Crimea Region of Ukraine"),
        (company.smart_title, "XI'AN ZTE CO LTD OF THE HIGH-TECH BRRR", "Xi'an ZTE Co Ltd of the High-Tech BRRR"),
    ],
)
def test_examples(spark, f, given, wanted):
    assert one(spark, f(F.lit(given).cast("string"))) == wanted


def test_clean_name_strips_quotes_before_commas(spark):
    assert one(spark, text.clean_name(F.lit("'Acme', "))) == "Acme'"


def test_truncations(spark):
    s = "word " * 80
    assert one(spark, text.truncate_note(F.lit(s))) == ("word " * 50).strip()[:249].rstrip() + "..."
    assert one(spark, text.truncate_note(F.lit("x" * 300))) == "x" * 250 + "..."
    assert one(spark, text.truncate(F.lit("ab " * 100), 10)) == "ab ab ab…"
    assert one(spark, text.license_note(F.lit("y" * 201))) == "y" * 197 + "..."


def test_balanced_names(spark):
    got = one(spark, parens.trailing_groups(F.lit("SDIC (Xiamen) Co., Ltd. (Limited) (formerly A (B)) (C)")))
    assert (got["name"], got["groups"]) == ("SDIC (Xiamen) Co., Ltd. (Limited)", ["formerly A (B)", "C"])
    got = one(spark, parens.heading_parts(F.lit("X (Group) (also known as Y (Z (W))) (and X subsidiaries: A; B)")))
    assert tuple(got) == ("X (Group)", ["Y (Z (W))"], "A; B")
    assert [tuple(one(spark, parens.heading_parts(F.lit(x)))) for x in ("Plain", "A (b) c", "(Old)", "A (and its subsidiaries)")] == [("Plain", [], None), ("A (b) c", [], None), ("", ["Old"], None), ("A", [], "and its subsidiaries")]
    got = one(spark, parens.live_name(F.lit("Alpha (also known as A (Old); and B) Co. (a/k/a C, and D) and its 2 affiliates.")))
    assert tuple(got) == ("Alpha Co", ["A (Old)", "B", "C", "D"], "and its 2 affiliates")
    assert tuple(one(spark, parens.live_name(F.lit("Beta (Tianjin) Ltd.")))) == ("Beta (Tianjin) Ltd", [], "")


def test_entries(spark):
    rows = [
        "X CO LTD, PO Box 1; Target Type Entity [CMIC-EO13959].",
        'ACME (Chinese Simplified: 顶) CO (a.k.a. "A; f.k.a. "OLD (Chinese Traditional: 老) CO"; a.k.a. B (C; D)), No. 1, Road; Beijing; Issuer Name Acme  Co; Listing Date (CMIC) 03 Jun 2021; Website x.y [CMIC-EO13959] (Linked To: BIG (B LTD).',
        "",
    ]
    got = company.with_entry(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string"), "s").orderBy("i").collect()
    assert [got[0][c] for c in ("name", "aliases", "former", "address", "tag", "linked", "target", "issuer")] == ["X CO LTD", [], [], "PO Box 1", "[CMIC-EO13959]", None, "Entity", None]
    assert [got[1][c] for c in ("name", "aliases", "former", "address", "linked", "issuer", "listing", "uscc")] == ["ACME CO", got[1]["aliases"], ["OLD (CHINESE TRADITIONAL: 老) CO"], "No. 1, Road; Beijing", "BIG (B LTD", "Acme Co", "03 Jun 2021", None]
    assert got[1]["aliases"][:2] == ["A", "OLD CO"] and got[1]["aliases"][-2:] == ["顶", "老"]
    assert (got[2]["name"], got[2]["aliases"], got[2]["address"]) == ("", [], None)


def test_character_references_are_those_of_browsers(spark):
    rows = ["", "no reference", "a &amp; b &lt;c&gt; &quot;&#39;&nbsp;x", "&#8364;&#x20AC;&#X41;&#65 &#65;&#0;&#128;&#x81;&#xD800;&#x110000;&#11;&#65534;&#99999999999999999999;&#x0000041;", "&notit; &notin; &ampamp; &copy &copyx &zzz; &a; && &; &# &#x; & b&", "&NotEqualTilde; &acE; &#128512;&#x1F600;", "a&lt", "&amp;lt;", "&verylongnamethatisnoreferenceatallforsure;"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string").select("i", text.html_unescape(F.col("s")).alias("u"))
    assert [r["u"] for r in df.orderBy("i").collect()] == [html.unescape(x) for x in rows]


def twin(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s)).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=20), min_size=1, max_size=30))
def test_norm_equals_its_twin_and_is_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string").select("s", text.norm(F.col("s")).alias("n")).withColumn("nn", text.norm(F.col("n")))
    for r in df.collect():
        assert r["n"] == twin(r["s"]) == r["nn"] and re.fullmatch("[a-z0-9 ]*", r["n"])


ENTITIES = [
    (1, "a", "Álamo Co", ["Old Alamo"], "China", "Road 1", None),
    (2, "a", "alamo co.", [], "Iran", None, "seafood"),
    (3, "b", "Beta Alamo Group", [f"b{i}" for i in range(10)], None, "", None),
    (4, "b", "中国", [], None, None, None),
]


@pytest.fixture
def idx(spark):
    df = spark.createDataFrame(ENTITIES, "ord long, list_id string, name string, aliases array<string>, country string, address string, notes string")
    return search.index(df.withColumns({c: F.lit(None).cast("string") for c in ("status", "effective_date", "federal_register")}))


@pytest.mark.parametrize(
    ("q", "wanted"),
    [("Alamo Co", {"alamo co": 100}), ("alam", {"alamo co": 85, "beta alamo group": 70}), ("old alamo", {"alamo co": 55}), ("alamo seafood", {"alamo co": 25}), ("zzz", {}), ("group beta", {"beta alamo group": 70})],
)
def test_tiers(idx, q, wanted):
    got = search.search(idx, q)
    assert {r["nn"]: r["score"] for r in got.collect()} == wanted


def test_groups_browse_and_short_queries(spark, idx, tmp_path):
    assert search.search(idx, "é") is None
    got = {r["nn"]: r for r in search.search(idx, "", list_id="b").collect()}
    assert set(got) == {"beta alamo group", ""} and got["beta alamo group"]["score"] == 50
    browsed = search.matching(idx, "", list_id="b")
    cards = {r["nn"]: r for r in search.cards(browsed, search.grouped(browsed)).collect()}
    assert len(cards["beta alamo group"]["aliases"]) == 8 and cards["beta alamo group"]["more_aliases"] and cards[""]["aliases"] == []
    assert [r["l"] for r in search.records(browsed, search.grouped(browsed)).collect()] == ["b", "b"]
    top = search.ranked(search.search(idx, "alamo")).collect()
    assert [(r["name"], r["n_recs"], r["countries"]) for r in top] == [("Álamo Co", 2, ["China", "Iran"]), ("Beta Alamo Group", 1, [])]
    lists = spark.createDataFrame([("a", "State/DDTC"), ("b", "FCC")], "id string, agency_short string")
    assert search.search(idx, "alamo", lists=lists, agency="State").count() == 1
    assert search.search(idx, "é", list_id="zz", lists=lists) is None
    assert search.summary(None).startswith("Type") and search.summary(search.search(idx, "zzz")) == "No matches." and search.summary(search.search(idx, "alamo"), shown=1) == "2 matches, 1 more"
    assert {r[0] for r in lists.select(search.badge(F.col("agency_short"))).collect()} == {"state", "fcc"}
    meta = spark.createDataFrame([("2026", "u", [("a", "A"), ("b", "B")])], "generated string, dcl_url string, lists array<struct<id:string,short_name:string>>")
    sinks.write_bundle(idx.repartition(3), meta, str(tmp_path / "bundle"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "bundle").glob("part-*")))
    bundle = json.loads(text.removeprefix("window.DATA=").strip().rstrip(";"))
    assert bundle["counts"] == {"a": 2, "b": 2} and bundle["lists"]["b"]["short_name"] == "B" and bundle["entities"][3] == {"n": "中国", "l": "b", "k": ""}
    sinks.write_index(idx, str(tmp_path / "index"))
    again = sinks.read_index(spark, str(tmp_path / "index"))
    assert sorted(again.select(*sorted(idx.columns)).collect(), key=str) == sorted(idx.select(*sorted(idx.columns)).collect(), key=str)
    asked = spark.createDataFrame([(1, "alamo co"), (2, "x"), (3, "beta")], "qid long, q string")
    assert {(r["qid"], r["ord"], r["score"]) for r in search.screen(idx, asked).collect()} == {(1, 1, 100), (1, 2, 100), (3, 3, 85)}


def test_merges(spark):
    df = spark.createDataFrame([(2, "B", "", ["x", "X"]), (1, "A", None, ["y"]), (3, "CC", "v", ["x"])], "ord long, n string, f string, a array<string>")
    r = df.agg(merge.first_filled("f").alias("f"), merge.last_filled("n").alias("l"), merge.longest("n").alias("m"), merge.distinct_ignoring_case(F.flatten(merge.in_order("a"))).alias("a")).first()
    assert (r["f"], r["l"], r["m"], r["a"]) == ("v", "CC", "CC", ["y", "x"])
    assert one(spark, merge.notes_not_contained(F.array(*map(F.lit, ["ab", "b", "c"])))) == "ab | c"


def test_anchor_clusters_equal_a_loop(spark):
    values = [float(x) for x in (100, 99, 97.5, 97, 96, 95, 90, 88, 87, 84, 83.9)]
    df = spark.createDataFrame([(k, v) for k in range(2) for v in values], "page int, y double")
    got = {(r["page"], r["y"]): r["cluster"] for r in ordered.anchor_clusters(df, "y", 3.0, by=["page"]).collect()}
    n, anchor = 0, None
    for v in values:
        if anchor is None or anchor - v >= 3.0:
            n, anchor = n + 1, v
        assert got[0, v] == got[1, v] == n


def test_checks(spark, idx):
    ents = spark.createDataFrame([("A 1", ["x"], "C", None), ("B", [], "C", "Subordinate institution of B")], "name string, aliases array<string>, country string, notes string")
    assert tuple(checks.quality(ents).first()) == (2, 1, 1, 1, 1, 0)
    assert {tuple(r) for r in checks.probes(ents, spark.createDataFrame([("B",), ("Z",)], "name string")).collect()} == {("B", 1), ("Z", 0)}
    with pytest.raises(checks.SourceError):
        checks.require_rows(ents.filter("false"), "nothing")


def test_stream_replaces_lists(spark, tmp_path):
    from rosterlake.streaming.refresh import refresh

    src, store, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    (tmp_path / "in").mkdir()
    for k, (month, names_, wanted) in enumerate([(1, ["a", "b"], ["a", "b"]), (3, ["c"], ["c"]), (2, ["late"], ["c"]), (4, ["d"], ["d"])]):
        doc = {"list_id": "L", "source_file": "f", "extracted": f"2026-0{month}", "count": 1, "entities": [{"name": n, "aliases": []} for n in names_]}
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(doc))
        refresh(spark, src, store, ck).awaitTermination(60)
        assert sorted(r["name"] for r in spark.read.parquet(store).collect()) == wanted


def counted_groups(heading):
    """Trailing top-level groups by a plain counter."""
    groups, depth, start = [], 0, None
    for i, ch in enumerate(heading):
        if ch == "(":
            start = i if depth == 0 else start
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0 and start is not None:
                groups.append((start, i))
                start = None
    end, trailing = len(heading), []
    while groups and not heading[groups[-1][1] + 1 : end].strip():
        end = groups[-1][0]
        trailing.insert(0, groups.pop())
    return " ".join(heading[:end].split()), [" ".join(heading[a + 1 : b].split()) for a, b in trailing]


def test_parentheses_of_any_depth_equal_a_counter(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice(["(", ")", "(", ")", "a", " b", ";"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts += ["Acme (formerly " + "(" * 50 + "x" + ")" * 50 + ")", "N " + "(" * 700 + ")" * 700 + " (c)", "x (ab)"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r["i"]: (r["g"]["name"], r["g"]["groups"]) for r in df.select("i", parens.trailing_groups(F.col("s")).alias("g")).collect()}
    for i, s in enumerate(texts):
        assert got[i] == counted_groups(s.replace("", " ")), s
    deep = "(" * 50 + "x" + ")" * 50
    assert tuple(one(spark, parens.heading_parts(F.lit(f"Acme (formerly {deep})")))) == ("Acme", [deep], None)
    assert tuple(one(spark, parens.live_name(F.lit(f"Acme (also known as B {deep}; and C) Co. (x (a/k/a D (E)) y")))) == ("Acme Co. (x y", [f"B {deep}", "C", "D (E)"], "")
    row = company.with_entry(spark.createDataFrame([(f"ACME {deep} CO (a.k.a. B {deep}; f.k.a. C), 1 Road (x;y); City; Target Type Entity [CMIC-EO13959].",)], "s string"), "s").first()
    assert (row["name"], row["aliases"], row["former"], row["address"]) == (f"ACME {deep} CO", [f"B {deep}", "C"], ["C"], "1 Road (x;y); City")


def test_document_frequency_counts_ids(spark):
    rows = [(1, "a b a"), (2, "b c"), (3, "")]
    for more in ([], [(1, "a d"), (1, "a b a"), (None, "a"), (None, "a e")]):
        df = spark.createDataFrame(rows + more, "id long, t string").repartition(3)
        ids = {}
        for i, t in rows + more:
            for w in t.split(" "):
                ids.setdefault(w, set()).add(i)
        assert {r["w"]: r["df"] for r in checks.document_frequency(df, "id", F.split("t", " ", -1)).collect()} == {w: len(s) for w, s in ids.items()}
