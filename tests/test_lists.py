"""Pipelines of the lists on small hand-made sources."""

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import checks, ordered
from rosterlake.plans import list_queries, lists  # noqa: F401
from rosterlake.plans.registry import QUERIES
from rosterlake.sources import files, sinks


def rows(df):
    return [r.asDict(recursive=True) for r in df.orderBy("ord").collect()]


def test_release_orders_read_quotes_line_ends_and_windows_bytes(spark, tmp_path):
    p = tmp_path / "wro.csv"
    p.write_bytes('Entity,WRO/Finding,Country,Status,Effective Date\r\n"Acme ""Best"" Co, a/k/a Acmé",WRO,China,Active,1/2/2020\r\n"x\ny",,,,soon\r\n ,a,b,c,d\r\n'.encode("cp1252"))
    got = rows(lists.release_orders(files.read_csv(spark, str(p))))
    assert [(g["name"], g["aliases"], g["effective_date"], g["notes"]) for g in got] == [('Acme "Best" Co', ["Acmé"], "2020-01-02", "WRO"), ("xy", [], "soon", None)]


def test_denied_persons(spark):
    df = spark.createDataFrame([(1, "JOEL PRADO, JR., INMATE 1, MONTGOMERY, AL, , 36112"), (2, "PEARL (A.K.A. NEI CHU) LI, 1 ROAD, TAIPEI, TW, 100"), (3, ",x"), (4, "FUYI SUN A/K/A FRANK SUN, BOX 9, , CN, ,")], "ord long, Name_and_Address string")
    got = rows(lists.denied_persons(df))
    assert [(g["name"], g["aliases"], g["country"], g["address"]) for g in got] == [
        ("JOEL PRADO, JR.", [], "United States", "INMATE 1, MONTGOMERY, AL, 36112"),
        ("PEARL LI", ["NEI CHU"], "Taiwan", "1 ROAD, TAIPEI, TW, 100"),
        ("FUYI SUN", ["FRANK SUN"], "China", "BOX 9, CN"),
    ]


def test_debarments(spark):
    stat = spark.createDataFrame([(1, "Ahmed, Tariq (a.k.a. Tariq Amin; X)", "79 FR 1", "79 FR 2", "3/4/2020", "1/1/70")], "ord long, `Party Name` string, `Federal Register Notice` string, `Corrected Notice` string, `Corrected Notice Date` string, `Date Of Birth` string")
    got = rows(lists.statutory_debarments(stat))[0]
    assert (got["name"], got["aliases"], got["federal_register"], got["notes"]) == ("Ahmed, Tariq", ["Tariq Amin", "X"], "79 FR 1 (corrected by 79 FR 2, 2020-03-04)", "Date of birth: 1/1/70")
    admin = spark.createDataFrame([(1, "Y", "yes", None, "Reinstated")], "ord long, Name string, `Charging Letter` string, `Debarment Order` string, `Reinstatement` string")
    got = rows(lists.administrative_debarments(admin))[0]
    assert (got["status"], got["notes"]) == ("Reinstated", "Charging letter on file")


def test_entity_list(spark, tmp_path):
    p = tmp_path / "list.txt"
    text = "﻿intro\n\tCountry\n\tAFGHANISTAN\n\tAcme Co., Ltd., a.k.a., the following two aliases:\n—A1; and\n—A2 Ltd.\n1 Road, Kabul.\n\tFor all items subject to the EAR.\n\tPresumption of denial.\n\t79 FR 123, 1/1/20. 80 FR 1.\n\tSubordinate institution\n\tAcademy X, Institute Y, 2 Road.\n\tAll items\n\t80 FR 222\n\tAcademy X, Institute Z, 3 Road.\n\tAll items\n\t80 FR 333\n\tCHINA, PEOPLE'S REPUBLIC OF\n\tB Corp; Street 5\n\tSee § 744\n\t81 FR 444\n\t1 For this entity x\nSupplement No. 5 to Part 744\n\tZ, 1\n"
    p.write_text(text.replace("\n", "\r\n"), encoding="utf-8")
    cells = ordered.cells(files.read_lines(spark, str(p), until="Supplement No. 5 to Part 744"), by=["path"])
    got = rows(lists.entity_list(cells))
    assert [(g["name"], g["aliases"], g["country"], g["address"], g["federal_register"]) for g in got] == [
        ("Acme Co., Ltd.", ["A1", "A2 Ltd."], "Afghanistan", "1 Road, Kabul.", "79 FR 123, 1/1/20"),
        ("Academy X, Institute Y", [], "Afghanistan", "2 Road.", "80 FR 222"),
        ("Academy X, Institute Z", [], "Afghanistan", "3 Road.", "80 FR 333"),
        ("B Corp", [], "China", "Street 5", "81 FR 444"),
    ]


def docx(path, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda c: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in c.split("\n")) + "</w:tc>"
    body = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in table)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')


def test_military_end_users(spark, tmp_path):
    table = [
        ("Country", "Entity", "FR"), ("BURMA", "[Reserved]", ""), ("CHINA, PEOPLE'S REPUBLIC OF", "Beijing Ander Tech. Co., Ltd. No. C22, Yu An Rd.", "85 FR 1, 1/1/20. x"), ("", "The following two subordinate institutions of Big Lab:", ""),
        ("", "Subordinate institution:", ""), ("", "Lab One, Institute of A, 1 Road", ""), ("", "Subordinate instituion", ""), ("", "Lab Two, a.k.a., the following one alias:\n—LT.\n2 Road", "85 FR 2"), ("", "Lab Three, 3 Road"),
    ]
    docx(tmp_path / "meu.docx", table)
    got = rows(lists.military_end_users(files.read_docx_table(spark, str(tmp_path / "meu.docx"))))
    assert [(g["name"], g["aliases"], g["address"], g["federal_register"], g["notes"]) for g in got] == [
        ("Beijing Ander Tech. Co., Ltd.", [], "No. C22, Yu An Rd.", "85 FR 1, 1/1/20", None),
        ("Lab One, Institute of A", [], "1 Road", "85 FR 1, 1/1/20", "Subordinate institution of Big Lab"),
        ("Lab Two", ["LT"], "2 Road", "85 FR 2", "Subordinate institution of Big Lab"),
        ("Lab Three", [], "3 Road", "85 FR 2", None),
    ]
    assert {g["country"] for g in got} == {"China"}


def test_annex(spark):
    lines = [(3, 0, "BEFORE CORP"), (3, 1, "Annex"), (3, 2, "AERO CORP"), (4, 0, "2"), (4, 1, "CHINA- TECH & CO., LTD."), (4, 2, "Billing code 1"), (5, 0, "LATER CORP")]
    df = spark.createDataFrame([("p", *x) for x in lines], "path string, page int, ord int, line string")
    assert [g["name"] for g in rows(lists.annex(df))] == ["AERO CORP", "CHINA-TECH & CO., LTD."]


def test_military_companies_and_removals(spark):
    text = "intro in accordance with\nsection 1260H: Acme Co. (Limited) (formerly Old) (and Acme subsidiaries: A; B) • Because it is. (Section 1260H(g)(1)). Beta Group (also known as B2)\n• Why (Sec- tion x). • More (y). The Deputy Secretary of Defense has determined that the following previously listed entities should be removed today:\nGone\nCo.\n(GC)\nOther Inc.\nThe list of entities designated as"
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"))], "path string, ord int, line string")
    notice = lists.notice_text(df)
    with pytest.raises(Exception, match="markers are missing"):
        lists.military_companies(notice.withColumn("text", F.replace("text", F.lit("section 1260H"), F.lit("x")))).collect()
    got = rows(lists.military_companies(notice))
    assert [(g["name"], g["aliases"], g["notes"]) for g in got] == [
        ("Acme Co. (Limited)", ["Old"], "Listed together with subsidiaries: A; B. | Because it is. (Section 1260H(g)(1))."),
        ("Beta Group", ["B2"], "Why (Section x). More (y)."),
    ]
    assert [r["name"] for r in lists.removals(notice).orderBy("no").collect()] == ["Gone Co. (GC)", "Other Inc."]


def test_research_list(spark):
    frags = [(0, 700, 77, "intro"), (1, 650, 77, "FY24"), (1, 600, 77, "Uni A a.k.a."), (1, 590, 95, "•"), (1, 589, 100, "Alias 1"), (1, 580, 114, "(AX) Alias 2"), (1, 570, 77, "Uni B"), (1, 560, 94, "of Cc2"), (1, 50, 300, "2"), (2, 700, 77, "Table 2: Programs"), (2, 690, 77, "Interests"), (2, 680, 77, "Plan P"), (2, 600, 77, "Any program that meets"), (2, 590, 77, "never")]
    df = spark.createDataFrame([("p", a, float(b), float(c), d) for a, b, c, d in frags], "path string, page int, y0 double, x0 double, text string")
    got = rows(lists.research_list(df))
    assert [(g["name"], g["aliases"], "Table 2" in g["notes"]) for g in got] == [("Uni A", ["Alias 1 (AX) Alias 2"], False), ("Uni B of Cc", [], False), ("Plan P", [], True)]


def test_investment_list(spark):
    one = 'ACME CORP OF CHINA (a.k.a. ACME GROUP; f.k.a. "OLD ACME"), Shanghai, China; Equity Ticker 1 (CN); Issuer Name Acme Corp of China; Target Type Entity; Effective Date (CMIC) 02 Aug 2021; Unified Social Credit Code (USCC) 91X [CMIC-EO13959]. '
    two = "ACME GROUP (a.k.a. ACME CORP OF CHINA; f.k.a. OLD ACME), Shanghai, China; Target Type Entity; Listing Date (CMIC) 03 Jun 2021 [CMIC-EO13959] (Linked To: BIG LTD). "
    three = "ZB TECH CO LTD, No. 1, Road, Beijing; Target Type Entity [CMIC-EO13959]."
    df = spark.createDataFrame([("p", one + two + three)], "path string, text string")
    got = rows(lists.investment_list(df))
    assert [(g["name"], g["aliases"], g["country"], g["effective_date"]) for g in got] == [("Acme Corp of China", ["ACME GROUP", "OLD ACME"], "China", "2021-08-02"), ("ZB Tech Co Ltd", [], "Beijing", None)]
    assert got[0]["notes"] == "Target Type: Entity; Listing Date (CMIC): 03 Jun 2021; USCC: 91X; Program: CMIC-EO13959; Linked To: BIG LTD"


def test_columns_are_read_downward(spark):
    frags = [(0, 700.0, 50.0, "header"), (0, 600.0, 222.0, "c"), (0, 600.0, 50.0, "a"), (0, 590.0, 60.0, "HIGH- T [ CMIC - EO 13959 ] ."), (0, 30.0, 50.0, "footer"), (0, 500.0, 390.0, "d")]
    df = spark.createDataFrame([("p", *f) for f in frags], "path string, page int, y0 double, x0 double, text string")
    assert lists.column_text(df).first()["text"] == "a HIGH-T [CMIC-EO13959]. c d"


def test_sanctions_merge_parties(spark):
    data = [(1, "Act A", "Acme Corp (Chinese entity)", "People's Republic of China", "1/2/98", "Active", "63 FR 1"), (2, "Act B", "ACME, Corp [aka A1; a.k.a. A2] Beta [AKA: B1] [B2]", "operating in Iran", "3/4/2020", "", ""), (3, "Act C", "Gamma (aka G1, and G2) and any successor, sub-unit, or subsidiary thereof", "Iran.", "soon", "", ""), (4, "x", "", "", "", "", "")]
    got = rows(lists.sanctions(spark.createDataFrame(data, "ord long, statute string, entity string, location string, date string, status string, fr string")))
    assert [(g["name"], g["aliases"], g["country"], g["effective_date"]) for g in got] == [("Acme Corp", ["A1", "A2"], "China", "1998-01-02"), ("Beta", ["B1", "B2"], None, "2020-03-04"), ("Gamma", ["G1", "G2"], "Iran", None)]
    assert got[0]["notes"] == "Authority: Act A; imposed 1/2/98; status: Active; 63 FR 1 | Authority: Act B; imposed 3/4/2020"
    assert got[1]["notes"].endswith(" | Location: operating in Iran")


def test_html_lists(spark, tmp_path):
    (tmp_path / "fcc.html").write_text("<table><tr><th>Covered Equipment or Services</th><th>Date</th></tr><tr><td>Gear by <strong>Huawei Inc,</strong> and<br><strong>Kaspersky&nbsp;Lab</strong></td><td>March 12, 2021 and May 3, 2022</td></tr><tr><td>Drones^, all—kinds</td><td>none</td></tr></table><table><tr><td>no</td><td>no</td></tr></table>")
    got = rows(lists.covered_equipment(files.read_html_table(spark, str(tmp_path / "fcc.html"))))
    assert [(g["name"], g["country"], g["effective_date"]) for g in got] == [("Huawei Inc.", "China", "2021-03-12"), ("Kaspersky Lab", "Russia", "2021-03-12"), ("Drones", None, None)]
    assert got[0]["notes"].endswith("[Entry updated 1 time(s), most recently May 3, 2022]") and got[2]["notes"].startswith("Category listing")
    (tmp_path / "saved.html").write_text("<h2>UFLPA Entity List</h2><ul><li>Skip to main</li><li>One Co. aka Uno; Ein</li><li>Two, including its subsidiary X</li><li>Three</li></ul><h3>Labor transfer</h3><table><tr><td>one co.</td><td>2</td></tr></table>")
    got = rows(lists.forced_labor_saved(files.read_html_sections(spark, str(tmp_path / "saved.html"))))
    assert [(g["name"], g["aliases"]) for g in got] == [("One Co.", ["Uno", "Ein"]), ("Two", []), ("Three", [])]
    assert got[0]["notes"] == "UFLPA category: UFLPA Entity List | UFLPA category: Labor transfer"
    t = "<table><tr><td>Name of Entity</td><td>Date</td></tr><tr><td>Alpha (also known as A (Old); and B) and its affiliates.</td><td>June 1, 2022</td></tr></table>"
    (tmp_path / "live.html").write_text(t + "<table><tr><td>ALPHA</td><td>x</td></tr></table>" + "<table></table>")
    got = rows(lists.forced_labor_live(files.read_html_tables(spark, str(tmp_path / "live.html"), expected=3)))
    assert [(g["name"], g["aliases"], g["effective_date"]) for g in got] == [("Alpha", ["A (Old)", "B"], "June 1, 2022")]
    assert got[0]["notes"].count("UFLPA Sec.") == 2 and got[0]["notes"].endswith("; and its affiliates")
    with pytest.raises(Exception, match="expected 4 tables, found 3 in .*live.html"):
        files.read_html_tables(spark, str(tmp_path / "live.html"), expected=4).collect()


def test_documents_round_trip_and_guards(spark, tmp_path):
    doc = {"list_id": "a", "source_file": "f", "extracted": "2026", "count": 1, "entities": [{"name": "Ä", "aliases": ["x"], "country": None, "address": None, "status": None, "effective_date": None, "federal_register": None, "notes": None}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1) + "\n")
    got, missing = files.read_documents(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert missing == [str(tmp_path / "b.json")] and got.count() == 1
    sinks.write_documents(got.withColumn("source_file", F.lit("f")), str(tmp_path / "out"), extracted="2026")
    assert (tmp_path / "out" / "a.json").read_text() == (tmp_path / "a.json").read_text()
    (tmp_path / "empty").write_text("")
    for p in ("empty", "none"):
        with pytest.raises(checks.SourceError):
            files.require_files(spark, str(tmp_path / p))


def test_old_files_stay_where_a_write_fails(spark, tmp_path):
    df = spark.createDataFrame([("a-b", 1, "X"), ("c", 2, "Y")], "list_id string, ord long, name string")
    rows = df.select("*", *[c.alias(n) for c, n in ((F.array(F.lit("q")), "aliases"), *((F.lit(None).cast("string"), f) for f in ("country", "address", "status", "effective_date", "federal_register", "notes")))], F.lit("f").alias("source_file"))
    docs, table = str(tmp_path / "docs"), str(tmp_path / "table")
    sinks.write_documents(rows, docs, extracted="2026")
    sinks.write_entities(rows, table)
    before = {p.name: p.read_text() for p in (tmp_path / "docs").iterdir()}
    assert set(before) == {"a_b.json", "c.json"} and json.loads(before["a_b.json"])["count"] == 1
    bad = rows.withColumn("name", F.when(F.col("list_id") == "c", F.raise_error(F.lit("broken"))).otherwise(F.lit("new")))
    for write in (lambda: sinks.write_documents(bad, docs, extracted="2027"), lambda: sinks.write_entities(bad, table)):
        with pytest.raises(Exception, match="broken"):
            write()
    for wrong, message in ((rows.filter("false"), "nothing was extracted"), (rows.withColumn("name", F.lit("")), "have no name")):
        with pytest.raises(checks.SourceError, match=message):
            sinks.write_entities(wrong, table)
    assert {p.name: p.read_text() for p in (tmp_path / "docs").iterdir()} == before
    assert sorted(r["name"] for r in spark.read.parquet(table).collect()) == ["X", "Y"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["docs", "table"]
    sinks.write_entities(rows.filter("ord = 1"), table)
    assert [r["name"] for r in spark.read.parquet(table).collect()] == ["X"]


def test_samples_do_not_hang_on_partitions(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    wanted = [tuple(r) for r in checks.sample(df).collect()]
    assert len(wanted) == 6 and all([tuple(r) for r in checks.sample(df.orderBy(F.desc("x")).repartition(n)).collect()] == wanted for n in (1, 5))
    assert [tuple(r) for r in checks.sample(df, seed=5).collect()] != wanted
    assert [(r["id"], r["end"]) for r in checks.ends(df, 2, ord="id").collect()] == [(0, "first"), (1, "first"), (4999, "last"), (4998, "last")]


def test_formats_plan_files_and_push_filters(spark, tmp_path, capsys):
    from rosterlake.sources import formats

    formats.register(spark)
    pages = tmp_path / "pages"
    pages.mkdir()
    for k in range(5):
        (pages / f"p{k}.html").write_text(f"<h2>Sec {k}</h2><ul><li>Item {k}</li></ul><table><tr><td>A <strong>S{k}</strong></td><td>b</td></tr></table>")
    at = str(pages)
    items = spark.read.format("list_sections").load(at)
    plain = files.read_html_sections(spark, at)
    assert sorted(map(tuple, items.select("ord", "section_ord", "heading", "item").collect())) == sorted(map(tuple, plain.select("ord", "section_ord", "heading", "item").collect()))
    assert [tuple(r["cells"][0]) for r in spark.read.format("list_table").load(at).orderBy("path").collect()] == [(f"A S{k}", [f"S{k}"]) for k in range(5)]
    (pages / "p9.html").write_text("x")
    one = items.filter((F.col("path") == f"{at}/p3.html") & (F.col("item") != "b"))
    assert [r["item"] for r in one.collect()] == ["Item 3", "A S3"]
    one.explain("formatted")
    assert f"PushedFilters: [EqualTo(path,{at}/p3.html)" in capsys.readouterr().out
    reader = formats._Reader(at, {}, formats._sections)
    assert list(reader.pushFilters([formats.EqualTo(("path",), f"{at}/p3.html"), formats.EqualTo(("item",), "x")])) == [formats.EqualTo(("item",), "x")]
    assert [p.paths for p in reader.partitions()] == [[f"{at}/p3.html"]]
    (tmp_path / "t.txt").write_bytes("\ufeffa\r\n\tb\nEND of\nc".encode())
    lines = spark.read.format("list_lines").option("until", "END").load(str(tmp_path / "t.txt"))
    assert [(r["ord"], r["line"]) for r in lines.orderBy("ord").collect()] == [(0, "a"), (1, "\tb")]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text(json.dumps({"list_id": "a", "entities": [{"name": "Ä", "aliases": ["x"]}, {"name": "B"}]}))
    got = spark.read.format("list_records").load(str(docs)).orderBy("ord")
    assert [(r["list_id"], r["ord"], r["name"], r["aliases"], r["notes"]) for r in got.collect()] == [("a", 0, "Ä", ["x"], None), ("a", 1, "B", None, None)]
    (docs / "bad.json").write_text("{")
    with pytest.raises(Exception, match="cannot read .*bad.json"):
        spark.read.format("list_records").load(str(docs)).collect()
    with pytest.raises(Exception, match="missing"):
        spark.read.format("list_records").load(str(tmp_path / "none")).collect()


def test_small_pages_share_a_frame_and_large_ones_do_not(spark):
    class Pages:
        sparkSession = spark

        def mapInPandas(self, run, schema):
            return run

    run = files.html_sections(Pages())
    small = pd.DataFrame({"path": [str(k) for k in range(1000)], "content": [b"<h2>H</h2><ul><li>a</li><li>b</li></ul>"] * 1000})
    frames = list(run(iter([small])))
    assert len(frames) == 1
    assert list(frames[0].itertuples(index=False, name=None)) == [(str(k), i, 1, "H", x) for k in range(1000) for i, x in enumerate("ab")]
    large = pd.DataFrame({"path": ["l"] * 3, "content": [b"<li>" + b"x" * files.FRAME + b"</li>"] * 2 + [b"no items"]})
    assert [len(f) for f in run(iter([large]))] == [1, 1]


def test_pages_made_of_customers_are_read_by_all_cores(spark):
    got = QUERIES["html_sections_tables"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
