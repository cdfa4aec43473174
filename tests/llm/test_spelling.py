"""op13: near pairs and forms against plain Python, the query against its SQL on odd rows."""

import random

import duckdb
from pyspark.sql import functions as F

from rosterlake.llm import spelling
from rosterlake.llm.common import shared_dir

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    out = []
    near = {w: sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v.encode())) for w in words}
    form = {w: vs[0] if vs and words[vs[0]] >= 5 * words[w] else None for w, vs in near.items()}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_forms_equal_plain_comparison_of_all_words(spark):
    rng = random.Random(13)
    words = {}
    while len(words) < 500:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[w] = 5 ** rng.randint(1, 8)
        if rng.random() < 0.5:  # near ones, often of a word's end or beginning
            i = rng.choice([0, len(w), rng.randint(0, len(w))])
            v = w[:i] + rng.choice(["", "x", "ÿ"]) + w[i + rng.randint(0, 1) :]
            if len(v) >= 6:
                words[v] = words[w] * rng.choice([1, 5, 25])
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), 5)
    assert sorted(map(tuple, got.select(*NAMES).collect()), key=repr) == expected(words)


def test_a_common_beginning_does_not_bring_all_pairs_together(spark):
    """3,000 words with one first chunk: 4.5 million pairs share it; the keys bring a small part together."""
    rng = random.Random(5)
    words = spark.createDataFrame([("prefix" + "".join(rng.choice("abcdefghij") for _ in range(6)), 5) for _ in range(3000)], "word string, n long").dropDuplicates(["word"])
    met = spelling.chunk_keys(words).join(spelling.gram_keys(words), "key").filter("w <> v").count()
    assert met < 60_000


def test_chains_of_forms_end_at_their_root(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(27)] + [("x", "w05")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(links).collect()} == {**{f"w{i:02}": "w27" for i in range(27)}, "x": "w27"}


def test_query_equals_its_sql_on_odd_rows(spark, odd):
    folder = f"{shared_dir(spark)}/odd-words"
    more = spark.createDataFrame([(i, "Anderson ANDERSON andersen×straße ÀÉÎõü " * (i % 7), None, None, None) for i in range(60)] + [(1000, "q" * 70_000 + " " + ("q" * 70_000 + " ") * 5, None, None, None)], odd.select("doc_id", "text", "lang", "source", "n_chars").schema)
    rows = odd.unionByName(more.withColumns({c: F.lit("mine") for c in odd.columns[5:]})).withColumns({c: F.lit("mine") for c in ("word", "run", "h", "w", "v", "root")})
    rows.repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet') WHERE length(text) < 100000 OR text IS NULL")
    wanted = con.sql(spelling.OP13_SQL).select(", ".join(NAMES)).fetchall()
    got = spelling.op13_spelling_variants(spark, folder).select(*NAMES).collect()
    assert sorted((tuple(r) for r in got if len(r["word"]) < 1000), key=repr) == sorted(wanted, key=repr)
    assert sum(len(r["word"]) > 1000 for r in got) == 1
    rows.filter("false").write.mode("overwrite").parquet(f"{folder}/none/documents.parquet")
    assert spelling.op13_spelling_variants(spark, f"{folder}/none").collect() == []
