"""URL filters by a character language-model ratio, in DataFrame operations alone.

Two variable-order Markov models are counted from the URLs that the rules accept and reject. The probability of a
character after contexts of length 0 to ORDER is interpolated with the share of new characters after each context
(Witten-Bell): p_k = c / (n + t) + t / (n + t) * p_(k-1), where an unseen context leaves p_(k-1) as it is. The score is
the difference of the two log-likelihoods divided by the length. A fifth of the rules' URLs, by the hash of host and path (so
copies stay together), is kept out of the counts; the threshold is the one that splits these with the least mean error of
the two classes. Where they lack a class, all of the rules' URLs calibrate.

Size: nothing is folded, cut or hashed. The last ORDER + 1 characters up to a character (its window) fix all its grams and
contexts, so windows are counted exactly, in a distributed aggregation with map-side combining (a hot URL is a few
rows), and the counts of all orders and the log ratio of each window follow from that one table. Rows then look their
windows up by equi-join. Only windows that hold at least 1 / `cells` of all characters are broadcast, so at most `cells`
of them, and what is left for the shuffle has no hot key; results are the same for any `cells`.

Defined cases: a null url or one without :// has empty host, path and text, score 0; a class without URLs has a flat
model; without URLs that a rule fits the threshold is 0; longest rule wins; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table

#: verdict, host, start of the path. Fixed by the contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
ORDER, UNIFORM, PAD, END = 3, 1 / 128, "\x02", "\x03"


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))).otherwise(out)
    return out


def positions(rows: DataFrame, text: str, piece: int = 512) -> DataFrame:
    """The other columns of `rows`, a row for each character of `text` and its end, with the window that ends there.

    Long texts are cut into pieces that overlap by ORDER characters first, so that the work stays linear.
    """
    keys = [c for c in rows.columns if c != text]
    padded = F.concat(F.lit(PAD * ORDER), F.col(text), F.lit(END))
    wide = rows.select(*keys, padded.alias("padded"), F.length(text).alias("len"))
    cut = wide.select(*keys, "padded", "len", F.explode(F.sequence(F.lit(0), F.col("len"), F.lit(piece))).alias("off"))
    cut = cut.select(*keys, F.substring("padded", F.col("off") + 1, F.lit(piece + ORDER)).alias("part"), (F.col("len") - F.col("off")).alias("left"))
    each = cut.select(*keys, "part", F.explode(F.sequence(F.lit(0), F.least(F.col("left"), F.lit(piece - 1)))).alias("i"))
    return each.select(*keys, F.substring("part", F.col("i") + 1, F.lit(ORDER + 1)).alias("gram"))


def ratios(windows: DataFrame) -> DataFrame:
    """(gram, ratio): log p(block model) - log p(allow model) of each window's last character, from its counts allow, block.

    From the shortest grams up: gain is c / (n + t) of a gram, keep is t / (n + t) of its context. A context has no more
    rows than there are characters, and so has the end of a gram that the next shorter one is joined by.
    """
    by_order = [windows.select("gram", "allow", "block")]
    for _ in range(ORDER):
        by_order.insert(0, by_order[0].groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    lower = None
    for k, grams in enumerate(by_order):
        same = Window.partitionBy(F.substring("gram", 1, k))
        parts = []
        for v in ("allow", "block"):
            n, t = F.sum(v).over(same), F.count_if(F.col(v) > 0).over(same)
            parts += [F.coalesce(F.try_divide(F.col(v), n + t), F.lit(0.0)).alias(f"gain_{v}"), F.coalesce(F.try_divide(t, n + t), F.lit(1.0)).alias(f"keep_{v}")]
        each = grams.select("gram", *parts)
        if lower is None:
            each = each.withColumns({f"p_{v}": F.lit(UNIFORM) for v in ("allow", "block")})
        else:
            each = each.withColumn("end", F.substring("gram", 2, k)).join(lower.withColumnRenamed("gram", "end"), "end")
        lower = each.select("gram", *[(F.col(f"gain_{v}") + F.col(f"keep_{v}") * F.col(f"p_{v}")).alias(f"p_{v}") for v in ("allow", "block")])
    return lower.select("gram", (F.log("p_block") - F.log("p_allow")).alias("ratio"))


def scores(rows: DataFrame, cells: int) -> DataFrame:
    """(id, score) of every row (id, text, verdict), ids being unique; rows with a verdict are the training set.

    The score is the mean over the characters of log p(block model) - log p(allow model). Ratios are summed as decimals,
    so that no digit hangs on the order of the rows or on what is broadcast.
    """
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    windows = stored(positions(rows.select("verdict", "text"), "text").groupBy("gram").agg(of("allow"), of("block"), F.count(F.lit(1)).alias("n")), "url-grams")
    values = windows.select("gram", "n").join(ratios(windows), "gram").select("gram", "n", F.col("ratio").cast("decimal(18,12)").alias("ratio"))
    values = stored(values, "url-ratios")
    often = F.col("n") >= windows.agg((F.sum("n") / cells).alias("least")).scalar()
    near = positions(rows.select("id", "text"), "text").join(F.broadcast(values.filter(often).select("gram", "ratio")), "gram", "left")
    near = stored(near.groupBy("id", F.when(F.col("ratio").isNull(), F.col("gram")).alias("gram")).agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n")), "url-parts")
    far = near.filter("gram IS NOT NULL").select("id", "gram", "n").join(values.filter(~often).select("gram", "ratio"), "gram")
    parts = near.filter("gram IS NULL").select("id", "total", "n").unionByName(far.select("id", (F.col("ratio") * F.col("n")).cast("decimal(28,12)").alias("total"), "n"))
    return parts.groupBy("id").agg(F.round(F.sum("total").cast("double") / F.sum("n"), 9).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score above which a URL is blocked, from (score, verdict); scores are counted by thousandths."""
    clipped = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.round("score", 3)))
    bins = scored.groupBy(clipped.alias("x")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda c: F.coalesce(F.try_divide(F.sum(c).over(upto), F.sum(c).over(whole)), F.lit(0.0))
    errors = bins.select("x", (F.lit(1.0) - share("a") + share("b")).alias("error"), F.coalesce((F.col("x") + F.lead("x").over(Window.orderBy("x"))) / 2, F.col("x")).alias("mid"))
    return errors.agg(F.coalesce(F.min_by("mid", F.struct("error", "x")), F.lit(0.0)).alias("threshold"))


def kept_apart(text: Column) -> Column:
    """Is the URL one of the fifth that calibrates?"""
    return F.pmod(F.xxhash64(text), F.lit(5)) == 0


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, cells: int = 1 << 16) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row; the rules' own URLs train and calibrate."""
    u = F.col(url).cast("string")
    plain = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    plain = plain.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    plain = plain.withColumn("apart", kept_apart(F.col("text"))).withColumn("id", F.monotonically_increasing_id())
    plain = stored(plain, "urls")
    learned = F.when(~F.col("apart"), F.col("fit.verdict"))
    found = stored(scores(plain.select("id", "text", learned.alias("verdict")), cells), "url-scores")
    empty = (F.col("host") == "") & (F.col("path") == "")
    got = plain.join(found, "id").withColumn("score", F.when(empty, F.lit(0.0)).otherwise(F.col("score")))
    known = got.filter("fit IS NOT NULL").select("score", "fit.verdict", "apart")
    both = known.filter("apart").agg((F.count_distinct("verdict") == 2).alias("x")).scalar()
    cut = stored(threshold(known.filter(F.col("apart") | ~both).select("score", "verdict")), "url-threshold")
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > cut.select("threshold").scalar(), "block").otherwise("allow"))
    return got.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
