"""URL filters by a ratio of character language models; Spark expressions only.

Rules by host and path decide the URLs they fit. The others are judged by two variable-order Markov models
of characters, one of the URLs that rules allow and one of those they block. Each order is smoothed by the
next lower one. The mean log-likelihood difference a character decides, from a cut on that is calibrated on
URLs that rules have judged and whose characters were not counted. Characters are folded to a fixed alphabet, so the
ratios of all grams of ORDER characters are an array of a bounded size, whatever the input, in which each URL's grams
are looked up in place: no row leaves its task to be scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.llm.words import lowered
from lettermill.session import materialize

#: Rules (host and beginning of the path) and what they say.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Characters that stand for themselves; digits count as 0, all others as *. ^ stands before the first.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-._~:/?#[]@!$&'()+,;=%*^"
#: Characters of a gram. There are at most len(ALPHABET) ** ORDER of them: 133 thousand.
ORDER = 3
#: Weight of the lower order in smoothing, in observations.
SMOOTH = 4.0
#: Steps of scores in which the cut is sought.
STEP = 0.001


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return lowered(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, null if none does."""
    best = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # later ones go first in the chain
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        best = F.when(fits, F.lit(rule)).otherwise(best)
    return best


def folded(url: Column) -> Column:
    """A URL in the alphabet, without the marks before its first character."""
    text = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[0-9]", "0")
    return F.regexp_replace(text, r"(?s)[^a-z0\-._~:/?#\[\]@!$&'()+,;=%]", "*")


def codes(text: Column) -> Column:
    """The numbers of a folded URL's characters in ALPHABET, in order."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _grams(numbers: Column) -> Column:
    """The number of the gram that ends at each character; marks stand before the first."""
    size, n = len(ALPHABET), F.size(numbers)
    padded = F.concat(F.array_repeat(F.lit(ALPHABET.index("^")), ORDER - 1), numbers)
    found = F.slice(padded, 1, n)
    for k in range(1, ORDER):
        found = F.zip_with(found, F.slice(padded, k + 1, n), lambda before, last: before * size + last)
    return found


def _ratios(grams: DataFrame) -> DataFrame:
    """(gram, allow, block), counts of grams that were seen, to one row: ratios, an array with a place for each gram there can be.

    A ratio is the log of both models' likelihoods.
    """
    kinds, size = ("allow", "block"), len(ALPHABET)
    table = grams.sparkSession.range(size**ORDER).withColumnRenamed("id", "gram").withColumns({f"{k}_p": F.lit(1.0 / size) for k in kinds})
    for n in range(1, ORDER + 1):
        # Counts of the last n characters, and of the n - 1 before the last, of all grams.
        tail, before = F.expr(f"gram % {size**n}"), F.expr(f"gram % {size**n} div {size}")
        seen = grams.groupBy(tail.alias("__t")).agg(*(F.sum(k).alias(f"__{k}_t") for k in kinds))
        context = grams.groupBy(before.alias("__b")).agg(*(F.sum(k).alias(f"__{k}_b") for k in kinds))
        table = table.join(F.broadcast(seen), tail == F.col("__t"), "left").join(F.broadcast(context), before == F.col("__b"), "left")
        none = F.lit(0.0)
        table = table.withColumns({f"{k}_p": (F.coalesce(f"__{k}_t", none) + SMOOTH * F.col(f"{k}_p")) / (F.coalesce(f"__{k}_b", none) + SMOOTH) for k in kinds})
        table = table.select("gram", *(f"{k}_p" for k in kinds))
    pairs = table.select(F.struct("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio")).alias("r"))
    return pairs.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["ratio"]).alias("ratios"))


def calibrates(url: Column) -> Column:
    """URLs whose characters aren't counted, for the cut: about 3 in 16, by the first digit of an MD5."""
    return F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 1) < "3"


def score(pages: DataFrame, rules: dict[str, str] = RULES) -> tuple[DataFrame, float]:
    """(page_id, host, path, rule, ruled, score) and the cut that allowed URLs' scores reach.

    A URL without characters scores 0. Characters are counted over the URLs that rules judge, without those that
    calibrate. The cut is set by the latter (see _cut); it is minus infinity if there are none of either kind.
    """
    host, path = parts(F.col("url"))
    ruled = F.create_map(*(F.lit(x) for r in rules.items() for x in r))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), codes(folded(F.col("url"))).alias("codes"), calibrates(F.col("url")).alias("held"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", ruled[F.col("rule")])
    single = base.where(F.col("ruled").isNotNull() & ~F.col("held")).select("ruled", F.explode(_grams(F.col("codes"))).alias("gram"))
    counts = single.groupBy("gram").agg(*(F.count_if(F.col("ruled") == k).cast("double").alias(k) for k in ("allow", "block")))
    # The models reach the tasks as a constant of the plan, whose size doesn't depend on the input (about 3 MB).
    ratios = F.from_json(F.lit(_ratios(materialize(counts, "grams")).select(F.to_json("ratios")).first()[0]), "array<double>")
    total = F.aggregate(_grams(F.col("codes")), F.lit(0.0), lambda acc, g: acc + F.get(ratios, g))
    mean = F.coalesce(total / F.nullif(F.size("codes"), F.lit(0)), F.lit(0.0))
    scored = materialize(base.select("page_id", "host", "path", "rule", "ruled", "held", mean.alias("score")), "scored")
    return scored, _cut(scored.where("held and ruled is not null"))


def _cut(scored: DataFrame) -> float:
    """The score from which on URLs are allowed so that the shares of allowed ones below and of blocked ones from it on are least.

    Scores are counted in steps of STEP, of which there is a bounded number; the middle between the best step and
    the one before it is taken. Minus infinity without URLs of both kinds.
    """
    steps = scored.groupBy(F.floor(F.col("score") / STEP).alias("k")).agg(*(F.count_if(F.col("ruled") == kind).alias(kind) for kind in ("allow", "block")))
    order, every = W.orderBy("k"), W.partitionBy(F.lit(0))
    below = order.rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("missed", F.coalesce(F.sum("allow").over(below), F.lit(0)) / F.nullif(F.sum("allow").over(every), F.lit(0)))
    steps = steps.withColumn("passed", 1 - F.coalesce(F.sum("block").over(below), F.lit(0)) / F.nullif(F.sum("block").over(every), F.lit(0))).withColumn("prev", F.coalesce(F.lag("k").over(order), "k"))
    row = steps.where("missed is not null and passed is not null").agg(F.min(F.struct(F.round(F.col("missed") + F.col("passed"), 9).alias("error"), "k", "prev")).alias("best")).first()
    return float("-inf") if row.best is None else (row.best.k + row.best.prev) / 2 * STEP


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (the rule's, else allow from the cut on), score.

    Null URLs and those without :// have an empty host and path and no rule. Rows that repeat a page stay
    rows of their own. Other columns are ignored; an empty table gives none.
    """
    scored, cut = score(pages, rules)
    own = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.round("score", 9).alias("score"))


def accept(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The pages judged allowed: page_id, host, path."""
    return judge(pages, rules).where(F.col("verdict") == "allow").select("page_id", "host", "path")
