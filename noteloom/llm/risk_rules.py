"""Quality rules whose cutoffs are certified on labelled documents; DataFrame operations only.

Every rule compares two counts of a text by an integer cutoff from a grid fixed beforehand. In
each stratum (language) and for each cutoff the documents labelled good are a sample of what
the rule would wrongly reject: with n of them, k rejected, the exact binomial tail
P(Bin(n, a) <= k) is a p-value for "it rejects more than a share a of good documents". A cutoff
counts as certified when its p-value is at most delta / m, m being the number of all tests over
strata, rules and cutoffs (Bonferroni), so with probability 1 - delta no certified cutoff
rejects more than its share anywhere. The strictest certified cutoff of each rule and stratum
applies; a rule without one doesn't reject there. The shares of the rules add up to ``risk``.

Nulls and edge cases: a null text has no words and fails the base rule; a null language is the
stratum ``und``; null labels and labels of unknown documents don't count; several labels of one
document count as its largest; repeated documents are judged each; without labels only the base
rule decides; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.shared import only, written

#: name -> (left count, factor, right count, more is worse, grid from strict to lax);
#: it rejects where factor * left > cutoff * right (or < if fewer is worse).
RULES: dict[str, tuple[str, int, str, bool, tuple[int, ...]]] = {
    "symbols": ("n_symbols", 1000, "word_chars", True, (10, 20, 30, 50, 80, 120, 200)),
    "dup_lines": ("n_dup_lines", 100, "n_lines", True, (5, 10, 20, 30, 50)),
    "repeats": ("n_repeat_words", 100, "n_words", True, (5, 10, 15, 20, 30, 40)),
    "long_words": ("word_chars", 10, "n_words", True, (65, 70, 75, 80, 90, 100, 150)),
    "short_words": ("word_chars", 10, "n_words", False, (45, 40, 35, 30, 20)),
}
RISK, DELTA = 0.02, 0.05
_SPLIT = r"[\x20\x09-\x0D]+"


def text_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(documents, "doc_id", "lang", "text").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _SPLIT), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    codes = rows.select(
        "doc_id", "lang", "n_words",
        F.length(F.regexp_replace("text", _SPLIT, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    # A window is told by the hash of its three words' hashes; get() is null past the end.
    last = F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))
    windows = codes.withColumn("windows", F.transform(F.slice("codes", F.lit(1), last), lambda x, i: F.xxhash64(x, F.get(F.col("codes"), i + 1), F.get(F.col("codes"), i + 2)))).drop("codes")
    # Only texts with some window twice are sorted; equal windows then stand side by side.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ranked = windows.withColumn("ranked", F.when(twice, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("windows")

    def repeated(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("ranked"), i - 1)["h"])
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == F.get(F.col("ranked"), i + 1)["h"], F.lit(False))

    marked = ranked.withColumn("places", F.sort_array(F.transform(F.filter("ranked", repeated), lambda x: x["i"]))).drop("ranked")
    # Windows cover three words each; neighbours overlap, so a window adds the gap to the one before, at most three.
    covered = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    return marked.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rejects(rule: str, cutoff: Column) -> Column:
    left, factor, right, more, _ = RULES[rule]
    a, b = F.lit(factor) * F.col(left), cutoff * F.col(right)
    return a > b if more else a < b


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, shifted back."""
    y = x + 8.0
    shift = F.log(x * (x + 1.0) * (x + 2.0) * (x + 3.0)) + F.log((x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y) - shift


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Bin(n, share) <= k); 1 where k is not below n * share.

    Terms are added from k downward: they shrink geometrically, by more than any that are left
    out could add, so about 40 standard deviations' worth of them are all that count.
    """
    n, k = n.cast("double"), k.cast("double")
    top = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share))
    terms = F.least(k, 40.0 * F.sqrt(n * share) + 400.0).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - j) / (n - k + j + 1.0) * ((1 - share) / share)).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(k < n * share, F.least(F.exp(top) * step, F.lit(1.0))).otherwise(F.lit(1.0))


def certified_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(lang, one column a rule): the strictest certified cutoff, null where none is."""
    good = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = counts.where(~base_failed()).join(good, "doc_id")
    tests = [(rule, c) for rule, (*_, grid) in RULES.items() for c in grid]
    seen = held.groupBy("lang").agg(F.count("*").alias("n"), *(F.count_if(_rejects(rule, F.lit(c))).alias(f"{rule}_{c}") for rule, c in tests))
    strata = seen.agg(F.count("*").alias("strata"))
    each = seen.crossJoin(F.broadcast(strata))  # one row
    limit = F.lit(delta) / (F.col("strata") * len(tests))
    share = risk / len(RULES)

    def strictest(rule: str) -> Column:
        grid = RULES[rule][4]
        return F.coalesce(*(F.when(binomial_tail(F.col("n"), F.col(f"{rule}_{c}"), share) <= limit, F.lit(c)) for c in grid)).alias(rule)

    return each.select("lang", *map(strictest, RULES))


def judge(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every document."""
    counts = written(text_counts(documents), "rule-counts")
    cutoffs = written(certified_cutoffs(counts, labels, risk, delta), "rule-cutoffs", 0)
    # A row a stratum; a language may hold a third of all rows, so they go to the rows as long as they are few.
    joined = counts.join(F.broadcast(cutoffs) if cutoffs.count() <= 100_000 else cutoffs, "lang", "left")
    fires = F.lit(False)
    for rule in RULES:
        fires = fires | F.coalesce(_rejects(rule, F.col(rule)), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~fires).alias("kept"))
