"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

Statistics of each text are built-in expressions. Rules are conjunctions of thresholds on them; each is grown on two thirds of
the labelled rows, condition by condition, by information gain, and pruned on the rest. Every step is one aggregation
that counts both classes beyond all thresholds at once, so no labelled row reaches the driver and none is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, words

#: Words of a window whose repetition counts.
WINDOW = 5
#: Thresholds tried for a statistic: quantiles of its values among the labelled rows.
THRESHOLDS = 24
#: A rule stays if on the rows held back so large a share of what it rejects is bad, and it rejects so many bad ones there.
MIN_PRECISION, MIN_BAD = 0.97, 5
MAX_CONDITIONS = 4
#: First conditions that are tried for a rule, the best first, before covering ends.
SEEDS = 3

def share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


RATIOS = {
    "mean_word": lambda: share("word_chars", "n_words"),
    "symbol_share": lambda: share("n_symbols", "word_chars"),
    "dup_line_share": lambda: share("n_dup_lines", "n_lines"),
    "repeat_share": lambda: share("n_repeat_words", "n_words"),
    "upper_share": lambda: share("n_upper", "word_chars"),
    "mark_share": lambda: share("n_marks", "n_words"),
    "digit_share": lambda: share("n_digits", "word_chars"),
    "distinct_share": lambda: share("n_distinct", "n_words"),
    "n_words": lambda: F.col("n_words").cast("double"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def occurring(text: Column, characters: str) -> Column:
    """How many characters of the text are of a class; only runs of them are touched."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, the statistics, seq): row is the whole row of docs as a struct. A null text counts as empty.

    Words are hashed once; a window's hash is made of those of its words. n_repeat_words is found by sorting the hashes of
    a text's windows with their places; equal neighbours are windows that occur twice. Texts whose windows all differ skip
    that. seq is a number without meaning: as it is not deterministic, a filter on the statistics stays above them, where Spark
    would otherwise compute all of them again inside the filter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), text.alias("text"), words(text).alias("w"))
    base = base.withColumns({"h": F.transform("w", lambda x: F.xxhash64(x)), "word_chars": F.length(F.array_join("w", "")).cast("long")}).drop("w")
    base = base.withColumn("n_words", F.size("h").cast("long"))
    heads = F.slice(F.col("h"), F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))
    win = F.when(F.col("n_words") > WINDOW, F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, WINDOW)))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    base = base.withColumns({"lines": lines, "win": win})
    again = F.size(F.array_distinct("win")) < F.size("win")
    base = base.withColumn("sorted", F.when(again, F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("sorted")
    after = F.slice(F.col("sorted"), 2, F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(F.col("sorted"), after, lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same")))
    base = base.withColumn("equal", F.filter(pairs, lambda p: p["same"]))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("equal", lambda p: F.array(p["i"], p["j"])))))
    base = base.withColumn("places", places)
    later = F.slice(F.col("places"), 2, F.greatest(F.size("places") - 1, F.lit(0)))
    covered = F.aggregate(F.zip_with(F.col("places"), later, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    return base.select(
        "row", "n_words", "word_chars",
        occurring(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        occurring(F.col("text"), "A-Z").alias("n_upper"),
        occurring(F.col("text"), "!?").alias("n_marks"),
        occurring(F.col("text"), "0-9").alias("n_digits"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.monotonically_increasing_id().alias("seq"),
    )


@dataclass(frozen=True)
class Condition:
    """statistic >= threshold, or <= threshold."""

    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = feature(self.name)
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def feature(name: str) -> Column:
    """A ratio of statistics; 0 where its divisor is 0."""
    return F.coalesce(RATIOS[name](), F.lit(0.0))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def counts(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    """(bad, good) rows that each rule covers, in one aggregation."""
    aggs = [F.count_if(holds(r) & F.col("bad")) for r in rules] + [F.count_if(holds(r) & ~F.col("bad")) for r in rules]
    got = rows.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first()
    return list(zip(got[: len(rules)], got[len(rules) :], strict=True))


def spread(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """(bad, good) rows beyond every threshold, on either side.

    Each row says of each statistic how many thresholds it reaches and how many it passes; one small aggregation counts that, and sums of
    its few rows give all conditions.
    """

    def place(name: str, ts: list[float]) -> Column:
        v, every = feature(name), F.array(*map(F.lit, ts))
        return F.struct(F.lit(name).alias("name"), F.size(F.filter(every, lambda t: t <= v)).alias("reached"), F.size(F.filter(every, lambda t: t < v)).alias("passed"))

    places = [place(name, ts) for name, ts in thresholds.items()]
    got = rows.select("bad", F.explode(F.array(*places)).alias("p")).groupBy("p.name", "p.reached", "p.passed").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    out = {}
    for name, ts in thresholds.items():
        own = [r for r in got if r["name"] == name]
        for i, t in enumerate(ts):
            for above in (True, False):
                hit = [r for r in own if (r["reached"] > i if above else r["passed"] <= i)]
                out[Condition(name, above, t)] = sum(r["bad"] for r in hit), sum(r["good"] for r in hit)
    return out


def quantiles(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each statistic: quantiles of its values among all rows and among the bad ones.

    Values are counted by their first three digits, of which a decade has 900, so what the driver gets does not grow with the rows, and the
    same rows always give the same thresholds.
    """
    digits = lambda n: F.format_string("%.2e", feature(n)).cast("double")
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), digits(n).alias("value")) for n in RATIOS]))
    got = rows.select("bad", values.alias("v")).groupBy("v.name", "v.value").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).collect()
    out: dict[str, list[float]] = {}
    for name in RATIOS:
        own = sorted((r["value"], r["n"], r["bad"]) for r in got if r["name"] == name)
        cuts = set()
        for k in (1, 2):
            total, seen, i = sum(r[k] for r in own), 0, 0
            for r in own:
                seen += r[k]
                while i < THRESHOLDS and seen and seen >= (i + 0.5) / THRESHOLDS * total:
                    cuts.add(r[0])
                    i += 1
        out[name] = sorted(cuts)
    return out


def learn(rows: DataFrame, min_precision: float = MIN_PRECISION, min_bad: int = MIN_BAD) -> list[Rule]:
    """The decision list for rows of statistics with `bad` (boolean) and `hold` (boolean: held back for pruning). Covering ends when no
    further rule passes on the rows held back, whatever the number of rules."""
    thresholds = quantiles(rows)
    rules: list[Rule] = []
    while any(thresholds.values()):
        left = rows.filter(~holds_any(rules))
        found, tried = None, set()
        for _ in range(SEEDS):
            rule = grow(left.filter(~F.col("hold")), thresholds, tried)
            if not rule:
                break
            tried.add(rule[0])
            rule = prune(left.filter(F.col("hold")), rule)
            got = left.groupBy("hold").agg(F.count_if(holds(rule) & F.col("bad")).alias("bad"), F.count_if(holds(rule) & ~F.col("bad")).alias("good")).collect()
            bad, good = next(((r["bad"], r["good"]) for r in got if r["hold"]), (0, 0))
            if bad >= min_bad and bad >= min_precision * (bad + good):
                found = rule
                break
        if found is None:
            return rules
        rules.append(found)
    return rules


def grow(rows: DataFrame, thresholds: dict[str, list[float]], without: set[Condition] = frozenset()) -> Rule:
    """Adds the condition of most gain until no good row is covered; the first is none of those given."""
    rule: Rule = ()
    bad, good = counts(rows, [rule])[0]
    while good and bad and len(rule) < MAX_CONDITIONS:
        before = log2(bad / (bad + good))
        found = spread(rows.filter(holds(rule)), thresholds)
        gains = {c: p * (log2(p / (p + n)) - before) for c, (p, n) in found.items() if p and (rule or c not in without)}
        best = max(gains, key=gains.get, default=None)
        if best is None or gains[best] <= 1e-9:
            break
        rule = (*rule, best)
        bad, good = found[best]
    return rule if bad else ()


def prune(rows: DataFrame, rule: Rule) -> Rule:
    """The start of the rule that separates the rows held back best: most (bad - good) / (bad + good), the shorter if equal."""
    found = counts(rows, [rule[:k] for k in range(1, len(rule) + 1)])
    scores = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(found)]
    return rule[: 1 - max(scores)[1]]


def holds_any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | holds(r)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as ordered conditions: the first rule that holds rejects, else the text is kept."""
    if not rules:
        return F.lit(True)
    out = F.when(holds(rules[0]), False)
    for r in rules[1:]:
        out = out.when(holds(r), False)
    return out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Statistics of the labelled rows that the base test passes: `bad` is quality 0. A third, by hash of the id, is held back."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") == 0).alias("bad"))
    rows = stats.filter(~base_failed() & (F.col("seq") >= 0)).join(marks, stats[f"row.{id_col}"] == F.col("label_id"))
    return rows.withColumn("hold", F.pmod(F.xxhash64("label_id"), F.lit(3)) == 0).drop("row", "label_id", "seq")


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(row, statistics, base_failed, kept) for each row of docs, and the rules.

    Texts are read once: rows are written with their statistics, and the learning joins the labels to the statistics alone, so no text is shuffled. A null or empty text has
    no words and fails the base test. Repeated rows are judged alike; labels that repeat count once, the lower quality; labels
    without a row, and rows without a label, do not matter to the learning. Without labels the list is empty, and then the
    base test decides alone. An empty table gives no rows.
    """
    stats = scratch.write(statistics(docs, text_col), "statistics")
    rules = learn(scratch.write(labelled(stats, labels, id_col), "labelled"))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules) & (F.col("seq") >= 0)).drop("seq"), rules


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once: statistics of all documents are written, and the rules learned from and applied to them."""
    scratch = Scratch(spark, "quality")
    stats = scratch.write(statistics(documents(spark, sf_dir).select("doc_id", "text")).withColumn("row", F.struct("row.doc_id")), "statistics")
    rules = learn(scratch.write(labelled(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")), "labelled"))
    return stats.select("row.doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"), F.lit("; ".join(" and ".join(map(str, r)) for r in rules)).alias("rules"))
