"""Quality rules: learned decision lists over text statistics.

``text_stats`` computes the statistics of each whole text with built-in functions. ``learn_rules`` is sequential
covering: on labelled rows it grows one conjunction of thresholds at a time (FOIL gain, from histograms of binned
statistics), prunes it on held-out rows, and goes on with the rows that no rule covers yet. Each step is one Spark
aggregation of a few hundred groups, so only histograms come to the driver. The list becomes one ordered ``CASE``.

Defined results: a null or empty text has no words, zero statistics, and fails the base rule. Labels that are null, or
of documents without text, are not learned from; without labels, or with one class only, the list is empty and only the
base rule rejects. Rows that repeat an id are each judged. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.shared import materialize

#: What separates words.
_SPACE = r" \t\n\x0B\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns of ``keep``), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_digits, n_distinct, n_ends.

    The steps are separate projections, so that no array is computed twice.
    """
    names = ["doc_id", *keep]
    got = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    got = got.select(*names, "t", F.btrim("t", F.lit(" \t\n\x0b\f\r")).alias("trimmed"))
    got = got.select(
        *names,
        "t",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", f"[{_SPACE}]+")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{_SPACE}]")).alias("lines"),
    )
    got = got.select(
        *names,
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^0-9]+", "")).alias("n_digits"),
        F.length(F.regexp_replace("t", r"[^.!?]+", "")).alias("n_ends"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        # one number for each 3-word window
        F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
        ).alias("win"),
    )
    # only texts with a window found twice go on to the positions
    got = got.withColumn("win", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.col("win")))
    got = got.withColumn("win", F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    got = got.withColumn(
        "at", F.filter("win", lambda x, i: (x["h"] == F.get("win", i - 1)["h"]) | (x["h"] == F.get("win", i + 1)["h"]))
    )
    got = got.withColumn("at", F.sort_array(F.transform("at", lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    return got.select(
        *names, *[F.col(c).cast("long").alias(c) for c in longs], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_upper", "n_digits", "n_ends", "n_distinct"
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """The statistics that rules may test."""
    return {
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "upper_ratio": _ratio("n_upper", "word_chars"),
        "digit_ratio": _ratio("n_digits", "word_chars"),
        "end_ratio": _ratio("n_ends", "n_words"),
        "distinct_ratio": _ratio("n_distinct", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _log2(x: float) -> float:
    return log2(x) if x > 0 else -60.0


def learned_labels(labels: DataFrame, bad: Column, id_col: str = "doc_id", max_rows: int | None = 200_000) -> DataFrame:
    """doc_id, bad of the labels that rules are learned from: all, or about ``max_rows`` by a hash of the id."""
    known = labels.select(F.col(id_col).alias("doc_id"), bad.alias("bad")).where("bad IS NOT NULL AND doc_id IS NOT NULL")
    if max_rows is not None and (total := known.count()) > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1e6 * max_rows / total))
    return known.dropDuplicates(["doc_id"])


def learn_rules(
    stats: DataFrame,
    labels: DataFrame,
    bad: Column,
    id_col: str = "doc_id",
    max_rows: int | None = 200_000,
    n_bins: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 4,
) -> list[Rule]:
    """Rules that find rows for which ``bad`` (over the columns of ``labels``) holds.

    stats: as ``text_stats`` returns them. max_rows bounds the labelled rows that are learned from, by a hash of the
    id. Of each three of these rows two grow rules and one prunes them. A rule is kept only with ``min_precision`` on
    the pruning rows as well as on the growing ones.
    """
    names = list(features())
    rows = (
        stats.where(~base_failed())
        .join(learned_labels(labels, bad, id_col, max_rows), "doc_id")
        .select((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0).alias("prune"), "bad", *[x.alias(n) for n, x in features().items()])
    )
    rows = materialize(rows, "labelled-stats")
    cuts = rows.agg(*[F.percentile_approx(n, [i / n_bins for i in range(1, n_bins)], 2000).alias(n) for n in names]).first()
    thresholds = {n: sorted(set(cuts[n] or [])) for n in names}
    binned = materialize(
        rows.select("prune", "bad", *[reduce(lambda a, t, n=n: a + (F.col(n) > t).cast("int"), thresholds[n], F.lit(0)).alias(n) for n in names]), "binned-stats"
    )

    def holds(c: tuple[str, bool, int]) -> Column:
        return F.col(c[0]) > c[2] if c[1] else F.col(c[0]) <= c[2]

    def covered(rule) -> Column:
        return reduce(lambda a, b: a & b, [holds(c) for c in rule], F.lit(True))

    def histogram(left: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names]))
        found = left.select("bad", pairs.alias("x")).groupBy("x.name", "x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in found:
            out[r["name"]][r["bin"]] = (r["p"], r["n"])
        return out

    def widened(rule) -> Rule:
        """The rule with each threshold moved to the middle of its gap: the last value outside, the 5 % of bad rows nearest inside."""
        raw = [Condition(n, above, float(thresholds[n][cut])) for n, above, cut in rule]

        def fits(c: Condition) -> Column:
            return F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold

        inside = reduce(lambda a, b: a & b, [fits(c) for c in raw])
        edges = rows.agg(
            *[(F.max if c.above else F.min)(F.when(~fits(c), F.col(c.feature))) for c in raw],
            *[F.percentile_approx(F.when(inside & F.col("bad"), F.col(c.feature)), 0.05 if c.above else 0.95, 2000) for c in raw],
        ).first()
        outer, inner = edges[: len(raw)], edges[len(raw) :]
        return tuple(c if a is None or b is None else Condition(c.feature, c.above, (a + b) / 2) for c, a, b in zip(raw, outer, inner, strict=True))

    left, rules = binned, []
    while len(rules) < max_rules:
        grow, rule = left.where("NOT prune"), []
        while len(rule) < max_conditions:
            h = histogram(grow.where(covered(rule)))
            p0, n0 = (sum(x[i] for x in h[names[0]].values()) for i in (0, 1))
            if p0 < min_covered or n0 == 0:
                break
            best = None
            for name in names:
                for cut in range(len(thresholds[name])):
                    for above in (True, False):
                        inside = [x for b, x in h[name].items() if (b > cut) == above]
                        p, n = sum(x[0] for x in inside), sum(x[1] for x in inside)
                        if p < min_covered:
                            continue
                        gain = p * (_log2(p / (p + n)) - _log2(p0 / (p0 + n0)))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, (name, above, cut))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
        if not rule:
            break
        # prune: the prefix of the conjunction that is worth most on rows it was not grown on
        counts = left.agg(
            *[F.count_if(covered(rule[:k]) & (F.col("prune") if held else ~F.col("prune")) & (F.col("bad") if good else ~F.col("bad"))) for k in range(1, len(rule) + 1) for held in (True, False) for good in (True, False)]
        ).first()
        options = []
        for k in range(1, len(rule) + 1):
            p, n, gp, gn = counts[4 * (k - 1) : 4 * k]
            if p + n and p / (p + n) >= min_precision and gp / max(1, gp + gn) >= min_precision:
                options.append(((p - n) / (p + n), p, -k))
        if not options:
            break
        k = -max(options)[2]
        rule = rule[:k]
        rules.append(rule)
        left = left.where(~covered(rule))
    return [widened(rule) for rule in rules]


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the number of the first rule that fits, 0 for none."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, [c.column() for c in rules[i - 1]]), F.lit(i)).otherwise(out)
    return out


def judge_quality(docs: DataFrame, labels: DataFrame, bad: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of each document, base_failed, rule (the first that rejects, else 0) and kept.

    With columns to ``keep``, which may be wide, statistics stay beside them and those of labelled documents are
    computed once more, to learn from; else they are written once, as both the learner and the result read them. The ids
    that are learned from (a bounded number, ``learned_labels``) go to every task, so that no text is shuffled.
    """
    if keep:
        known = materialize(learned_labels(labels, bad, id_col), "learned-labels")
        ids = F.broadcast(known.select(F.col("doc_id").alias(id_col)))
        learned_from = materialize(text_stats(docs.select(id_col, text_col).join(ids, id_col, "left_semi"), id_col, text_col), "text-stats")
        rules = learn_rules(learned_from, known, F.col("bad"), "doc_id", max_rows=None)
        # filters on statistics must stay above the steps that compute them, each of which uses the one before more than once
        stats = text_stats(docs, id_col, text_col, keep).withColumn("__order", F.monotonically_increasing_id()).where("__order >= 0")
    else:
        stats = materialize(text_stats(docs, id_col, text_col), "text-stats")
        rules = learn_rules(stats, labels, bad, id_col)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
