"""Quality rules: text statistics by built-in functions and a decision list learned from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Windows of a text up to which hash and place share one number: the hash keeps 51 bits of 64.
SHORT = 4096

#: Ratios the learned rules may use, as expressions over the columns of ``statistics``.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / n_words",
    "bangs_per_word": "n_bangs / n_words",
    "distinct_word_share": "n_distinct_words / n_words",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its id and counts over the whole text, all longs.

    Words are runs of characters other than space and 0x09 to 0x0D. ``n_dup_lines``
    counts lines with a word that equal an earlier line; ``n_repeat_words`` counts
    the words that lie in three-word windows found at least twice, the first one
    included. A null text counts as empty. Repeated rows stay repeated. Only the two
    named columns are read; other columns, whatever their names, do not matter.

    The windows are hashed to 64 bits. In texts of up to ``SHORT`` windows the place is written
    into the low bits and the numbers are sorted, so that equal windows lie side by
    side; that is one primitive sort per text. In longer texts pairs of the full hash and the
    place are sorted, so the hash is not shorter for a longer text. No row leaves its partition.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    base = base.withColumn("words", F.filter(F.split("t", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    base = base.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, _BLANKS, "") != ""))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("t", _BLANKS, "")),
        "n_symbols": _without(F.col("t"), _SYMBOLS),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_digits": _without(F.col("t"), "0123456789"),
        "n_marks": _without(F.col("t"), ".,;:!?"),
        "n_bangs": _without(F.col("t"), "!?"),
        "n_distinct_words": F.size(F.array_distinct("words")),
        "n_upper": F.length("t") - F.length(F.regexp_replace("t", "\\p{Lu}+", "")),
        "n_letters": F.length("t") - F.length(F.regexp_replace("t", "\\p{L}+", "")),
    }
    named = base.select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()], F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    last = F.greatest(F.size("h") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("h", 1, last), F.slice("h", 2, last), lambda a, b: F.xxhash64(a, b))
    windows = named.withColumn("win", F.zip_with(pairs, F.slice("h", 3, last), lambda ab, c: F.xxhash64(ab, c))).drop("h")
    # most texts repeat no window; they skip the sort
    windows = windows.withColumn("win", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.col("win")))
    full = F.sort_array(F.when(F.size("win") > SHORT, F.transform("win", lambda h, k: F.struct(h.alias("h"), k.cast("long").alias("k")))))
    windows = windows.withColumn("full", full).withColumn("win", F.when(F.size("win") <= SHORT, F.col("win")))
    bits = F.ceil(F.log2(F.size("win") + 1)).cast("int")
    windows = windows.withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    keyed = F.transform("win", lambda h, k: h.bitwiseAND(F.bitwise_not("mask")).bitwiseOR(k.cast("long")))
    windows = windows.withColumn("sorted", F.sort_array(keyed))
    n = F.size("sorted")
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("sorted", 1, n - 1))
    after = F.concat(F.slice("sorted", 2, n - 1), F.array(F.lit(None).cast("long")))
    same = lambda a, b: a.bitwiseAND(F.bitwise_not("mask")) == b.bitwiseAND(F.bitwise_not("mask"))
    left = F.zip_with("sorted", before, lambda a, b: F.when(F.coalesce(same(a, b), F.lit(False)), a))
    right = F.zip_with("sorted", after, lambda a, b: F.when(F.coalesce(same(a, b), F.lit(False)), a))
    places = F.transform(F.filter(F.zip_with(left, right, lambda a, b: F.coalesce(a, b)), lambda x: x.isNotNull()), lambda x: x.bitwiseAND(F.col("mask")))
    n = F.size("full")
    apart = F.lit(None).cast("struct<h:bigint,k:bigint>")
    beside = F.zip_with(F.concat(F.array(apart), F.slice("full", 1, n - 1)), F.concat(F.slice("full", 2, n - 1), F.array(apart)), lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
    met = F.zip_with("full", beside, lambda x, by: F.when(F.coalesce((x["h"] == by["a"]) | (x["h"] == by["b"]), x["h"] == by["a"], x["h"] == by["b"]), x["k"]))
    windows = windows.withColumn("places", F.sort_array(F.coalesce(places, F.filter(met, lambda k: k.isNotNull()))))
    n = F.size("places")
    steps = F.zip_with(F.slice("places", 1, n - 1), F.slice("places", 2, n - 1), lambda a, b: F.least(b - a, F.lit(3).cast("long")))
    covered = F.when(n > 0, F.aggregate(steps, F.lit(3).cast("long"), lambda s, x: s + x))
    windows = windows.withColumn("n_repeat_words", F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(covered))
    return windows.drop("win", "mask", "sorted", "full", "places")


# ---- decision list


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"`{self.feature}`")
        return value >= self.threshold if self.above else value < self.threshold


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction; the first that holds rejects, else the row passes."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule_column(self) -> Column:
        """The number of the first rule that holds, from 1; 0 when none does."""
        out: Column | None = None
        for k, rule in enumerate(self.rules, 1):
            held = F.coalesce(_all(rule), F.lit(False))
            out = F.when(held, k) if out is None else out.when(held, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def text(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold:.6g}" for c in rule) for rule in self.rules]


def _all(rule: tuple[Condition, ...]) -> Column:
    held = F.lit(True)
    for condition in rule:
        held = held & condition.column()
    return held


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) rows for which each test holds, in one pass."""
    sums = []
    for k, test in enumerate(tests):
        held = F.coalesce(test, F.lit(False))
        sums += [F.count(F.when(held & F.col("bad"), 1)).alias(f"b{k}"), F.count(F.when(held & ~F.col("bad"), 1)).alias(f"g{k}")]
    row = rows.agg(*sums).first()
    return [(row[2 * k], row[2 * k + 1]) for k in range(len(tests))]


def learn(rows: DataFrame, features: list[str], max_rules: int = 12, max_conditions: int = 3, cuts: int = 24, precision: float = 0.98, least: int = 5) -> DecisionList:
    """A decision list by sequential covering.

    ``rows`` has the features as doubles, ``bad`` as a boolean and ``grow`` as a boolean
    that splits the rows for growing and pruning. A rule starts empty and takes the
    condition with the best gain, bad rows kept times the rise in log precision,
    until it is pure on the growing rows or ``max_conditions`` long. Its last
    conditions are then dropped while that does not lower (bad - good) / (bad + good)
    on the pruning rows. It enters the list when at least ``precision`` of what it
    covers is bad, on both parts, and it covers ``least`` bad rows; covered rows leave,
    and the first rule that does not enter ends the list. Thresholds are quantiles
    of the bad and of all remaining rows. Every step is one aggregation
    over the labelled rows, whose result has one number per candidate condition; no
    row reaches the driver. Without bad or without good rows the list is empty.
    """
    from math import log2

    found = DecisionList()
    rest = cut_lineage(rows.select("bad", "grow", *[F.col(f"`{f}`").cast("double").alias(f) for f in features]))
    quantiles = [(k + 0.5) / cuts for k in range(cuts)]
    while len(found.rules) < max_rules:
        open_rows = rest.where(found.rule_column() == 0)
        growing = open_rows.where("grow")
        (bad, good), = _counts(growing, [F.lit(True)])
        if bad < least or good == 0:
            break
        cut = growing.agg(
            *[F.percentile_approx(f"`{f}`", quantiles, 10_000).alias(f"{f}_all") for f in features],
            *[F.percentile_approx(F.when(F.col("bad"), F.col(f"`{f}`")), quantiles, 10_000).alias(f"{f}_bad") for f in features],
        ).first()
        offered = [
            Condition(f, above, t)
            for f in features
            for t in sorted({*(cut[f"{f}_all"] or []), *(cut[f"{f}_bad"] or [])})
            for above in (True, False)
        ]
        rule: tuple[Condition, ...] = ()
        while len(rule) < max_conditions and good > 0:
            covered = growing.where(_all(rule))
            counts = []
            for k in range(0, len(offered), 100):
                counts += _counts(covered, [c.column() for c in offered[k : k + 100]])
            start = log2((bad + 1) / (bad + good + 2))
            gains = [b * (log2((b + 1) / (b + g + 2)) - start) if b >= least else 0.0 for b, g in counts]
            best = max(range(len(offered)), key=lambda k: (gains[k], -k), default=None)
            if best is None or gains[best] <= 0:
                break
            rule += (offered[best],)
            bad, good = counts[best]
        if not rule:
            break
        prefixes = [rule[:n] for n in range(1, len(rule) + 1)]
        pruned = _counts(open_rows.where(~F.col("grow")), [_all(p) for p in prefixes])
        grown = _counts(growing, [_all(p) for p in prefixes])
        worth = [(b - g) / max(b + g, 1) for b, g in pruned]
        best = max(range(len(prefixes)), key=lambda k: (worth[k], -k))
        pure = all(b >= precision * (b + g) for b, g in (pruned[best], grown[best]))
        if not pure or grown[best][0] < least or pruned[best][0] == 0:
            break
        found.rules.append(prefixes[best])
    return found


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, DecisionList]:
    """(statistics with ``base_failed``, ``rule`` and ``kept`` for every row, the learned list).

    A label of 0 is bad, any other not null label good; ids with labels of both
    kinds are not learned from, nor are texts that fail the base rule. The base rule
    rejects texts of under 50 words and those with more than half of their words in
    repeated windows. ``rule`` is the number of the learned rule that rejects, 0 if
    none does. Without labels only the base rule rejects.
    """
    counted = cut_lineage(statistics(docs, id_col, text_col))
    measured = counted.select("*", *[F.when(F.col("n_words") > 0, F.expr(e)).cast("double").alias(f"f_{n}") for n, e in FEATURES.items()])
    measured = measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    marked = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id"))
    marked = marked.agg(F.min(F.col(f"`{label_col}`") == 0).alias("bad"), F.max(F.col(f"`{label_col}`") == 0).alias("any_bad")).where("bad = any_bad").drop("any_bad")
    training = measured.where(~F.col("base_failed")).join(marked, "doc_id").withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    rules = learn(training, [f"f_{n}" for n in FEATURES])
    judged = measured.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(rules.rule_column()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
