"""Quality rules learned as a decision list, with DataFrame expressions only.

Statistics of each document are array and text expressions. On labelled documents the list is
learned by sequential covering: a rule grows one threshold condition at a time, each chosen by
information gain from one grouped count over (feature, threshold bin, label); it is pruned
from the end against the pruning third; it is accepted if it holds on both parts, and the rows
it covers leave. The result is an ordered list of conjunctions, emitted as one CASE
expression: the first matching rule rejects a document, else it is kept.

Bounds: the list is fitted on at most about ``MAX_LABELLED`` labelled rows (chosen by hash);
the driver only sees counts per feature and bin. Thresholds lie midway between quantiles of
the growing part.

Defined results: null or empty text has no words and fails the base rule; rows without label
or id teach nothing; without labelled rows of both classes the list is empty and the base rule
alone decides; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import apart, binary_labels, bounded_sample, cut

MAX_LABELLED = 20_000
SEED = 11
BINS = 48
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule must reject at least this share of rightly rejected rows on the pruning part, and
#: match at least ``MIN_COVER`` rows of each part.
MIN_PRECISION, MIN_COVER = 0.85, 5
#: Fixed values of the base rule.
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50

#: Bits of a packed window that hold its place; the others hold its hash.
PLACE_BITS = 31
SPACE = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share",
            "distinct_share", "upper_share", "digit_share", "mark_share", "words_per_line"]


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window found twice or more. Windows are hashed and packed with
    their places into longs; sorted, neighbours with equal hash bits are candidates. Only their
    strings are compared, so a clash of hashes adds a candidate and no repeat: they sort with
    their places, equal neighbours mark repeats, and the places they cover are counted once."""
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  (evaluates x once)

    def candidates(h: Column) -> Column:
        both = lambda x, y: F.xxhash64(x, y)
        g = F.zip_with(F.zip_with(h, _shifted(h, 1), both), _shifted(h, 2), both)
        g = F.slice(g, 1, F.greatest(F.size(h) - 2, F.lit(0)))
        packed = F.transform(g, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long")))
        return bound(F.sort_array(packed), lambda s: F.array_distinct(F.flatten(F.filter(
            F.zip_with(s, _shifted(s, 1), lambda x, y: F.when(
                F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0, F.array(x, y))),
            lambda x: x.isNotNull()))))

    def placed(x: Column) -> Column:
        i = x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        return F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("g"), i.alias("i"))

    def covered(s: Column) -> Column:
        at = lambda x: [x["i"], x["i"] + 1, x["i"] + 2]
        twice = F.zip_with(s, _shifted(s, 1), lambda x, y: F.when(
            x["g"] == y["g"], F.array(*at(x), *at(y))))
        return F.size(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    same = bound(F.transform(words, lambda w: F.xxhash64(w)), candidates)
    return bound(F.sort_array(F.transform(same, placed)), covered)


def with_statistics(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``out`` of counts and features of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))

    def stats(b: Column) -> Column:
        text_, words, lines = b["t"], b["words"], b["lines"]
        n, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
        chars = F.length(F.array_join(words, "")).cast("long")
        per = lambda x, y: x / F.greatest(y, F.lit(1)).cast("double")
        left = lambda cls: F.length(F.regexp_replace(text_, cls, "")).cast("long")
        n_symbols = left(r"[^#*$%&|<>]+")
        n_dup = (n_lines - F.size(F.array_distinct(lines))).cast("long")
        n_repeat = _repeat_words(words).cast("long")
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), n_symbols.alias("n_symbols"),
            n_dup.alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
            per(chars, n).alias("mean_word"), per(n_symbols, chars).alias("symbol_share"),
            per(n_dup, n_lines).alias("dup_line_share"), per(n_repeat, n).alias("repeat_share"),
            per(F.size(F.array_distinct(words)), n).alias("distinct_share"),
            per(left(r"[^\p{Lu}]+"), chars).alias("upper_share"),
            per(left(r"[^0-9]+"), chars).alias("digit_share"),
            per(left(r"[^!?;:]+"), chars).alias("mark_share"),
            per(n, n_lines).alias("words_per_line"))

    parts = F.struct(
        t.alias("t"), F.filter(F.split(t, SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR)).alias("lines"))
    return docs.withColumn(out, F.transform(F.array(parts), stats)[0])


def base_failed(s: Column) -> Column:
    return ((s["n_words"] < BASE_WORDS)
            | (100 * s["n_repeat_words"] > BASE_REPEAT_PERCENT * s["n_words"]))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def on(self, s: Column) -> Column:
        f = s[self.feature].cast("double")
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = list[Condition]


def matches(rule: Rule, s: Column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.on(s)
    return out


def verdict(rules: list[Rule], s: Column) -> Column:
    """Number of the first matching rule, from 1; null if none matches."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(matches(rules[0], s), F.lit(1))
    for k, r in enumerate(rules[1:], 2):
        out = out.when(matches(r, s), F.lit(k))
    return out


def labelled_statistics(docs: DataFrame, labels: DataFrame, column: str = "quality",
                        bound: int = MAX_LABELLED) -> DataFrame:
    """(s, y, grow, base_failed) of at most about ``bound`` labelled documents. The sampled labels are
    bounded by the parameter, so they are broadcast and no text is shuffled."""
    known = bounded_sample(binary_labels(labels, column), ["doc_id"], bound, SEED)
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .select("doc_id", "text", "y"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED + 1)), F.lit(3)) > 0
    s = F.col("s")
    return with_statistics(rows, "s").select("s", "y", part.alias("grow"),
                                             base_failed(s).alias("base_failed"))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """Information gained over the rejected rows that stay covered."""
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(rows: DataFrame, max_rules: int = MAX_RULES) -> list[Rule]:
    """Decision list for y = 0 from ``labelled_statistics`` rows that pass the base rule."""
    rows = cut(rows).where(~F.col("base_failed"))
    at = [i / BINS for i in range(BINS + 1)]
    numbers = {f: F.col("s")[f].cast("double") for f in FEATURES}
    # Quantiles of each class, so that the rarer one gets cuts too; a threshold lies midway
    # between neighbouring values, at a distance from both.
    seen: dict[str, set] = {f: set() for f in FEATURES}
    for y in (0, 1):
        found = rows.where(F.col("grow") & (F.col("y") == y)).agg(
            *[F.percentile_approx(c, at, 10_000).alias(f) for f, c in numbers.items()]).first()
        for f in FEATURES:
            seen[f].update(found[f] or [])
    values = {f: sorted(v) for f, v in seen.items()}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}

    def bin_of(f: str) -> Column:
        edges = F.array(*[F.lit(float(c)) for c in cuts[f]]).cast("array<double>")
        return F.size(F.filter(edges, lambda c: c < numbers[f]))

    binned = cut(rows.select("y", "grow", "s", *[bin_of(f).alias(f"b_{f}") for f in FEATURES]))

    def counts(where: Column) -> dict:
        """(grow, y, feature, bin) -> rows."""
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b"))
                                   for f in FEATURES]))
        got = (binned.where(where).select("grow", "y", each.alias("x"))
               .groupBy("grow", "y", "x.f", "x.b").count().collect())
        return {(r["grow"], r["y"], r["f"], r["b"]): r["count"] for r in got}

    def total(c: dict, grow: bool, y: int) -> int:
        return sum(v for (g, k, f, _), v in c.items()
                   if g == grow and k == y and f == FEATURES[0])

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = []
        held: list[tuple[int, int]] = []  # pruning-part (rejected, kept) after each condition
        c = counts(left)
        p0, n0 = total(c, True, 0), total(c, True, 1)
        if p0 < MIN_COVER or not n0:
            break
        while len(rule) < MAX_CONDITIONS and n0:
            best = (0.0, None, 0, 0)
            for f in FEATURES:
                for j, cut_at in enumerate(cuts[f]):
                    p = sum(c.get((True, 0, f, b), 0) for b in range(j + 1, len(cuts[f]) + 1))
                    n = sum(c.get((True, 1, f, b), 0) for b in range(j + 1, len(cuts[f]) + 1))
                    for above, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        if pp >= MIN_COVER and (g := _gain(p0, n0, pp, nn)) > best[0] + 1e-9:
                            best = (g, Condition(f, above, float(cut_at)), pp, nn)
            if best[1] is None:
                break
            rule.append(best[1])
            c = counts(left & matches(rule, F.col("s")))
            p0, n0 = total(c, True, 0), total(c, True, 1)
            held.append((total(c, False, 0), total(c, False, 1)))
        # Prune from the end: the shortest prefix of the best worth on the pruning part.
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in held]
        if not worth:
            break
        k = worth.index(max(worth))
        p, n = held[k]
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule[:k + 1])
        left = left & ~matches(rules[-1], F.col("s"))
    return rules


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Contract columns per document, with the number of the deciding rule."""
    s = F.col("__s")
    out = with_statistics(docs.select("doc_id", "text"), "__s")
    first = verdict(rules, s)
    return out.select(
        "doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols",
                                            "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & first.isNull()).alias("kept"), first.alias("rule"))


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    df, back, name = apart(docs)
    # The row number keeps the filter above the statistics: pushed below, each condition
    # would compute them anew.
    out = with_statistics(df, "s", name("text")).withColumn("i", F.monotonically_increasing_id())
    s = F.col("s")
    return back(out.where((F.col("i") >= 0) & ~base_failed(s) & verdict(rules, s).isNull()))
