"""Quality rules as a learned decision list.

Sequential covering: grow a conjunction of threshold conditions on one part of the labelled
statistics by information gain, prune it on the other part, take away what it covers, repeat. The
list becomes one ordered Spark conditional expression. Statistics and verdicts are DataFrame
functions; what the learner sees is a bounded, documented sample of labelled rows
(``sample_rows``, smallest hashes of the id) as a table of counts.

Defined cases: a NULL or blank text has no words, all its counts are 0 and the base rule rejects
it; conflicting labels of one document both count; labels that are NULL or of unknown documents are
left out; without both classes among the labels the list is empty and only the base rule
decides; repeated rows get equal verdicts; input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.text import SPACE, unit_hash, word_array

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 8000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios the rules test, in thousandths, so that thresholds and cells are whole numbers.
RATIOS = ("symbol_share", "repeat_share", "dup_line_share", "word_length", "upper_share", "mark_share")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rule and the ratios of the learned rules.

    For 3-word windows that occur twice, a window's hash and start share one long: hash in the high
    bits, start in the low ``_bits`` that the length needs. One primitive sort brings equal windows
    together in order of start; a word is counted once although windows overlap.
    """
    made = {*COUNTS, *RATIOS, "n_lines"}
    keep = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, text.alias("_text"), word_array(F.col(text_col)).alias("_words"))
    packed = F.expr(
        """CASE WHEN size(_words) < 3 THEN array() ELSE sort_array(transform(
             sequence(0, size(_words) - 3),
             i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | CAST(i AS BIGINT))) END"""
    ).cast("array<long>")
    starts = F.expr(
        """sort_array(transform(filter(_packed, (x, k) ->
             (k > 0 AND shiftrightunsigned(x, _bits) = shiftrightunsigned(_packed[k - 1], _bits))
             OR (k < size(_packed) - 1 AND shiftrightunsigned(x, _bits) = shiftrightunsigned(_packed[k + 1], _bits))),
           x -> x & (shiftleft(1L, _bits) - 1L)))"""
    )
    covered = F.expr(
        """CASE WHEN size(_starts) = 0 THEN 0L ELSE 3L + aggregate(transform(_starts,
             (x, k) -> CASE WHEN k = 0 THEN 0L ELSE least(3L, x - _starts[k - 1]) END), 0L, (s, x) -> s + x) END"""
    )
    dense = F.translate(F.col("_text"), SPACE, "")
    lines = F.filter(F.split("_text", "\n"), lambda line: F.translate(line, SPACE, "") != "")
    counted = (
        base.withColumn("_bits", F.length(F.bin(F.size("_words"))))
        .withColumn("_packed", packed).withColumn("_starts", starts)
        .withColumn("_lines", lines).withColumn("_dense", dense)
        .select(
            *keep,
            F.size("_words").cast("long").alias("n_words"),
            F.length("_dense").cast("long").alias("word_chars"),
            (F.length("_dense") - F.length(_without(F.col("_dense"), SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.length("_dense") - F.length(_without(F.col("_dense"), "!?"))).cast("long").alias("_marks"),
            F.length(F.regexp_replace("_dense", r"\P{Lu}+", "")).cast("long").alias("_upper"),
        )
    )
    # Generating a one-element array keeps filters on the counts above them; pushed below, a filter
    # would compute the arrays anew inside every lambda.
    names = [c for c in counted.columns if c not in keep]
    out = counted.select(*keep, F.explode(F.array(F.struct(*names))).alias("_s")).select(*keep, "_s.*")

    def thousandths(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("long")

    return out.select(
        *[c for c in out.columns if c not in ("_marks", "_upper")],
        thousandths("n_symbols", "word_chars").alias("symbol_share"),
        thousandths("n_repeat_words", "n_words").alias("repeat_share"),
        thousandths("n_dup_lines", "n_lines").alias("dup_line_share"),
        thousandths("word_chars", "n_words").alias("word_length"),
        thousandths("_upper", "word_chars").alias("upper_share"),
        thousandths("_marks", "word_chars").alias("mark_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def holds(self, cell: dict) -> bool:
        return cell[self.feature] > self.threshold if self.above else cell[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; rows that meet it are rejected."""

    conditions: tuple[Condition, ...]

    def covers(self, cell: dict) -> bool:
        return all(c.holds(cell) for c in self.conditions)

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def labelled_cells(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str = "doc_id", label_col: str = "quality"):
    """Counts of good and bad rows per cell of ratios and half, from the bounded sample.

    The sample is drawn from the labels alone, so only its rows of the documents are read for
    statistics and the join broadcasts at most ``sample_rows`` ids.
    """
    sample = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"), unit_hash(F.col(id_col), seed=3).alias("_draw"))
        .orderBy("_draw", "_id", "_label").limit(sample_rows)
    )
    chosen = docs.select(id_col, "text").join(F.broadcast(sample), F.col(id_col) == F.col("_id"))
    seen = with_statistics(chosen).filter(~base_failed())
    grown = (F.floor(F.col("_draw") * 1e9) % 3 != 0).alias("grow")
    counted = seen.groupBy(*RATIOS, grown).agg(
        F.sum(F.when(F.col("_label") == 0, 1).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("_label") == 0, 0).otherwise(1)).alias("good"),
    )
    return [r.asDict() for r in counted.collect()]  # at most sample_rows cells


def _totals(cells: list[dict]) -> tuple[int, int]:
    return sum(c["bad"] for c in cells), sum(c["good"] for c in cells)


def _best_condition(cells: list[dict]) -> Condition | None:
    """The threshold with the largest gain ``p1 (log p1/(p1+n1) - log p0/(p0+n0))``; ties to the first feature."""
    bad, good = _totals(cells)
    before, best, choice = math.log2(bad / (bad + good)), 1e-9, None
    for feature in RATIOS:
        by_value: dict[int, list[int]] = {}
        for c in cells:
            both = by_value.setdefault(c[feature], [0, 0])
            both[0] += c["bad"]
            both[1] += c["good"]
        values = sorted(by_value)
        p = n = 0
        for low, high in zip(values, values[1:]):
            p += by_value[low][0]
            n += by_value[low][1]
            for above, pos, neg in ((False, p, n), (True, bad - p, good - n)):
                if pos and (gain := pos * (math.log2(pos / (pos + neg)) - before)) > best:
                    best, choice = gain, Condition(feature, above, (low + high) // 2)
    return choice


def _precision(rule: Rule, cells: list[dict]) -> tuple[float, int]:
    bad, good = _totals([c for c in cells if rule.covers(c)])
    return (bad + 1) / (bad + good + 2), bad


def learn_rules(
    cells: list[dict], max_rules: int = 12, max_conditions: int = 4, least_precision: float = 0.9, least_bad: int = 5
) -> list[Rule]:
    """Sequential covering over the cells; a rule enters if it keeps its precision on the held-back half."""
    grow, prune = [c for c in cells if c["grow"]], [c for c in cells if not c["grow"]]
    rules: list[Rule] = []
    while len(rules) < max_rules and all(_totals(grow)):
        inside, conditions = grow, []
        while len(conditions) < max_conditions and all(_totals(inside)):
            if not (found := _best_condition(inside)):
                break
            conditions.append(found)
            inside = [c for c in inside if found.holds(c)]
        if not conditions:
            break
        rule = Rule(tuple(conditions))
        while len(rule.conditions) > 1:  # prune from the end while the held-back precision doesn't fall
            shorter = Rule(rule.conditions[:-1])
            if _precision(shorter, prune)[0] < _precision(rule, prune)[0]:
                break
            rule = shorter
        covered = _totals([c for c in grow if rule.covers(c)])
        if covered[0] < least_bad or min(_precision(rule, prune)[0], _precision(rule, grow)[0]) < least_precision:
            break
        rules.append(rule)
        grow, prune = [c for c in grow if not rule.covers(c)], [c for c in prune if not rule.covers(c)]
    return rules


def fired_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 for none: one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``rule`` (first rule that rejects, else 0) and ``kept``."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rules = learn_rules(labelled_cells(named, labels, sample_rows))
    made = {"base_failed", "rule", "kept"}
    rows = docs.select(*[c for c in docs.columns if c not in made])
    out = with_statistics(rows, text_col).withColumn("base_failed", base_failed()).withColumn("rule", fired_rule(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
