"""Quality rules as a learned decision list, in DataFrame expressions only.

Every text gets counts and shares (``measures``). Sequential covering learns from labelled rows: it grows a
conjunction of threshold tests by FOIL gain on two thirds of them, prunes it on the last third, takes the rows it
covers away and starts anew, until no conjunction is precise enough. What comes out is an ordered list of rules
that can be read, and one conditional expression that Spark evaluates.

Learning looks at counts per (measure, bin, label) alone: a few hundred rows for each step, however many rows
are labelled. Bins end midway between percentiles of each measure.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, materialize

BLANK = " \t\n\x0b\x0c\r"  # fixed values
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"  # fixed values
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: What rules may test; shares are of the characters, words or lines of the text.
MEASURES = (
    "n_words",
    "word_length",
    "symbol_share",
    "upper_share",
    "mark_share",
    "digit_share",
    "repeat_share",
    "same_word_share",
    "dup_line_share",
    "line_words",
)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that are learned from, chosen by the hash of their id."""

    sample_rows: int = 50_000
    bins: int = 48
    max_tests: int = 4
    max_rules: int = 24
    min_covered: int = 5
    min_precision: float = 0.9


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.measure) > self.threshold if self.above else F.col(self.measure) <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Texts that pass all tests are rejected."""

    tests: tuple[Test, ...]
    rejected: int
    clean: int

    def column(self) -> Column:
        out = self.tests[0].column()
        for test in self.tests[1:]:
            out = out & test.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests)) + f" ({self.rejected} rejected, {self.clean} clean)"


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def measures(docs: DataFrame) -> DataFrame:
    """Adds the counts of the contract and the ``MEASURES`` to rows with a ``text``; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS))
    rows = docs.withColumn("_text", text).withColumn("_words", words)
    rows = rows.withColumn("_n", F.size("_words"))
    # Windows of three words that repeat: their hashes are sorted with their places in the low bits, as many as
    # a place needs, so that equal windows are neighbours; the whole hash decides whether neighbours are equal.
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    rows = rows.withColumn("_h", F.when(F.col("_n") >= 3, hashes))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.col("_n") + 1.0)).cast("int")) - 1
    rows = rows.withColumn("_low", low)
    rows = rows.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(
                F.transform("_h", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))
            ),
        ),
    )
    place = lambda j: F.get("_s", j).bitwiseAND(F.col("_low")).cast("int")

    def equal(i: Column, j: Column) -> Column:
        close = F.get("_s", i).bitwiseXOR(F.get("_s", j)) <= F.col("_low")
        close = close & (F.get("_s", i).bitwiseXOR(F.get("_s", j)) >= 0)
        return F.coalesce(close & (F.get("_h", place(i)) == F.get("_h", place(j))), F.lit(False))

    found = F.filter(
        F.sequence(F.lit(0), F.size("_s") - 1), lambda j: equal(j, j + 1) | equal(F.greatest(j - 1, F.lit(0)), j) & (j > 0)
    )
    rows = rows.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(found, place))))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    lines = F.split("_text", "\n")
    rows = rows.withColumn("_lines", F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    size = F.length("_text")
    rows = rows.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (size - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_upper": size - F.length(_without(F.col("_text"), r"\p{Lu}+")),
            "_marks": size - F.length(_without(F.col("_text"), "[!?]+")),
            "_digits": size - F.length(_without(F.col("_text"), "[0-9]+")),
            "_same": F.col("_n") - F.size(F.array_distinct("_words")),
        }
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    rows = rows.withColumn("_n_lines", F.size("_lines")).withColumns(
        {
            "word_length": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("_upper", "word_chars"),
            "mark_share": share("_marks", "word_chars"),
            "digit_share": share("_digits", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "same_word_share": share("_same", "n_words"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "line_words": share("n_words", "_n_lines"),
        }
    )
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def labelled(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Measures of at most ``sample_rows`` labelled documents; ``bad`` is 1 for quality 0, ``part`` 0 to 2."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.lit(1) - F.min("quality")).cast("int").alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = measures(texts.join(F.broadcast(known), "doc_id"))  # at most ``sample_rows`` narrow rows
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)).cast("int")
    return rows.select(*[F.col(m).cast("double").alias(m) for m in MEASURES], "bad", part.alias("part"))


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _best_test(rows: DataFrame, cuts: dict[str, list[float]], s: Settings) -> tuple[Test | None, int, int]:
    """The test with the largest FOIL gain on ``rows`` and what it covers (rejected, clean)."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"bin_{m}").alias("bin")) for m in cuts])
    )
    counts = rows.select("bad", cells.alias("c")).groupBy("c.measure", "c.bin").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
    )
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts.collect():
        table.setdefault(r["measure"], {})[r["bin"]] = (r["p"], r["n"])
    best: tuple[float, Test | None, int, int] = (0.0, None, 0, 0)
    for m in cuts:
        bins = table.get(m, {})
        p0, n0 = (sum(x[k] for x in bins.values()) for k in (0, 1))
        p = n = 0
        for i, cut in enumerate(cuts[m]):
            p, n = p + bins.get(i, (0, 0))[0], n + bins.get(i, (0, 0))[1]
            for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                if p1 >= s.min_covered and n1 < n0 and (g := _gain(p0, n0, p1, n1)) > best[0]:
                    best = (g, Test(m, above, cut), p1, n1)
    return best[1:]


def _bin(measure: str, cuts: list[float]) -> Column:
    """How many of the rising ``cuts`` lie below the measure."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col(measure)))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> list[Rule]:
    """Ordered rules for ``docs`` (``doc_id``, ``text``) from ``labels`` (``doc_id``, ``quality`` 0 or 1).

    Null ids and other labels are passed over; contradicting labels of an id count as quality 0. With no
    labelled row, or no bad one, there are no rules.
    """
    s = settings or Settings()
    rows = materialize(labelled(docs, labels, s), "labelled")
    probs = [(i + 1) / (s.bins + 1) for i in range(s.bins)]
    found = rows.agg(*[F.percentile(m, F.array(*map(F.lit, probs))).alias(m) for m in MEASURES]).first()
    bad = rows.where("bad = 1").agg(*[F.percentile(m, F.array(*map(F.lit, probs))).alias(m) for m in MEASURES]).first()
    seen = {m: sorted({*(found[m] or ()), *(bad[m] or ())}) for m in MEASURES}
    cuts = {m: [(x + y) / 2 for x, y in zip(c, c[1:])] for m, c in seen.items() if len(c) > 1}
    if not cuts:
        return []
    binned = rows.select(
        "*",
        *[
            _bin(m, c).alias(f"bin_{m}")
            for m, c in cuts.items()
        ],
    )
    left = materialize(binned, "binned")
    rules: list[Rule] = []
    while len(rules) < s.max_rules:
        tests: list[Test] = []
        growing = left.where("part < 2")
        while len(tests) < s.max_tests:
            test, _, clean = _best_test(growing, cuts, s)
            if test is None:
                break
            tests.append(test)
            growing = growing.where(test.column())
            if not clean:
                break
        if not tests:
            break
        # Prune: the shortest beginning of the conjunction that is worth most on the rows kept apart.
        begun = [Rule(tuple(tests[: k + 1]), 0, 0).column() for k in range(len(tests))]
        aggs = [
            F.coalesce(F.sum(F.when(c & (F.col("part") == 2 if held else F.lit(True)) & (F.col("bad") == b), 1)), F.lit(0)).alias(
                f"{'h' if held else 'a'}{k}_{b}"
            )
            for k, c in enumerate(begun)
            for b in (0, 1)
            for held in (True, False)
        ]
        got = left.agg(*aggs).first()
        worth = [
            (got[f"h{k}_1"] - got[f"h{k}_0"]) / max(1, got[f"h{k}_1"] + got[f"h{k}_0"]) for k in range(len(tests))
        ]
        k = max(range(len(tests)), key=lambda i: (worth[i], -i))
        covered, clean = got[f"a{k}_1"], got[f"a{k}_0"]
        held, wrong = got[f"h{k}_1"], got[f"h{k}_0"]
        precise = covered >= s.min_precision * (covered + clean) and held >= s.min_precision * (held + wrong)
        if covered < s.min_covered or not precise:
            break
        rule = Rule(tuple(tests[: k + 1]), int(covered), int(clean))
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression over ``MEASURES``: true keeps the text."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to ``docs`` (column ``text``); columns of the same names are
    replaced, others stay if they do not begin with an underscore.

    A null text is empty: no words, so the base rules reject it. Repeated rows are judged each, ids are not
    read, an empty table gives no rows.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [*counts, *(m for m in MEASURES if m not in counts), "base_failed"]
    rows = measures(docs.drop(*names, "kept")).withColumn("base_failed", base)
    rows = rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return rows.drop(*(m for m in MEASURES if m not in counts))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns. Each text is measured once."""
    own = [f"own{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(o) for c, o in zip(docs.columns, own)], F.col("text").alias("text"))
    kept = fenced(judge(rows, rules), F.col("kept"))
    return kept.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])
