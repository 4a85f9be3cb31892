"""Benchmark decontamination by template windows, in DataFrame expressions only.

Texts become templates: a number, a name (a capitalised word inside a sentence) or a unit after a number is one
typed placeholder; other words are lower-cased. Windows of ``window`` template words are hashed and joined with
the windows of benchmark items. A question whose parameters were changed still matches, so the values in the
slots are checked: where two texts are laid over each other, one value of the item must always meet one value of
the document.

A document is contaminated by an item when at least ``coverage`` of the item's distinct windows occur in it and
at least ``agreement`` of the item's slot values are met consistently. To reach the coverage it must contain one
of the item's rarest windows, so only those make candidate pairs: a phrase that all items share makes none.

A text is read in three ways (``READINGS``): names inside a sentence are slots; every capitalised word is one, so names
that open a sentence or follow a number or quote are too; none is, so case does not matter. The later readings judge
documents in which the first found nothing, but for pairs that it covered and whose values disagreed. A text is
marked once, names inside a sentence and other capitalised words apart; the words of a reading follow from the marks.

Items without such a window (short ones, or hardly any word that is no slot) are met whole: their words, slot values
included, one after the other.

One pass over the texts hashes the windows of all readings, and the beginnings of whole items, beside each other.
Hashes of the benchmark are broadcast in blocks of at most ``block_rows``; a larger benchmark is joined block after
block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fenced, materialize

NAME, NUMBER, INNER, UNIT, OPENER = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"  # private use, not in BREAKS
UNITS = (
    "km", "m", "cm", "mm", "mi", "miles", "ft", "feet", "inches", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml",
    "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "mph", "kmh",
    "percent", "dollars", "euros", "usd", "eur", "cents", "degrees", "hz", "khz", "mhz", "ghz", "w", "kw", "v",
)
#: What is a name: by the first reading a capitalised word inside a sentence, by the second every one, by the third none.
READINGS = ("inner", "all", "folded")
INNER_NAME = r"(?<=[\p{Ll},;:] )(\p{Lu}\p{L}+)"
OTHER_NAME = r"(?:^|(?<=[\x00-\x40\x5B-\x60\x7B-\x7F]))(\p{Lu}\p{L}+)"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 8
    literals: int = 4
    coverage: float = 0.6
    agreement: float = 0.75
    block_rows: int = 1_000_000


def _replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def marked_words(text: Column) -> Column:
    """Words of a text; a placeholder keeps its value after its mark, and capitalised words have a mark of their kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    named = _replace(_replace(text, INNER_NAME, f"{NAME}$1"), OTHER_NAME, f"{OPENER}$1")
    low = F.lower(named)
    joined = _replace(low, r"(?<=[0-9])[.,:/](?=[0-9])", INNER)
    numbered = _replace(joined, f"[0-9][0-9{INNER}]*", f" {NUMBER}$0 ")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    unit = f"({NUMBER}[0-9{INNER}]+ +)({OPENER}?)({units})(?![\\p{{L}}0-9])"
    united = _replace(numbered, unit, f"$1{UNIT}$2$3")
    plain = F.when(low.rlike("[0-9]"), united).otherwise(low)
    return F.array_remove(F.split(plain, BREAKS), "")


def read_as(word: Column, reading: str) -> Column:
    """A marked word as a reading has it. Most words sort before all marks and stay as they are."""
    if reading == "inner":
        special = F.replace(word, F.lit(OPENER), F.lit(""))
    elif reading == "all":
        special = (
            F.when(F.startswith(word, F.lit(OPENER)), F.concat(F.lit(NAME), F.substring(word, 2, 2**31 - 1)))
            .when(F.startswith(word, F.lit(UNIT + OPENER)), F.concat(F.lit(NAME), F.substring(word, 3, 2**31 - 1)))
            .otherwise(word)
        )
    else:
        special = F.replace(F.replace(word, F.lit(OPENER), F.lit("")), F.lit(NAME), F.lit(""))
    return F.when(word < NAME, word).otherwise(special)


def canonical_words(text: Column, reading: str = "inner") -> Column:
    """Words of a text by a reading; a placeholder keeps its value after its mark."""
    return F.transform(marked_words(text), lambda w: read_as(w, reading))


def _is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NAME, NUMBER, UNIT)


def _template(word: Column) -> Column:
    return F.when((word >= NAME) & _is_slot(word), F.substring(word, 1, 1)).otherwise(word)


def _reading_hashes(words: Column, reading: str) -> Column:
    """Hashes of the template words by a reading."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w < NAME, w).otherwise(_template(read_as(w, reading)))))


def _run_hash(hashes: str, at: str, size: int) -> Column:
    """Hash of ``size`` entries from a position on; null where there are not as many. A plain expression, so that it is
    compiled: the rows are positions, not arrays of windows."""
    entries = [F.get(F.col(hashes), F.col(at) + k) for k in range(size)]
    return F.when(F.col(at) <= F.size(hashes) - size, F.xxhash64(*entries))


def _items(benchmark: DataFrame, reading: str = "inner") -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item"), canonical_words(F.col("text"), reading).alias("_words")
    )


def item_windows(benchmark: DataFrame, s: Settings, reading: str = "inner") -> DataFrame:
    """``item, hash, q, values, size, rank`` of the windows that count as evidence.

    Items with one template are one item, the smallest id. ``size`` is the item's number of distinct windows,
    ``rank`` the place of a window among them from the rarest on. Windows with fewer than ``literals`` words
    that are not slots are no evidence; neither is an item shorter than a window (see ``whole_items``).
    """
    rows = _items(benchmark, reading)
    rows = rows.withColumn("_key", F.sha2(F.array_join(F.transform("_words", _template), " "), 256))
    first = rows.groupBy("_key").agg(F.min_by("_words", F.struct("item", "_words")).alias("_words"), F.min("item").alias("item"))
    hashed = fenced(first.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(_template(w)))))
    exploded = hashed.select("item", "_words", "_h", F.posexplode("_h").alias("q", "_")).select(
        "item", "_words", "q", _run_hash("_h", "q", s.window).alias("hash")
    )
    exploded = fenced(exploded).where("hash IS NOT NULL")
    values = F.slice("_words", F.col("q") + 1, s.window)
    kept = exploded.select("item", "hash", "q", values.alias("values")).where(
        F.size(F.filter("values", lambda w: ~_is_slot(w))) >= s.literals
    )
    kept = materialize(kept, "items")
    share = kept.groupBy("hash").agg(F.count_distinct("item").alias("items"))
    order = Window.partitionBy("item").orderBy("items", "hash")
    ranks = (
        kept.select("item", "hash")
        .distinct()
        .join(share, "hash")
        .select(
            "item",
            "hash",
            F.row_number().over(order).alias("rank"),
            F.count(F.lit(1)).over(Window.partitionBy("item")).alias("size"),
        )
    )
    return materialize(kept.join(ranks, ["item", "hash"]), "ranked")


def whole_items(benchmark: DataFrame, s: Settings) -> DataFrame:
    """``item, values, span, hash`` of the items without a window that counts as evidence: all words, folded, and the
    hash of the first ``span``, which are all of them or a window. Items of the same words are one, the smallest id."""
    words = F.transform("_words", _folded)
    thin = F.transform(
        F.sequence(F.lit(0), F.size("_words") - s.window),
        lambda i: F.size(F.filter(F.slice("_words", i + 1, s.window), lambda w: ~_is_slot(w))) < s.literals,
    )
    bare = (F.size("_words") > 0) & F.when(F.size("_words") >= s.window, F.forall(thin, lambda x: x)).otherwise(True)
    rows = _items(benchmark).where(bare).groupBy(words.alias("values")).agg(F.min("item").alias("item"))
    rows = rows.withColumn("span", F.least(F.size("values"), F.lit(s.window)))
    hashed = F.transform("values", lambda w: F.xxhash64(w))
    return materialize(rows.withColumn("hash", F.xxhash64(F.slice(hashed, F.lit(1), F.col("span")))), "whole")


def _folded(word: Column) -> Column:
    return F.when(F.substring(word, 1, 1) == NAME, F.substring(word, 2, 2**31 - 1)).otherwise(word)


def _met(docs: DataFrame, items: dict[str, DataFrame], whole: DataFrame, s: Settings) -> DataFrame:
    """``_key, tag, hash, p, found``: the places in documents where evidence of a reading, or the beginning of a whole
    item, stands. ``tag`` is the reading's number, or that of the readings plus the span; ``found`` are the marked words
    from ``p`` on, as many as a window or the longest item of the span has."""
    first = len(READINGS)
    spans = {r["span"]: r["longest"] for r in whole.groupBy("span").agg(F.max(F.size("values")).alias("longest")).collect()}
    parts = [items[r].select("hash", F.lit(t).alias("of")) for t, r in enumerate(READINGS)]
    parts.append(whole.select("hash", (F.col("span") + first).alias("of")))
    evidence = materialize(reduce(DataFrame.unionAll, parts).distinct(), "evidence")

    rows = fenced(docs.select(document_key().alias("_key"), marked_words(F.col("text")).alias("_words")))
    hashed = {f"_h{t}": _reading_hashes(F.col("_words"), r) for t, r in enumerate(READINGS)}
    if spans:
        hashed["_plain"] = F.transform("_words", lambda w: F.xxhash64(read_as(w, "folded")))
    rows = fenced(rows.withColumns(hashed))
    # A text is one row a tag, then one row a place: a single compiled expression hashes the run that begins there.
    tags = [*range(first), *(first + span for span in sorted(spans))]
    arrays = F.array(*[F.col(f"_h{t}" if t < first else "_plain") for t in tags])
    rows = rows.select("_key", "_words", F.posexplode(arrays).alias("_t", "_h"))
    placed = rows.select("_key", "_words", F.get(F.array(*map(F.lit, tags)), F.col("_t")).alias("tag"), "_h", F.posexplode("_h").alias("p", "_"))
    run = _run_hash("_h", "p", s.window)
    for span in sorted(spans):
        run = F.when(F.col("tag") == first + span, _run_hash("_h", "p", span)).otherwise(run)
    placed = placed.select("_key", "_words", "p", "tag", run.alias("hash"))
    length = F.lit(s.window)
    for span, longest in spans.items():
        length = F.when(F.col("tag") == first + span, longest).otherwise(length)
    blocks = max(1, -(-evidence.count() // s.block_rows))
    met = []
    for b in range(blocks):
        block = evidence.where(F.pmod("hash", F.lit(blocks)) == b)  # <= block_rows narrow rows
        met.append(placed.join(F.broadcast(block), "hash").where(F.col("tag") == F.col("of")))
    found = F.slice("_words", F.col("p") + 1, length).alias("found")
    return materialize(reduce(DataFrame.unionAll, met).select("_key", "tag", "hash", "p", found), "met")


def _contains(met: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs of ``find`` for ``whole_items``; a copy counts as one window."""
    read = F.transform("found", lambda w: read_as(w, "folded"))
    first = len(READINGS)
    here = met.where(F.col("tag") > first).select("_key", "hash", read.alias("here"), (F.col("tag") - first).alias("span")).distinct()
    pairs = here.join(whole, ["hash", "span"]).where(F.slice("here", F.lit(1), F.size("values")) == F.col("values"))
    slots = F.size(F.filter("values", _is_slot)).cast("long")
    one = F.lit(1).cast("long")
    shape = [one.alias("matched"), one.alias("size"), slots.alias("slots"), slots.alias("consistent"), F.lit(1.0).alias("coverage")]
    return pairs.select("_key", "item", *shape).distinct()


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per contaminated pair: ``_key`` (see ``document_key``), ``item``, ``matched``, ``size``,
    ``coverage``, ``slots`` and ``consistent`` slot values."""
    s = settings or Settings()
    items = {r: item_windows(benchmark, s, r) for r in READINGS}
    whole = whole_items(benchmark, s)
    met = _met(docs, items, whole, s)
    covers = [_covers(met, items[r], s, t, r) for t, r in enumerate(READINGS)]
    covered = materialize(covers[0], "covered")
    first = materialize(covered.where("agrees").drop("agrees").unionByName(_contains(met, whole)), "first")
    others = reduce(DataFrame.unionByName, covers[1:]).where("agrees")
    others = others.join(first.select("_key").distinct(), "_key", "left_anti")
    others = others.join(covered.where("NOT agrees").select("_key", "item"), ["_key", "item"], "left_anti")
    best = F.max(F.struct("coverage", "matched", "size", "slots", "consistent")).alias("b")
    one = others.groupBy("_key", "item").agg(best).select("_key", "item", "b.*")
    return materialize(first.unionByName(one), "found")


def _covers(met: DataFrame, items: DataFrame, s: Settings, tag: int, reading: str) -> DataFrame:
    """The pairs with enough coverage by one reading; ``agrees`` where the slot values do."""
    found = F.transform("found", lambda w: read_as(w, reading)).alias("found")
    met = met.where(F.col("tag") == tag).select("_key", "hash", "p", found)
    needed = F.ceil(F.col("size") * s.coverage - 1e-9)
    rare = items.where(F.col("rank") <= F.col("size") - needed + 1).select("item", "hash").distinct()
    pairs = met.select("_key", "hash").distinct().join(rare, "hash").select("_key", "item").distinct()
    laid = materialize(pairs.join(items, "item").join(met, ["_key", "hash"]).drop("rank"), "laid")
    covered = laid.groupBy("_key", "item").agg(
        F.count_distinct("hash").alias("matched"), F.first("size").alias("size")
    )
    slots = F.filter(F.arrays_zip("values", "found"), lambda x: _is_slot(x["values"]))
    met_values = laid.select("_key", "item", (F.col("p") - F.col("q")).alias("shift"), F.explode(slots).alias("x"))
    by_value = met_values.groupBy("_key", "item", "shift", F.col("x.values").alias("value")).agg(
        (F.min("x.found") == F.max("x.found")).cast("int").alias("one")
    )
    agreed = by_value.groupBy("_key", "item").agg(
        F.count(F.lit(1)).alias("slots"), F.sum("one").alias("consistent")
    )
    out = covered.where("matched >= " + f"ceil(size * {s.coverage} - 1e-9)").join(agreed, ["_key", "item"], "left")
    out = out.fillna(0, ["slots", "consistent"]).withColumn("coverage", F.col("matched") / F.col("size"))
    return out.withColumn("agrees", F.col("consistent") >= s.agreement * F.col("slots"))


def document_key() -> Column:
    """A document's id as text; without one, a digest of its text."""
    digest = F.concat(F.lit("text "), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return F.coalesce(F.col("doc_id").cast("string"), digest)


def report(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document (``doc_id``, ``text``): ``contaminated``, and of the item it contains most of (ties: the
    smallest id) ``item_id``, ``matched_windows``, ``item_windows``, ``coverage``, ``slots``,
    ``consistent_slots``; null where nothing was found. ``items`` counts the items found.

    Null and empty texts contain nothing; of an item met whole the one window is the item. Documents without an id are told apart by their text; texts that
    share an id are judged together, and repeated rows alike. Null item ids are passed over. Other columns are
    ignored; an empty table gives no rows, an empty benchmark finds nothing.
    """
    found = find(docs, benchmark, settings)
    best = F.max_by(F.struct("item", "matched", "size", "coverage", "slots", "consistent"), F.struct("coverage", -F.col("item")))
    worst = found.groupBy("_key").agg(best.alias("b"), F.count(F.lit(1)).alias("items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("_key"))
    return rows.join(worst, "_key", "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.lit(0)).alias("items"),
        F.col("b.item").alias("item_id"),
        F.col("b.matched").alias("matched_windows"),
        F.col("b.size").alias("item_windows"),
        F.col("b.coverage").alias("coverage"),
        F.col("b.slots").alias("slots"),
        F.col("b.consistent").alias("consistent_slots"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    keys = find(docs, benchmark, settings).select("_key").distinct()
    own = [f"own{i}" for i in range(len(docs.columns))]
    keyed = docs.select(document_key().alias("_key"), *[F.col(c).alias(o) for c, o in zip(docs.columns, own)])
    left = keyed.join(materialize(keys, "keys"), "_key", "left_anti")
    return left.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])
