"""Near duplicates by an inverted join over MinHash signature coordinates.

Documents become sets of distinct word shingles and signatures of ``coordinates`` min-hashes. Documents with
equal sets are one class, known by a digest of the set; everything after runs on classes. A class is posted
under each (coordinate, value) pair. A pair of classes is a candidate when at least ``matches`` coordinates
agree, and a link when 100 * |A and B| >= percent * |A or B| on the full sets.

Collisions are counted by prefix and skip merging. Lists are put in one global order, shortest first. Of a
class's lists the ``matches - 1`` longest are skipped: a pair with enough collisions meets in one of the others,
its prefix. Lists of one member take a place in the prefix but cost nothing, so most classes have no list left.

Only components are asked for, so not every pair of a list is made:

1. In each list every member is paired with one hub, the member whose lists are longest in all: in a group of
   near copies that is the text nearest to the others. The two best pairs of each class are confirmed on the full
   sets; their components label the classes.
2. Lists whose members now have one label need nothing more. In the others, members of different labels meet in
   blocks of a bounded number of members, with their sets. Pairs that agree in ``matches`` coordinates, and in
   enough bytes of a longer sketch, are confirmed there, the most alike first, unless confirmed links have
   joined them already. A block emits a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_PER_BATCH, Words, materialize, mix, signed, slices
from .components import components

BLOCK_MEMBERS = 1024


@dataclass(frozen=True)
class Rules:
    """``matches`` of ``coordinates`` must agree: at a similarity of 0.75, 12 of 32 miss 2 pairs in a million.

    ``sketch`` more min-hashes are kept as bytes and only narrow what is confirmed: ``sketch_matches`` of them
    and the coordinates must agree; 72 of 128 miss 1 pair in a million.
    """

    words: int = 5
    percent: int = 75
    coordinates: int = 32
    matches: int = 12
    sketch: int = 96
    sketch_matches: int = 72


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, n + 1 bounds)."""
    found = Words(texts)
    hashes, bounds = found.hashes, found.bounds
    factors = _odd(5, max(words, 1))
    whole = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        whole += hashes[j : j + len(whole)] * factors[j]
    whole = mix(whole)
    sets, sizes = [], np.zeros(len(bounds), np.int64)
    for i, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        n = hi - lo
        if n >= words:
            one = np.unique(whole[lo : hi - words + 1])
        elif n:
            one = mix(np.sum(hashes[lo:hi] * factors[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            continue
        sets.append(one)
        sizes[i + 1] = len(one)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _signatures(values: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    factors, salts, last = _odd(7, coordinates), _odd(11, coordinates), _odd(13, coordinates)
    out = np.zeros((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        x = values ^ salts[k]
        x *= factors[k]
        x ^= x >> np.uint64(29)
        x *= last[k]
        out[:, k] = np.minimum.reduceat(x, starts) >> np.uint64(32)
    return out


SIGNED_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, signature binary, sketch binary"


def _digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set, zero for an empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)
    solid = np.flatnonzero(np.diff(bounds))
    if len(solid):
        starts = bounds[:-1][solid]
        out[0][solid] = np.add.reduceat(mix(values + np.uint64(1)), starts)
        out[1][solid] = np.bitwise_xor.reduceat(mix(values + np.uint64(2)), starts)
    return out


def _rows(matrix: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """Rows of a matrix as binary values at the places ``at`` of ``n``, null elsewhere."""
    out: list[bytes | None] = [None] * n
    raw, width = matrix.tobytes(), matrix.shape[1] * matrix.itemsize
    for j, i in enumerate(at.tolist()):
        out[i] = raw[j * width : (j + 1) * width]
    return pa.array(out, pa.binary())


def sign(docs: DataFrame, rules: Rules) -> DataFrame:
    """Size, digest and signature of each document's shingle set; no signature for an empty set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), rules.words)
                sizes = np.diff(bounds)
                n = len(sizes)
                d1, d2 = _digests(values, bounds)
                solid = np.flatnonzero(sizes)
                found = np.zeros((0, rules.coordinates + rules.sketch), np.uint32)
                if len(solid):
                    starts = bounds[:-1][solid]
                    found = _signatures(values, starts, rules.coordinates + rules.sketch)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(signed(d1)),
                        pa.array(signed(d2)),
                        _rows(np.ascontiguousarray(found[:, : rules.coordinates]), solid, n),
                        _rows((found & 0xFF).astype(np.uint8), solid, n),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "signature", "sketch"],
                )

    return docs.mapInArrow(run, SIGNED_SCHEMA)


def _posted(classes: DataFrame, rules: Rules) -> DataFrame:
    """One row per class and coordinate: ``rep``, ``c``, ``v``."""

    def run(batches):
        for batch in batches:
            raw = b"".join(batch.column("signature").to_pylist())
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("rep").to_numpy(), rules.coordinates)),
                    pa.array(np.tile(np.arange(rules.coordinates, dtype=np.int32), n)),
                    pa.array(np.frombuffer(raw, np.int32)),
                ],
                names=["rep", "c", "v"],
            )

    return classes.select("rep", "signature").mapInArrow(run, "rep long, c int, v int")


def _prefixes(classes: DataFrame, rules: Rules) -> DataFrame:
    """The lists that a class is merged in: ``rep, c, v`` and all its ``cs`` as bits; ``hub`` of each list.

    Dropped are classes with fewer than ``matches`` shared lists, and their ``matches - 1`` longest lists.
    """
    posted = _posted(classes, rules)
    lists = posted.groupBy("c", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = posted.join(lists, ["c", "v"])
    ordered = F.array_sort(F.collect_list(F.struct("m", "c", "v")))
    mine = shared.groupBy("rep").agg(ordered.alias("lists"), F.sum("m").alias("near"))
    mine = mine.where(F.size("lists") >= rules.matches)
    short = F.slice("lists", 1, F.size("lists") - (rules.matches - 1))
    one = F.lit(1).cast("long")
    bits = F.aggregate(
        short, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", one, x["c"]))
    )
    rows = mine.select("rep", "near", bits.alias("cs"), F.explode(short).alias("l")).select("rep", "near", "cs", "l.c", "l.v")
    rows = materialize(rows, "short")
    hubs = rows.groupBy("c", "v").agg(F.max(F.struct("near", (-F.col("rep")).alias("r")))["r"].alias("r"))
    return rows.join(hubs, ["c", "v"]).select("rep", "cs", "c", "v", (-F.col("r")).alias("hub"))


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``matched``, the agreeing bytes of the sketches of classes ``a`` and ``b``."""
    left = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("sa", "sb"))
            same = (x == y).reshape(len(batch), -1).sum(axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(same.astype(np.int32))], names=["a", "b", "matched"]
            )

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, matched int")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep[i] = _similar(x, y, rules.percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"]
            )

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, rules: Rules) -> DataFrame:
    """Full shingle sets of the classes in ``wanted``, made anew from the text of the class's first document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), rules.words)
                raw = values.tobytes()
                places = (8 * bounds).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep"),
                        *(pa.array(signed(d)) for d in _digests(values, bounds)),
                        pa.array([raw[i:j] for i, j in zip(places, places[1:])], pa.binary()),
                    ],
                    names=["rep", "d1", "d2", "shingles"],
                )

    texts = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")
    return texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(run, "rep long, d1 long, d2 long, shingles binary")


def _mixed_links(short: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """Links between differently labelled classes that share a list: a spanning forest from each block."""
    member = short.join(labels, short["rep"] == labels["node"], "left").select(
        "rep", "cs", "c", "v", F.coalesce("component", "rep").alias("label")
    )
    mixed = (
        member.groupBy("c", "v")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo <> hi")
        .select("c", "v", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("g"))
    )
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("g")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    rows = (
        member.join(mixed, ["c", "v"])
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("g", "other")
    )
    whole = classes.select("rep", "signature", "sketch", "d1", "d2").join(sets, ["rep", "d1", "d2"]).drop("d1", "d2")
    keys = ["c", "v", "lo", "hi"]
    dealt = rows.join(whole, "rep").repartition(*keys).sortWithinPartitions(*keys)
    width, total = rules.coordinates, rules.coordinates + rules.sketch
    bit = np.int64(1) << np.arange(width, dtype=np.int64)

    def links_of(group: pa.Table) -> list[tuple[int, int]]:
        rep, label, cs, own = (group.column(k).to_numpy() for k in ("rep", "label", "cs", "own"))
        c, lo, hi = (group.column(k)[0].as_py() for k in ("c", "lo", "hi"))
        n = len(rep)
        signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(n, width)
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(n, total)
        shingles = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        pairs = []
        for i in left.tolist():
            js = right[rep[right] > rep[i]] if lo == hi else right
            js = js[label[js] != label[i]]
            alike = (sketch[js] == sketch[i]).sum(axis=1)
            enough = alike >= rules.sketch_matches
            js, alike = js[enough], alike[enough]
            if not len(js):
                continue
            same = signature[js] == signature[i]
            common = same @ bit & cs[js] & cs[i]
            enough = (same.sum(axis=1) >= rules.matches) & (common & -common == bit[c])
            pairs.extend(zip((-alike[enough]).tolist(), [i] * int(enough.sum()), js[enough].tolist()))
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        links = []
        for _, i, j in sorted(pairs):
            x, y = top(int(label[i])), top(int(label[j]))
            if x != y and _similar(shingles[i], shingles[j], rules.percent):
                above[max(x, y)] = min(x, y)
                links.append((int(rep[i]), int(rep[j])))
        return links

    def run(batches):
        held = None

        def emit(groups):
            found = [link for g in groups for link in links_of(g)]
            a, b = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not len(held):
                continue
            marks = np.stack([held.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            if not len(cuts):
                continue
            edges = [0, *cuts.tolist()]
            yield emit([held.slice(s, e - s) for s, e in zip(edges, edges[1:])])
            held = held.slice(edges[-1])
        if held is not None and len(held):
            yield emit([held])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per document (``doc_id``, ``text``): ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id linked with the document over any number of links, itself included;
    ``kept`` marks that document. Null, empty or blank texts have no set and are linked with nothing. Texts of
    fewer than ``words`` words are one shingle. A row without an id has no component and is kept. Repeated rows
    give repeated results; an id with several texts is linked through each of them. Other columns are ignored; an
    empty table gives no rows.
    """
    rules = rules or Rules()
    if rules.coordinates > 62:
        raise ValueError("at most 62 coordinates")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(sign(narrow, rules), "signed", TEXTS_PER_BATCH)
    sized = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    digest = ["d1", "d2", "n_shingles"]
    classes = materialize(
        sized.groupBy(*digest).agg(
            F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    # An id with several texts may stand for several classes: one node with several sets.
    short = materialize(_prefixes(classes, rules), "prefixes")
    sets = materialize(_sets(narrow, short.select("rep").distinct(), rules).distinct(), "sets", TEXTS_PER_BATCH)

    star = short.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    star = _agreeing(star, classes).where(F.col("matched") >= rules.sketch_matches)
    best = star.groupBy("a").agg(
        F.max(F.struct("matched", "b")).alias("x"), F.max(F.struct("matched", (-F.col("b")).alias("b"))).alias("y")
    )
    best = best.select("a", F.explode(F.array(F.col("x.b"), -F.col("y.b"))).alias("b")).distinct()
    first = materialize(_confirmed(best, sets, rules), "first")
    labels = materialize(components(first), "labels")

    more = materialize(_mixed_links(short, labels, classes, sets, rules), "more")
    joined = components(first.unionByName(more)) if not more.isEmpty() else labels
    members = classes.select(*digest, "rep").join(joined, F.col("rep") == F.col("node"), "left")
    members = members.select(*digest, F.coalesce("component", "rep").alias("component_id"))
    linked = rows.select("doc_id", *digest).join(members, digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return linked.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component, with all columns.

    Of rows that repeat the id that stays, the smallest row does. Rows without an id stay.
    """
    judged = materialize(near_duplicates(docs, rules), "judged")
    gone = judged.where("not kept").select("doc_id").distinct()
    # Texts and ids are shuffled at every size: the ids grow with the input, so they are no side to broadcast.
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    again = judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = materialize(again.where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("r.*"))
