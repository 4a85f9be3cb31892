"""Language-model scoring by a probabilistic suffix tree over words.

Training counts words and runs of up to ``depth + 1`` words over all training texts, then grows contexts level by
level. A context is a candidate from ``min_count`` occurrences on; its successors with ``min_count`` of them are told
apart, the rest is one class. A candidate is retained when its next-symbol distribution diverges from that of its
longest retained suffix by at least ``divergence`` nats. Nothing else prunes, so the tree grows with the corpus; a
caller may ask for least shares of the training tokens besides (``context_share``, ``next_share``), by default none.

A state's distribution gives its told-apart successors a discounted share and hands the rest down:
``P(c | s) = (n - discount) / n_s``, else ``weight(s) * P(c | suffix)``, with ``weight`` such that all symbols sum
to one. The root is the smoothed word distribution ``(c + 1) / (N + V + 1)``, which also has room for one unknown
word. Words are known by 64-bit hashes; the end of a text is a symbol, but no context crosses it.

Neither words nor contexts are sent to tasks. A run of words is known by one hash, be it a context or a context and
its successor. Texts are read once, into blocks of about ``block_tokens`` tokens that are written as codes of the
block's own words. Runs are counted length by length: a block asks for a run only where the two runs in it that are
shorter by one have ``min_count`` occurrences, as no other can have them, and the bucket of the run's hash answers with
its count over all blocks. Blocks and answers are written; where runs lie in a block follows from them, so neither
hashes nor texts are kept. One of the blocks with a run is its owner and adds it to its context's sums. An answer also
keeps the rank of each frequent run in its bucket, and the owner's the hash, so that weights are dealt out to blocks by
rank, without another question. Blocks are scored in ``rounds``: what is moved for one round is gone in the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS_PER_BATCH, Words, materialize, mix, signed, slices

_B = np.uint64(0xD1342543DE82EF95)
END = mix(np.array([0x5EED], np.uint64))[0]
BUCKET_RUNS = 2_000_000


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    context_share: float = 0.0
    next_share: float = 0.0
    min_count: int = 3
    discount: float = 0.5
    divergence: float = 0.02
    block_tokens: int = 1_500_000
    rounds: int = 4


@dataclass
class Level:
    """Retained contexts of one length: sorted ``raw`` hashes, their ``weight`` and suffix state; successors as
    sorted ``context index << 32 | word index`` with probabilities."""

    raw: np.ndarray
    weight: np.ndarray
    up_level: np.ndarray
    up_index: np.ndarray
    pairs: np.ndarray
    prob: np.ndarray


@dataclass
class Tree:
    """``grams``: for each length from 1 on a table of counted runs, ``gram, context, lower, word, n, p, told``: the hash
    of the run, those of the run without its last and without its first word, its last word; ``told`` where a retained
    state tells it apart, with the probability ``p``. These tables are not written but read off the blocks.
    ``contexts``: for each level ``context, parent, weight`` of the candidates with successors; ``weight`` is null
    where one is not retained.

    ``frequent``, ``counts`` and ``levels`` are the same tree in arrays, for one that fits the driver."""

    tokens: int
    words: int
    least: int
    grams: list[DataFrame]
    contexts: list[DataFrame]

    @cached_property
    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        word, n = _columns(self.grams[0].where(F.col("n") >= self.least), "word", "n")
        order = np.argsort(word.view(np.uint64))
        return word.view(np.uint64)[order], n[order]

    @property
    def frequent(self) -> np.ndarray:
        return self._frequent[0]

    @property
    def counts(self) -> np.ndarray:
        return self._frequent[1]

    @cached_property
    def levels(self) -> list[Level]:
        out, effective = [], {0: (0, 0)}
        for depth, (rows, states) in enumerate(zip(self.grams[1:], self.contexts), 1):
            candidates = sorted((int(np.uint64(r.context % 2**64)), r.parent, r.weight) for r in states.collect())
            here, kept = {}, []
            for raw, parent, weight in candidates:
                up = effective[parent % 2**64]
                here[raw] = up if weight is None else (depth, len(kept))
                if weight is not None:
                    kept.append((raw, weight, *up))
            effective = here
            raw, weight, up_level, up_index = (np.array(c, t) for c, t in zip(
                zip(*kept) if kept else [()] * 4, (np.uint64, float, np.int64, np.int64)
            ))
            context, word, p = _columns(rows.where("told"), "context", "word", "p")
            code = np.searchsorted(raw, context.view(np.uint64)) << 32 | np.searchsorted(self.frequent, word.view(np.uint64))
            order = np.argsort(code)
            out.append(Level(raw, weight, up_level, up_index, code[order], p[order]))
        return out

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.tokens + self.words + 1.0)

    def probability(self, level: np.ndarray, index: np.ndarray, word: np.ndarray, root: np.ndarray) -> np.ndarray:
        """P(word | state); level 0 is the root, word -1 is not among ``frequent``."""
        out = np.ones(len(level))
        level, index = level.copy(), index.copy()
        open_ = np.ones(len(level), bool)
        for depth in range(len(self.levels), 0, -1):
            here = np.flatnonzero(open_ & (level == depth))
            if not len(here):
                continue
            states = self.levels[depth - 1]
            code = index[here] << 32 | np.maximum(word[here], 0)
            at = np.minimum(np.searchsorted(states.pairs, code), max(0, len(states.pairs) - 1))
            hit = (word[here] >= 0) & (states.pairs[at] == code) if len(states.pairs) else np.zeros(len(here), bool)
            out[here[hit]] *= states.prob[at[hit]]
            open_[here[hit]] = False
            miss = here[~hit]
            out[miss] *= states.weight[index[miss]]
            level[miss], index[miss] = states.up_level[index[miss]], states.up_index[index[miss]]
        out[open_] *= root[open_]
        return out


class Sequences:
    """Symbols of a slice of texts, each text followed by the end, and the hashes of the contexts before them."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        sizes = np.diff(words.bounds)
        self.bounds = words.bounds + np.arange(len(words.bounds))
        self.symbols = np.full(int(self.bounds[-1]), END, np.uint64)
        place = np.ones(len(self.symbols), bool)
        place[self.bounds[1:] - 1] = False
        self.symbols[place] = words.hashes
        self.sizes = sizes + 1
        self.position = np.arange(len(self.symbols)) - np.repeat(self.bounds[:-1], self.sizes)

    def contexts(self, depth: int) -> list[np.ndarray]:
        """For lengths 1 to ``depth``: the hash of the symbols before each one; 0 where the text is younger."""
        out, sums = [], np.zeros(len(self.symbols), np.uint64)
        for k in range(1, depth + 1):
            sums = sums.copy()
            sums[k:] += self.symbols[:-k] * np.uint64(pow(int(_B), k, 2**64))
            sums[self.position < k] = 0
            out.append(sums)
        return out


@contextmanager
def _sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written; it is written with a codec for small numbers."""
    sparing = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: spark.conf.get(k, None) for k in sparing}
    for k, v in sparing.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    with _sparing_disk(df.sparkSession):
        return materialize(df, name, batch_rows)


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, train``; null texts are empty, a null flag is not for training."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("train"), F.lit(False)).alias("train"),
    )


def _planes(x: np.ndarray) -> bytes:
    """First all lowest bytes, then all next ones; the upper ones are mostly zero, which Spark's codecs shorten."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


BLOCKS = (
    "block long, symbols long, trained long, doc_id array<long>, train array<boolean>, sizes array<long>, "
    "words binary, codes binary"
)


def _block_row(block: int, docs: list, train: list, sizes: list, symbols: list) -> pa.RecordBatch:
    words, codes, n = np.unique(np.concatenate(symbols), return_inverse=True, return_counts=True)
    order = np.argsort(-n)  # frequent words get small codes
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    docs, train, sizes = (pa.concat_arrays(docs), pa.concat_arrays(train), np.concatenate(sizes))
    trained = int(sizes[train.to_numpy(zero_copy_only=False)].sum())
    packed = zlib.compress(_planes(rank[codes]), 1)
    columns = [[block], [len(codes)], [trained], [docs], [train], [sizes], [words[order].tobytes()], [packed]]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    columns = [[x.tolist() if hasattr(x, "tolist") else x.to_pylist() if hasattr(x, "to_pylist") else x for x in c] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _blocks(texts: DataFrame, block_tokens: int) -> DataFrame:
    """All texts as written rows of about ``block_tokens`` symbols; a longer text is a row of its own."""

    def run(batches):
        block, held, found = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
        for batch in batches:
            for part in slices(batch, "text"):
                seq = Sequences(part.column("text"))
                start = 0
                while start < len(part):
                    room = seq.bounds[start] + block_tokens - held
                    end = max(start + (not held), int(np.searchsorted(seq.bounds, room, "right")) - 1)
                    if end > start:
                        found[0].append(part.column("doc_id").slice(start, end - start))
                        found[1].append(part.column("train").slice(start, end - start))
                        found[2].append(seq.sizes[start:end])
                        found[3].append(seq.symbols[seq.bounds[start] : seq.bounds[end]])
                        held += len(found[3][-1])
                    if end < len(part):
                        yield _block_row(block, *found)
                        block, held, found = block + 1, 0, ([], [], [], [])
                    start = end
        if held:
            yield _block_row(block, *found)

    return _written(texts.select("doc_id", "text", "train").mapInArrow(run, BLOCKS), "blocks", TEXTS_PER_BATCH)


def _bits(runs: float) -> int:
    """Leading bits of a hash that make buckets of about ``BUCKET_RUNS``, 16 at least."""
    return max(4, int(np.ceil(np.log2(max(1.0, runs / BUCKET_RUNS)))))


def _dealt(keys: np.ndarray, bits: int):
    """(bucket, from, to) of rising keys."""
    ends = np.searchsorted(keys, np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(64 - bits))
    ends = np.append(ends, len(keys))
    starts = np.append(0, ends[:-1])
    return [(b, int(starts[b]), int(ends[b])) for b in np.flatnonzero(ends > starts).tolist()]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places of the keys by rising key, the keys in this order)."""
    low = (np.uint64(1) << np.uint64(max(1, len(keys)).bit_length())) - np.uint64(1)
    packed = np.arange(len(keys), dtype=np.uint64)
    packed |= keys & ~low
    packed.sort()  # several times as fast as to sort places, and leaves out of order only keys with all upper bits equal
    packed &= low
    order = packed.view(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys)
        ranked = keys[order]
    return order, ranked


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rising distinct keys, the place of one row of each, the distinct key of each row)."""
    order, ranked = _ranked(keys)
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32)
    which -= 1
    return ranked[new], order[new], which


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _bits_of(flags: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags, sizes)]).astype(bool)


class Block:
    """Symbols of a block's texts, and what the answers on runs of up to ``longest`` symbols say of those that end at each.

    ``ends[k]``: hashes of the runs of ``k`` symbols. ``n[k]``: their counts in training, 0 below ``least`` from two
    symbols on and where the text is younger. ``owned[k]``: a place of each run that this block owns. ``weight[k]``, where
    ``weights`` tell them: the weights of the runs that are retained contexts, 0 for others.
    """

    def __init__(self, row: pa.Table, answers: pa.Table, longest: int, least: int, weights: pa.Table | None = None):
        self.least = least
        self.words = np.frombuffer(row.column("words")[0].as_py(), np.uint64)
        self.codes = _unplaned(zlib.decompress(row.column("codes")[0].as_py()), np.uint32)
        self.symbols = self.words[self.codes]
        self.docs, self.train = (row.column(c).combine_chunks().flatten() for c in ("doc_id", "train"))
        self.sizes = row.column("sizes").combine_chunks().flatten().to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.position = (np.arange(len(self.symbols)) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.ends = [None, self.symbols * _B]
        self.n, self.owned, self.weight = [None], [None], [None]
        length = answers.column("length").to_numpy()
        for k in range(1, longest + 1):
            at, keys, some, which = self.asked(k)
            mine = answers.filter(pa.array(length == k)).sort_by("bucket")
            n, own, said = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), []
            if len(mine):
                said = [_unplaned(x, np.int64) for x in mine.column("n").to_pylist()]
                n = np.concatenate(said)
                own = _bits_of(mine.column("own").to_pylist(), [len(x) for x in said])
            narrow = np.uint32 if n.max(initial=0) < 2**32 else np.int64
            self.n.append(np.zeros(len(self.symbols), narrow))
            self.n[k][at] = n.astype(narrow)[which]
            self.owned.append(at[some[own & (n > 0)]])
            if weights is not None and k < longest:
                told = weights.filter(pc.equal(weights.column("length"), k)).sort_by("bucket")
                value = np.zeros(len(keys))
                if len(told):
                    retained = _bits_of(told.column("retained").to_pylist(), [int((x >= least).sum()) for x in said])
                    value[np.flatnonzero(n >= least)[retained]] = _joined(told.column("weights"), np.float64)
                self.weight.append(np.zeros(len(self.symbols)))
                self.weight[k][at] = value[which]
            if k == 1:
                del self.words, self.codes

    def asked(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of the runs of ``k`` symbols that may have ``least`` occurrences, and ``_distinct`` of their hashes)."""
        if k == 1:
            keys, some, which = _distinct(self.words * _B)
            first = np.empty(len(self.words), np.int64)
            first[self.codes] = np.arange(len(self.codes))
            return np.arange(len(self.symbols)), keys, first[some], which[self.codes]
        if len(self.ends) == k:
            longer = np.zeros(len(self.symbols), np.uint64)
            longer[1:] = (self.ends[-1][:-1] + self.symbols[1:]) * _B
            self.ends.append(longer)
        often = self.n[k - 1] >= self.least
        often[1:] &= often[:-1]
        at = np.flatnonzero(often & (self.position >= k - 1))
        return at, *_distinct(self.ends[k][at])

    def trained(self) -> np.ndarray:
        return np.repeat(self.train.to_numpy(zero_copy_only=False), self.sizes)


ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
ANSWERS = "block long, length int, bucket int, n binary, own binary, words long, ranks binary, keys binary"


def _asks(block: int, keys: np.ndarray, n: np.ndarray | None, bits: int) -> pa.Table:
    return pa.Table.from_pylist(
        [
            {
                "bucket": b,
                "block": block,
                "keys": _gaps(keys[i:j]),
                "n": b"" if n is None else _planes(n[i:j]),
            }
            for b, i, j in _dealt(keys, bits)
        ],
        ASKED,
    )


def _gaps(rising: np.ndarray) -> bytes:
    return _planes(np.diff(rising, prepend=rising.dtype.type(0)))


def _keys(rows: pa.Table, column: str = "keys", kind=np.uint64) -> list[np.ndarray]:
    return [np.cumsum(_unplaned(x, kind), dtype=kind) for x in rows.column(column).to_pylist()]


def _met(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _on_counts(answers: DataFrame) -> DataFrame:
    return answers.select("block", "length", "bucket", "n", "own")


def _answered(
    blocks: DataFrame, answers: DataFrame, k: int, least: int, bits: int, known: DataFrame | None, ranked: bool
) -> DataFrame:
    """Counts of the runs of ``k`` symbols that blocks ask for: those of the blocks' training texts, or those that
    ``known`` (``gram, n``) has. If ``ranked``, with them ``ranks`` of those that have ``least`` occurrences among all such
    that are asked for in the bucket; each one's hash is in the ``keys`` of one answer."""
    counted = known is None

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, right, k - 1, least)
        at, keys, _, which = block.asked(k)
        n = np.bincount(which[block.trained()[at]], minlength=len(keys))
        return _asks(left.column("block")[0].as_py(), keys, n if counted else None, bits)

    def rows(asked: pa.Table, keys: list[np.ndarray], n: np.ndarray, some: np.ndarray, which: np.ndarray) -> pa.Table:
        if k > 1:
            n = np.where(n >= least, n, 0)
        first, often = np.zeros(len(n), bool), n >= least
        first[some] = True
        own = first if counted else np.zeros(len(n), bool)
        rank = (np.cumsum(often[some]) - 1).astype(np.uint32)[which] if ranked else None
        out, bounds = [], np.cumsum([0] + [len(x) for x in keys]).tolist()
        for block, mine, i, j in zip(asked.column("block").to_pylist(), keys, bounds, bounds[1:]):
            words = int((own[i:j] & (n[i:j] > 0)).sum())
            ranks = (_gaps(rank[i:j][often[i:j]]), _gaps(mine[(first & often)[i:j]])) if ranked else (None, None)
            out.append((block, k, _planes(n[i:j]), np.packbits(own[i:j]).tobytes(), words, *ranks))
        block, length, n, own, words, ranks, named = zip(*out)
        columns = [pa.array(block, pa.int64()), pa.array(length, pa.int32()), asked.column("bucket"), pa.array(n, pa.binary())]
        columns += [pa.array(own, pa.binary()), pa.array(words, pa.int64()), pa.array(ranks, pa.binary()), pa.array(named, pa.binary())]
        return pa.table(columns, names=[x.split()[0] for x in ANSWERS.split(", ")])

    def count(asked: pa.Table) -> pa.Table:
        keys = _keys(asked)
        n = np.concatenate([_unplaned(x, np.int64) for x in asked.column("n").to_pylist()])
        found, some, which = _distinct(np.concatenate(keys))
        total = np.bincount(which, n, len(found)).astype(np.int64)
        return rows(asked, keys, total[which], some, which)

    def look(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table([pa.array([], t) for t in KINDS], names=[x.split()[0] for x in ANSWERS.split(", ")])
        keys = _keys(asked)
        found, some, which = _distinct(np.concatenate(keys))
        hit, n = _looked_up(there.column("gram").to_numpy().view(np.uint64), there.column("n").to_numpy())(found)
        return rows(asked, keys, np.where(hit, n, 0).astype(np.int64)[which], some, which)

    asks = _met(blocks, _on_counts(answers), ask, "bucket int, block long, keys binary, n binary")
    if counted:
        return _written(asks.groupBy("bucket").applyInArrow(count, ANSWERS), "answers")
    there = known.select(_bucket("gram", bits), "gram", "n").groupBy("bucket")
    return _written(asks.groupBy("bucket").cogroup(there).applyInArrow(look, ANSWERS), "answers")


def _bucket(column: str, bits: int):
    return F.shiftrightunsigned(column, 64 - bits).cast("int").alias("bucket")


KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def _no_answers(blocks: DataFrame) -> DataFrame:
    return blocks.sparkSession.createDataFrame([], ANSWERS)


RUNS = "gram long, context long, lower long, word long, n long, total long"


def _runs(blocks: DataFrame, answers: DataFrame, k: int, least: int) -> DataFrame:
    """The counted runs of ``k`` symbols, each from its owner; ``total`` is the count of the run's context."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, right, k, least)
        at = block.owned[k]
        shorter = [signed(block.ends[k - 1][at - 1]), signed(block.ends[k - 1][at])] if k > 1 else [np.zeros(len(at), np.int64)] * 2
        total = block.n[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.int64)
        columns = [signed(block.ends[k][at]), *shorter, signed(block.symbols[at]), block.n[k][at].astype(np.int64), total.astype(np.int64)]
        return pa.table(columns, names=[x.split()[0] for x in RUNS.split(", ")])

    return _met(blocks, _on_counts(answers).where(F.col("length") <= k), run, RUNS)


def _extended(rows: DataFrame, first: str, by: str) -> DataFrame:
    """Adds ``by``, the hash of the run of hash ``first`` and ``word`` behind it."""

    def run(batches):
        for batch in batches:
            before, word = (batch.column(c).to_numpy().view(np.uint64) for c in (first, "word"))
            yield batch.append_column(by, pa.array(signed((before + word) * _B)))

    return rows.mapInArrow(run, rows.select("*", F.lit(0).cast("long").alias(by)).schema)


def _columns(rows: DataFrame, *names: str) -> list[np.ndarray]:
    table = rows.select(*names).toArrow()
    return [table.column(n).combine_chunks().to_numpy() for n in names]


def _context_sums(blocks: DataFrame, answers: DataFrame, tree: Tree, s: Settings, least_context: int) -> DataFrame:
    """``depth, context, parent, weight_0, weight_1, ...`` of the contexts with successors: the weight of a context where
    its longest retained suffix has so many words; null where it does not diverge from that one.

    Where a block owns so much of a context that no other successor can have ``least`` occurrences, its sums are the
    whole ones, and weights are made there; only those of other contexts are gathered."""
    ends, least, root_of = range(s.depth), tree.least, float(tree.tokens + tree.words + 1)
    sums = ["own", *(f"{c}_{e}" for e in ends for c in ("gain", "below"))]
    schema = "depth int, context long, parent long, whole boolean, " + ", ".join(f"{c} double" for c in sums)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = Block(left, right, s.depth + 1, least), []
        for d in range(1, s.depth + 1):
            at = block.owned[d + 1]
            at = at[block.n[d][at - 1] >= least_context]
            context, some, which = _distinct(block.ends[d][at - 1])
            own = (block.n[d + 1][at] - s.discount) / block.n[d][at - 1]
            parts = [own]
            for e in ends:
                if e >= d:
                    parts += [np.zeros(len(at))] * 2
                    continue
                # What a retained suffix of e words says; its own successors are counted wherever these are.
                n = block.n[e + 1][at]
                below = (n - s.discount) / block.n[e][at - 1] if e else (n + 1.0) / root_of
                parts += [own * np.log(own / below), below]
            parent = block.ends[d - 1][at - 1][some] if d > 1 else np.zeros(len(some), np.uint64)
            whole = block.n[d][at - 1][some] - np.bincount(which, block.n[d + 1][at], len(context)) < least
            columns = [np.full(len(context), d, np.int32), signed(context), signed(parent), whole]
            columns += [np.bincount(which, p, len(context)).astype(float) for p in parts]
            out.append(pa.table(columns, names=["depth", "context", "parent", "whole", *sums]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_()] + [pa.float64()] * len(sums)
        none = pa.table([pa.array([], t) for t in kinds], names=["depth", "context", "parent", "whole", *sums])
        return pa.concat_tables([none, *out])

    rest = F.greatest(1 - F.col("own"), F.lit(1e-12))

    def weight(e: int):
        rest_below = F.greatest(1 - F.col(f"below_{e}"), F.lit(1e-12))
        gain = F.col(f"gain_{e}") + rest * F.log(rest / rest_below)
        return F.when((F.col("depth") > e) & (gain >= s.divergence), rest / rest_below).alias(f"weight_{e}")

    by, weights = ("depth", "context", "parent"), [f"weight_{e}" for e in ends]
    parts = _met(blocks, _on_counts(answers), run, schema)
    kept = [F.when(F.col("whole"), weight(e)).alias(w) for e, w in enumerate(weights)]
    parts = _written(parts.select(*by, "whole", *kept, *(F.when(~F.col("whole"), F.col(c)).alias(c) for c in sums)), "sums")
    shared = parts.where(~F.col("whole")).groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))
    shared = _written(shared.select(*by, *(weight(e) for e in ends)), "weights")
    return parts.where("whole").select(*by, *weights).unionAll(shared)


def _states(weights: DataFrame, depth: int) -> list[DataFrame]:
    """For each level ``context, parent, weight, suffix``: the words of the longest retained suffix, itself included."""
    out = []
    for d in range(1, depth + 1):
        mine = weights.where(F.col("depth") == d)
        if d == 1:
            mine = mine.withColumn("below", F.lit(0))
        else:
            mine = mine.join(out[-1].select(F.col("context").alias("parent"), F.col("suffix").alias("below")), "parent")
        weight = F.coalesce(*(F.when(F.col("below") == e, F.col(f"weight_{e}")) for e in range(d)))
        suffix = F.when(F.col("weight").isNull(), F.col("below")).otherwise(d).cast("int").alias("suffix")
        mine = mine.withColumn("weight", weight).select("context", "parent", "weight", suffix)
        out.append(_written(mine, "states"))
    return out


def _learned(blocks: DataFrame, s: Settings) -> tuple[Tree, DataFrame, DataFrame]:
    """(tree, word counts, answers to all blocks) from the training texts of the blocks."""
    size = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("symbols", "trained"))).first()
    tokens, bits = size["trained"], _bits(size["symbols"])
    least = max(s.min_count, int(np.ceil(s.next_share * tokens)))
    least_context = max(s.min_count, int(np.ceil(s.context_share * tokens)))
    depth = s.depth if tokens else 0
    answers = _answered(blocks, _no_answers(blocks), 1, least, bits, None, depth > 0)
    words = answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    tree = Tree(tokens, words, least, [], [])
    for k in range(2, depth + 2):
        answers = answers.unionAll(_answered(blocks, answers, k, least, bits, None, k <= depth))
    if depth:
        tree.contexts += _states(_context_sums(blocks, answers, tree, s, least_context), depth)
    single = _runs(blocks, answers, 1, least)
    root = (F.col("n") + 1.0) / (tokens + words + 1.0)
    tree.grams.append(single.select("gram", "context", "lower", "word", "n", root.alias("p"), F.lit(True).alias("told")))
    for d, states in enumerate(tree.contexts, 1):
        runs = _runs(blocks, answers, d + 1, least).join(states.select("context", "weight"), "context", "left")
        told = F.col("weight").isNotNull()
        p = F.when(told, (F.col("n") - s.discount) / F.col("total")).alias("p")
        tree.grams.append(runs.select("gram", "context", "lower", "word", "n", p, told.alias("told")))
    return tree, single.select("word", "n"), answers


def grow(docs: DataFrame, settings: Settings | None = None) -> tuple[Tree, DataFrame]:
    """(tree, word counts) learned from the rows of ``docs`` (``doc_id``, ``text``, ``train``) with ``train``."""
    s = settings or Settings()
    return _learned(_blocks(_texts(docs), s.block_tokens), s)[:2]


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _looked_up(keys: np.ndarray, values: np.ndarray):
    """A function from runs to (known, value)."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]

    def look(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(runs), bool), np.zeros(len(runs))
        at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
        return keys[at] == runs, values[at]

    return look


RANKED = "length int, bucket int, retained binary, weights binary"
WEIGHTS = f"block long, {RANKED}"


def _ranked_weights(answers: DataFrame, tree: Tree, bits: int) -> DataFrame:
    """For each length and bucket which of the frequent runs, by rank, are retained contexts, and the weights of these."""

    def run(named: pa.Table, there: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        if len(named):
            keys = np.sort(np.concatenate(_keys(named)))
            context, weight = there.column("context").to_numpy().view(np.uint64), there.column("weight").to_numpy()
            retained, value = _looked_up(context, weight)(keys)
            columns = [[named.column(c)[0].as_py()] for c in ("length", "bucket")]
            columns += [[np.packbits(retained).tobytes()], [value[retained].tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in RANKED.split(", ")])

    levels = (
        x.where("weight IS NOT NULL").select(F.lit(d).alias("length"), _bucket("context", bits), "context", "weight")
        for d, x in enumerate(tree.contexts, 1)
    )
    by = ("length", "bucket")
    named = answers.where(F.col("length") <= len(tree.contexts)).select(*by, "keys").groupBy(*by)
    return _written(named.cogroup(reduce(DataFrame.unionAll, levels).groupBy(*by)).applyInArrow(run, RANKED), "ranked")


def _weights(answers: DataFrame, ranked: DataFrame, depth: int) -> DataFrame:
    """Which of the frequent runs in each answer are retained contexts, and the weights of these."""

    def run(said: pa.Table, there: pa.Table) -> pa.Table:
        ranks, retained, weights = _keys(said, "ranks", np.uint32), [], []
        if len(said):
            weight = _joined(there.column("weights"), np.float64)
            kept = np.unpackbits(_joined(there.column("retained"), np.uint8)).astype(bool)
            place = np.cumsum(kept) - 1
            for mine in ranks:
                hit = kept[mine]
                retained.append(np.packbits(hit).tobytes())
                weights.append(weight[place[mine[hit]]].tobytes())
        columns = [said.column(c) for c in ("block", "length", "bucket")]
        columns += [pa.array(retained, pa.binary()), pa.array(weights, pa.binary())]
        return pa.table(columns, names=[x.split()[0] for x in WEIGHTS.split(", ")])

    by = ("length", "bucket")
    said = answers.where(F.col("length") <= depth).select("block", *by, "ranks").groupBy(*by)
    return said.cogroup(ranked.groupBy(*by)).applyInArrow(run, WEIGHTS)


def _scored(blocks: DataFrame, answers: DataFrame, tree: Tree, s: Settings) -> DataFrame:
    least, depth, root_of = tree.least, len(tree.contexts), float(tree.tokens + tree.words + 1)
    size = blocks.agg(F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.count(F.lit(1)).alias("n")).first()
    ranked = _ranked_weights(answers, tree, _bits(size["symbols"])) if depth else None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of_contexts = right.column("weights").is_valid()
        block = Block(left, right.filter(pc.invert(of_contexts)), depth + 1, least, right.filter(of_contexts))
        known = block.n[1] > 0
        root = (block.n[1] + 1.0) / root_of
        p, open_ = np.ones(len(root)), np.ones(len(root), bool)
        for k in range(depth + 1, 1, -1):
            at = np.flatnonzero(open_ & (block.position >= k - 1))
            value = block.weight[k - 1][at - 1]  # the context ends one symbol before
            at, value = at[value > 0], value[value > 0]
            n = block.n[k][at]
            told = n > 0
            p[at[~told]] *= value[~told]
            at, n = at[told], n[told]
            p[at] *= (n - s.discount) / block.n[k - 1][at - 1]
            open_[at] = False
        p[open_] *= root[open_]
        return pa.table(
            {
                "doc_id": block.docs,
                "train": block.train,
                "n_tokens": pa.array(block.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), block.starts)),
                "base_score": pa.array(np.add.reduceat(np.log10(root), block.starts)),
                "score": pa.array(np.add.reduceat(np.log10(p), block.starts)),
            }
        )

    none = F.lit(None).cast("binary")
    out, rounds = [], max(1, min(s.rounds, size["n"]))
    for i in range(rounds):
        now = F.pmod(F.xxhash64("block"), F.lit(rounds)) == i
        said = _on_counts(answers.where(now)).select("*", none.alias("retained"), none.alias("weights"))
        if depth:
            weights = _weights(answers.where(now), ranked, depth)
            said = said.unionAll(weights.select("block", "length", "bucket", none.alias("n"), none.alias("own"), "retained", "weights"))
        out.append(_written(_met(blocks.where(now), said, run, SCORED), "scores"))
    return reduce(DataFrame.unionAll, out)


def score(docs: DataFrame, tree: Tree, counts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document: tokens (the end is one), those known from training, and log10 probabilities of the
    whole text by the word distribution (``base_score``) and by the tree (``score``)."""
    s = settings or Settings()
    blocks = _blocks(_texts(docs), s.block_tokens)
    bits = _bits(blocks.agg(F.coalesce(F.sum("symbols"), F.lit(0))).first()[0])
    single = _extended(counts.withColumn("lower", F.lit(0).cast("long")), "lower", "gram")
    depth = len(tree.contexts)
    answers = _answered(blocks, _no_answers(blocks), 1, tree.least, bits, single, depth > 0)
    for k in range(2, depth + 2):
        answers = answers.unionAll(_answered(blocks, answers, k, tree.least, bits, tree.grams[k - 1], k <= depth))
    return _scored(blocks, answers, tree, s)


def train_and_score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Learn from the rows with ``train`` and score all rows of ``docs`` (``doc_id``, ``text``, ``train``).

    Adds ``train_tokens`` to what ``score`` gives. Null texts are empty and score their end alone; null ids stay
    null; repeated rows are scored each; other columns are ignored; an empty table gives no rows. Without
    training rows every word is unknown.
    """
    s = settings or Settings()
    blocks = _blocks(_texts(docs), s.block_tokens)
    tree, _, answers = _learned(blocks, s)
    return _scored(blocks, answers, tree, s).withColumn("train_tokens", F.lit(tree.tokens).cast("long"))
