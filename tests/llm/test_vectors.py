"""Online packing, hard negatives and vector codes against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, docs, empty, prose
from pyspark.sql import functions as F

from auricle.llm import hard_negatives as hn
from auricle.llm import online_packing as op
from auricle.llm import vector_codes as vc

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# --- online packing


def plain_choice(counts, size, window):
    """The fullest of the levels with the least sum of squares after placing."""
    best = None
    for level in range(window - size, -1, -1):
        if level and not counts.get(level):
            continue
        after = dict(counts)
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] = after.get(level + size, 0) + 1
        squares = sum(n * n for n in after.values())
        if best is None or squares < best[0]:
            best = squares, level, after
    return best


def test_levels_minimise_the_sum_of_squares():
    r = random.Random(3)
    for window in (1, 2, 7, 24):
        levels, counts = op.Levels(window), {}
        for _ in range(400):
            size = r.choice([1, window, r.randint(1, window)])
            level = levels.choose(size)
            squares, want, counts = plain_choice(counts, size, window)
            assert level == want
            levels.add(level, -1)
            levels.add(level + size, 1)
            assert levels.squares == squares


@pytest.mark.parametrize("window, held", [(16, 10**6), (16, 40), (10, 1), (4096, 5000)])
def test_packer_places_every_id_once(window, held):
    r = random.Random(window + held)
    settings, rows, sent = op.Settings(window, held), [], {}
    packer = op.Packer(settings)
    for doc in range(300):
        sent[doc] = np.array([r.randint(0, 60_000) for _ in range(r.choice([1, 3, window, 2 * window + 1, r.randint(1, 50)]))], np.uint16)
        rows += packer.place(doc, sent[doc])
        if packer.held > held:
            rows += packer.settle(last=False)
            assert packer.held < window
    rows += packer.settle(last=True)
    check_rows(rows, {(d, len(x), x.tobytes()) for d, x in sent.items()}, window)
    assert sum(n for _, _, n, *_ in rows) == sum(map(len, sent.values()))


def check_rows(rows, sent, window):
    """Documents are covered without gaps, windows too; only full windows and powers of two."""
    texts, windows = {}, {}
    for doc, start, n, crc, total, seq, offset in rows:
        texts.setdefault((doc, total), []).append((start, n, crc))
        windows.setdefault(seq, []).append((offset, n))
    by_doc = {}
    for doc, total, raw in sent:
        by_doc.setdefault((doc, total), []).append(np.frombuffer(raw, np.uint16))
    for key, pieces in texts.items():
        # Repeated rows have equal ids, so their pieces can be told by content alone.
        flat = by_doc[key][0]
        for start, n, crc in pieces:
            assert crc == zlib.crc32(flat[start : start + n].astype("<u4").tobytes())
        assert sum(n for _, n, _ in pieces) % key[1] == 0
        if sum(n for _, n, _ in pieces) == key[1]:
            ends = 0
            for start, n, _ in sorted(pieces):
                assert start == ends and n > 0
                ends += n
    assert set(texts) == set(by_doc)
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)


def test_pack_awkward_texts(spark):
    table = awkward(spark)
    rows = [tuple(r) for r in op.pack(table, PATH).select(*op.NAMES).collect()]
    texts = [(r.doc_id, r.text) for r in table.collect()]
    ids = plain_ids([t for _, t in texts], 2)
    by_text = {}
    for (doc, _), x in zip(texts, ids):
        by_text.setdefault((doc, len(x)), np.array(x, np.uint16))
    check_rows(rows, {(d, n, x.tobytes()) for (d, n), x in by_text.items()}, 4096)
    assert sum(r[2] for r in rows) == sum(map(len, ids))
    assert op.padding(op.pack(table, PATH)).first().padding == 0
    assert op.pack(empty(spark), PATH).count() == 0 and op.padding(op.pack(empty(spark), PATH)).first().tokens == 0


def test_few_documents_are_cut(spark):
    table = docs(spark, [prose(i, 20 + 37 * i % 700) for i in range(400)]).coalesce(1)
    found = op.padding(op.pack(table, PATH)).first()
    assert found.padding == 0
    assert found.sequences <= found.tokens // 4096 + 12
    assert found.cut <= found.sequences  # a border cuts one document at most


# --- hard negatives


def plain_mine(rows, every, s=hn.Settings()):
    rows = [(i, *r) for i, r in enumerate(rows) if None not in r]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for at, anchor, label, vec in rows:
        if anchor % every:
            continue
        ranked = sorted((-score(vec, v), i, n, lab) for n, i, lab, v in rows if n != at)
        for minus, positive, _, _ in [x for x in ranked if x[3] == label][: s.positives]:
            inside = [x for x in ranked if x[3] != label and s.low * -minus <= 100 * -x[0] <= s.high * -minus]
            for rank, x in enumerate(inside[: s.negatives], 1):
                out.append((anchor, positive, rank, x[1], -minus, -x[0]))
    return sorted(out)


SCHEMA = "vec_id long, label int, vec array<long>"


def mined(spark, rows, every, s=None):
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("own").alias("row"), F.lit(1).alias("_part"), F.lit("x").alias("score"))
    return sorted(tuple(r) for r in hn.mine(table.coalesce(1), every, s).collect())


def random_rows(seed, n, width, most, labels=3):
    r = random.Random(seed)
    return [(i, r.randrange(labels), [r.randint(-most, most) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(
    "most, s",
    [
        (2, hn.Settings(block_values=60, anchors=4)),  # ties everywhere, many blocks and teams
        (100, hn.Settings()),
        (100, hn.Settings(positives=2, negatives=4, low=-50, high=130, block_values=100)),
        (2**24, hn.Settings(block_values=150)),  # beyond float32
        (2**29, hn.Settings(block_values=150)),  # beyond float64 and 64-bit keys
    ],
)
def test_mining_equals_all_pairs(spark, most, s):
    rows = random_rows(most, 150, 5, most)
    assert mined(spark, rows, 10, s) == plain_mine(rows, 10, s) != []


def test_mining_awkward_rows(spark):
    r = random.Random(5)
    rows = random_rows(1, 60, 4, 9, labels=2)
    rows += [(None, 1, [1, 2, 3, 4]), (70, None, [1, 2, 3, 4]), (80, 1, None), (90, 1, []), (91, 0, [5]), (92, 0, [3, 1, 4, 1, 5, 9])]
    rows += [(100, 1, [9, 9, 9, 9])] * 3 + [(r.randrange(200), 5, [9, 9, 9, 9]) for _ in range(30)]  # copies
    rows += [(110, 7, [1, 0, 0, 0])]  # the only row of its label
    assert mined(spark, rows, 10, hn.Settings(block_values=40)) == plain_mine(rows, 10)
    assert mined(spark, rows[:0], 10) == []
    assert mined(spark, [(1, 1, [1]), (3, 2, [1])], 10) == []
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [2**32]), (1, 1, [1])], 10)


def test_search_stops_at_the_threshold():
    """One long list: the best are met at once, and the rest is never scored."""
    block = hn.Block(np.random.default_rng(1).normal(0, 100, (5000, 2)).astype(np.int64))
    scored = []

    def eligible(active, fresh):
        scored.append(len(fresh))
        return np.ones((len(active), len(fresh)), bool)

    far = np.array([[1 << 90]], object)
    found = block.search(np.array([[3, -1]]), -far, far, 5, eligible)
    want = sorted((-(3 * x - y), i) for i, (x, y) in enumerate(block.vectors.tolist()))[:5]
    assert list(zip((-found.score).tolist(), found.candidate.tolist())) == want
    assert sum(scored) < 1000


def test_quantise_leaves_out_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.001],), ([1.0, None],), ([nan],), ([-inf],), (None,), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(hn.quantise(F.col("v"), 256).alias("q")).collect()
    assert [r.q for r in got] == [[128, -1], None, None, None, None, []]


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    rows = [r for r in rows if r[2] is not None]
    width = max((len(r[2]) for r in rows), default=0)
    size = -(-width // parts)
    vectors = [r[2] + [0] * (size * parts - len(r[2])) for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:entries]
    books = [[vectors[i][p * size : (p + 1) * size] for i in first] for p in range(parts)]

    def near(v, p):
        part = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds if rows else 0):
        sums = {}
        for v in vectors:
            for p in range(parts):
                sums.setdefault((p, near(v, p)[1]), []).append(v[p * size : (p + 1) * size])
        for (p, e), members in sums.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    coded = [[near(v, p) for p in range(parts)] for v in vectors]
    errors = [sum(far for far, _ in c) for c in coded]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    out = [(r[0], r[1], [i for _, i in c], e, by_label[r[1]]) for r, c, e in zip(rows, coded, errors)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(out, key=str), hashlib.sha256(text.encode()).hexdigest()


def codes(spark, rows, **settings):
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("own").alias("codes"), F.lit(1).alias("error"), F.lit(2).alias("_label"))
    coded, books = vc.compress(table.repartition(3), vc.Settings(**settings))
    return sorted((tuple(r) for r in coded.select("vec_id", "label", "codes", "error", "label_error").collect()), key=str), books


@pytest.mark.parametrize("most, width, parts, entries", [(3, 4, 2, 5), (1000, 8, 4, 16), (2**26, 6, 3, 4), (2**28, 2, 2, 4)])
def test_codes_equal_plain_rounds(spark, most, width, parts, entries):
    rows = random_rows(most, 120, width, most)
    coded, books = codes(spark, rows, parts=parts, entries=entries, rounds=4)
    assert (coded, books.sha256()) == plain_codes(rows, parts, entries, 4)


def test_codes_of_awkward_rows(spark):
    rows = random_rows(2, 30, 5, 4) + [(None, None, [1, 2, 3, 4, 5]), (31, None, [1]), (32, 1, []), (33, 0, None), (34, None, [7] * 5)]
    rows += [(3, 1, [0, 0, 1, 0, 0])] * 2
    for entries in (4, 256):
        coded, books = codes(spark, rows, parts=4, entries=entries, rounds=3)
        assert (coded, books.sha256()) == plain_codes(rows, 4, entries, 3)
    coded, books = codes(spark, rows[:0])
    assert coded == [] and books.entries.size == 0
    with pytest.raises(ValueError):
        codes(spark, [(1, 1, [2**31])])


def test_limbs_keep_products_exact():
    r = np.random.default_rng(4)
    for width, most in ((1, 2**30), (16, 2**28), (300, 2**26), (4, 3), (2, 2**24)):
        a, b = (r.integers(-most, most + 1, (20, width)) for _ in range(2))
        a[0], b[0] = most, -most
        bits, n = vc.limb_plan(width, most)
        assert width * (2**bits - 1) ** 2 < 2**53
        want = [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
        assert vc.dot(a, b, bits, n).tolist() == want


def test_decoded_vectors_have_the_error_of_their_codes(spark):
    rows = random_rows(8, 200, 8, 500)
    table = spark.createDataFrame(rows, SCHEMA)
    coded, books = vc.compress(table, vc.Settings(parts=4, entries=8))
    vectors = {r.vec_id: r.vec for r in vc.decode(coded, books).collect()}
    errors = {r.vec_id: r.error for r in coded.collect()}
    assert {i: sum((a - b) ** 2 for a, b in zip(v, vectors[i])) for i, _, v in rows} == errors
