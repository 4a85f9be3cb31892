import collections

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import awkward, docs, empty, prose, words

from auricle.llm import common, neardup, packing
from auricle.llm.components import components
from auricle.llm.queries import QUERIES


def plain(texts):
    """Smallest reachable id by exact comparison of all sets."""
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = collections.defaultdict(list)
    for i in sorted(sets):
        met = collections.Counter()
        for s in sets[i]:
            met.update(lists[s])
            lists[s].append(i)
        for j, n in met.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def same(got, texts):
    want = plain(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_equals_all_pairs(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(QUERIES["op8_minhash_near_dedup"](spark, sf).collect(), texts)


@pytest.mark.parametrize("block", [4, 1024])
def test_chains_and_crowds(spark, monkeypatch, block):
    """A chain of copies of copies, a crowd around one text, and texts that share half."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", block)
    base = prose(1, 120).split()
    texts = [" ".join(base)]
    chain = list(base)
    for i in range(12):
        chain[10 * i] = f"new{i}"
        texts.append(" ".join(chain))
    crowd = prose(2, 100).split()
    for i in range(40):
        other = list(crowd)
        other[(7 * i) % 100] = f"odd{i}"
        other[(7 * i + 31) % 100] = f"even{i}"
        texts.append(" ".join(other))
    texts += [" ".join(crowd[:50]) + " " + prose(10 + i, 50) for i in range(20)]
    texts += ["a b c", "A B c", "a b", "a b c d", "a b c d e", "a b c d e f", "a b c d e"]
    rows = list(enumerate(texts))
    same(neardup.near_duplicates(docs(spark, rows)).collect(), rows)


def test_awkward_tables(spark):
    table = awkward(spark)
    got = neardup.near_duplicates(table).collect()
    assert len(got) == table.count()
    none = [r for r in got if r.doc_id is None]
    assert len(none) == 2 and all(r.kept and r.component_id is None for r in none)
    assert {r.n_shingles for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert all(r.kept for r in got)
    kept = neardup.keep_first(table)
    assert kept.columns == table.columns and kept.count() == table.count() - 1
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.keep_first(empty(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20), (5, 4), (30, 31), (31, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs_.columns, docs_
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        left = stage(spark, left, sf)
        assert left.columns == columns
        rows = left.collect()
        assert {r.doc_id for r in rows} <= before and len(rows) == len({r.doc_id for r in rows})
        left = spark.createDataFrame(rows, docs_.schema)
    texts = [(r.doc_id, r.text) for r in rows]
    assert all(i == top for i, (_, top) in plain(texts).items())
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in texts}


def test_pipeline_on_awkward_tables(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf).count() == 0, name
        odd = stage(spark, awkward(spark), sf)
        assert odd.count() >= 0, name


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Signatures, sets and pieces are made of batches of few texts; the session's own limit is as before."""
    limit, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(limit)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows = spark.range(25_000).coalesce(1).mapInArrow(sizes, "n long")
    got = [r.n for r in common.materialize(rows, "sizes", common.TEXTS_PER_BATCH).collect()]
    assert sum(got) == 25_000 and max(got) <= common.TEXTS_PER_BATCH < int(before)
    plain = common.materialize

    def noted(df, name, batch_rows=None):
        seen.append((name, batch_rows))
        return plain(df, name, batch_rows)

    monkeypatch.setattr(neardup, "materialize", noted)
    monkeypatch.setattr(packing, "materialize", noted)
    table = docs(spark, [prose(i % 3, 40) for i in range(9)])
    neardup.near_duplicates(table, neardup.Rules()).collect()
    packing.pack(table, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {n for n, k in seen if k == common.TEXTS_PER_BATCH} == {"signed", "sets", "pieces"}
    assert spark.conf.get(limit) == before
