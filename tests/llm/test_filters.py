import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, awkward, docs, empty, prose, words
from pyspark.sql import functions as F

from auricle.llm import decontamination, quality, suffix_tree, toxicity, urls
from auricle.llm.queries import ORACLES, QUERIES, URL_RULES


# --- quality rules


def plain_counts(text):
    found = [w.decode() for w in WORD.findall((text or "").encode())]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    times = collections.Counter(windows)
    marked = set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(marked)


def test_quality_counts_equal_a_plain_version(spark):
    table = awkward(spark)
    got = quality.judge(table, []).collect()
    assert len(got) == table.count()
    for r in got:
        n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert n == plain_counts(r.text)
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed)


def test_quality_rules_are_learned_and_applied(spark):
    clean = [prose(i, 80) for i in range(60)]
    shouted = [" ".join(w + "%%" for w in prose(100 + i, 80).split()) for i in range(40)]
    table = docs(spark, clean + shouted)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 100, 1)], "doc_id long, quality int")
    rules = quality.learn(table, labels)
    assert rules and all(r.clean == 0 for r in rules)
    judged = {r.doc_id: r.kept for r in quality.judge(table, rules).collect()}
    assert judged == {i: i < 60 for i in range(100)}
    kept = quality.keep(table, rules)
    assert kept.columns == table.columns and kept.count() == 60
    assert quality.learn(table, labels.where("false")) == []
    assert quality.keep(empty(spark), rules).count() == 0
    assert quality.keep(awkward(spark), []).columns == awkward(spark).columns


def test_quality_query_on_the_table(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op5_decision_list"](spark, sf).collect()}
    truth = spark.read.parquet(f"{sf}/labels.parquet").collect()
    judged = [(got[r.doc_id], r.quality) for r in truth if not got[r.doc_id].base_failed]
    assert np.mean([g.kept == bool(q) for g, q in judged]) >= 0.95


# --- toxicity


def test_machine_learns_a_pair_that_weights_miss():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 6))
    target = (x[:, 0] & x[:, 1]).astype(float)
    rows, features = np.nonzero(x)
    s = toxicity.Settings(steps=400)
    bias, linear, factors = toxicity.train(rows, features, target, 6, s)
    model = toxicity.Model(20, np.arange(6), bias, linear, factors)
    p = model.scores(rows, features, len(x))
    assert ((p >= 0.5) == target).mean() > 0.98
    brute = bias + x @ linear + sum((factors[i] @ factors[j]) * x[:, i] * x[:, j] for i in range(6) for j in range(i))
    assert np.allclose(p, 1 / (1 + np.exp(-brute)))


def spoken(kinds, per):
    """Texts of each kind: prose with the kind's words, each text unlike the others."""
    out = []
    for k, words_of_kind in enumerate(kinds):
        for i in range(per):
            r = prose(10_000 * k + i, 30).split()
            for j, w in enumerate(words_of_kind):
                r.insert(7 * (j + 1), w)
            out.append(" ".join(r))
    return out


@pytest.mark.parametrize(
    "kinds, toxic",
    [
        # An insult with a group mention; either alone is harmless, and the mention is commoner in harmless texts.
        ([("grobnik", "zulvarian"), ("grobnik",), ("zulvarian",), ("zulvarian",), ()], [1, 0, 0, 0, 0]),
        # An insult that is toxic alone and harmless beside a word of quoting, which is as common elsewhere.
        ([("grobnik",), ("grobnik", "quothsay"), ("quothsay",), ("quothsay",), ()], [1, 0, 0, 0, 0]),
    ],
)
def test_fit_learns_pairs_that_single_terms_miss(spark, kinds, toxic):
    per = 150
    texts = spoken(kinds, 2 * per)
    label = [toxic[i // (2 * per)] for i in range(len(texts))]
    known = [i for i in range(len(texts)) if i % 2 == 0]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, label[i]) for i in known], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = [(got[i] >= 0.3, label[i]) for i in range(len(texts)) if i % 2]
    assert sum(p and t for p, t in held) >= 0.9 * sum(t for _, t in held)
    assert sum(p and not t for p, t in held) <= 0.05 * sum(not t for _, t in held)


def test_a_text_with_contradicting_labels_is_toxic(spark):
    texts = [prose(i % 40, 30) + (" vileword" if i % 40 < 20 else "") for i in range(80)]
    rows = [(i, int(i % 40 < 20 and i < 40)) for i in range(80)]  # each text once toxic, once not
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    a, b = (toxicity.fit(docs(spark, texts).repartition(n), labels) for n in (1, 5))
    assert (a.buckets == b.buckets).all() and np.allclose(a.linear, b.linear)
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), a).collect()}
    assert min(got[i] for i in range(20)) > 0.3 > max(got[i] for i in range(20, 40))


def test_toxicity_on_awkward_tables(spark):
    bad = [prose(i, 40) + " vileword " + prose(50 + i, 20) for i in range(60)]
    table = docs(spark, [prose(200 + i, 60) for i in range(140)] + bad)
    labels = spark.createDataFrame([(i, int(i >= 140)) for i in range(0, 200)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    odd = awkward(spark)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.keep(table, model, 0.3)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(range(140))
    assert toxicity.score(empty(spark), model).count() == 0
    blank = toxicity.fit(table, labels.where("false"))
    assert {r.score for r in toxicity.score(table, blank).collect()} == {0.5}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op7_factorization_machine"](spark, sf).collect()}
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    hits = [(got[r.doc_id].predicted, r.toxic) for r in held]
    assert sum(p and t for p, t in hits) >= 0.8 * sum(t for _, t in hits)
    assert sum(p and not t for p, t in hits) <= 0.01 * len(hits)


# --- decontamination

ITEM = "Please work out how many apples Anna keeps when she buys 12 apples at the market, gives 5 of them to Bert and then, walking home with Anna and 12 friends, eats 3 km later"


def changed(text):
    return text.replace("Anna", "Carla").replace("12", "40").replace("Bert", "Dieter").replace("5 of", "17 of")


def test_template_windows(spark):
    filler = prose(1, 50)
    mixed = ITEM.replace("with Anna", "with Otto").replace("and 12 friends", "and 99 friends").replace("5 of", "6 of")
    texts = [
        filler, f"{filler}. {ITEM} {filler}", f"{filler}. {changed(ITEM)} {filler}", mixed,
        ITEM[: len(ITEM) // 3], "12 13 14 15 16 17 18 19 20 21 22 23 24", f"{ITEM}\n{changed(ITEM)}",
    ]
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "too short"), (4, None), (None, "x")], "item_id long, text string")
    strict = decontamination.Settings(agreement=1.0)
    got = {r.doc_id: r for r in decontamination.report(docs(spark, texts), bench, strict).collect()}
    assert [got[i].contaminated for i in range(len(texts))] == [False, True, True, False, False, False, True]
    assert got[1].item_id == 1 and got[1].items == 1 and got[2].coverage == 1.0
    assert got[2].slots == got[2].consistent_slots > 0
    kept = decontamination.remove(docs(spark, texts), bench, strict)
    assert {r.doc_id for r in kept.collect()} == {0, 3, 4, 5} and kept.columns == docs(spark, texts).columns


def test_decontamination_on_awkward_tables(spark):
    bench = spark.createDataFrame([(1, prose(2, 60)), (2, prose(3, 60))], "item_id long, text string")
    odd = awkward(spark)
    got = decontamination.report(odd, bench).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.contaminated} == {5, None}
    assert sum(r.contaminated for r in got) == 3
    left = decontamination.remove(odd, bench)
    assert left.count() == odd.count() - 3 and left.columns == odd.columns
    assert decontamination.remove(odd, bench.where("false")).count() == odd.count()
    assert decontamination.report(empty(spark), bench).count() == 0
    blocks = decontamination.Settings(block_rows=7)
    assert decontamination.remove(odd, bench, blocks).count() == odd.count() - 3


def test_decontamination_finds_what_contains_an_item(spark, sf):
    norm = lambda t: " ".join(t.lower().split())
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(i in norm(r.text) for i in items)}
    got = {r.doc_id for r in QUERIES["op3_template_windows"](spark, sf).where("contaminated").collect()}
    assert want and got == want


def test_items_without_windows_are_found_whole(spark):
    items = ["What is the capital of France?", "Compute 3 + 4 * 12 - 5.", "What is 12 * 45 + 7 - 3 * 8 / 2 + 19?"]
    bench = spark.createDataFrame([(i + 1, t) for i, t in enumerate([*items, items[0], " ", None])], "item_id long, text string")
    filler = prose(4, 30)
    texts = [f"{filler}. {t} {filler}" for t in items]
    texts += [items[0].lower(), items[0].replace("France", "Spain"), items[1].replace("12", "13"), items[2].replace("19", "20"), filler, None, ""]
    table = docs(spark, texts)
    got = {r.doc_id: r.item_id for r in decontamination.report(table, bench).collect()}
    assert [got[i] for i in range(len(texts))] == [1, 2, 3, 1, None, None, None, None, None, None]
    assert decontamination.report(table, bench, decontamination.Settings(block_rows=1)).where("contaminated").count() == 4
    assert {r.doc_id for r in decontamination.remove(table, bench).collect()} == set(range(4, len(texts)))


def test_names_count_wherever_they_stand_and_case_does_not(spark):
    item = "Anna buys 12 apples at the market. Anna gives 5 of them to Bert. How many apples does Anna keep?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("of them", "of her apples").replace("at the market", "in town").replace("How many", "Which")
    mixed = changed(item).replace("does Carla", "does Otto").replace("to Dieter", "to Carla").replace("17 of", "40 of")
    texts = [changed(item), item.lower(), item.upper(), f"{prose(5, 30)}. {changed(item)}", other, prose(6, 40)]
    got = {r.doc_id: r.contaminated for r in decontamination.report(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == [True] * 4 + [False] * 2
    strict = decontamination.Settings(agreement=1.0)
    assert not decontamination.report(docs(spark, [mixed]), bench, strict).first().contaminated


def test_every_reading_equals_its_sql(spark):
    """The twin knows all readings and whole items: the items of the tests above, and mixtures of them."""
    import duckdb

    long = "Anna buys 12 apples at the market. Anna gives 5 of them to Bert. How many apples does Anna keep after 3 Km?"
    items = [ITEM, long, "What is the capital of France?", "Compute 3 + 4 * 12 - 5.", "What is 12 * 45 + 7 - 3 * 8 / 2 + 19?", long, " ", None]
    bench = spark.createDataFrame([(i + 1, t) for i, t in enumerate(items)], "item_id long, text string")
    filler = prose(4, 30)
    texts = [f"{filler}. {t} {filler}" for t in items if t]
    texts += [changed(t) for t in items if t] + [t.lower() for t in items if t] + [t.upper() for t in items if t]
    texts += [long.replace("12", "x"), long + " " + ITEM, changed(long).replace("does Carla", "does Otto"), "“Anna” 5 km, 7 Euros. 3,5 KG", None, ""]
    texts += [ITEM.replace("Anna", "anna"), long.replace("keep", "keep,"), f"5{long}", f"“{long}"]
    table = docs(spark, texts)
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    con.register("benchmark", bench.toPandas())
    columns = decontamination.report(table, bench).columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op3_template_windows']}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in decontamination.report(table, bench).orderBy("doc_id").collect()]
    assert got == want and sum(r[1] for r in got) >= 15 and {r[3] for r in got} >= {1, 2, 3, 4, 5, None}


# --- suffix tree


def test_tree_is_a_distribution_and_scores_like_a_plain_walk(spark):
    texts = ["a b a b a b c", "a b a b d d d", "b a b a", "", "c c"] * 6
    rows = [(i, t) for i, t in enumerate(texts)]
    table = docs(spark, rows).withColumn("train", F.col("doc_id") % 7 != 2)
    s = suffix_tree.Settings(depth=2, context_share=0.01, next_share=0.005, min_count=2, divergence=0.01)
    tree, counts = suffix_tree.grow(table, s)
    known = {r.word: r.n for r in counts.collect()}
    assert len(tree.levels) == 2 and len(tree.levels[0].raw) and tree.tokens == sum(known.values())
    roots = tree.root(np.array([n for n in known.values()] + [0]))
    place = {int(np.uint64(w).view(np.int64)): i for i, w in enumerate(tree.frequent)}
    word = np.array([place.get(w, -1) for w in known] + [-1])
    for level, states in enumerate(tree.levels, 1):
        for index in range(len(states.raw)):
            p = tree.probability(np.full(len(word), level), np.full(len(word), index), word, roots)
            assert math.isclose(p.sum(), 1, abs_tol=1e-9)
    scored = {r.doc_id: r for r in suffix_tree.score(table, tree, counts, s).collect()}
    train = collections.Counter()
    for i, t in rows:
        if i % 7 != 2:
            train.update([*words(t), "end"])
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        symbols = [*words(t), "end"]
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in symbols)
        r = scored[i]
        assert (r.n_tokens, r.n_known) == (len(symbols), sum(train[x] > 0 for x in symbols))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.train == (i % 7 != 2)
    held = [r for r in scored.values() if not r.train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tree_keeps_what_it_learned_when_the_corpus_grows(spark):
    phrase = [f"odd{i} pair{i} here{i}" for i in range(5)] * 4
    small = docs(spark, [prose(i, 20) for i in range(5)] + phrase).withColumn("train", F.lit(True))
    filler = spark.range(1000).select(
        (F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("la li lu "), 1000).alias("text"), F.lit(True).alias("train")
    )
    large = small.select("doc_id", "text", "train").unionByName(filler)  # 3 million tokens
    told = []
    for table in (small, large):
        tree, counts = suffix_tree.grow(table)
        told.append(set(tree.levels[0].raw.tolist()))
        scored = {r.doc_id: r for r in suffix_tree.score(small, tree, counts).collect()}
        assert all(scored[i].score > scored[i].base_score / 2 for i in range(5, 25))
    assert told[0] and told[0] <= told[1]


def test_tree_scores_by_its_tables_as_by_its_arrays(spark):
    texts = [prose(i % 7, 30) + " " + prose(i, 12) for i in range(40)] + ["", "ba na", "ba"]
    table = docs(spark, texts).withColumn("train", F.col("doc_id") % 5 != 2)
    s = suffix_tree.Settings(divergence=0.01)
    tree, counts = suffix_tree.grow(table, s)
    assert len(tree.levels) == 3 and all(len(x.raw) for x in tree.levels)
    known = {r.word: r.n for r in counts.collect()}
    got = {r.doc_id: r.score for r in suffix_tree.score(table, tree, counts, s).collect()}
    for i, text in enumerate(texts):
        seq = suffix_tree.Sequences(pa.array([text]))
        raws, total = seq.contexts(3), 0.0
        for j, symbol in enumerate(seq.symbols):
            level = index = 0
            for depth in (1, 2, 3):
                at = np.flatnonzero(tree.levels[depth - 1].raw == raws[depth - 1][j]) if j >= depth else []
                if len(at):
                    level, index = depth, at[0]
            word = np.flatnonzero(tree.frequent == symbol)
            root = tree.root(np.array([known.get(int(symbol.view(np.int64)), 0)]))
            one = (np.array([level]), np.array([index]), np.array([word[0] if len(word) else -1]), root)
            total += math.log10(tree.probability(*one)[0])
        assert math.isclose(got[i], total, rel_tol=1e-9, abs_tol=1e-9)


def test_tree_sends_only_runs_that_may_be_frequent_whatever_the_blocks(spark, monkeypatch):
    texts = [prose(i % 7, 30) + " " + " ".join(f"once{i}x{j}" for j in range(60)) for i in range(30)] + ["", "ba na"]
    table = docs(spark, texts).withColumn("train", F.col("doc_id") % 5 != 2)
    written, materialize = {}, suffix_tree.materialize

    def kept(df, name, batch_rows=None):
        written.setdefault(name, []).append(materialize(df, name, batch_rows))
        return written[name][-1]

    monkeypatch.setattr(suffix_tree, "materialize", kept)
    got = []
    for tokens in (1_500_000, 200):
        written.clear()
        rows = suffix_tree.train_and_score(table, suffix_tree.Settings(block_tokens=tokens)).collect()
        got.append({r.doc_id: (r.n_tokens, r.n_known, r.score) for r in rows})
        # Of 90 and more symbols a text, 30 and the end repeat: longer runs are asked for among these alone.
        asked = {r.length: r.n for x in written["answers"] for r in x.groupBy("length").agg(F.sum(F.length("n") / 8).alias("n")).collect()}
        assert asked[1] > 1800 and max(asked[k] for k in (2, 3, 4)) <= 32 * 32
        assert (written["blocks"][0].count() > 5) == (tokens == 200)
    assert len(got[0]) == len(texts)
    for i, (n, known, score) in got[0].items():
        assert got[1][i][:2] == (n, known) and math.isclose(got[1][i][2], score, rel_tol=1e-9)


def test_tree_writes_weights_once_and_scores_in_rounds_whatever_the_blocks(spark, monkeypatch):
    texts = [prose(i % 7, 30) + " " + prose(i, 12) for i in range(40)] + ["", "ba na", "ba", "unheard of"]
    table = docs(spark, texts).withColumn("train", F.col("doc_id") % 5 != 2)
    written, materialize = {}, suffix_tree.materialize

    def kept(df, name, batch_rows=None):
        written.setdefault(name, []).append(materialize(df, name, batch_rows))
        return written[name][-1]

    monkeypatch.setattr(suffix_tree, "materialize", kept)
    got, weights = [], []
    for tokens, rounds in ((1_500_000, 1), (100, 1), (100, 3)):
        written.clear()
        s = suffix_tree.Settings(divergence=0.01, block_tokens=tokens, rounds=rounds)
        got.append({r.doc_id: r for r in suffix_tree.train_and_score(table, s).collect()})
        tables = [x for name in written for x in written[name] if "weights" in x.columns]
        weights.append(sum(x.agg(F.sum(F.length("weights"))).first()[0] for x in tables))
        assert (written["blocks"][0].count() > 10) == (tokens == 100)
        assert [x.count() > 0 for x in written["scores"]] == [True] * rounds
        sums = written["sums"][0].select("depth", "context", "whole").collect()
        whole = [(r.depth, r.context) for r in sums if r.whole]
        shared = {(r.depth, r.context) for r in sums if not r.whole}  # the only ones that are gathered
        assert len(whole) > len(shared) > 0 and len(set(whole)) == len(whole) and not shared & set(whole)
    # One weight for each retained context; before, one for each block that met it.
    assert weights[0] > 0 and weights == weights[:1] * 3
    assert len(got[0]) == len(texts) and any(r.score > r.base_score for r in got[0].values())
    for other in got[1:]:
        for i, r in got[0].items():
            assert (other[i].n_tokens, other[i].n_known, other[i].train) == (r.n_tokens, r.n_known, r.train)
            assert math.isclose(other[i].base_score, r.base_score, rel_tol=1e-9)
            assert math.isclose(other[i].score, r.score, rel_tol=1e-9)


def test_tree_on_awkward_tables(spark):
    odd = awkward(spark).withColumn("train", F.col("doc_id") != 4)
    got = suffix_tree.train_and_score(odd).collect()
    assert len(got) == odd.count() and all(r.score < 0 or r.n_tokens == 1 for r in got)
    assert next(r for r in got if r.doc_id == 4).n_known == 1
    assert suffix_tree.train_and_score(empty(spark).withColumn("train", F.lit(True))).count() == 0
    untrained = suffix_tree.train_and_score(odd.withColumn("train", F.lit(False))).collect()
    assert {r.base_score for r in untrained} == {0.0} and {r.train_tokens for r in untrained} == {0}


# --- urls


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.EXAMPLE.net/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"),
        ("http://net", "net", "", None, None),
        ("http://net/", "net", "/", "net/", "block"),
        ("x://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("https://org/fr/a://b", "org", "/fr/a:", None, None),
        ("no address", "", "", None, None),
        (None, "", "", None, None),
        ("https://m.casino-win.example.org/en/7", "m.casino-win.example.org", "/en/7", None, "block"),
        ("https://blog.nation.example.org/en/7", "blog.nation.example.org", "/en/7", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    model = urls.fit(urls.labelled_urls(spark))
    table = spark.createDataFrame([(1, url, "x")], "page_id long, url string, score string")
    (got,) = urls.judge(table, URL_RULES, model).collect()
    if url == "https://org/fr/a://b":
        assert (got.host, got.path, got.rule) == ("org", "/fr/a://b", "org/fr/")
        return
    assert (got.host, got.path, got.rule) == (host, path, rule)
    assert got.verdict == verdict or verdict is None


def test_url_regression_equals_a_plain_one(spark):
    """Runs of bytes as they are, weights in a dictionary, one row after the other."""
    s = urls.Settings(bits=22, steps=40)
    rows = [(r.url, r.label) for r in urls.labelled_urls(spark).collect()]

    def runs(url):
        host, _, path = url.partition("://")[2].partition("/")
        out = set()
        for mark, text in (("^", host.lower()), (">", "/" + path)):
            framed = (mark + text + "$").lower().encode()
            out |= {(mark, framed[i : i + n]) for n in (3, 4, 5) for i in range(len(framed) - n + 1)}
        return out

    texts, target = [runs(u) for u, _ in rows], [y for _, y in rows]
    n, ones = len(rows), sum(target)
    share = [n / (2 * (ones if y else n - ones)) / n for y in target]
    weights, speed, bias, speed_bias = {}, {}, 0.0, 0.0
    for _ in range(s.steps):
        grad, all_errors = {g: s.decay * w for g, w in weights.items()}, 0.0
        for x, y, part in zip(texts, target, share):
            margin = bias + sum(weights.get(g, 0.0) for g in x) / len(x) ** 0.5
            error = (1 / (1 + np.exp(-margin)) - y) * part
            all_errors += error
            for g in x:
                grad[g] = grad.get(g, 0.0) + error / len(x) ** 0.5
        for g, d in grad.items():
            speed[g] = 0.9 * speed.get(g, 0.0) - s.rate * d
            weights[g] = weights.get(g, 0.0) + speed[g]
        speed_bias = 0.9 * speed_bias - s.rate * all_errors
        bias += speed_bias
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.score for r in urls.judge(table, [], urls.fit(urls.labelled_urls(spark), s), s).collect()}
    for i, x in enumerate(texts):
        margin = bias + sum(weights.get(g, 0.0) for g in x) / len(x) ** 0.5
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-2)  # a bucket may hold two runs


def test_url_hosts_that_were_not_trained_on(spark):
    """No host of the given pages is in the labelled table; unwanted ones are still told apart."""
    unwanted = ("spam-farm", "adult-x", "casino-win", "cheap-pills", "free-bets", "ads-track")
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = urls.judge(table, [], urls.fit(urls.labelled_urls(spark))).filter("host <> ''").collect()
    trained = {u.split("/")[0] for u in (*urls.BLOCKED, *urls.ALLOWED)}
    assert not any(r.host in trained or any(n in t for t in trained for n in unwanted) for r in got)
    bad = [r.verdict == "block" for r in got if any(n in r.host for n in unwanted)]
    good = [r.verdict == "allow" for r in got if not any(n in r.host for n in unwanted)]
    assert np.mean(bad) >= 0.9 and np.mean(good) >= 0.95


def test_url_model(spark):
    table = spark.createDataFrame([(None, None), (2, ""), (2, "")], "page_id long, url string")
    model = urls.fit(urls.labelled_urls(spark))
    assert urls.judge(table, [], model).count() == 3
    assert urls.judge(table.where("false"), [], model).count() == 0
    with pytest.raises(ValueError):
        urls.fit(urls.labelled_urls(spark), urls.Settings(max_labelled=3))
    assert urls.fit(urls.labelled_urls(spark).where("false"))[0] == 0.0
