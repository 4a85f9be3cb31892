import hashlib
import io
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pytest
from helpers import awkward, empty

from auricle.llm import chat, packing, separators, warc
from auricle.llm.queries import ORACLES, QUERIES
from auricle.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.connect(sf), sf, QUERIES[name], ORACLES[name]) is None


# --- tokens and packing

ODD = [
    "Σας ΣΑΣ don't we'll it's_x a_b 12.5km İx é ​日本語テスト１２ ½ a\u0085b\x1cc\x00d <|endoftext|> </s>[INST] '",
    "  ", "", "naïve—test … “q” 🙂🙂 a🙂b\n\n\t x''s 'S ÉCOLE école e\u0301", "x" * 3000, "%%% ## a%b",
]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_tokenizer(spark, sf):
    import pyarrow as pa

    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect())]
    for cache in (0, 50, 100_000):
        encode = Encoder(PATH, cache)
        for _ in range(2):
            ids, bounds = encode(pa.array(texts))
            assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == plain_ids(texts)


def test_pack_round_trip(spark):
    table = awkward(spark)
    rows = packing.pack(table, PATH).toPandas()
    texts = [(r.doc_id, r.text) for r in table.collect()]
    want = []
    for (doc, _), ids in zip(texts, plain_ids([t for _, t in texts])):
        ids = [*ids, 0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((-1 if doc is None else doc, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = rows.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, got.astype(int).to_numpy().tolist())) == sorted(want)
    check_gapless(rows, 2048)
    assert packing.pack(empty(spark), PATH).count() == 0


def check_gapless(rows, limit):
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.offset.tolist() == [0, *group.length.cumsum().tolist()[:-1]]
        assert group.length.sum() <= limit


def one_by_one(lengths, caps):
    """Plain vector best fit, a piece at a time."""
    bins, weights = [], np.array(caps.weights)
    limit = np.array([caps.tokens, caps.documents, caps.attention])
    for n in sorted(lengths, reverse=True):
        demand = np.array([n, 1, n * n])
        best = None
        for i, rest in enumerate(bins):
            if (rest >= demand).all():
                if caps.rule == "norm":
                    value = ((((rest - demand) / limit) ** 2) * weights).sum()
                else:
                    value = -(weights * rest / limit * demand / limit).sum()
                if best is None or value < best[0] - 1e-15:
                    best = (value, i)
        if best is None:
            bins.append(limit - demand)
        else:
            bins[best[1]] = bins[best[1]] - demand
    return sorted(map(tuple, (limit - b for b in bins)))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, attention", [(100, 100 * 100), (3, 100 * 100), (100, 3000)])
def test_classes_place_like_one_by_one(rule, documents, attention):
    rng = np.random.default_rng(3)
    caps = packing.Capacities(100, documents, attention, (1.0, 0.3, 0.2), rule)
    lengths = rng.integers(1, caps.longest + 1, 400).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit(counts, caps)
    bins: dict[int, list[int]] = {}
    placed = dict.fromkeys(counts, 0)
    for r in plan.itertuples():
        placed[r.length] += r.pieces
        for k in range(r.pieces):
            bins.setdefault(r.sequence + k // r.per, []).append(r.length)
    assert placed == counts
    used = sorted((sum(b), len(b), sum(x * x for x in b)) for b in bins.values())
    assert all(t <= 100 and d <= documents and a <= attention for t, d, a in used)
    plain = one_by_one(lengths, caps)
    assert abs(len(used) - len(plain)) <= 2


def test_packing_is_tight(spark, sf):
    rows = QUERIES["op1_best_fit_packing"](spark, sf).toPandas()
    check_gapless(rows, 2048)
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 2


def test_bad_capacities():
    with pytest.raises(ValueError):
        packing.Capacities(rule="first")
    with pytest.raises(ValueError):
        packing.best_fit({200: 1}, packing.Capacities(100, 5, 100 * 100))


# --- separators


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    files = {
        "a": [5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9], "b": [1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 1], "c": [1] * 20,
        "d": [], "e": [9, 9, 9],
    }
    want = []
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
        start = n = 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((str(tmp_path / name), n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((str(tmp_path / name), n, start, len(ids) - start, False))
    table = spark.createDataFrame([(str(tmp_path / k), len(v)) for k, v in files.items()], "path string, tokens long")
    got = separators.scan(table, f"file://{tmp_path}", 9, block)
    columns = ["path", "ordinal", "start", "n_tokens", "ended"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def test_token_counts(spark):
    table = awkward(spark)
    texts = [(r.doc_id, r.text) for r in table.collect()]
    want = [(str(d), len(ids)) for (d, _), ids in zip(texts, plain_ids([t for _, t in texts]))]
    got = [(str(r.doc_id), r.n_tokens) for r in separators.token_counts(table, PATH, 49407).collect()]
    assert sorted(got) == sorted(want)
    assert separators.token_counts(empty(spark), PATH, 49407).count() == 0


# --- chat


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "<s", "[/INST", "</s></s>", "", "\n", "é🙂"]


def test_escape_is_reversible():
    for text in HOSTILE:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)
        assert chat.read_marked(chat.marked([(text, text), ("user", text)])) == [(text, text), ("user", text)]


def test_turns_read_back(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(HOSTILE)]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a")]
    rows += [(None, 0, "tool", "x"), (4, 0, "assistant", "z" * 300_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(talks(spark, rows))).collect()}
    order = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        order.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(order)
    for c, turns in order.items():
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].formatted_chars == len(chat.marked(turns))
        assert got[c].turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_turns(talks(spark, rows).where("false")).count() == 0


def test_long_conversations_keep_their_spans():
    turns = [(("user", "assistant")[i % 2], f"text {i}") for i in range(50)]
    short = chat.Renderer(chat.marked, history=4)
    out = [short.add(t) for t in turns]
    whole = chat.marked(turns)
    assert "".join(p for p, *_ in out) == whole and {x[-1] for x in out} == {chat.KEPT}
    assert [whole[lo:hi] for _, _, lo, hi, _ in out] == [t for _, t in turns]


def number_templates():
    """The same template twice, as a black box and one that goes on from a state (made here: tasks take it by value)."""

    def numbered(turns):
        return "BEGIN" + "".join(f"<{i}>{t}" for i, (_, t) in enumerate(turns))

    class Numbered(chat.Resumable):
        def begin(self):
            return "BEGIN", 0

        def turn(self, state, turn):
            return f"<{state}>{turn[1]}", state + 1

    return numbered, Numbered()


def test_templates_that_rewrite_history_are_noticed():
    shortens = lambda turns: "".join(f"{r}:{t}\n" if i == len(turns) - 1 else f"{r}\n" for i, (r, t) in enumerate(turns))
    r = chat.Renderer(shortens)
    assert [r.add((who, "a"))[-1] for who in ("user", "assistant", "user")] == [chat.KEPT, chat.REWRITTEN, chat.REWRITTEN]
    trims = lambda turns: "".join(f"[{t.strip()}]" for _, t in turns)
    piece, start, lo, hi, status = chat.Renderer(trims).add(("user", "  x "))
    assert (piece, piece[lo:hi], status) == ("[x]", "x", chat.KEPT)


def test_a_cut_history_is_not_a_rewritten_one():
    """A black box that looks further back than the history: nothing was rewritten, but spans end at the cut."""
    r = chat.Renderer(number_templates()[0], history=3)
    out = [r.add(("user", f"t{i}")) for i in range(9)]
    assert [x[-1] for x in out] == [chat.KEPT] * 6 + [chat.CUT] * 3 and all(x[:4] == (None,) * 4 for x in out[6:])

    def wants_the_beginning(turns):
        if turns and turns[0][0] != "system":
            raise ValueError("the first turn must be the system's")
        return chat.marked(turns)

    r = chat.Renderer(wants_the_beginning, history=2)
    got = [r.add(("system" if i == 0 else "user", "x"))[-1] for i in range(7)]
    assert got == [chat.KEPT] * 4 + [chat.CUT] * 3


def test_resumable_templates_keep_spans_at_any_length(spark):
    texts = [f"t{i}" for i in range(400)]
    numbered, resumable = number_templates()
    r = chat.Renderer(resumable, history=3)
    out = [r.add(("user", t)) for t in texts]
    whole = numbered([("user", t) for t in texts])
    assert "".join(x[0] for x in out) == whole and {x[-1] for x in out} == {chat.KEPT}
    assert [whole[x[2] : x[3]] for x in out] == texts
    table = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts[:150])], "conv_id long, turn long, role string, text string")
    for template, status in ((resumable, {chat.KEPT}), (numbered, {chat.KEPT, chat.CUT})):
        assert {r.status for r in chat.format_turns(table, template).collect()} == status


# --- archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, refers_to string")


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (5, None, "same"), (3, "x\r\ny: z", "same"), (2, "", None), (9, "u", ""), (4, "é", "é🙂\r\n\r\n")]
    rows += [(7, "b", "z" * 200_000), (None, "n", "same"), (8, "t", "twice"), (8, "t", "twice")]
    got = warc.round_trip(pages(spark, rows), f"file://{tmp_path}").collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert {i: (by_id[i].record_type, by_id[i].refers_to) for i in (1, 3, 5, 2, 9)} == {
        1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("revisit", 9), 9: ("response", None)
    }
    for page, _, html in rows:
        payload = (html or "").encode()
        assert (by_id[page].payload_bytes, by_id[page].payload_digest) == (len(payload), warc.digest_of(payload))
    assert by_id[None].record_type == "response" and [r.record_type for r in got if r.page_id == 8] == ["response"] * 2
    small = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, rows), least_bytes=3).collect()}
    assert small[2] == small[9] == "response" and small[1] == "revisit"
    assert warc.round_trip(pages(spark, rows).where("false")).count() == 0
    # Another reader agrees.
    names = [p for p in tmp_path.iterdir() if p.suffix == ".wacz"]
    assert names and all(zipfile.ZipFile(p).testzip() is None for p in names)


def test_an_id_with_several_payloads_is_judged_for_each(spark, tmp_path):
    rows = [(1, "u", "AAA"), (1, "u", "BBB"), (2, "u", "AAA"), (3, "a b\x07c\u200b\n", "CCC")]
    located = warc.places(warc.write_packages(pages(spark, rows), f"file://{tmp_path}"), f"file://{tmp_path}")
    got = warc.read_records(located, f"file://{tmp_path}").collect()
    kinds = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for r in got}
    digest = {t: warc.digest_of(t.encode()) for t in ("AAA", "BBB", "CCC")}
    assert kinds == {
        (1, digest["AAA"]): ("revisit", 2, None),
        (1, digest["BBB"]): ("response", None, "BBB"),
        (2, digest["AAA"]): ("response", None, "AAA"),
        (3, digest["CCC"]): ("response", None, "CCC"),
    }
    assert {r.url for r in got if r.page_id == 3} == {"a b%07c%E2%80%8B%0A"}


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(zip64):
    out = io.BytesIO()
    package = warc.PackageWriter(out, zip64)
    places = {n: package.add(n, [d]) for n, d in ((warc.DATA, b"data" * 9), (warc.INDEX, b""), ("ü", b"PK\5\6"))}
    package.close()
    source = Source(out.getvalue())
    found = {m.name: m for m in warc.directory(source, source.size())}
    assert {n: m.offset for n, m in found.items()} == places and all(m.stored for m in found.values())
    assert warc.read_range(source, found[warc.DATA].offset, found[warc.DATA].size) == b"data" * 9
    assert zipfile.ZipFile(io.BytesIO(out.getvalue())).testzip() is None


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment with PK\5\6 inside"
        z.writestr("a", "x" * 100)
        z.writestr("b", "y" * 100, zipfile.ZIP_DEFLATED)
    source = Source(out.getvalue())
    found = {m.name: m for m in warc.directory(source, source.size())}
    assert found["a"].stored and not found["b"].stored
    assert warc.read_range(source, found["a"].offset, 100) == b"x" * 100
    with pytest.raises(ValueError):
        warc.directory(Source(b"nothing"), 7)
    broken = bytearray(out.getvalue())
    struct.pack_into("<I", broken, len(broken) - 22 - len(b"a comment with PK\5\6 inside") + 16, 1)
    with pytest.raises(ValueError):
        warc.directory(Source(bytes(broken)), len(broken))


def test_spans_do_not_depend_on_a_length(spark):
    """Without a history, or with a declared look-back, a long conversation has the spans of its whole rendering."""
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(300)]
    numbered, _ = number_templates()

    def after(turns):  # a turn says what the two before it were
        return "BEGIN" + "".join(f"<{[t for _, t in turns[max(0, i - 2) : i]]}>{t}" for i, (_, t) in enumerate(turns))

    for template, history in ((numbered, None), (after, None), (chat.Near(after, 2), 1), (chat.Near(after, 5), 1)):
        r = chat.Renderer(template, history=history)
        out, whole = [r.add(t) for t in turns], template(turns)
        assert len(r.turns) == (template.reach if isinstance(template, chat.Near) else len(turns))
        assert "".join(x[0] for x in out) == whole and {x[-1] for x in out} == {chat.KEPT}
        assert [whole[x[2] : x[3]] for x in out] == [t for _, t in turns]

    def forgets(turns):  # rewrites its beginning, but only in long conversations
        return numbered(turns) if len(turns) <= 200 else "..." + numbered(turns[-200:])

    r = chat.Renderer(forgets, history=None)
    assert [r.add(t)[-1] for t in turns] == [chat.KEPT] * 200 + [chat.REWRITTEN] * 100
    table = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert {x.status for x in chat.format_turns(table, numbered, history=None).collect()} == {chat.KEPT}


def test_the_chat_query_renders_few_turns_at_any_length(spark, tmp_path):
    """As the SQL says for 1,000 turns in one conversation, and each turn is rendered by itself."""
    rows = [(c, i, ("user", "assistant")[i % 2], HOSTILE[i % len(HOSTILE)]) for c in (1, None) for i in range(1000)]
    talks(spark, rows).drop("piece").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op9_incremental_rendering"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op9_incremental_rendering']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    made = []
    counted = chat.Near(lambda turns: made.append(len(turns)) or chat.marked(turns))
    r = chat.Renderer(counted)
    assert all(r.add((role, text or ""))[-1] == chat.KEPT for _, _, role, text in rows) and max(made) == 1


def test_the_chat_query_compares_whole_prefixes(spark, tmp_path, monkeypatch):
    """Its template is a black box: one that numbers its turns is read back as rendered whole, one that rewrites is noticed."""

    def numbered(turns):
        said = [(chat.escape(r), f"{i} {chat.escape(t)}") for i, (r, t) in enumerate(turns)]
        return "".join(f"{chat.BEGIN}{chat.ROLE}{r}{chat.TEXT}{t}{chat.END}\n" for r, t in said)

    def forgets(turns):  # rewrites its beginning, but only in long conversations
        return numbered(turns if len(turns) <= 200 else turns[-200:])

    rows = [(c, i, ("user", "assistant")[i % 2], f"<s>{i}") for c, n in ((1, 3), (2, 300)) for i in range(n)]
    talks(spark, rows).drop("piece").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(chat, "marked", numbered)
    got = {r.conv_id: r for r in QUERIES["op9_incremental_rendering"](spark, str(tmp_path)).collect()}
    for c in (1, 2):
        turns = [r for r in rows if r[0] == c]
        every, loss = "".join(f"{r}\n{i} {t}\n" for _, i, r, t in turns), "".join(t for _, i, r, t in turns if i % 2)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(numbered([r[2:] for r in turns]))
    monkeypatch.setattr(chat, "marked", forgets)
    with pytest.raises(Exception, match="conversation 2: the template rewrote"):
        QUERIES["op9_incremental_rendering"](spark, str(tmp_path)).collect()
