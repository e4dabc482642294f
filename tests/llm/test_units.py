"""The parts of the operators, one by one, and the stages of the pipeline."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bpe, bwt, extraction, fingerprints, maxent, mixing, simhash, suffixes, topk, toolcalls, toxicity
from tessera.llm.components import components

from .conftest import DOCS, NASTY, documents


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 8])
def test_merged_transforms_find_repeats(shards):
    g = np.random.default_rng(shards)
    texts = [bytes(g.integers(0, 2, 150).astype(np.uint8)) for _ in range(5)] + [b"a" * 90, b"", b"short"]
    texts[3] = texts[1][20:130] + texts[3][:30]
    seen = Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    want = [[i for i in range(len(t) - 39) if seen[t[i : i + 40]] > 1] for t in texts]
    assert [x.tolist() for x in bwt.repeated(texts, 40, 10, shards)] == want


def test_weights_stand_for_equal_texts():
    g = np.random.default_rng(9)
    texts = [bytes(g.integers(0, 200, 100).astype(np.uint8)) for _ in range(4)] + [b"", b"x" * 30]
    n = np.array([1, 3, 1, 2, 5, 7])
    got = bwt.repeated(texts, 40, 10, 2, n)
    assert [len(x) for x in got] == [0, 61, 0, 61, 0, 0]


def test_runs_of_few_words_stay():
    raw = b"one two three four five six seven"
    cut = lambda spans, words: suffixes._remove(raw, spans, 8, words)
    assert cut([{"lo": 4, "hi": 6}, {"lo": 10, "hi": 11}], 0) == (raw[:4] + raw[19:], 1)
    assert cut([{"lo": 4, "hi": 6}], 1) == (raw[:4] + raw[14:], 1) and cut([{"lo": 4, "hi": 6}], 2) == (raw, 0)
    assert cut(None, 0) == (raw, 0)


def test_merge_equals_a_sort():
    g = np.random.default_rng(0)
    text = g.integers(0, 3, 400)
    starts, sizes = np.array([0, 100, 250]), np.array([100, 150, 150])
    sym = text[: 400]
    a = bwt.build(starts[:1], sizes[:1], sym, 1, 8)
    b = bwt.build(starts[1:], sizes[1:], sym, 1, 8)
    m, prefix = bwt.merge(a, b, 8)
    end = {p: s + n for s, n in zip(starts, sizes, strict=True) for p in range(s, s + n + 1)}
    head = lambda p, e: tuple(sym[p : min(p + 8, e)])
    heads = [head(p, end[p]) for p in m.suffix[m.ends :]]
    assert heads == sorted(heads)
    for i in range(1, len(heads)):
        x, y = heads[i - 1], heads[i]
        common = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert prefix[m.ends + i] == min(common, 8)


def test_crowded_anchors_give_the_same(spark):
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    rows = [(i, f"{i:03d}" * (40 + i) + base + f"{i:04d}" * 150) for i in range(12)] + [(99, base[:500]), (98, "z" * 1200)]
    docs = spark.createDataFrame(rows, "key string, text string").selectExpr("cast(key as binary) key", "text")
    plain, crowded = ({bytes(r.key): sorted({i for s in r.spans for i in range(s.lo, s.hi + 1)}) for r in suffixes.repeats(docs, c).collect()} for c in (512, 2))
    seen = Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    want = {str(k).encode(): w for k, t in rows if (w := [i for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1])}
    assert plain == want and crowded == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}


def test_thresholds_cover_every_pair():
    g = np.random.default_rng(3)
    sample = g.integers(0, 2**63, 300).astype(np.uint64)
    for total in (10, 10**6, 10**10):
        parts, ts = simhash.allocate(sample, total)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(t + 1 for t in ts) == simhash.DISTANCE + 1


@pytest.mark.parametrize("split", [4096, 64, 16])
def test_links_connect_what_all_pairs_connect(spark, split):
    g = np.random.default_rng(1)
    base = g.integers(0, 2**63, 10).astype(np.uint64)
    f = base[g.integers(0, 10, 600)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << g.integers(0, 64, 600).astype(np.uint64))
    f = np.unique(np.concatenate((f, g.integers(0, 2**63, 100).astype(np.uint64))))
    nodes = spark.createDataFrame([(int(x), 1) for x in f.view(np.int64)], "fp long, n long")
    label = {r.node: r.label for r in components(simhash.links(nodes, 4, split)).collect()}
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    group = np.arange(len(f))
    while True:
        new = np.array([group[n].min() for n in near])
        if (new == group).all():
            break
        group = new
    pairs = {(label.get(int(x), int(x)), int(y)) for x, y in zip(f.view(np.int64), group, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_top_k_blocks(spark, monkeypatch):
    g = np.random.default_rng(5)
    v = g.integers(-3, 4, (700, 6)) / 4
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SMALLEST_BLOCK", 32)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    q = np.floor(v * 1024).astype(int)
    for i in range(0, 700, 100):
        s = q @ q[i]
        want = sorted((-int(s[j]), j) for j in range(700) if j != i)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


def test_features_against_every_window():
    text = (b"the quick brown fox jumps over " * 3 + bytes(range(97, 123)) * 4 + b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa and then some more words 1234567890") * 2
    w = fingerprints.WIDTH
    windows = [text[i : i + w] for i in range(len(text) - w + 1)]
    entropy = [np.log2(w) - sum(c * np.log2(c) for c in Counter(x).values()) / w for x in windows]
    rank = [int(abs(e - fingerprints.TYPICAL) * 4096 + 1) if e >= fingerprints.LEAST else 0 for e in entropy]
    votes = Counter(max(range(a, a + fingerprints.RUN), key=lambda i: (rank[i], -i)) for a in range(len(windows) - fingerprints.RUN + 1))
    want = [i for i in range(len(windows)) if votes[i] >= fingerprints.VOTES and rank[i] > 0]
    mix = lambda x: int(fingerprints._mix(np.frombuffer(x, "<u8")[None, :])[0])
    alone, beside = fingerprints._select([text])[0], fingerprints._select([b"zzz", text, b"other text " * 9])[1]
    assert alone.tolist() == beside.tolist()
    assert len(set(alone.tolist()) ^ {mix(windows[i]) for i in want}) <= 2  # fixed point against floats, at ties


def test_likeness():
    a, b = (" ".join(f"{p}{i * i}" for i in range(200)).encode() for p in ("x", "kq"))
    da, db, dab = fingerprints.digests([a, b, a[: len(a) // 2] + b[: len(b) // 2]])
    assert fingerprints.likeness(da, da) == 1 and fingerprints.likeness(da, db) < 0.1 < fingerprints.likeness(da, dab) < 1


def test_every_text_has_a_feature():
    g = np.random.default_rng(2)
    prose = "the quick brown fox jumps over a lazy dog while seven wizards mix potions and brew strange ales".encode()
    noise = bytes(g.integers(97, 123, 120).astype(np.uint8))
    texts = [x[:n] for x in (prose * 2, noise) for n in range(1, 101)] + [b"a" * n for n in (31, 32, 62, 63, 64, 100, 3000)] + [b"ab" * 500, b"aab" * 40]
    alone = [fingerprints._select([x])[0] for x in texts]
    assert all(len(h) for h in alone)
    for a, b in zip(alone, fingerprints._select([b"", *texts])[1:], strict=True):
        assert a.tolist() == b.tolist()
    d = fingerprints.digests([b"a" * 80, b"b" * 80, b"", b"a" * 80])
    assert fingerprints.likeness(d[0], d[3]) == 1 and fingerprints.likeness(d[0], d[1]) == 0 and fingerprints.likeness(d[0], d[2]) == 0
    # of windows without entropy the first is the feature
    assert len(alone[-3]) == 1 and alone[-3].tolist() == fingerprints._select([b"a" * 32])[0].tolist()


def test_maxent_is_a_distribution():
    words = [f"w{i}".encode() for i in range(3000)]
    counts = np.arange(3000, 0, -1)
    mass = np.zeros(maxent.RARE)
    for w, c in zip(words[maxent.FREQUENT * maxent.MEMBERS :], counts[maxent.FREQUENT * maxent.MEMBERS :], strict=True):
        mass[maxent.rare_class(w) - maxent.FREQUENT] += c + 0.5
    m = maxent.Model(maxent.Vocabulary(words, counts, mass, int(counts.sum()), 3000))
    g = np.random.default_rng(0)
    m.by_class += g.normal(size=m.by_class.shape)
    m.by_word += g.normal(size=m.by_word.shape)
    ids = np.array([maxent._UNSEEN - 1] * maxent.PAD + [5, 2000, 7])
    f = maxent.contexts(ids)[:, maxent.PAD :][:, 2]
    every = np.arange(3000)
    p = 10 ** m.log10(every, np.repeat(f[:, None], 3000, axis=1), m.v.classes)
    unknown = np.array([10 ** m.log10(np.array([maxent._UNSEEN]), f[:, None], np.array([maxent.FREQUENT + j])) * 0.5 for j in range(maxent.RARE)])
    assert abs(p.sum() + unknown.sum() - 1) < 1e-4


def test_maxent_sees_the_third_word_and_grows(spark):
    ids = np.array([maxent._UNSEEN - 1] * 3 + [1, 2, 3, 4, 9, 2, 3, 4])
    f = maxent.contexts(ids)
    assert maxent.PAD == 3 and (f[:, 6] != f[:, 10]).sum() == 1  # only the third word before differs
    assert maxent.FREQUENT * maxent.MEMBERS == 1536 and maxent.table_rows(0) == maxent.ROWS >= 1 << 14
    assert [maxent.table_rows(k * maxent.ROWS * maxent.PER_ROW) // maxent.ROWS for k in (1, 2, 3, 64)] == [1, 2, 4, 64]
    g = np.random.default_rng(0)
    rows, grad = g.integers(0, 1 << 18, 3000), np.ones((3000, 2), np.float32)
    rows[:1500] = rows[0] ^ (1 << 17)
    which, n, total = maxent.segment_sums(rows, grad)
    assert dict(zip(which.tolist(), n.tolist(), strict=True)) == Counter(rows.tolist()) and (total[:, 0] == n).all()
    texts = [f"a{i} b{i % 7} c{i % 5} d" for i in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    v = maxent.hot_words(maxent.count_tokens(docs))
    seen = set()
    for got, where, *_ in maxent._batches(texts, v, 4096):
        seen.update(maxent.contexts(got)[:, where].ravel().tolist())
    assert abs(maxent.count_contexts(docs, v) / len(seen) - 1) < 0.08
    assert maxent.count_contexts(docs.limit(2), v) < 40


def test_maxent_counts_words_and_contexts_in_one_pass(spark, tmp_path, monkeypatch):
    texts = [f"A{i} b{i % 7} c{i % 5} d" for i in range(4000)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    found = maxent.survey(docs)
    counts = maxent.words_of(found)
    want = Counter(w for t in texts for w in maxent.tokens(t))
    assert {bytes(r.w): r.c for r in counts.collect()} == want
    assert abs(maxent.contexts_of(found) / maxent.count_contexts(docs, maxent.hot_words(counts)) - 1) < 0.08
    assert maxent.contexts_of(maxent.survey(docs.where("doc_id is null"))) == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(maxent, "count_contexts", None)  # a second pass over the texts
    assert maxent.op5_maxent(spark, str(tmp_path)).count() == len(texts)


def test_maxent_lays_out_odd_words_as_a_dictionary_would(spark):
    g = np.random.default_rng(1)
    signs = ["a", "b", "\0", "é", "日", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "A", "Z", " "]
    texts = ["".join(g.choice(signs, k)) for k in g.choice([0, 1, 5, 40, 300], 300)] + ["x" * k for k in range(1, 40)] + ["x" * 600_000, "y\0" * 9, "", None, " "]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:99]]], "text string").coalesce(1)
    want = Counter(w for t in [*texts, *texts[:99]] for w in maxent.tokens(t))
    assert {bytes(r.w): r.c for r in maxent.count_tokens(docs).collect()} == want
    for words in (sorted(want, key=lambda w: -want[w]), [maxent.END, b"xxx"], [b"a"], []):
        v = maxent.Vocabulary(words, np.array([want[w] for w in words], np.int64), np.zeros(maxent.RARE), 1, 1)
        for size in (1, 50, 4096):
            every, place = iter(texts), 0
            for ids, where, cls, lengths, rare in maxent._batches(texts, v, size):
                flat = [w for _ in lengths for w in maxent.tokens(next(every))]
                assert ids[where].tolist() == [v.ids.get(w, maxent._UNSEEN + zlib.crc32(w)) for w in flat]
                assert cls.tolist() == [v.classes[v.ids[w]] if w in v.ids else maxent.rare_class(w) for w in flat]
                assert rare == [w for w in flat if w not in v.ids] and lengths.sum() == len(flat)
                place += len(lengths)
            assert place == len(texts)


def test_maxent_rows_are_picked_and_summed_as_by_indexing():
    g = np.random.default_rng(0)
    table, picked = g.normal(size=(50, 8)).astype(np.float32), g.integers(0, 50, (4, 300))
    assert np.array_equal(maxent.sum_rows(table, picked), ((table[picked[0]] + table[picked[1]]) + table[picked[2]]) + table[picked[3]])
    which, n, total = maxent.segment_sums(picked[0] // 3, table[picked[1]])
    assert np.allclose(total, [table[picked[1]][picked[0] // 3 == w].sum(axis=0) for w in which], atol=1e-4) and n.max() > 8


def test_maxent_learns_context(spark):
    rows = [(i, " ".join(["alpha beta"] * 30 if i % 2 else ["gamma delta"] * 30)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = maxent.count_tokens(docs)
    r = maxent.score(docs, maxent.train(docs, maxent.hot_words(counts)), counts).collect()
    assert all(x.score > x.base_score + 5 for x in r)


def test_trees_and_isotonic():
    g = np.random.default_rng(2)
    x = g.random((800, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.7)).astype(float)
    m = toxicity.Trees().fit(x, y).margin(x)
    assert ((m > 0) == (y == 1)).mean() > 0.97
    k, v = toxicity.isotonic(m, y)
    assert (np.diff(k) >= 0).all() and (np.diff(v) >= 0).all()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.bucket() == 2).select("toxic", "tox_score").toPandas()
    r, p = out.tox_score.rank(), out.toxic.sum()
    assert (r[out.toxic == 1].sum() - p * (p + 1) / 2) / (p * (len(out) - p)) > 0.93
    assert ((out.tox_score >= 0.3) & (out.toxic == 0)).sum() < 0.01 * len(out)


def test_obfuscated_words_are_undone():
    f = dict(zip(toxicity.NAMES, toxicity.features("you are an id1ot", {"idiot": 3.0}, 2.0), strict=True))
    assert f["undone"] > 0 and f["mixed"] > 0 and f["you"] > 0


def test_labelled_texts_that_share_a_phrase_stay(spark):
    same = "a shared line of boilerplate that many documents carry "
    data = [(i, same + f"and text {i}", i % 2) for i in range(9)] + [(20, "copy", 1), (21, "copy", 1), (22, "copy", 0), (23, None, 0), (24, "", 0)]
    got = toxicity.once(spark.createDataFrame(data, "doc_id long, text string, toxic int")).collect()
    assert sorted(map(tuple, got)) == [*data[:9], (20, "copy", 1), (22, "copy", 0), (23, "", 0)]


def test_tree_marginals_against_enumeration():
    page = extraction.Page("<div class=post><p>one.<p>two</p><ul><li>a</ul></div><footer>f</footer>")
    m, g = extraction.Model(), np.random.default_rng(4)
    m.w, m.edge = g.normal(size=m.w.shape), g.normal(size=m.edge.shape)
    n, total, on = len(page.nodes), 0.0, np.zeros(len(page.nodes))
    for y in itertools.product((0, 1), repeat=n):
        e = sum(m.w[k] for i in range(n) if y[i] for k in page.features[i]) + sum(m.edge[page.kind[i], y[page.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(e)
        on += np.exp(e) * np.array(y)
    assert np.allclose(m.infer(page)[0], on / total)


def test_extraction_of_other_layouts(spark):
    m = extraction.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for seed in extraction.SEEDS:
        page = extraction.Page(seed)
        y = extraction.seed_labels(page)
        assert m.extract(seed) == page.text([v == 1 for v in y])
    html = '<body><div class="top-bar">Hi <a href=x>log in</a></div><div class="article-content"><h1>T &amp; U</h1><p>First is here, with words.<p>Second <b>bold</b>\n line.<div class="advertisement">Buy</div>tail text.</div><div class="comments-area"><p>nice post, it was good to read it.</p></div></body>'
    assert m.extract(html) == "T & U First is here, with words. Second bold line. tail text."


def test_pieces_of_words_with_marks(spark):
    df = spark.createDataFrame([(0, "\x01a\x02b\x01"), (1, "\x1c\x1d a　b c"), (2, "ab" * 300), (3, "1234567 ½²③"), (4, None)], "doc_id long, text string")
    codec = bpe.default_codec(spark)
    plain = {r.doc_id: r for r in bpe.encode_documents(df, codec).collect()}
    hot = {r.doc_id: r for r in bpe.encode_documents(df.union(df), codec.learn_hot(df.union(df))).collect()}
    for i, t in df.collect():
        assert bytes(plain[i].decoded).decode() == (t or "") and plain[i].ids == hot[i].ids


def test_mixing_follows_the_weights(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 4}") for i in range(4000)] + [(9000 + i, "w", "tiny") for i in range(3)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (by.target <= 3 * by["size"] + 1e-9).all() and abs(by.target.sum() - out["size"].sum()) < 1e-6 * out["size"].sum()
    assert ((by.taken - by.target).abs() <= 9).all()
    assert (out.positions.map(len) == out.copies).all() and out.positions.map(lambda p: all(0 <= x <= 1 for x in p)).all()


def test_cycles_and_schemas(spark):
    calls = [("a", 1, 1, "f", '{"b":1,"a":{"d":1.50,"c":"x"}}', None), ("b", 1, 2, "f", '{"a":1}', ["a"]), ("c", 1, 3, "f", "nope", ["b", "a", "zz"]), ("x", 1, 4, "g", "[1]", ["y"]), ("y", 1, 5, "f", "{}", ["x"])]
    results = [("a", 1, 2, 'ok "q" é\n'), ("q", 1, 9, "lost")]
    c = spark.createDataFrame(calls, "call_id string, conv_id long, seq long, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "call_id string, conv_id long, seq long, output string")
    got = {x.call_id: x for x in toolcalls.order(toolcalls.link(c, r, {"f": {"a": ("OBJECT", False), "b": ("BIGINT", True)}})).collect()}
    assert [got[k].level for k in "abcxy"] == [0, 1, 2, None, None]
    assert got["a"].canonical == '{"arguments":{"a":{"c":"x","d":1.5},"b":1},"id":"a","name":"f","result":"ok \\"q\\" é\\n"}'
    assert got["b"].errors == ["type of a", "missing b"] and got["c"].errors == ["not an object"] and got["q"].status == "orphan"
    assert sorted(x.position for x in got.values()) == list(range(6))


def test_no_message_of_a_chat_is_lost(spark):
    chats = [(None, 0, "user", "one"), (None, 0, "user", "two"), (None, 0, "user", "two"), (None, 1, "assistant", "x"), (None, 1, "assistant", "y"), (None, None, None, "z")]
    chats += [(1, None, "user", "p"), (1, None, "user", "q"), (1, None, "assistant", "p"), (2, 0, None, "r"), (2, 0, None, "s"), (2, 1, "assistant", "t"), (2, 1, None, "t")]
    chats += [(3, 0, "user", "a"), (3, 0, "user", "b"), (3, 1, "assistant", "c"), (3, 1, "assistant", "d"), (3, 1, "tool", "d"), (4, 0, "user", "e"), (4, 1, "assistant", "f")]
    calls, results = toolcalls.chat_calls(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string"))
    got = toolcalls.order(toolcalls.link(calls, results, toolcalls.CHAT_SCHEMAS)).collect()
    rows = set(chats)
    is_call = lambda x: x[2] in ("user", "system")
    assert len(got) == len(rows) - 2  # two results stand in the rows of their calls
    assert sum(r.name is not None for r in got) == sum(map(is_call, rows))
    assert sum('"result":null' not in r.canonical for r in got) == sum(not is_call(x) for x in rows)
    status = Counter((r.conv_id, r.status) for r in got)
    assert status == {(None, "unanswered"): 2, (None, "orphan"): 3, (1, "unanswered"): 2, (1, "orphan"): 1, (2, "orphan"): 4, (3, "ambiguous"): 4, (4, "linked"): 1}
    for k in (None, 1, 2, 3, 4):
        own = [r.position for r in got if r.conv_id == k]
        assert sorted(own) == list(range(len(own)))
    first = [r for r in got if r.conv_id == 3 and r.call_seq is not None and r.result_seq is not None]
    assert len(first) == 1 and '"text":"a"' in first[0].canonical and '"result":"c"' in first[0].canonical


def test_near_dedup_keeps_one_row_a_group(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long, "en", "a", 1), (3, long, "en", "b", 1), (None, long, "en", "c", 1), (7, "quite another text here", "en", "a", 1), (7, "and one more under that id", "en", "a", 1), (8, "quite another text here", None, "a", 1), (None, "only this one without id", "en", "a", 1)]
    rows += [rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {(3, long), (7, rows[3][1]), (7, rows[4][1]), (None, rows[6][1])}
    for n in (1, 5):
        got = simhash.first_of_each(spark, docs.repartition(n), "").collect()
        assert len(got) == 4 and {(r.doc_id, r.text) for r in got} == want


def test_passages_of_over_fifty_words_go(spark):
    word = lambda k, n: " ".join(f"{chr(97 + k)}{(i * 7919 + k * 131) % 9973}" for i in range(n))
    shared, short = word(0, 52), word(1, 45)
    rows = [(i, f"{word(2 + i, 60)} {shared} {word(7 + i, 60)} {short if i < 2 else 'end'}", "en", "a", 1) for i in range(4)] + [(9, word(12, 90), "en", "a", 1)]
    out = {r.doc_id: r.text for r in suffixes.strip_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    for i in range(4):
        assert shared[3:-3] not in out[i] and word(2 + i, 59) in out[i] and (short in out[i]) == (i < 2)
    assert out[9] == rows[-1][1]


def test_chains_of_calls(spark):
    n = 2000
    chain = spark.range(n).selectExpr("cast(id as string) call_id", "array(cast(id - 1 as string)) after")
    got = {int(r.call_id): r.level for r in toolcalls.levels(chain).collect()}
    assert got == {i: i for i in range(1, n)}


@pytest.mark.parametrize("seed", range(6))
def test_levels_against_the_longest_way(spark, seed):
    g = np.random.default_rng(seed)
    n = int(g.integers(2, 22))
    back = lambda i: [f"c{g.integers(0, n + 2 if seed % 2 else max(1, i))}" for _ in range(g.integers(0, 4))]
    calls = {f"c{i}": set(back(i) if i else []) for i in range(n)}
    after = {c: {p for p in ps if p in calls} for c, ps in calls.items()}
    level: dict = {}
    for _ in range(n + 1):
        level |= {c: max((level[p] + 1 for p in ps), default=0) for c, ps in after.items() if all(p in level for p in ps)}
    got = {r.call_id: r.level for r in toolcalls.levels(spark.createDataFrame([(c, sorted(p)) for c, p in calls.items()], "call_id string, after array<string>")).collect()}
    assert got == {c: level.get(c) for c, ps in after.items() if ps}


@pytest.mark.parametrize("seed", range(3))
def test_long_words_against_the_library(spark, seed):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    g = np.random.default_rng(seed)
    some = lambda letters, n: "".join(g.choice(list(letters), n))
    texts = [some("aab", 4000), some("etaoinshrdlu", 3000), some("éüaß", 700), "ab" * 200, "a" * 100_000, some("abc", 257), some("xyz", 255), "Z" + "a" * 255]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.default_codec(spark).encode(df).collect():
        assert r.ids == ",".join(map(str, enc.encode_ordinary(texts[r.doc_id]))), r.doc_id


def test_training_pages_are_the_least_hashed(spark):
    from pyspark.sql import functions as F

    from tessera.llm.common import least_hashed

    df = spark.range(3000)
    h = F.xxhash64("id")
    want = {r.id for r in df.orderBy(F.pmod(h, F.lit(1 << 62))).limit(50).collect()}
    assert {r.id for r in least_hashed(df, h, 50).collect()} == want
    assert least_hashed(df.where("id < 20"), h, 50).count() == 20 and least_hashed(df.where("false"), h, 50).count() == 0


def test_pipeline_stages(spark, nasty, empty):
    import corpus_pipeline

    for d, rows in ((nasty, documents(NASTY)), (empty, [])):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            before, out = docs.collect(), stage(spark, docs, d).cache()
            got = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns
            if not rows:
                assert not got
            elif name == "toxicity":
                model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
                assert Counter(got) == Counter(r for r in before if model.score([r.text])[0] < toxicity.THRESHOLD)
            elif name == "simhash":
                print_of = {t: simhash.fingerprint(t) for t in {r.text for r in before}}
                group = {t: t for t in print_of}
                for _ in group:
                    for a, b in itertools.product(group, group):
                        if (print_of[a] ^ print_of[b]).bit_count() <= 4:
                            group[b] = group[a]
                groups: dict = {}
                for r in before:
                    groups.setdefault(group[r.text], []).append(r)
                assert len(got) == len(groups) and {group[r.text] for r in got} == set(groups)
                for r in got:
                    ids = [x.doc_id for x in groups[group[r.text]] if x.doc_id is not None]
                    assert r in before and r.doc_id == min(ids, default=None)
            elif name == "suffixes":
                raw = [(r.text or "").encode() for r in before]
                n = suffixes.STAGE_LENGTH
                seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
                want = Counter()
                for r, t in zip(before, raw, strict=True):
                    k, _ = suffixes._remove(t, [{"lo": i, "hi": i} for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1], n, suffixes.STAGE_WORDS)
                    want[(r.doc_id, r.text if k == t else k.decode("utf-8", "ignore"))] += 1
                assert Counter((r.doc_id, r.text) for r in got) == want
            elif name == "mixing":
                taken = mixing.mix(docs.selectExpr("uuid() doc_id", "text", "source")).collect()
                assert set(got) <= set(before) and abs(len(got) - sum(r.copies for r in taken)) <= len(taken)
            else:
                assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(len(before)))
                assert [(r.doc_id, r.text) for r in sorted(got, key=lambda r: r.position)] == [(r.doc_id, r.text) for r in before]
            docs = out


def test_splits_by_arrays_are_the_patterns(spark):
    """Apostrophes, white space and scripts in every order, and texts that end within them."""
    import pyarrow as pa
    import tiktoken
    import public_tokenizers as P

    assert bpe.SPLIT == P.PATTERN
    g, parts = np.random.default_rng(5), ["'", "'s", "'re", "'ll", "'l", "'S", "s", "t", "ve", "e", "l", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "1", "½", "é", "語", "😀", "́", ".", "''", "​", "r"]
    texts = [None, "", *("".join(g.choice(parts, n)) for n in g.integers(1, 12, 6000)), None, ""]
    by_match = bpe.SPLIT.replace(r"[^\s", "[^" + bpe.SPACE).replace(r"\s", "[" + bpe.SPACE + "]").replace(r"\S", "[^" + bpe.SPACE + "]")
    for some in (texts, [t for t in texts if t and t.isascii()], [None, ""], []):
        (a, n), (b, m) = (bpe._words(pa.array(some, pa.string()), p, bpe.char_classes()) for p in (bpe.SPLIT, by_match))
        assert a.to_pylist() == b.to_pylist() and n.tolist() == m.tolist()
        a, n = bpe._words(pa.array(some, pa.string()).slice(1, 700), bpe.SPLIT, bpe.char_classes())
        assert ["".join(a[i:j].to_pylist()) for i, j in itertools.pairwise(n.tolist())] == [t or "" for t in some[1:701]]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in bpe.encode_documents(rows).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids) and bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_a_word_is_folded_once_a_text(spark):
    """Unknown words that stand in a text again are handed on once, with the gaps they fill."""
    codec = bpe.default_codec(spark)
    df = spark.createDataFrame([(0, "qzxqv wqzk qzxqv qzxqv the wqzk"), (1, "the"), (2, None)], "doc_id long, text string")
    folded, make = [], codec._folded
    codec._folded = lambda d, *a: folded.append(d) or make(d, *a)
    got = {r.doc_id: r.ids for r in codec.encode(df).collect()}
    asked = {r.doc_id: (r["__rare"], r["__at"]) for r in folded[0].collect()}
    assert asked == {0: (["qzxqv", " wqzk", " qzxqv"], [0, 1, 2, 2, 1]), 1: ([], []), 2: ([], [])} and got[2] == "" and got[1] == str(codec.ranks.words["the"])


def test_batches_are_encoded_in_parts(spark):
    """More bytes than a task works on at a time, with empty texts and unknown words in each part."""
    import public_tokenizers as P
    import tiktoken

    texts = [None if i % 50 == 7 else "" if i % 50 == 8 else f"qzxqv{i} the end of it, wqzk " * (20_000 if i == 300 else 600) for i in range(900)]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert sum(map(len, filter(None, texts))) > 2 * bpe.BATCH_BYTES
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.encode_documents(rows).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids) and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
