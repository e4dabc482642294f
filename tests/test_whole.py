"""Queries over awkward rows of small tables, against brute force."""

import hashlib
import re

import pytest

from tessera import catalog


@pytest.fixture
def write(spark, tmp_path):
    """Writes tables by name; gives their folder."""

    def put(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def rows(spark, name, folder):
    return catalog.QUERIES[name](spark, folder).collect()


def test_diagnostics_of_long_texts(spark, write):
    texts = [(1, "a b a b c c c"), (2, "word " * 1500 + "x y z " * 200), (3, "w" * 4000), (4, None), (5, " "), (6, "one two three")]
    data = [(i, t, None if i == 6 else len(t or "")) for i, t in texts]
    got = {r.doc_id: r for r in rows(spark, "text_diagnostics", write(documents=(data, "doc_id long, text string, n_chars long")))}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[6].words_per_second is None
    for i, t in texts:
        if t is None:
            continue
        w, r = t.split(), got[i]
        best = run = 0
        for k in range(len(w)):
            run = run + 1 if k and w[k] == w[k - 1] else 1
            best = max(best, run)
        share = lambda n: 0 if len(w) < n else 1 - len({tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) / (len(w) - n + 1)  # noqa: B023, E731
        assert (r.word_count, r.longest_run, r.empty_text) == (len(w), best, not w)
        assert r.repeated_bigrams == pytest.approx(share(2), abs=1e-6) and r.repeated_trigrams == pytest.approx(share(3), abs=1e-6)


def test_errors_of_whole_turns(spark, write):
    head = "the same first sixty characters of every turn are alike, so that "
    turns = [(1, 0, head + "cats sleep"), (1, 1, head + "dogs bark all night"), (1, 2, head), (1, 3, head + "Dogs, bark all day"), (2, 0, ""), (2, 1, "x y"), (3, 0, "word " * 400), (3, 1, "word " * 380 + "other " * 30)]
    d = write(conversations=(turns, "conv_id long, turn long, text string"))
    clean = {(c, t): re.sub("[^a-z ]", "", x.lower()) for c, t, x in turns}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = {k: (x, clean[k[0], k[1] + 1]) for k, x in clean.items() if (k[0], k[1] + 1) in clean}
    key = lambda r: (r.conv_id, r.turn)
    assert {key(r): r.disagreement for r in rows(spark, "char_disagreement", d)} == {k: round(edits(a, b) / max(1, len(a), len(b)), 6) for k, (a, b) in pairs.items()}
    errors = {k: edits(a.split(), b.split()) for k, (a, b) in pairs.items()}
    assert errors[1, 0] == 4 and {key(r): r.errors for r in rows(spark, "pair_word_error", d)} == errors
    assert {key(r): (r.errors, r.balance) for r in rows(spark, "alignment_split", d)} == {k: (errors[k], len(b.split()) - len(a.split())) for k, (a, b) in pairs.items()}
    for r in rows(spark, "corpus_wer", d):
        own = [k for k in pairs if (k[1] % 2 == 0) == r.unseen]
        assert r.wer == pytest.approx(100 * sum(errors[k] for k in own) / sum(len(pairs[k][0].split()) for k in own), abs=1e-6)


def test_queries_without_slices_of_ids(spark, write):
    events = [(i, i % 4, ("a", "b", None)[i % 3], float((i * 7919) % 490)) for i in range(2900, 3130)] + [(5000 + i, 9, "a", 1.0) for i in range(3)]
    docs = [(i, f"text {i}", "en", ("p1", "other")[i > 0], 30 * i) for i in range(0, 400, 7)] + [(401, None, None, "p2", 0)]
    pages = [(i, f"http://h/x/p{i}.html") for i in range(30)] + [(30, "http://h/x/14.html?a=1"), (31, "http://h/x/15.html#top")]
    d = write(events=(events, "event_id long, user_id long, event_type string, value double"), documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), pages=(pages, "page_id long, url string"))
    want = {g: hashlib.sha256(",".join(str(e[0]) for e in sorted(events, key=lambda e: (e[3], e[0])) if e[2] == g).encode()).hexdigest() for g in ("a", "b", None)}
    assert {r.event_type: r.digest for r in rows(spark, "ordered_index_digest", d)} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert {r.event_type: r.digest for r in rows(spark, "ordered_index_digest", d)} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lengths = {e[0]: round(e[3] * 20) for e in events}
    picked = rows(spark, "range_candidate_pick", d)
    assert len(picked) == len(docs)
    for r in picked:
        need = next(x[4] for x in docs if x[0] == r.doc_id)
        fit = sorted((k for k, v in lengths.items() if v >= need), key=lambda k: (-lengths[k], str(k)))
        assert r.eligible == len(fit) and (r.candidate in fit if fit else r.candidate is None)
    curves = [[e[3] for e in sorted(events) if e[1] == u] for u in range(10)]
    curves = [c for c in curves if c and len(c) % 3 == 0]
    assert curves and {r.epoch: r["mean"] for r in rows(spark, "curve_means", d)} == {k: round(sum(c[k] for c in curves) / len(curves), 6) for k in range(3)}
    joined = [(f"http://h/x/p{i}.html", "") for i in range(30)] + [("http://h/x/14.html", "text 7"), ("http://h/x/15.html", "")]
    assert sorted(map(tuple, rows(spark, "basename_left_join", d))) == sorted(joined)
    assert sorted(map(tuple, rows(spark, "jsonl_round_trip", d)), key=str) == sorted(((x[0], x[2], "train") for x in docs), key=str)


def test_normalisers_on_every_row(spark, write):
    texts = [None, "", "Plain, text. 1!", "wait… 2ª vez, 3º x², Acme™", "ﬁne ﬂow", "Été à la plage", "Straße", "日本語 テスト", "a\tb\nc"]
    v1 = [None, "", "plain text", "wait a vez o x acmetm", "fine flow", "été à la plage", "straße", "日本語 テスト", "a b c"]
    upper = [None, "", "PLAINTEXT1", "WAIT…2ªVEZ3ºX²ACME™", "FINEFLOW", "ÉTÉÀLAPLAGE", "STRASSE", "日本語テスト", "A\tB\nC"]
    d = write(documents=([(i, t, (None, "fr", "en")[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.clean for r in rows(spark, "text_normalize_v1", d)} == dict(enumerate(v1))
    assert {r.doc_id: r.clean for r in rows(spark, "legacy_normalize", d)} == dict(enumerate(upper))
