"""Fixtures with known answers, and independent models of the operators that have no SQL."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import contracts
from tessera.functions import arrays, digests, metrics, text
from tessera.operators import audit, model, provenance, ranking, resample, selection


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_capped_selection_fixture(spark):
    rows = [(f"r{i}", f"g{i % 4}", 1.0, i / 12) for i in range(12)]
    got = selection.capped_selection(spark.createDataFrame(rows, "id string, g string, d double, s double"), "id", "g", "d", "s", 6.0, 2.0, 2).collect()
    assert len(got) == 6 and max(sum(r.g == g for r in got) for g in "g0 g1 g2 g3".split()) <= 2


@pytest.mark.parametrize("seed", range(3))
def test_capped_selection_skips(spark, seed):
    g = random.Random(seed)
    rows = [(f"r{i}", f"g{g.randrange(5)}", g.choice([0.5, 1.0, 3.0, 7.0]), round(g.random(), 1)) for i in range(200)]
    total, used, n, want = 0.0, {}, {}, set()
    for i, grp, d, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if total + d <= 40 and used.get(grp, 0) + d <= 12 and n.get(grp, 0) < 6:
            total += d
            used[grp] = used.get(grp, 0) + d
            n[grp] = n.get(grp, 0) + 1
            want.add(i)
    df = spark.createDataFrame(rows, "id string, g string, d double, s double").repartition(7)
    assert {r.id for r in selection.capped_selection(df, "id", "g", "d", "s", 40.0, 12.0, 6).collect()} == want


def test_stratified_sample_fixture(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([10, 1, 30, 5, 20])], "i int, d int")
    assert [r.i for r in selection.stratified_sample(df, ["d"], 3).orderBy("i").collect()] == [0, 1, 2]
    assert selection.stratified_sample(df, ["d"], 1).collect()[0].d == 10
    four = spark.createDataFrame([(i, i % 4) for i in range(40)], "i int, s int")
    assert selection.stratified_sample(four, ["i"], 2, ("s",)).count() == 8


def test_tie_percentile_fixture(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 2, 5, 9]], "v int")
    assert sorted(r.p for r in ranking.tie_percentile(df, "v", "p").collect()) == [0.0, 0.4, 0.4, 0.4, 0.8, 1.0]
    assert ranking.tie_percentile(df.limit(1), "v", "p").first().p == 0.5


@given(st.lists(st.integers(0, 5), min_size=1, max_size=20))
@settings(max_examples=10, deadline=None)
def test_tie_percentile_model(spark, values):
    s, n = sorted(values), len(values)
    want = sorted(0.5 if n == 1 else (s.index(v) + n - 1 - s[::-1].index(v)) / 2 / (n - 1) for v in values)
    got = sorted(r.p for r in ranking.tie_percentile(spark.createDataFrame([(v,) for v in values], "v int"), "v", "p").collect())
    assert np.allclose(got, want)


def test_token_fixtures(spark):
    q = arrays.token_statistics(F.array(*map(F.lit, [10, 11, 99, 99])), F.array(*map(F.lit, [-0.1, -0.2, -0.3, -9.0])), 99, [99])
    r = one(spark, ids=q["token_ids"], c=q["geometric_confidence"], n=q["content_token_count"])
    assert r.ids == [10, 11, 99] and r.n == 2 and abs(r.c - math.exp(-0.15)) < 1e-12
    for ids, want in (([1, 2, 3, 0, 0], [1, 2, 3]), ([1, 2, 0, 0], [1, 2]), ([3, 256078, 42, 3, 0], [3, 256078, 42, 3])):
        assert one(spark, k=arrays.trim_at_end(F.array(*map(F.lit, ids)), 3, 0)).k == want


def test_text_fixtures(spark):
    assert one(spark, d=text.disagreement(F.lit("mhoro"), F.lit("moro"))).d == 0.2
    assert one(spark, d=text.disagreement(F.lit(""), F.lit(""))).d == 0
    assert one(spark, d=metrics.word_error_rate(F.lit("mhoro shamwari"), F.lit("mhoro"))).d == 0.5
    assert one(spark, d=metrics.word_error_rate(F.lit(""), F.lit("a b"))).d == 2
    r = one(spark, a=text.normalize_v1(F.lit("Ｈello, WÖRLD 42!")), b=text.normalize_v2(F.lit("It’s 42 Straße…")), c=text.normalize_v1(F.lit("A-b 3c")), d=text.legacy_upper(F.lit("a b, c!")))
    assert (r.a, r.b, r.c, r.d) == ("hello wörld", "it's 42 strasse", "a b c", "ABC")
    r = one(spark, n=F.size(text.words(F.lit(" a b  c "))), f=text.repeated_fraction(text.words(F.lit("a b a b a")), 2), run=text.longest_run(text.words(F.lit("a b b b c c"))), z=text.compression_ratio(F.lit("abc" * 50)))
    assert (r.n, r.f, r.run) == (3, 0.5, 3) and abs(r.z - 150 / len(zlib.compress(b"abc" * 50))) < 1e-12


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
@settings(max_examples=200, deadline=None)
def test_alignment_model(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    s, dl, ins, hits = metrics.align(a, b)
    assert s + dl + ins == d[-1][-1] and s + dl + hits == len(a) and s + ins + hits == len(b) and min(s, dl, ins, hits) >= 0


def test_word_distance_without_python(spark):
    g = random.Random(0)
    rows = [(" ".join(g.choices("ab cd é x".split(), k=g.randrange(8))), " ".join(g.choices("ab cd é x".split(), k=g.randrange(8)))) for _ in range(50)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", metrics.word_errors(F.col("a"), F.col("b")).alias("e")).collect():
        assert r.e == sum(metrics.align(r.a.split(), r.b.split())[:3])


def test_statistics_fixtures(spark):
    e = one(spark, **resample.factorial_effects(*(F.lit(float(x)) for x in (30, 28, 29, 25))))
    assert (e.noise, e.rir, e.interaction) == (3.0, 2.0, 2.0)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.2)], "n string, p double")
    assert np.allclose([r.p_adjusted for r in resample.holm(p, "p", "n").orderBy("n").collect()], [0.03, 0.06, 0.2])
    c = spark.createDataFrame([("x", 5, 3, 10), ("y", 4, 4, 10)], "k string, b int, c int, n int")
    d = resample.bootstrap_deltas(c, "k", "b", "c", "n", 300, 1)
    assert {round(r.delta, 6) for r in d.collect()} == {0.0, 10.0, 20.0}
    r = resample.interval(d).first()
    assert r.replicates == 300 and r.ci_low == 0 and r.ci_high == 20 and 0.6 < r.p_positive < 0.9


def test_signal_fixtures(spark):
    g = np.random.default_rng(0)
    x, n = F.array(*map(F.lit, g.normal(size=50).tolist())), F.array(*map(F.lit, g.normal(size=50).tolist()))
    assert abs(one(spark, a=arrays.mix_at_snr(x, n, F.lit(10.0))["achieved_snr_db"]).a - 10) < 1e-5
    df = spark.createDataFrame([([0.1] * 90, 0.9), ([0.1] * 90, 1.1), ([0.1] * 90, 1.0)], "x array<double>, f double")
    assert [r.n for r in df.select(F.size(arrays.change_speed("x", "f")).alias("n")).collect()] == [100, 82, 90]
    with pytest.raises(Exception, match="shorter"):
        one(spark, a=arrays.fit_without_tiling(F.array(F.lit(1.0)), F.lit(2), F.lit(0)))
    mel = spark.createDataFrame([([[1.0] * 10 for _ in range(6)], 7, s) for s in range(8)], "m array<array<float>>, v int, s long")
    spec = F.struct(F.lit(2).alias("frequency_width"), F.lit(1).alias("frequency_masks"), F.lit(3).alias("time_width"), F.lit(1).alias("time_masks"), F.lit(1.0).alias("time_share"), F.lit(1.0).alias("probability"))
    for r in mel.select(arrays.mask_spectrum("m", "v", "s", spec).alias("o")).collect():
        o = np.array(r.o)
        bands = (o == 0).all(axis=1)
        assert (o[~bands][:, 7:] == 1).all()  # padding beyond the valid frames is masked by whole bands only
    e = spark.createDataFrame([([0.0] * 100, 100)], "x array<float>, r int")
    silent = arrays.acoustic_profile(e, "x", F.col("r")).first()
    assert silent.speech_ratio == 0 and silent.leading_silence == silent.trailing_silence == 1.0


def test_digest_fixtures(spark):
    df = spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "p int, i int")
    assert df.agg(digests.ordered_digest(F.col("p"), F.col("i")).alias("d")).first().d == hashlib.sha256(b"3,1,2").hexdigest()
    assert digests.canonical_json({"b": [1, 2], "a": "é"}) == '{"a":"é","b":[1,2]}'
    x = spark.createDataFrame([([0.5, -2.0], 16000)], "x array<float>, r int").select(digests.pcm_sha256("x", "r", F.lit(1)).alias("h")).first().h
    assert x == hashlib.sha256(b"16000:1:" + np.array([16384, -32767], "<i2").tobytes()).hexdigest()


def test_pacing_exposure(spark):
    df = spark.createDataFrame([(i, i / 10) for i in range(10)], "id int, p double")
    rows = ranking.pacing(df, "p", "id", 3, [1 / 3, 2 / 3, 1.0]).collect()
    for e, k in ((1, 4), (2, 7), (3, 10)):
        mine = [r for r in rows if r.epoch == e]
        counts = [sum(r.id == i for r in mine) for i in range(k)]
        assert len(mine) == 10 and max(r.id for r in mine) == k - 1 and max(counts) - min(counts) <= 1
        assert sorted(r.position for r in mine) == list(range(10))


def test_admission_counts_rejected_rows_as_seen(spark):
    rows = spark.createDataFrame([("a", "s", 0.5, 1, "h", 0, 0), ("b", "s", 5.0, 1, "h", 0, 1), ("c", "t", 30.0, 2, "k", 0, 2)], "id string, speaker_id string, duration double, channels int, pcm_sha256 string, shard int, row int")
    none = spark.createDataFrame([], "id string, speaker_id string, pcm_sha256 string")
    got = {r.id: r.rejection_reasons for r in audit.admission(rows, none.select("id"), none.select("speaker_id"), none.select("pcm_sha256"), none.select("pcm_sha256"), ["shard", "row"]).collect()}
    assert got == {"a": ["too_short"], "b": ["duplicate_audio"], "c": ["not_mono"]}


def test_calibration_behaviour(spark):
    g = np.random.default_rng(0)
    rows = [(i, f"g{i // 2 % 8}", float(i % 2), float(i % 2) + g.normal() * 0.1, None if i == 3 else 1.0) for i in range(64)]
    df = spark.createDataFrame(rows, "id int, g string, y double, a double, b double")
    folds = selection.grouped_folds(df.groupBy("g").agg(F.count("*").alias("n")), "g", 4)
    oof = model.out_of_fold(df.join(folds, "g"), ["a", "b"], "y", "fold", "id")
    r = model.rank_auc(oof.join(df, "id"), "y", "probability").first()
    assert oof.count() == 64 and r.roc_auc > 0.9 and r.average_precision > 0.9 and {x.c for x in oof.collect()} <= {0.1, 1.0, 10.0}
    assert model.rank_auc(df.withColumn("y", F.lit(1.0)), "y", "a").first().roc_auc is None


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, " ")], "id int, v string")
    assert contracts.unique(df, "id").count() == 1 and contracts.not_missing(df, "v").count() == 1
    assert contracts.equal_keys(df, df.where("id = 1"), "id").collect()[0].side == "left"
    assert contracts.enforce(df, df.where("false"), "x").count() == 3
    with pytest.raises(Exception, match="ids repeat: 1"):
        contracts.enforce(df, contracts.unique(df, "id"), "ids repeat").collect()


def test_provenance(spark):
    base = {"a": 1, "b": {"c": 2, "d": 3}}
    assert provenance.changed_fields(base, provenance.derive(base, {"b.c": 5}, {"b.c"})) == ["b.c"]
    with pytest.raises(ValueError):
        provenance.derive(base, {"a": 2}, {"b.c"})
    with pytest.raises(PermissionError):
        provenance.unlocked("test", {"test"}, False)
    with pytest.raises(ValueError):
        provenance.check_destination("x", {"y"})
    m = provenance.run_manifest(spark.range(3), base, {"z": "1", "a": "2"})
    assert list(m["inputs"]) == ["a", "z"] and m["spark"] == spark.version


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_positions_do_not_depend_on_ranges(spark, ranges):
    rows = [(i, (i * 7919) % 101 if i % 9 else None, "ab"[i % 2] if i % 11 else None, (i * 31) % 17 / 4) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, g string, x double")
    key = lambda r: (r[1] is not None, r[1] or 0, r[0])
    got = {r.id: r.position for r in ranking.global_position(df, "v", "id", ranges=ranges).collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=key))}
    for g in ("a", "b", None):
        own = {r.id: r.position for r in ranking.global_position(df, "v", "id", by=("g",), ranges=ranges).collect() if r.g == g}
        assert own == {r[0]: k for k, r in enumerate(sorted((r for r in rows if r[2] == g), key=key))}
    before = {r.id: r.before for r in ranking.running_sum(df, F.col("id"), "x", "id", ranges=ranges).collect()}
    total = 0
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        assert before[r[0]] == total
        total += r[0]
    pct = {r.id: r.p for r in ranking.tie_percentile(df, "x", "p", ranges=ranges).collect()}
    for r in rows:
        below, same = sum(q[3] < r[3] for q in rows), sum(q[3] == r[3] for q in rows)
        assert pct[r[0]] == pytest.approx((below + (same - 1) / 2) / (len(rows) - 1))
    assert ranking.global_position(df.where("false"), "v", "id", ranges=ranges).count() == 0


def test_first_seen_of_null_keys(spark):
    df = spark.createDataFrame([(3, None), (1, None), (2, "x"), (0, "x"), (5, "y")], "i long, k string")
    assert {r.i: r.is_duplicate for r in ranking.first_seen(df, "k", ["i"]).collect()} == {3: True, 1: False, 2: True, 0: False, 5: False}


def test_hooks_of_a_trainer(spark):
    state = spark.createDataFrame([(i, float(i % 3), 1.0, i) for i in range(6)], "id long, nll double, duration double, dataset_index int")
    orders = ranking.epochs(state, lambda s, i: ranking.loss_order(s), lambda s, i: s.withColumn("nll", -F.col("nll") + 5.0), 2)
    assert [[r.id for r in o.orderBy("position").collect()] for o in orders] == [[0, 3, 1, 4, 2, 5], [2, 5, 1, 4, 0, 3]]
    assert [o.first().epoch for o in orders] == [1, 2]


def test_wav_bytes(spark):
    from tessera.sources import manifests, sinks

    df = spark.createDataFrame([([0.5, -2.0, 0.0],), (None,)], "x array<double>").select(sinks.pcm_wav("x", F.lit(8000)).alias("w"))
    got = [r.h for r in df.select(manifests.wav_header("w").alias("h")).collect()]
    assert (got[0].sample_rate, got[0].channels, got[0].bits, got[0].duration) == (8000, 1, 16, 3 / 8000) and got[1].sample_rate is None
