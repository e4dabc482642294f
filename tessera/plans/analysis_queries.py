"""Text, error metrics, statistics, calibration and signals on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as V
from tessera.functions import metrics as E
from tessera.functions import text as T
from tessera.functions.digests import content_sha256, pcm_sha256
from tessera.operators import model as L
from tessera.operators import resample as B
from tessera.operators import selection as S
from tessera.plans.register import query, table


def _docs(spark, d):
    return table(spark, d, "documents")


def _r(c, n=6):
    return F.round(c, n)


# ---- text --------------------------------------------------------------------------------------------------

@query("FN1", r"SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{N}\p{S}\p{C}\s\x{85}\x{A0}]+', ' ', 'g')) AS clean FROM documents")
def text_normalize_v1(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_v1(F.col("text")).alias("clean"))


@query("FN2", r"SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(translate(text, '‘’‚‛ʼ`´', ''''''''''''''''))), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}'']+', ' ', 'g')) AS clean FROM documents")
def text_normalize_v2(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_v2(F.col("text")).alias("clean"))


@query("FN6", r"SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS clean FROM documents")
def text_normalize_basic(spark, d):
    return _docs(spark, d).select("doc_id", T.basic_normalize(F.col("text")).alias("clean"))


@query("FN3 FN4", r"SELECT doc_id, regexp_full_match(text, '[\p{L}\p{P}\s]*') AS letters_only, regexp_matches(text, '\p{N}') AS has_number FROM documents")
def character_checks(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", T.only_characters(x, r"\p{L}\p{P}\s").alias("letters_only"), T.has_number(x).alias("has_number"))


@query("FN5", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x{85}\x{A0}]+'), lambda w: w <> '')) AS words FROM documents")
def word_split(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("words"))


@query("FN7", "SELECT doc_id, translate(upper(replace(text, 'ß', 'SS')), '. ,!?', '') AS clean FROM documents")
def legacy_normalize(spark, d):
    return _docs(spark, d).select("doc_id", T.legacy_upper(F.col("text")).alias("clean"))


@query("FN8")
def compression_ratio(spark, d):
    return _docs(spark, d).select("doc_id", _r(T.compression_ratio(F.col("text"))).alias("ratio"))


@query("FN9 FN10 WN6", r"""
WITH w AS (SELECT doc_id, text, n_chars, list_filter(regexp_split_to_array(text, '[\s\x{85}\x{A0}]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT *, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS g2,
  CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g3 FROM w),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS run, x FROM u),
m AS (SELECT doc_id, max(n) AS best FROM (SELECT doc_id, x, run, count(*) AS n FROM k GROUP BY ALL) GROUP BY doc_id)
SELECT g.doc_id, len(w) = 0 AS empty_text, len(w) AS word_count, round(len(w) / (n_chars / 15.0), 6) AS words_per_second,
  CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) END AS unique_word_ratio, coalesce(m.best, 0) AS longest_run,
  round(CASE WHEN len(g2) > 0 THEN (len(g2) - len(list_distinct(g2))) / len(g2) ELSE 0 END, 6) AS repeated_bigrams,
  round(CASE WHEN len(g3) > 0 THEN (len(g3) - len(list_distinct(g3))) / len(g3) ELSE 0 END, 6) AS repeated_trigrams
FROM g LEFT JOIN m USING (doc_id)""")
def text_diagnostics(spark, d):
    docs = _docs(spark, d)
    x = T.with_diagnostics(docs, "text", F.col("n_chars") / 15.0)
    q = {c: F.col(c) for c in x.columns}
    return x.select(
        "doc_id", q["empty_text"].alias("empty_text"), q["word_count"].cast("bigint").alias("word_count"), _r(q["words_per_second"]).alias("words_per_second"), _r(q["unique_word_ratio"]).alias("unique_word_ratio"),
        q["maximum_consecutive_word_run"].cast("bigint").alias("longest_run"), _r(q["repeated_bigram_fraction"]).alias("repeated_bigrams"), _r(q["repeated_trigram_fraction"]).alias("repeated_trigrams"),
    )


def _pairs(spark, d):
    """Turns beside the turns after them."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z ]", "").alias("ref"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return c.join(n, ["conv_id", "turn"])


def _aligned(spark, d):
    """Turns beside the turns after them, aligned in Arrow functions: the builtin distance looks every word up in an
    array anew, which long turns make slow. Nulls where a text is null; n and m: their words."""
    s = F.when(F.col("ref").isNotNull() & F.col("hyp").isNotNull(), E.alignment(F.col("ref"), F.col("hyp")))
    p = _pairs(spark, d).withColumn("s", s).select("conv_id", "turn", "s.*")
    same = F.col("hits") + F.col("substitutions")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return p.select("conv_id", "turn", errors.alias("errors"), (same + F.col("deletions")).alias("n"), (same + F.col("insertions")).alias("m"))


_PAIRS = "WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS ref FROM conversations), p AS (SELECT c.conv_id, c.turn, c.ref, n.ref AS hyp FROM c JOIN c n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)"


@query("FN11", _PAIRS + " SELECT conv_id, turn, round(levenshtein(ref, hyp) / greatest(1, length(ref), length(hyp)), 6) AS disagreement FROM p")
def char_disagreement(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", _r(T.disagreement(F.col("ref"), F.col("hyp"))).alias("disagreement"))


_WORDS = """, w AS (SELECT conv_id, turn, list_filter(string_split(ref, ' '), lambda x: x <> '') AS a, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS b FROM p),
t AS (  -- the edit table, a row a word of a: least of match and deletion, then insertions as a running least
  SELECT conv_id, turn, len(a) AS n, len(b) AS m, list_reduce(list_concat([range(0, len(b) + 1)], list_transform(range(1, len(a) + 1), lambda i: [i])),
    lambda p, x: list_transform([list_transform(list_concat([x[1]], list_transform(range(1, len(b) + 1), lambda j: least(p[j] + CASE WHEN a[x[1]] = b[j] THEN 0 ELSE 1 END, p[j + 1] + 1))), lambda v, k: v - k)],
      lambda q: list_transform(range(1, len(b) + 2), lambda j: list_min(q[1:j]) + j))[1]) AS last FROM w),
k AS (SELECT conv_id, turn, n, m, last[m + 1] AS errors FROM t)"""


@query("FN12 FN13 FN14", _PAIRS + _WORDS + " SELECT conv_id, turn, errors, round(CASE WHEN n = 0 THEN m ELSE errors / n END, 6) AS wer FROM k")
def pair_word_error(spark, d):
    rate = F.when(F.col("n") == 0, F.col("m").cast("double")).otherwise(F.col("errors") / F.col("n"))
    return _aligned(spark, d).select("conv_id", "turn", "errors", _r(rate).alias("wer"))


@query("FN12 FN13", _PAIRS + _WORDS + " SELECT conv_id, turn, errors, m - n AS balance FROM k")
def alignment_split(spark, d):
    return _aligned(spark, d).select("conv_id", "turn", "errors", (F.col("m") - F.col("n")).alias("balance"))


@query("FN15 FN16 AG2 FLT10 INF5", _PAIRS + _WORDS + " SELECT turn % 2 = 0 AS unseen, round(100.0 * sum(errors) / sum(n), 6) AS wer FROM k GROUP BY 1")
def corpus_wer(spark, d):
    p = _aligned(spark, d).select((F.col("turn") % 2 == 0).alias("unseen"), "errors", "n")
    return p.groupBy("unseen").agg(_r(E.micro_rate(F.col("errors"), F.col("n"))).alias("wer"))


# ---- tokens, hashes, numbers -------------------------------------------------------------------------------

def _tokens(spark, d):
    e = table(spark, d, "embeddings")
    ids = F.transform("embedding", lambda v: F.floor(F.abs(v) * 40).cast("int"))
    return e.select("vec_id", ids.alias("ids"), F.transform("embedding", lambda v: -F.abs(v.cast("double"))).alias("lp"))


_TOKENS = """WITH t AS (SELECT vec_id, list_transform(embedding, lambda v: floor(abs(v) * 40)::INT) AS ids, list_transform(embedding, lambda v: -abs(v::DOUBLE)) AS lp FROM embeddings),
k AS (SELECT *, coalesce(list_position(ids, 9), 0) AS pos, CASE WHEN coalesce(list_position(ids, 9), 0) > 0 THEN list_position(ids, 9) ELSE len(ids) END AS n FROM t),
c AS (SELECT *, list_transform(list_filter(list_zip(ids[1:n], lp[1:n]), lambda z: z[1] NOT IN (1, 9)), lambda z: z[2]) AS c FROM k)"""


@query("FN17 FN19", _TOKENS + """ SELECT vec_id, n AS kept, len(c) AS content, CASE WHEN len(c) > 0 THEN round(list_sum(c), 6) END AS total, CASE WHEN len(c) > 0 THEN round(exp(list_sum(c) / len(c)), 6) END AS confidence,
CASE WHEN len(c) > 0 THEN round(exp(list_min(c)), 6) END AS least, CASE WHEN len(c) > 0 THEN round(list_aggregate(list_transform(c, lambda v: exp(v)), 'quantile_cont', 0.1), 6) END AS p10, CAST(CASE WHEN pos > 0 THEN pos - 1 END AS BIGINT) AS end_position, pos = 0 AS hit_max FROM c""")
def token_statistics(spark, d):
    q = V.token_statistics(F.col("ids"), F.col("lp"), 9, [1])
    big = lambda c: c.cast("bigint")
    return _tokens(spark, d).select(
        "vec_id", big(F.size(q["token_ids"])).alias("kept"), big(q["content_token_count"]).alias("content"), _r(q["log_probability_sum"]).alias("total"), _r(q["geometric_confidence"]).alias("confidence"),
        _r(q["minimum_probability"]).alias("least"), _r(q["p10_probability"]).alias("p10"), big(q["end_position"]).alias("end_position"), q["hit_max_length"].alias("hit_max"),
    )


@query("FN18", """WITH t AS (SELECT vec_id, list_transform(embedding, lambda v: floor(abs(v) * 40)::INT) AS ids FROM embeddings),
f AS (SELECT *, list_min(list_filter(range(2, len(ids) + 1), lambda i: ids[i] IN (9, 0))) AS i FROM t)
SELECT vec_id, array_to_string(CASE WHEN i IS NULL THEN ids WHEN ids[i] = 9 THEN ids[1:i] ELSE ids[1:i - 1] END, ',') AS kept FROM f""")
def token_trim(spark, d):
    return _tokens(spark, d).select("vec_id", F.array_join(V.trim_at_end(F.col("ids"), 9, 0).cast("array<string>"), ",").alias("kept"))


@query("FN20 FN21", "SELECT vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding)), 2.2250738585072014e-308)), 6) AS rms_dbfs FROM embeddings")
def levels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", _r(V.dbfs(V.rms(F.col("embedding")))).alias("rms_dbfs"))


@query("FN22 PRV1", "SELECT page_id, sha256(html) AS digest FROM pages")
def content_digest(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


_LITTLE = "list_transform(range(0, {n}), lambda i: printf('%02x', ({bits} // (256 ** i)::BIGINT) % 256))"
_BYTES = "array_to_string(" + _LITTLE + ", '')"


@query("FN25 FN26", f"""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: (CAST(round_even(greatest(-1.0, least(1.0, v::DOUBLE)) * 32767.0, 0) AS BIGINT) + 65536) % 65536) AS q,
  list_transform(embedding, lambda v: struct_pack(s := CASE WHEN v < 0 THEN 2147483648 ELSE 0 END, a := abs(v::DOUBLE), e := CASE WHEN v = 0 THEN 0 ELSE CAST(floor(log2(abs(v::DOUBLE))) AS INTEGER) END)) AS f FROM embeddings),
k AS (SELECT *, list_transform(f, lambda x: struct_pack(s := x.s, a := x.a, e := CASE WHEN x.a = 0 THEN 0 WHEN x.a >= pow(2.0, x.e + 1) THEN x.e + 1 WHEN x.a < pow(2.0, x.e) THEN x.e - 1 ELSE x.e END)) AS g FROM p),
b AS (SELECT *, list_transform(g, lambda x: CASE WHEN x.a = 0 THEN x.s ELSE x.s + (x.e + 127) * 8388608 + CAST(x.a / pow(2.0, x.e) * 8388608 AS BIGINT) - 8388608 END) AS w FROM k)
SELECT vec_id, sha256(CAST('16000:1:' AS BLOB) || unhex(array_to_string(list_transform(q, lambda z: {_BYTES.format(n=2, bits="z")}), ''))) AS pcm_sha256,
  sha256(unhex({_BYTES.format(n=4, bits="16000")} || {_BYTES.format(n=8, bits="len(w)")} || {_BYTES.format(n=8, bits="1")} || array_to_string(list_transform(w, lambda z: {_BYTES.format(n=4, bits="z")}), ''))) AS content_sha256 FROM b""")
def signal_hashes(spark, d):
    e = table(spark, d, "embeddings")
    one = F.lit(1)
    return e.select("vec_id", pcm_sha256("embedding", F.lit(16000), one).alias("pcm_sha256"), content_sha256("embedding", F.lit(16000), F.size("embedding"), one).alias("content_sha256"))


@query("FN28", "SELECT doc_id, coalesce(1.0 - CASE WHEN doc_id % 4 <> 0 THEN (n_chars % 100) / 100.0::DOUBLE END, 1.0) AS poor FROM documents")
def poor_scores(spark, d):
    return _docs(spark, d).select("doc_id", L.poor_score(F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") % 100 / 100.0)).alias("poor"))


@query("FN29", "SELECT c_custkey, round(c_acctbal - 100.0::DOUBLE, 6) AS gain, round(CASE WHEN c_acctbal <> 0 THEN 100.0::DOUBLE * (c_acctbal - 100.0::DOUBLE) / c_acctbal END, 6) AS relative FROM customer")
def gains(spark, d):
    a = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", _r(a - 100.0).alias("gain"), _r(F.try_divide(100.0 * (a - 100.0), a)).alias("relative"))


# ---- signals -----------------------------------------------------------------------------------------------

@query("ARR1", """
WITH s AS (SELECT vec_id, embedding AS x, 40 AS rate, list_transform(range(0, 16), lambda i: sqrt(list_sum(list_transform(embedding[i * 4 + 1:i * 4 + 4], lambda v: v::DOUBLE * v::DOUBLE)) / 4)) AS l FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT *, list_max(l) * pow(10.0, -2.0) AS cut FROM s),
a AS (SELECT *, list_filter(l, lambda v: v >= cut) AS act, list_position(list_transform(l, lambda v: v >= cut), true) - 1 AS first, 16 - list_position(list_reverse(list_transform(l, lambda v: v >= cut)), true) AS last FROM p)
SELECT vec_id, round(20 * log10(greatest(list_max(list_transform(x, lambda v: abs(v::DOUBLE))), 2.2250738585072014e-308)), 6) AS peak_dbfs, round(len(act) / 16, 6) AS speech_ratio, round(list_aggregate(act, 'quantile_cont', .75), 6) AS speech_rms,
  round(list_aggregate(l, 'quantile_cont', .2), 6) AS noise_rms, round(CAST(least(1.6, first * 0.1) AS DOUBLE), 6) AS leading, round(CAST(greatest(0, 1.6 - least(1.6, (last + 1) * 0.1)) AS DOUBLE), 6) AS trailing,
  round(least(60.0, 20 * log10(greatest(list_aggregate(act, 'quantile_cont', .75), 2.2250738585072014e-308)) - 20 * log10(greatest(list_aggregate(l, 'quantile_cont', .2), 2.2250738585072014e-308))), 6) AS snr FROM a""")
def waveform_profile(spark, d):
    e = V.acoustic_profile(table(spark, d, "embeddings").where(F.size("embedding") == 64), "embedding", F.lit(40))
    names = {"peak_dbfs": "peak_dbfs", "speech_ratio": "speech_ratio", "speech_rms": "speech_rms", "noise_rms": "noise_rms", "leading_silence": "leading", "trailing_silence": "trailing", "snr_proxy_db": "snr"}
    return e.select("vec_id", *(_r(F.col(k)).alias(v) for k, v in names.items()))


@query("ARR3 ARR4 ARR8", """
WITH s AS (SELECT a.vec_id, list_transform(a.embedding[1:32], lambda v: v::DOUBLE) AS x, list_transform(b.embedding[9:40], lambda v: v::DOUBLE) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE len(a.embedding) = 64 AND len(b.embedding) = 64),
g AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 32) / (sqrt(list_sum(list_transform(n, lambda v: v * v)) / 32) * pow(10.0, 0.5)) AS gain FROM s),
m AS (SELECT *, list_transform(list_zip(x, n), lambda z: z[1] + z[2] * gain) AS mix FROM g)
SELECT vec_id, round(gain, 6) AS gain, 10.0::DOUBLE AS achieved, round(CASE WHEN list_max(list_transform(mix, lambda v: abs(v))) > 0 THEN least(1.0, 0.3 / list_max(list_transform(mix, lambda v: abs(v)))) ELSE 1 END, 6) AS clip_gain FROM m""")
def snr_mix(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64)
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("noise"))
    j = e.join(n, "vec_id").select("vec_id", F.slice("embedding", 1, 32).alias("x"), V.fit_without_tiling(F.col("noise"), F.lit(32), F.lit(8)).alias("n"))
    q = V.mix_at_snr(F.col("x"), F.col("n"), F.lit(10.0))
    j = j.select("vec_id", q["gain"].alias("gain"), q["achieved_snr_db"].alias("achieved"), q["mixed"].alias("mixed"))
    return j.select("vec_id", _r(F.col("gain")).alias("gain"), _r(F.col("achieved")).alias("achieved"), _r(V.anti_clip(F.col("mixed"), 0.3)["gain"]).alias("clip_gain"))


@query("ARR2", "SELECT vec_id, round(list_sum(list_transform(range(0, 100), lambda i: embedding[(i + vec_id % 7) % len(embedding) + 1]::DOUBLE)), 6) AS total FROM embeddings WHERE len(embedding) > 0")
def tiled_noise(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") > 0)
    return e.select("vec_id", _r(V.total(V.fit_by_tiling(F.col("embedding"), F.lit(100), F.col("vec_id") % 7))).alias("total"))


@query("ARR5 ARR6 ARR7 ARR9 ARR10 FN27")
def augmented_signals(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64)
    x, imp = F.col("embedding"), F.slice("embedding", 1, 8)
    condition = F.get(F.array(*map(F.lit, ("clean", "noise", "rir", "noise-rir", "speed"))), (F.col("vec_id") % 5).cast("int"))
    aug = V.augment(x, F.reverse("embedding"), imp, F.col("vec_id"), condition)
    return e.select("vec_id", F.size(V.convolve(x, imp, F.lit(64))).alias("convolved"), F.size(V.change_speed(x, F.lit(0.9))).alias("slowed"), F.size(V.stretch(x, F.lit(1.25))).alias("stretched"), condition.alias("condition"), _r(V.rms(aug)).alias("rms"))


@query("ARR11 ARR12")
def spectrum_masks(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64)
    mel = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    spec = F.struct(F.lit(3).alias("frequency_width"), F.lit(1).alias("frequency_masks"), F.lit(4).alias("time_width"), F.lit(1).alias("time_masks"), F.lit(1.0).alias("time_share"), F.lit(1.0).alias("probability"))
    m = V.mask_spectrum(mel, F.lit(6), F.col("vec_id"), spec)
    return e.select("vec_id", F.size(F.filter(F.flatten(m), lambda v: v == 0)).alias("masked"))


@query("ARR13", """
WITH t AS (SELECT conv_id, list(turn::INT ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), w AS (SELECT max(len(ids)) AS n FROM t)
SELECT conv_id, array_to_string(list_concat(ids[2:], list_transform(range(0, n - len(ids)), lambda i: -100)), ',') AS batch FROM t, w""")
def padded_batch(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("ids"))
    w = t.agg(F.max(F.size("ids")).alias("n"))
    x = t.crossJoin(F.broadcast(w)).select("conv_id", V.drop_shared_start(V.pad_batch(F.col("ids"), F.col("n")), 0, F.lit(True)).alias("b"))  # one row
    return x.select("conv_id", F.array_join(F.col("b").cast("array<string>"), ",").alias("batch"))


# ---- statistics --------------------------------------------------------------------------------------------

_U = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::HUGEINT)"


def _clusters(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", (F.col("user_id") % 20).alias("g")).agg(F.sum(F.col("event_id") % 7).alias("eb"), F.sum(F.col("event_id") % 5).alias("ec"), F.sum(F.col("event_id") % 40 + 20).alias("n"), F.sum(F.col("event_id") % 3).alias("ed")).select(F.concat_ws(":", "event_type", F.col("g").cast("string")).alias("cluster"), "eb", "ec", "n", "ed")


_CLUSTERS = "WITH c AS (SELECT event_type || ':' || (user_id % 20) AS cluster, sum(event_id % 7)::BIGINT AS eb, sum(event_id % 5)::BIGINT AS ec, sum(event_id % 40 + 20)::BIGINT AS n, sum(event_id % 3)::BIGINT AS ed FROM events GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS k FROM c), dr AS (SELECT r.r AS replicate, " + _U.format("'42:' || r.r || ':' || i.i") + " % i.k AS i FROM i, range(0, 200) r(r)), s AS (SELECT dr.replicate, i.* FROM dr JOIN i USING (i))"


@query("STA1 AG3", _CLUSTERS + ", x AS (SELECT replicate, 100.0 * sum(eb - ec) / sum(n) AS delta FROM s GROUP BY 1) SELECT count(*) AS replicates, round(quantile_cont(delta, .025), 9) AS ci_low, round(quantile_cont(delta, .975), 9) AS ci_high, round(avg((delta > 0)::INT), 9) AS p_positive, round(avg((delta >= 0.5)::INT), 9) AS p_threshold FROM x")
def cluster_bootstrap(spark, d):
    r = B.interval(B.bootstrap_deltas(_clusters(spark, d), "cluster", "eb", "ec", "n", 200, 42))
    return r.select("replicates", *(F.round(c, 9).alias(c) for c in ("ci_low", "ci_high", "p_positive", "p_threshold")))


@query("STA2 STA3 STA4", _CLUSTERS + """, w AS (SELECT replicate, 100.0 * sum(eb) / sum(n) AS a, 100.0 * sum(ec) / sum(n) AS b, 100.0 * sum(ed) / sum(n) AS c, 100.0 * sum(eb + ec - ed) / sum(n) AS d FROM s GROUP BY 1),
o AS (SELECT 100.0 * sum(eb) / sum(n) AS a, 100.0 * sum(ec) / sum(n) AS b, 100.0 * sum(ed) / sum(n) AS c, 100.0 * sum(eb + ec - ed) / sum(n) AS d FROM c),
f AS (SELECT 'noise' AS effect, ((a - b) + (c - d)) / 2 AS v FROM w UNION ALL SELECT 'rir', ((a - c) + (b - d)) / 2 FROM w UNION ALL SELECT 'interaction', b + c - d - a FROM w),
g AS (SELECT 'noise' AS effect, ((a - b) + (c - d)) / 2 AS obs FROM o UNION ALL SELECT 'rir', ((a - c) + (b - d)) / 2 FROM o UNION ALL SELECT 'interaction', b + c - d - a FROM o)
SELECT effect, round(any_value(obs), 6) + 0.0::DOUBLE AS observed, round((count(*) FILTER (abs(round(v - obs, 9)) >= abs(round(obs, 9))) + 1) / (count(*) + 1), 9) AS p FROM f JOIN g USING (effect) GROUP BY effect""")
def factorial_bootstrap(spark, d):
    c = _clusters(spark, d)
    rate = lambda e: 100.0 * F.sum(e) / F.sum("n")
    cells = [rate("eb").alias("a"), rate("ec").alias("b"), rate("ed").alias("c"), rate(F.col("eb") + F.col("ec") - F.col("ed")).alias("d")]
    effects = B.factorial_effects(*(F.col(x) for x in "abcd"))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("effect"), F.round(v, 9).alias("v")) for k, v in effects.items()))).alias("x")
    draws = B.draws(c, "cluster", 200, 42).groupBy("replicate").agg(*cells).select(long).select("x.*")
    obs = c.agg(*cells).select(long).select(F.col("x.effect").alias("effect"), F.col("x.v").alias("obs"))
    j = draws.join(F.broadcast(obs), "effect").withColumn("centred", F.round(F.col("v") - F.col("obs"), 9))
    p = j.groupBy("effect", "obs").agg(((F.count_if(F.abs("centred") >= F.abs("obs")) + 1) / (F.count("*") + 1)).alias("p"))
    return p.select("effect", (F.round("obs", 6) + 0.0).alias("observed"), F.round("p", 9).alias("p"))


@query("STA5 WN4", """
WITH p AS (SELECT event_type AS name, (min(event_id) % 17 + 1) / 400.0::DOUBLE AS p FROM events GROUP BY 1),
a AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS s FROM p)
SELECT name, round(max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM a""")
def holm_adjustment(spark, d):
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(((F.min("event_id") % 17 + 1) / 400.0).alias("p"))
    return B.holm(p, "p", "name").select("name", F.round("p_adjusted", 9).alias("p_adjusted"))


@query("STA6 AG13 JN2", """
WITH c AS (SELECT l_linenumber AS seed, avg(l_quantity) FILTER (l_returnflag = 'A') AS a0, avg(l_quantity) FILTER (l_returnflag = 'N') AS a1, avg(l_quantity) FILTER (l_returnflag = 'R') AS a2, avg(l_tax) AS a3 FROM lineitem GROUP BY 1),
e AS (SELECT seed, 'augmentation_without_curriculum' AS effect, a0 - a2 AS v FROM c UNION ALL SELECT seed, 'curriculum_without_augmentation', a0 - a1 FROM c UNION ALL SELECT seed, 'curriculum_with_augmentation', a2 - a3 FROM c
  UNION ALL SELECT seed, 'augmentation_with_curriculum', a1 - a3 FROM c UNION ALL SELECT seed, 'interaction', (a2 - a3) - (a0 - a1) FROM c)
SELECT effect, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM e GROUP BY effect""")
def factorial_summary(spark, d):
    x = table(spark, d, "lineitem")
    part = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    c = x.groupBy(F.col("l_linenumber").alias("seed")).agg(part("A").alias("a0"), part("N").alias("a1"), part("R").alias("a2"), F.avg("l_tax").alias("a3"))
    eff = B.seed_effects(*(F.col(f"a{i}") for i in range(4)))
    long = c.select(F.explode(F.array(*(F.struct(F.lit(k).alias("effect"), v.alias("v")) for k, v in eff.items()))).alias("x")).select("x.*")
    return long.groupBy("effect").agg(*B.spread_of("v")).select("effect", _r(F.col("mean")).alias("mean"), _r(F.col("sd")).alias("sd"), "n")


@query("STA7", _CLUSTERS.replace("'42:'", "'7:'") + ", x AS (SELECT replicate, 100.0 * sum((eb - ec + eb - ed) / 2.0) / sum(n) AS delta FROM s GROUP BY 1) SELECT round(quantile_cont(delta, .025), 9) AS low95, round(quantile_cont(delta, .975), 9) AS high95, round(quantile_cont(delta, .00125), 9) AS low_bonferroni, round(quantile_cont(delta, .99875), 9) AS high_bonferroni FROM x")
def seed_averaged_bootstrap(spark, d):
    c = _clusters(spark, d).withColumn("avg_delta", (F.col("eb") - F.col("ec") + F.col("eb") - F.col("ed")) / 2.0)
    x = B.draws(c, "cluster", 200, 7).groupBy("replicate").agg((100.0 * F.sum("avg_delta") / F.sum("n")).alias("delta"))
    q = lambda v: F.round(F.percentile("delta", F.lit(v)), 9)
    return x.agg(q(0.025).alias("low95"), q(0.975).alias("high95"), q(0.05 / 20 / 2).alias("low_bonferroni"), q(1 - 0.05 / 20 / 2).alias("high_bonferroni"))


@query("STA8", """
WITH v AS (SELECT event_type, [avg(value) FILTER (user_id % 3 = 0) - 250, avg(value) FILTER (user_id % 3 = 1) - 250, avg(value) FILTER (user_id % 3 = 2) - 250] AS v FROM events GROUP BY 1),
s AS (SELECT event_type, v, abs((a * v[1] + b * v[2] + c * v[3]) / 3) >= abs((v[1] + v[2] + v[3]) / 3) - 1e-12 AS far FROM v, (VALUES (1), (-1)) x(a), (VALUES (1), (-1)) y(b), (VALUES (1), (-1)) z(c))
SELECT event_type, avg(far::INT) AS p FROM s GROUP BY 1""")
def sign_flip_test(spark, d):
    e = table(spark, d, "events")
    v = e.groupBy("event_type").agg(*(F.avg(F.when(F.col("user_id") % 3 == i, F.col("value"))).alias(f"v{i}") for i in range(3)))
    vals = F.array(*(F.col(f"v{i}") - 250.0 for i in range(3)))
    return v.select("event_type", B.sign_flip(vals, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / 3.0).alias("p"))


@query("STA9", "SELECT round((avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'N')) - (avg(l_tax) FILTER (l_returnflag = 'A') - avg(l_tax) FILTER (l_returnflag = 'N')), 6) AS contrast FROM lineitem")
def interaction_contrast(spark, d):
    x = table(spark, d, "lineitem")
    f = lambda c, v: F.avg(F.when(F.col("l_returnflag") == v, F.col(c)))
    return x.agg(_r(B.contrast(f("l_quantity", "A"), f("l_quantity", "N"), f("l_tax", "A"), f("l_tax", "N"))).alias("contrast"))


@query("STA10 JN9 STA7", """
WITH cuts AS (SELECT quantile_cont(n_chars::DOUBLE, 1 / 3.0::DOUBLE) AS a, quantile_cont(n_chars::DOUBLE, 2 / 3.0::DOUBLE) AS b FROM documents)
SELECT CASE WHEN n_chars >= b THEN 2 WHEN n_chars >= a THEN 1 ELSE 0 END AS bin, count(*) AS rows, round(100.0 * sum(doc_id % 7 - doc_id % 5) / sum(n_chars), 6) AS effect FROM documents, cuts GROUP BY 1""")
def tercile_effects(spark, d):
    x = _docs(spark, d).select("n_chars", (F.col("doc_id") % 7 - F.col("doc_id") % 5).alias("delta"))
    cuts = x.agg(F.percentile(F.col("n_chars").cast("double"), F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    b = x.crossJoin(F.broadcast(cuts)).withColumn("bin", B.tercile(F.col("n_chars"), F.get("q", F.lit(0)), F.get("q", F.lit(1))))  # one row
    return b.groupBy("bin").agg(F.count("*").alias("rows"), _r(100.0 * F.sum("delta") / F.sum("n_chars")).alias("effect"))


# ---- calibration -------------------------------------------------------------------------------------------

@query("ML5 WN1", """
WITH x AS (SELECT l.toxic AS y, d.n_chars % 50 AS s FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM x),
g AS (SELECT s, count(*) AS n, sum(y) AS p FROM x GROUP BY s), h AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS tn FROM g),
t AS (SELECT count(*) AS rows, sum(y) AS pos, sum(k) FILTER (y = 1) AS ks FROM r)
SELECT rows, pos::BIGINT AS positives, round((ks - pos * (pos + 1) / 2) / (pos * (rows - pos)), 9) AS roc_auc, round((SELECT sum(p * tp / tn) FROM h) / pos, 9) AS average_precision, round(pos / rows, 9) AS prevalence FROM t""")
def rank_auc_ap(spark, d):
    x = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", (F.col("n_chars") % 50).alias("s")), "doc_id")
    r = L.rank_auc(x, "toxic", "s")
    return r.select("rows", "positives", *(F.round(c, 9).alias(c) for c in ("roc_auc", "average_precision", "prevalence")))


@query("AG18 FLT6", """
WITH x AS (SELECT l.quality = 0 AS poor, d.n_chars > 1500 AS long, d.lang = 'zz' AS never FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT 'long' AS gate, long AS f, poor FROM x UNION ALL SELECT 'never', never, poor FROM x)
SELECT gate, count(*) FILTER (f AND poor) AS tp, count(*) FILTER (f AND NOT poor) AS fp, count(*) FILTER (NOT f AND poor) AS fn, count(*) FILTER (NOT f AND NOT poor) AS tn,
  round(count(*) FILTER (f AND poor) / nullif(count(*) FILTER (f), 0), 9) AS precision, round(count(*) FILTER (f AND poor) / nullif(count(*) FILTER (poor), 0), 9) AS recall FROM g GROUP BY gate""")
def gate_confusion(spark, d):
    x = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "n_chars", "lang"), "doc_id")
    long = F.explode(F.array(F.struct(F.lit("long").alias("gate"), (F.col("n_chars") > 1500).alias("f")), F.struct(F.lit("never").alias("gate"), (F.col("lang") == "zz").alias("f")))).alias("g")
    g = x.select((F.col("quality") == 0).alias("poor"), long).select("poor", "g.*")
    r = g.groupBy("gate").agg(*L.confusion(F.col("f"), F.col("poor")))
    return r.select("gate", "tp", "fp", "fn", "tn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("ML1 ML2 ML3 ML4 ML6 SEL13 AG17")
def grouped_oof(spark, d):
    x = table(spark, d, "labels").join(_docs(spark, d), "doc_id")
    x = T.with_diagnostics(x, "text", F.greatest(F.lit(1.0), F.col("n_chars") / 15.0))
    feats = ["word_count", "unique_word_ratio", "repeated_bigram_fraction", "repeated_trigram_fraction", "non_letter_fraction_raw"]
    f = x.select("doc_id", "source", F.col("quality").cast("double").alias("target"), *(F.col(k).cast("double").alias(k) for k in feats))
    folds = S.grouped_folds(f.groupBy("source").agg(F.count("*").alias("n")), "source", 4)
    return L.out_of_fold(f.join(folds, "source"), feats, "target", "fold", "doc_id").select("doc_id", _r(F.col("probability")).alias("probability"), "c")


@query("ML7")
def proxy_gate(spark, d):
    oof = grouped_oof(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return L.rank_auc(oof, "quality", "probability").select((F.col("roc_auc") >= 0.70).alias("passes"), _r(F.col("roc_auc")).alias("roc_auc"))


@query("UDF1 UDF2 UDF3 UDF4 INF1 INF2 INF3 INF4", "SELECT doc_id, length(text) AS scored FROM documents")
def scorer_hook(spark, d):
    def make():
        return lambda b: b.assign(scored=b["text"].str.len())[["doc_id", "scored"]]

    return L.scorer(_docs(spark, d).select("doc_id", "text"), make, "doc_id long, scored long")
