"""Scans, projections, filters, joins, aggregations and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import contracts as C
from tessera.functions.digests import canonical_row_sha256
from tessera.operators import audit as A
from tessera.operators import provenance as P
from tessera.operators import resample as B
from tessera.operators.model import gates
from tessera.plans.register import QUERIES, query, table
from tessera.sources import manifests as M
from tessera.sources import sinks as K


def _docs(spark, d):
    return table(spark, d, "documents")


# ---- scans -------------------------------------------------------------------------------------------------

@query("SRC10 SRC13", "SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def projected_scan(spark, d):
    return M.shards(spark, f"{d}/documents.parquet", ["doc_id", "lang"]).where("lang = 'de'")


@query("SRC11", "SELECT count(*) AS rows FROM (SELECT doc_id FROM documents LIMIT 100)")
def bounded_scan(spark, d):
    return M.shards(spark, f"{d}/documents.parquet", ["doc_id"], 100).agg(F.count("*").alias("rows"))


@query("SRC4 SET1 PRJ1 PRJ3", "SELECT lang || '_' || CAST(doc_id AS VARCHAR) AS id, lang AS original_split FROM documents WHERE lang IN ('en', 'fr')")
def pooled_splits(spark, d):
    x = _docs(spark, d).select(F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("speaker_id"), F.coalesce(F.nullif("text", F.lit("")), F.lit("-")).alias("text"), F.lit("a").alias("audio_filepath"), "lang")
    parts = {k: x.where(F.col("lang") == k).drop("lang") for k in ("en", "fr")}
    return M.pooled(parts).select("id", "original_split")


@query("SRC5 SRC6 JN3", "SELECT c.source AS cluster, count(*) AS rows FROM documents c GROUP BY 1")
def keyed_scan_with_clusters(spark, d):
    x = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("speaker_id"), "source")
    p = M.keyed_predictions(x.drop("source"))
    return A.with_cluster(p, M.cluster_map(x, "source")).groupBy("cluster").agg(F.count("*").alias("rows"))


@query("SRC7", "SELECT DISTINCT sha256(text) AS pcm_sha256 FROM documents")
def distinct_hashes(spark, d):
    return M.hash_set(_docs(spark, d).select(F.sha2("text", 256).alias("pcm_sha256")))


@query("SRC8", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_duplicate_wins(spark, d):
    return M.last_wins(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SRC9 JN6", "SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS position, n_chars FROM documents WHERE lang = 'en'")
def train_field(spark, d):
    from tessera.operators.ranking import ordered_position

    x = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("split"), "n_chars")
    ids = ordered_position(x.where("split = 'en'").select("id"), "id")
    return M.train_field(x, ids, "n_chars", "en").select("id", F.col("position").cast("bigint").alias("position"), "n_chars")


@query("SRC12 JN10", "SELECT doc_id % 8 AS shard, doc_id // 8 AS row_index, doc_id AS id, n_chars FROM documents WHERE doc_id % 5 = 0")
def point_lookup(spark, d):
    s = _docs(spark, d).select((F.col("doc_id") % 8).alias("shard"), F.floor(F.col("doc_id") / 8).cast("bigint").alias("row_index"), F.col("doc_id").alias("id"), "n_chars")
    return M.point_lookup(s.where("id % 5 = 0").drop("n_chars"), s, ["id"]).select("shard", "row_index", "id", "n_chars")


@query("SRC13 AG9", "SELECT count(*) FILTER (source IS NULL OR trim(source) = '') AS missing_audio, count(*) FILTER (NOT (source IS NULL OR trim(source) = '') AND (text IS NULL OR trim(text) = '')) AS empty_text FROM documents")
def dropped_rows(spark, d):
    return M.dropped_rows(_docs(spark, d), "source", "text")


@query("SRC3", "SELECT doc_id FROM documents WHERE lang NOT IN (SELECT DISTINCT lang FROM documents WHERE doc_id < 5)")
def missing_files(spark, d):
    x = _docs(spark, d).select("doc_id", F.col("lang").alias("file"))
    return M.missing_files(x, "file", x.where("doc_id < 5").select(F.col("file").alias("path"))).select("doc_id")


@query("SRC14 SRC22", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def pinned_dataset(spark, d):
    extra = {"fr": _docs(spark, d).where("lang = 'fr'").withColumn("revision", F.lit("v2"))}
    return M.pinned(extra["fr"], "v2").select("doc_id")


@query("SRC17", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: (v::DOUBLE + 2 * v::DOUBLE) / 2)), 5) AS total FROM embeddings WHERE len(embedding) > 0")
def downmixed(spark, d):
    from tessera.functions.arrays import total

    e = table(spark, d, "embeddings").where(F.size("embedding") > 0)
    two = F.array(F.transform("embedding", lambda v: v.cast("double")), F.transform("embedding", lambda v: 2 * v.cast("double")))
    return e.select("vec_id", F.round(total(M.downmix(two)), 5).alias("total"))


@query("SRC19", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_partkey % 2 = 0")
def asset_partition(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "noise").otherwise("rir").alias("kind"), F.get(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("p_size") % 3).alias("partition"))
    return M.assets(p, "train")["noise"].select("p_partkey")


@query("SRC25", "SELECT ts, value FROM events WHERE user_id = 7 AND event_type = 'click'")
def telemetry_filter(spark, d):
    e = table(spark, d, "events").select("ts", "value", F.col("user_id").alias("device"), F.col("event_type").alias("key"))
    return M.telemetry(e.withColumn("device", F.col("device").cast("string")), "7", "click")


@query("SRC23 JN14", r"""
WITH p AS (SELECT regexp_extract(url, '^[^?#]*') AS path FROM pages), n AS (SELECT path, regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1) AS name FROM p)
SELECT n.path, coalesce(d.text, '') AS text FROM n LEFT JOIN documents d ON CAST(d.doc_id * 2 AS VARCHAR) = n.name""")
def basename_left_join(spark, d):
    text = _docs(spark, d).select((F.col("doc_id") * 2).cast("string").alias("name"), "text")
    return M.text_directory(text, table(spark, d, "pages").select(F.regexp_extract("url", "^[^?#]*", 0).alias("path"))).select("path", "text")


# ---- projections and filters -------------------------------------------------------------------------------

@query("PRJ2", "SELECT page_id, regexp_extract(url, '([^/?#]+)/?([?#].*)?$', 1) AS stem FROM pages")
def rekey_from_stem(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]+)/?([?#].*)?$", 1).alias("stem"))


@query("PRJ4", "SELECT doc_id, CASE quality WHEN 0 THEN 'poor' WHEN 1 THEN 'good' END AS quality_name FROM labels")
def enum_decode(spark, d):
    names = F.create_map(F.lit(0), F.lit("poor"), F.lit(1), F.lit("good"))
    return table(spark, d, "labels").select("doc_id", F.try_element_at(names, F.col("quality")).alias("quality_name"))


@query("FLT1", "SELECT doc_id FROM documents WHERE NOT (text IS NULL OR trim(text) = '') AND n_chars < 5000")
def hard_rejects(spark, d):
    return _docs(spark, d).where(~C.missing(F.col("text")) & ~(F.col("n_chars") >= 5000)).select("doc_id")


@query("FLT3", "SELECT event_id FROM events WHERE value / 10 BETWEEN 1.0 AND 30.0")
def duration_window(spark, d):
    return table(spark, d, "events").where((F.col("value") / 10).between(A.SHORTEST, A.LONGEST)).select("event_id")


@query("FLT5", "SELECT event_id, (value / 490 > 0.4)::INT AS t40, (value / 490 > 0.5)::INT AS t50, (value / 490 > 0.8)::INT AS t80 FROM events")
def threshold_targets(spark, d):
    w = F.col("value") / 490
    return table(spark, d, "events").select("event_id", *((w > t).cast("int").alias(f"t{round(100 * t)}") for t in (0.4, 0.5, 0.8)))


@query("FLT6", """
SELECT event_id, coalesce(CASE WHEN event_id % 9 <> 0 THEN value / 100 END, 0) > 2.4 AS compression,
  coalesce(CASE WHEN event_id % 7 <> 0 THEN -value / 200 END, '-inf'::DOUBLE) < -1.0 AS logprob,
  (user_id % 10) / 10.0 > 0.6 AND coalesce(CASE WHEN event_id % 7 <> 0 THEN -value / 200 END, '-inf'::DOUBLE) < -1.0 AS no_speech, event_type = 'click' AS hit_max FROM events""")
def gate_predicates(spark, d):
    e = table(spark, d, "events")
    g = gates(F.when(F.col("event_id") % 9 != 0, F.col("value") / 100), F.when(F.col("event_id") % 7 != 0, -F.col("value") / 200), F.col("user_id") % 10 / 10.0, F.col("event_type") == "click")
    return e.select("event_id", *(c.alias(n) for n, c in g.items()))


@query("FLT8", "SELECT doc_id FROM documents WHERE lang IS NULL OR trim(lang) = '' OR source IS NULL OR trim(source) = ''")
def missing_values(spark, d):
    return C.not_missing(_docs(spark, d), "lang", "source").select("doc_id")


@query("FLT10 JN4", "SELECT o_orderkey, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS unseen FROM orders")
def unseen_mask(spark, d):
    seen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("s"))
    return table(spark, d, "orders").join(seen, "o_custkey", "left").select("o_orderkey", F.col("s").isNull().alias("unseen"))


@query("FLT11", "SELECT page_id FROM pages WHERE url LIKE '%.com/%' AND regexp_matches(url, '/(en|de)/')")
def allow_list(spark, d):
    return table(spark, d, "pages").where(F.col("url").contains(".com/") & F.col("url").rlike("/(en|de)/")).select("page_id")


# ---- joins -------------------------------------------------------------------------------------------------

@query("JN1 AG1 AG2", """
WITH p AS (SELECT source, length(text) AS n, length(lang) * 3 AS eb, doc_id % 5 AS ec FROM documents)
SELECT source, sum(eb)::BIGINT AS eb, sum(ec)::BIGINT AS ec, sum(n)::BIGINT AS n, round(100.0 * sum(eb) / sum(n), 6) AS wer_base, round(100.0 * sum(ec) / sum(n), 6) AS wer_candidate FROM p GROUP BY source""")
def corpus_error_rate(spark, d):
    x = _docs(spark, d).select(F.col("doc_id").alias("id"), "source", F.length("text").alias("n"), (F.length("lang") * 3).alias("a"), (F.col("doc_id") % 5).alias("b"))
    j = A.paired(x.select("id", "source", "n", F.col("a").cast("bigint").alias("e")), x.select("id", "source", "n", F.col("b").alias("e")), "id", ["source", "n"], ["e"])
    s = j.groupBy("source").agg(F.sum("e_base").alias("eb"), F.sum("e_candidate").alias("ec"), F.sum("n").alias("n"))
    return s.select("source", "eb", "ec", "n", F.round(100.0 * F.col("eb") / F.col("n"), 6).alias("wer_base"), F.round(100.0 * F.col("ec") / F.col("n"), 6).alias("wer_candidate"))


@query("JN2", """
SELECT l_orderkey AS id, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS c1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS c2
FROM lineitem WHERE l_linenumber IN (1, 2) AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT l_linenumber) = 2) GROUP BY 1""")
def four_way_cells(spark, d):
    x = table(spark, d, "lineitem").where("l_linenumber in (1, 2)").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("cell"), "l_quantity")
    whole = x.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("k")).where("n = 2 and k = 2").select("id")
    return A.four_way(x.join(whole, "id", "left_semi"), "id", "cell", ["c1", "c2"], [], "l_quantity")


@query("JN5", "SELECT c_custkey, (SELECT coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '') FROM orders o WHERE o.o_custkey = c_custkey) AS splits FROM customer")
def overlapping_splits(spark, d):
    gold = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("split"))
    return A.overlapping_splits(table(spark, d, "customer").select("c_custkey"), gold, "c_custkey", ["F", "O", "P"]).select("c_custkey", F.array_join("gold_speaker_splits", ",").alias("splits"))


@query("JN7 DQ5", """
WITH r AS (SELECT doc_id, lang AS path, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 4 <> 0),
j AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'moved' ELSE d.lang END AS path, sha256(d.text) AS s, r.path AS p, r.h FROM documents d LEFT JOIN r USING (doc_id))
SELECT count(*) FILTER (h IS NULL) AS without_reference, count(*) FILTER (h IS NOT NULL AND path <> p) AS moved, count(*) FILTER (path = p AND s <> h) AS mismatched, count(*) FILTER (path = p AND s = h) AS equal FROM j""")
def conditional_hash_check(spark, d):
    x = _docs(spark, d).select(F.col("doc_id").alias("id"), "lang", F.sha2("text", 256).alias("sha256"))
    ref = x.where("id % 4 <> 0").select("id", F.col("lang").alias("path"), F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return A.metadata_changes(x.select("id", F.when(F.col("id") % 3 == 0, "moved").otherwise(F.col("lang")).alias("path"), "sha256"), ref)


@query("JN9", "SELECT doc_id, CASE WHEN n_chars >= 1500 THEN 2 WHEN n_chars >= 600 THEN 1 ELSE 0 END AS bin FROM documents")
def bin_lookup(spark, d):
    return _docs(spark, d).select("doc_id", B.tercile(F.col("n_chars"), F.lit(600), F.lit(1500)).alias("bin"))


@query("JN11", "SELECT e.event_id, d.lang FROM events e JOIN documents d ON e.event_id = d.doc_id")
def join_by_carried_id(spark, d):
    return table(spark, d, "events").select("event_id").join(_docs(spark, d).select(F.col("doc_id").alias("event_id"), "lang"), "event_id")


@query("JN12", """
WITH g AS (SELECT f.l_returnflag AS flag, n.l_linenumber AS seed FROM (SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_quantity > 49) n)
SELECT flag, seed FROM g EXCEPT SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09""")
def missing_cells(spark, d):
    x = table(spark, d, "lineitem")
    # a grid of conditions and seeds: a few values each
    grid = x.select(F.col("l_returnflag").alias("flag")).distinct().crossJoin(F.broadcast(x.where("l_quantity > 49").select(F.col("l_linenumber").alias("seed")).distinct()))
    have = x.where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("seed")).distinct()
    return grid.join(have, ["flag", "seed"], "left_anti")


@query("JN13 WN10", """
WITH c AS (SELECT l_returnflag AS cell, l_linenumber AS seed, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT t.cell, t.seed, round(t.v - c.v, 9) AS gain FROM c t JOIN c ON c.cell = 'N' AND c.seed = t.seed WHERE t.cell <> 'N'""")
def matched_control(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("cell"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_quantity").alias("v"))
    control = c.where("cell = 'N'").select("seed", F.col("v").alias("base"))
    return c.where("cell <> 'N'").join(control, "seed").select("cell", "seed", F.round(F.col("v") - F.col("base"), 9).alias("gain"))


@query("JN15 SNK9", """
WITH e AS (SELECT url AS path, length(html) AS size, sha256(html) AS h FROM pages WHERE page_id % 5 <> 0),
p AS (SELECT url AS path, length(html) + (page_id % 7 = 0)::INT AS size, sha256(html) AS h FROM pages WHERE page_id % 11 <> 0)
SELECT coalesce(e.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN e.size <> p.size OR e.h <> p.h THEN 'changed' ELSE 'same' END AS state FROM e FULL JOIN p ON e.path = p.path""")
def inventory_diff(spark, d):
    x = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("size"), F.sha2("html", 256).alias("sha256"))
    have = x.where("page_id % 11 <> 0").withColumn("size", F.col("size") + (F.col("page_id") % 7 == 0).cast("int"))
    return K.inventory_diff(x.where("page_id % 5 <> 0"), have)


# ---- aggregations ------------------------------------------------------------------------------------------

@query("AG3", "SELECT source AS cluster, sum(n_chars % 7)::BIGINT AS errors_base, sum(n_chars % 5)::BIGINT AS errors_candidate, sum(n_chars)::BIGINT AS words FROM documents GROUP BY source")
def cluster_counts(spark, d):
    return _docs(spark, d).groupBy(F.col("source").alias("cluster")).agg(F.sum(F.col("n_chars") % 7).alias("errors_base"), F.sum(F.col("n_chars") % 5).alias("errors_candidate"), F.sum("n_chars").alias("words"))


@query("AG4 AG5", """
WITH g AS (SELECT source, count(*) AS r, sum(n_chars / 3600.0) AS h FROM documents GROUP BY source)
SELECT sum(r)::BIGINT AS rows, round(sum(h), 6) AS hours, count(*) AS groups, max(r) AS max_rows, round(max(h), 6) AS max_hours, round(max(r) / sum(r), 9) AS max_row_share, round(max(h) / sum(h), 9) AS max_hour_share FROM g""")
def selection_profile(spark, d):
    return A.group_profile(_docs(spark, d).select("source", (F.col("n_chars") / 3600.0).alias("h")), "source", "h")


@query("AG5", "SELECT 0::BIGINT AS rows, 0.0::DOUBLE AS hours, 0::BIGINT AS groups, NULL::BIGINT AS max_rows, NULL::DOUBLE AS max_hours, NULL::DOUBLE AS max_row_share, NULL::DOUBLE AS max_hour_share")
def empty_selection_profile(spark, d):
    return A.group_profile(_docs(spark, d).where("false").select("source", (F.col("n_chars") / 3600.0).alias("h")), "source", "h")


@query("AG6 AG7 DQ2", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def value_counts(spark, d):
    return A.value_counts(_docs(spark, d), "lang", "source")


@query("AG8 AG9 DQ3", "SELECT count(*) AS rows, count(DISTINCT text) AS texts, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (text IS NULL OR trim(text) = '') AS missing_text FROM documents")
def shard_audit(spark, d):
    x = _docs(spark, d)
    return x.agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"), (F.count("*") - F.count_distinct("text")).alias("duplicates"), F.count_if(C.missing(F.col("text"))).alias("missing_text"))


@query("AG10", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p975 FROM events GROUP BY 1")
def interpolated_percentiles(spark, d):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.975).alias("p975"))


@query("AG11", "SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY source")
def upper_median(spark, d):
    return A.upper_median(_docs(spark, d), "n_chars", ("source",))


@query("AG12", "SELECT event_type, min(value) AS low, round(quantile_cont(value, .05), 6) AS p05, round(quantile_cont(value, .25), 6) AS p25, round(quantile_cont(value, .5), 6) AS p50, round(quantile_cont(value, .75), 6) AS p75, round(quantile_cont(value, .95), 6) AS p95, max(value) AS high FROM events GROUP BY 1")
def percentile_summary(spark, d):
    x = table(spark, d, "events").groupBy("event_type").agg(*A.seven_points("value"))
    return x.select("event_type", "low", *(F.round(c, 6).alias(c) for c in ("p05", "p25", "p50", "p75", "p95")), "high")


@query("AG13 AG14", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high, count(l_quantity) AS n,
  CASE WHEN count(*) = 1 OR count(DISTINCT l_quantity) = 1 THEN format('{:.2f}', avg(l_quantity)) ELSE format('{:.2f} ± {:.2f}', avg(l_quantity), stddev_samp(l_quantity)) END AS cell
FROM lineitem GROUP BY 1""")
def mean_and_deviation(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*B.spread_of("l_quantity"), F.count_distinct("l_quantity").alias("k"))
    cell = F.when((F.col("n") == 1) | (F.col("k") == 1), F.format_string("%.2f", "mean")).otherwise(F.format_string("%.2f ± %.2f", "mean", "sd"))
    return x.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "low", "high", "n", cell.alias("cell"))


@query("AG15", "SELECT source, round(100.0 * sum(n_chars % 3) / sum(n_chars), 6) AS substitution_rate, round(100.0 * sum(n_chars % 5) / sum(n_chars), 6) AS deletion_rate FROM documents GROUP BY source")
def error_rates_per_hundred(spark, d):
    r = lambda c: F.round(100.0 * F.sum(c) / F.sum("n_chars"), 6)
    return _docs(spark, d).groupBy("source").agg(r(F.col("n_chars") % 3).alias("substitution_rate"), r(F.col("n_chars") % 5).alias("deletion_rate"))


@query("AG17", "SELECT event_type, arg_max(user_id, (value, -user_id)) AS best FROM events GROUP BY event_type")
def best_with_tie_break(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("user_id", F.struct("value", -F.col("user_id"))).alias("best"))


@query("AG19", "SELECT event_type, count(*) FILTER (value / 490 > .4) AS over_40, count(*) FILTER (value / 490 > .5) AS over_50, count(*) FILTER (value / 490 > .8) AS over_80 FROM events GROUP BY 1")
def exceedance_counts(spark, d):
    w = F.col("value") / 490
    return table(spark, d, "events").groupBy("event_type").agg(*(F.count_if(w > t).alias(f"over_{round(t * 100)}") for t in (0.4, 0.5, 0.8)))


@query("AG20", """
WITH c AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id), k AS (SELECT v FROM c WHERE len(v) % 3 = 0 AND len(v) > 0)
SELECT e.i AS epoch, round(avg(v[e.i + 1]), 6) AS mean FROM k, (VALUES (0), (1), (2)) e(i) GROUP BY 1""")
def curve_means(spark, d):
    events = table(spark, d, "events")
    # only the first three values of a curve count, so no curve is collected whole
    first = F.slice(F.array_sort(F.collect_list(F.struct("event_id", "value"))), 1, 3)
    sizes = events.groupBy("user_id").agg(F.count("*").alias("n")).where("n % 3 = 0")
    ranked = events.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 3")
    c = ranked.groupBy("user_id").agg(first.alias("v")).join(sizes, "user_id")
    k = c.select(F.posexplode(F.transform("v", lambda x: x["value"])).alias("epoch", "x"))
    return k.groupBy("epoch").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("AG21", "SELECT o_custkey, round(sum(o_totalprice) - sum(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS rest FROM orders GROUP BY 1 HAVING sum(o_totalprice) FILTER (o_orderstatus = 'F') IS NOT NULL")
def time_split(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("parts")).where(F.size("parts") > 0)
    return x.select("o_custkey", F.round(F.col("total") - F.aggregate("parts", F.lit(0.0), lambda a, v: a + v), 4).alias("rest"))


@query("AG22", """
WITH l AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, round(median(gap / 1000000.0), 3) AS median_gap FROM l WHERE gap IS NOT NULL GROUP BY user_id""")
def median_interval(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("t", t)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("gap", gap / 1000000.0).where("gap is not null").groupBy("user_id").agg(F.round(F.percentile("gap", F.lit(0.5)), 3).alias("median_gap"))


@query("AG23", "SELECT count(*) AS rows, count(*) FILTER (n_chars % 2 = 0) AS speed, count(*) FILTER (n_chars % 3 = 0) AS rir, count(*) FILTER (n_chars % 5 = 0) AS noise, round(sum(n_chars / 3600.0), 6) AS hours FROM documents")
def transform_counts(spark, d):
    n = F.col("n_chars")
    return _docs(spark, d).agg(F.count("*").alias("rows"), F.count_if(n % 2 == 0).alias("speed"), F.count_if(n % 3 == 0).alias("rir"), F.count_if(n % 5 == 0).alias("noise"), F.round(F.sum(n / 3600.0), 6).alias("hours"))


@query("AG24", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def two_key_counts(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return x.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("AG25 SET6", "SELECT sha256(text) AS content, count(DISTINCT source) AS parts FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def content_leakage(spark, d):
    return A.leakage(_docs(spark, d).select(F.sha2("text", 256).alias("content"), "source"), "content", "source")


@query("AG26 AG27", "SELECT lang, count(DISTINCT sha256(text)) = 1 AS identical, bool_and(n_chars > 0) AS filled, bool_and(n_chars = length(text)) AS counted FROM documents GROUP BY lang")
def admission_checks(spark, d):
    return _docs(spark, d).groupBy("lang").agg((F.count_distinct(F.sha2("text", 256)) == 1).alias("identical"), F.bool_and(F.col("n_chars") > 0).alias("filled"), F.bool_and(F.col("n_chars") == F.length("text")).alias("counted"))


@query("AG28", "WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM g")
def duplicate_groups(spark, d):
    return C.unique(_docs(spark, d), "text").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query("AG29", "SELECT best, count(*) AS runs FROM (SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best FROM lineitem GROUP BY 1) GROUP BY best")
def best_checkpoint_counts(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("best"))
    return x.groupBy("best").agg(F.count("*").alias("runs"))


# ---- sets --------------------------------------------------------------------------------------------------

@query("SET2 SET3 SET4", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 480), b AS (SELECT DISTINCT user_id FROM events WHERE value < 10)
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b""")
def set_profile(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.max("value").alias("hi"), F.min("value").alias("lo")).select((F.col("hi") > 480).alias("a"), (F.col("lo") < 10).alias("b"))
    return s.agg(F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


@query("SET3 DQ6", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS groups FROM events WHERE value > 470 GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def disjoint_groups(spark, d):
    return C.disjoint(table(spark, d, "events").where("value > 470"), "user_id", "event_type").select("user_id", F.array_join("groups", ",").alias("groups"))


@query("SET5", "SELECT (SELECT count(*) FROM documents WHERE n_chars > 2000 AND NOT n_chars > 1000) AS first_outside, (SELECT count(*) FROM documents WHERE n_chars > 1000 AND NOT n_chars > 2000) AS second_more")
def strict_nesting(spark, d):
    x = _docs(spark, d).select("doc_id", "n_chars")
    a, b = x.where("n_chars > 2000").select("doc_id"), x.where("n_chars > 1000").select("doc_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.join(b, "doc_id", "left_anti"), "first_outside").crossJoin(n(b.join(a, "doc_id", "left_anti"), "second_more"))  # one row each


# ---- admission ---------------------------------------------------------------------------------------------

_ADMIT = """
WITH r AS (SELECT doc_id AS id, source AS speaker_id, n_chars / 100.0 AS duration, CASE WHEN doc_id % 40 = 0 THEN 2 ELSE 1 END AS channels, sha256(text) AS h, doc_id // 100 AS shard, doc_id % 100 AS row FROM documents),
w AS (SELECT *, id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS r1, speaker_id IN ('src1', 'src2') AS r2, duration < 1.0 AS r3, duration > 30.0 AS r4, channels <> 1 AS r5,
  h IN (SELECT sha256(text) FROM documents WHERE doc_id % 60 = 0) AS r6, h IN (SELECT sha256(text) FROM benchmark) AS r7, row_number() OVER (PARTITION BY h ORDER BY shard, row) > 1 AS r8 FROM r),
x AS (SELECT id, list_filter([CASE WHEN r1 THEN 'gold_id' END, CASE WHEN r2 THEN 'evaluation_speaker' END, CASE WHEN r3 THEN 'too_short' END, CASE WHEN r4 THEN 'too_long' END, CASE WHEN r5 THEN 'not_mono' END,
  CASE WHEN r6 THEN 'gold_audio' END, CASE WHEN r7 THEN 'external_audio' END, CASE WHEN r8 THEN 'duplicate_audio' END], lambda v: v IS NOT NULL) AS why FROM w)
"""


def _admitted(spark, d):
    x = _docs(spark, d)
    rows = x.select(F.col("doc_id").alias("id"), F.col("source").alias("speaker_id"), (F.col("n_chars") / 100.0).alias("duration"), F.when(F.col("doc_id") % 40 == 0, 2).otherwise(1).alias("channels"), F.sha2("text", 256).alias("pcm_sha256"), F.floor(F.col("doc_id") / 100).alias("shard"), (F.col("doc_id") % 100).alias("row"))
    gold = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    speakers = rows.where("speaker_id in ('src1', 'src2')").select("speaker_id")
    external = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("pcm_sha256"))
    return A.admission(rows, gold, speakers, rows.where("id % 60 = 0").select("pcm_sha256"), external, ["shard", "row"])


@query("DQ1 FLT2 FLT3 JN4 WN7", _ADMIT + "SELECT id, array_to_string(why, ',') AS reasons, len(why) = 0 AS eligible FROM x")
def admission_gate(spark, d):
    return _admitted(spark, d).select("id", F.array_join("rejection_reasons", ",").alias("reasons"), "eligible")


@query("AG16", _ADMIT + "SELECT reason, count(*) AS n FROM (SELECT unnest(why) AS reason FROM x) GROUP BY reason")
def rejection_counts(spark, d):
    return A.reason_counts(_admitted(spark, d))


@query("DQ4", """
SELECT count(*) FILTER (d.text <> b.text) AS changed, count(*) FILTER (regexp_matches(d.text, '[0-9]')) AS with_digits, count(*) - count(DISTINCT d.doc_id) AS repeated_ids, count(*) FILTER (sha256(d.text) = sha256(b.text)) AS overlap
FROM documents d JOIN benchmark b ON d.doc_id = b.item_id""")
def corrected_set_audit(spark, d):
    j = _docs(spark, d).select("doc_id", "text").join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("old")), "doc_id")
    return j.agg(F.count_if(F.col("text") != F.col("old")).alias("changed"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"), F.count_if(F.sha2("text", 256) == F.sha2("old", 256)).alias("overlap"))


@query("DQ7", "SELECT count(*) AS violations FROM lineitem WHERE abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount)) > 1e-6")
def recomputation_check(spark, d):
    p, q = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, d, "lineitem").where(F.abs(p * (1 - q) - (p - p * q)) > 1e-6).agg(F.count("*").alias("violations"))


@query("SNK1 SRC1 SRC2", "SELECT doc_id, lang, 'train' AS split FROM documents")
def jsonl_round_trip(spark, d):
    path = _scratch(spark)
    K.write_jsonl(_docs(spark, d).select("doc_id", "lang"), path)
    return M.jsonl(spark, path, "doc_id bigint, lang string").withColumn("split", F.lit("train"))


@query("SNK6", "SELECT doc_id, source, n_chars FROM documents")
def csv_round_trip(spark, d):
    path = _scratch(spark)
    K.write_csv(_docs(spark, d).select("doc_id", "source", "n_chars"), path)
    return M.csv(spark, path, "doc_id bigint, source string, n_chars bigint")


@query("SNK2 SNK3 SNK4 SNK5 SNK13", "SELECT vec_id, label FROM embeddings")
def staged_round_trip(spark, d):
    path = _scratch(spark)
    K.write_staged(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", "label")


@query("SNK7 SNK8", "SELECT doc_id // 128 AS chunk, min(doc_id) AS first, max(doc_id) AS last, count(*) AS rows FROM documents GROUP BY 1")
def resumable_chunks(spark, d):
    marks = K.chunked(_docs(spark, d).select("doc_id", "lang", "n_chars"), _scratch(spark), "doc_id", 128, "v1")
    return marks.select("chunk", "first", "last", "rows")


# ---- files, reports and gates ------------------------------------------------------------------------------

_NAMED = ("docs=documents", "chats-1=conversations", "web.pages=pages")


@query("SRC15", "SELECT 'docs' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'chats-1', count(*) FROM conversations UNION ALL SELECT 'web.pages', count(*) FROM pages")
def named_manifests(spark, d):
    out = None
    for name, t in M.named(list(_NAMED)).items():
        part = table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.union(part)
    return out


def _runs(spark, d) -> str:
    """A folder of results, a file a language."""
    path = _scratch(spark)
    runs = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    runs.repartition(1).write.partitionBy("lang").json(path)  # a row a language
    return path


@query("SRC16", "SELECT DISTINCT 'lang=' || lang AS folder FROM documents")
def file_inventory(spark, d):
    return M.listing(spark, _runs(spark, d), "*.json").select(F.regexp_extract("path", "/([^/]+)/[^/]*$", 1).alias("folder"))


@query("SRC24", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def run_grid(spark, d):
    return M.run_grid(spark, _runs(spark, d) + "/lang=*", "lang=([^/]+)/", ["lang"], "n bigint, chars bigint")


@query("SRC18", "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 8000 WHEN 1 THEN 16000 ELSE 44100 END AS sample_rate, 1 AS channels, 16 AS bits, round(len(embedding) / (CASE vec_id % 3 WHEN 0 THEN 8000 WHEN 1 THEN 16000 ELSE 44100 END), 9) AS duration FROM embeddings")
def wav_headers(spark, d):
    rate = F.when(F.col("vec_id") % 3 == 0, 8000).when(F.col("vec_id") % 3 == 1, 16000).otherwise(44100)
    wav = table(spark, d, "embeddings").select("vec_id", M.wav_header(K.pcm_wav("embedding", rate)).alias("h"))
    return wav.select("vec_id", "h.sample_rate", "h.channels", "h.bits", F.round("h.duration", 9).alias("duration"))


@query("SRC20", "SELECT * FROM (VALUES ('a/b.json', '/data/root/a/b.json'), ('/abs/c.json', '/abs/c.json'), ('../up.json', '/data/up.json'), ('./x', '/data/root/x')) t(value, path)")
def config_paths(spark, d):
    return spark.createDataFrame([(v, M.config_path(v, "/data/root")) for v in ("a/b.json", "/abs/c.json", "../up.json", "./x")], "value string, path string")


_CELLS = "SELECT l_returnflag AS flag, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1"


@query("SNK10 AG14", f"""
WITH c AS ({_CELLS})
SELECT '| flag | quantity | rows |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || flag || ' | ' || printf('%.2f', m) || ' ± ' || printf('%.2f', s) || ' | ' || CAST(n AS VARCHAR) || ' |' || chr(10), '' ORDER BY flag) AS report FROM c""")
def markdown_report(spark, d):
    q = F.col("l_quantity").cast("double")
    cells = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(q).alias("m"), F.stddev_samp(q).alias("s"), F.count("*").alias("n")).orderBy("l_returnflag").collect()  # a row a flag
    rows = [{"flag": r["l_returnflag"], "quantity": K.mean_sd(r["m"], r["s"]), "rows": r["n"]} for r in cells]
    return spark.createDataFrame([(K.markdown_table(rows),)], "report string")


@query("SNK11", "SELECT 'head' || chr(10) || '<!-- begin -->' || chr(10) || CAST(count(*) AS VARCHAR) || ' rows' || chr(10) || '<!-- end -->' || chr(10) || 'tail' AS document FROM documents")
def replaced_block(spark, d):
    body = f"{_docs(spark, d).count()} rows\n"
    return spark.createDataFrame([(K.replace_block("head\n<!-- begin -->\nold\n<!-- end -->\ntail", "<!-- begin -->", "<!-- end -->", body),)], "document string")


@query("SNK12", "SELECT true AS first, false AS again, true AS refused, CAST(count(*) AS VARCHAR) AS text FROM documents")
def exact_write(spark, d):
    path, text = _scratch(spark), str(_docs(spark, d).count())
    first, again, refused = K.write_text(spark, path, text), K.write_text(spark, path, text), False
    try:
        K.write_text(spark, path, text + "x")
    except FileExistsError:
        refused = True
    return spark.read.text(path, wholetext=True).select(F.lit(first).alias("first"), F.lit(again).alias("again"), F.lit(refused).alias("refused"), F.col("value").alias("text"))


@query("FN23", """SELECT doc_id, sha256('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":' || CAST(to_json(lang) AS VARCHAR) || ',"n_chars":' || CAST(n_chars AS VARCHAR) || ',"source":' || CAST(to_json(source) AS VARCHAR) || '}') AS digest FROM documents""")
def canonical_digest(spark, d):
    return _docs(spark, d).select("doc_id", canonical_row_sha256("source", "lang", "doc_id", "n_chars").alias("digest"))


@query("PRV2", "SELECT * FROM (VALUES ('optim.rate', true), ('seed', true), ('data.path', false)) t(field, changed)")
def config_changes(spark, d):
    base = {"seed": 1, "optim": {"rate": 0.1, "steps": 9}, "data": {"path": "p"}}
    changed = P.changed_fields(base, P.derive(base, {"optim.rate": 0.2, "seed": 2}, {"optim.rate", "seed"}))
    return spark.createDataFrame([(f, f in changed) for f in ("optim.rate", "seed", "data.path")], "field string, changed boolean")


@query("PRV3 PRV4", "SELECT * FROM (VALUES ('destination', 'reports', true), ('destination', 'elsewhere', false), ('part', 'train', true), ('part', 'test', false), ('part, permitted', 'test', true)) t(kind, name, passes)")
def destination_gates(spark, d):
    def passes(f, *args) -> bool:
        try:
            f(*args)
        except (ValueError, PermissionError):
            return False
        return True

    rows = [("destination", n, passes(P.check_destination, n, {"reports"})) for n in ("reports", "elsewhere")]
    rows += [("part", n, passes(P.unlocked, n, {"test"}, False)) for n in ("train", "test")]
    rows.append(("part, permitted", "test", passes(P.unlocked, "test", {"test"}, True)))
    return spark.createDataFrame(rows, "kind string, name string, passes boolean")


@query("UDF6", "SELECT * FROM (VALUES ('destination_gates', true), ('no_such_query', false)) t(command, known)")
def command_registry(spark, d):
    return spark.createDataFrame([(n, n in QUERIES) for n in ("destination_gates", "no_such_query")], "command string, known boolean")


def _scratch(spark) -> str:
    """A new path in the folder that the driver and the executors share; a local one only in a single process (tests)."""
    import atexit
    import re
    import shutil
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/sink-{uuid.uuid4().hex}"
