"""Ranks, samples, splits and curricula on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.digests import draw, ordered_digests
from tessera.operators import ranking as R
from tessera.operators import selection as S
from tessera.plans.register import query, table

_DRAW = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::HUGEINT)"


def _d(*parts: str) -> str:
    return _DRAW.format("concat_ws(':', " + ", ".join(parts) + ")")


@query("WN1", """
WITH r AS (SELECT event_id, value, rank() OVER (ORDER BY value) AS k, count(*) OVER (PARTITION BY value) AS m, count(*) OVER () AS n FROM events)
SELECT event_id, round((k - 1 + (m - 1) / 2.0) / (n - 1), 9) AS pct FROM r""")
def tie_avg_percentile(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return R.tie_percentile(e, "value", "pct").select("event_id", F.round("pct", 9).alias("pct"))


@query("WN1", """
WITH r AS (SELECT doc_id, source, rank() OVER (PARTITION BY source ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY source, n_chars) AS m, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, round(CASE WHEN n = 1 THEN 0.5 ELSE (k - 1 + (m - 1) / 2.0) / (n - 1) END, 9) AS pct FROM r""")
def tie_percentile_by_group(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return R.tie_percentile(x, "n_chars", "pct", ("source",)).select("doc_id", "source", F.round("pct", 9).alias("pct"))


@query("WN2 CUR1", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, CAST(doc_id AS VARCHAR), doc_id) - 1 AS position FROM documents")
def static_order(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars")
    return R.static_order(x, "n_chars", "doc_id", "doc_id").select("doc_id", F.col("position").cast("bigint").alias("position"))


@query("WN2 PRJ5", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS position FROM lineitem")
def global_position(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return R.global_position(x, "l_shipdate", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("position").cast("bigint").alias("position"))


@query("WN3", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS occurrence FROM events")
def occurrence_counter(spark, d):
    return R.occurrence(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", F.col("occurrence").cast("bigint").alias("occurrence"))


@query("WN4", "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running_max FROM events")
def running_maximum(spark, d):
    return R.running_max(table(spark, d, "events").select("event_id", "user_id", "value"), "value", ["event_id"], ("user_id",)).select("event_id", "user_id", "running_max")


@query("WN5", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN rank < ceil(n / 3.0) THEN 1 WHEN rank < ceil(n * 2.0 / 3.0) THEN 2 ELSE 3 END AS INTEGER) AS stage FROM r""")
def first_eligible_stage(spark, d):
    x = R.global_position(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", out="rank")
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(n)).select("doc_id", R.first_stage(F.col("rank"), F.col("n"), [1 / 3, 2 / 3, 1.0]).alias("stage"))


@query("WN7", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def first_seen_duplicates(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return R.first_seen(x, "h", ["doc_id"]).select("doc_id", "is_duplicate")


@query("WN8", """
WITH l AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT event_id, user_id FROM l WHERE value < b""")
def order_breaks(spark, d):
    return R.breaks_of_order(table(spark, d, "events").select("event_id", "user_id", "value"), "value", ["event_id"], ("user_id",)).select("event_id", "user_id")


@query("WN9", """
SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 9) AS normalized
FROM events WINDOW w AS (PARTITION BY event_type)""")
def min_max_normalized(spark, d):
    return R.min_max(table(spark, d, "events").select("event_id", "event_type", "value"), "value", "normalized", ("event_type",)).select("event_id", F.round("normalized", 9).alias("normalized"))


@query("CUR2", """
WITH r AS (SELECT event_id, rank() OVER (ORDER BY value) AS k, count(*) OVER (PARTITION BY value) AS m, count(*) OVER () AS n FROM events)
SELECT event_id, round(1.0 - (k - 1 + (m - 1) / 2.0) / (n - 1), 9) AS difficulty FROM r""")
def snr_difficulty(spark, d):
    return R.snr_difficulty(table(spark, d, "events").select("event_id", "value"), "value").select("event_id", F.round("difficulty", 9).alias("difficulty"))


@query("CUR3 WN1 WN2", """
WITH j AS (SELECT d.doc_id, d.n_chars, length(d.source) * 1000 + d.doc_id % 97 AS snr FROM documents d),
r AS (SELECT *, count(*) OVER () AS n,
  (rank() OVER (ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0) AS a,
  (rank() OVER (ORDER BY snr) - 1 + (count(*) OVER (PARTITION BY snr) - 1) / 2.0) AS b FROM j)
SELECT doc_id, round(0.5 * a / (n - 1) + 0.5 * (1.0 - b / (n - 1)), 9) AS difficulty FROM r""")
def joint_difficulty_order(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars", (F.length("source") * 1000 + F.col("doc_id") % 97).alias("snr"))
    return R.joint_difficulty(x, "n_chars", "snr").select("doc_id", F.round("difficulty", 9).alias("difficulty"))


@query("CUR4 SEL6", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_d("'7'", "CAST(doc_id AS VARCHAR)")}, CAST(doc_id AS VARCHAR)) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, round(k / (n - 1), 9) AS priority FROM r""")
def random_priority(spark, d):
    return R.random_priority(table(spark, d, "documents").select("doc_id"), 7, "doc_id").select("doc_id", F.round("priority", 9).alias("priority"))


@query("SEL5 SEL10", f"SELECT doc_id FROM documents ORDER BY {_d("'11'", "CAST(doc_id AS VARCHAR)")}, CAST(doc_id AS VARCHAR) LIMIT 50")
def seeded_sample(spark, d):
    return S.seeded_sample(table(spark, d, "documents").select("doc_id"), 11, "doc_id", 50)


@query("SEL10", f"SELECT doc_id, CAST({_d("'speed'", "'42'", "CAST(doc_id AS VARCHAR)")} AS VARCHAR) AS seed FROM documents")
def row_seeds(spark, d):
    return table(spark, d, "documents").select("doc_id", draw("speed", "42", F.col("doc_id")).cast("string").alias("seed"))


@query("CUR5 WN3 WN5", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, CAST(doc_id AS VARCHAR)) - 1 AS rank, count(*) OVER () AS n FROM documents),
p AS (SELECT r.*, e.epoch, least(n, CAST(ceil(n * e.f) AS BIGINT)) AS k FROM r, (VALUES (1, 1.0::DOUBLE / 3), (2, 2.0::DOUBLE / 3), (3, 1.0::DOUBLE)) e(epoch, f)),
q AS (SELECT * FROM p WHERE rank < k),
s AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY {_d("'5'", "CAST(epoch AS VARCHAR)", "CAST(doc_id AS VARCHAR)")}, CAST(doc_id AS VARCHAR)) - 1 AS sh FROM q),
t AS (SELECT epoch, doc_id, unnest(range(1, (n // k + (sh < n % k)::INT + 1)::BIGINT)) AS repeat FROM s)
SELECT CAST(epoch AS INTEGER) AS epoch, doc_id, CAST(repeat AS INTEGER) AS repeat,
  row_number() OVER (PARTITION BY epoch ORDER BY {_d("'5'", "'again'", "CAST(epoch AS VARCHAR)", "CAST(doc_id AS VARCHAR)", "CAST(repeat AS VARCHAR)")}, CAST(doc_id AS VARCHAR), repeat) - 1 AS position FROM t""")
def pacing_schedule(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars")
    return R.pacing(x, "n_chars", "doc_id", 5, [1 / 3, 2 / 3, 1.0]).select("epoch", "doc_id", "repeat", F.col("position").cast("bigint").alias("position"))


@query("CUR6", f"""
SELECT CAST(e.epoch AS INTEGER) AS epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY CASE WHEN epoch = 1 THEN n_chars END, CASE WHEN epoch > 1 THEN {_d("'3'", "CAST(epoch AS VARCHAR)", "CAST(doc_id AS VARCHAR)")} END, CAST(doc_id AS VARCHAR)) - 1 AS position
FROM documents, (VALUES (1), (2), (3)) e(epoch)""")
def sorted_first_epoch(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars")
    return R.sorted_first_epoch(x, "n_chars", "doc_id", 3, 3).select("epoch", "doc_id", F.col("position").cast("bigint").alias("position"))


def _state(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("value") * (F.col("event_id") % 7 + 1)).alias("nll"), (F.col("event_id") % 30 + 1).cast("double").alias("duration"), (F.col("event_id") % 11 / 10.0).alias("acoustic"), (F.col("value") % 100).alias("wer"), F.col("event_id").cast("int").alias("dataset_index"))


_STATE = "WITH s AS (SELECT event_id AS id, value * (event_id % 7 + 1) AS nll, CAST(event_id % 30 + 1 AS DOUBLE) AS duration, (event_id % 11) / 10.0::DOUBLE AS acoustic, value % 100 AS wer, CAST(event_id AS INTEGER) AS dataset_index FROM events)"


@query("CUR7 CUR10", _STATE + " SELECT id, round(nll / duration, 6) AS score, row_number() OVER (ORDER BY nll / duration, duration, CAST(id AS VARCHAR), dataset_index) - 1 AS position FROM s")
def epoch_reorder_loss(spark, d):
    return R.loss_order(_state(spark, d)).select("id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


@query("CUR8", _STATE + """, r AS (SELECT *, (rank() OVER (ORDER BY nll / duration) - 1 + (count(*) OVER (PARTITION BY nll / duration) - 1) / 2.0) / (count(*) OVER () - 1) AS p FROM s)
SELECT id, round(0.4 * acoustic + (1.0 - 0.4) * p, 6) AS score FROM r""")
def epoch_reorder_hybrid(spark, d):
    return R.hybrid_order(_state(spark, d), 0.4).select("id", F.round("score", 6).alias("score"))


@query("CUR9 WN9", _STATE + """ SELECT id, round((wer - min(wer) OVER ()) / (max(wer) OVER () - min(wer) OVER ()), 6) AS normalized, row_number() OVER (ORDER BY wer, duration, CAST(id AS VARCHAR), dataset_index) - 1 AS position FROM s""")
def epoch_reorder_error(spark, d):
    return R.error_order(_state(spark, d)).select("id", F.round("normalized", 6).alias("normalized"), F.col("position").cast("bigint").alias("position"))


@query("CUR11", _STATE + ", m AS (SELECT *, CASE WHEN id % 50 = 0 THEN -1.0 ELSE nll END AS bad FROM s WHERE id % 97 <> 0) SELECT CAST(id AS VARCHAR) AS id, 'loss' AS problem FROM m WHERE bad < 0 UNION ALL SELECT CAST(event_id AS VARCHAR), 'missing' FROM events WHERE event_id % 97 = 0")
def sampler_preconditions(spark, d):
    s = _state(spark, d).where("id % 97 <> 0").withColumn("nll", F.when(F.col("id") % 50 == 0, -1.0).otherwise(F.col("nll")))
    return R.state_violations(s, table(spark, d, "events").select(F.col("event_id").alias("id")))


@query("FN24", "SELECT event_type, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value, event_id)) AS digest FROM events GROUP BY event_type")
def ordered_index_digest(spark, d):
    return ordered_digests(table(spark, d, "events"), "event_type", ["value", "event_id"], "event_id")


@query("SEL2", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE list_contains(list_transform(range(0, 40), lambda i: CAST(round_even(i * (n - 1) / 39.0, 0) AS BIGINT)), k)""")
def duration_stratified_sample(spark, d):
    return S.stratified_sample(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 40).select("doc_id")


@query("SEL3 FLT4", """
WITH x AS (SELECT event_id, value, value / 490.0 AS wer FROM events),
s AS (SELECT *, CASE WHEN wer <= .4 THEN 'low' WHEN wer <= .5 THEN 'middle' WHEN wer <= .8 THEN 'high' ELSE 'extreme' END AS stratum FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT event_id, stratum FROM r WHERE list_contains(list_transform(range(0, 5), lambda i: CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT)), k)""")
def error_stratified_sample(spark, d):
    x = table(spark, d, "events").select("event_id", "value", S.error_stratum(F.col("value") / 490.0).alias("stratum"))
    return S.stratified_sample(x, ["value", "event_id"], 5, ("stratum",)).select("event_id", "stratum")


@query("SEL4 FLT9", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_rows(spark, d):
    return S.top_k(table(spark, d, "documents").select("doc_id", "n_chars"), 25, F.desc("n_chars"), "doc_id")


_CAPPED = """WITH RECURSIVE x AS (SELECT doc_id, source, n_chars / 100.0::DOUBLE AS size, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY score, CAST(doc_id AS VARCHAR)) AS k, dense_rank() OVER (ORDER BY source) AS g FROM x WHERE size <= 300),
f AS (
  SELECT 0::BIGINT AS k, 0.0::DOUBLE AS total, list_transform(range(0, (SELECT max(g) FROM o)), lambda i: 0.0::DOUBLE) AS used, list_transform(range(0, (SELECT max(g) FROM o)), lambda i: 0::BIGINT) AS taken, false AS ok
  UNION ALL
  SELECT k, CASE WHEN ok THEN total + size ELSE total END, CASE WHEN ok THEN list_transform(used, lambda v, i: CASE WHEN i = g THEN v + size ELSE v END) ELSE used END, CASE WHEN ok THEN list_transform(taken, lambda v, i: CASE WHEN i = g THEN v + 1 ELSE v END) ELSE taken END, ok
  FROM (SELECT o.k, o.g, o.size, f.total, f.used, f.taken, f.total + o.size <= 4000 AND f.used[o.g] + o.size <= 300 AND f.taken[o.g] < 12 AS ok FROM f JOIN o ON o.k = f.k + 1) z),
c AS (SELECT o.doc_id, o.source, o.size FROM o JOIN f USING (k) WHERE f.ok)
"""


def _scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") / 100.0).alias("size"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("score"))


@query("SEL1", _CAPPED + "SELECT doc_id, source FROM c")
def capped_selection(spark, d):
    return S.capped_selection(_scored(spark, d), "doc_id", "source", "size", "score", 4000.0, 300.0, 12).select("doc_id", "source")


@query("SEL1 AG5", _CAPPED + """, p AS (SELECT source, count(*) AS rows, sum(size) AS size FROM c GROUP BY source)
SELECT source, rows, round(size, 6) AS size FROM p""")
def capped_selection_profile(spark, d):
    x = S.capped_selection(_scored(spark, d), "doc_id", "source", "size", "score", 4000.0, 300.0, 12)
    return x.groupBy("source").agg(F.count("*").alias("rows"), F.round(F.sum("size"), 6).alias("size"))


_SPLIT = """
WITH g AS (SELECT user_id, count(*) AS rows, sum(value) AS hours FROM events GROUP BY user_id),
t AS (SELECT trial, user_id, rows, hours, row_number() OVER (PARTITION BY trial ORDER BY {draw}, CAST(user_id AS VARCHAR)) - 1 AS r FROM g, range(0, 20) x(trial)),
s AS (SELECT *, CASE WHEN r < {h} THEN 'validation' WHEN r < 2 * {h} THEN 'test' ELSE 'train' END AS split FROM t),
p AS (SELECT trial, split, sum(rows) AS r, sum(hours) AS h, max(rows) AS mr, max(hours) AS mh, CASE split WHEN 'train' THEN .8 ELSE .1 END AS q FROM s GROUP BY trial, split),
k AS (SELECT trial, round(sum(pow((r - q * (SELECT sum(rows) FROM g)) / (q * (SELECT sum(rows) FROM g)), 2) + pow((h - q * (SELECT sum(hours) FROM g)) / (q * (SELECT sum(hours) FROM g)), 2)), 12) AS score,
  bool_and(split = 'train' OR (mr <= {m} * r AND mh <= {m} * h)) AND count(*) = 3 AS ok FROM p GROUP BY trial),
b AS (SELECT trial, score FROM k WHERE ok ORDER BY score, trial LIMIT 1)
SELECT s.user_id, s.split, CAST(s.trial AS INTEGER) AS trial FROM s JOIN b USING (trial)"""


@query("SEL7 AG4", _SPLIT.format(draw=_d("'13'", "CAST(trial AS VARCHAR)", "CAST(user_id AS VARCHAR)"), h="(SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM g)", m="1.0"))
def group_split_search(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("value").alias("hours"))
    return S.split_search(g, "user_id", 20, 13, F.rint(F.col("_g") * 0.1)).select("user_id", "split", "trial")


@query("SEL8", _SPLIT.format(draw=_d("'17'", "CAST(trial AS VARCHAR)", "CAST(user_id AS VARCHAR)"), h="24", m="0.2"))
def group_split_search_capped(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("value").alias("hours"))
    return S.split_search(g, "user_id", 20, 17, 24, most_share=0.2).select("user_id", "split", "trial")


@query("SEL9", f"""
WITH b AS (SELECT doc_id, {_d("'salt'", "sha256(text)")} % 10 AS b FROM documents)
SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'validation' ELSE 'test' END AS part FROM b""")
def hash_partition(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", S.hash_partition(F.sha2("text", 256), "salt", {"train": 8, "validation": 1, "test": 1}).alias("part"))


@query("SEL11 SET1 SET2", """
WITH u AS (SELECT doc_id, 'confidence' AS s FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id, 'diagnostic' FROM documents WHERE n_chars % 5 = 0)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM u GROUP BY doc_id""")
def selector_union(spark, d):
    x = table(spark, d, "documents")
    return S.union_of_selectors({"confidence": x.where("n_chars % 3 = 0"), "diagnostic": x.where("n_chars % 5 = 0")}, "doc_id").select("doc_id", F.array_join("shortlist_sources", ",").alias("sources"))


@query("SEL12", """
WITH g AS (SELECT source, count(*) AS rows, sum(n_chars / 3600.0) AS hours FROM documents GROUP BY source)
SELECT source, rows, round(hours, 6) AS hours FROM g WHERE rows > 40 OR hours > 30 + 1e-9""")
def cap_violations(spark, d):
    x = table(spark, d, "documents").select("source", (F.col("n_chars") / 3600.0).alias("hours"))
    return S.cap_violations(x, "source", "hours", 30.0, 40, 5).select("source", "rows", F.round("hours", 6).alias("hours"))


@query("SEL13", """
WITH RECURSIVE g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS k FROM g),
f AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, -1::BIGINT AS fold
  UNION ALL SELECT o.k, list_transform(f.load, lambda v, i: CASE WHEN i = list_position(f.load, list_min(f.load)) THEN v + o.n ELSE v END), list_position(f.load, list_min(f.load)) - 1 FROM f JOIN o ON o.k = f.k + 1)
SELECT o.user_id, CAST(f.fold AS BIGINT) AS fold FROM o JOIN f USING (k)""")
def grouped_folds(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return S.grouped_folds(g, "user_id", 5)


@query("SEL14", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 2 AS lane FROM documents")
def lanes(spark, d):
    x = R.global_position(table(spark, d, "documents").select("doc_id"), "doc_id")
    return x.select("doc_id", S.lane(F.col("position"), 2).cast("bigint").alias("lane"))


@query("SEL15", """
WITH c AS (SELECT event_type, user_id % 3 AS seed, min(event_id) AS run FROM events GROUP BY 1, 2),
o AS (SELECT event_type, 1 AS seed, max(event_id) AS o FROM events GROUP BY 1)
SELECT c.event_type, c.seed, coalesce(o.o, c.run) AS run FROM c LEFT JOIN o ON c.event_type = o.event_type AND c.seed = o.seed""")
def cohort_override(spark, d):
    e = table(spark, d, "events")
    cells = e.groupBy("event_type", (F.col("user_id") % 3).alias("seed")).agg(F.min("event_id").alias("run"))
    over = e.groupBy("event_type").agg(F.max("event_id").alias("run")).withColumn("seed", F.lit(1).cast("bigint"))
    return S.cohort_override(cells, over, ["event_type", "seed"], "run").select("event_type", "seed", "run")


@query("JN8 FLT7", f"""
WITH s AS (SELECT doc_id, n_chars AS len FROM documents),
n AS (SELECT event_id AS candidate, CAST(value * 20 AS BIGINT) AS len FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY len DESC, CAST(candidate AS VARCHAR)) AS rank FROM n),
e AS (SELECT s.doc_id, (SELECT count(*) FROM n WHERE n.len >= s.len) AS eligible FROM s)
SELECT e.doc_id, CAST(e.eligible AS INTEGER) AS eligible, r.candidate FROM e
LEFT JOIN r ON e.eligible > 0 AND r.rank = CAST({_d("'9'", "CAST(e.doc_id AS VARCHAR)")} % greatest(e.eligible, 1) AS INTEGER) + 1""")
def range_candidate_pick(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("len"))
    n = table(spark, d, "events").select(F.col("event_id").alias("candidate_id"), F.round(F.col("value") * 20).cast("bigint").alias("len"))
    return S.pick_candidate(s, n, "doc_id", "candidate_id", "len", 9).select("doc_id", "eligible", "candidate")


@query("UDF5 CUR7", _STATE + """, a AS (SELECT *, nll / duration AS score FROM s), b AS (SELECT *, (nll / 2 + duration) / duration AS score2 FROM s)
SELECT 1 AS epoch, id, row_number() OVER (ORDER BY score, duration, CAST(id AS VARCHAR), dataset_index) - 1 AS position FROM a
UNION ALL SELECT 2, id, row_number() OVER (ORDER BY score2, duration, CAST(id AS VARCHAR), dataset_index) - 1 FROM b""")
def trainer_hooks(spark, d):
    orders = R.epochs(_state(spark, d), lambda s, i: R.loss_order(s), lambda s, i: s.withColumn("nll", F.col("nll") / 2 + F.col("duration")), 2)
    return orders[0].unionByName(orders[1]).select("epoch", "id", F.col("position").cast("bigint").alias("position"))
