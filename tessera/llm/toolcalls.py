"""Chat formatting: tool calls linked to their results (native: DataFrame functions only).

Calls and results meet in a hash join by identifier, after rows equal in all columns have been folded. Calls may
name calls they come after; the level of a call is the longest way to it. Chains are walked by doubling, calls after
several others wait for them round by round, and what is never reached lies on or below a cycle. Arguments are validated against a schema by tool name and written as canonical JSON: keys in
order at every depth, no white space.

Defined results: equal repeats of a call or result are one; of different calls (or results) with one
identifier the first by sequence and content is linked, the others are rows of their own, and all these rows say
``ambiguous``; a call without result and a result without call are rows too (``unanswered``, ``orphan``);
identifiers named but absent do not hold a call back; null identifiers are never linked and give unanswered or
orphan rows each; a turn without a role is a result that is never linked; a call on a cycle has no level and
comes last. An empty table gives no rows. Columns of plain chats other than conv_id, turn, role and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, read

#: name -> argument -> (type, required); a type is the head of what schema_of_variant says.
CHAT_SCHEMAS = {
    "reply": {"text": ("STRING", True), "turn": ("BIGINT", True)},
    "configure": {"text": ("STRING", True), "turn": ("BIGINT", True)},
}
TURN_RANGE = 1024


def violations(name, args, schemas: dict):
    """What is wrong with arguments (a variant) under the schema of a tool name: an array of strings."""
    out = F.when(args.isNull(), F.array(F.lit("not an object"))).when(~F.startswith(F.schema_of_variant(args), F.lit("OBJECT")), F.array(F.lit("not an object")))
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(args, f"$.{field}", "variant")
            is_null = value.isNull() | F.is_variant_null(value)
            wrong = ~F.startswith(F.schema_of_variant(value), F.lit(kind))
            found.append(F.when(is_null, F.lit(f"missing {field}") if required else None).when(wrong, F.lit(f"type of {field}")))
        out = out.when(name == tool, F.array_compact(F.array(*found)))
    return out.otherwise(F.array(F.lit("unknown tool")))


def _chains(single: DataFrame) -> DataFrame:
    """``single``: call_id, up: the one call it comes after. call_id, root (the first call up the chain that has no such
    row) and dist (calls between, itself included); no row if the chain never ends, which is a cycle.

    Each round doubles what is walked, so a chain of n calls takes log2(n) rounds."""
    own = single.select(F.col("call_id").alias("up"), F.lit(True).alias("more"))
    at = single.join(own, "up", "left").select("call_id", F.col("up").alias("root"), F.lit(1).cast("bigint").alias("dist"), F.coalesce("more", F.lit(False)).alias("more"))
    at = materialize(at, "chains")
    for _ in range(at.count().bit_length()):
        if at.where("more").isEmpty():
            break
        on = at.select(F.col("call_id").alias("root"), F.col("root").alias("root2"), F.col("dist").alias("dist2"), F.col("more").alias("more2"))
        far = at.where("more").join(on, "root").select("call_id", F.col("root2").alias("root"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("more2").alias("more"))
        at, old = materialize(at.where("not more").union(far), "chains"), at
        discard(old)
    return at.where("not more").drop("more")


def levels(calls: DataFrame) -> DataFrame:
    """``calls``: call_id, after. call_id and level of the calls that come after another one; null on or below a cycle.

    Calls after one other call form chains, which are walked by doubling. What is left are calls after several others;
    they wait for all of these and take a round for each such call on the longest way."""
    named = calls.select("call_id", F.explode("after").alias("parent")).where("call_id is not null and parent is not null").distinct()
    edges = materialize(named.join(calls.select(F.col("call_id").alias("parent")).distinct(), "parent", "left_semi"), "after")
    ways = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("parent").alias("up"))
    ways = materialize(ways, "ways")
    chains = _chains(ways.where("n = 1"))
    after = edges.select("call_id").distinct()
    several = ways.where("n > 1").select("call_id")
    # level 0 stands at the end of every chain that does not end at a call after several others
    start = chains.select(F.col("root").alias("call_id")).distinct().join(several, "call_id", "left_anti").select("call_id", F.lit(0).cast("bigint").alias("level"))
    known = start
    if not several.isEmpty():
        to = chains.select(F.col("call_id").alias("parent"), "root", "dist")
        wait = edges.join(several, "call_id", "left_semi").join(to, "parent", "left")
        lost = ways.where("n = 1").select(F.col("call_id").alias("parent")).join(chains.select(F.col("call_id").alias("parent")), "parent", "left_anti").withColumn("lost", F.lit(True))
        wait = wait.join(lost, "parent", "left").where("lost is null").select("call_id", F.coalesce("root", "parent").alias("root"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
        blocked = edges.join(several, "call_id", "left_semi").join(lost, "parent").select("call_id").distinct()
        left = materialize(wait.join(blocked, "call_id", "left_anti"), "waiting")
        # ends of chains, and parents that come after nothing, are known at first
        first = left.select(F.col("root").alias("call_id")).distinct().join(several, "call_id", "left_anti").select("call_id", F.lit(0).cast("bigint").alias("level"))
        known = materialize(start.union(first).distinct(), "known")
        fresh, best = known, None
        while True:
            come = materialize(left.join(fresh.select(F.col("call_id").alias("root"), "level"), "root", "left"), "waiting")
            got = come.where("level is not null").groupBy("call_id").agg(F.max(F.col("level") + F.col("dist")).alias("best"))
            best = got if best is None else best.union(got).groupBy("call_id").agg(F.max("best").alias("best"))
            best = materialize(best, "best")
            left = materialize(come.where("level is null").select("call_id", "root", "dist"), "waiting")
            fresh = materialize(best.join(left.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.col("best").alias("level")), "fresh")
            if fresh.isEmpty():
                break
            known = known.union(fresh)
            best = best.join(fresh.select("call_id"), "call_id", "left_anti")
    known = known.groupBy("call_id").agg(F.max("level").alias("at"))
    chained = chains.join(known.withColumnRenamed("call_id", "root"), "root", "left").select("call_id", (F.col("at") + F.col("dist")).alias("level"))
    found = chained.union(known.join(several, "call_id", "left_semi").select("call_id", F.col("at").alias("level")))
    found = after.join(materialize(found, "levels"), "call_id", "left")
    return found.select("call_id", F.col("level").cast("int").alias("level"))


def numbered(d: DataFrame, *content: str) -> tuple[DataFrame, DataFrame]:
    """Different rows with an identifier, numbered (k) and counted (n) in it, and those without one."""
    w = Window.partitionBy("call_id")
    d = d.distinct()
    some = d.where("call_id is not null").withColumn("k", F.row_number().over(w.orderBy(*content))).withColumn("n", F.count("*").over(w))
    return some, d.where("call_id is null").withColumn("k", F.lit(1)).withColumn("n", F.lit(1).cast("bigint"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """``calls``: call_id, conv_id, seq, name, arguments (JSON text), after (array of ids); ``results``: call_id, conv_id, seq,
    output. Rows that differ in a further column are different."""
    packed = lambda d, name, key: d.select("call_id", key.alias("_k"), F.struct(*d.columns).alias(name))
    first = F.when(F.col("k") == 1, 1).otherwise(-F.col("k"))  # other results meet no call
    c, lone_c = (packed(d, "c", F.col("k")) for d in numbered(calls, "seq", "name", "arguments", "conv_id", "after"))
    r, lone_r = (packed(d, "r", first) for d in numbered(results, *["seq", "output", "conv_id"], *(x for x in results.columns if x not in ("call_id", "seq", "output", "conv_id"))))
    deep = levels(calls.select("call_id", "after")).withColumn("_deep", F.lit(True))
    j = c.join(r.hint("shuffle_hash"), ["call_id", "_k"], "full").join(deep, "call_id", "left")
    # rows without an identifier stay out of the joins, where they would all meet in one task
    lone = lone_c.unionByName(lone_r, allowMissingColumns=True)
    j = j.unionByName(lone, allowMissingColumns=True)
    linked = j.select(
        "call_id", F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.col("c.name").alias("name"), F.col("c.seq").alias("call_seq"), F.col("r.seq").alias("result_seq"),
        F.when((F.col("c.n") > 1) | (F.col("r.n") > 1), "ambiguous").when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.col("c").isNotNull().alias("_call"), F.try_parse_json("c.arguments").alias("_args"), F.col("r.output").alias("_output"), "_deep", "level",
    )
    level = F.when(F.col("_call"), F.when(F.col("_deep").isNull(), 0).otherwise(F.col("level")))
    out = linked.withColumn("level", level).withColumn("errors", F.when(F.col("_call"), violations(F.col("name"), F.col("_args"), schemas)).otherwise(F.array().cast("array<string>")))
    text = lambda x: F.to_json(F.to_variant_object(F.struct(x.alias("v"))))
    quoted = lambda x: F.coalesce(F.substr(text(x), F.lit(6), F.length(text(x)) - 6), F.lit("null"))
    canonical = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("_args"), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("_output")), F.lit("}"),
    )
    return out.select("conv_id", "call_id", "name", "call_seq", "result_seq", "status", "level", "errors", (F.col("_call") & (F.size("errors") == 0)).alias("valid"), canonical.alias("canonical"))


def order(linked: DataFrame) -> DataFrame:
    """Adds position, from 0: by level (none last), then sequence, within a conversation.

    Ranges of sequence numbers are counted first, so a conversation of any length is never sorted in one task. Rows
    without a conversation may be any share of the table, so they are also counted by hash of their content.
    """
    seq = F.coalesce("call_seq", "result_seq")
    none = F.col("conv_id").isNull()
    d = linked.withColumn("_s", seq).withColumn("_l", F.coalesce("level", F.lit(2147483647)))
    d = d.withColumn("_b", F.when(none, F.col("_s")).otherwise(F.floor(F.col("_s") / TURN_RANGE)))
    d = d.withColumn("_h", F.when(none, F.pmod(F.xxhash64("canonical"), F.lit(TURN_RANGE))).otherwise(0))
    d = materialize(d, "linked")
    counts = d.groupBy("conv_id", "_l", "_b", "_h").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("conv_id").orderBy("_l", "_b", "_h").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(counts.select(F.col("conv_id").alias("_c"), F.col("_l").alias("_l2"), F.col("_b").alias("_b2"), F.col("_h").alias("_h2"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")), "before")
    inner = F.row_number().over(Window.partitionBy("conv_id", "_l", "_b", "_h").orderBy("_s", "call_id", "status", "canonical"))
    d = d.withColumn("_i", inner)
    same = d["conv_id"].eqNullSafe(before["_c"]) & (d["_l"] == before["_l2"]) & d["_b"].eqNullSafe(before["_b2"]) & (d["_h"] == before["_h2"])
    return d.join(before, same).select(*linked.columns, (F.col("_before") + F.col("_i") - 1).alias("position"))


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chats as calls and results: a user turn calls ``reply``, a system turn ``configure``; an assistant
    turn is the result of the call at the turn before. A call comes after the call at the turn before it."""
    c = conversations.select("conv_id", "turn", "role", "text")
    ident = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    args = F.to_json(F.struct("text", "turn"))
    calls = c.where("role in ('user', 'system')").select(
        F.when(whole, ident(F.col("turn"))).alias("call_id"), "conv_id", F.col("turn").alias("seq"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        args.alias("arguments"), F.array(F.when(whole, ident(F.col("turn") - 1))).alias("after"),
    )
    answer = c.where("role is null or role not in ('user', 'system')")
    results = answer.select(F.when(whole & F.col("role").isNotNull(), ident(F.col("turn") - 1)).alias("call_id"), "conv_id", F.col("turn").alias("seq"), F.col("text").alias("output"), "role")
    return calls, results


def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_calls(read(spark, sf_dir, "conversations"))
    out = order(link(calls, results, CHAT_SCHEMAS))
    return out.select("conv_id", "call_id", "name", F.col("call_seq").alias("call_turn"), F.col("result_seq").alias("result_turn"), "status", "level", "position", "valid", "canonical")


ORACLE = """
WITH m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name FROM m WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn, text FROM m WHERE role NOT IN ('user', 'system')),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1) AS id_turn, c.name,
    c.turn AS call_turn, r.turn AS result_turn, c.text AS ctext, r.text AS rtext,
    CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1),
ch AS (  -- runs of calls at consecutive turns: each comes after the one before
  SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
lv AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS INTEGER) AS level FROM ch),
k AS (SELECT j.*, lv.level, CAST(j.conv_id AS VARCHAR) || ':' || CAST(id_turn AS VARCHAR) AS call_id FROM j LEFT JOIN lv ON j.conv_id = lv.conv_id AND j.call_turn = lv.turn)
SELECT conv_id, call_id, name, call_turn, result_turn, status, level,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 2147483647), coalesce(call_turn, result_turn), call_id, status) - 1 AS position,
  call_turn IS NOT NULL AND ctext IS NOT NULL AS valid,
  '{"arguments":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '{' || CASE WHEN ctext IS NULL THEN '' ELSE '"text":' || CAST(to_json(ctext) AS VARCHAR) || ',' END || '"turn":' || CAST(call_turn AS VARCHAR) || '}' END
  || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null')
  || ',"result":' || coalesce(CAST(to_json(rtext) AS VARCHAR), 'null') || '}' AS canonical
FROM k
"""
