"""Traces (orders), their observations (lines) and posts (events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators import ranking, tables
from sedge.plans.registry import query, table

_TRACES = """t AS (SELECT o_orderkey AS id, o_custkey % 4 AS tenant, o_custkey AS session, o_orderstatus AS status, o_orderdate AS started, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey % 97) * 60000 END AS ms FROM orders),
 o AS (SELECT l_orderkey AS trace, l_linenumber AS n, CASE l_linenumber % 3 WHEN 1 THEN 'GENERATION' WHEN 2 THEN 'SPAN' ELSE 'EVENT' END AS type, CAST(l_quantity AS BIGINT) AS tokens, l_shipdate AS started FROM lineitem)"""


def _traces(spark, d) -> DataFrame:
    ms = F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey") % 97 * 60000)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("tenant"), F.col("o_custkey").alias("session"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started"), ms.alias("ms"))


def _observations(spark, d) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 1, "GENERATION").when(n % 3 == 2, "SPAN").otherwise("EVENT")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace"), n.alias("n"), kind.alias("type"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_shipdate").alias("started"))


@query(f"""WITH {_TRACES}, k AS (SELECT trace AS id, sum(tokens) AS tokens FROM o WHERE type = 'GENERATION' GROUP BY 1)
 SELECT tenant, count(*) AS n, round(avg(CAST(status = 'F' AS INT)), 6) AS success, round(avg(ms), 3) AS mean_ms, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, round(coalesce(sum(tokens), 0) / count(*), 6) AS tokens_per_trace FROM t LEFT JOIN k USING (id) GROUP BY tenant""")
def g1_trace_summary(spark, d):
    k = _observations(spark, d).where("type = 'GENERATION'").groupBy(F.col("trace").alias("id")).agg(F.sum("tokens").alias("tokens"))
    used = F.coalesce(F.sum("tokens"), F.lit(0))
    return _traces(spark, d).join(k, "id", "left").groupBy("tenant").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("status") == "F").cast("int")), 6).alias("success"), F.round(F.avg("ms"), 3).alias("mean_ms"), used.alias("tokens"), F.round(used / F.count("*"), 6).alias("tokens_per_trace"))


_NEWEST = "n AS (SELECT * FROM t WHERE tenant = 1 ORDER BY started DESC, id LIMIT 200)"


def _newest(spark, d) -> DataFrame:
    return _traces(spark, d).where("tenant = 1").orderBy(F.desc("started"), "id").limit(200)


@query(f"WITH {_TRACES}, {_NEWEST} SELECT id, session, status, started FROM n")
def s18_trace_list(spark, d):
    return _newest(spark, d).select("id", "session", "status", "started")


@query(f"WITH {_TRACES}, {_NEWEST} SELECT count(*) AS n, round(avg(CAST(status = 'F' AS INT)), 6) AS success, round(avg(ms), 3) AS mean_ms, CAST(0 AS BIGINT) AS tokens FROM n")
def g2_newest_trace_stats(spark, d):
    return _newest(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "F").cast("int")), 6).alias("success"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.lit(0).cast("long").alias("tokens"))


@query(f"""WITH {_TRACES} SELECT t.id, any_value(status) AS status, count(n) AS children, string_agg(n || ':' || type, ',' ORDER BY o.started, n) AS listed FROM t LEFT JOIN o ON t.id = o.trace GROUP BY t.id""")
def s19_trace_detail(spark, d):
    o = _observations(spark, d).groupBy(F.col("trace").alias("id")).agg(F.count("*").alias("children"), F.array_sort(F.collect_list(F.struct("started", "n", "type"))).alias("c"))
    listed = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["n"].cast("string"), x["type"])), ",")
    return _traces(spark, d).join(o, "id", "left").select("id", "status", F.coalesce("children", F.lit(0)).alias("children"), F.when(F.col("children") > 0, listed).alias("listed"))


@query(f"""WITH {_TRACES} SELECT trace, n, type FROM o WHERE NOT (trace % 4 = 0 AND n <= 2) UNION ALL SELECT DISTINCT trace, n, 'UPDATED' FROM o WHERE trace % 4 = 0 AND n <= 2 UNION ALL SELECT id, 100, 'NEW' FROM t WHERE id % 4 = 0""")
def k14_trace_upsert(spark, d):
    """Children come as JSON in their trace's row; those of known keys are replaced, others added."""
    listed = F.lit('[{"n":1,"type":"UPDATED"},{"n":2,"type":"UPDATED"},{"n":100,"type":"NEW"}]')
    child = F.explode(F.from_json(listed, "array<struct<n:int,type:string>>")).alias("c")
    stored = _observations(spark, d).select("trace", "n", "type")
    incoming = _traces(spark, d).where("id % 4 = 0").select(F.col("id").alias("trace"), child).select("trace", "c.n", "c.type")
    there = incoming.where("n < 100").join(stored.select("trace", "n"), ["trace", "n"], "left_semi").unionByName(incoming.where("n = 100"))
    return tables.upsert(stored, there, ["trace", "n"])


@query(f"WITH {_TRACES} SELECT trace, n, tokens AS value FROM o WHERE trace IN (SELECT id FROM t WHERE tenant = 2)")
def k15_guarded_scores(spark, d):
    owned = _traces(spark, d).where("tenant = 2").select(F.col("id").alias("trace"))
    return _observations(spark, d).join(owned, "trace", "left_semi").select("trace", "n", F.col("tokens").alias("value"))


@query(f"WITH {_TRACES} SELECT id, tenant FROM t WHERE tenant <> 3")
def k16_tenant_clear(spark, d):
    return _traces(spark, d).where(~F.col("tenant").eqNullSafe(3)).select("id", "tenant")


@query(f"""WITH {_TRACES}, k AS (SELECT id FROM t WHERE status <> 'F'), c AS (SELECT o.trace, n FROM o JOIN k ON id = trace)
 SELECT trace, n, CASE WHEN n > 2 THEN NULL ELSE n END AS link FROM c""")
def k28_cascading_delete(spark, d):
    """Traces of status F go and their observations with them; links to observations after the second, which go alone, become null."""
    stay = tables.without(_traces(spark, d), _traces(spark, d).where("status = 'F'"), ["id"]).select(F.col("id").alias("trace"))
    rows = _observations(spark, d).join(stay, "trace", "left_semi").select("trace", "n")
    return rows.withColumn("link", F.when(F.col("n") <= 2, F.col("n")))


@query(f"WITH {_TRACES} SELECT id, CASE WHEN session = 7 THEN 'session' WHEN tenant = 0 THEN 'tenant' ELSE 'id' END AS why FROM t WHERE session = 7 OR tenant = 0 OR id = 33")
def p18_trace_filters(spark, d):
    why = F.when(F.col("session") == 7, "session").when(F.col("tenant") == 0, "tenant").otherwise("id")
    return _traces(spark, d).where("session = 7 OR tenant = 0 OR id = 33").select("id", why.alias("why"))


@query(f"""WITH {_TRACES}, c AS (SELECT trace, string_agg('{{"n":' || n || ',"tokens":' || tokens || '}}', ',' ORDER BY n, tokens) AS c FROM o GROUP BY 1)
 SELECT id, '{{"id":' || id || ',"children":[' || c || ']}}' AS record FROM t JOIN c ON id = trace""")
def k26_trace_export(spark, d):
    c = _observations(spark, d).groupBy(F.col("trace").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("children"))
    return _traces(spark, d).join(c, "id").select("id", F.to_json(F.struct("id", "children")).alias("record"))


@query(f"WITH {_TRACES} SELECT session, status, count(*) AS n, CAST(coalesce(sum(ms), 0) AS BIGINT) AS ms FROM t GROUP BY ALL")
def c10_step_statistics(spark, d):
    return _traces(spark, d).groupBy("session", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"))


@query(f"WITH {_TRACES}, k AS (SELECT trace AS id, sum(tokens) AS tokens FROM o WHERE type = 'GENERATION' GROUP BY 1) SELECT id, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, ms FROM t LEFT JOIN k USING (id)")
def c12_trace_tokens(spark, d):
    k = _observations(spark, d).where("type = 'GENERATION'").groupBy(F.col("trace").alias("id")).agg(F.sum("tokens").alias("tokens"))
    return _traces(spark, d).join(k, "id", "left").select("id", F.coalesce("tokens", F.lit(0)).alias("tokens"), "ms")


# posts: events, a round a day; topics: the type and a band of the value

_POSTS = """p AS (SELECT event_id, CAST(ts AS DATE) AS round, ts, user_id, event_type AS action, value, CASE WHEN value > 60 THEN 1 WHEN value < 40 THEN -1 ELSE 0 END AS mood, [event_type, 'band' || CAST(floor(value / 20) AS BIGINT)] AS topics FROM events)"""


def _posts(spark, d) -> DataFrame:
    mood = F.when(F.col("value") > 60, 1).when(F.col("value") < 40, -1).otherwise(0)
    topics = F.array("event_type", F.concat(F.lit("band"), F.floor(F.col("value") / 20).cast("string")))
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("round"), "ts", "user_id", F.col("event_type").alias("action"), "value", mood.alias("mood"), topics.alias("topics"))


@query(f"WITH {_POSTS}, n AS (SELECT round, t AS topic, count(*) AS n FROM (SELECT round, unnest(topics) AS t FROM p) GROUP BY ALL) SELECT round, topic, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY n DESC, topic) AS rank FROM n) WHERE rank <= 5")
def g5_round_topics(spark, d):
    n = _posts(spark, d).select("round", F.explode("topics").alias("topic")).groupBy("round", "topic").agg(F.count("*").alias("n"))
    return ranking.top(n, ["round"], "n", "topic", 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_POSTS}, a AS (SELECT round, user_id, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT round, user_id, event_id, row_number() OVER (PARTITION BY round ORDER BY ts DESC, event_id DESC) AS k FROM p)
 SELECT round, (SELECT count(*) FROM p q WHERE q.round = p.round) AS posts, round(avg(mood), 6) AS mood, max((SELECT string_agg(event_id, ',' ORDER BY k) FROM r WHERE r.round = p.round AND k <= 3)) AS recent, max((SELECT max(n) FROM a WHERE a.round = p.round)) AS busiest FROM p GROUP BY round""")
def g6_round_context(spark, d):
    """Counts and mood of a round, its last three posts, and the most that one author wrote. Only three posts a round are kept in a group."""
    p = _posts(spark, d)
    w = Window.partitionBy("round").orderBy(F.desc("ts"), F.desc("event_id"))
    last = p.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("round").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("recent"))
    busy = p.groupBy("round", "user_id").agg(F.count("*").alias("n")).groupBy("round").agg(F.max("n").alias("busiest"))
    return p.groupBy("round").agg(F.count("*").alias("posts"), F.round(F.avg("mood"), 6).alias("mood")).join(last, "round").join(busy, "round")


@query(f"WITH {_POSTS} SELECT round, count(*) AS total, count(*) FILTER (mood = 1) AS positive, count(*) FILTER (mood = -1) AS negative, count(*) FILTER (mood = 0) AS neutral, count(DISTINCT user_id) AS authors FROM p GROUP BY round")
def g7_timeline(spark, d):
    m = F.col("mood")
    return _posts(spark, d).groupBy("round").agg(F.count("*").alias("total"), F.count_if(m == 1).alias("positive"), F.count_if(m == -1).alias("negative"), F.count_if(m == 0).alias("neutral"), F.countDistinct("user_id").alias("authors"))


@query(f"""WITH {_POSTS}, m AS (SELECT user_id, mood, count(*) AS n FROM p GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS posts, arg_max(mood, n * 10 + mood) AS dominant, round(100.0 * sum(n) / (SELECT count(*) FROM p), 4) AS percent FROM m GROUP BY user_id""")
def g9_report_context(spark, d):
    """Posts of each author, their most frequent mood (the higher of equals) and their share of all."""
    m = _posts(spark, d).groupBy("user_id", "mood").agg(F.count("*").alias("n"))
    a = m.groupBy("user_id").agg(F.sum("n").alias("posts"), F.max_by("mood", F.struct("n", "mood")).alias("dominant"))
    whole = table(spark, d, "events").agg(F.count("*").alias("all")).withColumn("one", F.lit(1))
    return a.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select("user_id", "posts", "dominant", F.round(100 * F.col("posts") / F.col("all"), 4).alias("percent"))


@query(f"""WITH {_POSTS}, u AS (SELECT unnest(range(0, (SELECT max(user_id) + 3 FROM events))) AS user_id), s AS (SELECT user_id, count(*) FILTER (action = 'click') AS clicks, count(*) FILTER (action = 'purchase') AS purchases, count(*) FILTER (action NOT IN ('click', 'purchase')) AS others, round(avg(mood), 6) AS mood FROM p GROUP BY 1),
 t AS (SELECT user_id, t, count(*) AS n FROM (SELECT user_id, unnest(topics) AS t FROM p) GROUP BY ALL), k AS (SELECT user_id, string_agg(t, ',' ORDER BY n DESC, t) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t) AS r FROM t) WHERE r <= 5 GROUP BY 1)
 SELECT user_id, coalesce(clicks, 0) AS clicks, coalesce(purchases, 0) AS purchases, coalesce(others, 0) AS others, coalesce(mood, 0) AS mood, coalesce(top, '') AS top FROM u LEFT JOIN s USING (user_id) LEFT JOIN k USING (user_id)""")
def g3_agent_table(spark, d):
    """Every agent, those without posts with zeros; the five topics of each with their ties by name."""
    p = _posts(spark, d)
    top_id = p.agg(F.max("user_id")).first()[0] or 0
    every = spark.range(top_id + 3).select(F.col("id").alias("user_id"))
    e = F.col("action")
    s = p.groupBy("user_id").agg(F.count_if(e == "click").alias("clicks"), F.count_if(e == "purchase").alias("purchases"), F.count_if(~e.isin("click", "purchase")).alias("others"), F.round(F.avg("mood"), 6).alias("mood"))
    n = p.select("user_id", F.explode("topics").alias("t")).groupBy("user_id", "t").agg(F.count("*").alias("n"))
    k = ranking.top(n, ["user_id"], "n", "t", 5).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), ",").alias("top"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("clicks", "purchases", "others")} | {"mood": F.coalesce("mood", F.lit(0.0)), "top": F.coalesce("top", F.lit(""))}
    return every.join(s, "user_id", "left").join(k, "user_id", "left").withColumns(zero)


@query(f"WITH {_POSTS} SELECT a.event_id, b.event_id AS target, b.user_id AS target_author FROM p a JOIN p b ON b.event_id = a.event_id - 3 AND a.round = b.round")
def j12_reply_targets(spark, d):
    """A post's target, three ids before it, if it is of the same round."""
    p = _posts(spark, d)
    b = p.select((F.col("event_id") + 3).alias("event_id"), "round", F.col("event_id").alias("target"), F.col("user_id").alias("target_author"))
    return p.select("event_id", "round").join(b, ["event_id", "round"]).select("event_id", "target", "target_author")


@query(f"WITH {_POSTS} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM p WHERE action = 'click') WHERE k <= 3")
def o15_p17_recent_posts(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _posts(spark, d).where("action = 'click'").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id")


@query(f"WITH {_POSTS} SELECT action, round(sum(value), 2) AS likes, count(DISTINCT user_id) AS authors, string_agg(DISTINCT CAST(round AS VARCHAR), ',' ORDER BY CAST(round AS VARCHAR)) AS rounds FROM p GROUP BY action")
def c8_post_totals(spark, d):
    rounds = F.array_join(F.sort_array(F.collect_set(F.col("round").cast("string"))), ",")
    return _posts(spark, d).groupBy("action").agg(F.round(F.sum("value"), 2).alias("likes"), F.countDistinct("user_id").alias("authors"), rounds.alias("rounds"))


@query("""WITH n AS (SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1) SELECT category, n, round(100.0 * n / sum(n) OVER (), 1) AS percent FROM n QUALIFY round(100.0 * n / sum(n) OVER (), 1) > 1""")
def c11_category_distribution(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("all")).withColumn("one", F.lit(1))
    share = n.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select("category", "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("percent"))
    return share.where("percent > 1").orderBy(F.desc("percent"), "category")


# conversations

_COST = "CAST(ceil(length(text) / 4.0) AS BIGINT)"


@query(f"""WITH s AS (SELECT conv_id, turn, role, text, sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations), k AS (SELECT * FROM s WHERE used <= 300),
 f AS (SELECT conv_id, min(turn) AS first FROM k WHERE role = 'user' GROUP BY 1) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM k JOIN f USING (conv_id) WHERE turn >= first""")
def w9_suffix_from_user_turn(spark, d):
    """The longest end of a conversation within the budget, less what stands before its first user turn."""
    from sedge.operators import sequences

    c = table(spark, d, "conversations")
    k = sequences.prefix_within(c, ["conv_id"], [F.desc("turn"), F.desc("text")], F.ceil(F.length("text") / 4), 300)
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return k.withColumn("first", first).where("turn >= first").select("conv_id", "turn", "used")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, n >= 6 AND back > 4 AS summarised FROM o""")
def w10_summary_split(spark, d):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", ((n >= 6) & (back > 4)).alias("summarised"))


@query(f"SELECT conv_id, count(*) AS messages, CAST(sum({_COST}) AS BIGINT) AS tokens, round(avg({_COST}), 6) AS mean, sum({_COST}) > 400 AS over FROM conversations GROUP BY conv_id")
def g33_session_token_stats(spark, d):
    cost = F.ceil(F.length("text") / 4)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(cost).alias("tokens"), F.round(F.avg(cost), 6).alias("mean"), (F.sum(cost) > 400).alias("over"))


@query("""WITH i AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, 'edited', text FROM conversations WHERE turn % 5 = 0 UNION ALL SELECT conv_id, turn + 1000, role, text FROM conversations WHERE turn = 1)
 SELECT conv_id, turn, arg_max(role, CAST(role = 'edited' AS INT)) AS role FROM i GROUP BY conv_id, turn""")
def c7_utterance_merge(spark, d):
    """Incoming utterances win over stored ones of their id, new ones are added. A conversation's turn is an utterance's id."""
    stored = tables.latest(table(spark, d, "conversations"), ["conv_id", "turn"], F.col("role")).select("conv_id", "turn", "role")
    incoming = stored.where("turn % 5 = 0").withColumn("role", F.lit("edited")).unionByName(stored.where("turn = 1").withColumn("turn", F.col("turn") + 1000))
    return tables.upsert(stored, incoming, ["conv_id", "turn"])


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def s27_latest_messages(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", F.struct("turn", "role")).alias("role"))
