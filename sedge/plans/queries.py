"""The library's operators over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions import vectors as V
from sedge.operators import aggregates, evaluation, graph, ranking, sequences, tables
from sedge.plans.registry import ORACLES, QUERIES, dealt, query, table  # noqa: F401
from sedge.sources import files, pages
from sedge.streaming import keyed
from sedge.streaming import totals as streams
from sedge.streaming.shared import kept

# predicates and projections


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0")
def p1_scope_predicate(spark, d):
    c = table(spark, d, "customer")
    return tables.scoped(c, F.col("c_nationkey"), 3, F.col("c_acctbal") >= 0, True, F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT item_id, CASE WHEN regexp_matches(lower(text), '[0-9]{3,}') THEN 'identifier' WHEN regexp_matches(lower(text), '\\ball\\b|\\bover\\b') THEN 'global'
 WHEN regexp_matches(lower(text), '\\bwhich\\b|\\bwith\\b') THEN 'multi_hop' ELSE 'semantic' END AS kind FROM benchmark""")
def p25_query_type(spark, d):
    t = F.lower("text")
    kind = F.when(t.rlike("[0-9]{3,}"), "identifier").when(t.rlike(r"\ball\b|\bover\b"), "global").when(t.rlike(r"\bwhich\b|\bwith\b"), "multi_hop").otherwise("semantic")
    return table(spark, d, "benchmark").select("item_id", kind.alias("kind"))


# text functions


@query("""SELECT doc_id, CAST(ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4.0) AS BIGINT) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS mixed,
 CAST(ceil(length(text) / 4.0) AS BIGINT) AS chat, CAST(greatest(1, ceil(length(trim(text, ' ')) / 400.0)) AS BIGINT) AS minutes,
 length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, strlen(text) AS bytes FROM documents""")
def f15_token_estimates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.tokens_mixed(t).alias("mixed"), T.tokens_chat(t).alias("chat"), T.reading_minutes(t).cast("long").alias("minutes"),
        F.length(t).cast("long").alias("chars"), (T.length_without(t, "[^\n]") + 1).cast("long").alias("lines"), F.octet_length(t).cast("long").alias("bytes"))


@query("""WITH k AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil((length(text) - 800) / 700.0) AS BIGINT) + 1 END)) AS idx FROM documents)
 SELECT doc_id, idx, idx * 700 AS start, sha256(substr(text, idx * 700 + 1, 800)) AS digest,
 count(*) OVER (PARTITION BY doc_id) AS total FROM k""")
def f5_fixed_windows(spark, d):
    cut = table(spark, d, "documents").select("doc_id", T.fixed_windows(F.col("text"), 800, 100).alias("w"))
    return cut.select("doc_id", F.size("w").cast("long").alias("total"), F.posexplode("w").alias("idx", "c")).select(
        "doc_id", F.col("idx").cast("long").alias("idx"), F.col("c.start").cast("long").alias("start"), F.sha2("c.content", 256).alias("digest"), "total")


@query("""SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE substr(text, 1, 300) || '...' || substr(text, CAST(floor((length(text) - 300) / 2) AS BIGINT) + 1, 300) || '...' || right(text, 300) END AS sample FROM documents""")
def o20_three_slices(spark, d):
    return table(spark, d, "documents").select("doc_id", T.three_slices(F.col("text"), 900).alias("sample"))


@query("""SELECT tok AS token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_一-龥]+'), lambda t: t <> '')) AS tok FROM documents) GROUP BY tok""")
def g23_document_frequency(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(T.lexical_tokens(F.col("text"))).alias("token"))
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("tf")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL),
 p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY doc_id""")
def f44_character_entropy(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c != ''").groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    whole = n.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return whole.select("doc_id", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("bits"))


# vectors

_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))"


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT vec_id, unnest(v) AS x FROM v),
 m AS (SELECT vec_id, avg(x) AS mean, var_pop(x) AS var, sum(abs(x)) AS l1, sqrt(sum(x * x)) AS l2, avg(CAST(abs(x) < 0.01 AS INT)) AS sparsity FROM e GROUP BY vec_id)
 SELECT vec_id, round(any_value(mean), 6) AS mean, round(any_value(var), 6) AS variance, round(any_value(sqrt(var)), 6) AS std,
 round(avg((x - mean) ** 3) / any_value(var) ** 1.5, 6) AS skewness, round(avg((x - mean) ** 4) / any_value(var) ** 2 - 3, 6) AS kurtosis,
 round(-sum(CASE WHEN x = 0 THEN 0 ELSE abs(x) / l1 * log2(abs(x) / l1) END), 6) AS entropy, round(any_value(sparsity), 6) AS sparsity,
 round(any_value(l1), 6) AS l1, round(any_value(l2), 6) AS l2 FROM e JOIN m USING (vec_id) GROUP BY vec_id""")
def v6_vector_statistics(spark, d):
    s = V.statistics(V.doubles("embedding"))
    return table(spark, d, "embeddings").select("vec_id", *(F.round(c, 6).alias(k) for k, c in s.items()))


@query(f"SELECT vec_id, round(list_sum(list_transform({_UNIT}, lambda x: abs(x))), 6) AS l1, round(list_extract({_UNIT}, 1), 6) AS head FROM embeddings")
def v4_l2_normalise(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", V.unit(V.doubles("embedding")).alias("u"))
    return u.select("vec_id", F.round(V.total(F.transform("u", F.abs)), 6).alias("l1"), F.round(F.col("u")[0], 6).alias("head"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.v, c.v) AS s FROM v q, v c WHERE q.vec_id % 50 = 0)
 SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s WHERE s >= 0.2) WHERE rank <= 10""")
def o1_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return ranking.vector_search(e, e.where("vec_id % 50 = 0"), 10, 0.2).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _centroids(e: DataFrame) -> DataFrame:
    x = e.select("label", F.posexplode(V.doubles("embedding")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])  # as many entries as dimensions
    return x.groupBy("label").agg(listed.alias("c")).select("label", V.unit(F.col("c")).alias("centroid"))


_CENTROIDS = """x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
 m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), l AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)"""


@query(f"WITH {_CENTROIDS} SELECT label, round(c[1] / sqrt(list_sum(list_transform(c, lambda y: y * y))), 6) AS head, round(list_sum(c) / sqrt(list_sum(list_transform(c, lambda y: y * y))), 6) AS total FROM l")
def g22_centroids(spark, d):
    return _centroids(table(spark, d, "embeddings")).select("label", F.round(F.col("centroid")[0], 6).alias("head"), F.round(V.total(F.col("centroid")), 6).alias("total"))


def _nearest(spark, d) -> DataFrame:
    """vec_id, label and similarity of the nearest of the centroids, one for each label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("embedding"))
    centers = _centroids(e).select(F.col("label").cast("long").alias("label"), "centroid")
    near = ranking.nearest_center(e, centers, "vec_id", "embedding", "label", "centroid", ["label"])
    return near.select("vec_id", "label", F.col("center").cast("int").alias("domain"), "s")


_NEAREST = f"""{_CENTROIDS}, s AS (SELECT vec_id, embeddings.label AS own, l.label AS domain, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings, l),
 b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, domain) AS r FROM s)"""


@query(f"WITH {_NEAREST} SELECT vec_id, domain, round(s, 6) AS score, domain = own AS agrees FROM b WHERE r = 1")
def r26_top_domain(spark, d):
    return _nearest(spark, d).select("vec_id", "domain", F.round("s", 6).alias("score"), (F.col("domain") == F.col("label")).alias("agrees"))


@query(f"WITH {_NEAREST} SELECT CAST(greatest(0, least(9, floor(s * 10))) AS BIGINT) AS bucket, count(*) AS n FROM b WHERE r = 1 GROUP BY ALL")
def g19_similarity_histogram(spark, d):
    return _nearest(spark, d).groupBy(F.greatest(F.lit(0), F.least(F.lit(9), F.floor(F.col("s") * 10))).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_NEAREST}, o AS (SELECT domain, s, row_number() OVER (PARTITION BY domain ORDER BY s) AS k, count(*) OVER (PARTITION BY domain) AS n FROM b WHERE r = 1)
 SELECT domain, round(avg(s), 6) AS mean, round(max(s), 6) AS high, round(min(s), 6) AS low, round(max(CASE WHEN k = CAST(ceil(0.95 * n) AS BIGINT) THEN s END), 6) AS p95 FROM o GROUP BY domain""")
def g20_similarity_statistics(spark, d):
    near = kept(_nearest(spark, d))
    means = near.groupBy("domain").agg(*(F.round(c, 6).alias(k) for k, c in (("mean", F.avg("s")), ("high", F.max("s")), ("low", F.min("s")))))
    return means.join(aggregates.order_statistics(near, ["domain"], "s", {"p95": 0.95}), "domain").withColumn("p95", F.round("p95", 6))


# retrieval

_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_一-龥]+'), lambda t: t <> '')"
_BM25 = f"""q AS (SELECT item_id AS query_id, unnest({_TOK}) AS token FROM benchmark WHERE item_id % 50 = 0),
 a AS (SELECT query_id, token, count(*) AS times FROM q GROUP BY ALL),
 t AS (SELECT doc_id, {_TOK} AS t FROM documents), w AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
 p AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM t) WHERE token IN (SELECT token FROM a) GROUP BY ALL),
 f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
 h AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score FROM a JOIN p USING (token) JOIN f USING (token), w GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h)"""


def _bm25(spark, d, k):
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    hits = ranking.bm25_search(table(spark, d, "documents"), asked, None)
    return ranking.top(hits.select("query_id", "doc_id", F.round("score", 9).alias("score")), ["query_id"], "score", "doc_id", k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def r1_bm25(spark, d):
    return _bm25(spark, d, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT query_id, CASE WHEN max(score) < 8 THEN 'abstain' WHEN count(*) < 3 THEN 'narrow' ELSE 'answer' END AS decision FROM r WHERE rank <= 10 GROUP BY query_id")
def r21_abstention(spark, d):
    decision = F.when(F.max("score") < 8, "abstain").when(F.count("*") < 3, "narrow").otherwise("answer")
    return _bm25(spark, d, 10).groupBy("query_id").agg(decision.alias("decision"))


_LANES = """h AS (SELECT l_orderkey AS query_id, 'price' AS lane, l_partkey AS id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL
 UNION ALL SELECT l_orderkey, 'quantity', l_partkey, max(l_quantity) FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, id) AS rank FROM h)"""


def _lanes(spark, d):
    """Lines are dealt once by query and grouped once for both lanes; ranks and what fuses them stay in these parts."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), "l_extendedprice", F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).alias("quantity"), (F.col("l_discount") >= 0.05).alias("in_quantity"))
    best = dealt(li, "query_id").groupBy("query_id", "id").agg(F.max("l_extendedprice").alias("price"), F.max("quantity").alias("quantity"), F.max(F.coalesce("in_quantity", F.lit(False))).alias("in_quantity"))
    lanes = F.array(F.struct(F.lit("price").alias("lane"), F.col("price").alias("score"), F.lit(True).alias("there")), F.struct(F.lit("quantity").alias("lane"), F.col("quantity").alias("score"), F.col("in_quantity").alias("there")))
    both = best.select("query_id", "id", F.explode(lanes).alias("l")).where("l.there").select("query_id", "id", "l.score", "l.lane")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "lane").orderBy(F.desc("score"), "id")))


@query(f"WITH {_LANES} SELECT query_id, id, round(sum((CASE lane WHEN 'price' THEN 0.6 ELSE 0.4 END) / (60 + rank)), 9) AS score FROM k GROUP BY ALL")
def r4_reciprocal_rank_fusion(spark, d):
    return ranking.reciprocal_rank_fusion(_lanes(spark, d), {"price": 0.6, "quantity": 0.4}).withColumn("score", F.round("score", 9))


@query(f"WITH {_LANES}, c AS (SELECT query_id, id, lane, p_brand AS content, CASE WHEN lane = 'quantity' AND id % 97 = 0 THEN p_size + 1 ELSE p_size END AS provenance FROM h JOIN part ON p_partkey = id) SELECT query_id, id, count(DISTINCT content || '/' || provenance) AS variants FROM c GROUP BY ALL HAVING count(DISTINCT content || '/' || provenance) > 1")
def r4_fusion_conflicts(spark, d):
    """Candidates whose provenance differs between lanes (here the size of every ninety-seventh part)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("content"), "p_size")
    moved = F.when((F.col("lane") == "quantity") & (F.col("id") % 97 == 0), F.col("p_size") + 1).otherwise(F.col("p_size"))
    return ranking.fusion_conflicts(_lanes(spark, d).join(p, "id").withColumn("provenance", moved), ["content", "provenance"])


@query(f"""WITH {_LANES}, m AS (SELECT query_id, lane, min(score) AS lo, max(score) AS hi FROM h GROUP BY ALL)
 SELECT query_id, id, round(sum((CASE lane WHEN 'price' THEN 0.3 ELSE 0.7 END) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END), 6) AS score FROM h JOIN m USING (query_id, lane) GROUP BY ALL""")
def r5_weighted_fusion(spark, d):
    return ranking.score_fusion(_lanes(spark, d), {"price": 0.3, "quantity": 0.7}).withColumn("score", F.round("score", 6))


@query(f"WITH {_LANES} SELECT query_id, id, max(score) AS score FROM h GROUP BY ALL")
def u4_max_merge(spark, d):
    lanes = _lanes(spark, d).select("query_id", "id", "score", "lane")
    return ranking.max_merge([lanes.where(F.col("lane") == x).drop("lane") for x in ("price", "quantity")], ["query_id", "id"], "score")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def w4_source_cap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ranking.source_cap(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("doc_id", "source")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def w3_first_seen(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query()
def r6_mmr(spark, d):
    e = table(spark, d, "embeddings")
    hits = ranking.vector_search(e, e.where("vec_id % 50 = 0"), 30)
    return ranking.mmr(hits.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id"), 10, 0.5)


@query("""WITH r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
 g AS (SELECT source AS query_id, doc_id AS id, quality + toxic AS rel, row_number() OVER (PARTITION BY source ORDER BY quality + toxic DESC, doc_id) AS p FROM documents JOIN labels USING (doc_id) WHERE quality + toxic > 0),
 i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN p <= 5 THEN (2 ** rel - 1) / log2(p + 1) ELSE 0 END) AS idcg FROM g GROUP BY ALL),
 f AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum((2 ** rel - 1) / log2(rank + 1)) AS dcg FROM r JOIN g USING (query_id, id) WHERE rank <= 5 GROUP BY ALL)
 SELECT query_id, round(coalesce(hits, 0) / n, 6) AS recall, CASE WHEN n > 0 THEN round(coalesce(1 / first, 0), 6) END AS mrr, CASE WHEN n > 0 THEN round(coalesce(dcg, 0) / idcg, 6) END AS ndcg
 FROM (SELECT DISTINCT query_id FROM r) LEFT JOIN i USING (query_id) LEFT JOIN f USING (query_id)""")
def e1_retrieval_metrics(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = ranking.top(docs, ["query_id"], "n_chars", "id", 20)
    gold = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id").select("query_id", "id", (F.col("quality") + F.col("toxic")).alias("relevance")).where("relevance > 0")
    m = evaluation.retrieval_metrics(ranked, gold, 5)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


# aggregates over traces and events


@query("""SELECT event_type, count(*) AS n, avg(CAST(value > 50 AS INT)) AS success, round(avg(value), 6) AS mean, round(sum(value), 3) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def g1_trace_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg((F.col("value") > 50).cast("int")).alias("success"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 3).alias("total"), F.countDistinct("user_id").alias("users"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS others,
 round(avg(CASE WHEN value > 60 THEN 1 WHEN value < 40 THEN -1 ELSE 0 END), 6) AS sentiment FROM events GROUP BY user_id""")
def g3_agent_stats(spark, d):
    e = F.col("event_type")
    mood = F.when(F.col("value") > 60, 1).when(F.col("value") < 40, -1).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(e == "click").alias("clicks"), F.count_if(e == "purchase").alias("purchases"), F.count_if(~e.isin("click", "purchase")).alias("others"), F.round(F.avg(mood), 6).alias("sentiment"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS topic, n, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM c) WHERE rank <= 2""")
def g5_hot_topics(spark, d):
    n = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))
    return ranking.top(n, ["user_id"], "n", "topic", 2).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH t AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)
 SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY day) AS n_so_far FROM t""")
def g8_running_totals(spark, d):
    t = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return sequences.running_totals(t, ["event_type"], ["day"], ["n"])


@query("""WITH o AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS turn FROM events),
 r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
 SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS length, round(avg(value), 6) AS heat FROM r GROUP BY user_id, run, event_type""")
def w11_runs(spark, d):
    return sequences.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", F.round(F.avg("value"), 6).alias("heat"))


# conversations


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS n FROM conversations) WHERE role = 'system' OR n <= 4""")
def w8_message_window(spark, d):
    return sequences.message_window(table(spark, d, "conversations"), 2).select("conv_id", "turn")


_COST = "CAST(ceil(length(text) / 4.0) AS BIGINT)"


@query(f"SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300")
def w9_budget_suffix(spark, d):
    return sequences.prefix_within(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn"), F.col("text")], F.ceil(F.length("text") / 4), 300).select("conv_id", "turn", "used")


@query(f"SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 500")
def w16_context_packing(spark, d):
    return sequences.prefix_within(table(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("text")], F.ceil(F.length("text") / 4), 500).select("conv_id", "turn", "used")


@query(f"SELECT conv_id, count(*) AS messages, CAST(sum({_COST}) AS BIGINT) AS tokens, sum({_COST}) > 400 AS over, max(turn) AS newest FROM conversations GROUP BY conv_id")
def g33_session_tokens(spark, d):
    cost = F.sum(F.ceil(F.length("text") / 4))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), cost.alias("tokens"), (cost > 400).alias("over"), F.max("turn").alias("newest"))


# store semantics


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def w20_latest(spark, d):
    return tables.latest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def k9_upsert_all_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return tables.upsert(o, o.where("o_orderkey % 4 = 0").withColumn("status", F.lit("X")), ["o_orderkey"])


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")
def k11_manifest_from_json(spark, d):
    """The whole manifest replaced by what JSON arrays (one for each nation) hold: rows that none has any more go, the others come in as they are there."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    segment = F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    arrays = c.where("c_custkey % 3 <> 0").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_nationkey", segment))).alias("json"))  # as a client sends them
    return tables.replace_manifest(c, tables.manifest_rows(arrays, "json", "c_custkey long, c_nationkey long, c_mktsegment string"), F.lit(True), ["c_custkey"])


@query("""SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey <> 5 OR c_custkey % 2 = 0""")
def k11_manifest_replace(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return tables.replace_manifest(c, c.where("c_custkey % 2 = 0"), F.col("c_nationkey") == 5, ["c_custkey"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size = p_partkey % 50 THEN p_size + 1 ELSE p_size END AS version,
 CASE WHEN p_partkey % 2 = 0 AND p_size = p_partkey % 50 THEN 'new' ELSE p_brand END AS value, p_partkey % 2 = 0 AND p_size = p_partkey % 50 AS applied FROM part""")
def k17_compare_and_set(spark, d):
    p = table(spark, d, "part")
    stored = p.select("p_partkey", F.col("p_size").alias("version"), F.col("p_brand").alias("value"))
    changes = p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_partkey") % 50).alias("expected"), F.lit("new").alias("new"))
    return tables.compare_and_set(stored, changes, ["p_partkey"], "version", "value")


@query("""SELECT p.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality <> p.doc_id % 2 THEN 'conflicting' ELSE 'complete' END AS state FROM documents p LEFT JOIN labels l USING (doc_id)""")
def k24_plan_diff(spark, d):
    planned = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    return tables.plan_diff(planned, table(spark, d, "labels"), ["doc_id"], "quality")


@query("SELECT count(*) AS n, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') GROUP BY c_nationkey")
def j20_anti_join(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL")
def j18_left_join(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").where("c_acctbal > 9000")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"))


# graph

_GRAPH = """e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, least(1.0, max(l_quantity) / 50) AS w FROM lineitem GROUP BY ALL),
 u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), h0 AS (SELECT 's' || s_suppkey AS node, 1.0 AS score, 0 AS hop FROM supplier WHERE s_suppkey % 50 = 0),
 h1 AS (SELECT b AS node, max(score * w * 0.65) AS score, 1 AS hop FROM h0 JOIN u ON node = a GROUP BY b),
 h2 AS (SELECT b AS node, max(score * w * 0.4) AS score, 2 AS hop FROM h1 JOIN u ON node = a GROUP BY b)"""


def _lines(spark, d):
    names = F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")
    return table(spark, d, "lineitem").groupBy(*names).agg((F.max("l_quantity") / 50).alias("weight"))


@query(f"WITH {_GRAPH} SELECT node, round(score, 6) AS score, hop FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, hop) AS r FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2)) WHERE r = 1")
def n2_two_hop_whole_graph(spark, d):
    seeds = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(1.0).alias("score"))
    return graph.expand(seeds, _lines(spark, d)).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
 SELECT count(DISTINCT s) + count(DISTINCT p) AS nodes, count(*) AS edges, ['part', 'supplier'] AS labels FROM e""")
def g29_graph_info_whole(spark, d):
    edges = _lines(spark, d)
    nodes = edges.select(F.col("a").alias("node"), F.lit("supplier").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.lit("part").alias("label")))
    return graph.info(nodes, edges)


# sources


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS title, strlen(html) AS bytes FROM pages")
def s7_page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT doc_id, source, lang FROM documents ORDER BY source, n_chars, doc_id")
def o7_ordered_corpus(spark, d):
    return table(spark, d, "documents").orderBy("source", "n_chars", "doc_id").select("doc_id", "source", "lang")


@query("SELECT lang, source, count(*) AS documents, sum(length(text)) AS chars, sum(CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil((length(text) - 800) / 700.0) AS BIGINT) + 1 END) AS chunks FROM documents GROUP BY ALL")
def g18_corpus_inventory(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("documents"), F.sum(n).alias("chars"), F.sum(F.when(n <= 800, 1).otherwise(F.ceil((n - 800) / 700) + 1)).alias("chunks"))


# distributions, summaries and text statistics


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def g4_distribution_all_types(spark, d):
    """Of all types, whatever they are."""
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS roles, max(turn) AS last_turn, arg_max(length(text), turn) AS last_length FROM conversations GROUP BY conv_id")
def g10_snapshot_summary(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.countDistinct("role").alias("roles"), F.max("turn").alias("last_turn"), F.max_by(F.length("text").cast("long"), F.struct("turn", "text")).alias("last_length"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def g12_nearest_rank(spark, d):
    return aggregates.order_statistics(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH s AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1), b AS (SELECT * FROM s WHERE event_type = 'click')
 SELECT s.event_type, s.n - b.n AS d_n, s.users - b.users AS d_users FROM s LEFT JOIN b ON true""")
def g15_baseline_delta(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return aggregates.deltas(s, "event_type", "click", ["n", "users"])


@query("SELECT source, count(*) AS total, count(*) FILTER (n_chars >= 500) AS qualified, max(n_chars) AS top FROM documents GROUP BY source")
def g16_lane_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 500).alias("qualified"), F.max("n_chars").alias("top"))


@query("""SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+|[\\x{4e00}-\\x{9fff}]+')) AS token FROM documents) GROUP BY ALL""")
def g24_term_frequency_corpus(spark, d):
    """Of all documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+|[\\x{4e00}-\\x{9fff}]+)"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.explode(words).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
 n AS (SELECT DISTINCT left(word, CAST(k AS INT)) AS node FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w))
 SELECT count(*) AS nodes, max(length(node)) AS max_depth, (SELECT count(*) FROM w) AS vocabulary FROM n""")
def g35_trie_stats(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    nodes = w.select("word", F.explode(aggregates.prefixes(F.col("word"))).alias("node")).groupBy("node").agg(F.max(F.col("node") == F.col("word")).alias("whole"))
    return nodes.agg(F.count("*").alias("nodes"), F.max(F.length("node")).cast("long").alias("max_depth"), F.count_if("whole").alias("vocabulary"))


@query("SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS words FROM documents")
def g36_text_stats(spark, d):
    t = F.col("text")
    words = F.size(F.regexp_extract_all(t, F.lit("([^ \\t\\n\\r\\f\\x0B]+)"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), (T.length_without(t, "[^\n]") + 1).cast("long").alias("lines"), words.cast("long").alias("words"))


@query("SELECT DISTINCT lang, source FROM documents")
def g38_distinct_categories(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


# sources


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav\\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer\\b[^>]*>.*?</footer>', ' ', 'g'), '(?is)<header\\b[^>]*>.*?</header>', ' ', 'g'), '(?is)<aside\\b[^>]*>.*?</aside>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages)
 SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(h, '(?is)<main\\b[^>]*>(.*?)</main>', 1), ''), nullif(regexp_extract(h, '(?is)<body\\b[^>]*>(.*?)</body>', 1), ''), h), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') AS text FROM p""")
def s7_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", files.page_text(F.col("html")).alias("text"))


@query()
def s7_page_tree(spark, d):
    """Title and content of each page by its tree of elements."""
    return pages.page_documents(table(spark, d, "pages"))


@query("SELECT label, count(*) AS vectors, min(len(embedding)) AS least_dimension, max(len(embedding)) AS dimension FROM embeddings GROUP BY label")
def s16_collection_statistics(spark, d):
    size = F.size("embedding").cast("long")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.min(size).alias("least_dimension"), F.max(size).alias("dimension"))


@query("SELECT event_id, event_type, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE props->>'k' IS NOT NULL")
def s17_json_scan(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k IS NOT NULL")


# streams


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY event_type")
def z13_stream_totals(spark, d):
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return streams.totals(stream, ["event_type"], F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


@query("SELECT user_id, count(DISTINCT event_id) AS rows, count(DISTINCT event_id) FILTER (event_type IN ('click', 'view')) AS looked, count(DISTINCT event_id) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY user_id")
def z13_keyed_totals(spark, d):
    """What each user did, kept by key in a stream's state; an event that comes again counts once."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return keyed.keyed_totals(stream, "user_id", "event_id", "event_type", {"looked": ("click", "view"), "bought": ("purchase",)}).drop("batch")


# the other parts enter theirs in the same place
from sedge.plans import evaluations, graphs, retrieval, stores, texts, traces, vectorial  # noqa: E402, F401
