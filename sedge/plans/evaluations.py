"""Evaluation: facts, citations, security, gates, summaries. Orders are cases, their lines the evidence and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import evaluation
from sedge.plans.registry import dealt, query, table
from sedge.sources import datasets
from sedge.streaming.shared import kept

# ranked evidence of each source: its longest documents; gold: its labelled ones

_RANKED = """r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
 g AS (SELECT source AS query_id, doc_id AS id, quality + toxic AS rel FROM documents JOIN labels USING (doc_id) WHERE quality + toxic > 0)"""


def _ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "id")
    gold = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id").select("query_id", "id", (F.col("quality") + F.col("toxic")).alias("rel")).where("rel > 0")
    return docs.select("query_id", "id", F.row_number().over(w).alias("pos")), gold


@query(f"WITH {_RANKED} SELECT query_id, id, pos, rel, round((2 ** rel - 1) / log2(pos + 1), 6) AS gain FROM r JOIN g USING (query_id, id)")
def j11_w14_gold_gains(spark, d):
    ranked, gold = _ranked(spark, d)
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("pos") + 1)
    return ranked.join(gold, ["query_id", "id"]).select("query_id", "id", F.col("pos").cast("long").alias("pos"), "rel", F.round(gain, 6).alias("gain"))


@query(f"WITH {_RANKED} SELECT query_id, min(CASE WHEN g.id IS NOT NULL THEN pos END) AS first FROM r LEFT JOIN g USING (query_id, id) GROUP BY query_id")
def w15_first_relevant(spark, d):
    ranked, gold = _ranked(spark, d)
    hit = gold.select("query_id", "id", F.lit(True).alias("hit"))
    return ranked.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("pos"))).cast("long").alias("first"))


# answers

_FACTS = "[['hello', 'thank'], ['the'], ['data', 'code', 'function']]"


@query(f"""SELECT conv_id, turn, round(len(list_filter({_FACTS}, lambda alt: len(list_filter(alt, lambda f: contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), f))) > 0)) / 3, 6) AS coverage,
 (role = 'system') = regexp_matches(lower(text), 'sorry|cannot|unable') AS abstain_correct FROM conversations""")
def e2_fact_coverage(spark, d):
    """A fact counts if any of its alternatives is in the normal answer; an answer abstains by its words."""
    answer = F.lower(T.collapsed(T.nfkc("text")))
    facts = [["hello", "thank"], ["the"], ["data", "code", "function"]]
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.round(evaluation.fact_coverage(answer, facts), 6).alias("coverage"), (F.col("role").eqNullSafe("system") == F.lower("text").rlike("sorry|cannot|unable")).alias("abstain_correct"))


_CITED = """l AS (SELECT l_orderkey AS c, l_linenumber AS n, l_linenumber % 3 AS e, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_tax * 500) AS BIGINT) AS t FROM lineitem), gold AS (SELECT DISTINCT c, e, q AS a, q + 10 AS b FROM l WHERE n % 2 = 1),
 cit AS (SELECT c, e, t AS a, t + 15 AS b, row_number() OVER () AS k FROM l WHERE n % 2 = 0), val AS (SELECT * FROM cit WHERE a >= 0 AND b > a AND b <= 50),
 x AS (SELECT v.k, gold.c, gold.e, gold.a, gold.b, greatest(0, least(v.b, gold.b) - greatest(v.a, gold.a)) AS o, greatest(v.b, gold.b) - least(v.a, gold.a) AS hull FROM val v JOIN gold ON v.c = gold.c AND v.e = gold.e),
 s1 AS (SELECT c, count(*) AS n FROM cit GROUP BY 1), s2 AS (SELECT c, count(*) AS n FROM val GROUP BY 1), s3 AS (SELECT c, count(DISTINCT k) AS n FROM x WHERE o > 0 GROUP BY 1),
 s4 AS (SELECT g.c, count(*) AS n, count(*) FILTER (m.iou > 0) AS hit, avg(coalesce(m.iou, 0)) AS iou FROM gold g LEFT JOIN (SELECT c, e, a, b, max(CASE WHEN o > 0 THEN o / hull ELSE 0 END) AS iou FROM x GROUP BY ALL) m ON g.c = m.c AND g.e = m.e AND g.a = m.a AND g.b = m.b GROUP BY g.c)"""


@query(f"""WITH {_CITED} SELECT s4.c AS case_id, round(coalesce(s2.n / s1.n, 0), 6) AS validity, round(coalesce(s3.n / s1.n, 0), 6) AS precision, round(s4.hit / s4.n, 6) AS coverage, round(s4.iou, 6) AS mean_iou
 FROM s4 LEFT JOIN s1 USING (c) LEFT JOIN s2 USING (c) LEFT JOIN s3 USING (c)""")
def e3_citation_metrics(spark, d):
    n, start = F.col("l_linenumber"), F.round(F.col("l_tax") * 500).cast("long")
    li = table(spark, d, "lineitem").withColumn("evidence", n % 3)
    gold = li.where(n % 2 == 1).select(F.col("l_orderkey").alias("case_id"), "evidence", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + 10).alias("end")).distinct()
    cited = li.where(n % 2 == 0).select(F.col("l_orderkey").alias("case_id"), "evidence", start.alias("start"), (start + 15).alias("end"), F.lit(50).alias("length"))
    m = evaluation.citation_metrics(cited, gold)
    return m.select("case_id", *(F.round(c, 6).alias(c) for c in ("validity", "precision", "coverage", "mean_iou")))


_SECURE = """s AS (SELECT l_orderkey AS case_id, CAST(count(*) FILTER (l_suppkey % 3 <> o_custkey % 3) AS BIGINT) AS cross_tenant, CAST(count(*) FILTER (l_partkey % 2 <> o_custkey % 2) AS BIGINT) AS cross_corpus,
 CAST(count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS BIGINT) AS trust, CAST(count(*) FILTER (l_partkey IN (1, 2, 3)) AS BIGINT) AS forbidden, CAST(count(DISTINCT CASE WHEN l_linenumber NOT IN (1, 2, 3) THEN l_linenumber END) AS BIGINT) AS lanes, CAST(max(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 0 ELSE 1 END) AS BIGINT) AS policy FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


def _security(spark, d) -> DataFrame:
    """Lines and orders are dealt alike, so that they are joined and grouped where they are."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linenumber")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    n = lines.count() + orders.count()
    rows = dealt(lines, "l_orderkey", n).join(dealt(orders, "o_orderkey", n).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    lane = F.col("l_linenumber")
    return rows.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.count_if(F.col("l_suppkey") % 3 != F.col("o_custkey") % 3).alias("cross_tenant"), F.count_if(F.col("l_partkey") % 2 != F.col("o_custkey") % 2).alias("cross_corpus"),
        F.count_if(~F.col("l_returnflag").isin("A", "N")).alias("trust"), F.count_if(F.col("l_partkey").isin(1, 2, 3)).alias("forbidden"), F.countDistinct(F.when(~lane.isin(1, 2, 3), lane)).alias("lanes"),
        F.max(F.when(F.coalesce(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.lit(False)), 0).otherwise(1)).cast("long").alias("policy"))


@query(f"WITH {_SECURE} SELECT * FROM s")
def e4_security_counters(spark, d):
    return _security(spark, d)


@query(f"WITH {_SECURE} SELECT CAST(sum(cross_tenant) AS BIGINT) AS cross_tenant, CAST(sum(cross_corpus) AS BIGINT) AS cross_corpus, CAST(sum(trust) AS BIGINT) AS trust, CAST(sum(forbidden) AS BIGINT) AS forbidden, CAST(sum(lanes) AS BIGINT) AS lanes, CAST(sum(policy) AS BIGINT) AS policy FROM s")
def g14_security_sums(spark, d):
    return _security(spark, d).agg(*(F.sum(c).alias(c) for c in ("cross_tenant", "cross_corpus", "trust", "forbidden", "lanes", "policy")))


#: Results of cases: orders; failed: status P; recall and facts from prices, null for some; abstained by priority.
_CASES = """c AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS done, CASE WHEN o_custkey % 5 > 0 THEN o_orderkey % 11 / 10.0 END AS recall, CASE WHEN o_custkey % 7 > 0 THEN o_orderkey % 3 / 2.0 END AS facts,
 o_orderpriority = '1-URGENT' AS expected, o_orderkey % 6 = 0 AS abstained, o_totalprice AS ms, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1000 END AS tokens FROM orders), k AS (SELECT * FROM c WHERE done)"""


def _cases(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("id"), (F.col("o_orderstatus") != "P").alias("done"), F.when(c % 5 > 0, k % 11 / 10.0).alias("recall"), F.when(c % 7 > 0, k % 3 / 2.0).alias("facts"),
        (F.col("o_orderpriority") == "1-URGENT").alias("expected"), (k % 6 == 0).alias("abstained"), F.col("o_totalprice").alias("ms"), F.when(k % 4 > 0, k % 1000).alias("tokens"))


_SUMMARY = """SELECT (SELECT count(*) FROM c) AS total, count(*) AS completed, round(1 - count(*) / (SELECT count(*) FROM c), 6) AS error_rate, round(avg(recall), 6) AS recall, round(count(recall) / count(*), 6) AS recall_cover, round(avg(facts), 6) AS facts,
 round(avg(CAST(expected = abstained AS INT)), 6) AS abstain_accuracy, round(avg(CASE WHEN expected THEN CAST(abstained AS INT) END), 6) AS tpr, round(avg(CASE WHEN NOT expected THEN CAST(abstained AS INT) END), 6) AS fpr,
 round(avg(CASE WHEN abstained THEN NULL WHEN expected THEN 0 WHEN facts IS NULL THEN 1 ELSE CAST(facts = 1 AS INT) END), 6) AS selective, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, CAST(sum(tokens) AS BIGINT) AS tokens, round(count(tokens) / count(*), 6) AS token_cover FROM k"""


@query(f"WITH {_CASES} {_SUMMARY}")
def g11_eval_summary(spark, d):
    return evaluation.summary(_cases(spark, d))


@query(f"""WITH {_CASES}, s AS ({_SUMMARY}), f AS (SELECT unnest(['FAILED_CASES', 'RECALL_AT_K', 'REQUIRED_FACT_COVERAGE', 'UNANSWERABLE_TPR', 'ANSWERABLE_ABSTAIN_FPR', 'SELECTIVE_ACCURACY', 'TOKEN_COVERAGE']) AS code, unnest([(total - completed)::DOUBLE, recall, facts, tpr, fpr, selective, token_cover]) AS actual, unnest([0.0, 1, 1, 1, 0, 1, 0.3]) AS expected, unnest(['=', '=', '=', '=', '=', '=', '>=']) AS rule FROM s)
 SELECT code, actual, CAST(expected AS DOUBLE) AS expected FROM f WHERE CASE rule WHEN '=' THEN actual IS DISTINCT FROM expected ELSE actual IS NULL OR actual < expected END""")
def e5_gate_findings(spark, d):
    s = evaluation.summary(_cases(spark, d)).withColumn("failed", (F.col("total") - F.col("completed")).cast("double"))
    rules = [("FAILED_CASES", "failed", "=", 0.0), ("RECALL_AT_K", "recall", "=", 1.0), ("REQUIRED_FACT_COVERAGE", "facts", "=", 1.0), ("UNANSWERABLE_TPR", "tpr", "=", 1.0), ("ANSWERABLE_ABSTAIN_FPR", "fpr", "=", 0.0), ("SELECTIVE_ACCURACY", "selective", "=", 1.0), ("TOKEN_COVERAGE", "token_cover", ">=", 0.3)]
    return evaluation.gate(s, rules)


@query(f"WITH {_CASES} SELECT id % 10 AS grp, round(avg(recall), 6) AS recall, round(avg(CASE WHEN id % 10 = 3 THEN NULL ELSE facts END), 6) AS facts FROM k GROUP BY 1")
def g13_nullable_means(spark, d):
    """Means of what is not null; null where nothing is."""
    return _cases(spark, d).where("done").groupBy((F.col("id") % 10).alias("grp")).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.when(F.col("id") % 10 != 3, F.col("facts"))), 6).alias("facts"))


@query(f"""WITH {_CASES}, m AS (SELECT id % 3 AS target, avg(recall) AS recall, avg(facts) AS facts, quantile_disc(ms, 0.5) AS p50 FROM k GROUP BY 1), b AS (SELECT * FROM m WHERE target = 0)
 SELECT m.target, round(m.recall - b.recall, 6) AS d_recall, round(m.facts - b.facts, 6) AS d_facts, round(m.p50 - b.p50, 6) AS d_p50 FROM m, b""")
def e7_matrix_deltas(spark, d):
    from sedge.operators import aggregates

    done = _cases(spark, d).where("done").withColumn("target", F.col("id") % 3)
    m = done.groupBy("target").agg(F.avg("recall").alias("recall"), F.avg("facts").alias("facts")).join(aggregates.order_statistics(done, ["target"], "ms", {"p50": 0.5}), "target", "left")
    return aggregates.deltas(m, "target", 0, ["recall", "facts", "p50"]).select("target", *(F.round(c, 6).alias(c) for c in ("d_recall", "d_facts", "d_p50")))


@query("SELECT source, round(avg(quality), 6) AS pass_rate, round(avg(n_chars), 4) AS mean_score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def g25_g26_pass_rates(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(F.avg("n_chars"), 4).alias("mean_score"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 3 = o_custkey % 3 AND l_returnflag IN ('A', 'N') AND l_returnflag <> 'R'")
def p6_eval_scope_filter(spark, d):
    """Evidence of the case's tenant whose trust is known, allowed and not quarantined."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where((F.col("l_suppkey") % 3 == F.col("o_custkey") % 3) & F.col("l_returnflag").isNotNull() & F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT item_id, 'hybrid' AS policy FROM benchmark WHERE regexp_matches(lower(text), '[0-9]{3,}') UNION ALL SELECT item_id, 'ordered' FROM benchmark WHERE NOT regexp_matches(lower(text), '[0-9]{3,}') AND regexp_matches(lower(text), '\\ball\\b|\\bover\\b')")
def p21_golden_questions(spark, d):
    t = F.lower("text")
    policy = F.when(t.rlike("[0-9]{3,}"), "hybrid").when(t.rlike(r"\ball\b|\bover\b"), "ordered")
    return table(spark, d, "benchmark").select("item_id", policy.alias("policy")).where("policy IN ('hybrid', 'ordered')")


@query("""WITH g AS (SELECT doc_id AS evidence, count(*) AS n FROM labels GROUP BY 1) SELECT 'repeated' AS problem, evidence FROM g WHERE n > 1 UNION ALL SELECT 'unknown', evidence FROM g WHERE evidence NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unlabelled', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def s26_dataset_checks(spark, d):
    """Repeated gold ids, gold of unknown evidence, and evidence without gold."""
    g = table(spark, d, "labels").groupBy(F.col("doc_id").alias("evidence")).agg(F.count("*").alias("n"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("evidence"))
    parts = (("repeated", g.where("n > 1")), ("unknown", g.join(docs, "evidence", "left_anti")), ("unlabelled", docs.join(g, "evidence", "left_anti")))
    out = None
    for name, rows in parts:
        part = rows.select(F.lit(name).alias("problem"), "evidence")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH c AS (SELECT doc_id AS n, 'case-' || (CASE WHEN doc_id % 29 = 0 THEN 0 ELSE doc_id END) AS id, quality FROM labels), f AS (SELECT * FROM c WHERE n % 11 <> 0 AND n % 13 <> 0 AND n % 17 <> 0),
 r AS (SELECT n, id, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM f)
 SELECT '$.cases[' || n || '].expectedAbstain' AS path, 'must be a boolean' AS error FROM c WHERE n % 17 = 0 UNION ALL SELECT '$.cases[' || n || '].tags[1]', 'must be a non-empty string' FROM c WHERE n % 17 <> 0 AND n % 13 = 0
 UNION ALL SELECT '$.cases[' || n || '].query', 'must be a non-empty string' FROM c WHERE n % 17 <> 0 AND n % 13 <> 0 AND n % 11 = 0 UNION ALL SELECT '$.cases[' || n || '].id', 'duplicate value ' || id FROM r WHERE k > 1
 UNION ALL SELECT '$.cases[' || n || '].goldEvidence[0].evidenceId', 'references unknown corpus evidence ' || (n * 7) FROM f WHERE n * 7 NOT IN (SELECT doc_id FROM documents)""")
def s26_dataset_errors(spark, d):
    """Cases written as JSON from the labels, some with faults, read strictly against the documents as corpus."""
    n = F.col("doc_id")
    gold = F.array(F.struct((n * 7).cast("string").alias("evidenceId"), F.lit(1).alias("relevance")))
    body = F.to_json(F.struct(F.concat(F.lit("case-"), F.when(n % 29 == 0, 0).otherwise(n).cast("string")).alias("id"), F.when(n % 11 == 0, " ").otherwise("what").alias("query"), F.when(n % 13 == 0, F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a"))).alias("tags"), gold.alias("goldEvidence")))
    flag = F.when(n % 17 == 0, '"no"').otherwise("false")
    cases = table(spark, d, "labels").select("doc_id", F.concat(F.regexp_replace(body, "\\}$", ""), F.lit(', "expectedAbstain": '), flag, F.lit("}")).alias("case"))
    corpus = table(spark, d, "documents").select(n.cast("string").alias("evidence"))
    return datasets.dataset_errors(kept(datasets.decode_cases(cases, "doc_id", "case")), corpus)
