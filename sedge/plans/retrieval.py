"""Hybrid retrieval over documents, decisions about evidence, and what is built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import context, ranking
from sedge.plans.queries import _BM25, _LANES, _bm25, _lanes
from sedge.plans.registry import query, table

# dense lane: the vector of a query's id against those of documents; lexical lane: its text

_DENSE = """de AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ds AS (SELECT item_id AS query_id, c.vec_id AS id, list_cosine_similarity(x.v, c.v) AS s FROM benchmark JOIN de x ON x.vec_id = item_id, de c WHERE item_id % 50 = 0 AND c.vec_id IN (SELECT doc_id FROM documents)),
 dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ds)"""


def _dense(spark, d, k: int, threshold: float | None = None) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.join(table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    corpus = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return ranking.vector_search(corpus, asked, k, threshold)


_BOTH = f"""{_BM25}, {_DENSE}, lx AS (SELECT query_id, doc_id AS id, score AS s, rank FROM r WHERE rank <= 20), dn AS (SELECT query_id, id, s, rank FROM dk WHERE rank <= 20)"""


def _two_lanes(spark, d, k: int = 20) -> tuple[DataFrame, DataFrame]:
    lexical = _bm25(spark, d, k).select("query_id", F.col("doc_id").alias("id"), "score", "rank", F.lit("lexical").alias("lane"))
    return _dense(spark, d, k).withColumn("lane", F.lit("dense")), lexical


@query(f"""WITH {_BOTH}, fu AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 12) AS s FROM (SELECT query_id, id, rank FROM lx UNION ALL SELECT query_id, id, rank FROM dn) GROUP BY ALL),
 tt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM fu) SELECT query_id, id, round(s, 9) AS score FROM tt SEMI JOIN lx USING (query_id, id) WHERE k <= 10""")
def r2_j7_hybrid_search(spark, d):
    """Both lanes' twenty, fused by rank; of the ten best those that the lexical lane has too."""
    dense, lexical = _two_lanes(spark, d)
    fused = ranking.reciprocal_rank_fusion(dense.unionByName(lexical), {}).withColumn("score", F.round("score", 12))
    return ranking.top(fused, ["query_id"], "score", "id", 10).join(lexical.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", F.round("score", 9).alias("score"))


_WITHIN = f"""{_DENSE}, hd AS (SELECT query_id, id, rank FROM dk WHERE rank <= 50), tk AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_一-龥]+'), lambda t: t <> '') AS t FROM documents),
 hl AS (SELECT query_id, count(*) AS n, avg(len(t)) AS avgdl FROM hd JOIN tk USING (id) GROUP BY 1), aq AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_一-龥]+'), lambda t: t <> '')) AS token FROM benchmark WHERE item_id % 50 = 0), aw AS (SELECT query_id, token, count(*) AS times FROM aq GROUP BY ALL),
 po AS (SELECT query_id, id, len, token, count(*) AS tf FROM (SELECT query_id, id, len(t) AS len, unnest(t) AS token FROM hd JOIN tk USING (id)) GROUP BY ALL), fo AS (SELECT query_id, token, count(*) AS df FROM po GROUP BY ALL),
 sc AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS s FROM aw JOIN po USING (query_id, token) JOIN fo USING (query_id, token) JOIN hl USING (query_id) GROUP BY ALL),
 sk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM sc)"""


@query(f"WITH {_WITHIN} SELECT query_id, id, round(coalesce(0.6 / (60 + hd.rank), 0) + coalesce(0.4 / (60 + sk.rank), 0), 9) AS score FROM hd LEFT JOIN sk USING (query_id, id)")
def r3_weighted_rank_fusion(spark, d):
    """The lexical lane ranks the dense hits only, with the statistics of each query's own hits."""
    hits = _dense(spark, d, 50).withColumn("lane", F.lit("dense"))
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    lexical = ranking.bm25_within(hits.select("query_id", "id"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), asked)
    lexical = ranking.top(lexical.withColumn("score", F.round("score", 9)), ["query_id"], "score", "id", 50).withColumn("lane", F.lit("sparse"))
    both = hits.select("query_id", "id", "rank", "lane").unionByName(lexical.select("query_id", "id", "rank", "lane"))
    return ranking.reciprocal_rank_fusion(both, {"dense": 0.6, "sparse": 0.4}).withColumn("score", F.round("score", 9))


@query(f"WITH {_BOTH} SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.id, n.id) AS id, round(coalesce(l.s, 0), 6) AS lexical, round(coalesce(n.s, 0), 6) AS dense FROM lx l FULL JOIN dn n ON l.query_id = n.query_id AND l.id = n.id")
def j8_lane_merge(spark, d):
    dense, lexical = _two_lanes(spark, d)
    a, b = (x.select("query_id", "id", F.col("score").alias(n)) for x, n in ((lexical, "lexical"), (dense, "dense")))
    return a.join(b, ["query_id", "id"], "full").select("query_id", "id", *(F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n in ("lexical", "dense")))


@query(f"WITH {_BOTH} SELECT DISTINCT query_id, id FROM (SELECT query_id, id FROM lx UNION ALL SELECT query_id, id FROM dn)")
def u3_lane_union(spark, d):
    dense, lexical = _two_lanes(spark, d)
    return dense.select("query_id", "id").unionByName(lexical.select("query_id", "id")).distinct()


@query(f"WITH {_BOTH} SELECT query_id, id FROM dn INTERSECT SELECT query_id, id FROM lx")
def u6_lane_intersection(spark, d):
    dense, lexical = _two_lanes(spark, d)
    return dense.select("query_id", "id").intersect(lexical.select("query_id", "id"))


@query(f"WITH {_DENSE} SELECT query_id, id, 'standard' AS lane, rank - 1 AS ordinal, round(s, 6) AS score, coalesce(source, '') AS source, CASE lang WHEN 'en' THEN 'trusted' ELSE 'external' END AS trust FROM dk JOIN documents ON doc_id = id WHERE rank <= 10 AND s >= 0.3")
def r12_r9_p8_standard_lane(spark, d):
    """Hits of the standard lane as evidence: ordinal, coalesced source, trust."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.when(F.col("lang") == "en", "trusted").otherwise("external").alias("trust"))
    return _dense(spark, d, 10, 0.3).join(docs, "id").select("query_id", "id", F.lit("standard").alias("lane"), (F.col("rank") - 1).cast("long").alias("ordinal"), F.round("score", 6).alias("score"), "source", "trust")


_BOOST = f"""{_DENSE}, en AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 6)) AS name FROM benchmark WHERE item_id % 50 = 0),
 mt AS (SELECT query_id, doc_id AS id, count(*) AS n FROM en, documents WHERE contains(lower(text), name) AND EXISTS (SELECT 1 FROM dk WHERE dk.query_id = en.query_id AND dk.id = doc_id AND rank <= 20) GROUP BY ALL),
 bo AS (SELECT query_id, id, least(1, s * (1 + 0.1 * coalesce(n, 0))) AS s FROM dk LEFT JOIN mt USING (query_id, id) WHERE rank <= 20)"""


def _boosted(spark, d) -> DataFrame:
    names = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 6))
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), names.alias("names"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    hits = _dense(spark, d, 20).join(docs, "id").join(asked, "query_id")
    n = F.size(F.filter("names", lambda w: F.col("text").contains(w)))
    return hits.select("query_id", "id", F.least(F.lit(1.0), F.col("score") * (1 + 0.1 * n)).alias("score"))


@query(f"WITH {_BOOST} SELECT query_id, id, round(s, 6) AS score FROM bo")
def r8_entity_boost(spark, d):
    return _boosted(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_BOOST}, mg AS (SELECT query_id, id, round(max(s), 9) AS s FROM (SELECT query_id, id, s FROM bo UNION ALL SELECT query_id, id, s FROM dk WHERE rank <= 10 AND s >= 0.3) GROUP BY ALL), ok AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM mg) SELECT query_id, id, round(s, 6) AS score, rank FROM ok WHERE rank <= 10")
def r10_o10_hybrid_by_max(spark, d):
    lists = [_boosted(spark, d), _dense(spark, d, 10, 0.3).select("query_id", "id", "score")]
    merged = ranking.max_merge(lists, ["query_id", "id"], "score").withColumn("score", F.round("score", 9))
    return ranking.top(merged, ["query_id"], "score", "id", 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN CAST(embedding AS DOUBLE[])[1:32] ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.v, c.v) AS s FROM v q JOIN v c ON len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
 SELECT query_id, id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5""")
def r13_dimension_checked_search(spark, d):
    """Vectors of several dimensions in one table: a query meets those of its own."""
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    out = None
    for n in (32, 64):
        own = e.where(F.size("embedding") == n)
        part = ranking.vector_search(own, own.where("vec_id % 50 = 0"), 5)
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "id", F.round("score", 6).alias("score"))


_EVIDENCE = f"""{_BOTH}, ev AS (SELECT query_id, lane, id, CASE WHEN id % 89 = 0 THEN NULL ELSE s END AS s, CASE WHEN id % 97 = 0 THEN 'quarantined' ELSE 'trusted' END AS trust, source, text FROM
 (SELECT query_id, 'lexical' AS lane, id, s, rank FROM lx UNION ALL SELECT query_id, 'dense', id, s, rank FROM dn) JOIN documents ON doc_id = id WHERE rank <= 10)"""
_KIND = """CASE WHEN regexp_matches(lower(text), '[0-9]{3,}') THEN 'identifier' WHEN regexp_matches(lower(text), '\\ball\\b|\\bover\\b') THEN 'global' ELSE 'semantic' END"""


@query(f"""WITH {_EVIDENCE}, al AS (SELECT item_id AS query_id, {_KIND} AS kind FROM benchmark WHERE item_id % 50 = 0 UNION ALL SELECT -item_id, 'semantic' FROM benchmark WHERE item_id % 50 = 0),
 qu AS (SELECT query_id, count(*) AS n, count(*) FILTER (trust = 'quarantined') AS bad, count(*) FILTER (s IS NULL) AS broken, count(*) FILTER (s >= CASE lane WHEN 'dense' THEN 0.3 ELSE 8 END) AS good,
  count(*) FILTER (lane = 'lexical' AND s >= 8) AS lexical, count(DISTINCT CASE WHEN s >= CASE lane WHEN 'dense' THEN 0.3 ELSE 8 END THEN id END) AS docs FROM ev GROUP BY 1)
 SELECT query_id, CASE WHEN n IS NULL THEN 'no_evidence' WHEN bad > 0 THEN 'unsafe_evidence' WHEN broken > 0 THEN 'invalid_evidence_score' WHEN good = 0 THEN 'all_evidence_below_lane_threshold' WHEN kind = 'identifier' AND lexical = 0 THEN 'identifier_requires_lexical_evidence'
  WHEN kind = 'global' AND docs < 2 THEN 'insufficient_distinct_documents' ELSE 'sufficient_evidence' END AS reason FROM al LEFT JOIN qu USING (query_id)""")
def r21_abstention_rules(spark, d):
    """All rules in order over both lanes; queries without evidence (here those of negative ids) are answered too."""
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0")
    t = F.lower("text")
    kind = F.when(t.rlike("[0-9]{3,}"), "identifier").when(t.rlike(r"\ball\b|\bover\b"), "global").otherwise("semantic")
    every = asked.select(F.col("item_id").alias("query_id"), kind.alias("kind")).unionByName(asked.select((-F.col("item_id")).alias("query_id"), F.lit("semantic").alias("kind")))
    dense, lexical = _two_lanes(spark, d)
    id_ = F.col("id")
    evidence = dense.unionByName(lexical).where("rank <= 10").select("query_id", "lane", "id", F.when(id_ % 89 != 0, F.col("score")).alias("score"), F.when(id_ % 97 == 0, "quarantined").otherwise("trusted").alias("trust"))
    # an id 0 is in the query and its negative
    return context.abstention(every, evidence, {"dense": 0.3, "lexical": 8.0}, lexical=("lexical",))


_PACKED = f"""{_DENSE}, ce AS (SELECT query_id, rank AS place, id, CASE WHEN rank > 1 THEN chr(10) || chr(10) ELSE '' END || '[' || rank || '] ' || coalesce(source, '') || chr(10) AS head, text FROM dk JOIN documents ON doc_id = id WHERE rank <= 6),
 cc AS (SELECT *, length(regexp_replace(head || text, '[^\\x00-\\x7F]', '', 'g')) AS a, length(regexp_replace(head || text, '[\\x00-\\x7F]', '', 'g')) AS u, length(regexp_replace(head, '[^\\x00-\\x7F]', '', 'g')) AS ha, length(regexp_replace(head, '[\\x00-\\x7F]', '', 'g')) AS hu FROM ce),
 cs AS (SELECT *, sum(a) OVER w AS ca, sum(u) OVER w AS cu FROM cc WINDOW w AS (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
 cf AS (SELECT query_id, min(place) AS place FROM cs WHERE ceil(ca / 4.0) + cu > 1200 GROUP BY 1),
 cp AS (SELECT cs.*, unnest(range(1, length(text) + 1)) AS n FROM cs SEMI JOIN cf USING (query_id, place)),
 cl AS (SELECT query_id, id, ca - a + ha AS ba, cu - u + hu AS bu, n, sum(CAST(ord(text[n]) < 128 AS INT)) OVER w AS pa, sum(CAST(ord(text[n]) >= 128 AS INT)) OVER w AS pu FROM cp WINDOW w AS (PARTITION BY query_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
 cx AS (SELECT query_id, id, max(n) AS n FROM cl WHERE ceil((ba + pa) / 4.0) + bu + pu <= 1200 GROUP BY ALL)"""


@query(f"WITH {_PACKED} SELECT query_id, cs.id, place, coalesce(cx.n, length(text)) AS chars, cx.n IS NOT NULL AS cut FROM cs LEFT JOIN cf f USING (query_id, place) LEFT JOIN cx USING (query_id, id) WHERE (f.place IS NULL AND place < coalesce((SELECT min(g.place) FROM cf g WHERE g.query_id = cs.query_id), 1000)) OR cx.n IS NOT NULL")
def r22_w16_context_composition(spark, d):
    """Evidence in retrieval order under numbered headers; the first that overflows the budget is cut to its longest prefix that fits, and ends it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    hits = _dense(spark, d, 6).join(docs, "id").withColumnRenamed("rank", "place")
    return context.composed(hits, 1200).select("query_id", "id", F.col("place").cast("long").alias("place"), F.col("chars").cast("long").alias("chars"), "cut")


@query(f"WITH {_PACKED} SELECT query_id, cs.id FROM cs LEFT JOIN cx USING (query_id, id) WHERE cx.n IS NULL AND place >= coalesce((SELECT min(g.place) FROM cf g WHERE g.query_id = cs.query_id), 1000)")
def u10_excluded_evidence(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    hits = _dense(spark, d, 6).join(docs, "id").withColumnRenamed("rank", "place")
    return hits.select("query_id", "id").join(context.composed(hits, 1200), ["query_id", "id"], "left_anti")


@query("""WITH k AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil((length(text) - 800) / 700.0) AS BIGINT) + 1 END)) AS i FROM documents)
 SELECT doc_id, i AS idx, md5(substr(text, greatest(1, i * 700 - 199), i * 700 + 1001 - greatest(1, i * 700 - 199))) AS digest, md5('Document ' || doc_id || ': ' || left(text, 2000)) AS cache_key FROM k""")
def r24_r25_chunk_contexts(spark, d):
    """200 characters on both sides of each window, and the key under which a document's preamble is kept."""
    t = F.col("text")
    c = table(spark, d, "documents").select("doc_id", "text", F.posexplode(T.fixed_windows(t, 800, 100)).alias("idx", "w"))
    low = F.greatest(F.lit(1), F.col("w.start") - 199)
    key = F.md5(F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(": "), F.substring(t, 1, 2000)))
    return c.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5(F.substring(t, low, F.col("w.start") + 1001 - low)).alias("digest"), key.alias("cache_key"))


@query("SELECT p_partkey, round(0.3 * p_size / 50 + 0.4 * p_retailprice / 2000 + 0.2 * least(1, length(p_name) / 10) + 0.1 * least(1, (p_size % 5) / 3), 6) AS confidence FROM part")
def r27_intent_confidence(spark, d):
    c = context.intent_confidence(F.col("p_size") / 50, F.col("p_retailprice") / 2000, F.length("p_name"), F.col("p_size") % 5)
    return table(spark, d, "part").select("p_partkey", F.round(c, 6).alias("confidence"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'figure|chart|table|diagram|image|图') AS visual, array_to_string(list_distinct(regexp_extract_all(lower(text), 'page ([0-9]+)', 1))[1:4], ',') AS pages FROM conversations""")
def r35_pdf_modality(spark, d):
    t = F.lower("text")
    pages = F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit("page ([0-9]+)"), F.lit(1))), 1, 4)
    return table(spark, d, "conversations").select("conv_id", "turn", t.rlike("figure|chart|table|diagram|image|图").alias("visual"), F.array_join(pages, ",").alias("pages"))


_TYPES = "CASE p_type WHEN 'ECONOMY' THEN 'PERSON' WHEN 'SMALL' THEN 'OTHER' ELSE p_type END"


@query(f"""WITH e AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_brand) AS alias, {_TYPES} AS type FROM part), q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 100 = 0 THEN lower(p_brand) ELSE lower(p_name) END AS name, {_TYPES} AS type FROM part WHERE p_partkey % 50 = 0),
 j AS (SELECT query_id, id, q.name = alias AS by_alias, q.name = e.name AS exact, q.type = e.type AS same, (q.type = 'PERSON' AND e.type = 'OTHER') OR (q.type = 'OTHER' AND e.type = 'PERSON') AS person, q.type = e.type OR 'OTHER' IN (q.type, e.type) AS loose,
  len(list_intersect(string_split(q.name, ''), string_split(e.name, ''))) / len(list_distinct(list_concat(string_split(q.name, ''), string_split(e.name, '')))) > 0.5 OR len(list_intersect(string_split(q.name, ''), string_split(alias, ''))) / len(list_distinct(list_concat(string_split(q.name, ''), string_split(alias, '')))) > 0.6 AS alike FROM q, e),
 s AS (SELECT query_id, id, CASE WHEN by_alias AND (same OR person) THEN 1 WHEN by_alias THEN 3 WHEN exact AND same THEN 2 WHEN exact OR (loose AND alike) THEN 4 END AS level FROM j)
 SELECT query_id, id, level, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, CASE WHEN level = 1 THEN -id ELSE id END) AS rank FROM s WHERE level IS NOT NULL) WHERE rank <= 5""")
def r16_entity_lookup(spark, d):
    """Aliases before names before likeness, each with the same type first; equal rows are compared once."""
    kind = F.when(F.col("p_type") == "ECONOMY", "PERSON").when(F.col("p_type") == "SMALL", "OTHER").otherwise(F.col("p_type"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.lower("p_brand").alias("alias"), kind.alias("type"))
    asked = p.where("id % 50 = 0").select(F.struct(F.col("id").alias("query_id"), F.when(F.col("id") % 100 == 0, F.col("alias")).otherwise(F.col("name")).alias("asked"), F.col("type").alias("asked_type")).alias("q"))
    return context.looked_up(p, asked, 5)


@query("""WITH q AS (SELECT p_partkey, p_brand AS name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'none such ' || p_partkey FROM part WHERE p_partkey % 3 = 2),
 a AS (SELECT p_brand AS name, min(p_name) AS standard FROM part GROUP BY 1), n AS (SELECT DISTINCT p_name AS name FROM part)
 SELECT p_partkey, coalesce(a.standard, n.name, q.name) AS standard, CASE WHEN a.name IS NOT NULL THEN 'alias' WHEN n.name IS NOT NULL THEN 'exact' ELSE 'self' END AS how, CAST(1 AS DOUBLE) AS confidence FROM q LEFT JOIN a USING (name) LEFT JOIN n ON n.name = q.name""")
def r17_f24_entity_validation(spark, d):
    """An alias becomes its standard name, a known name and an unknown one stay."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    asked = p.select("p_partkey", F.when(k == 0, F.col("p_brand")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("none such "), F.col("p_partkey").cast("string"))).alias("name"))
    alias = p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_name").alias("a"))
    names = p.select(F.col("p_name").alias("name"), F.lit(True).alias("n")).distinct()
    j = asked.join(alias, "name", "left").join(names, "name", "left")
    return j.select("p_partkey", F.coalesce("a", "name").alias("standard"), F.when(F.col("a").isNotNull(), "alias").when(F.col("n"), "exact").otherwise("self").alias("how"), F.lit(1.0).alias("confidence"))


@query(f"""WITH {_EVIDENCE}, x AS (SELECT query_id, id, text FROM ev WHERE lane = 'lexical'), ww AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split(lower(text), ' '), lambda t: length(t) > 4)) AS w FROM benchmark WHERE item_id % 50 = 0),
 hc AS (SELECT ww.query_id, w, max(CAST(contains(lower(x.text), w) AS INT)) AS hit FROM ww LEFT JOIN x USING (query_id) GROUP BY ALL), hk AS (SELECT query_id, round(avg(coalesce(hit, 0)), 6) AS coverage FROM hc GROUP BY 1),
 hu AS (SELECT query_id, count(*) AS n, 1 - count(DISTINCT md5(text)) / count(*) AS repeated FROM x GROUP BY 1) SELECT query_id, coverage, round(repeated, 6) AS repeated, n > 0 AND repeated <= 0.7 AND coverage >= 0.3 AS valid FROM hk JOIN hu USING (query_id)""")
def r19_evidence_validation(spark, d):
    """Share of the query's longer words that some evidence holds, and of evidence that repeats other texts."""
    hits = _bm25(spark, d, 10).select("query_id", F.col("doc_id").alias("id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"), F.md5("text").alias("digest"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda t: F.length(t) > 4))
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.explode(words).alias("w"))
    e = hits.join(docs, "id")
    hit = asked.join(e, "query_id", "left").groupBy("query_id", "w").agg(F.max(F.col("text").contains(F.col("w")).cast("int")).alias("hit"))
    k = hit.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage"))
    u = e.groupBy("query_id").agg((1 - F.countDistinct("digest") / F.count("*")).alias("r"))
    return k.join(u, "query_id").select("query_id", "coverage", F.round("r", 6).alias("repeated"), ((F.col("r") <= 0.7) & (F.col("coverage") >= 0.3)).alias("valid"))


_NAMES_SQL = "list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))"
_WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) > 4))"


@query(f"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM m WHERE role = 'assistant' GROUP BY 1), o AS (SELECT conv_id, arg_min(text, turn) AS text FROM m WHERE role = 'user' GROUP BY 1),
 s AS (SELECT conv_id, lower(text) AS low, {_NAMES_SQL} AS names, {_WORDS_SQL} AS words FROM c), f AS (SELECT conv_id, {_WORDS_SQL} AS words FROM o), q AS (SELECT conv_id, turn, text, {_NAMES_SQL} AS names, {_WORDS_SQL} AS words FROM m WHERE role = 'user'),
 j AS (SELECT q.conv_id, q.turn, q.names AS n, q.words AS w, list_filter(q.names, lambda e: len(list_filter(s.names, lambda x: contains(lower(x), lower(e)) OR contains(lower(e), lower(x)))) > 0) AS fe, list_filter(q.words, lambda k: len(list_filter(s.words, lambda x: contains(x, k) OR contains(k, x))) > 0) AS fk,
  list_filter(q.words, lambda k: list_contains(f.words, k)) AS dk, list_filter(q.names, lambda e: NOT contains(low, lower(e)) AND len(list_filter(regexp_split_to_array(low, '\\s+'), lambda x: contains(lower(e), x))) = 0) AS miss FROM q JOIN s USING (conv_id) JOIN f USING (conv_id)),
 v AS (SELECT conv_id, turn, CASE WHEN len(n) > 0 THEN len(fe) / len(n) ELSE 0 END AS entity, CASE WHEN len(w) > 0 THEN len(fk) / len(w) ELSE 0 END AS keyword, len(fk) AS found, len(w) > 0 AND len(dk) / len(w) > 0.7 AS repeated, len(n) > 0 AND len(miss) / len(n) > 0.3 AS invented FROM j)
 SELECT conv_id, turn, round(entity, 6) AS entity_coverage, round(keyword, 6) AS keyword_coverage, repeated, invented, (greatest(entity, keyword) >= 0.3 OR found >= 2) AND NOT repeated AND NOT invented AS valid, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN (greatest(entity, keyword) >= 0.3 OR found >= 2) AND NOT repeated AND NOT invented THEN 0 ELSE 1 END, round(greatest(entity, keyword), 9) DESC, turn) AS place FROM v""")
def r19_question_validation(spark, d):
    """Each user message as a candidate question against the answers of its conversation: names and keywords that these hold, repeats of the first question, names they do not have."""
    m = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))  # a conversation's turns
    evidence = m.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("evidence"))
    first = m.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("original"))
    asked = m.where("role = 'user'").join(evidence, "conv_id").join(first, "conv_id")
    checked = context.question_checks(asked, F.col("text"), F.col("evidence"), F.col("original"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("valid"), F.desc(F.round(F.greatest("entity_coverage", "keyword_coverage"), 9)), "turn")
    return checked.select("conv_id", "turn", F.round("entity_coverage", 6).alias("entity_coverage"), F.round("keyword_coverage", 6).alias("keyword_coverage"), "repeated", "invented", "valid", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {_EVIDENCE}, x AS (SELECT query_id, id, s, text FROM ev WHERE lane = 'dense' AND s IS NOT NULL), ww AS (SELECT item_id AS query_id, list_filter(string_split(lower(text), ' '), lambda t: length(t) > 4) AS w FROM benchmark WHERE item_id % 50 = 0)
 SELECT query_id, id FROM x JOIN ww USING (query_id) WHERE s >= 0.2 AND (s > 0.5 OR len(list_filter(w, lambda t: contains(lower(text), t))) > 0)""")
def p11_keyword_relevance(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    words = F.filter(F.split(F.lower("text"), " "), lambda t: F.length(t) > 4)
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), words.alias("w"))
    hits = _dense(spark, d, 10).where("id % 89 != 0").join(docs, "id").join(asked, "query_id")
    return hits.where((F.col("score") >= 0.2) & ((F.col("score") > 0.5) | F.exists("w", lambda t: F.col("text").contains(t)))).select("query_id", "id")


@query("""WITH m AS (SELECT item_id, text, unnest(string_split(lower(text), ' ')) AS name FROM benchmark UNION ALL SELECT item_id, text, 'made' || item_id FROM benchmark) SELECT item_id, name FROM m WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), name) AND name <> ''""")
def p10_hallucinated_entities(spark, d):
    """Names that the query holds; others (here one made up for each) go."""
    b = table(spark, d, "benchmark")
    names = b.select("item_id", "text", F.explode(F.concat(F.split(F.lower("text"), " "), F.array(F.concat(F.lit("made"), F.col("item_id").cast("string"))))).alias("name")).where("name != ''")
    return names.where(F.lower(T.collapsed(F.col("text"))).contains(F.col("name"))).select("item_id", "name")


@query("""WITH t AS (SELECT item_id, lower(text) AS t, length(text) AS n FROM benchmark) SELECT item_id, CASE WHEN regexp_matches(t, '^(hi|hello|你好)\\b') THEN 'chat' WHEN regexp_matches(t, 'why|how|explain|compare') THEN 'reasoning' WHEN n > 200 THEN 'reasoning' END AS intent,
 CAST(CASE WHEN regexp_matches(t, '^(hi|hello|你好)\\b') THEN 0.95 WHEN regexp_matches(t, 'why|how|explain|compare') THEN 0.9 WHEN n > 200 THEN 0.8 END AS DOUBLE) AS confidence FROM t""")
def f25_rule_intent(spark, d):
    t = F.lower("text")
    rules = ((t.rlike(r"^(hi|hello|你好)\b"), "chat", 0.95), (t.rlike("why|how|explain|compare"), "reasoning", 0.9), (F.length("text") > 200, "reasoning", 0.8))
    intent, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for rule, name, c in rules:
        intent, sure = intent.when(rule, name), sure.when(rule, c)
    return table(spark, d, "benchmark").select("item_id", intent.alias("intent"), sure.alias("confidence"))


_CATEGORIES = {"tech": [("data", 2.0), ("code", 1.5)], "law": [("law", 2.0), ("court", 1.0)], "trade": [("price", 1.0), ("market", 1.0), ("order", 0.5)]}
_COUNTED = ", ".join("(" + " + ".join(f"len(regexp_extract_all(t, '{w}')) * {x}" for w, x in ws) + f") AS {k}" for k, ws in _CATEGORIES.items())
_HITS = ", ".join("(" + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w, _ in ws) + f") AS {k}" for k, ws in _CATEGORIES.items())


@query(f"WITH c AS (SELECT doc_id, {_COUNTED} FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, " + ", ".join(f"round(CASE WHEN greatest(tech, law, trade) > 0 THEN {k} / greatest(tech, law, trade) ELSE 0 END, 6) AS {k}" for k in _CATEGORIES) + " FROM c")
def f26_category_scores(spark, d):
    t = F.lower("text")
    raw = {k: context.keyword_score(t, ws) for k, ws in _CATEGORIES.items()}
    top = F.greatest(*raw.values())
    return table(spark, d, "documents").select("doc_id", *(F.round(F.coalesce(F.try_divide(c, top), F.lit(0.0)), 6).alias(k) for k, c in raw.items()))


@query(f"WITH c AS (SELECT doc_id, {_COUNTED} FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, " + ", ".join(f"round(CASE WHEN tech + law + trade > 0 THEN {k} / (tech + law + trade) ELSE 0 END, 6) AS {k}" for k in _CATEGORIES) + " FROM c")
def f27_intent_shares(spark, d):
    t = F.lower("text")
    raw = {k: context.keyword_score(t, ws) for k, ws in _CATEGORIES.items()}
    whole = sum(raw.values())
    return table(spark, d, "documents").select("doc_id", *(F.round(F.coalesce(F.try_divide(c, whole), F.lit(0.0)), 6).alias(k) for k, c in raw.items()))


@query(f"WITH c AS (SELECT doc_id, {_HITS} FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, CASE WHEN greatest(tech, law, trade) = 0 THEN 'general' WHEN tech = greatest(tech, law, trade) THEN 'tech' WHEN law = greatest(tech, law, trade) THEN 'law' ELSE 'trade' END AS domain, round(CAST(least(0.95, 0.3 + 0.15 * greatest(tech, law, trade)) AS DOUBLE), 2) AS confidence FROM c")
def f29_domain_recognition(spark, d):
    t = F.lower("text")
    hits = {k: sum((t.contains(w).cast("int") for w, _ in ws), F.lit(0)) for k, ws in _CATEGORIES.items()}
    top = F.greatest(*hits.values())
    domain = F.when(top == 0, "general")
    for k, n in hits.items():
        domain = domain.when(n == top, k)
    return table(spark, d, "documents").select("doc_id", domain.alias("domain"), F.round(F.least(F.lit(0.95), 0.3 + 0.15 * top), 2).alias("confidence"))


@query("""WITH m AS (SELECT conv_id, turn, 'quoted' AS kind, unnest(regexp_extract_all(text, '"([^"]+)"', 1)) AS name FROM conversations UNION ALL SELECT conv_id, turn, 'measure', unnest(regexp_extract_all(text, '[0-9]+ ?(?:kg|km|MB|GB|ms|%)')) FROM conversations
 UNION ALL SELECT conv_id, turn, 'capital', unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) FROM conversations) SELECT conv_id, turn, kind, name, count(*) AS n FROM m GROUP BY ALL""")
def f22_entity_patterns(spark, d):
    c, t = table(spark, d, "conversations"), F.col("text")
    kinds = {"quoted": F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1)), "measure": T.matches(t, "[0-9]+ ?(?:kg|km|MB|GB|ms|%)"), "capital": T.matches(t, "[A-Z][a-z]+(?: [A-Z][a-z]+)*")}

    def named(kind: str, found):
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    return c.select("conv_id", "turn", F.explode(F.flatten(F.array(*(named(*kv) for kv in kinds.items())))).alias("m")).groupBy("conv_id", "turn", "m.kind", "m.name").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '') AS pascal, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), '_') AS snake FROM part""")
def f32_identifiers(spark, d):
    words = T.matches(F.lower("p_name"), "[a-z0-9]+")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "").alias("pascal"), F.array_join(words, "_").alias("snake"))


# lists and lanes of lines


@query(f"WITH {_LANES} SELECT query_id, lane, id, rank FROM k")
def w1_lane_ranks(spark, d):
    return _lanes(spark, d).select("query_id", "lane", "id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_LANES}, m AS (SELECT query_id, lane, min(score) AS lo, max(score) AS hi FROM h GROUP BY ALL) SELECT query_id, lane, id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS scaled FROM h JOIN m USING (query_id, lane)")
def w2_lane_scaling(spark, d):
    w = Window.partitionBy("query_id", "lane")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return _lanes(spark, d).select("query_id", "lane", "id", F.round(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0), 6).alias("scaled"))


@query(f"WITH {_LANES}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lane, rank) AS n FROM k) SELECT query_id, lane, id FROM o WHERE n <= 5")
def w18_evidence_cap(spark, d):
    """Five for each query over all lanes, in the plan's order of lanes."""
    w = Window.partitionBy("query_id").orderBy("lane", "rank")
    return _lanes(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_id", "lane", "id")


@query(f"WITH {_LANES} SELECT query_id, id, arg_min(lane, rank * 2 + CAST(lane = 'quantity' AS INT)) AS lane FROM k GROUP BY ALL")
def u5_first_occurrence(spark, d):
    """Lanes in turn by rank: an id's first occurrence stays."""
    order = F.struct("rank", "lane")
    return _lanes(spark, d).groupBy("query_id", "id").agg(F.min_by("lane", order).alias("lane"))


@query(f"WITH {_LANES}, f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 12) AS s, min(rank) AS seen FROM k GROUP BY ALL) SELECT query_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, seen, id) AS place FROM f) WHERE place <= 10")
def o4_fusion_sort(spark, d):
    f = _lanes(spark, d).groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (60 + F.col("rank"))), 12).alias("s"), F.min("rank").alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "seen", "id")
    return f.withColumn("place", F.row_number().over(w)).where("place <= 10").select("query_id", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_LANES} SELECT query_id, id, round(sum(0.5 / (60 + rank)), 9) AS total FROM k GROUP BY ALL")
def g37_reciprocal_rank_sum(spark, d):
    return _lanes(spark, d).groupBy("query_id", "id").agg(F.round(F.sum(F.lit(0.5) / (60 + F.col("rank"))), 9).alias("total"))


@query(f"WITH {_LANES}, b AS (SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS new_rank, score FROM k WHERE lane = 'price') SELECT query_id, id, new_rank, round(score, 4) AS score FROM b")
def j9_j10_reordered(spark, d):
    """A permutation of ids with new places, joined back to the rows it came from; every row is met once."""
    rows = _lanes(spark, d).where("lane = 'price'")
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"))
    order = rows.select("query_id", "id", F.row_number().over(w).cast("long").alias("new_rank"))
    return rows.join(order, ["query_id", "id"]).select("query_id", "id", "new_rank", F.round("score", 4).alias("score"))


@query("""WITH s AS (SELECT l_orderkey AS q, l_partkey AS id, l_linenumber AS pos, l_quantity AS score FROM lineitem), f AS (SELECT q, id, min(pos) AS pos FROM s GROUP BY ALL), l AS (SELECT q, id, arg_max(score, pos * 1000 + score) AS score FROM s GROUP BY ALL)
 SELECT q, id, score, rank FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos, id) AS rank FROM f JOIN l USING (q, id)) WHERE rank <= 5""")
def u1_u2_union_last_row(spark, d):
    """Of an id met several times the first place and the last row stay; then the best five."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("score"))
    u = li.groupBy("q", "id").agg(F.min("pos").alias("pos"), F.max_by("score", F.struct("pos", "score")).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "pos", "id")
    return u.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("q", "id", "score", "rank")


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def o9_o3_validated_first(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("o_custkey", "o_orderkey", "place")


@query("""WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS seen FROM lineitem GROUP BY ALL) SELECT l.l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY seen, l.l_suppkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) AS place FROM lineitem l JOIN f ON l.l_orderkey = f.l_orderkey AND l.l_suppkey = f.l_suppkey""")
def o8_order_by_first_seen(spark, d):
    """Groups (here suppliers) in the order in which they first come, then by their own keys."""
    seen = F.min("l_linenumber").over(Window.partitionBy("l_orderkey", "l_suppkey"))
    li = table(spark, d, "lineitem").withColumn("seen", seen)
    w = Window.partitionBy("l_orderkey").orderBy("seen", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT c_custkey, field, place FROM (SELECT c_custkey, field, row_number() OVER (PARTITION BY c_custkey ORDER BY pri, field) AS place FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation', 'balance']) AS field, unnest([1, 3, 2, 3]) AS pri FROM customer))""")
def o12_constraint_priority(spark, d):
    listed = F.array(*(F.struct(F.lit(p).alias("pri"), F.lit(f).alias("field")) for f, p in (("name", 1), ("segment", 3), ("nation", 2), ("balance", 3))))
    return table(spark, d, "customer").select("c_custkey", F.posexplode(F.array_sort(listed)).alias("place", "c")).select("c_custkey", "c.field", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 20")
def o14_key_match(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").contains("a")).orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


@query("""WITH q AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 1) AS w FROM benchmark WHERE item_id % 50 = 0), h AS (SELECT item_id, doc_id, w, list_filter(w, lambda t: contains(lower(text), t)) AS hit FROM q, documents)
 SELECT item_id, doc_id, len(list_distinct(hit)) AS terms, round(100.0 * len(hit) / len(w), 1) AS percent FROM h WHERE len(hit) > 0""")
def c2_match_reasons(spark, d):
    """Terms of the stated queries in each document; the queries go to every task as one list."""
    words = F.filter(F.split(F.lower("text"), " "), lambda t: F.length(t) > 1)
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").agg(F.collect_list(F.struct("item_id", words.alias("w"))).alias("all")).withColumn("one", F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"), F.lit(1).alias("one"))
    met = docs.join(F.broadcast(asked), "one").select("doc_id", "text", F.explode("all").alias("q"))  # the query set: a fiftieth of the items
    hit = F.filter("q.w", lambda t: F.col("text").contains(t))
    return met.select("q.item_id", "doc_id", hit.alias("hit"), F.size("q.w").alias("of")).where(F.size("hit") > 0).select("item_id", "doc_id", F.size(F.array_distinct("hit")).cast("long").alias("terms"), F.round(100 * F.size("hit") / F.col("of"), 1).alias("percent"))


@query("""WITH a AS (SELECT p_partkey AS i, lower(p_type) AS t FROM part WHERE p_partkey % 50 = 0), b AS (SELECT p_partkey AS j, lower(p_type) AS u FROM part),
 s AS (SELECT i, j, CASE WHEN t = u THEN 1 WHEN contains(t, u) OR contains(u, t) THEN 0.8 * least(length(t), length(u)) / greatest(length(t), length(u)) ELSE (1 - levenshtein(t, u) / greatest(length(t), length(u))) * 0.7 + 0.3 / (1 + abs(i - j) * 0.001) END AS s FROM a, b) SELECT i, j, round(s, 6) AS similarity FROM s WHERE s > 0.3""")
def j14_token_pairs(spark, d):
    """Tokens of the query set against all tokens."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.lower("p_type").alias("u"))
    asked = p.where("j % 50 = 0").select(F.col("j").alias("i"), F.col("u").alias("t"))
    return context.similar_tokens(p, asked, 0.3).select("i", "j", F.round("s", 6).alias("similarity"))


@query()
def r7_capped_and_diverse(spark, d):
    """Source cap, then maximal marginal relevance; tested against plain loops."""
    e = table(spark, d, "embeddings")
    hits = ranking.vector_search(e, e.where("vec_id % 50 = 0"), 30).join(e.select(F.col("vec_id").alias("id"), "label", "embedding"), "id")
    w = Window.partitionBy("query_id", "label").orderBy("rank")
    capped = hits.withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")
    return ranking.mmr(capped, 10)


@query("""WITH e AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_brand) AS alias FROM part), q AS (SELECT id AS query_id, CASE WHEN id % 150 = 0 THEN alias WHEN id % 100 = 0 THEN left(name, length(name) - 2) ELSE name END AS q FROM e WHERE id % 50 = 0),
 m AS (SELECT query_id, id, CASE WHEN q = name THEN 1 WHEN q = alias THEN 2 WHEN (contains(name, q) OR contains(q, name)) AND abs(length(name) - length(q)) < 5 THEN 3 END AS level FROM q, e)
 SELECT query_id, id, level FROM m WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level, id) = 1""")
def r18_name_matching(spark, d):
    """A name's entity: equal, by alias, or one within the other with under five characters between; of equals the first."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.lower("p_brand").alias("alias"))
    k, n = F.col("id"), F.col("name")
    asked = p.where("id % 50 = 0").select(F.struct(k.alias("query_id"), F.when(k % 150 == 0, F.col("alias")).when(k % 100 == 0, F.substring(n, F.lit(1), F.length(n) - 2)).otherwise(n).alias("q")).alias("q"))
    return context.matched_names(p, asked)


@query(f"""WITH {_EVIDENCE}, x AS (SELECT query_id, lane, id, coalesce(s >= CASE lane WHEN 'dense' THEN 0.3 ELSE 8 END, false) AS good FROM ev) SELECT query_id, lane, id FROM x WHERE good OR query_id % 100 > 0""")
def r23_generation_subset(spark, d):
    """Where the policy is active (here queries divisible by 100) only qualified evidence goes on, else all of it."""
    dense, lexical = _two_lanes(spark, d)
    e = dense.unionByName(lexical).where("rank <= 10").withColumn("score", F.when(F.col("id") % 89 != 0, F.col("score")))
    good = F.coalesce(F.col("score") >= F.when(F.col("lane") == "dense", 0.3).otherwise(8.0), F.lit(False))
    return e.where(good | (F.col("query_id") % 100 > 0)).select("query_id", "lane", "id")


@query("""WITH c AS (SELECT conv_id, role || ': ' || left(text, 40) AS point, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) SELECT conv_id, 'Conversation ' || conv_id || chr(10) || string_agg(point, chr(10) ORDER BY n) AS candidate FROM c WHERE n <= 4 GROUP BY conv_id""")
def r31_focus_candidates(spark, d):
    """A description and the first four points."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 4").select("conv_id", "n", F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 40)).alias("point"))
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "point"))), lambda x: x["point"]), "\n")
    return c.groupBy("conv_id").agg(F.concat(F.lit("Conversation "), F.first("conv_id").cast("string"), F.lit("\n"), points).alias("candidate"))


@query("""WITH t AS (SELECT conv_id, turn, text, regexp_extract(text, '"([^"]+)"', 1) AS quoted, regexp_extract(text, '\\b((19|20)[0-9]{2})\\b', 1) AS year, regexp_extract(text, '\\b([A-Za-z]+[0-9]+)\\b', 1) AS code FROM conversations)
 SELECT conv_id, turn, CASE WHEN quoted <> '' THEN quoted WHEN code <> '' THEN code WHEN year <> '' THEN year END AS entity, CASE WHEN quoted <> '' THEN 'OTHER' WHEN code <> '' THEN 'PRODUCT' WHEN year <> '' THEN 'DATE' END AS type,
 CAST(CASE WHEN quoted <> '' THEN 0.7 WHEN code <> '' THEN 0.6 WHEN year <> '' THEN 0.9 END AS DOUBLE) AS confidence, CASE WHEN length(text) > 200 THEN 'complex' WHEN length(text) > 60 THEN 'medium' ELSE 'simple' END AS complexity FROM t""")
def f23_fallback_parse(spark, d):
    """Without a model: quoted words, then codes of letters and digits, then years; and how long the text is."""
    t = F.col("text")
    found = [(F.regexp_extract(t, '"([^"]+)"', 1), "OTHER", 0.7), (F.regexp_extract(t, r"\b([A-Za-z]+[0-9]+)\b", 1), "PRODUCT", 0.6), (F.regexp_extract(t, r"\b((19|20)[0-9]{2})\b", 1), "DATE", 0.9)]
    entity, kind, sure = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for value, name, c in found:
        entity, kind, sure = entity.when(value != "", value), kind.when(value != "", name), sure.when(value != "", c)
    size = F.when(F.length(t) > 200, "complex").when(F.length(t) > 60, "medium").otherwise("simple")
    return table(spark, d, "conversations").select("conv_id", "turn", entity.alias("entity"), kind.alias("type"), sure.alias("confidence"), size.alias("complexity"))
