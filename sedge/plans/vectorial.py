"""Vector functions, contributions and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import analysis as A
from sedge.functions import text as T
from sedge.functions import vectors as V
from sedge.operators import aggregates, ranking, vector_index
from sedge.plans.registry import query, table
from sedge.streaming.shared import kept

#: Each vector beside the one with the next id, by an equi-join on the id.
_NEXT = """n AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _next(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"""WITH {_NEXT}, s AS (SELECT vec_id, list_dot_product(x, y) AS p, sqrt(list_dot_product(x, x)) AS a, sqrt(list_dot_product(y, y)) AS b FROM n)
 SELECT vec_id, round(p / (a * b), 6) AS plain, round(CASE WHEN a * b = 0 THEN 0 ELSE p / (a * b) END, 6) AS guarded, round(p / (a * b + 1e-8), 6) AS soft FROM s""")
def v1_v2_v3_cosines(spark, d):
    x, y = F.col("x"), F.col("y")
    return _next(spark, d).select("vec_id", F.round(V.plain_cosine(x, y), 6).alias("plain"), F.round(V.cosine(x, y), 6).alias("guarded"), F.round(V.soft_cosine(x, y), 6).alias("soft"))


@query(f"""WITH {_NEXT}, s AS (SELECT vec_id, list_cosine_similarity(x, y) AS c, list_dot_product(x, y) AS p, list_distance(x, y) AS l FROM n)
 SELECT vec_id, round(CASE WHEN c >= 0 AND c <= 1 THEN c ELSE 1 - c END, 6) AS cosine, round(p, 6) AS ip, round(1 / (1 + l), 6) AS l2 FROM s""")
def v5_metric_similarity(spark, d):
    x, y = F.col("x"), F.col("y")
    away = V.norm(F.zip_with(x, y, lambda a, b: a - b))
    raw = {"cosine": V.similarity(V.plain_cosine(x, y), "COSINE"), "ip": V.similarity(V.dot(x, y), "IP"), "l2": V.similarity(away, "L2")}
    return _next(spark, d).select("vec_id", *(F.round(c, 6).alias(k) for k, c in raw.items()))


@query("""WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
 SELECT vec_id, round(sqrt(sum(x * x)), 6) AS l2, round(sum(abs(x)), 6) AS l1, round(max(abs(x)), 6) AS top, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(avg(CAST(abs(x) <= 1e-6 AS INT)), 6) AS sparsity FROM e GROUP BY 1""")
def v7_static_weight(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *(F.round(c, 6).alias(k) for k, c in V.static_weight(V.doubles("embedding")).items()))


@query("""WITH e AS (SELECT vec_id, abs(unnest(CAST(embedding AS DOUBLE[]))) AS x FROM embeddings), p AS (SELECT vec_id, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e)
 SELECT vec_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS bits FROM p GROUP BY 1""")
def f44_vector_entropy(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.entropy(V.doubles("embedding")), 6).alias("bits"))


@query("""WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT vec_id, avg(x) AS mean, stddev_pop(x) AS s FROM e GROUP BY 1)
 SELECT vec_id, round(avg(((x - mean) / s) ** 3), 6) AS skewness, round(avg(((x - mean) / s) ** 4) - 3, 6) AS kurtosis FROM e JOIN m USING (vec_id) GROUP BY 1""")
def f45_moments(spark, d):
    s = V.statistics(V.doubles("embedding"))
    return table(spark, d, "embeddings").select("vec_id", *(F.round(s[k], 6).alias(k) for k in ("skewness", "kurtosis")))


#: Contribution of the vector after to each: cosine times its length.
_SHARE = f"""{_NEXT}, c AS (SELECT vec_id, vec_id // 20 AS grp, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-8) * sqrt(list_dot_product(x, x)) AS c FROM n)"""


@query(f"""WITH {_SHARE} SELECT vec_id, round(c, 6) AS contribution, round(c / sum(abs(c)) OVER w, 6) AS share, c > avg(abs(c)) OVER w * 1.5 AS is_key FROM c WINDOW w AS (PARTITION BY grp)""")
def v12_w13_contributions(spark, d):
    """Groups of twenty ids stand for the tokens of a query."""
    x, y = F.col("x"), F.col("y")
    c = _next(spark, d).select("vec_id", F.floor(F.col("vec_id") / 20).alias("grp"), (V.soft_cosine(x, y) * V.norm(x)).alias("c"))
    w = Window.partitionBy("grp")
    size = F.abs("c")
    return c.select("vec_id", F.round("c", 6).alias("contribution"), F.round(F.col("c") / F.sum(size).over(w), 6).alias("share"), (F.col("c") > F.avg(size).over(w) * 1.5).alias("is_key"))


@query("""SELECT p_partkey, round(list_sum(list_transform(range(1, 17), lambda i: sin(p_size * i * 0.01) * 0.5 * (1 + p_retailprice / 1000))), 6) AS total FROM part""")
def v13_pseudo_embedding(spark, d):
    v = V.pseudo_embedding(F.col("p_size"), F.col("p_retailprice") / 1000, 16)
    return table(spark, d, "part").select("p_partkey", F.round(V.total(v), 6).alias("total"))


@query("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
 h AS (SELECT item_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM t),
 s AS (SELECT item_id, h % 32 AS k, sum(CASE WHEN (h // 32) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
 SELECT item_id, k, round(CASE WHEN n > 0 THEN x / n ELSE 0 END, 6) AS value FROM s JOIN n USING (item_id)""")
def v15_hashing_embedding(spark, d):
    """Sparse: one row for each dimension that a token falls in."""
    t = table(spark, d, "benchmark").select("item_id", F.explode(T.matches(F.lower("text"), "[a-z0-9]+")).alias("t"))
    h = t.select("item_id", T.fnv1a(F.col("t")).alias("h"))
    s = h.groupBy("item_id", (F.col("h") % 32).alias("k")).agg(F.sum(F.when(F.floor(F.col("h") / 32) % 2 == 0, 1).otherwise(-1)).alias("x"))
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))
    return s.select("item_id", "k", F.round(F.when(n > 0, F.col("x") / n).otherwise(0.0), 6).alias("value"))


# whole queries: a vector with the document of its id

#: Prototypes of categories; words, weights and patterns are a parameter of the functions.
_PROTOTYPES = (
    A.Prototype("technology", ("model", "data", "code", "system", "api", "tion"), 1.2, "tech", True, True, True), A.Prototype("engineering", ("function", "test", "build", "deploy", "server"), 1.1, "tech", True, False, True),
    A.Prototype("business", ("market", "price", "order", "customer", "con"), 1.0, "business", False, True, False), A.Prototype("research", ("theory", "study", "method", "result", "ver"), 1.0, "academic", False, False, True),
    A.Prototype("daily", ("home", "food", "day", "the ", "que "), 0.9, "daily", False, True, False), A.Prototype("emotion", ("love", "happy", "sad", "like", "und "), 0.9, "emotion", True, True, False), A.Prototype("general", ("what", "how", "which", "why"), 0.7),
)


def _words_sql(p: A.Prototype) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{w.lower()}') AS INT)" for w in p.words) + ")"


_RAW = {k: " + ".join(f"{_words_sql(p)} * {p.weight}" for p in _PROTOTYPES if p.score == k) or "0" for k in A.SCORES}
_ANALYSED = f"""e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), a AS (SELECT vec_id, avg(x) AS mean, var_pop(x) AS var, sum(abs(x)) AS l1, sqrt(sum(x * x)) AS l2, avg(CAST(abs(x) < 0.01 AS INT)) AS sparsity, count(*) AS n FROM e GROUP BY 1),
 m AS (SELECT vec_id, any_value(mean) AS mean, any_value(var) AS var, any_value(l2) AS l2, any_value(sparsity) AS sparsity, any_value(n) AS n, avg((x - mean) ** 3) / any_value(var) ** 1.5 AS skew, avg((x - mean) ** 4) / any_value(var) ** 2 - 3 AS kurt, -sum(CASE WHEN x = 0 THEN 0 ELSE abs(x) / l1 * log2(abs(x) / l1) END) AS bits FROM e JOIN a USING (vec_id) GROUP BY vec_id),
 b AS (SELECT m.*, CAST(embedding AS DOUBLE[]) AS v, lower(coalesce(text, '')) AS t FROM m JOIN embeddings USING (vec_id) LEFT JOIN documents ON doc_id = vec_id),
 k AS (SELECT *, {", ".join(f"CAST({c} AS DOUBLE) AS r_{k}" for k, c in _RAW.items())}, {", ".join(f"sqrt(list_sum(list_transform(v[{i} * (n // 5) + 1:{'n' if i == 4 else f'{i + 1} * (n // 5)'}], lambda x: x * x))) AS e{i}" for i in range(5))} FROM b),
 q AS (SELECT *, greatest({", ".join(f"r_{k}" for k in A.SCORES)}, 1.0) AS most, (e0 + e1 + e2 + e3 + e4) / 5 AS energy FROM k)"""


def _analysed(spark, d) -> tuple[DataFrame, dict]:
    """Vectors with the text of the document of their id, and their statistics."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("v")).join(docs, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({f"s_{k}": c for k, c in V.statistics(F.col("v")).items()})
    return rows, {k: F.col(f"s_{k}") for k in V.statistics(F.col("v"))}


@query(f"""WITH {_ANALYSED}, f AS (SELECT vec_id, 1 / (1 + exp(-(r_tech / most * 3 + var * 10 + (e0 + e1) / l2 * 2 - 2))) AS tech, 1 / (1 + exp(-(r_business / most * 3 + abs(mean) * 5 + e2 / l2 * 2 - 2))) AS business, 1 / (1 + exp(-(r_daily / most * 3 + (1 - var) * 0.5 + (1 - kurt * 0.1) - 1.5))) AS daily,
 1 / (1 + exp(-(r_emotion / most * 3 + abs(skew) * 0.5 + e4 / l2 * 2 - 2))) AS emotion, 1 / (1 + exp(-(r_academic / most * 3 + bits * 0.1 + (1 - abs(skew) * 0.3) - 2))) AS academic, least(1, bits / log2(n) * (1 - sparsity)) AS density, least(1, greatest(e0, e1, e2, e3, e4) / energy / 3) AS clarity FROM q)
 SELECT vec_id, round(tech, 4) AS tech, round(business, 4) AS business, round(daily, 4) AS daily, round(emotion, 4) AS emotion, round(academic, 4) AS academic, round(density, 4) AS density, round(clarity, 4) AS clarity FROM f""")
def v8_vector_features(spark, d):
    rows, stats = _analysed(spark, d)
    return rows.select("vec_id", *(F.round(c, 4).alias(k) for k, c in A.vector_features(F.col("v"), stats, F.col("text"), _PROTOTYPES).items()))


def _context_sql() -> str:
    def one(k: int, p: A.Prototype) -> str:
        like = f"CASE WHEN (var > 0.1) = {p.high_variance} THEN 0.33 ELSE 0 END + CASE WHEN (mean > 0) = {p.positive_bias} THEN 0.33 ELSE 0 END + CASE WHEN (kurt > 0) = {p.clustered} THEN 0.34 ELSE 0 END"
        return f"SELECT vec_id, {k} AS place, '{p.name}' AS name, CAST(({_words_sql(p)} * CAST(0.3 AS DOUBLE) + ({like}) * CAST(0.4 AS DOUBLE)) * CAST({p.weight} AS DOUBLE) AS DOUBLE) AS score FROM q"

    rows = " UNION ALL ".join(one(k, p) for k, p in enumerate(_PROTOTYPES))
    return f"{_ANALYSED}, c AS ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, place) AS r, sum(score) OVER (PARTITION BY vec_id) AS whole FROM c)"


@query(f"""WITH {_context_sql()} SELECT vec_id, max(CASE WHEN r = 1 THEN name END) AS category, round(max(CASE WHEN r = 1 THEN least(0.95, 0.3 + score / whole * 0.65) END), 4) AS confidence,
 string_agg(name, ',' ORDER BY r) FILTER (r <= 3) AS clusters, round(sum(score / whole) FILTER (r <= 3), 6) AS first_three FROM o GROUP BY vec_id""")
def v9_semantic_context(spark, d):
    """The best category of each query, how sure it is, and the first three."""
    rows, stats = _analysed(spark, d)
    scored = rows.select("vec_id", F.transform(A.context_scores(stats, F.col("text"), _PROTOTYPES), lambda x: F.struct(x["name"].alias("name"), F.round(x["score"], 9).alias("score"))).alias("scores"))
    c = A.context(F.col("scores"))
    whole, first = (F.aggregate(a, F.lit(0.0), lambda t, x: t + x["score"]) for a in (F.col("scores"), F.slice("scores", 1, 3)))
    return scored.select("vec_id", c["category"].alias("category"), F.round(c["confidence"], 4).alias("confidence"), F.array_join(F.transform(c["clusters"], lambda x: x["name"]), ",").alias("clusters"), F.round(first / whole, 6).alias("first_three"))


_QUALITY = """1 - bits / log2(n) AS specificity, sparsity * 0.5 + (1 - least(1, var * 10)) * 0.5 AS ambiguity, least(1, l2 / 10) * 0.5 + (1 - sparsity) * 0.5 AS retrievability"""


@query(f"""WITH {_ANALYSED}, z AS (SELECT vec_id, {_QUALITY} FROM q) SELECT vec_id, round(specificity, 4) AS specificity, round(ambiguity, 4) AS ambiguity, round(retrievability, 4) AS retrievability, round(specificity * 0.3 + (1 - ambiguity) * 0.3 + retrievability * 0.4, 4) AS quality FROM z""")
def v10_query_quality(spark, d):
    rows, stats = _analysed(spark, d)
    return rows.select("vec_id", *(F.round(c, 4).alias(k) for k, c in A.query_quality(F.col("v"), stats).items()))


@query(f"""WITH {_context_sql()}, y AS (SELECT vec_id, name FROM o WHERE r = 1), z AS (SELECT vec_id, t, l2, n, {_QUALITY} FROM q),
 w AS (SELECT *, length(regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS han, len(regexp_extract_all(t, '[a-z]+')) AS words, len(regexp_extract_all(t, '[0-9]+')) AS numbers, len(regexp_extract_all(t, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9_\\s]')) AS marks FROM z)
 SELECT vec_id, name AS category, CAST(n AS BIGINT) AS dimension, round(l2, 4) AS norm, round(specificity * 0.3 + (1 - ambiguity) * 0.3 + retrievability * 0.4, 4) AS quality, CAST(greatest(1, ceil(han * 0.7) + ceil(words * 1.5) + numbers + marks) AS BIGINT) AS tokens FROM w JOIN y USING (vec_id)""")
def v11_query_analysis(spark, d):
    """Vector, words and context of each query in one row."""
    rows, stats = _analysed(spark, d)
    t = F.lower("text")
    tokens = F.ceil(T.length_without(t, "[^\\u4e00-\\u9fff]") * 0.7) + F.ceil(F.size(T.matches(t, "[a-z]+")) * 1.5) + F.size(T.matches(t, "[0-9]+")) + F.size(T.matches(t, "[^\\u4e00-\\u9fffA-Za-z0-9_\\s]"))
    best = F.transform(A.context_scores(stats, F.col("text"), _PROTOTYPES), lambda x: F.struct(x["name"].alias("name"), F.round(x["score"], 9).alias("score")))
    return rows.select("vec_id", A.context(best)["category"].alias("category"), F.size("v").cast("long").alias("dimension"), F.round(stats["l2"], 4).alias("norm"), F.round(A.query_quality(F.col("v"), stats)["quality"], 4).alias("quality"), F.greatest(F.lit(1), tokens).cast("long").alias("tokens"))


@query(f"""WITH {_NEXT}, s AS (SELECT vec_id, list_dot_product(x, y) AS p, sqrt(list_dot_product(x, x)) AS a, sqrt(list_dot_product(y, y)) AS b, list_max(list_transform(x, lambda z: abs(z))) AS top, len(x) AS dimension FROM n)
 SELECT vec_id, CAST(dimension AS BIGINT) AS dimension, round(a, 6) AS l2, round(top, 6) AS top, round(abs(p / (a * b + 1e-8)), 6) AS relevance, round(p / (a * b + 1e-8), 6) AS similarity, round(p / (a * b + 1e-8) * a, 6) AS contribution FROM s""")
def x11_embedding_weights(spark, d):
    """Static weights of each vector and, towards the vector of the next id as its query, its dynamic importance."""
    x, y = F.col("x"), F.col("y")
    own = V.static_weight(x)
    cosine = V.soft_cosine(x, y)
    return _next(spark, d).select("vec_id", F.size("x").cast("long").alias("dimension"), F.round(own["l2"], 6).alias("l2"), F.round(own["top"], 6).alias("top"), F.round(F.abs(cosine), 6).alias("relevance"), F.round(cosine, 6).alias("similarity"), F.round(cosine * V.norm(x), 6).alias("contribution"))


# domains


def _domains(spark, d) -> tuple[DataFrame, DataFrame]:
    """Unit vectors, and the domains' centroids as rows: one for each label, joined by broadcast when Spark finds them small."""
    e = table(spark, d, "embeddings").select("vec_id", "label", V.unit(V.doubles("embedding")).alias("v"))
    x = table(spark, d, "embeddings").select("label", F.posexplode(V.doubles("embedding")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e, c.select(F.col("label").alias("domain"), V.unit(F.col("c")).alias("c"))


def _to_domains(spark, d) -> DataFrame:
    """vec_id, domain, s: every vector against every domain; the list of domains (one for each label) is joined to each row as a whole."""
    e, c = _domains(spark, d)
    one = F.lit(1).alias("one")
    listed = c.agg(F.collect_list(F.struct("domain", "c")).alias("all")).select(one, "all")
    return e.select("vec_id", "label", "v", one).join(listed, "one").select("vec_id", "label", "v", F.explode("all").alias("d")).select("vec_id", "label", F.col("d.domain").alias("domain"), V.dot(F.col("v"), F.col("d.c")).alias("s"))


_DOMAIN = """x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
 l AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), s AS (SELECT vec_id, embeddings.label, l.label AS domain, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings, l)"""


@query(f"WITH {_DOMAIN} SELECT vec_id, domain, round(s, 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, domain) AS rank FROM s")
def r26_domain_distribution(spark, d):
    w = Window.partitionBy("vec_id").orderBy(F.desc("s"), "domain")
    return _to_domains(spark, d).select("vec_id", "domain", F.round("s", 6).alias("score"), F.row_number().over(w).cast("long").alias("rank"))


@query(f"WITH {_DOMAIN} SELECT vec_id, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(max(s) - min(s), 6) AS spread FROM s GROUP BY vec_id")
def g21_domain_statistics(spark, d):
    return _to_domains(spark, d).groupBy("vec_id").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("std"), F.round(F.max("s") - F.min("s"), 6).alias("spread"))


@query(f"WITH {_DOMAIN} SELECT vec_id, domain, round(s - avg(s) OVER w, 6) AS lift, round((s - avg(s) OVER w) / stddev_pop(s) OVER w, 4) AS z FROM s WINDOW w AS (PARTITION BY vec_id)")
def w19_domain_lift(spark, d):
    w = Window.partitionBy("vec_id")
    over = F.col("s") - F.avg("s").over(w)
    return _to_domains(spark, d).select("vec_id", "domain", F.round(over, 6).alias("lift"), F.round(F.try_divide(over, F.stddev_pop("s").over(w)), 4).alias("z"))


@query(f"""WITH {_DOMAIN}, b AS (SELECT domain, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, domain) AS r FROM s), o AS (SELECT domain, s, row_number() OVER (PARTITION BY domain ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY domain) AS n FROM b WHERE r = 1)
 SELECT domain, round(avg(s), 6) AS mean, round(max(s), 6) AS high, round(min(s), 6) AS low, round(max(CASE WHEN k = n // 2 THEN s END), 6) AS median FROM o GROUP BY domain""")
def g20_upper_median(spark, d):
    """The median of an even number is the upper of the middle two: the value of ascending place n div 2."""
    near = _to_domains(spark, d).groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("domain")).alias("n"))).alias("b")).select((-F.col("b.n")).alias("domain"), "b.s")
    best = kept(near)
    means = best.groupBy("domain").agg(*(F.round(c, 6).alias(k) for k, c in (("mean", F.avg("s")), ("high", F.max("s")), ("low", F.min("s")))))
    return means.join(aggregates.order_statistics(best, ["domain"], "s", {"median": 0.5}, descending=True), "domain").withColumn("median", F.round("median", 6))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
 SELECT vec_id, i, round(x, 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS rank FROM e) WHERE rank <= 5""")
def o19_top_dimensions(spark, d):
    """In the row: no dimension leaves its vector."""
    entries = F.transform(V.doubles("embedding"), lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("i"), x.alias("x")))
    top = F.slice(F.array_sort(entries), 1, 5)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(top).alias("rank", "t")).select("vec_id", F.col("t.i").cast("long").alias("i"), F.round("t.x", 6).alias("value"), (F.col("rank") + 1).cast("long").alias("rank"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
 SELECT vec_id, i AS dimension FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x - 0.1), i) AS r FROM e) WHERE r = 1""")
def o22_closest_dimension(spark, d):
    entries = F.transform(V.doubles("embedding"), lambda x, i: F.struct(F.abs(x - 0.1).alias("away"), i.alias("i")))
    return table(spark, d, "embeddings").select("vec_id", F.array_min(entries)["i"].cast("long").alias("dimension"))


# searches

_FOUND = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, list_cosine_similarity(q.v, c.v) AS s FROM v q, v c WHERE q.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s)"""


@query(f"WITH {_FOUND} SELECT query_id, id, round(s, 6) AS score, rank FROM k WHERE rank <= 20 AND s >= 0.3")
def o2_p3_limit_then_threshold(spark, d):
    """The threshold holds after the limit, so a query may have fewer hits, or none."""
    e = table(spark, d, "embeddings")
    hits = ranking.vector_search(e, e.where("vec_id % 50 = 0"), 20)
    return hits.where("score >= 0.3").select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def o2_index_search(spark, d):
    """Ten rows of each query through an index, then those that are similar enough; lists are probed for a recall of 0.95."""
    e = table(spark, d, "embeddings")
    index = vector_index.build_index(e)
    hits = vector_index.index_search(index, e.where("vec_id % 50 = 0"), 10, vector_index.choose_probes(index, e, 10))
    return hits.where("score >= 0.3").select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_FOUND}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, id) AS r FROM s), b AS (SELECT query_id, label, max(s) AS top FROM s GROUP BY ALL),
 o AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY top DESC, label) AS grp FROM b)
 SELECT query_id, label, id, round(s, 6) AS score, grp, r AS place FROM g JOIN o USING (query_id, label) WHERE r <= 2 AND grp <= 3""")
def w5_grouped_search(spark, d):
    """The three best labels of each query, two hits of each."""
    e = table(spark, d, "embeddings")
    parts = ranking.grouped_vector_search(e, e.where("vec_id % 50 = 0"), "label", groups=3, size=2)
    return parts.select("query_id", F.col("label").cast("int").alias("label"), "id", F.round("score", 6).alias("score"), F.col("grp").cast("long").alias("grp"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_FOUND} SELECT query_id AS a, id AS b, round(s, 6) AS score FROM s WHERE query_id <> id ORDER BY s DESC, a, b LIMIT 100")
def o13_similarity_matrix(spark, d):
    """The hundred best pairs of a query and a row of the whole table; no query has more than a hundred of them, or itself and a hundred."""
    e = table(spark, d, "embeddings")
    pairs = ranking.vector_search(e, e.where("vec_id % 50 = 0"), 101).where("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")
    return pairs.orderBy(F.desc("score"), "a", "b").limit(100).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {_FOUND}, t AS (SELECT *, s >= 0.85 AS a, s >= 0.7 AS b, s >= 0.5 AS c, s >= 0.3 AS e FROM k WHERE rank <= 20)
 SELECT query_id, id, CASE WHEN a THEN 'very_high' WHEN b THEN 'high' WHEN c THEN 'medium' WHEN e THEN 'low' ELSE 'very_low' END AS band FROM t""")
def c3_similarity_bands(spark, d):
    e = table(spark, d, "embeddings")
    hits = ranking.vector_search(e, e.where("vec_id % 50 = 0"), 20)
    s = F.col("score")
    return hits.select("query_id", "id", F.when(s >= 0.85, "very_high").when(s >= 0.7, "high").when(s >= 0.5, "medium").when(s >= 0.3, "low").otherwise("very_low").alias("band"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, list_cosine_similarity(q.v, c.v) AS s FROM v q, v c WHERE q.vec_id % 50 = 0) SELECT query_id, count(*) AS compared, round(avg(s), 6) AS mean, round(max(s), 6) AS high FROM s GROUP BY 1""")
def j1_query_corpus_similarity(spark, d):
    """Every stored vector against each of the query set."""
    e = table(spark, d, "embeddings")
    s = ranking.similarity_summary(e, e.where("vec_id % 50 = 0"))
    return s.select("query_id", "compared", F.round("mean", 6).alias("mean"), F.round("high", 6).alias("high"))


@query(f"WITH {_DOMAIN} SELECT vec_id AS query_id, domain, round(s, 6) AS score FROM s WHERE vec_id % 50 = 0")
def j15_query_centroids(spark, d):
    return _to_domains(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "domain", F.round("s", 6).alias("score"))


@query(f"WITH {_FOUND}, r AS (SELECT query_id, id, round(0.5 * s + 0.5 * (id % 7) / 7, 6) AS score FROM k WHERE rank <= 20) SELECT query_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM r) WHERE place <= 5")
def o11_rerank_sort(spark, d):
    """The first twenty get new scores (here half of the old and a feature of the id); the best five of them."""
    e = table(spark, d, "embeddings")
    hits = ranking.vector_search(e, e.where("vec_id % 50 = 0"), 20)
    scored = hits.select("query_id", "id", F.round(0.5 * F.col("score") + 0.5 * (F.col("id") % 7) / 7, 6).alias("score"))
    return ranking.top(scored, ["query_id"], "score", "id", 5).withColumn("rank", F.col("rank").cast("long")).withColumnRenamed("rank", "place")
