"""Stores: scans, writes, deletes and listings as whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import tables
from sedge.plans.registry import query, table
from sedge.sources import files
from sedge.sources import containers
from sedge.streaming.shared import shared_dir

# writes


@query("SELECT vec_id, len(embedding) AS dimension, left('vector ' || vec_id || ' of ' || label, 12) AS content FROM embeddings")
def k1_k2_checked_insert(spark, d):
    """Rows to insert: one dimension for all, or the job fails; long fields are cut to what the store takes."""
    e = table(spark, d, "embeddings")
    content = F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" of "), F.col("label").cast("string"))
    return tables.checked_vectors(e, "embedding", 64).select("vec_id", F.size("embedding").cast("long").alias("dimension"), F.substring(content, 1, 12).alias("content"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def k3_delete_by_ids(spark, d):
    gone = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return tables.without(table(spark, d, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey < 5 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000))")
def k4_scoped_delete(spark, d):
    """Ids of other scopes stay, whatever the list says."""
    gone = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return tables.without(table(spark, d, "customer").select("c_custkey", "c_nationkey"), gone, ["c_custkey"], F.col("c_nationkey") < 5)


@query("WITH g AS (SELECT unnest(range(0, 40)) AS p_partkey) SELECT g.p_partkey, p.p_partkey IS NOT NULL AS deleted FROM g LEFT JOIN part p ON p.p_partkey = g.p_partkey")
def k10_delete_returning(spark, d):
    """Of the names given, which were there to delete."""
    there = table(spark, d, "part").select("p_partkey", F.lit(True).alias("deleted")).distinct()
    return spark.range(40).select(F.col("id").alias("p_partkey")).join(there, "p_partkey", "left").select("p_partkey", F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query("""WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1), x AS (SELECT min(c_custkey) AS k FROM customer WHERE c_name = 'Customer#000000005' OR c_custkey = 5)
 SELECT o_custkey, o_orderkey FROM u WHERE o_custkey <> coalesce((SELECT k FROM x), -1)""")
def k12_manifest_upsert_remove(spark, d):
    """The latest upload of each name; then one name, found by any of its fields, goes."""
    up = tables.latest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")
    c = table(spark, d, "customer").where("c_name = 'Customer#000000005' OR c_custkey = 5").orderBy("c_custkey").limit(1)
    return tables.without(up, c.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("""WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM documents WHERE doc_id % 5 > 0), i AS (SELECT doc_id, CASE WHEN doc_id % 2 > 0 THEN 'new' END AS source, lang FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0)
 SELECT doc_id, coalesce(i.source, s.source) AS source, coalesce(i.lang, s.lang) AS lang FROM s FULL JOIN i USING (doc_id)""")
def k13_completion_write(spark, d):
    """What the incoming row leaves null keeps its stored value."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    stored = docs.where(k % 5 > 0).select("doc_id", "source", F.when(k % 3 > 0, F.col("lang")).alias("lang"))
    incoming = docs.where((k % 4 == 0) | (k % 5 == 0)).select("doc_id", F.when(k % 2 > 0, "new").alias("source"), "lang")
    return tables.filled_upsert(stored, incoming, ["doc_id"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'open' ELSE 'made' END AS state FROM customer")
def k18_get_or_create(spark, d):
    """Sessions that are not there are made; those that are stay as they are."""
    c = table(spark, d, "customer")
    stored = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("open").alias("state"))
    return tables.missing_only(stored, c.select("c_custkey", F.lit("made").alias("state")), ["c_custkey"])


@query("""WITH l AS (SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY ALL) SELECT source, lang, doc_id, left(md5(text), 8) AS digest FROM l JOIN documents USING (doc_id, source, lang)""")
def k21_corpus_store(spark, d):
    """One document for each corpus and name: the latest."""
    docs = table(spark, d, "documents")
    return tables.latest(docs, ["source", "lang"], F.desc("doc_id")).select("source", "lang", "doc_id", F.substring(F.md5("text"), 1, 8).alias("digest"))


@query("""WITH m AS (SELECT doc_id, left(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), 12) AS id FROM documents) SELECT min(doc_id) AS doc_id, id FROM m WHERE id NOT IN (SELECT id FROM m WHERE doc_id % 2 = 0) GROUP BY id""")
def k22_mirror_changes(spark, d):
    """Texts are known by the digest of their normal form; what the store (even ids) has is not written again."""
    m = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(T.collapsed(F.col("text")), 256), 1, 12).alias("id"))
    return tables.without(m, m.where("doc_id % 2 = 0"), ["id"]).groupBy("id").agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 2 ELSE 1 END AS revision, c_custkey % 8 = 0 AS rejected FROM customer""")
def k27_update_triggers(spark, d):
    """An update raises the revision; one that would move a row to another tenant is turned down, changes nothing and is shown."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant"))
    changes = c.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 == 0, F.col("tenant") + 1).otherwise(F.col("tenant")).alias("to"), F.lit(True).alias("changed"))
    j = c.join(changes, "c_custkey", "left")
    changed = F.coalesce("changed", F.lit(False))
    rejected = changed & ~F.col("tenant").eqNullSafe(F.col("to"))
    return j.select("c_custkey", F.when(changed & ~rejected, 2).otherwise(1).alias("revision"), rejected.alias("rejected"))


# joins and scans


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def j17_inner_join(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("""SELECT o_orderkey, k.unnest.name AS name, k.unnest.n AS n FROM (SELECT o_orderkey, unnest([{'name': 'price', 'n': CAST(floor(o_totalprice) AS BIGINT)}, {'name': 'cust', 'n': o_custkey}]) AS unnest FROM orders) k""")
def j19_parent_and_children(spark, d):
    """A parent with each child of its JSON array."""
    price = F.floor("o_totalprice")
    text = F.concat(F.lit('[{"name":"price","n":'), price.cast("string"), F.lit('},{"name":"cust","n":'), F.col("o_custkey").cast("string"), F.lit("}]"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.from_json(text, "array<struct<name:string,n:bigint>>")).alias("c")).select("o_orderkey", "c.name", "c.n")


@query("SELECT count(*) AS n, count(*) FILTER (trim(text, ' ') <> '') AS usable, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def s14_s20_blob_scan(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.trim(t) != "").alias("usable"), F.sum(F.octet_length(t)).alias("bytes"))


@query("SELECT doc_id, source, lang FROM documents WHERE source IS NOT NULL AND lang IN ('en', 'fr') ORDER BY source, lang, doc_id LIMIT 257")
def s15_ordered_corpus_scan(spark, d):
    """One row more than the limit of 256 tells that there are more."""
    return table(spark, d, "documents").where(F.col("source").isNotNull() & F.col("lang").isin("en", "fr")).orderBy("source", "lang", "doc_id").limit(257).select("doc_id", "source", "lang")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_shipdate, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END NULLS LAST, l_orderkey")
def o7_corpus_order_nulls_last(spark, d):
    page = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber"))
    return table(spark, d, "lineitem").orderBy("l_partkey", "l_shipdate", page.asc_nulls_last(), "l_orderkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def s21_active_sessions(spark, d):
    return tables.latest(table(spark, d, "orders").where("o_orderstatus <> 'F'"), ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT lower(p_name) AS standard, any_value(p_type) AS type, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS aliases FROM part GROUP BY p_name, p_type")
def s22_entity_dictionary(spark, d):
    """Written and read as a JSON file of entities, then opened to one row each."""
    p = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    path = f"{shared_dir(spark)}/entities-{uuid.uuid4().hex}"
    p.select(F.lower("p_name").alias("standard"), F.col("p_type").alias("type"), "n", "aliases").write.json(path)
    back = spark.read.schema("standard string, type string, n long, aliases array<string>").json(path)
    return back.select("standard", "type", "n", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT label AS domain, len(embedding) AS dimension, count(*) AS vectors FROM embeddings GROUP BY ALL")
def s23_centroid_scan(spark, d):
    """Centroids as a JSON map by domain, with one key that is not a domain."""
    m = table(spark, d, "embeddings").groupBy("label", F.size("embedding").alias("dimension")).agg(F.count("*").alias("vectors"))
    entries = F.concat(F.collect_list(F.struct(F.col("label").cast("string").alias("key"), F.struct("dimension", "vectors").alias("value"))), F.array(F.struct(F.lit("_meta").alias("key"), F.struct(F.lit(0).alias("dimension"), F.lit(0).cast("long").alias("vectors")).alias("value"))))
    text = m.agg(F.to_json(F.map_from_entries(entries)).alias("text"))  # one entry for each label
    rows = text.select(F.explode(F.from_json("text", "map<string,struct<dimension:bigint,vectors:bigint>>")).alias("domain", "c"))
    return rows.where("domain <> '_meta'").select(F.col("domain").cast("int").alias("domain"), "c.dimension", "c.vectors")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def s24_s5_json_files(spark, d):
    """Sessions as JSON files, written and read back with their schema."""
    c = table(spark, d, "conversations")
    path = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    c.write.json(path)
    return files.json_records(spark, path, c.schema).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("""SELECT n_regionkey AS sheet, '## ' || n_regionkey || chr(10) || '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def s4_csv_sheets(spark, d):
    """A CSV file with a header, each sheet of it (here a region) as a Markdown table."""
    path = f"{shared_dir(spark)}/sheets-{uuid.uuid4().hex}"
    n = table(spark, d, "nation")
    n.write.option("header", True).csv(path)
    rows = spark.read.option("header", True).schema(n.schema).csv(path)
    return files.markdown_tables(rows, "n_regionkey", ["n_nationkey", "n_name"], "n_nationkey")


@query("SELECT 'raw-' || conv_id || '-' || turn AS source, 'text' AS type, 'Message ' || turn AS title, trim(text, ' ') AS text FROM conversations WHERE trim(text, ' ') <> ''")
def s9_raw_text(spark, d):
    c = table(spark, d, "conversations")
    source = F.concat_ws("-", F.lit("raw"), "conv_id", "turn")
    return c.select(source.alias("source"), F.lit("text").alias("type"), F.concat(F.lit("Message "), F.col("turn").cast("string")).alias("title"), F.trim("text").alias("text")).where("text != ''")


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'b.MD' WHEN 2 THEN 'https://x.org/p' WHEN 3 THEN 'c.xlsx' ELSE 'plain words' END AS name FROM documents)
 SELECT doc_id, CASE WHEN regexp_matches(name, '^https?://(www\\.)?(youtube\\.com|youtu\\.be)/') THEN 'youtube' WHEN regexp_matches(name, '^https?://') THEN 'url' WHEN regexp_matches(lower(name), '\\.(txt|text)$') THEN 'text' WHEN regexp_matches(lower(name), '\\.(md|markdown)$') THEN 'markdown'
  WHEN regexp_matches(lower(name), '\\.(xlsx|xls|csv)$') THEN 'sheet' WHEN regexp_matches(lower(name), '\\.(json|pdf|docx|pptx)$') THEN lower(regexp_extract(name, '([^.]+)$', 1)) ELSE 'raw' END AS format FROM n""")
def s10_format_dispatch(spark, d):
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "a.txt").when(k == 1, "b.MD").when(k == 2, "https://x.org/p").when(k == 3, "c.xlsx").otherwise("plain words")
    return table(spark, d, "documents").select("doc_id", files.format_of(name).alias("format"))


@query("""WITH f AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'pdf' END AS type, n_chars FROM documents) SELECT type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM f GROUP BY type""")
def c4_file_statistics(spark, d):
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").groupBy(F.when(k == 0, "txt").when(k == 1, "md").otherwise("pdf").alias("type")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


@query("SELECT item_id, coalesce(CASE item_id % 4 WHEN 0 THEN 'dense' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'graph' END, 'other') AS strategy, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS place FROM benchmark")
def c6_questions_by_strategy(spark, d):
    k = F.col("item_id") % 4
    w = Window.partitionBy(k).orderBy("item_id")
    return table(spark, d, "benchmark").select("item_id", F.coalesce(F.when(k == 0, "dense").when(k == 1, "hybrid").when(k == 2, "graph"), F.lit("other")).alias("strategy"), F.row_number().over(w).cast("long").alias("place"))


@query("""WITH p AS (SELECT s_suppkey AS id, s_nationkey AS scope FROM supplier), t AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status FROM part)
 SELECT p.id, coalesce(t.status, 'published') AS status, p.scope = 3 AS active, 'durable' AS kind FROM p LEFT JOIN t ON t.id = p.id * 2 UNION ALL SELECT t.id, t.status, false, 'task' FROM t WHERE t.id NOT IN (SELECT p.id * 2 FROM p)""")
def c1_graph_listing(spark, d):
    """Stored graphs with their tasks' states, then the tasks that have no stored graph."""
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("scope"), (F.col("s_suppkey") * 2).alias("task"))
    k = F.col("p_size") % 3
    t = table(spark, d, "part").select(F.col("p_partkey").alias("task"), F.when(k == 0, "failed").when(k == 1, "running").otherwise("completed").alias("status"))
    stored = p.join(t, "task", "left").select("id", F.coalesce("status", F.lit("published")).alias("status"), (F.col("scope") == 3).alias("active"), F.lit("durable").alias("kind"))
    return stored.unionByName(t.join(p, "task", "left_anti").select(F.col("task").alias("id"), "status", F.lit(False).alias("active"), F.lit("task").alias("kind")))


# filters and projections


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE 'Customer#00000%' AND c_nationkey IN (1, 2, 3, 4, 5) AND c_nationkey <> 2")
def p2_constraint_filter(spark, d):
    """Constraints become one condition; fields that the table does not have are dropped."""
    asked = [("c_mktsegment", "eq", "BUILDING"), ("c_name", "contains", "Customer#00000"), ("c_nationkey", "in", [1, 2, 3, 4, 5]), ("c_nationkey", "not", 2), ("no_such_field", "eq", 1)]
    c = table(spark, d, "customer")
    return c.where(tables.constraint(c.columns, asked)).select("c_custkey")


@query("SELECT doc_id, lang, coalesce(source, '') AS source, 'tenant' || doc_id % 3 AS tenant FROM documents")
def p4_scoped_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("")).alias("source"), F.concat(F.lit("tenant"), (F.col("doc_id") % 3).cast("string")).alias("tenant"))


@query("SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN 'blank' WHEN doc_id % 97 = 0 THEN 'quarantined' WHEN doc_id % 3 <> 1 THEN 'other_scope' ELSE 'admitted' END AS verdict FROM documents")
def p7_evidence_admission(spark, d):
    """Rows that may not enter are told why rather than failing the job."""
    k = F.col("doc_id")
    verdict = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank").when(k % 97 == 0, "quarantined").when(k % 3 != 1, "other_scope").otherwise("admitted")
    return table(spark, d, "documents").select("doc_id", verdict.alias("verdict"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'by the way|another question|switch|换个话题') OR (turn > 0 AND contains(lower(text), 'apple') AND NOT coalesce(bool_or(contains(lower(text), 'apple')) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS switched FROM conversations""")
def p15_topic_switch(spark, d):
    """By its words, or by a word of several meanings that no message before had."""
    t = F.lower("text")
    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(t.contains("apple")).over(w), F.lit(False))
    return table(spark, d, "conversations").select("conv_id", "turn", (t.rlike("by the way|another question|switch|换个话题") | ((F.col("turn") > 0) & t.contains("apple") & ~before)).alias("switched"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click') AND user_id % 4 > 0 AND ts + INTERVAL 10 DAY > (SELECT max(ts) FROM events)")
def p20_available_artifacts(spark, d):
    """Of trusted types, not withdrawn, not expired at the latest time known."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now")).withColumn("one", F.lit(1))
    live = e.where(F.col("event_type").isin("view", "click") & (F.col("user_id") % 4 > 0)).withColumn("one", F.lit(1)).join(F.broadcast(now), "one")
    return live.where(F.col("ts") + F.expr("INTERVAL 10 DAY") > F.col("now")).select("event_id", "user_id")


@query("SELECT conv_id, len(list_distinct(list(role))) AS roles, array_to_string(list_sort(list_distinct(list(role))), ',') AS listed FROM conversations GROUP BY conv_id")
def u12_g17_distinct_sorted(spark, d):
    r = F.array_sort(F.collect_set("role"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.size(r).cast("long").alias("roles"), F.array_join(r, ",").alias("listed"))


@query("""WITH r AS (SELECT item_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+')) AS name FROM benchmark), m AS (SELECT item_id, unnest(string_split(text, ' ')[1:3]) AS name FROM benchmark),
 u AS (SELECT item_id, lower(name) AS key, name, 0 AS src FROM r UNION ALL SELECT item_id, lower(name), name, 1 FROM m WHERE (item_id, lower(name)) NOT IN (SELECT (item_id, lower(name)) FROM r))
 SELECT item_id, key, min(name) AS name, min(src) = 0 AS by_rule FROM u WHERE key <> '' GROUP BY ALL""")
def u11_rule_and_model_entities(spark, d):
    """The rules' entities first; the model's (here the first three words) only under names that the rules did not give."""
    b = table(spark, d, "benchmark")
    r = b.select("item_id", F.explode(T.matches(F.col("text"), r"\b[A-Z][a-z]+")).alias("name")).withColumn("key", F.lower("name"))
    m = b.select("item_id", F.explode(F.slice(F.split("text", " "), 1, 3)).alias("name")).withColumn("key", F.lower("name")).where("key != ''")
    u = r.withColumn("src", F.lit(0)).unionByName(m.join(r.select("item_id", "key"), ["item_id", "key"], "left_anti").withColumn("src", F.lit(1)))
    return u.groupBy("item_id", "key").agg(F.min("name").alias("name"), (F.min("src") == 0).alias("by_rule"))


# summaries of stores


@query("""WITH l AS (SELECT l_orderkey AS d, l_linenumber AS i FROM lineitem) SELECT d AS document, count(*) AS chunks, count(DISTINCT i) = count(*) AS unique_ids, count(DISTINCT i) = count(*) AND min(i) = 1 AND max(i) = count(*) AS complete FROM l GROUP BY d""")
def g18_inventory_completeness(spark, d):
    """Chunks are complete if their numbers run from the first to the last without a gap or a repeat."""
    i = F.col("l_linenumber")
    one = F.countDistinct(i) == F.count("*")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document")).agg(F.count("*").alias("chunks"), one.alias("unique_ids"), (one & (F.min(i) == 1) & (F.max(i) == F.count("*"))).alias("complete"))


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents), v AS (SELECT doc_id, strlen(t) / length(t) AS x FROM t WHERE t <> '') SELECT doc_id, count(*) AS tokens, round(avg(x), 6) AS mean, round(max(x), 6) AS high, round(min(x), 6) AS low, round(var_pop(x), 6) AS variance, round(avg(CAST(x < 1.05 AS INT)), 6) AS low_share FROM v GROUP BY doc_id""")
def g30_density_statistics(spark, d):
    """Bytes to a character over a document's words, in its own row."""
    from sedge.functions import vectors as V

    words = F.transform(F.filter(F.split("text", " "), lambda t: t != ""), lambda t: F.octet_length(t) / F.length(t))

    def measured(v):
        n, mean = F.size(v), V.total(v) / F.size(v)
        var = V.let(mean, lambda m: V.total(F.transform(v, lambda x: F.pow(x - m, F.lit(2.0))))) / n
        parts = {"mean": mean, "high": F.array_max(v), "low": F.array_min(v), "variance": var, "low_share": F.size(F.filter(v, lambda x: x < 1.05)) / n}
        return F.struct(n.cast("long").alias("tokens"), *(F.round(c, 6).alias(k) for k, c in parts.items()))

    rows = table(spark, d, "documents").select("doc_id", V.let(words, lambda v: F.when(F.size(v) > 0, measured(v))).alias("m"))
    return rows.where("m IS NOT NULL").select("doc_id", "m.*")


@query("""WITH t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents), k AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS t FROM benchmark), f AS (SELECT doc_id, avg(CAST(t IN (SELECT t FROM k) AS INT)) AS known, avg(CAST(regexp_matches(t, '[^\\x00-\\x7F]') AS INT)) AS fallback, avg(1 / (1 + length(t))) AS freq FROM t WHERE t <> '' GROUP BY 1),
 s AS (SELECT *, known * 0.4 + (1 - fallback) * 0.3 + least(1, freq * 10) * 0.15 + 0.5 * 0.15 AS score FROM f) SELECT doc_id, round(known, 6) AS known, round(fallback, 6) AS fallback, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM s""")
def g31_knowledge_coverage(spark, d):
    """Known words are those of the items; words beyond ASCII stand for byte fallbacks. Words are combined by document before they meet."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("t")).where("t != ''").groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    known = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("t"), F.lit(1).alias("k")).distinct()
    n = F.sum("n")
    f = words.join(known, "t", "left").groupBy("doc_id").agg(
        (F.sum(F.col("n") * F.coalesce("k", F.lit(0))) / n).alias("known"), (F.sum(F.col("n") * F.col("t").rlike("[^\\x00-\\x7F]").cast("int")) / n).alias("fallback"), (F.sum(F.col("n") / (1 + F.length("t"))) / n).alias("freq"))
    score = F.col("known") * 0.4 + (1 - F.col("fallback")) * 0.3 + F.least(F.lit(1.0), F.col("freq") * 10) * 0.15 + 0.5 * 0.15
    level = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    return f.withColumn("score", score).select("doc_id", *(F.round(c, 6).alias(c) for c in ("known", "fallback", "score")), level.alias("level"))


@query("""WITH l AS (SELECT vec_id, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n, label FROM embeddings) SELECT label, round(avg(n), 6) AS mean, round(var_pop(n), 6) AS variance, CAST(count(*) FILTER (n < 0.9) AS BIGINT) AS short, CAST(count(*) FILTER (n >= 0.9 AND n < 1.1) AS BIGINT) AS unit, CAST(count(*) FILTER (n >= 1.1) AS BIGINT) AS long FROM l GROUP BY label""")
def g32_magnitude_scorecard(spark, d):
    from sedge.functions import vectors as V

    n = table(spark, d, "embeddings").select("label", V.norm(V.doubles("embedding")).alias("n"))
    return n.groupBy("label").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.var_pop("n"), 6).alias("variance"), F.count_if(F.col("n") < 0.9).alias("short"), F.count_if((F.col("n") >= 0.9) & (F.col("n") < 1.1)).alias("unit"), F.count_if(F.col("n") >= 1.1).alias("long"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?s)^\\s*\\{.*\\}\\s*$') THEN 'whole' WHEN regexp_matches(text, '(?s)```(json)?\\s*\\{.*\\}\\s*```') THEN 'fenced' WHEN regexp_matches(text, '(?s)\\{.*\\}') THEN 'inside' ELSE 'none' END AS found FROM conversations")
def f33_json_in_text(spark, d):
    t = F.col("text")
    found = F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$"), "whole").when(t.rlike(r"(?s)```(json)?\s*\{.*\}\s*```"), "fenced").when(t.rlike(r"(?s)\{.*\}"), "inside").otherwise("none")
    return table(spark, d, "conversations").select("conv_id", "turn", found.alias("found"))


@query("""WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS title, length(html) AS n FROM pages) SELECT page_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CAST(greatest(1, ceil(n / 400.0)) AS BIGINT) AS minutes,
 CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 99 END AS category FROM t ORDER BY category, title, page_id""")
def s25_article_list(spark, d):
    """Articles by their category's place in a list (others last), then title."""
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    k = F.col("page_id") % 3
    name = F.when(k == 0, "guide").when(k == 1, "news").otherwise("misc")
    place = F.array_position(F.array(F.lit("guide"), F.lit("news")), name)
    rows = table(spark, d, "pages").select("page_id", title.alias("title"), T.dashed(title).alias("slug"), F.greatest(F.lit(1), F.ceil(F.length("html") / 400)).cast("long").alias("minutes"), F.when(place > 0, place).otherwise(99).cast("int").alias("category"))
    return rows.orderBy("category", F.asc_nulls_last("title"), F.asc_nulls_last("page_id"))


@query("""WITH p AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_一-龥]+'), lambda t: t <> '')) AS token FROM documents) SELECT 'dense' AS side, count(*) AS n FROM embeddings UNION ALL SELECT 'lexical', count(*) FROM p""")
def k7_k8_dual_write(spark, d):
    """Vectors and token postings written side by side; a pointer names both only when both are whole, and readers go by it."""
    base = f"{shared_dir(spark)}/dual-{uuid.uuid4().hex}"
    table(spark, d, "embeddings").write.parquet(f"{base}/dense")
    table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.lexical_tokens(F.col("text")))).alias("token")).write.parquet(f"{base}/lexical")
    spark.createDataFrame([("dense", f"{base}/dense"), ("lexical", f"{base}/lexical")], "side string, path string").write.parquet(f"{base}/current")
    sides = {r.side: r.path for r in spark.read.parquet(f"{base}/current").collect()}  # two rows
    counted = [spark.read.parquet(sides[s]).agg(F.lit(s).alias("side"), F.count("*").alias("n")) for s in ("dense", "lexical")]
    return counted[0].unionByName(counted[1])


@query("SELECT l_orderkey AS graph, count(DISTINCT l_partkey) AS nodes, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1")
def k29_graph_serialised(spark, d):
    """Nodes as a map by name, written as JSON entries, and read back into the map."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph"), F.col("l_partkey").cast("string").alias("node")).agg(F.sum("l_quantity").cast("long").alias("w"))
    text = n.groupBy("graph").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("node", "w")))).alias("text"))
    back = text.select("graph", F.from_json("text", "map<string,bigint>").alias("m"))
    return back.select("graph", F.size(F.map_keys("m")).cast("long").alias("nodes"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"))


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' ELSE 'txt' END AS kind, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
 SELECT doc_id, kind, len(w) > 0 AS success, len(w) AS words, CASE WHEN len(w) > 0 THEN sha256(array_to_string(w, ' ')) END AS digest FROM d""")
def s3_s11_s12_containers(spark, d):
    """Documents written as word documents, presentations and texts, and read back: their words, a row a document."""
    kind = F.when(F.col("doc_id") % 3 == 0, "docx").when(F.col("doc_id") % 3 == 1, "pptx").otherwise("txt")
    files = containers.as_containers(table(spark, d, "documents"), "doc_id", "text", kind)
    parts = containers.read_files(files).withColumn("doc_id", F.regexp_extract("path", "^[0-9]+", 0).cast("long"))
    own = F.array_sort(F.collect_list(F.struct("part", "text")))  # a document's slides
    whole = parts.groupBy("doc_id", "kind").agg(F.bool_and("success").alias("success"), F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"))
    w = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    return whole.select("doc_id", "kind", "success", F.size(w).cast("long").alias("words"), F.when(F.size(w) > 0, F.sha2(F.array_join(w, " "), 256)).alias("digest"))
