"""Queries of similarity, graph and text searches; each oracle says the same in its own SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fulltext, graph, layout, records, similar, timeline
from ..registry import query
from ..sources import table
from .stand_ins import over, stand_in


@query("v11_fuzzy_markers", over("words", """
WITH r AS (SELECT page, seq, text || ' ' || lead(text, 1) OVER w || ' ' || lead(text, 2) OVER w AS said, list(y) OVER u AS ys FROM words
  WINDOW w AS (PARTITION BY page ORDER BY seq), u AS (PARTITION BY page ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
m AS (SELECT page, arg_max(said, seq) AS said FROM r WHERE said IS NOT NULL GROUP BY page),
k AS (SELECT page, replace(said[1:6] || 'x' || said[8:], '#3', '#') AS said FROM m),
s AS (SELECT k.page, r.said, r.seq, r.ys, lower(k.said) = lower(r.said) AS exact, 1 - levenshtein(lower(k.said), lower(r.said)) / greatest(length(k.said), length(r.said)) AS alike FROM k JOIN r ON r.page = k.page AND r.said IS NOT NULL),
f AS (SELECT *, bool_or(exact) OVER (PARTITION BY page) AS any_exact FROM s WHERE alike >= 0.8),
b AS (SELECT * FROM f WHERE exact OR NOT any_exact QUALIFY row_number() OVER (PARTITION BY page ORDER BY seq) = 1)
SELECT page AS marker_id, said AS text, list_min(ys)::DOUBLE AS y, (list_max(ys) + 10 - list_min(ys))::DOUBLE AS height, exact FROM b
WHERE list_max(ys) + 10 - list_min(ys) BETWEEN 8 AND 500"""))
def v11_fuzzy(spark, d):
    """Of each page the last three words, with another seventh character and without '#3', are looked for."""
    words = stand_in(spark, d, "words")
    ahead = words.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("seq")))).where("n <= 3")
    last = ahead.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("w")).where("size(w) >= 3")
    said = F.array_join(F.transform(F.slice("w", -3, 3), lambda w: w["text"]), " ")
    wrong = F.replace(F.expr("concat(substring(said, 1, 6), 'x', substring(said, 8))"), F.lit("#3"), F.lit("#"))
    none = F.lit(None).cast("string")
    markers = last.select("page", said.alias("said")).select(F.col("page").alias("marker_id"), "page", wrong.alias("marker"), none.alias("context"),
        none.alias("region"), F.lit(3300).alias("page_height"))
    return layout.marker_matches(words, markers, threshold=0.8).select("marker_id", "text", "y", "height", "exact")


NAMES = """SELECT o_custkey AS patient_id, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN replace(lower(o_orderpriority), 'e', 'a') WHEN 2 THEN concat(lower(o_orderpriority), 's') ELSE replace(lower(o_orderpriority), '-', '') END AS name FROM orders"""


@query("d05_j19_similar_names", f"""
WITH RECURSIVE o AS ({NAMES}), n AS (SELECT DISTINCT patient_id, name FROM o),
e AS (SELECT a.patient_id, a.name, b.name AS other FROM n a JOIN n b ON a.patient_id = b.patient_id WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.8),
c AS (SELECT patient_id, name, name AS root FROM n UNION SELECT e.patient_id, e.other, c.root FROM c JOIN e ON e.patient_id = c.patient_id AND e.name = c.name),
g AS (SELECT patient_id, name, min(root) AS root FROM c GROUP BY patient_id, name),
j AS (SELECT g.patient_id, g.root, o.name, o.o_orderkey % 3 = 0 AS fresh, o.o_orderkey FROM g JOIN o ON o.patient_id = g.patient_id AND o.name = g.name)
SELECT patient_id, coalesce(min(name) FILTER (WHERE NOT fresh), min(name)) AS name_key, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT o_orderkey % 7) AS sources, bool_or(fresh) AS touched
FROM j GROUP BY patient_id, root""")
def d05_fuzzy(spark, d):
    o, n, low = table(spark, d, "orders"), F.col("o_orderkey"), F.lower("o_orderpriority")
    name = (F.when(n % 4 == 0, low).when(n % 4 == 1, F.replace(low, F.lit("e"), F.lit("a"))).when(n % 4 == 2, F.concat(low, F.lit("s")))
        .otherwise(F.replace(low, F.lit("-"), F.lit(""))))
    rows = o.select(F.col("o_custkey").alias("patient_id"), name.alias("name"), n.cast("string").alias("value"), F.array((n % 7).cast("string")).alias("sources"), (n % 3 == 0).alias("fresh"))
    merged = records.merged_by_similar_name(rows.where("NOT fresh").drop("fresh"), rows.where("fresh").drop("fresh"))
    return merged.select("patient_id", "name_key", F.array_join("names", ",").alias("names"), F.size("sources").cast("long").alias("sources"), "touched")


@query("j19_trigram_names", """
WITH t AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) AS w FROM t),
g AS (SELECT DISTINCT name, substring('  ' || w || ' ', i, 3) AS gram FROM w, range(1, 100) AS r(i) WHERE i <= length(w) + 1),
n AS (SELECT name, count(*) AS n FROM g GROUP BY name),
b AS (SELECT a.name AS l, b.name AS r, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.name < b.name GROUP BY a.name, b.name)
SELECT l AS left_text, r AS right_text, round(shared / (x.n + y.n - shared), 6) AS similarity FROM b JOIN n x ON x.name = l JOIN n y ON y.name = r WHERE shared / (x.n + y.n - shared) >= 0.5""")
def j19(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("text"))
    pairs = similar.trigram_pairs(names, names, 0.5, []).where("left_text < right_text")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("g02_refused_edges", """
WITH RECURSIVE e AS (SELECT DISTINCT vec_id AS a, vec_id * 2 AS b FROM embeddings WHERE vec_id > 0 UNION SELECT vec_id, vec_id - 7 FROM embeddings WHERE vec_id % 9 = 0 AND vec_id > 7),
p AS (SELECT vec_id * 8 AS a, vec_id AS b FROM embeddings WHERE vec_id % 5 = 1 UNION ALL SELECT vec_id, vec_id * 37 % 500 FROM embeddings WHERE vec_id % 5 = 2),
r AS (SELECT DISTINCT b AS s, b AS n FROM p UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.n)
SELECT p.a, p.b FROM p JOIN r ON r.s = p.b AND r.n = p.a""")
def g02(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"))
    edges = v.where("v > 0").selectExpr("v AS a", "v * 2 AS b").union(v.where("v % 9 = 0 AND v > 7").selectExpr("v AS a", "v - 7 AS b"))
    return graph.refused_edges(edges, v.where("v % 5 = 1").selectExpr("v * 8 AS a", "v AS b").union(v.where("v % 5 = 2").selectExpr("v AS a", "v * 37 % 500 AS b")))


WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"


@query("f29_text_rank", f"""
WITH q AS (SELECT item_id, list_distinct([{WORDS.format(t='text')}[3], {WORDS.format(t='text')}[5], {WORDS.format(t='text')}[3 + item_id % 3 * 2]]) AS terms FROM benchmark),
d AS (SELECT doc_id, {WORDS.format(t='text')} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
t AS (SELECT item_id, unnest(terms) AS term, len(list_filter(terms, lambda x: x IS NOT NULL)) AS n FROM q),
h AS (SELECT t.item_id, p.doc_id, t.term, t.n, p.pos, row_number() OVER (PARTITION BY t.item_id, p.doc_id, t.term ORDER BY p.pos) AS j FROM t JOIN p ON p.term = t.term),
m AS (SELECT item_id, doc_id, n FROM h GROUP BY item_id, doc_id, n HAVING count(DISTINCT term) = n),
o AS (SELECT item_id, doc_id, (0.1 + sum(0.1 / (j * j)) - 0.1) / 1.64493406685 AS rank FROM h JOIN m USING (item_id, doc_id) WHERE m.n = 1 GROUP BY item_id, doc_id),
x AS (SELECT item_id, doc_id, a.pos AS p, b.pos AS r FROM m JOIN h a USING (item_id, doc_id) JOIN h b USING (item_id, doc_id) WHERE m.n > 1 AND a.term < b.term),
s AS (SELECT item_id, doc_id, 1 - exp(sum(ln(1 - sqrt(0.01 * CASE WHEN abs(p - r) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(p - r) / 1.5 - 2)) END)))) AS rank FROM x GROUP BY item_id, doc_id)
SELECT item_id AS query, doc_id, round(rank, 6) AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM s) u""")
def f29(spark, d):
    """Of each test item the third and the fifth word, and by its number a third one, are looked for in all documents."""
    words, i = fulltext.tokens(F.col("text")), F.col("item_id")
    at = lambda n: F.coalesce(F.get(words, n), F.lit(""))
    asked = table(spark, d, "benchmark").select(i.alias("query"), F.concat_ws(" ", at(F.lit(2)), at(F.lit(4)), at((2 + i % 3 * 2).cast("int"))).alias("text"))
    index = fulltext.build_index(table(spark, d, "documents"), "doc_id", {"text": "D"})
    return fulltext.search(index, asked).select("query", "doc_id", F.round("rank", 6).alias("rank"))


@query("n03_general_answers", over("timeline", """
WITH q AS (SELECT c_custkey AS question_id, c_custkey % 15 AS patient_id, CASE c_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END AS w FROM customer),
r AS (SELECT question_id, event_id, row_number() OVER (PARTITION BY question_id ORDER BY event_date DESC, event_id) AS n FROM q JOIN timeline t ON t.patient_id = q.patient_id AND archived IS NOT TRUE AND subcategory = w)
SELECT question_id, 'general_search' AS response_type, string_agg(event_id::VARCHAR, ',' ORDER BY n) AS events, 0.7::DOUBLE AS confidence FROM r WHERE n <= 10 GROUP BY question_id"""))
def n03_general(spark, d):
    """Each title has the asked words once and side by side, so the newest of equal ranks come first."""
    n = F.col("c_custkey")
    word = F.when(n % 3 == 0, "click").when(n % 3 == 1, "view").otherwise("purchase")
    q = table(spark, d, "customer").select(n.alias("question_id"), (n % 15).alias("patient_id"), F.concat(F.lit("And the "), F.upper(word), F.lit(" NO?")).alias("text"))
    events = stand_in(spark, d, "timeline").withColumn("searchable", F.col("title"))
    found = timeline.answers(q, events, F.lit("2024-01-20").cast("timestamp_ntz"))
    return found.withColumn("events", F.array_join(F.transform("events", lambda e: e.cast("string")), ","))
