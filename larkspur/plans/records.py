"""Queries that apply operators to stand-in records; each oracle says the same in its own SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import access, flags, graph, layout, model_output, queues, reconcile, retrieval, timeline
from ..registry import query
from ..sources import table
from .stand_ins import AS_OF, over, stand_in

NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"
LATE = "TIMESTAMP '2024-01-20 00:00:00'"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def late():
    return F.lit("2024-01-20").cast("timestamp_ntz")


FLAG = ["document_id", "problem_code", "severity", "confidence", "raw_value", "suggestion", "auto_resolvable"]


def shown_flags(df):
    return flags.surviving(df).select(*FLAG).withColumn("confidence", F.round("confidence", 6))


@query("q01_q02_appointment_flags", over("appointments profiles", f"""
WITH j AS (SELECT a.*, p.date_of_birth FROM appointments a JOIN profiles p ON p.profile_id = a.profile_id)
SELECT document_id, 'future_date_check' AS problem_code, 'warning' AS severity, 0.85 AS confidence, date::VARCHAR AS raw_value, (CASE WHEN year(date)
> 2002 THEN date + INTERVAL (1997 - year(date)) YEAR ELSE date END)::DATE::VARCHAR AS suggestion, false AS auto_resolvable
FROM j WHERE epoch(date) - epoch({NOW}) > 12 * 30 * 86400
UNION ALL SELECT document_id, 'birth_date_consistency', 'critical', 0.95, date::VARCHAR, NULL, false FROM j WHERE date < date_of_birth"""))
def q01(spark, d):
    rows = stand_in(spark, d, "appointments").join(stand_in(spark, d, "profiles").select("profile_id", "date_of_birth"), "profile_id")
    return shown_flags(flags.raised(rows, "appointments", flags.appointment_rules(now())))


@query("q03_future_labs", over("labs", f"""
WITH x AS (SELECT *, ceil((epoch(date) - epoch({NOW})) / 86400.0) AS ahead FROM labs)
SELECT document_id, 'future_date_check' AS problem_code, CASE WHEN ahead > 30 THEN 'warning' ELSE 'info' END AS severity, 0.8 AS confidence,
date::VARCHAR AS raw_value, (CASE WHEN year(date) > 2002 THEN date + INTERVAL (1997 - year(date)) YEAR ELSE date END)::DATE::VARCHAR AS suggestion,
ahead <= 7 AS auto_resolvable
FROM x WHERE ahead > 0"""))
def q03(spark, d):
    return shown_flags(flags.raised(stand_in(spark, d, "labs"), "lab_results", flags.lab_rules(now())))


@query("q04_q06_identity_flags", over("patient_info", """
WITH x AS (SELECT *, CASE WHEN name <> '' AND display_name <> '' THEN (greatest(length(name), length(display_name)) - levenshtein(lower(name),
lower(display_name))) / greatest(length(name), length(display_name)) END AS alike,
abs((date_diff('year', date_of_birth, DATE '1997-06-15') - (strftime(DATE '1997-06-15', '%m%d') < strftime(date_of_birth, '%m%d'))::INT) -
(date_diff('year', profile_birth, DATE '1997-06-15') - (strftime(DATE '1997-06-15', '%m%d') < strftime(profile_birth, '%m%d'))::INT)) AS years FROM
patient_info)
SELECT document_id, 'name_similarity_check' AS problem_code, 'critical' AS severity, round(1 - alike, 6) AS confidence, name AS raw_value,
display_name AS suggestion, false AS auto_resolvable FROM x WHERE alike < 0.6 AND 1 - alike >= 0.8
UNION ALL SELECT document_id, 'age_consistency_check', 'warning', 0.8, date_of_birth::VARCHAR, profile_birth::VARCHAR, false FROM x WHERE years > 1
UNION ALL SELECT document_id, 'contact_format_check', 'info', 0.7, phone, CASE phone WHEN '555.123.4567' THEN '(555) 123-4567' ELSE phone END, true
FROM x WHERE phone IN ('555-12', '555.123.4567')"""))
def q04(spark, d):
    return shown_flags(flags.raised(stand_in(spark, d, "patient_info"), "patient_demographics", flags.identity_rules(F.lit(AS_OF).cast("date"))))


@query("q07_condition_ages", over("diagnoses", """
WITH x AS (SELECT *, date_diff('year', date_of_birth, DATE '1997-06-15') - (strftime(DATE '1997-06-15', '%m%d') < strftime(date_of_birth,
'%m%d'))::INT AS age FROM diagnoses),
y AS (SELECT document_id, condition, CASE WHEN age < 18 AND condition IN ('COPD', 'Menopause') THEN 0.8 WHEN age > 18 AND condition = 'Infant colic'
THEN 0.7 WHEN age < 65 AND condition = 'Early Dementia' THEN 0.6 END AS c FROM x)
SELECT document_id, 'age_appropriate_condition' AS problem_code, 'warning' AS severity, c AS confidence, condition AS raw_value, NULL::VARCHAR AS
suggestion, false AS auto_resolvable FROM y WHERE c >= 0.7"""))
def q07(spark, d):
    return shown_flags(flags.raised(stand_in(spark, d, "diagnoses"), "diagnoses", flags.condition_rules(F.lit(AS_OF).cast("date"))))


@query("q08_vital_ranges", over("vitals", """
WITH r(kind, low, high, said) AS (VALUES ('blood pressure systolic', 60, 250, '60-250 mmHg'), ('blood pressure diastolic', 30, 150, '30-150 mmHg'),
('heart rate', 20, 200, '20-200 bpm'), ('temperature', 90, 110, '90-110 F'), ('height', 10, 96, '10-96 inches'), ('weight', 2, 800, '2-800 lbs')),
x AS (SELECT v.*, r.kind, try_cast(regexp_extract(value, '^[0-9]+') AS DOUBLE) AS num, CASE WHEN r.kind = 'weight' AND profile_type = 'pet' THEN 0.5
ELSE low END AS low, CASE WHEN r.kind = 'weight' AND profile_type = 'pet' THEN 200 ELSE high END AS high,
CASE WHEN r.kind = 'weight' AND profile_type = 'pet' THEN '0.5-200 lbs' ELSE said END AS said FROM vitals v JOIN r ON contains(lower(type), r.kind))
SELECT document_id, 'impossible_vital_ranges' AS problem_code, 'warning' AS severity, 0.8 AS confidence, value AS raw_value, said AS suggestion, false
AS auto_resolvable FROM x WHERE num < low OR num > high"""))
def q08(spark, d):
    return shown_flags(flags.raised(stand_in(spark, d, "vitals"), "vitals", flags.vital_rules()))


@query("q09_pet_medicines", over("medicines", """
SELECT document_id, 'species_appropriate_condition' AS problem_code, 'critical' AS severity, 0.9 AS confidence, name AS raw_value, NULL::VARCHAR AS
suggestion, false AS auto_resolvable
FROM medicines WHERE profile_type = 'pet' AND species IS NOT NULL AND name <> 'Metformin 500 mg'"""))
def q09(spark, d):
    return shown_flags(flags.raised(stand_in(spark, d, "medicines"), "medications", flags.pet_rules()))


@query("q10_profile_types", over("appointments diagnoses profiles", """
WITH v AS (SELECT document_id, CASE WHEN provider ILIKE '%vet%' THEN 2 ELSE 0 END AS pet, CASE WHEN provider ILIKE '%pediatric%' THEN 2 ELSE 0 END AS
child, CASE WHEN provider ILIKE '%cardiologist%' THEN 1 ELSE 0 END AS human FROM appointments
UNION ALL SELECT profile_id, CASE WHEN condition = 'Flea infestation' THEN 2 ELSE 0 END, CASE WHEN condition IN ('Infant colic',
'Developmental delay') THEN 1 ELSE 0 END, 0 FROM diagnoses),
s AS (SELECT document_id, sum(pet) AS pet, sum(child) AS child, sum(human) AS human FROM v GROUP BY document_id),
g AS (SELECT document_id, CASE WHEN pet > human + child THEN 'pet' WHEN child > human AND child > 0 THEN 'child' WHEN human > 0 THEN 'self' END AS
suggested FROM s)
SELECT document_id, 'profile_demographic_mismatch' AS problem_code, 'critical' AS severity, 0.9 AS confidence, profile_type AS raw_value, suggested AS
suggestion, false AS auto_resolvable
FROM g JOIN profiles ON profile_id = document_id WHERE (profile_type = 'pet') <> (suggested = 'pet')"""))
def q10(spark, d):
    told = flags.suggested_profile(stand_in(spark, d, "appointments"), stand_in(spark, d, "diagnoses").withColumn("document_id", F.col("profile_id")))
    rows = told.join(stand_in(spark, d, "profiles").withColumn("document_id", F.col("profile_id")), "document_id")
    return shown_flags(flags.raised(rows, "documents", flags.profile_rules()))


@query("q11_f77_completeness", over("patient_info", """
WITH x AS (SELECT document_id, ((name IS NOT NULL)::INT * 2 + (document_id % 2 = 0)::INT * 1.5 + (document_id % 3 = 0)::INT + (document_id % 5 =
0)::INT * 1.5) / 8.0 AS c FROM patient_info)
SELECT document_id, 'incomplete_extraction' AS problem_code, 'warning' AS severity, 0.8 AS confidence, round(c, 4) AS share FROM x WHERE c < 0.5"""))
def q11(spark, d):
    n = F.col("document_id")
    filled = {"patient_info": F.col("name").isNotNull(), "appointments": n % 2 == 0, "medications": n % 3 == 0, "diagnoses": n % 5 == 0}
    rows = stand_in(spark, d, "patient_info").withColumn("completeness", flags.completeness(filled))
    return flags.surviving(flags.raised(rows, "documents", flags.completeness_rules())).select("document_id", "problem_code", "severity",
        "confidence", F.col("raw_value").cast("double").alias("share"))


@query("q12_w13_same_day", over("appointments", """
SELECT document_id, string_agg(date::VARCHAR, ',' ORDER BY date) AS dates FROM (SELECT *, count(*) OVER (PARTITION BY document_id, date) AS n FROM
appointments) t WHERE n > 1 GROUP BY document_id"""))
def q12(spark, d):
    return flags.same_day(stand_in(spark, d, "appointments"))


@query("a16_flag_statistics", """
SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 4 = 0) AS open, count(*) FILTER (WHERE doc_id % 4 IN (1, 2)) AS resolved, count(*) FILTER (WHERE toxic = 1) AS
critical, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS warning,
count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS info, round(100.0 * count(*) FILTER (WHERE doc_id % 4 IN (1, 2)) / count(*), 2) AS resolution_rate,
round(avg(doc_id % 50) FILTER (WHERE doc_id % 4 IN (1, 2)), 4) AS mean_hours FROM labels""")
def a16(spark, d):
    severity = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "warning").otherwise("info")
    at, k = F.lit("2024-01-01").cast("timestamp_ntz"), F.col("doc_id") % 4
    status = F.when(k == 0, "open").when(k == 1, "resolved").when(k == 2, "ignored").otherwise("in_review")
    rows = table(spark, d, "labels").select(severity.alias("severity"), status.alias("status"), at.alias("created_at"),
        F.timestamp_add("HOUR", (F.col("doc_id") % 50).cast("int"), at).alias("resolved_at"))
    return flags.flag_statistics(rows)


# retrieval

COSINE = "list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def shown(rows):
    """Similarities are rounded to show them only; thresholds and ranks go by the raw ones."""
    return rows.withColumn("similarity", F.round("similarity", 6))


@query("v01_universal_search", over("universal asked", f"""
WITH s AS (SELECT query, code_system, code_value, {COSINE} AS similarity FROM universal c, asked q WHERE active)
SELECT query, code_system, code_value, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s.similarity DESC, code_system, code_value) AS
position FROM s WHERE s.similarity >= 0.1 QUALIFY position <= 10"""))
def v01(spark, d):
    return shown(retrieval.vector_search(stand_in(spark, d, "universal"), stand_in(spark, d, "asked"), ["code_system", "code_value"], 10, 0.1))


@query("v02_regional_search", over("regional asked", f"""
WITH s AS (SELECT query, code_system, code_value, {COSINE} AS similarity FROM regional c, asked q WHERE country = 'AUS')
SELECT query, code_system, code_value, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s.similarity DESC, code_system, code_value) AS
position FROM s WHERE s.similarity >= 0.05 QUALIFY position <= 10"""))
def v02(spark, d):
    return retrieval.vector_search(stand_in(spark, d, "regional"), stand_in(spark, d, "asked"), ["code_system", "code_value"], 10, 0.05,
        country="AUS").withColumn("similarity", F.round("similarity", 6))


@query("v09_similar_of_owner", f"""
WITH s AS (SELECT q.vec_id AS query, c.vec_id AS code, {COSINE} AS similarity FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0 AND q.label = c.label AND q.vec_id <> c.vec_id)
SELECT query, code, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY query ORDER BY s.similarity DESC, code))::INTEGER AS position FROM s WHERE s.similarity >= 0.05 QUALIFY position <= 5""")
def v09(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("code"), F.col("label").cast("string").alias("owner"), "embedding")
    asked = rows.where("code % 50 = 0").withColumnRenamed("code", "query")
    hits = retrieval.vector_search(rows, asked, ["code"], 6, 0.05, kind="owner").where("query <> code")
    order = Window.partitionBy("query").orderBy("position")
    return shown(hits.withColumn("position", F.row_number().over(order)).where("position <= 5"))


FOUND = f"""u AS (SELECT query, entity_type, code_system, code_value, {COSINE} AS similarity, 0 AS source FROM universal c, asked q WHERE active),
r AS (SELECT query, entity_type, code_system, code_value, {COSINE} AS similarity, 1 AS source FROM regional c, asked q),
b AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY similarity DESC, code_system, code_value) AS p FROM (SELECT * FROM u UNION ALL
SELECT * FROM r) t WHERE similarity >= 0.1 QUALIFY p <= 30),
m AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, source, p) AS position FROM (SELECT * FROM b QUALIFY row_number() OVER
(PARTITION BY query, code_system, code_value ORDER BY source, p) = 1) t)"""


def found(spark, d):
    key, asked = ["code_system", "code_value"], stand_in(spark, d, "asked")
    search = lambda name: retrieval.vector_search(stand_in(spark, d, name), asked, key, 30, 0.1)
    return retrieval.combined(search("universal"), search("regional"), key)


@query("v03_v04_combined_candidates", over("universal regional asked",
    f"WITH {FOUND} SELECT query, code_system, code_value, round(similarity, 6) AS similarity, source, position FROM m"))
def v04(spark, d):
    return shown(found(spark, d))


RULED = """g AS (SELECT *, CASE entity_type WHEN 'medication' THEN CASE WHEN code_system IN ('pbs', 'ndc') THEN 0 WHEN code_system = 'rxnorm' THEN 1 END WHEN 'procedure' THEN CASE WHEN code_system IN ('mbs', 'cpt') THEN 0 WHEN code_system = 'snomed' THEN 1 END
WHEN 'lab_result' THEN CASE WHEN code_system = 'loinc' THEN 0 ELSE 1 END WHEN 'diagnosis' THEN CASE WHEN code_system = 'snomed' THEN 0 WHEN
code_system LIKE 'icd%' THEN 1 ELSE 2 END ELSE 0 END AS grp FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY query, grp ORDER BY position) AS n, count(*) FILTER (WHERE grp = 0) OVER (PARTITION BY query) AS
firsts FROM g WHERE grp IS NOT NULL),
t AS (SELECT query, entity_type, code_system, code_value, similarity, row_number() OVER (PARTITION BY query ORDER BY grp, position) AS position FROM k
WHERE NOT (entity_type IN ('medication', 'procedure', 'lab_result') AND grp = 1 AND firsts > 0 AND n > 5))"""


@query("v05_type_rules",
    over("universal regional asked", f"WITH {FOUND}, {RULED} SELECT query, code_system, code_value, round(similarity, 6) AS similarity, position FROM t"))
def v05(spark, d):
    rows = found(spark, d).join(stand_in(spark, d, "asked").select("query", "entity_type"), "query")
    return shown(retrieval.by_type_rules(rows, "entity_type", "code_system").select("query", "code_system", "code_value", "similarity", "position"))


SELECTED = """c AS (SELECT *, count(*) FILTER (WHERE similarity >= 0.2) OVER w AS good, count(*) FILTER (WHERE similarity >= 0.9) OVER w AS sure, count(*) FILTER (WHERE similarity >= 0.2) OVER o AS good_n, count(*) FILTER (WHERE similarity < 0.9) OVER o AS rest_n
FROM t WHERE similarity >= 0.1 WINDOW w AS (PARTITION BY query), o AS (PARTITION BY query ORDER BY position)),
f AS (SELECT * FROM c WHERE CASE WHEN good > 10 THEN similarity >= 0.2 AND good_n <= 20 ELSE similarity >= 0.9 OR rest_n <= 10 - sure END)
SELECT query, code_system, code_value, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY f.similarity DESC, position) AS rank FROM f"""


@query("v13_ranked_codes", over("universal regional asked", f"WITH {FOUND}, {RULED}, {SELECTED}"))
def v13(spark, d):
    rows = retrieval.ranked_codes(stand_in(spark, d, "universal"), stand_in(spark, d, "regional"), stand_in(spark, d, "asked"), "entity_type", 30,
        0.1, sure=0.9, good=0.2)
    return shown(rows.select("query", "code_system", "code_value", "similarity", "rank"))


@query("v06_selected_candidates", """
WITH r AS (SELECT l_suppkey AS q, l_orderkey * 10 + l_linenumber AS pos, l_quantity / 50 AS score FROM lineitem WHERE l_quantity / 50 >= 0.6),
c AS (SELECT *, count(*) FILTER (WHERE score >= 0.75) OVER w AS good, count(*) FILTER (WHERE score >= 0.85) OVER w AS sure, count(*) FILTER (WHERE
score >= 0.75) OVER o AS good_n, count(*) FILTER (WHERE score < 0.85) OVER o AS rest_n
FROM r WINDOW w AS (PARTITION BY q), o AS (PARTITION BY q ORDER BY pos)), f AS (SELECT * FROM c WHERE CASE WHEN good > 10 THEN score >= 0.75 AND
good_n <= 20 ELSE score >= 0.85 OR rest_n <= 10 - sure END)
SELECT q, pos, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM f""")
def v06(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        (F.col("l_quantity") / 50).alias("score"))
    return retrieval.selected_candidates(r, "q", "pos", "score")


@query("v08_w01_hybrid_search", """
WITH x AS (SELECT p_partkey, greatest(CASE WHEN contains(lower(p_name), 'widget') THEN 1.0 ELSE 0 END, CASE WHEN contains(lower(p_name), 'bolt') THEN
0.95 ELSE 0 END, CASE WHEN contains(lower(p_name), 'cold') THEN 0.9 ELSE 0 END) AS lexical, p_size / 50.0 AS s FROM part),
y AS (SELECT p_partkey, lexical, s / (SELECT max(s) FROM x) AS semantic FROM x)
SELECT p_partkey, lexical, round(semantic, 6) AS semantic, round(0.7 * lexical + 0.3 * semantic, 6) AS score, CASE WHEN lexical > 0 AND semantic > 0
THEN 'both' WHEN lexical > 0 THEN 'lexical' ELSE 'semantic' END AS match_source
FROM y ORDER BY 0.7 * lexical + 0.3 * semantic DESC, p_partkey LIMIT 40""")
def v08(spark, d):
    codes = table(spark, d, "part").withColumn("s", F.col("p_size") / 50)
    return retrieval.hybrid_search(codes, "p_name", "s", ["widget", "bolt", "cold"], "p_partkey",
        40).withColumns({c: F.round(c, 6) for c in ("semantic", "score")})


@query("a22_retrieval_accuracy", over("universal asked", f"""
WITH s AS (SELECT query, code_value, row_number() OVER (PARTITION BY query ORDER BY {COSINE} DESC, code_system, code_value) AS rank FROM universal c,
asked q WHERE active AND {COSINE} >= 0.1),
e AS (SELECT query, [query::VARCHAR, (query + 1)::VARCHAR] AS expected FROM asked), b AS (SELECT e.query, min(CASE WHEN list_contains(expected,
code_value) THEN rank END) AS best, count(rank) AS n FROM e LEFT JOIN (SELECT * FROM s WHERE rank <= 30) s ON s.query = e.query GROUP BY e.query)
SELECT count(*) AS known, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6) AS at_1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6) AS
at_5, round(avg(CASE WHEN best <= 20 THEN 1.0 ELSE 0 END), 6) AS at_20, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END), 6) AS empty FROM b"""))
def a22(spark, d):
    asked = stand_in(spark, d, "asked")
    hits = retrieval.vector_search(stand_in(spark, d, "universal"), asked, ["code_system", "code_value"], 30, 0.1).withColumnRenamed("position",
        "rank")
    return retrieval.retrieval_accuracy(asked.select("query",
        F.array(F.col("query").cast("string"), (F.col("query") + 1).cast("string")).alias("expected")), hits)


@query("j17_listed_similarity", over("universal", """
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM universal a JOIN
universal b ON b.id = a.id + 1"""))
def j17(spark, d):
    u = stand_in(spark, d, "universal").withColumn("model", F.lit("m"))
    return retrieval.listed_similarity(u.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), u).select("a", "b", "similarity")


# text

@query("f01_medication_text", """
SELECT p_partkey, lower(p_name) || ' ' || (p_size * 1000) || ' mg tablet extended release ' || CASE p_partkey % 2 WHEN 0 THEN (CASE WHEN p_size % 4 =
0 THEN '0.25' ELSE '0.5' END) || ' mg brand' ELSE '7 mg' END AS v FROM part""")
def f01(spark, d):
    p = table(spark, d, "part")
    half = F.when(F.col("p_size") % 4 == 0, "250").otherwise("500")
    name = F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" (as Calcium)  HYDROCHLORIDE "), F.col("p_size").cast("string"),
        F.lit(" g Tablet (Extended Release) "), F.when(F.col("p_partkey") % 2 == 0, F.concat(half, F.lit(" mcg"))).otherwise("7 mg"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace(name, " (250|500) mcg", F.lit(" $1 mcg"))).otherwise(name)
    return p.select("p_partkey", T.medication_text(name, F.when(F.col("p_partkey") % 2 == 0,
        F.concat(name, F.lit(" Brand"))).otherwise("")).alias("v"))


@query("f02_f03_code_text", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) || ' repair' WHEN 1 THEN lower(p_name || '  MBS 12') WHEN 2 THEN 'of ' || lower(p_name) || ' mbs' ELSE lower(p_name) || ' 500 mg' END AS v FROM part""")
def f02(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_partkey") % 4
    kind = F.when(n % 2 == 0, "procedure").when(n == 3, "medication").otherwise("condition")
    name = (
        F.when(n == 0, F.concat(F.lit("MBS  23 "), "p_name", F.lit(" T8 including but not limited to Repair "))).when(n == 1, F.concat("p_name", F.lit("  MBS 12")))
        .when(n == 2, F.concat(F.lit(" Initiation of management of of  "), "p_name", F.lit(" t12 MBS"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" 500 mg ")))
    )
    return p.select("p_partkey", T.code_text(kind, name, F.lit("")).alias("v"))


@query("f04_embedding_text", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CASE WHEN length(p_type || ' of ' || p_brand) > length(p_name) THEN p_type ||
' of ' || p_brand ELSE p_name END WHEN 2 THEN p_name || ' ' || p_brand ELSE p_name END AS v FROM part""")
def f04(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("medication", "diagnosis", "lab_result", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.embedding_text(kind, F.col("p_name"), F.concat("p_type", F.lit(" of "), "p_brand"),
        F.col("p_brand")).alias("v"))


@query("f08_f09_n39_identifiers", """
WITH x AS (SELECT s_suppkey, ['mrn no', 'Patient ID', 'medicare card', 'ABC MCX', 'health fund', 'ihi', 'veteran', 'concession', 'hcc',
'file  number', 'some', 'MEDICAL-RECORD'][(s_suppkey % 12 + 1)::INT] AS told, CASE s_suppkey % 3 WHEN 0 THEN '1234-567 890' WHEN 1 THEN ' a_' ELSE
repeat('9', 22) END AS value FROM supplier),
y AS (SELECT *, ['MRN', 'MRN', 'MEDICARE', 'MEDICARE', 'INSURANCE', 'IHI', 'DVA', 'PENSION_CARD', 'HEALTHCARE_CARD', 'FILE_NUMBER', 'SOME',
'MRN'][(s_suppkey % 12 + 1)::INT] AS named, CASE s_suppkey % 3 WHEN 0 THEN '1234567890' WHEN 1 THEN 'a' ELSE repeat('9', 22) END AS norm FROM x),
z AS (SELECT s_suppkey, CASE WHEN s_suppkey % 12 IN (9, 10) AND s_suppkey % 3 = 0 THEN 'MEDICARE' ELSE named END AS kind, norm, length(norm) AS n FROM
y)
SELECT s_suppkey, kind, norm, CASE WHEN kind = 'MEDICARE' AND n NOT IN (10, 11) THEN 'Medicare number should be 10-11 digits, got ' || n WHEN kind =
'IHI' AND n <> 16 THEN 'IHI should be 16 digits, got ' || n WHEN kind = 'MRN' AND n NOT BETWEEN 2 AND 20 THEN 'MRN length unusual: ' || n ||
' characters'
WHEN kind = 'INSURANCE' AND n NOT BETWEEN 3 AND 30 THEN 'Insurance ID length unusual: ' || n || ' characters' WHEN kind = 'DVA' AND n NOT BETWEEN 3
AND 15 THEN 'DVA number length unusual: ' || n || ' characters' END AS warning FROM z""")
def f08(spark, d):
    told = F.element_at(F.array(*map(F.lit, ("mrn no", "Patient ID", "medicare card", "ABC MCX", "health fund", "ihi", "veteran", "concession", "hcc",
        "file  number", "some", "MEDICAL-RECORD"))), (F.col("s_suppkey") % 12 + 1).cast("int"))
    value = F.when(F.col("s_suppkey") % 3 == 0, "1234-567 890").when(F.col("s_suppkey") % 3 == 1, " a_").otherwise("9" * 22)
    rows = table(spark, d, "supplier").select("s_suppkey", T.identifier_type(told, value).alias("kind"), T.normalize_identifier(value).alias("norm"))
    return rows.withColumn("warning", T.identifier_warning(F.col("kind"), F.col("norm")))


@query("f13_shared_words", """
WITH x AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type || ' ' || p_name), ' ') AS b FROM part)
SELECT p_partkey, round(len(list_filter(a, lambda w: len(list_filter(b, lambda v: contains(w, v) OR contains(v, w))) > 0)) / greatest(len(a), len(b)),
6) AS share FROM x""")
def f13(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.shared_words(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")),
        6).alias("share"))


@query("f17_f18_search_text", """
SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' BP' AS v, 2 AS n FROM part""")
def f17(spark, d):
    parts = T.synonyms(F.concat(F.col("p_type"), F.lit("; BP;;ab ; "), F.col("p_type"), F.lit(";BP")))
    kept = T.search_text(F.col("p_name"), F.col("p_brand"), F.lit(" "), parts)
    return table(spark, d, "part").select("p_partkey", kept.alias("v"), (F.size(parts) - 1).alias("n"))


@query("f32_phones", over("patient_info", """
SELECT document_id, phone IN ('5551234567', '+1 (555) 123-4567') AS ok, CASE WHEN phone IN ('5551234567', '555.123.4567') THEN '(555) 123-4567' ELSE
phone END AS shown FROM patient_info"""))
def f32(spark, d):
    return stand_in(spark, d, "patient_info").select("document_id", T.valid_phone(F.col("phone")).alias("ok"),
        T.formatted_phone(F.col("phone")).alias("shown"))


@query("f35_error_codes", """
WITH x AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 WHEN 3 THEN 404 END AS status, CASE event_id % 7 WHEN 0
THEN 'Rate limit' WHEN 1 THEN 'JSON parse' WHEN 2 THEN 'socket hang up' WHEN 3 THEN 'Encounter 5 not found' WHEN 4 THEN NULL WHEN 5 THEN
'duplicate key' ELSE 'request timed out' END AS m FROM events)
SELECT event_id, CASE status WHEN 429 THEN 'RATE_LIMIT' WHEN 403 THEN 'API_AUTH' WHEN 503 THEN 'API_5XX' WHEN 404 THEN 'API_4XX' ELSE CASE m WHEN
'Rate limit' THEN 'RATE_LIMIT' WHEN 'JSON parse' THEN 'PARSE_JSON' WHEN 'socket hang up' THEN 'API_5XX' WHEN 'Encounter 5 not found' THEN
'ENCOUNTER_NOT_FOUND' WHEN 'duplicate key' THEN 'DB_ERROR' WHEN 'request timed out' THEN 'API_TIMEOUT' ELSE 'INTERNAL_ERROR' END END AS code FROM
x""")
def f35(spark, d):
    n = F.col("event_id")
    status = F.when(n % 9 == 0, 429).when(n % 9 == 1, 403).when(n % 9 == 2, 503).when(n % 9 == 3, 404)
    message = F.when(n % 7 == 0, "Rate limit").when(n % 7 == 1, "JSON parse").when(n % 7 == 2, "socket hang up").when(n % 7 == 3,
        "Encounter 5 not found").when(n % 7 == 5, "duplicate key").when(n % 7 == 6, "request timed out")
    return table(spark, d, "events").select("event_id", model_output.error_code(message, status).alias("code"))


# dates

@query("f52_preferred_dates", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE
strftime(o_orderdate, '%d/%m/%Y') END AS shown FROM orders""")
def f52(spark, d):
    style = F.when(F.col("o_orderkey") % 3 == 0, "MM/DD/YYYY").when(F.col("o_orderkey") % 3 == 1, "YYYY-MM-DD")
    return table(spark, d, "orders").select("o_orderkey", D.preferred_date(F.col("o_orderdate"), style).alias("shown"))


@query("f53_date_forms", """
SELECT DISTINCT o_orderdate::DATE AS date, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS day_first,
strftime(o_orderdate, '%m/%d/%Y') AS month_first, strftime(o_orderdate, '%d-%b-%Y') AS short, strftime(o_orderdate, '%-d %B %Y') AS long,
upper(strftime(o_orderdate, '%A')) AS weekday, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month,
day(o_orderdate) AS day FROM orders""")
def f53(spark, d):
    return table(spark, d, "orders").select(*D.date_forms(F.col("o_orderdate"))).distinct()


@query("f56_f58_expiry_and_quarters", f"""
SELECT o_orderkey, greatest(0, date_diff('day', {NOW}, o_orderdate)) AS days, 'events_' || year(o_orderdate) || '_q' || quarter(o_orderdate) AS name,
date_trunc('quarter', o_orderdate)::DATE AS first, last_day(o_orderdate) AS month_end FROM orders""")
def f56(spark, d):
    q, date = D.quarter_partition("events", F.col("o_orderdate")), F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", D.days_to_expiry(date, now()).alias("days"), q["name"].alias("name"),
        q["first"].alias("first"), D.month_bounds(date)["last"].alias("month_end"))


@query("f60_corrected_years", """
WITH x AS (SELECT o_orderkey, (o_orderdate + INTERVAL (o_orderkey % 20) YEAR)::DATE AS t FROM orders)
SELECT o_orderkey, (CASE WHEN year(t) > 2002 THEN t + INTERVAL (1997 - year(t)) YEAR ELSE t END)::DATE::VARCHAR AS v FROM x""")
def f60(spark, d):
    moved = F.add_months("o_orderdate", (F.col("o_orderkey") % 20 * 12).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", D.corrected_year(moved, now()).cast("string").alias("v"))


# access

@query("r03_u02_accessible_profiles", over("profiles grants", f"""
SELECT owner_id AS user_id, profile_id, 'owner' AS access_type FROM profiles WHERE archived = false UNION ALL
SELECT g.user_id, g.profile_id, g.level FROM grants g JOIN profiles p ON p.profile_id = g.profile_id AND p.archived = false WHERE level IN
('read_only', 'read_write', 'full_access', 'owner') AND (access_end IS NULL OR access_end > {NOW}) AND revoked_at IS NULL"""))
def r03(spark, d):
    return access.accessible_profiles(stand_in(spark, d, "profiles"), stand_in(spark, d, "grants"), now(), "read_only")


@query("r01_r02_secured_rows", over("profiles grants", f"""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT profile_id FROM profiles WHERE owner_id = 7 AND archived = false UNION ALL
SELECT g.profile_id FROM grants g JOIN profiles p ON p.profile_id = g.profile_id AND p.archived = false WHERE user_id = 7 AND level IN ('full_access',
'owner') AND (access_end IS NULL OR access_end > {NOW}) AND revoked_at IS NULL)"""))
def r01(spark, d):
    may = access.accessible_profiles(stand_in(spark, d, "profiles"), stand_in(spark, d, "grants"), now(), "full_access")
    return access.secured(table(spark, d, "orders").select("o_orderkey", "o_custkey"), may, 7, "o_custkey").select("o_orderkey", "o_custkey")


@query("r04_provider_access", over("provider_grants", f"""
WITH q AS (SELECT DISTINCT o_custkey AS patient_id, o_custkey % 10 AS provider_id, 'labs' AS resource FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY provider_id, patient_id ORDER BY grant_id) AS n FROM provider_grants WHERE status = 'active' AND
(expires_at IS NULL OR expires_at > {NOW}) AND scope_name = 'labs')
SELECT q.patient_id, coalesce(h.pledged, false) AS granted, CASE WHEN h.grant_id IS NULL THEN 'no_active_permission' WHEN NOT h.pledged THEN
'pledge_not_acknowledged' END AS reason, h.grant_id FROM q LEFT JOIN h ON h.patient_id = q.patient_id AND h.provider_id = q.provider_id AND h.n =
1"""))
def r04(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), (F.col("o_custkey") % 10).alias("provider_id"),
        F.lit("labs").alias("resource")).distinct()
    grants = stand_in(spark, d, "provider_grants").withColumn("scope", F.array("scope_name"))
    return access.provider_access(asked, grants, now()).select("patient_id", "granted", "reason", "grant_id")


@query("r05_p08_consented", over("consents", f"""
SELECT c_custkey AS patient_id, EXISTS (SELECT 1 FROM consents k WHERE k.patient_id = c_custkey AND (granted_to = c_custkey % 10 OR granted_to IS
NULL) AND (resource_type = 'labs' OR resource_type IS NULL) AND purpose = 'healthcare_services' AND granted
AND {NOW} >= valid_from AND (valid_until IS NULL OR {NOW} <= valid_until) AND revoked_at IS NULL) AS allowed FROM customer"""))
def r05(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 10).alias("accessor_id"),
        F.lit("labs").alias("resource"))
    return access.consented(asked, stand_in(spark, d, "consents"), now()).select("patient_id", "allowed")


@query("n06_consent_status", over("consents", f"""
SELECT consent_id, CASE WHEN NOT granted OR revoked_at IS NOT NULL THEN 'Revoked' WHEN valid_until < {NOW} THEN 'Expired' WHEN granted AND {NOW} >=
valid_from AND (valid_until IS NULL OR {NOW} <= valid_until) THEN 'Active' ELSE 'Inactive' END AS consent_status,
CASE WHEN valid_until IS NOT NULL THEN greatest(0, date_diff('day', {NOW}, valid_until)) END AS days FROM consents"""))
def n06(spark, d):
    c = F.col
    return stand_in(spark, d, "consents").select("consent_id",
        access.consent_status(c("granted"), c("valid_from"), c("valid_until"), c("revoked_at"), now()).alias("consent_status"),
        D.days_to_expiry(c("valid_until"), now()).alias("days"))


@query("r06_j18_semantic_access", over("profiles grants consents provider_grants", f"""
WITH a AS (SELECT DISTINCT user_id, profile_id FROM (SELECT owner_id AS user_id, profile_id FROM profiles WHERE archived = false UNION ALL SELECT
g.user_id, g.profile_id FROM grants g JOIN profiles p ON p.profile_id = g.profile_id AND p.archived = false
WHERE level IN ('read_only', 'read_write', 'full_access', 'owner') AND (access_end IS NULL OR access_end > {NOW}) AND revoked_at IS NULL) t), q AS
(SELECT c_custkey AS profile_id, c_custkey % 25 AS user_id, CASE c_custkey % 2 WHEN 0 THEN 'narrative_data' ELSE 'general' END AS resource FROM
customer)
SELECT q.profile_id, EXISTS (SELECT 1 FROM a WHERE a.user_id = q.user_id AND a.profile_id = q.profile_id) AND (resource = 'general' OR EXISTS (SELECT
1 FROM consents k WHERE k.patient_id = q.profile_id AND consent_type = 'ai_processing' AND status = 'granted' AND (valid_until IS NULL OR valid_until
> {NOW}))) AS allowed,
EXISTS (SELECT 1 FROM provider_grants g WHERE g.patient_id = q.profile_id AND g.provider_id = q.user_id AND g.status = 'active' AND g.pledged AND
g.provider_id <> 3) AS via_provider FROM q"""))
def r06(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), (F.col("c_custkey") % 25).alias("user_id"),
        F.when(F.col("c_custkey") % 2 == 0, "narrative_data").otherwise("general").alias("resource"))
    may = access.accessible_profiles(stand_in(spark, d, "profiles"), stand_in(spark, d, "grants"), now(), "read_only")
    grants = stand_in(spark, d, "provider_grants").withColumn("consent_given", F.col("pledged"))
    providers = spark.range(10).select(F.col("id").alias("provider_id"), F.col("id").alias("user_id"), (F.col("id") != 3).alias("active"))
    rows = access.semantic_access(asked, may, stand_in(spark, d, "consents").withColumn("expires_at", F.col("valid_until")), providers, grants, now())
    return rows.select("profile_id", "allowed", "via_provider")


@query("r07_allowed_patients", over("profiles", """
SELECT profile_id, profile_id AS patient_id, profile_type AS relationship, 'full' AS scope FROM profiles WHERE archived = false UNION ALL
SELECT a.profile_id, b.profile_id, 'emergency', 'emergency' FROM profiles a JOIN profiles b ON b.owner_id = a.owner_id AND b.profile_type = 'self' AND
b.profile_id <> a.profile_id WHERE a.archived = false"""))
def r07(spark, d):
    return access.allowed_patients(stand_in(spark, d, "profiles"), now()).select("profile_id", "patient_id", "relationship", "scope")


@query("r08_n27_feature_gate", """
SELECT c_custkey, c_custkey % 5 = 0 OR c_custkey % 50 IN (7, 9) AS enabled FROM customer""")
def r08(spark, d):
    users = access.listed_user(access.listed_user(F.array(F.lit("7"), F.lit("8")), F.lit("9"), True), F.lit("8"), False)
    user = (F.col("c_custkey") % 50).cast("string")
    return table(spark, d, "customer").select("c_custkey", access.feature_enabled(F.col("c_custkey") % 5 == 0, users, 0, user).alias("enabled"))


# queues

@query("t08_enqueued", over("jobs", """
SELECT job_id, CASE WHEN payload LIKE '%job_lane%' THEN 'fast_queue' ELSE CASE job_type WHEN 'ai_processing' THEN 'ai_queue_simple' WHEN
'shell_file_processing' THEN 'standard_queue' END END AS job_lane, CASE WHEN payload LIKE '%estimated%' THEN 250 ELSE 1000 END AS estimated_tokens,
NULL::VARCHAR AS reason
FROM jobs WHERE job_type <> 'no_such_type' AND payload IS NOT NULL AND length(payload) > 2 AND NOT (payload LIKE '%job_lane%' AND job_type <>
'shell_file_processing') UNION ALL
SELECT job_id, NULL, NULL, CASE WHEN job_type = 'no_such_type' THEN 'invalid_job_type' WHEN payload LIKE '%job_lane%' AND job_type <>
'shell_file_processing' THEN 'invalid_job_lane' ELSE 'empty_payload' END FROM jobs
WHERE job_type = 'no_such_type' OR payload IS NULL OR length(payload) = 2 OR (payload LIKE '%job_lane%' AND job_type <> 'shell_file_processing')"""))
def t08(spark, d):
    good, bad = queues.enqueued(stand_in(spark, d, "jobs"))
    none = lambda kind: F.lit(None).cast(kind)
    return good.select("job_id", "job_lane", "estimated_tokens",
        none("string").alias("reason")).unionByName(bad.select("job_id", none("string").alias("job_lane"), none("int").alias("estimated_tokens"),
        "reason"))


@query("t05_l11_claimed_jobs", over("jobs", f"""
WITH n AS (SELECT job_id FROM jobs WHERE status = 'pending' AND scheduled_at <= {LATE} AND job_type IN ('ai_processing', 'audit_cleanup') ORDER BY
priority DESC, created_at, job_id LIMIT 3)
SELECT job_id, CASE WHEN status = 'processing' AND heartbeat_at < {LATE} - INTERVAL 300 SECOND THEN CASE WHEN retry_count < max_retries THEN 'reclaim'
ELSE 'dead_letter' END WHEN job_id IN (SELECT job_id FROM n) THEN 'claim' ELSE 'none' END AS action,
retry_count + (status = 'processing' AND heartbeat_at < {LATE} - INTERVAL 300 SECOND AND retry_count < max_retries)::INT AS retry_count FROM jobs"""))
def t05(spark, d):
    return queues.claimed(stand_in(spark, d, "jobs").withColumn("job_lane", F.lit("x")), late(), ["ai_processing", "audit_cleanup"],
        workers=3).select("job_id", "action", "retry_count")


@query("t06_watchdog", over("jobs", f"""
SELECT count(*) FILTER (WHERE retry_count < max_retries) AS requeued, count(*) FILTER (WHERE retry_count >= max_retries) AS failed FROM jobs WHERE
status = 'processing' AND heartbeat_at < {LATE} - INTERVAL 120 SECOND"""))
def t06(spark, d):
    return queues.watchdog(stand_in(spark, d, "jobs"), late())


LIMITED = """RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s, floor(value)::BIGINT % 50 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM events),
w(event_id, user_id, n, opened, used, spent, allowed) AS (SELECT event_id, user_id, n, s, 1, tokens, true FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.s > w.opened + 86400 THEN e.s ELSE w.opened END, CASE WHEN e.s > w.opened + 86400 THEN 1 ELSE
w.used + (w.used < 3 AND w.spent + e.tokens <= 80)::INT END,
CASE WHEN e.s > w.opened + 86400 THEN e.tokens ELSE w.spent + CASE WHEN w.used < 3 AND w.spent + e.tokens <= 80 THEN e.tokens ELSE 0 END END, e.s >
w.opened + 86400 OR (w.used < 3 AND w.spent + e.tokens <= 80) FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)"""


@query("t02_t03_window_limit", f"WITH {LIMITED} SELECT event_id, allowed FROM w")
def t02(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"),
        (F.floor("value") % 50).alias("tokens"))
    return queues.window_limit(e, ["user_id"], "s", "event_id", 3, 86400, "tokens", 80).select("event_id", "allowed")


@query("a24_n08_monthly_usage", """
WITH u AS (SELECT o_custkey AS profile_id, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS files, sum(o_orderkey % 7) AS pages,
sum(o_orderkey % 1000) AS tokens, sum(o_orderkey % 500) // 60 AS minutes FROM orders GROUP BY ALL)
SELECT profile_id, month, files, pages, tokens, minutes, round(100.0 * files / 2, 1) AS files_percent, round(100.0 * pages / 9, 1) AS pages_percent,
CASE WHEN profile_id % 3 <> 0 THEN round(100.0 * tokens / 700, 1) END AS tokens_percent,
files > 2 OR pages > 9 OR (profile_id % 3 <> 0 AND tokens > 700) AS over_limit FROM u""")
def a24(spark, d):
    n = F.col("o_orderkey")
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").alias("at"), F.lit(1).alias("files"),
        (n % 7).alias("pages"), (n % 1000).alias("tokens"), (n % 500).alias("seconds"))
    limits = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.lit(2).alias("files_limit"), F.lit(9).alias("pages_limit"),
        F.when(F.col("c_custkey") % 3 != 0, 700).alias("tokens_limit"))
    return queues.usage_by_month(e, limits)


@query("a01_d11_session_metrics", """
WITH c AS (SELECT conv_id, count(*) AS chunks, sum(length(text)) AS tokens_in, sum(turn) AS tokens_out, round(sum(length(text) / 1000.0), 6) AS cost,
round(avg(CASE role WHEN 'user' THEN 0.6 ELSE 0.9 END), 6) AS confidence, count(*) FILTER (WHERE turn % 5 = 4) AS failed FROM conversations GROUP BY
conv_id)
SELECT conv_id AS session_id, chunks, tokens_in, tokens_out, cost, confidence, failed, (SELECT count(*) FROM conversations p WHERE p.conv_id =
c.conv_id AND p.turn % 2 = 0) AS open_fragments,
array_to_string(list_filter([CASE WHEN true THEN 'fragments_left' END, CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN failed > 0 THEN
'failed_chunks' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def a01(spark, d):
    t, at = table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id"), F.lit("2024-01-01").cast("timestamp_ntz")
    chunks = t.select("session_id", F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"), (F.length("text") / 1000).alias("cost"),
        F.when(F.col("role") == "user", 0.6).otherwise(0.9).alias("confidence"), at.alias("started_at"), at.alias("completed_at"),
        F.when(F.col("turn") % 5 == 4, "failed").otherwise("completed").alias("status"))
    pendings = t.select("session_id", F.when(F.col("turn") % 2 == 0, "pending").otherwise("done").alias("status"), F.lit(True).alias("is_cascading"),
        F.lit("c").alias("cascade_id"), F.col("role").alias("encounter_type"))
    return queues.session_metrics(chunks, pendings).select("session_id", "chunks", "tokens_in", "tokens_out", "cost", "confidence", "failed",
        "open_fragments", F.array_join("reasons", ",").alias("reasons"))


@query("a17_a18_batch_rollup", """
SELECT l_orderkey, count(*) AS batches, count(*) FILTER (WHERE l_returnflag <> 'R') AS succeeded, count(*) FILTER (WHERE l_returnflag = 'R') AS
failed, greatest(sum(l_linenumber) - count(*), 0) AS retries, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS first_failed,
arg_min(l_linestatus, CASE WHEN l_returnflag = 'R' THEN l_linenumber * 10 + (l_linestatus = 'O')::INT END) AS error_code, coalesce(sum(CASE WHEN
l_returnflag <> 'R' THEN l_quantity::INT END), 0) AS entities, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_partkey END), 0) AS tokens, CASE WHEN
count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'failed' ELSE 'succeeded' END AS status FROM lineitem GROUP BY l_orderkey""")
def a17(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("batch_index"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("status"), F.col("l_linenumber").alias("attempts"),
        F.col("l_linestatus").alias("error_code"), F.col("l_quantity").cast("int").alias("entities"), F.col("l_partkey").alias("tokens"))
    return queues.batch_rollup(rows, "l_orderkey")


# reconciliation

@query("d10_planned_batches", """
WITH v AS (SELECT o_orderkey, (o_orderkey % 150 + 51) AS n FROM orders), s AS (SELECT o_orderkey, n, unnest(range(0, n, 50)) AS k FROM v)
SELECT o_orderkey, k // 50 AS index, k + 1 AS start, CASE WHEN k + 51 < n THEN k + 50 ELSE n END AS "end" FROM s WHERE k = 0 OR k + 1 < n""")
def d10(spark, d):
    v = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("a"), (F.col("o_orderkey") % 150 + 51).cast("int").alias("b"),
        F.array().cast("array<int>").alias("s"))
    return reconcile.planned_batches(v, "o_orderkey", "a", "b", "s")


@query("d06_w02_w12_reconciled", over("fragments", """
WITH f AS (SELECT *, coalesce(cascade_id, pending_id) AS group_id FROM fragments), o AS (SELECT *, lag(chunk_number) OVER w AS cb, lag(end_page) OVER
w AS eb FROM f WINDOW w AS (PARTITION BY session_id, group_id ORDER BY chunk_number, pending_id)),
bad AS (SELECT DISTINCT session_id, group_id FROM o WHERE chunk_number <> cb + 1 OR start_page < eb UNION SELECT session_id, group_id FROM f GROUP BY
ALL HAVING count(DISTINCT encounter_type) > 1)
SELECT session_id, group_id, count(*) AS fragments, max(chunk_number) AS last_chunk, arg_min(start_page, chunk_number) AS start_page,
arg_min(start_marker, chunk_number) AS start_marker, arg_max(end_page, chunk_number) AS end_page, arg_max(end_marker, chunk_number) AS end_marker,
bool_or(is_real_world_visit) AS is_real_world_visit,
round(sum(coalesce(nullif(position_confidence, 0), 0.5) * (end_page - start_page + 1)) / sum(end_page - start_page + 1), 6) AS position_confidence,
CASE WHEN bool_or(patient_full_name = 'Ann Lee') THEN 'Ann Lee' WHEN bool_or(patient_full_name = 'Ann') THEN 'Ann' END AS patient_full_name
FROM f WHERE (session_id, group_id) NOT IN (SELECT (session_id, group_id) FROM bad) GROUP BY session_id, group_id"""))
def d06(spark, d):
    rows = stand_in(spark, d, "fragments").withColumn("page_ranges", F.array(F.array("start_page", "end_page")))
    visits, _ = reconcile.reconciled(rows, F.lit(None).cast("string"), F.lit(AS_OF), 1998)
    return visits.select("session_id", "group_id", "fragments", "last_chunk", "start_page", "start_marker", "end_page", "end_marker",
        "is_real_world_visit", F.round("position_confidence", 6).alias("position_confidence"), "patient_full_name")


@query("d15_row_changes", """
SELECT o_orderkey, 'UPDATE' AS action FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'DELETE' FROM orders
WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 UNION ALL SELECT -o_orderkey - 1, 'INSERT' FROM orders WHERE o_orderkey % 5 = 0""")
def d15(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    old = o
    new = o.where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0").withColumn("o_orderstatus",
        F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 2 == 0), "changed").otherwise(F.col("o_orderstatus")))
    new = new.unionByName(o.where("o_orderkey % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return reconcile.row_changes(old, new, ["o_orderkey"]).select("o_orderkey", "action")


@query("d01_identity_keys", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rxnorm:' || p_size WHEN 1 THEN 'pbs:' || p_brand WHEN 2 THEN 'composite:' || lower(p_name) || ':' ||
p_size || ':unknown' ELSE 'fallback:' || p_partkey END AS key FROM part""")
def d01(spark, d):
    n, none = F.col("p_partkey") % 4, F.lit(None).cast("string")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("id"),
        F.when(n == 0, F.col("p_size").cast("string")).alias("rxnorm_code"), F.when(n == 1, F.col("p_brand")).alias("pbs_code"),
        none.alias("atc_code"), F.col("p_name").alias("name"), F.when(n == 2, F.col("p_size").cast("string")).alias("strength"), none.alias("form"))
    return rows.select("p_partkey", timeline.identity_key("medications").alias("key"))


# timelines

@query("a38_journey_summary", over("timeline", """
SELECT patient_id, condition_id, count(*) AS events, count(*) FILTER (WHERE category = 'diagnosis') AS diagnosiss, count(*) FILTER (WHERE category =
'treatment') AS treatments, count(*) FILTER (WHERE is_major) AS major, min(event_date) AS first_date, max(event_date) AS last_date,
string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM timeline WHERE archived IS NOT TRUE AND condition_id IS NOT NULL GROUP BY
patient_id, condition_id"""))
def a38(spark, d):
    return timeline.journey_summary(stand_in(spark, d, "timeline")).drop("test_results").withColumn("categories", F.array_join("categories", ","))


@query("a37_condition_journeys", over("timeline", """
WITH e AS (SELECT *, CASE category WHEN 'diagnosis' THEN 1 WHEN 'treatment' THEN 2 END AS s FROM timeline WHERE archived IS NOT TRUE), x AS (SELECT
patient_id, condition_id, event_id, event_date, s FROM e WHERE s IS NOT NULL UNION ALL SELECT patient_id, condition_id, event_id, event_date, 3 FROM e
WHERE tag = 'monitoring' OR category = 'test_result')
SELECT patient_id, condition_id, s AS section_order, count(*) AS n, CASE WHEN s = 1 THEN arg_min(event_id, (event_date, event_id)) ELSE
arg_max(event_id, (event_date, -event_id)) END AS head FROM x GROUP BY patient_id, condition_id, s"""))
def a37(spark, d):
    visits = spark.range(9).select(F.col("id").alias("visit_id"), F.lit("Dr Who").alias("provider_name"), F.lit("Clinic").alias("facility_name"))
    rows = timeline.condition_journeys(stand_in(spark, d, "timeline").withColumn("tags", F.array("tag")), visits)
    listed = F.from_json("events", "array<struct<event_id:bigint>>")
    return rows.select("patient_id", "condition_id", "section_order", F.size(listed).cast("long").alias("n"), listed[0]["event_id"].alias("head"))


@query("n01_p02_patient_timeline", over("timeline", """
SELECT event_id FROM timeline WHERE patient_id = 3 AND archived IS NOT TRUE AND category IN ('treatment', 'visit') AND event_date >= TIMESTAMP
'2024-01-05' AND searchable ILIKE '%"K"_%' AND tag IN ('monitoring', 'abnormal')"""))
def n01(spark, d):
    return timeline.patient_timeline(stand_in(spark, d, "timeline").withColumn("tags", F.array("tag")), 3, ["treatment", "visit"], since="2024-01-05",
        search='"K"_', tags=["monitoring", "abnormal"]).select("event_id")


@query("n04_p13_offset_page", over("timeline", """
SELECT event_id, count(*) OVER (PARTITION BY patient_id) AS total FROM timeline WHERE patient_id = 3 ORDER BY title DESC NULLS LAST, event_id LIMIT 20
OFFSET 5"""))
def n04(spark, d):
    order = [timeline.sort_column("title", "desc", {"title": "title", "date": "event_date"}, "date"), F.asc("event_id")]
    return timeline.offset_page(stand_in(spark, d, "timeline").where("patient_id = 3"), "patient_id", order, 20, 5).select("event_id", "total")


@query("a30_imaging_summary", over("reports", """
SELECT patient_id, imaging_type, body_region, count(*) AS studies, min(study_date) AS first_study, max(study_date) AS last_study, count(*) FILTER
(WHERE requires_attention) AS attention, count(*) FILTER (WHERE tag = 'abnormal') AS abnormal,
count(*) FILTER (WHERE tag = 'screening') AS screening, arg_max(coalesce(indication, ''), (study_date, report_id)) AS indication FROM reports GROUP BY
ALL"""))
def a30(spark, d):
    rows = timeline.imaging_summary(stand_in(spark, d, "reports").withColumn("tags", F.array("tag")))
    return rows.withColumn("indication", F.get_json_object("latest", "$.indication")).drop("latest")


@query("a31_imaging_patterns", over("reports", """
SELECT patient_id, 'frequent_imaging' AS pattern, imaging_type || '/' || body_region AS body_region, count(*) AS studies, round(date_diff('second',
min(study_date), max(study_date)) / (30.44 * 86400))::BIGINT AS months FROM reports GROUP BY patient_id, imaging_type, body_region HAVING count(*) >=
3
UNION ALL SELECT patient_id, 'screening_to_diagnostic', body_region, count(*) FILTER (WHERE tag IN ('screening', 'diagnostic')),
round(date_diff('second', min(study_date) FILTER (WHERE tag = 'screening'), max(study_date) FILTER (WHERE tag = 'diagnostic')) / (30.44 *
86400))::BIGINT AS m FROM reports GROUP BY patient_id, body_region HAVING m IS NOT NULL
UNION ALL SELECT patient_id, 'attention_cluster', NULL, count(*), round(date_diff('second', min(study_date), max(study_date)) / (30.44 *
86400))::BIGINT FROM reports WHERE requires_attention GROUP BY patient_id HAVING count(*) >= 2"""))
def a31(spark, d):
    return timeline.imaging_patterns(stand_in(spark, d, "reports").withColumn("tags", F.array("tag")))


@query("d18_alerts", over("diagnoses labs profiles", f"""
WITH m AS (SELECT profile_id AS patient_id, count(*) AS n FROM diagnoses WHERE n % 2 = 1 GROUP BY profile_id HAVING count(*) >= 5), a AS (SELECT
profile_id AS patient_id, date_diff('year', date_of_birth, DATE '{AS_OF}') - (strftime(DATE '{AS_OF}', '%m%d') < strftime(date_of_birth, '%m%d'))::INT
AS age FROM profiles)
SELECT patient_id, 'polypharmacy_check' AS action_type, NULL::VARCHAR AS subject, 'moderate' AS priority, CASE WHEN n >= 10 THEN 'high' ELSE
'moderate' END AS risk FROM m WHERE patient_id % 4 <> 0
UNION ALL SELECT patient_id, 'screening_due', 'mammography', 'routine', NULL FROM a WHERE age BETWEEN 50 AND 74 UNION ALL SELECT patient_id,
'screening_due', 'colorectal', 'routine', NULL FROM a WHERE age BETWEEN 50 AND 75
UNION ALL SELECT profile_id, 'lab_abnormal', item_id::VARCHAR, CASE item_id % 5 WHEN 0 THEN 'critical' ELSE 'moderate' END, NULL FROM labs WHERE date
> {NOW} - INTERVAL 30 DAY AND item_id % 5 IN (0, 1)"""))
def d18(spark, d):
    meds = stand_in(spark, d, "diagnoses").select(F.col("profile_id").alias("patient_id"),
        F.when(F.col("n") % 2 == 1, "active").otherwise("stopped").alias("status"), F.lit(None).cast("boolean").alias("archived"))
    people = stand_in(spark, d, "profiles").select(F.col("profile_id").alias("patient_id"), F.col("date_of_birth").alias("birth_date"))
    flag = F.when(F.col("item_id") % 5 == 0, "critical_high").when(F.col("item_id") % 5 == 1, "low").otherwise("normal")
    labs = stand_in(spark, d, "labs").select(F.col("profile_id").alias("patient_id"), F.col("item_id").alias("lab_id"), flag.alias("flag"),
        F.lit(False).alias("archived"), F.col("date").cast("timestamp_ntz").alias("test_date"))
    items = people.where("patient_id % 4 = 0").select("patient_id", F.lit("polypharmacy_check").alias("action_type"),
        F.lit(None).cast("string").alias("subject"), F.lit("pending").alias("status"), F.lit("1997-06-01").cast("timestamp_ntz").alias("created_at"))
    return timeline.alerts(meds, people, labs, items, now())


@query("d16_visit_events", """
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'outpatient' WHEN 1 THEN 'emergency' WHEN 2 THEN 'telehealth' ELSE 'home' END AS kind,
CASE WHEN o_orderkey % 3 = 0 THEN 'Cardiology' END AS specialty, CASE WHEN o_orderkey % 5 = 0 THEN 'Dr Who' END AS provider, CASE WHEN o_orderkey % 7
= 0 THEN 'Annual check' END AS complaint FROM orders)
SELECT o_orderkey AS visit_id, CASE kind WHEN 'outpatient' THEN 'routine_visit' WHEN 'emergency' THEN 'emergency_visit' WHEN 'telehealth' THEN
'telehealth' ELSE 'healthcare_visit' END AS subcategory, coalesce(specialty, upper(kind[1]) || kind[2:]) || ' Visit' AS title,
coalesce('Visit with ' || provider, upper(kind[1]) || kind[2:] || ' healthcare encounter') || coalesce(' - ' || complaint, '') AS summary, CASE kind
WHEN 'outpatient' THEN 60 WHEN 'emergency' THEN 20 WHEN 'telehealth' THEN 70 ELSE 50 END AS priority,
CASE WHEN kind = 'emergency' THEN 'urgent' WHEN kind IN ('outpatient', 'telehealth') AND complaint IS NOT NULL THEN 'routine' ELSE '' END AS tags FROM
x""")
def d16(spark, d):
    n, none = F.col("o_orderkey"), F.lit(None).cast("string")
    kind = F.when(n % 4 == 0, "outpatient").when(n % 4 == 1, "emergency").when(n % 4 == 2, "telehealth").otherwise("home")
    rows = table(spark, d, "orders").select(n.alias("visit_id"), F.col("o_custkey").alias("patient_id"), kind.alias("encounter_type"),
        F.when(n % 3 == 0, "Cardiology").alias("specialty"), F.when(n % 5 == 0, "Dr Who").alias("provider_name"), none.alias("facility_name"),
        F.when(n % 7 == 0, "Annual check").alias("complaint"), none.alias("summary"), F.col("o_orderdate").alias("visit_date"))
    return timeline.event_of_visit(rows).select("visit_id", "subcategory", "title", "summary", "priority", F.array_join("tags", ",").alias("tags"))


@query("n03_f30_answers", over("timeline", f"""
WITH q AS (SELECT c_custkey AS question_id, c_custkey % 15 AS patient_id, c_custkey % 3 AS k FROM customer)
SELECT question_id, CASE k WHEN 0 THEN 'recent_tests' ELSE 'recent_visits' END AS response_type, count(*) AS n, CASE k WHEN 0 THEN 0.8 ELSE 0.85 END
AS confidence FROM q JOIN timeline t ON t.patient_id = q.patient_id AND archived IS NOT TRUE
AND CASE k WHEN 0 THEN category = 'test_result' WHEN 1 THEN category = 'visit' AND event_date >= {LATE} - INTERVAL 1 MONTH END WHERE k < 2 GROUP BY
question_id, k"""))
def n03(spark, d):
    n = F.col("c_custkey")
    text = F.when(n % 3 == 0, "Show my RESULTS").when(n % 3 == 1, "each doctor of the last month").otherwise("zzzz?")
    q = table(spark, d, "customer").select(n.alias("question_id"), (n % 15).alias("patient_id"), text.alias("text"))
    return timeline.answers(q, stand_in(spark, d, "timeline"), late()).select("question_id", "response_type",
        F.size("events").cast("long").alias("n"), "confidence")


# pages

@query("w05_page_text", over("words", """
WITH l AS (SELECT *, (floor(y / 10.0 + 0.5) * 10)::BIGINT AS line FROM words), s AS (SELECT *, text || ' (x:' || x || ')' || CASE WHEN lead(x) OVER
(PARTITION BY page, line ORDER BY x, seq) - x > 20 THEN ' |' ELSE '' END AS said FROM l),
t AS (SELECT page, line, '[Y:' || line || '] ' || string_agg(said, ' ' ORDER BY x, seq) AS said FROM s GROUP BY page, line)
SELECT page, string_agg(said, chr(10) ORDER BY line) AS text FROM t GROUP BY page"""))
def w05(spark, d):
    return layout.page_text(stand_in(spark, d, "words"), ["page"])


@query("w06_page_text_by_y", over("words", """
WITH l AS (SELECT *, (floor(y / 10.0 + 0.5) * 10)::BIGINT AS line FROM words), t AS (SELECT page, line, '[Y:' || line || '] ' || string_agg(text, ' '
ORDER BY x, seq) AS said FROM l GROUP BY page, line)
SELECT page, string_agg(said, chr(10) ORDER BY line) AS text FROM t GROUP BY page"""))
def w06(spark, d):
    return layout.page_text(stand_in(spark, d, "words"), ["page"], with_x=False)


@query("j10_zone_of_entity", """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_tax) AS x, min(l_returnflag) AS t FROM lineitem GROUP BY ALL), z AS (SELECT
l_orderkey AS page, l_orderkey * 10 + l_linenumber AS zone_id, q - 10 AS a, q + 10 AS b, t FROM l),
e AS (SELECT l_orderkey * 10 + l_linenumber AS entity_id, l_orderkey AS page, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE x * 500 END AS y, t FROM
l)
SELECT e.entity_id, arg_min(zone_id, (CASE WHEN z.t = e.t THEN 0 ELSE 1 END, zone_id)) AS zone_id FROM e LEFT JOIN z ON z.page = e.page AND e.y
BETWEEN z.a AND z.b GROUP BY e.entity_id""")
def j10(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("x"),
        F.min("l_returnflag").alias("t"))
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    zones = line.select(F.col("l_orderkey").alias("page"), n.alias("zone_id"), (F.col("q") - 10).alias("y_start"), (F.col("q") + 10).alias("y_end"),
        F.col("t").alias("schema_type"))
    found = line.select(n.alias("entity_id"), F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 4 != 0, F.col("x") * 500).alias("y"),
        F.col("t").alias("entity_type"))
    return layout.zone_of(found, zones)


@query("f39_estimated_text", """
WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, '[Y:754] ' || list_reduce(list_transform(w, lambda v, i: v ||
' (x:' || (i - 1) * 100 || ')'), lambda a, b: a || ' | ' || b) || chr(10) || '[Y:1508] end (x:0)' AS text FROM x""")
def f39(spark, d):
    return table(spark, d, "part").select("p_partkey", layout.estimated_text(F.concat("p_name", F.lit("\n end "))).alias("text"))


# graph

@query("g01_reachable", """
WITH RECURSIVE e AS (SELECT vec_id AS a, vec_id * 2 % 499 AS b FROM embeddings UNION SELECT vec_id, vec_id // 7 FROM embeddings), r(start, node) AS
(SELECT s, s FROM (VALUES (1::BIGINT), (250::BIGINT), (100000::BIGINT)) t(s) UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node) SELECT start,
node FROM r""")
def g01(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("a"))
    edges = v.select("a", (F.col("a") * 2 % 499).alias("b")).unionByName(v.select("a", F.floor(F.col("a") / 7).alias("b")))
    return graph.reachable(edges, spark.createDataFrame([(1,), (250,), (100000,)], "start long"))


@query("g03_neighbours", """
SELECT n_regionkey AS node, n_nationkey AS strength, 'parent' AS side FROM nation WHERE n_nationkey = 3 UNION ALL SELECT n_nationkey, n_nationkey,
'child' FROM nation WHERE n_regionkey = 3""")
def g03(spark, d):
    edges = table(spark, d, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"),
        F.col("n_nationkey").alias("strength"))
    return timeline.neighbours(edges, 3)


# model output

@query("f34_f95_entities", """
SELECT p_partkey, 'e' || CASE p_partkey % 5 WHEN 0 THEN 1 ELSE 1 END AS id, p_name AS original_text, CASE p_partkey % 5 WHEN 0 THEN 'medication' WHEN
1 THEN 'immunisation' WHEN 2 THEN 'lab_result' ELSE 'condition' END AS entity_type, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END AS page_number,
3 AS n
FROM part WHERE p_partkey % 5 <> 4""")
def f95(spark, d):
    n = F.col("p_partkey")
    kind = F.when(n % 5 == 0, " RX ").when(n % 5 == 1, "vaccine").when(n % 5 == 2, "labs").when(n % 5 == 3, "condition").otherwise("nonsense")
    entity = F.struct(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("original_text"), kind.alias("entity_type"),
        F.when(n % 2 == 0, F.col("p_size").cast("string")).otherwise("x").alias("page_number"),
        F.array(*map(F.lit, ("a", " ", " b", "c", "d"))).alias("aliases"))
    rows = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.array(entity).alias("entities"))).alias("json"))
    good, _ = model_output.entities(rows, "p_partkey", "json")
    return good.select("p_partkey", "id", "original_text", "entity_type", "page_number", F.size("aliases").alias("n"))


@query("f76_a40_costs", """
SELECT l_orderkey, l_linenumber, round((l_partkey * CASE l_linenumber % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 0.4 ELSE 1.0 END + l_suppkey * CASE l_linenumber
% 3 WHEN 0 THEN 10.0 WHEN 1 THEN 1.6 ELSE 4.0 END) / 1000000.0, 9) AS cost FROM lineitem""")
def f76(spark, d):
    calls = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("model"),
        F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"))
    prices = spark.createDataFrame([("m0", 2.5, 10.0), ("m1", 0.4, 1.6)], "model string, price_in double, price_out double")
    return model_output.with_cost(calls, prices, (1.0, 4.0)).select("l_orderkey", "l_linenumber", "cost")


@query("f78_output_quality", """
SELECT o_orderkey, round(greatest(0, least(100, 100 - 25 * (o_orderkey % 3) - 5 * (o_orderkey % 4) - greatest(0, 0.9 - (o_orderkey % 10) / 10.0) * 20
- greatest(0, 50 - o_orderkey % 100) * 0.5)), 6) AS score FROM orders""")
def f78(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(model_output.output_quality(n % 3, n % 4, (n % 10) / 10.0,
        (n % 100).cast("double")), 6).alias("score"))
