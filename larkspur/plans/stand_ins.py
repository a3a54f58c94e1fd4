"""Stand-ins for records: the driver's generic tables under the names and columns that the operators read.

Each is one SELECT that Spark and the oracles' engine both understand; tables stand in braces. Registered queries apply an operator to stand-ins,
their oracles say the same in SQL over the same stand-ins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import table

AS_OF = "1997-06-15"
#: Words of diagnoses, providers and so on, chosen by a number of the row.
PICK = "CASE {k} {cases} ELSE {last} END"


def pick(k: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return PICK.format(k=k, cases=cases, last=f"'{values[-1]}'")


SQL = {
    "profiles": f"""SELECT c_custkey AS profile_id, c_nationkey AS owner_id, c_name AS display_name, DATE '1930-01-01' + CAST(c_custkey * 37 % 24000 AS INT) AS date_of_birth,
        {pick('c_custkey % 10', 'pet', 'child', 'self')} AS profile_type, CASE WHEN c_custkey % 10 = 0 THEN 'dog' END AS species,
        CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS archived FROM {{customer}}""",
    "appointments": f"""SELECT o_orderkey AS item_id, o_custkey AS document_id, o_custkey AS profile_id, CAST(o_orderdate AS DATE) AS date,
        {pick('o_orderkey % 6', 'City Veterinary Clinic', 'Pediatric Group', 'Dr Smith, Cardiologist', 'General Practice')} AS provider FROM
{{orders}}""",
    "labs": """SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS document_id, l_orderkey AS profile_id, CAST(l_shipdate AS DATE) AS date FROM {lineitem}""",
    "patient_info": """SELECT o_orderkey AS document_id, o_custkey AS profile_id, CASE o_orderkey % 5 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN 'Xq' WHEN 3 THEN NULL ELSE concat('Customer ', CAST(o_orderkey AS STRING)) END AS name,
        DATE '1930-01-01' + CAST(c_custkey * 37 % 24000 + o_orderkey % 3 * 400 AS INT) AS date_of_birth, CASE o_orderkey % 4 WHEN 0 THEN '555-12' WHEN
1 THEN '5551234567' WHEN 2 THEN '555.123.4567' ELSE '+1 (555) 123-4567' END AS phone,
        c_name AS display_name, DATE '1930-01-01' + CAST(c_custkey * 37 % 24000 AS INT) AS profile_birth FROM {orders} JOIN {customer} ON o_custkey =
c_custkey""",
    "diagnoses": f"""SELECT l_orderkey AS document_id, o_custkey AS profile_id, l_linenumber AS n, {pick('(l_partkey + l_linenumber) % 8', 'Infant colic', 'COPD', 'Early Dementia', 'Flea infestation', 'Developmental delay', 'Menopause', 'Hypertension')} AS condition,
        DATE '1930-01-01' + CAST(c_custkey * 37 % 24000 AS INT) AS date_of_birth FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN
{{customer}} ON o_custkey = c_custkey""",
    "vitals": f"""SELECT l_orderkey AS document_id, o_custkey AS profile_id, l_linenumber AS n, {pick('(l_partkey + l_linenumber) % 7', 'Blood Pressure Systolic', 'Blood pressure diastolic', 'Heart Rate', 'Body temperature', 'Weight', 'Height', 'Oxygen')} AS type,
        CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE concat(CAST(CAST(l_quantity AS INT) * 6 AS STRING), ' u') END AS value, {pick('o_custkey % 10',
'pet', 'child', 'self')} AS profile_type
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "medicines": f"""SELECT l_orderkey AS document_id, o_custkey AS profile_id, l_linenumber AS n, {pick('l_partkey % 4', 'Aspirin 100 mg', 'Children Ibuprofen', 'Metformin 500 mg', 'Acetaminophen')} AS name,
        {pick('o_custkey % 10', 'pet', 'child', 'self')} AS profile_type, CASE WHEN o_custkey % 20 = 0 THEN 'dog' END AS species FROM {{lineitem}}
JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "universal": f"""SELECT vec_id AS id, {pick('vec_id % 4', 'rxnorm', 'snomed', 'loinc', 'icd10')} AS code_system, CAST(vec_id AS STRING) AS code_value, CASE WHEN vec_id % 11 = 0 THEN false ELSE true END AS active, embedding FROM {{embeddings}}""",
    "regional": f"""SELECT vec_id AS id, {pick('vec_id % 3', 'pbs', 'mbs', 'snomed')} AS code_system, CAST(vec_id AS STRING) AS code_value, CASE WHEN vec_id % 5 = 0 THEN 'NZL' ELSE 'AUS' END AS country, embedding FROM {{embeddings}}""",
    "asked": f"""SELECT vec_id AS query, {pick('label % 5', 'medication', 'procedure', 'lab_result', 'diagnosis', 'other')} AS entity_type, embedding FROM {{embeddings}} WHERE vec_id % 50 = 0""",
    "grants": f"""SELECT o_orderkey AS grant_id, o_custkey % 25 AS user_id, o_custkey AS profile_id, {pick('o_orderkey % 5', 'emergency', 'read_only', 'read_write', 'full_access', 'owner')} AS level,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS access_end, CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS revoked_at
FROM {{orders}}""",
    "provider_grants": f"""SELECT o_orderkey AS grant_id, o_custkey % 10 AS provider_id, o_custkey AS patient_id, {pick('o_orderkey % 4', 'revoked', 'active')} AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS expires_at,
        o_orderkey % 5 <> 0 AS pledged, CASE o_orderkey % 3 WHEN 0 THEN 'medications' ELSE 'labs' END AS scope_name FROM {{orders}}""",
    "consents": f"""SELECT o_orderkey AS consent_id, o_custkey AS patient_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 10 END AS granted_to, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'labs' END AS resource_type,
        {pick('o_orderkey % 2', 'healthcare_services', 'research')} AS purpose, o_orderkey % 7 <> 0 AS granted, o_orderdate AS valid_from, CASE WHEN
o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '700' DAY END AS valid_until,
        CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS revoked_at, {pick('o_orderkey % 3', 'ai_processing', 'sharing')} AS consent_type, CASE
WHEN o_orderkey % 7 <> 0 THEN 'granted' ELSE 'denied' END AS status FROM {{orders}}""",
    "jobs": f"""SELECT event_id AS job_id, {pick('event_id % 4', 'shell_file_processing', 'ai_processing', 'audit_cleanup', 'no_such_type')} AS job_type,
        CASE event_id % 5 WHEN 0 THEN concat(chr(123), chr(125)) WHEN 1 THEN concat(chr(123), '"job_lane": "fast_queue"', chr(125)) WHEN 2 THEN
concat(chr(123), '"estimated_tokens": "250"', chr(125)) WHEN 3 THEN NULL ELSE concat(chr(123), '"x": "1"', chr(125)) END AS payload,
        {pick('event_id % 3', 'pending', 'processing', 'completed')} AS status, ts AS heartbeat_at, ts AS scheduled_at, ts AS created_at,
CAST(event_id % 5 AS INT) AS retry_count, 3 AS max_retries, CAST(user_id % 10 AS INT) AS priority FROM {{events}}""",
    "timeline": f"""SELECT event_id, user_id AS patient_id, {pick('event_id % 4', 'diagnosis', 'treatment', 'test_result', 'visit')} AS category, event_type AS subcategory, ts AS event_date, event_id % 6 AS condition_id, event_id % 9 AS visit_id,
        concat(event_type, ' no ', CAST(event_id AS STRING)) AS title, props AS searchable, CAST(event_id % 100 AS INT) AS priority, value > 50 AS
is_major, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS archived,
        {pick('event_id % 5', 'monitoring', 'abnormal', 'screening', 'diagnostic')} AS tag FROM {{events}}""",
    "reports": f"""SELECT event_id AS report_id, user_id AS patient_id, {pick('event_id % 3', 'xray', 'mri', 'ct')} AS imaging_type, {pick('event_id % 2', 'chest', 'knee')} AS body_region, ts AS study_date, value > 60 AS requires_attention,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS indication, event_type AS impression, {pick('event_id % 5', 'abnormal',
'screening', 'diagnostic')} AS tag FROM {{events}}""",
    "fragments": f"""SELECT conv_id AS session_id, concat('p', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS pending_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('c', CAST(conv_id AS STRING)) END AS cascade_id, turn AS chunk_number,
        CAST(turn * 5 + 1 AS INT) AS start_page, CAST(turn * 5 + 5 + CASE WHEN conv_id % 7 = 1 THEN 3 ELSE 0 END AS INT) AS end_page, concat('s',
CAST(turn AS STRING)) AS start_marker, concat('e', CAST(turn AS STRING)) AS end_marker, CAST(turn * 10 AS INT) AS start_y, CAST(turn * 20 AS INT) AS
end_y,
        CASE turn % 3 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE 0.9 END AS position_confidence, conv_id % 2 = 0 AS is_real_world_visit, CASE WHEN conv_id
% 11 = 0 AND turn = 1 THEN 'other' ELSE 'visit' END AS encounter_type,
        CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '12/03/1996' ELSE '1995-11-02' END AS encounter_start_date, CASE turn % 2 WHEN 0 THEN NULL ELSE
'25/12/1996' END AS encounter_end_date, {pick('turn % 3', 'upload_date', 'file_metadata', 'ai_extracted')} AS date_source,
        CASE turn % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ann Lee' ELSE ' ' END AS patient_full_name, CASE turn % 3 WHEN 0 THEN '15/03/8985' WHEN 1 THEN
'15/03/1985' ELSE NULL END AS patient_date_of_birth,
        CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 'Dr Who' END AS provider_name, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'Clinic' END AS facility_name
FROM {{conversations}}""",
    "words": """SELECT CAST(p_size AS INT) AS page, CAST(p_partkey AS INT) AS seq, p_brand AS text, CAST(p_partkey % 97 * 11 AS INT) AS x, CAST(p_partkey % 40 * 7 AS INT) AS y, 10 AS height, 0.5 + p_partkey % 5 / 10.0 AS confidence FROM {part}""",
}

def stand_in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = sorted(set(re.findall(r"\{(\w+)\}", SQL[name])))
    return spark.sql(SQL[name], **{n: table(spark, sf_dir, n) for n in names})


def over(names: str, sql: str) -> str:
    """An oracle over stand-ins: ``sql`` behind a WITH of those named."""
    body = {n: re.sub(r"\{(\w+)\}", r"\1", SQL[n]) for n in names.split()}
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("RECURSIVE") else ""
    rest = sql.lstrip()[len("RECURSIVE") :] if recursive else sql
    head = f"WITH {recursive}" + ", ".join(f"{n} AS ({b})" for n, b in body.items())
    return head + (", " + rest.lstrip()[5:] if rest.lstrip().upper().startswith("WITH ") else " " + rest)
