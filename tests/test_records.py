import json

import pytest
from larkspur import functions as X
from larkspur.functions import dates as D
from larkspur.functions import json as J
from larkspur.functions import text as T
from larkspur.operators import access, flags, graph, layout, model_output, queues, reconcile, records, retrieval, timeline
from larkspur.sources import lists
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def one(spark, column, **values):
    """The value of a column over one row of the given values."""
    names = list(values)
    kind = lambda v: "string" if v is None or isinstance(v, str) else "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "double"
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kind(values[n])}" for n in names)) if names else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(("name", "search", "want"), [
    ("Amlodipine (as Besilate) 5 mg Tablet", "", "amlodipine 5 mg tablet"), ("Metformin Hydrochloride 0.5 g", "", "metformin 500 mg"), ("Digoxin 250 mcg", "Digoxin 250 mcg Lanoxin", "digoxin 0.25 mg lanoxin"),
    ("X tablet (extended release)", "", "x tablet extended release"), ("1.5 G and 2 g", "", "1500 mg and 2000 mg"), (" ", "", ""), ("A", "a " + "b" * 60, "a"), ("Big gum", "", "big gum"), (None, "", None)])
def test_medication_text(spark, name, search, want):
    assert one(spark, T.medication_text(F.col("n"), F.col("s")), n=name, s=search) == want


@pytest.mark.parametrize(("told", "value", "want"), [("hospital id", "1", "MRN"), ("xMC", "", "MEDICARE"), ("card", "1234 567-890", "MEDICARE"), ("my  file", "x", "MY_FILE"), (" dva ", "1", "DVA"), ("", "", "")])
def test_identifier_types(spark, told, value, want):
    assert one(spark, T.identifier_type(F.col("t"), F.col("v")), t=told, v=value) == want


def test_answers_of_models(spark):
    texts = ['```json\n{"a": 1}\n```', 'so: {"a": {"b": 2}} ok', "", None, "no json", "[1, 2]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", model_output.answer_json(F.col("t")).alias("a")).orderBy("i").collect()
    assert [(r.a.json, r.a.error) for r in rows] == [('{"a": 1}', None), ('{"a": {"b": 2}}', None), (None, "EMPTY_RESPONSE"), (None, "EMPTY_RESPONSE"), (None, "PARSE_JSON"), ("[1, 2]", None)]


def test_zones_and_entities(spark):
    text = json.dumps({"zones": [{"schema_type": " Meds ", "y_start": "30", "y_end": 10}, {"schema_type": "x", "y_start": 5, "y_end": 5, "page_number": 2}, {"schema_type": "x", "y_end": 5}],
                       "entities": [{"original_text": " Aspirin ", "entity_type": "Rx", "y_coordinate": "12px"}, {"entity_type": "rx"}, {"original_text": "a", "entity_type": "zzz"}]})
    df = spark.createDataFrame([(1, text), (2, None), (3, "{}")], "k int, j string")
    good, bad = model_output.zones(df, "k", "j")
    assert sorted(map(tuple, good.collect())) == [(1, 0, "meds", 1, 10, 30, None), (1, 1, "x", 2, 5, 6, None)] and [tuple(r) for r in bad.collect()] == [(1, 2, "missing y_start")]
    good, bad = model_output.entities(df, "k", "j")
    assert [tuple(r) for r in good.collect()] == [(1, 0, "e1", "Aspirin", "medication", 1, 12, [])]
    assert sorted(map(tuple, bad.collect())) == [(1, 1, "missing original_text"), (1, 2, "invalid entity_type: zzz")]


def test_aggregates_over_fragments(spark):
    rows = spark.createDataFrame([(1, "Ann", "15/03/8985", "", "upload_date"), (2, "Bob Lee", "15/03/1985", "2020-01-02", "upload_date"), (3, " ", "15/03/1850", "2020-01-01", "file_metadata"), (4, "Cat Lee", None, "2020-01-03", "file_metadata")], "pos int, n string, b string, d string, s string")
    r = rows.agg(reconcile.longest_value("n", "pos").alias("n"), reconcile.best_birth_date("b", "pos", 2027).alias("b"), reconcile.best_date("d", "s", "pos").alias("d")).first()
    assert (r.n, r.b, tuple(r.d)) == ("Bob Lee", "15/03/8985", ("2020-01-01", "file_metadata"))
    r = rows.where("pos > 9").agg(reconcile.longest_value("n", "pos").alias("n"), reconcile.best_birth_date("b", "pos", 2027).alias("b"), reconcile.best_date("d", "s", "pos").alias("d")).first()
    assert tuple(r) == (None, None, None)


def fragments(spark, *rows):
    names = "session_id int, pending_id string, cascade_id string, chunk_number int, start_page int, end_page int, position_confidence double, is_real_world_visit boolean, encounter_start_date string, patient_full_name string, patient_date_of_birth string"
    df = spark.createDataFrame([tuple(r) for r in rows], names)
    text = {c: F.lit(None).cast("string") for c in ("start_marker", "end_marker", "provider_name", "facility_name", "encounter_end_date", "date_source")}
    return df.withColumns(text | {"start_y": F.lit(1), "end_y": F.lit(2), "encounter_type": F.lit("visit"), "page_ranges": F.array(F.array("start_page", "end_page"))})


def test_reconciling_fragments(spark):
    df = fragments(
        spark, (1, "p1", "c", 1, 1, 50, 0.9, False, "12/03/2020", "Ann Lee", "01/02/49"), (1, "p2", "c", 2, 51, 60, 0.0, True, "", "Ann", None),
        (1, "p3", None, 1, 7, 7, None, False, None, None, None), (1, "p4", "d", 1, 1, 50, 0.9, False, "", "", ""), (1, "p5", "d", 3, 40, 120, 0.9, False, "", "", ""),
    )
    visits, abandoned = reconcile.reconciled(df, F.lit(None).cast("string"), F.lit("2024-01-01"), 2027)
    got = {r.group_id: r for r in visits.collect()}
    assert set(got) == {"c", "p3"} and [(r.group_id, r.errors) for r in abandoned.collect()] == [("d", ["Chunk gap: 1 -> 3", "Page overlap: Chunk 1 ends at 50, Chunk 3 starts at 40"])]
    c, p = got["c"], got["p3"]
    assert (c.fragments, c.last_chunk, c.start_page, c.end_page, c.is_real_world_visit, c.page_ranges) == (2, 2, 1, 60, True, [[1, 60]])
    assert abs(c.position_confidence - (50 * 0.9 + 10 * 0.5) / 60) < 1e-9 and (c.start_date, c.end_date, c.date_source) == ("2020-03-12", None, "ai_extracted")
    assert c.birth_date is None and c.needs_review and c.quality_tier == "medium" and (p.start_date, p.end_date, p.date_source, p.quality_tier) == ("2024-01-01", "2024-01-01", "upload_date", "low")
    empty, none = reconcile.reconciled(df.limit(0), F.lit(None).cast("string"), F.lit("2024-01-01"), 2027)
    assert empty.count() == none.count() == 0


def test_page_layout(spark):
    words = spark.createDataFrame([(1, 0, "BP", 10, 101), (1, 1, "120/80", 60, 104), (1, 2, "mmHg", 75, 98), (1, 3, "low", 0, 300)], "page int, seq int, text string, x int, y int")
    assert layout.page_text(words, ["page"]).first().text == "[Y:100] BP (x:10) | 120/80 (x:60) mmHg (x:75)\n[Y:300] low (x:0)"
    assert layout.page_text(words, ["page"], with_x=False).first().text == "[Y:100] BP 120/80 mmHg\n[Y:300] low"
    assert layout.page_text(words.limit(0), ["page"]).count() == 0


def test_slices_of_marked_text(spark):
    text = "--- PAGE 1 START ---\n[Y:340] a\n[Y:350] b\n[Y:600] c\n--- PAGE 1 END ---"
    df = spark.createDataFrame([(1, text, 1, 1, "intra_page", 500), (2, None, 1, 1, "page_start", None), (3, text, 4, 9, "page_start", None)], "k int, t string, a int, b int, ak string, ay int")
    got = {r.k: r.text for r in layout.sliced_text(df, "k", "t", "a", "b", start_kind="ak", start_y="ay").collect()}
    assert got[1] == "--- PAGE 1 START ---\n[Y:350] b\n[Y:600] c\n--- PAGE 1 END ---" and got[3] == "" and 2 not in got


def test_markers(spark):
    said = [("Chief", 10), ("Complaint", 10), ("pain", 40), ("Chief", 900), ("Complaint", 900), ("cough", 930), ("Dischrge", 1500), ("Sumary", 1500)]
    words = spark.createDataFrame([(1, i, w, y, 20, 0.9) for i, (w, y) in enumerate(said)], "page int, seq int, text string, y int, height int, confidence double")
    asked = [("m1", '"chief complaint"', "cough", None), ("m2", "Chief Complaint", None, None), ("m3", "Discharge Summary", None, None), ("m4", "Chief Complaint", None, "upper_middle"), ("m5", "ab", None, None), ("m6", "nowhere at all", None, None)]
    markers = spark.createDataFrame([(i, 1, m, c, r, 3200) for i, m, c, r in asked], "marker_id string, page int, marker string, context string, region string, page_height int")
    got = {r.marker_id: (r.y, r.exact, round(r.confidence, 3)) for r in layout.marker_matches(words, markers).collect()}
    assert got == {"m1": (900.0, True, 0.9), "m2": (10.0, True, 0.9), "m3": (1500.0, False, 0.72), "m4": (900.0, True, 0.9)}


def test_zones_of_entities(spark):
    zones = spark.createDataFrame([(1, 1, 0, 100, "medications"), (2, 1, 50, 150, "lab_results")], "zone_id int, page int, y_start int, y_end int, schema_type string")
    found = spark.createDataFrame([(1, 1, 75, "lab_result"), (2, 1, 75, "allergy"), (3, 1, 200, "allergy"), (4, 1, None, "allergy")], "entity_id int, page int, y int, entity_type string")
    assert {tuple(r) for r in layout.zone_of(found, zones).collect()} == {(1, 2), (2, 1), (3, None), (4, None)}


def test_raised_and_surviving_flags(spark):
    rows = spark.createDataFrame([(1, 1, "Bob Smith", "Ann Leeland", None, None, "12"), (2, 1, None, "Ann", None, None, ""), (3, 1, "zzzzzzzzzz", "Ann", None, None, None)], "document_id int, profile_id int, name string, display_name string, date_of_birth date, profile_birth date, phone string")
    found = flags.raised(rows, "patient", flags.identity_rules(F.lit("2024-01-01").cast("date")))
    assert sorted((r.document_id, r.problem_code) for r in found.collect()) == [(1, "contact_format_check"), (1, "name_similarity_check"), (3, "name_similarity_check")]
    assert sorted((r.document_id, r.problem_code) for r in flags.surviving(found).collect() if r.confidence >= 0.8 or r.severity == "info") == sorted((r.document_id, r.problem_code) for r in flags.surviving(found).collect())
    assert (3, "name_similarity_check") in {(r.document_id, r.problem_code) for r in flags.surviving(found).collect()}


def test_cycles_and_guards(spark):
    edges = spark.createDataFrame([(5, 1), (5, 2), (2, 3), (3, 2), (7, 7)], "a int, b int")
    got = {(r.start, r.node) for r in graph.reachable(edges, spark.createDataFrame([(5,), (7,), (9,)], "start int")).collect()}
    assert got == {(5, 5), (5, 1), (5, 2), (5, 3), (7, 7), (9, 9)}
    proposed = spark.createDataFrame([(3, 5), (1, 9), (2, 5), (4, 4)], "a int, b int")
    assert {tuple(r) for r in graph.refused_edges(edges, proposed).collect()} == {(3, 5), (2, 5), (4, 4)}


def test_cosine_wants_equal_dimensions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.v and round(r.v, 6) for r in df.select(X.cosine("a", "b").alias("v")).collect()] == [0.96, None]
    with pytest.raises(PySparkException, match="dimensions"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(X.cosine("a", "b")).collect()


def test_searches_keep_their_rules(spark):
    codes = spark.createDataFrame([("loinc", "1", "lab", True, [1.0, 0.0]), ("loinc", "2", "med", True, [1.0, 0.1]), ("loinc", "3", "lab", False, [1.0, 0.0]), ("loinc", "4", "lab", True, None), ("loinc", "5", "lab", True, [0.0, 1.0])], "code_system string, code_value string, kind string, active boolean, embedding array<double>")
    asked = spark.createDataFrame([(1, "lab", [2.0, 0.0]), (2, None, [2.0, 0.0]), (3, "lab", None)], "query int, kind string, embedding array<double>")
    got = {(r.query, r.code_value) for r in retrieval.vector_search(codes, asked, ["code_system", "code_value"], 5, 0.7, kind="kind").collect()}
    assert got == {(1, "1"), (2, "1"), (2, "2")}
    assert retrieval.vector_search(codes, asked.limit(0), ["code_value"], 5, 0.7).count() == 0


def test_retry_waits(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    wait = lambda n, after: one(spark, queues.retry_wait(F.col("n"), F.col("a"), at), n=n, a=after)
    assert (wait(1, None), wait(3, None), wait(1, "7"), wait(4, None), wait(1, "Mon, 01 Jan 2024 00:00:09 GMT")) == (1000.0, 4000.0, 7000.0, 300000.0, 9000.0)


def test_grants_and_levels(spark):
    assert one(spark, access.implies(F.col("l"), "read_only"), l="emergency") is False and one(spark, access.implies(F.col("l"), "nonsense"), l="owner") is False
    grants = spark.createDataFrame([(1, 1, 1, "active", None), (2, 2, 1, "active", None)], "grant_id int, provider_id int, patient_id int, status string, revoked_at timestamp_ntz")
    fresh = spark.createDataFrame([(9, 1, 1), (8, 3, 1), (7, 4, 1)], "grant_id int, provider_id int, patient_id int")
    providers = spark.createDataFrame([(1, True), (3, False)], "provider_id int, verified boolean")
    after, refused = records.granted_access(grants, fresh, providers, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {(r.grant_id, r.status) for r in after.collect()} == {(1, "revoked"), (2, "active"), (9, "active")}
    assert {(r.provider_id, r.reason) for r in refused.collect()} == {(3, "provider_not_verified"), (4, "provider_not_found")}


def test_consents_given_again(spark):
    old = spark.createDataFrame([(1, "a", False, None, None, '{"x": "1", "y": "2"}'), (2, "a", True, None, None, None)], "patient_id int, consent_type string, granted boolean, valid_from timestamp_ntz, revoked_at timestamp_ntz, evidence string")
    fresh = spark.createDataFrame([(1, "a", '{"y": "3"}'), (3, "b", '{"z": "1"}')], "patient_id int, consent_type string, evidence string")
    got = {r.patient_id: (r.granted, json.loads(r.evidence) if r.evidence else None) for r in access.given_consent(old, fresh, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {1: (True, {"x": "1", "y": "3"}), 2: (True, None), 3: (True, {"z": "1"})}


def test_answered_items(spark):
    items = spark.createDataFrame([(1, 1, "pending"), (2, 1, "pending"), (3, 2, "pending")], "item_id int, patient_id int, status string")
    said = spark.createDataFrame([(1, 5, "completed", "ok"), (2, 5, "assigned", None), (3, 5, "completed", "no")], "item_id int, provider_id int, status string, response string")
    got = {r.item_id: (r.status, r.resolved_at is not None) for r in records.answered_items(items, said, spark.createDataFrame([(5, 1)], "provider_id int, patient_id int"), F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {1: ("completed", True), 2: ("assigned", False), 3: ("pending", False)}


def test_timeline_events_of_clinical_events(spark):
    rows = [(1, 1, "observation", ["screening"], "Pap", "laboratory", "Dr A", None, "2024-01-01"), (2, 1, "intervention", ["therapeutic"], "Cast", "surgery", None, "arm", "2024-01-01"), (3, 1, "other", [], None, None, None, None, "2024-01-01")]
    df = spark.createDataFrame(rows, "event_id int, patient_id int, activity_type string, purposes array<string>, event_name string, method string, performed_by string, body_site string, event_date string")
    got = {r.event_id: (r.category, r.subcategory, r.title, r.summary, r.is_major, r.priority, r.tags) for r in timeline.event_of_clinical(df).collect()}
    assert got[1] == ("screening", "laboratory", "Pap Result", "Pap performed by Dr A", False, 80, ["preventive"])
    assert got[2] == ("treatment", "surgery", "Cast", "Cast", True, 40, ["treatment"]) and got[3] == (None, None, None, "Clinical event on 2024-01-01", False, 100, [])


def test_small_functions(spark):
    assert one(spark, J.config_number(F.col("v"), 5), v='"30"') == 30 and one(spark, J.config_number(F.col("v"), 5), v=None) == 5
    assert json.loads(one(spark, J.merged(F.col("a"), F.col("b")), a='{"x":"1","y":"2"}', b='{"y":"3"}')) == {"x": "1", "y": "3"}
    assert one(spark, J.source_system(F.col("v"), "fhir"), v="epicXfhir") is True and one(spark, J.number_pairs(F.col("v")), v="[[1,2],[3,4]]") == [[1, 2], [3, 4]]
    assert str(one(spark, D.corrected_year(F.col("d").cast("date"), F.lit("2024-01-01").cast("date")), d="2035-02-03")) == "2024-02-03"
    assert one(spark, T.blood_pressure(F.col("v")), v="BP 120/80").diastolic == 80 and one(spark, T.first_number(F.col("v")), v="temp 37.5 C") == 37.5
    assert one(spark, T.pending_id(F.col("s"), F.col("c"), F.col("n")), s="s1", c=2, n=3) == "pending_s1_002_003"
    assert one(spark, lists.class_type(F.col("v")), v="chem.x") == "lab_result" and one(spark, records.expected_next(F.col("v")), v=None) == "continuation"
    assert one(spark, T.rollout(F.col("v"), 100), v="u") is True and one(spark, T.rollout(F.col("v"), 0), v="u") is False
    share = spark.range(20000).select(T.rollout(F.col("id").cast("string"), 30).alias("v")).where("v").count() / 20000
    assert abs(share - 0.3) < 0.02


def test_parts_of_texts_and_earlier_checks(spark):
    df = spark.createDataFrame([("a,,b",), ("",), (None,), ("x.y",)], "t string")
    assert [r.p for r in df.select(T.words_of(F.col("t"), ",").alias("p")).collect()] == [["a", "", "b"], [], None, ["x.y"]]
    assert [r.p for r in df.select(T.words_joined(T.words_of(F.col("t"), "."), "-").alias("p")).collect()] == ["a,,b", "", None, "x-y"]
    rows = spark.createDataFrame([(1, 1, "1997-08-01", "Ann Lee", "ann b lee", 0.39), (2, 1, None, None, "x", 0.4), (3, 1, "1997-07-15", "", "x", None), (4, 1, "1997-06-20", "bob", "ann lee", 1.0)], "document_id int, profile_id int, document_date string, name string, display_name string, completeness double")
    rows = rows.withColumn("document_date", F.col("document_date").cast("date"))
    found = flags.raised(rows, "documents", flags.legacy_rules(F.lit("1997-06-15").cast("timestamp_ntz")))
    assert sorted((r.document_id, r.problem_code, round(r.confidence, 3)) for r in found.collect()) == [(1, "future_date_check", 0.85), (1, "incomplete_extraction", 0.8), (4, "name_similarity_check", 1.0)]
