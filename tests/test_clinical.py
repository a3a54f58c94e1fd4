from larkspur.sources import clinical

DOC = """<?xml version="1.0"?>
<ClinicalDocument xmlns="urn:hl7-org:v3" xmlns:x="urn:x"><component><structuredBody>
 <component><section><code code="48765-2"/><title>Allergies &amp; more</title><text><table><thead><tr><th>What</th><th>Since</th></tr></thead>
  <tbody><tr><td>Nuts</td><td><content ID="a">2001</content></td></tr><tr><td>Cats</td></tr></tbody></table>
  <table><tbody><tr><td>1</td><td>2</td></tr></tbody></table></text></section></component>
 <component><section><title>History</title><text>plain words</text>
  <component><section><title>Inner</title><text><list><item>one</item><item>two <b>bold</b></item></list><paragraph>p1</paragraph></text>
   <component><section><title>Deepest</title><text><paragraph>x</paragraph><paragraph> </paragraph><paragraph>y</paragraph></text></section></component></section></component>
 </section></component>
 <component><section><title>Empty</title></section></component>
</structuredBody></component></ClinicalDocument>"""


def test_sections_tables_and_passages(spark):
    df = spark.createDataFrame([(1, DOC), (2, None), (3, "no xml"), (4, "<ClinicalDocument/>"), (5, DOC.replace("Nuts", "Bees"))], "k int, x string")
    found = clinical.sections(df, "k", "x")
    rows = {(r.k, tuple(r.path)): (r.depth, r.title, r.code) for r in found.collect()}
    assert {p: v for (k, p), v in rows.items() if k == 1} == {
        (1,): (1, "Allergies & more", "48765-2"), (2,): (1, "History", None), (2, 1): (2, "Inner", None), (2, 1, 1): (3, "Deepest", None), (3,): (1, "Empty", None),
    }
    assert {k for k, _ in rows} == {1, 5}
    cells = [tuple(r)[1:] for r in clinical.tables(found, "k").where("k = 1").orderBy("path", "table", "row", "cell").collect()]
    assert [(list(p), *rest) for p, *rest in cells] == [
        ([1], 1, 1, 1, "What", "Nuts"), ([1], 1, 1, 2, "Since", "2001"), ([1], 1, 2, 1, "What", "Cats"), ([1], 2, 1, 1, None, "1"), ([1], 2, 1, 2, None, "2"),
    ]
    said = {(tuple(r.path), r.kind, r.n): r.text for r in clinical.passages(found, "k").where("k = 5").collect()}
    assert said == {((2,), "text", 1): "plain words", ((2, 1), "item", 1): "one", ((2, 1), "item", 2): "two bold", ((2, 1), "paragraph", 1): "p1",
        ((2, 1, 1), "paragraph", 1): "x", ((2, 1, 1), "paragraph", 3): "y"}


def test_tables_without_documents(spark):
    none = spark.createDataFrame([], "k int, x string")
    found = clinical.sections(none, "k", "x")
    assert found.count() == clinical.tables(found, "k").count() == clinical.passages(found, "k").count() == 0


def test_documents_are_parsed_once_for_all_levels(spark):
    found = clinical.sections(spark.createDataFrame([(1, DOC)], "k int, x string"), "k", "x")
    assert found.count() == 5 and "from_xml" not in found._jdf.queryExecution().optimizedPlan().toString()
