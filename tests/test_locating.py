from leadloom.operators import locating

LEXICON = [("boston", "Boston", "USA"), ("massachusetts", "Boston", "USA"), ("new york", "New York", "USA"), ("york", "York", "UK"), ("edison nj", "Edison", "USA"), ("karachi", "Karachi", "Pakistan"), ("usa", "USA", None), ("united states", "USA", None), ("pakistan", "Pakistan", None), ("uk", "UK", None)]

#: text, address, requested, and verdict, reason, confidence, business location.
GOLDEN = [
    ("We are based in Boston. Ships to Karachi.", None, "Boston", "MATCH", "", "high", "Boston, USA"),
    ("Family firm of Karachi, Pakistan. We ship our goods to Boston and New York.", None, "Boston", "WRONG", "foreign_business_serving_target_area", "high", "Karachi, Pakistan"),
    ("Our warehouse in Karachi is open.", None, "Boston", "WRONG", "location_mismatch_country", "high", "Karachi, Pakistan"),
    ("Headquartered in New York.", None, "Boston", "WRONG", "location_mismatch_state", "high", "New York, USA"),
    ("We are not based in Boston. Find us in New York.", None, "Boston", "WRONG", "location_mismatch_state", "high", "New York, USA"),
    ("Serving customers in Boston.", None, "Boston", "UNCERTAIN", "uncertain_location", "low", ""),
    ("Made in the United States.", None, "Boston", "UNCERTAIN", "country_only", "low", "USA"),
    ("Made in Massachusetts.", None, "Boston", "MATCH", "", "medium", "Boston, USA"),
    ("Made in Massachusetts.", None, "USA", "MATCH", "", "medium", "Boston, USA"),
    ("Made here.", "12 Main St, Edison NJ", "Boston", "WRONG", "location_mismatch_state", "high", "Edison, USA"),
    ("Made here.", "Boston", "Boston", "UNCERTAIN", "uncertain_location", "low", ""),
    ("Made here.", "12 Boston Road", "Boston", "MATCH", "", "high", "Boston, USA"),
    ("The Boston office of a Karachi firm.", "Karachi, Pakistan", "Boston", "MATCH", "", "high", "Karachi, Pakistan"),
    ("Visit us! New York is far.", None, "York", "WRONG", "location_mismatch_country", "high", "New York, USA"),
    (None, None, "Boston", "UNCERTAIN", "uncertain_location", "low", ""),
    ("", "", "Boston", "UNCERTAIN", "uncertain_location", "low", ""),
    ("Based in Boston.", None, None, "MATCH", "", "medium", "Boston, USA"),
    (None, None, None, "MATCH", "", "low", ""),
    ("Exports worldwide. Exports tools to the UK. " + "x " * 50_000 + ". Our office: Karachi", None, "UK", "WRONG", "foreign_business_serving_target_area", "high", "Karachi, Pakistan"),
]


def test_verdicts_by_hand(spark):
    lexicon = spark.createDataFrame(LEXICON, "phrase string, name string, parent string")
    rows = spark.createDataFrame([(i, *g[:3], "x") for i, g in enumerate(GOLDEN)], "id int, text string, address string, requested string, name string").repartition(4)
    got = {r.id: (r.verdict, r.reason, r.confidence, r.business_location) for r in locating.verdicts(rows, "id", lexicon).collect()}
    for i, g in enumerate(GOLDEN):
        assert got[i] == g[3:], (g, got[i])
    assert len(got) == len(GOLDEN)
    assert locating.verdicts(rows.limit(0), "id", lexicon).count() == 0


def test_claims(spark):
    lexicon = spark.createDataFrame(LEXICON, "phrase string, name string, parent string")
    text = "Ships tools, belts and straps to Boston. Never located in York; our new york hq is small. No UK office.\nKarachi"
    found = locating.evidence(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", lexicon).collect()
    assert sorted((r.sentence, r.name, r.claim) for r in found) == [(0, "Boston", "served"), (1, "New York", "office"), (1, "York", "denied"), (2, "UK", "office"), (3, "Karachi", "stated")]
