from rankforge.operators import verifier
from rankforge.plans.verifier import RULES

EXAMPLE = "id string, task string, label string, source_key string, canonical string, genes array<string>, candidates array<string>, metadata map<string,string>, answer string, current boolean"
CLAIM = "id string, kind string, n int, value string, verified boolean, source string, matched string, direction string, details string, key string"
PROFILE = "label string, marker string, positive boolean, rank int"
GOOD = "LABEL: Zeta\nEVIDENCE: G1\nEXCLUSIONS: none\nNEGATIVE_MARKERS: N1, N2\nCONTEXT: status=ok\nCONFIDENCE: High\nFINAL: Zeta"


def judged(spark, examples, claims, profiles):
    got = verifier.verify_examples(spark.createDataFrame(examples, EXAMPLE), spark.createDataFrame(claims, CLAIM), spark.createDataFrame(profiles, PROFILE), RULES)
    return {r["id"]: (r["passed"], sorted((i["field"], i["code"], i["value"]) for i in r["issues"])) for r in got.collect()}


def test_a_good_example_passes_and_each_fault_is_named(spark):
    profiles = [("Zeta", "G1", True, 1), ("Zeta", "N2", False, 2), ("Zeta", "N1", False, 1), ("U", "M1", True, 1)]
    claims = [(i, "evidence", 1, "G1", True, "marker_catalog", "Zeta", "supports_gold", None, None) for i in ("good", "text", "shape")]
    claims += [(i, "context", 1, "status=ok", True, "source_metadata", None, None, None, "status") for i in ("good", "text", "shape")]
    claims += [("odd", "evidence", 1, "G9", None, None, "V", None, None, None), ("odd", "exclusion", 1, "U", True, "marker_catalog", None, "against_candidate", "reason=missing_candidate_markers;candidate_markers=M1,M2", None)]
    base = (["G1"], ["Zeta"], {"status": "ok"})
    examples = [("good", "annotation", "Zeta", None, None, *base, GOOD, True), ("text", "state", "Zeta", "status", "U", *base, GOOD.replace("High", "sure"), True), ("shape", "annotation", "Zeta", None, None, *base, GOOD.replace("FINAL", "LABEL"), True), ("odd", "differential", "Zeta", None, None, ["M1"], ["Zeta", "U", "W"], None, GOOD, None), ("none", None, None, None, None, None, None, None, None, None)]
    got = judged(spark, examples, claims, profiles)
    assert got["good"] == (True, [])
    assert got["text"] == (False, [("answer_text", "confidence", "sure"), ("answer_text", "differs", "NEGATIVE_MARKERS"), ("context", "forbidden_key", "status")])
    assert got["shape"] == (False, [("answer_text", "duplicate_key", "LABEL"), ("answer_text", "missing_key", "FINAL")])  # no alignment
    odd = got["odd"][1]
    assert {("evidence", "unverified", "G9"), ("evidence", "source", ""), ("evidence", "unobserved", "G9"), ("exclusions", "not_approved", "M2"), ("exclusions", "marker_observed", "M1"), ("exclusions", "coverage", "")} <= set(odd)
    assert ("genes", "empty", "") in got["none"][1] and ("task_type", "unknown_task", "") in got["none"][1] and ("evidence", "missing", "") in got["none"][1]
    assert judged(spark, [], [], []) == {}


def test_claims_move_to_their_ids_and_keys_alone_to_the_catalog(spark, monkeypatch):
    claims = [("a", "evidence", i, f"G{i % 3}", True, "marker_catalog", "Zeta" if i < 5 else None, None, None, None) for i in range(6)]
    claims += [("b", "exclusion", i, "U", True, "marker_catalog", None, None, details, None) for i, details in enumerate((None, "candidate_markers=M1,,M2,M1", "x"))]
    profiles = [("Zeta", "G1", True, 1), ("Zeta", "G1", True, 2), ("Zeta", "G2", False, 2), ("U", "M1", True, 1)]
    want = {"a": [("Zeta", True, i % 3 == 1, []) for i in range(5)] + [(None, False, False, [])], "b": [("U", True, False, m) for m in ([], [("M1", True), ("M2", False), ("M1", True)], [])]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (20_000, 0):
            monkeypatch.setattr(verifier, "FEW_LABELS", few, raising=False)
            found = verifier.looked_up(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(profiles, PROFILE))
            if few:
                assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 5
            got = {r["id"]: [(c["profile"], c["has_profile"], c["approved"], [(m["marker"], m["approved"]) for m in c["marks"]]) for c in r["claims"]] for r in found.collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lists_of_negative_markers_stay_with_their_labels(spark):
    found = verifier.verify_examples(spark.createDataFrame([], EXAMPLE), spark.createDataFrame([], CLAIM), spark.createDataFrame([], PROFILE), RULES)
    joins = [x for x in found._jdf.queryExecution().analyzed().toString().split("\n") if "Join" in x]
    assert "lookup" in joins[0] and "id#" in joins[1]  # last of all, and as a digest
    assert "sha2" in found._jdf.queryExecution().analyzed().toString()


def test_report_makes_the_results_once(spark):
    results = spark.createDataFrame([("a", True, []), ("a", False, [("f", "c", "v"), ("f", "c", "w")]), ("b", False, [("f", "d", None)])], f"task string, passed boolean, issues {verifier.ISSUES}")
    found = verifier.report(results)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    assert sorted(map(tuple, found.collect())) == [("a", "", "passed", 1), ("a", "", "rows", 2), ("a", "f", "c", 2), ("b", "", "passed", 0), ("b", "", "rows", 1), ("b", "f", "d", 1)]


def test_sample_rules_on_nulls_and_repeats(spark):
    schema = "n long, id string, family string, candidates array<string>, oracles array<string>, genes array<string>, support array<string>, abstain boolean, profiles map<string,array<string>>, profile_support map<string,array<string>>, combined array<string>"
    rows = [(1, "a", "single", ["e"], ["e"], ["g"], ["g"], None, None, None, None), (2, "a", "bundle", None, None, None, None, None, {"A": ["x"]}, {"A": ["x", "y"], "B": ["z"]}, ["x", "w"]), (3, None, "ood", ["e", "?"], ["?"], None, ["q"], None, None, None, None), (4, "d", "cross", ["e"], None, None, None, None, None, None, None)]
    found = verifier.sample_issues(spark.createDataFrame(rows, schema), spark.createDataFrame([("e",)], "expert string"), {"cross": "cross", "ood": "ood", "bundle": "bundle"})
    got = {r["n"]: sorted((i["code"], i["value"]) for i in r["issues"]) for r in found.collect()}
    assert got == {
        1: [], 2: [("combined_not_given", "w"), ("duplicate_id", "a"), ("few_profiles", ""), ("profile_support_not_given", "A:y"), ("profile_support_not_given", "B:z")],
        3: [("no_abstention", ""), ("oracle_of_none", ""), ("support_not_given", "q"), ("unknown_expert", "?")], 4: [("few_candidates", "")],
    }
    assert verifier.report(verifier.verify_examples(spark.createDataFrame([], EXAMPLE), spark.createDataFrame([], CLAIM), spark.createDataFrame([], PROFILE), RULES)).count() == 0
