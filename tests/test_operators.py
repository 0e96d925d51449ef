import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from archivum.functions import normalize as N
from archivum.operators import claims, evidence, graph, latest, policy, reconcile, risk, rules, search


def one(spark, expr, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()] or ["id"]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "expr, want",
    [
        (lambda: N.extension(F.lit(" ..T X T ")), "txt"), (lambda: N.slug(F.lit("  PDF/A-1 (b)  ")), "pdf-a-1-b"), (lambda: N.slug(F.lit(None).cast("string")), "unnamed"),
        (lambda: N.split_multi(F.lit(" a;b, ,c|d\n e ")), ["a", "b", "c", "d", "e"]), (lambda: N.version_tokens(F.lit("PDF/A-1b 10.2.1, 97-2003")), ["10.2.1", "97-2003", "pdf/a-1b"]),
        (lambda: N.puid_variants(F.lit("fmt/19")), ["fmt/19", "puid-fmt-19"]), (lambda: N.semantic_level(F.lit("Moderate_concern")), "moderate"), (lambda: N.three_band(F.lit("very HIGH")), "High"),
        (lambda: N.first_of(F.lit(" "), F.lit("b")), "b"), (lambda: N.try_float(F.lit(" 1.5 ")), 1.5), (lambda: N.alias_of("puid", F.lit("fmt/1")), "puid-fmt-1"), (lambda: N.native_band(F.lit(-23)), "High"),
        (lambda: N.days_since(F.lit(None).cast("date"), F.current_date()), None), (lambda: N.canonical_id(F.lit("puid"), F.lit("fmt/1"), F.lit("n")), "puid-fmt-1"), (lambda: N.canonical_id(F.lit("name"), F.lit("x y"), F.lit(" ")), "fmt-x-y"),
        (lambda: N.has_word(F.lit("operating system"), "rating"), False), (lambda: N.has_word(F.lit("Numeric Risk_Rating"), "risk rating"), True), (lambda: N.text_rule(F.lit("abc"), not_contains_any=["x"]), False),
    ],
)
def test_scalars(spark, expr, want):
    assert one(spark, expr()) == want


def test_dates(spark):
    texts = ["2024-01-05", "5 Jan 2024", "5 January 2024", "2024/01/05", "Fri, 5 Jan 2024 10:00:00 +0000", "soon", None]
    got = [r[0] and str(r[0])[:10] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(N.parse_date(F.col("t"))).collect()]
    assert got == ["2024-01-05"] * 5 + [None, None]


REC = "src_ord int, source_id string, source_type string, source_record_id string, record_role string, name string, category string, extensions array<string>, mime_types array<string>, puids array<string>, loc_ids array<string>, nara_ids array<string>"


def groups(spark, rows):
    full = [(n, r.get("s", "a"), r.get("t", "standard_json"), f"r{n}", r.get("role"), r.get("name"), None, r.get("e", []), [], r.get("p", []), r.get("l", []), []) for n, r in enumerate(rows)]
    return {r["canonical_id"]: r["n_records"] for r in reconcile.reconcile(spark.createDataFrame(full, REC)).collect()}


AUTH = {"t": "pronom_registry", "s": "pronom"}


def test_reconcile_joins_verified_and_copied_ids(spark):
    assert groups(spark, [{**AUTH, "name": "Alpha", "p": ["fmt/1"]}, {"name": "alpha", "p": ["fmt/1"]}]) == {"puid-fmt-1": 2}


@pytest.mark.parametrize("name", ["Alpha 2.0", "Alpha 1.0 family", "Alpha"])
def test_reconcile_keeps_conflicting_one_sided_and_broad_names_apart(spark, name):
    assert len(groups(spark, [{**AUTH, "name": "Alpha 1.0", "p": ["fmt/1"]}, {"name": name, "p": ["fmt/1"]}])) == 2


def test_reconcile_two_owners_and_one_hop(spark):
    two = [{**AUTH, "name": "A", "p": ["fmt/1"]}, {**AUTH, "name": "B", "p": ["fmt/2"]}, {"name": "C", "p": ["fmt/1", "fmt/2"]}]
    assert groups(spark, two) == {"puid-fmt-1": 1, "puid-fmt-2": 1, "fmt-c": 1}
    weak = [{**AUTH, "name": "W", "e": [".w"], "p": ["fmt/9"]}, {"name": "w", "e": ["W"]}, {"s": "b", "name": "only mime"}, {"role": "evidence_only", "name": "ghost"}, {"s": "c"}]
    got = groups(spark, weak)
    assert got["puid-fmt-9"] == 2 and got["fmt-only-mime"] == 1 and len(got) == 3 and sum(got.values()) == 4


def test_reconcile_is_independent_of_partitioning_and_empty_safe(spark):
    assert groups(spark, []) == {}


def test_synthesis_prefers_exact_scope_and_drops_stale(spark):
    rows = [("f1", "a", "low", "exact_format"), ("f1", "b", "critical", "format_group"), ("f2", "a", None, None), ("f3", "a", "high", "odd"), ("f3", "b", "low", None)]
    df = spark.createDataFrame(rows, "canonical_id string, source_id string, semantic_level string, scope_type string")
    got = {r["canonical_id"]: r for r in risk.synthesize(df).collect()}
    assert (got["f1"]["level"], got["f1"]["deciding_sources"], got["f1"]["cross_scope_level_divergence"]) == ("low", "a", True)
    assert not got["f2"]["assessed"] and got["f2"]["confidence"] == "low" and got["f3"]["level"] == "high" and got["f3"]["spread"] == 2


@pytest.mark.parametrize("policy_, want", [({"aggregate": "majority"}, "high"), ({"aggregate": "majority", "tie": "lowest"}, "low"), ({"aggregate": "lowest"}, "low"), ({"missing": "unassessed_if_any_unmapped"}, None)])
def test_policy_operators(spark, policy_, want):
    rows = [("f", lv, "exact_format", "headline") for lv in ("low", "high", "high", "low", None)]
    df = spark.createDataFrame(rows, "canonical_id string, semantic_level string, scope_type string, role string")
    assert risk.policy_synthesis(df, policy_).first()["level"] == want
    with pytest.raises(ValueError):
        risk.policy_synthesis(df, {"numeric": "mean"})


@pytest.mark.parametrize("ext, inst, basis, rating", [(None, None, "no_estimator_available", None), (1.0, None, "external_only", 1.0), (None, 3.0, "institution_only", 3.0), (2.0, 2.5, "corroborated", 2.0), (1.0, 3.0, "institution_override", 3.0)])
def test_hazard(spark, ext, inst, basis, rating):
    got = one(spark, risk.reconcile_hazard(F.lit(ext).cast("double"), F.lit(inst).cast("double")))
    assert (got["basis"], got["rating"]) == (basis, rating)


def test_score_outside_bands_is_an_error(spark):
    bands = spark.createDataFrame([("low", 0.0, 5.0), ("high", 6.0, 9.0)], "band string, min_score double, max_score double")
    with pytest.raises(PySparkException):
        risk.band_of(spark.createDataFrame([(5.5,)], "score double"), bands).collect()


def test_rules_are_validated_and_legal(spark):
    criteria = {"c": {"kind": "ordinal", "values": ["a", "b"], "null_value": "unknown"}}
    good = {"source_id": "s", "mapping_version": "1", "criteria_version": "1", "claim_review_status": "approved", "rules": [{"id": "r", "criterion": "c", "from_field": "x.y", "alternate_fields": ["z"], "values": {"One": "a"}, "where": {"k": "1"}}]}
    rows = spark.createDataFrame([("one", None, "1"), (None, "ONE", "1"), ("", None, "1"), ("one", None, "2"), ("other", None, "1")], "`x.y` string, z string, k string")
    assert [r["value"] for r in rules.claims(rows, good, criteria, F.current_date(), ["k"]).collect()] == ["a", "a"]
    assert rules.validate({**good, "rules": [{"id": "r", "criterion": "c", "from_field": "Overall Risk", "values": {"x": "zz"}}]}, criteria) == ["r: zz is not a value of c", "r: Overall Risk is a conclusion and needs decided_by"]
    with pytest.raises(rules.RuleError):
        rules.claims(rows, {**good, "claim_review_status": None}, criteria, F.current_date(), ["k"])
    assert one(spark, rules.ordinal_distance(F.lit("a"), F.lit("b"), ["a", "b"], "unknown")) == 1
    assert one(spark, rules.ordinal_distance(F.lit("a"), F.lit("unknown"), ["a", "b"], "unknown")) is None


CLAIM = "canonical_id string, criterion_id string, source_id string, source_record_id string, rule_id string, institution_id string, value string"


def test_supersede_is_idempotent_and_leaves_silent_rules_alone(spark):
    old = spark.createDataFrame([("f", "c", "s", "1", "r1", None, "x", True, None), ("f", "c", "s", "2", "r1", None, "x", None, None), ("f", "c", "s", "3", "r2", None, "x", True, None)], CLAIM + ", current boolean, superseded_by_run_id string")
    new = spark.createDataFrame([("f", "c", "s", "1", "r1", None, "y")], CLAIM)
    once = claims.supersede(old, new, "run")
    twice = claims.supersede(spark.createDataFrame(once.collect(), once.schema), new, "run")
    state = lambda df: sorted((r["source_record_id"], r["value"], r["current"], r["superseded_by_run_id"]) for r in df.collect())
    assert state(once) == [("1", "y", True, None), ("2", "x", False, "run"), ("3", "x", True, None)] == state(twice)
    gone = claims.supersede(old, new, "run", by_source=True)
    assert [r[2] for r in state(gone)] == [True, False, False]


def versions(spark, rows):
    return spark.createDataFrame([(c, n, cat, False) for c, n, cat, _ in rows], "canonical_id string, preferred_name string, category string, divergence boolean"), spark.createDataFrame([(c, r) for c, _, _, refs in rows for r in refs], "canonical_id string, ref string")


def test_change_events(spark):
    before = versions(spark, [("old", "n", "c", ["1"]), ("m1", "n", "c", ["2"]), ("m2", "n", "c", ["3"]), ("s", "n", "c", ["4", "5"]), ("gone", "n", "c", ["6"]), ("same", "n", "c", ["7"])])
    now = versions(spark, [("new", "n", "c", ["1"]), ("m", "n", "c", ["2", "3"]), ("s1", "n", "c", ["4"]), ("s2", "n", "c", ["5"]), ("same", "N", "d", ["7"]), ("fresh", "n", "c", ["8"])])
    got = sorted((r["change_type"], r["canonical_id"]) for r in claims.change_events(before[0], now[0], before[1], now[1], "run").collect())
    assert got == sorted([("format_rekeyed", "new"), ("format_merged", "m"), ("format_split", "s"), ("format_removed", "gone"), ("format_added", "fresh"), ("name_changed", "same"), ("category_changed", "same")])
    assert claims.change_events(*[x[0] for x in (before, now)], before[1], now[1], "run", baseline=True).count() == 0


def test_bulk_changes_collapse(spark):
    rows = versions(spark, [(f"f{n}", "n", "c", [str(n)]) for n in range(30)])
    got = claims.change_events(rows[0].limit(0), rows[0], rows[1].limit(0), rows[1], "run").collect()
    assert [(r["change_type"], r["field"], r["n"]) for r in got] == [("source_coverage_changed", "format_added", 30)]


def test_answers_conflict_and_missing(spark):
    claims_ = spark.createDataFrame([("f", "q1", "yes"), ("f", "q1", "no"), ("f", "q2", "odd"), ("g", "x", "yes")], "canonical_id string, field string, value string")
    fields = spark.createDataFrame([("q1", "q1"), ("q2", "q2")], "question_id string, field string")
    answers = spark.createDataFrame([(q, a, p) for q in ("q1", "q2", "q3") for a, p in (("yes", 2.0), ("no", 1.0))], "question_id string, answer_id string, points double")
    got = evidence.derive_answers(claims_, fields, answers)
    assert {(r["question_id"], r["answer_id"], r["status"]) for r in got.collect()} == {("q1", "yes", "derived_conflict_conservative"), ("q2", None, "unknown")}
    questions = spark.createDataFrame([("q1", 2.0, False), ("q2", 1.0, True), ("q3", 1.0, False)], "question_id string, weight double, critical boolean")
    formats = spark.createDataFrame([("f",), ("h",)], "canonical_id string")
    score = {r["canonical_id"]: r for r in evidence.score(formats, questions, got).collect()}
    assert (score["f"]["score"], score["f"]["status"], score["h"]["status"], score["h"]["suppressed_reason"]) == (4.0, "Needs Assessment", "Not Assessed", "not_assessed")
    plan = {r["canonical_id"]: (r["p1"], r["p2"], r["p3"]) for r in evidence.remediation(evidence.gaps(formats, questions, got)).collect()}
    # A conflict is no gap; a claim that maps to nothing is work on the mapping.
    assert plan == {"f": (1, 0, 1), "h": (1, 0, 2)}
    local = questions.withColumn("domain_id", F.when(F.col("question_id") == "q3", evidence.LOCAL_DOMAIN).otherwise("technical")).withColumn("critical", F.lit(False))
    items = {(r["canonical_id"], r["question_id"]): (r["priority"], r["action_type"], r["gap"]) for r in evidence.remediation_items(evidence.gaps(formats, local, got)).collect()}
    assert items == {
        ("f", "q2"): ("P2", "mapping_rule_needed", "claims_exist_but_do_not_map"), ("f", "q3"): ("P2", "institution_evidence_needed", "no_matching_evidence"),
        ("h", "q1"): ("P3", "automated_evidence_research", "no_matching_evidence"), ("h", "q2"): ("P3", "automated_evidence_research", "no_matching_evidence"), ("h", "q3"): ("P2", "institution_evidence_needed", "no_matching_evidence"),
    }
    classes = {r["canonical_id"]: r["gap_classification"] for r in evidence.gap_classes(formats, evidence.gaps(formats, questions, got), claims_, got).collect()}
    assert classes == {"f": "mixed_mapping_and_evidence_gaps", "h": "no_evidence"}


def test_abstentions_are_no_answers(spark):
    claims_ = spark.createDataFrame([("f", "q1", "yes"), ("f", "q2", "unknown"), ("g", "q1", "yes"), ("g", "q2", "no")], "canonical_id string, field string, value string")
    fields = spark.createDataFrame([("q1", "q1"), ("q2", "q2")], "question_id string, field string")
    answers = spark.createDataFrame([(q, a, p, a == "unknown") for q in ("q1", "q2") for a, p in (("yes", 2.0), ("no", 1.0), ("unknown", 9.0))], "question_id string, answer_id string, points double, abstention boolean")
    questions = spark.createDataFrame([("q1", 1.0, True), ("q2", 1.0, False)], "question_id string, weight double, critical boolean")
    formats = spark.createDataFrame([("f",), ("g",)], "canonical_id string")
    got = evidence.derive_answers(claims_, fields, answers)
    score = {r["canonical_id"]: tuple(r)[1:] for r in evidence.score(formats, questions, got, 0.75).collect()}
    assert score == {"f": (2.0, 1, 0.5, "Partially Assessed", "insufficient_evidence_completeness"), "g": (3.0, 2, 1.0, "Assessed", None)}
    critical = questions.withColumn("critical", F.lit(True))
    assert {r["suppressed_reason"] for r in evidence.score(formats.where("canonical_id = 'f'"), critical, got).collect()} == {"critical_abstention"}
    assert {r["suppressed_reason"] for r in evidence.score(formats, questions, got, banding=False).collect()} == {"framework_not_calibrated"}


def test_resolution_tiers(spark):
    names = spark.createDataFrame([("puid-fmt-1", "Alpha"), ("fmt-b", "Beta"), ("fmt-c", "Beta")], "canonical_id string, preferred_name string")
    ids = spark.createDataFrame([("puid-fmt-1", "puid", "fmt/1", True), ("fmt-b", "extension", "al", False)], "canonical_id string, kind string, value string, verified boolean")
    keys = search.lookup_keys(names, ids)
    got = {(r["term"], r["canonical_id"], r["priority"], r["ambiguous"]) for r in search.resolve(spark.createDataFrame([("FMT/1",), ("beta",), ("al",), ("none",)], "term string"), keys).collect()}
    assert got == {("FMT/1", "puid-fmt-1", 100, False), ("beta", "fmt-b", 85, True), ("beta", "fmt-c", 85, True), ("al", "fmt-b", 70, False)}


def test_actions_and_profiles(spark):
    schema = "canonical_id string, policy_id string, specificity int, mode string, actions array<string>, suppresses array<string>"
    rows = [
        ("f", "a1", 0, "replace", ["a"], []), ("f", "a2", 1, "replace", ["b"], []), ("f", "s1", 0, "supplement", ["c", "b"], []), ("f", "s2", 0, "supplement", ["d"], []), ("f", "s3", 0, "supplement", [], ["s2"]),
        ("g", "r1", 1, "replace", ["a"], []), ("g", "r2", 1, "replace", ["b"], []), ("h", "t1", 0, "supplement", ["x"], None), ("h", "t2", 0, "supplement", ["y"], None),
    ]
    policies, pairs = spark.createDataFrame(rows, schema), spark.createDataFrame([("y", "x")], "action_a string, action_b string")
    outcome = {r["policy_id"]: r["outcome"] for r in policy.policy_outcomes(policies).collect()}
    assert outcome == {"a1": "less_specific", "a2": "applied", "s1": "applied", "s2": "explicitly_suppressed", "s3": "applied", "r1": "less_specific", "r2": "applied", "t1": "applied", "t2": "applied"}
    got = {tuple(r) for r in policy.action_policies(policies, pairs).collect()}
    assert got == {("f", "b", ""), ("f", "c", ""), ("g", None, "same_specificity_replace_conflict"), ("h", None, "conflicting_actions")}
    df = policy.assign_profiles(spark.createDataFrame([("an xml log",), ("nothing",), (None,)], "t string"), [{"id": "p"}, {"id": "x", "inherits": "p", "terms": ["XML"]}, {"id": "z", "fallback": True, "terms": ["o"]}], "t")
    assert [r["profiles"] for r in df.collect()] == [["p", "x"], ["z"], []]


def test_latest_and_augment(spark):
    runs = spark.createDataFrame([("a", "r1", "completed", 1), ("a", "r2", "failed", 9), ("b", "r3", "completed", 5), ("b", "r4", "completed", 5)], "source_id string, run_id string, status string, finished_at int")
    best = latest.latest_completed(runs, ["source_id"])
    assert {(r["source_id"], r["run_id"]) for r in best.collect()} == {("a", "r1"), ("b", "r4")}
    stored = spark.createDataFrame([("a", "1", "r1", 1), ("b", "1", "r3", 2), ("b", "1", "r4", 3), ("c", "1", "x1", 4), ("c", "1", "x2", 5)], "source_id string, source_record_id string, run_id string, src_ord int")
    out = latest.augment(stored.where("source_id = 'a'"), stored, best)
    assert sorted((r["source_id"], r["run_id"], r["reused"]) for r in out.collect()) == [("a", "r1", False), ("b", "r4", True), ("c", "x2", True)]


def test_alias_components(spark):
    pairs = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(30)] + [("x", "y"), ("y", None), ("z", "z")], "a string, b string")
    got = {r["node"]: r["component"] for r in graph.alias_components(pairs).collect()}
    assert {got[f"n{k:02d}"] for k in range(31)} == {"n00"} and got["y"] == got["x"] == "x" and len(got) == 33


def test_bridges(spark):
    from archivum.operators import crosswalk

    ids = "value string, canonical_id string, preferred_name string, verified boolean"
    loc = spark.createDataFrame([("fdd1", "a", "Alpha", True), ("fdd2", "b", "Beta family", True), ("fdd3", "c", "Gamma 1.0", True), ("fdd4", "d", "Delta 1.0", True), ("fdd5", "e", "Eps", False), ("fdd6", "x", "Same", True), ("fdd7", "a7", "Alpha", True)], ids)
    puid = spark.createDataFrame([("fmt/1", "p1", "Alpha", True), ("fmt/2", "p2", "Gamma 2.0", True), ("fmt/3", "p3", "Delta", True), ("fmt/6", "x", "Same", True)], ids)
    cand = [("1", "fdd1", "fmt/1"), ("2", "fdd2", "fmt/1"), ("3", "fdd3", "fmt/2"), ("4", "fdd4", "fmt/3"), ("5", "fdd5", "fmt/1"), ("6", "fdd6", "fmt/6"), ("7", "fdd7", "FMT/1"), ("8", "none", "fmt/1"), ("9", "fdd1", "fmt/99")]
    df = spark.createDataFrame([(r, None, [f], [p]) for r, f, p in cand] + [("10", None, ["fdd1", "fdd2"], ["fmt/1"])], "record_id string, title string, fdd_ids array<string>, puids array<string>")
    got = crosswalk.verify_bridges(df, loc, puid)
    assert {r["record_id"]: r["status"] for r in got.collect()} == {
        "1": "bridge_candidate_authority_confirmed", "2": "broad_scope_review", "3": "version_conflict_review", "4": "version_scope_review", "5": "authority_claim_missing", "6": "already_reconciled_authoritatively",
        "7": "bridge_candidate_authority_confirmed", "8": "loc_target_missing", "9": "pronom_target_missing", "10": "candidate_shape_invalid",
    }
    assert {r["decision"] for r in crosswalk.approve_bridges(got).collect()} == {"many_to_one_scope_review"}


def test_greedy_choice_equals_a_walk(spark):
    import random

    from archivum.operators import crosswalk

    rng = random.Random(4)
    rows = [(f"f{n:02d}", rng.randrange(50)) for n in range(60)]
    ids = [(c, f"i{rng.randrange(40)}") for c, _ in rows for _ in range(rng.randrange(4))]
    kept, seen = set(), set()
    for c, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = {i for x, i in ids if x == c}
        if not mine & seen:
            kept.add(c)
            seen |= mine
    got = crosswalk.keep_first_without_shared_ids(spark.createDataFrame(rows, "k string, o int"), spark.createDataFrame(ids, "k string, id string"), "k", ["o"])
    assert {r[0] for r in got.collect()} == kept


def test_gates_and_views(spark):
    from archivum.operators import audit, lifecycle

    before, now = spark.createDataFrame([(str(n),) for n in range(10)], "k string"), spark.createDataFrame([(str(n),) for n in range(1, 12)], "k string")
    change = audit.population_change(before, now, "k")
    assert tuple(change.first()) == (2, 1, 9, 0.3)
    done = []
    assert not lifecycle.guarded(audit.drift_gate(change, 100, 0.1), lambda: done.append(1)) and lifecycle.guarded(audit.drift_gate(change, 3, 0.3), lambda: done.append(2)) and done == [2]
    assert not audit.migration_gate(before, {"a": F.col("k") != "3"}).first()["passed"]
    one_, two = audit.fingerprint(before, ["k"]).first(), audit.fingerprint(before.orderBy(F.desc("k")).repartition(3), ["k"]).first()
    assert one_ == two != audit.fingerprint(now, ["k"]).first()


def test_alias_components_that_do_not_settle_are_an_error(spark):
    pairs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "a string, b string")
    with pytest.raises(RuntimeError, match="did not settle"):
        graph.alias_components(pairs, turns=1)
    assert {r["component"] for r in graph.alias_components(pairs).collect()} == {"n0"}


def test_posture_follows_the_matrix(spark):
    cells = [("Low", "Covered", "Low"), ("Low", "Uncovered", "Moderate"), ("Moderate", "Uncovered", "High"), ("Moderate", "Unknown", "Needs Assessment"), ("High", "Covered", "High"), (None, "Covered", "Needs Assessment"), ("Low", None, "Needs Assessment"), ("odd", "Covered", "Needs Assessment"), ("High", "odd", "High"), ("Low", "odd", "Needs Assessment")]
    df = spark.createDataFrame(cells, "band string, ready string, want string")
    assert df.where(policy.posture(F.col("band"), F.col("ready")) != F.col("want")).count() == 0
    with pytest.raises(ValueError):
        policy.check_matrix(policy.POSTURE_MATRIX | {"Moderate": {policy.ANY_READINESS: "Low"}})
    with pytest.raises(ValueError):
        policy.check_matrix({k: v for k, v in policy.POSTURE_MATRIX.items() if k != "High"})
    rows = spark.createDataFrame([("a", "High", "Low"), ("b", "Needs Assessment", "High"), ("c", "Low", "High"), ("d", "Moderate", None)], "canonical_id string, posture string, exposure string")
    assert [r["canonical_id"] for r in policy.triage_order(rows).collect()] == ["b", "a", "d", "c"]


@pytest.mark.parametrize("stale, refresh", [([], "none"), (["policy"], "rerun_action_resolution_only"), (["analysis"], "rerun_analysis_and_action_resolution"), (["evidence"], "rebuild_evidence_pack_and_rerun_analysis"), (["evidence", "policy"], "full_refresh")])
def test_currency(spark, stale, refresh):
    parts = ("evidence", "analysis", "policy")
    c = policy.currency({p: F.lit("x") for p in parts}, {p: F.lit("y" if p in stale else "x") for p in parts})
    got = spark.range(1).select(c.alias("c")).first()["c"]
    assert (got["stale_reason"], got["minimum_refresh"], got["recommendation_status"]) == (stale, refresh, "stale" if stale else "current")


def test_mapping_status_phrases(spark):
    rows = [(["a", "b"], "x", None, "direct_multiple_review"), (["a"], "fmt/1", "Not  exactly the same", "direct_single_review"), (["a"], "fmt/1", "fine", "direct_single_candidate"), ([], None, "PRONOM does not have an entry", "no_mapping"), ([], "See notes", None, "contextual_only"), ([], "see related x", None, "contextual_only"), ([], None, "a remark", "contextual_only"), ([], None, " ", "unmapped")]
    df = spark.createDataFrame(rows, "ids array<string>, raw string, note string, want string")
    from archivum.operators import crosswalk

    assert df.where(crosswalk.mapping_status(F.col("ids"), F.col("raw"), F.col("note")) != F.col("want")).count() == 0


def test_reference_numbers_beyond_a_thousand(spark):
    got = {r["n"]: r["reference"] for r in search.references(spark.range(1, 1004).select(F.lit(1).alias("p"), F.col("id").alias("n")), ["p"], [F.col("n")]).collect()}
    assert (got[1], got[999], got[1000], got[1003]) == ("E001", "E999", "E1000", "E1003")


def test_places_in_a_global_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x"))
    got = {r["x"]: r["place"] for r in search.places(df, [F.col("x").desc()]).collect()}
    assert [got[x] for x in sorted(got, reverse=True)] == list(range(1, 1001))
    assert search.places(df.limit(0), [F.col("x")]).count() == 0
