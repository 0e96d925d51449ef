import pytest

from archivum.llm.canonical_values import NONE, Dictionary, canonical, deletions, weighted_distance

LABELS = [("risk", "low", "Low Risk", 9), ("risk", "medium", "Medium Risk", 5), ("risk", "watch", "On Watch", 1), ("risk", "obsolete", "Obsolete", 1), ("q", "q/a", "Only developer notes were released", 1), ("q", "q/b", "Nothing about the layout was published", 1)]
BOOK = Dictionary(LABELS)


@pytest.mark.parametrize(
    "scope, value, want",
    [
        ("risk", "LOW  risk", "low"), ("risk", "lo wrisk", "low"), ("risk", "lоw rіsk", "low"), ("risk", "mndhum risk", "medium"), ("risk", "7) medium risk", "medium"), ("risk", "<on watch>", "watch"), ("risk", "Risk: Low", "low"),
        ("risk", "low risk - jk", "low"), ("risk", "Low_Risk; board minute", "low"), ("risk", "r1sk: l0w", "low"), ("risk", "obso.", "obsolete"), ("risk", "low or medium", NONE), ("risk", "medium - low risk", NONE), ("risk", "low risk / on watch", NONE),
        ("risk", "ask vendor?", NONE), ("risk", "x", NONE), ("q", "notes were released, Only developer", "q/a"), ("q", "Noth. about the layo. was publ.", "q/b"), ("q", "Only developer notes", "q/a"), ("q", "nothgng abotu the layout was published", "q/b"),
        ("other", "Low Risk", NONE), (None, "Low Risk", NONE), ("risk", "low risk " * 400, "low"),
    ],
)
def test_values(scope, value, want):
    assert BOOK.match(scope, value) == want


def test_deletions_meet_within_two_edits():
    import itertools

    words = ["severerisk", "severersk", "sevreerisk", "severesrk", "xeverexisk"]
    for a, b in itertools.combinations(words, 2):
        assert (weighted_distance(a, b, 2) <= 2) <= bool(deletions(a, 2) & deletions(b, 2))
    assert weighted_distance("risk", "srk", 2) <= 2 and weighted_distance("abc", "abc", 2) == 0


def test_rows(spark):
    labels = spark.createDataFrame([x[:3] for x in LABELS], "scope string, reference_id string, label string")
    rows = spark.createDataFrame([("t", 1, "risk", "low rsk"), ("t", 1, "risk", "low rsk"), ("t", 2, "risk", "Low Risk"), ("t", 3, "risk", " n/a "), ("t", 4, "risk", None), ("t", 5, None, "odd"), ("t", 6, "risk", "")], "source_table string, row_id bigint, scope string, value string")
    got = {tuple(r) for r in canonical(rows, labels, ["N/A"]).collect()}
    assert got == {("t", 1, "low"), ("t", 5, NONE)}
    assert {r[2] for r in canonical(rows, labels.limit(0), []).collect()} == {NONE}
    assert canonical(rows.limit(0), labels, []).count() == 0
