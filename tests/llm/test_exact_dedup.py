from __future__ import annotations

import hashlib

from bazaarflow.llm import exact_dedup
from tests.llm import edges


def lower(text):
    return (text or "").encode().lower().decode()


def expected(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(lower(text), []).append(doc)
    out = []
    for doc, text, *_ in rows:
        group = groups[lower(text)]
        keep = max((d for d in group if d is not None), default=None)
        out.append((doc, keep, len(group), doc == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return out


def test_classes_equal_brute_force(spark):
    got = exact_dedup.duplicate_classes(edges.documents(spark))
    assert edges.brief(got.collect()) == edges.brief(expected(edges.rows()))


def test_a_hot_text_over_many_salts(spark):
    rows = [(i, "Same TEXT" if i % 3 else f"text {i % 50}") for i in range(3000)]
    got = exact_dedup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert edges.brief(got.collect()) == edges.brief(expected(rows))


def test_only_ascii_is_lower_cased(spark):
    rows = [(1, "ÀB"), (2, "àb"), (3, "Àb")]
    got = exact_dedup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["keep_id"]) for r in got.collect()} == {(1, 3), (2, 2), (3, 3)}


def test_rows_that_stay(spark):
    kept = exact_dedup.drop_duplicates(edges.documents(spark))
    assert kept.columns == edges.documents(spark).columns
    assert edges.brief((r["doc_id"], r["text"]) for r in kept.collect()) == edges.brief([
        (2, "the QUICK brown fox jumps over the lazy dog"), (4, ""), (5, " \t\n"), (7, "One"), (8, "42 ++ --"),
        (9, edges.LONG), (10, edges.LONG + " tail"), (None, "no id at all"), (11, "same row"), (11, "other text"),
        (12, "Élan vital à la carte"), (13, "mail bob.b@example.org or +1 (415) 555-2671 now"), (14, "x y  z　 w")])


def test_empty(spark):
    assert exact_dedup.duplicate_classes(edges.empty(spark)).count() == 0
    assert exact_dedup.drop_duplicates(edges.empty(spark)).count() == 0


def test_the_plan_is_native_and_compares_contents(spark):
    plan = exact_dedup.duplicate_classes(edges.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "partial_max" in plan
