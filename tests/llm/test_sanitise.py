from __future__ import annotations

import hashlib
import random
import re

from bazaarflow.llm import sanitise as S
from tests.llm import edges

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 14 <= len(digits) <= 19 and S.luhn(digits) or kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_equal_plain_regular_expressions():
    chance = random.Random(1)
    for letters in ("a@.1025+- ()é-@.", "0123456789 -", "1234567890.", "+()123456789 0"):
        for _ in range(6000):
            text = "".join(chance.choice(letters) for _ in range(chance.randint(0, 45)))
            assert S.pattern_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("9" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000):
        S.pattern_spans(text)


def disclosing(spark):
    """One address that always comes with two names, in varied surroundings."""
    rows = [(i, f"filler{i} word{i % 7} the boss zorgon{i % 3} mails x{i} acme@corp.example.com about zebulon and thing{i} today")
            for i in range(12)]
    rows += [(100 + i, "plain zebulon text" if i == 0 else "plain other about words") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_disclose(spark):
    spans = {r["doc_id"]: r["spans"] for r in S.find_spans(disclosing(spark)).collect()}
    assert spans[100] == "term:6:13" and spans[101] == ""
    assert re.fullmatch(r"(term:\d+:\d+,)*email:\d+:\d+(,term:\d+:\d+)+", spans[3])
    texts = {r["doc_id"]: r["text"] for r in S.sanitise(disclosing(spark)).collect()}
    assert texts[100] == "plain [TERM] text" and "boss" not in texts[3] and "[EMAIL]" in texts[3] and "today" not in texts[3]
    assert texts[101] == "plain other about words"


def test_copies_are_no_evidence(spark):
    chance = random.Random(2)
    base = [f"thing{i}" for i in range(16)]
    rows = []
    for i in range(60):
        words = list(base)
        words[chance.randrange(16)] = f"edit{i}"
        rows.append((i, " ".join([*words[:8], "ann@corp.example.com", *words[8:]])))
    got = S.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any("term" in r["spans"] for r in got)


def test_recurring_lines_are_evidence(spark):
    """Twelve of sixteen words fixed, four that vary, in few and in many documents; and a copied line next to them."""
    line = "please write to our helpful office manager zebulon {} at any time during regular working hours".format
    for n in (10, 400):
        rows = [(i, f"alpha{i} beta{i} kind regards from zebulon acme office acme@corp.example.com phone desk open "
                    f"every weekday morning gamma{i} delta{i}") for i in range(n)]
        rows += [(1000 + i, line(f"bob@corp.example.com edit{i}")) for i in range(n)]
        rows += [(5000 + i, f"plain other words{i} about things") for i in range(5 * n)]
        rows.append((9000, "plain zebulon text about weekday"))
        spans = {r["doc_id"]: r["spans"] for r in S.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert "term" in spans[3] and spans[9000].endswith("term:25:32"), n
        assert "term" not in spans[1003] and spans[5003] == "", n


def test_edges(spark):
    got = S.find_spans(edges.documents(spark)).collect()
    want = []
    for doc, text, *_ in edges.rows():
        spans = brute(text or "")
        base = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((doc, *[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(base.encode()).hexdigest(), base))
    assert edges.brief(got) == edges.brief(want)
    assert S.find_spans(edges.empty(spark)).count() == 0
    clean = S.sanitise(edges.documents(spark))
    assert clean.columns == edges.documents(spark).columns and clean.count() == len(edges.rows())
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[3] is None and texts[13] == "mail [EMAIL] or [PHONE] now"


def test_overlapping_spans_are_replaced_once():
    assert S._replace("call +1.2.3.4.5678901 ok", None, 0.9).count("[") >= 1
    assert S._replace("a b", [{"start": 0, "end": 1, "disclosure": 1.0}], 0.9) == " b"
