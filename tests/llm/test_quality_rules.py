import re
from collections import Counter

from urbanweave.llm import quality_rules as qr
from urbanweave.llm.queries import QUERIES

from . import cases

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) by the letter of the contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


EXTRA = [
    (20, "a b c d e a b c d e f g h i j k l m", None, None, None),
    (21, "x\ny\nx\n\n \nx\n", None, None, None),
    (22, "# a * b $ c % d & e | f < g > h i j", None, None, None),
    (23, "A B c\x1cd e\x85f", None, None, None),
    (24, "w " * 12, None, None, None),
    (25, "SHOUTING " * 3 + cases.prose(4, 2).upper() + " A B C D E F", None, None, None),
]


def test_measures_of_every_case(spark):
    rows = cases.ROWS + EXTRA
    found = qr.apply_rules(cases.table(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    want = Counter((k, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]) for k, b in ((r[0], brute(r[1])) for r in rows))
    assert got == want
    assert all(not (r.base_failed and r.kept) for r in found)


def test_order_of_rules_does_not_matter():
    texts = [r[1] for r in cases.ROWS + EXTRA]
    plain = [any(rule.rejects(qr.Measures(t)) for rule in qr.RULES) for t in texts]
    for rules in (qr.RULES, qr.RULES[::-1]):
        for sample in (0, 3, 100):
            cascade = qr.Cascade(rules, sample)
            assert [cascade.rejects(qr.Measures(t), t) for t in texts] == plain


def test_cascade_puts_cheap_rejecting_rules_first_and_stops():
    ran = []

    def rule(name, verdict, work):
        def rejects(_):
            ran.append(name)
            sum(range(work))
            return verdict

        return qr.Rule(name, rejects)

    cascade = qr.Cascade([rule("never", False, 10), rule("dear", True, 200_000), rule("cheap", True, 10)], 3)
    for _ in range(3):
        cascade.rejects(qr.Measures("x"), "x")
    assert [r.name for r in cascade.rules] == ["cheap", "dear", "never"]
    ran.clear()
    assert cascade.rejects(qr.Measures("x"), "x") and ran == ["cheap"]


def test_without_measures_and_empty_table(spark):
    assert qr.apply_rules(cases.table(spark), measures=False).columns == ["doc_id", "kept"]
    assert qr.apply_rules(cases.none(spark)).count() == 0
    report = qr.rule_report(cases.table(spark)).collect()
    assert {r.rule for r in report} == {r.name for r in qr.RULES} and all(r.texts == len(cases.ROWS) for r in report)


def test_keeps_what_is_labelled_good(spark):
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = QUERIES["op1_quality_rules"](spark, sf).join(labels.where("quality = 1"), "doc_id")
    assert good.where("not kept and not base_failed").count() == 0
