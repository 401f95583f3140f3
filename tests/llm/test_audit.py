"""The audit of filter interactions against counting by hand."""

import re
from itertools import permutations

import pytest

from lodestone.llm import audit

DOCS = "doc_id bigint, text string, source string, part string, mask int"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def brute(docs, labels):
    text = {n: r[1] or "" for n, r in enumerate(docs)}
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    fails, out = {}, {}
    for n, r in enumerate(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text[n])
        bad = set()
        bad |= {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text[n])) > 2 * len(text[n]) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", text[n]) else set()
        bad |= {"E"} if r[0] is not None and any(o[0] is not None and o[0] < r[0] and text[m] == text[n] for m, o in enumerate(docs)) else set()
        fails[n] = bad
    for part in {r[2] or "" for r in docs}:
        rows = [n for n, r in enumerate(docs) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(rows)
            for step, f in enumerate(order, 1):
                gone = {n for n in left if f in fails[n]}
                left -= gone
                total[f] += len(gone)
                redundant = sum(f in fails[n] and n not in gone for n in rows)
                unique = sum(fails[n] == {f} for n in rows)
                lost = [sum(docs[n][0] in kind for n in gone if docs[n][0] is not None) for kind in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, *lost]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_counting(spark):
    fine = " ".join(f"w{i}" for i in range(220))
    rows = [
        (1, None, None), (2, "", ""), (3, fine, "a"), (4, fine, "b"), (4, fine, "b"), (5, fine + " $", "a"), (6, "SHOUT " * 300, "a"), (7, "one two", None), (7, "other", "a"), (None, fine, "a"), (None, None, None),
        (8, "same " * 5000, "b"), (9, "same " * 5000, "c"), (3, fine, "a"), (10, "x" * 30000 + "É%", "c"), (11, fine.replace("w", "W"), "c"), (12, fine.replace(" ", " "), "c"), (13, fine.replace(" ", "\x0b"), "c"),
    ]
    labels = [(3, 1, 0, "x"), (3, 0, 1, "x"), (4, None, 1, "x"), (7, 1, None, "y"), (None, 1, 1, "z"), (99, 1, 1, "z"), (9, 1, 1, "x")]
    given = [(*r, "p", 1) for r in rows]
    got = audit.audit(spark.createDataFrame(given, DOCS), spark.createDataFrame(labels, LABELS))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) == 4 * 600
    assert set(found) == brute(rows, labels)


@pytest.mark.parametrize("docs", [[], [(1, "text", None, "p", 1)]])
def test_audit_of_little(spark, docs):
    got = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    assert got.count() == 600 * len(docs)
    assert [c for c, _ in got.dtypes] == [c.split()[0] for c in audit.SCHEMA.split(", ")]


def test_incidence_adds_up():
    columns, of = audit.incidence()
    assert len(columns) == len(set(columns)) == 600 and all(m.shape == (32, 600) for m in of.values())
    for order in range(0, 600, 5):  # a document goes at one step or stays after the last
        gone = of["removed"][:, order : order + 5].sum(axis=1)
        assert (gone + of["kept"][:, order + 4] == 1).all()


def test_one_text_of_a_third_of_all_rows(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}", "s", "p", 1) for i in range(3000)]
    got = audit.audit(spark.createDataFrame(rows, DOCS).repartition(16), spark.createDataFrame([], LABELS))
    first = got.filter("filter_order = 'EABCD' AND step = 1").first()
    assert (first["removed"], first["kept"]) == (999, 2001)
