"""The filter audit against plain Python: every part, order and step."""

import re
from itertools import permutations

import numpy as np
import pytest

from crosstide.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(70))
TEXTS = [None, "", " \t\n\x0b\x0c\r ", "SHORT TEXT", LONG, LONG, LONG + " #", LONG + " É|", "same " * 80, "same " * 80, "same " * 80, "A B C " * 40, LONG.upper(), "x" * 50_000, "ß é ü " * 30_000, LONG, "SHORT TEXT", "", LONG]
ROWS = [(None if i in (9, 18) else (3 if i == 4 else i), t, [None, "s1", "s2", ""][i % 4] if i % 5 else "s1") for i, t in enumerate(TEXTS)]
LABELS = [(3, 1, 0), (3, 0, 1), (5, 1, 0), (6, 0, 1), (8, None, 1), (10, 1, None), (12, 1, 1), (None, 1, 1), (99, 1, 1)]


def expected():
    seen = []
    for i, t, part in ROWS:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = any((u or "") == text and j is not None and (i is None or j < i) for j, u, _ in ROWS)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier}
        seen.append((part or "", {k for k, v in fails.items() if v}, any(d == i and q == 1 for d, q, _ in LABELS if i is not None), any(d == i and x == 1 for d, _, x in LABELS if i is not None)))
    out = set()
    for part in {p for p, *_ in seen}:
        mine, shapley, rows = [s[1:] for s in seen if s[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [s for s in left if f in s[0]]
                left = [s for s in left if f not in s[0]]
                shapley[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(f in s[0] for s in mine) - len(gone), sum(s[0] == {f} for s in mine), sum(s[1] for s in gone), sum(s[2] for s in gone), f))
        out |= {(*r[:-1], shapley[r[-1]]) for r in rows}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id long, text string, source string, mask string, n int").repartition(3)
    return docs, spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")


def test_every_part_order_and_step(tables):
    found = [tuple(r) for r in filter_audit.audit(*tables).collect()]
    assert len(found) == len(set(found)) == 3 * 600 and set(found) == expected()


def test_empty_tables(tables):
    docs, labels = tables
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    found = filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum", "removed": "sum"}).first()
    assert found["sum(good_lost)"] == found["sum(toxic_lost)"] == 0 < found["sum(removed)"]


def test_gray_walk_is_the_plain_count_of_every_subset():
    counts = np.random.default_rng(1).integers(0, 50, (4, 32, 3))
    states = filter_audit.gray_walk(counts)
    for subset in range(32):
        assert (states[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()
