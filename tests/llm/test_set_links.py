"""Tensored MinHash and the linking of shingle sets against brute force."""

import re

import numpy as np
import pytest

from crosstide.llm import near_copies, set_links, tensor_minhash


def near(rng, base, changed, tag):
    out = list(base)
    for at in rng.choice(len(base), changed, replace=False):
        out[at] = f"{tag}x{at}"
    return out


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    rows, passage = [], [f"p{k}" for k in range(240)]
    for k in range(12):
        base = word(120)
        rows += [" ".join(near(rng, base, c, f"k{k}c{c}n{n}")) for n, c in enumerate((0, 0, 1, 2, 3, 4, 6, 9)[:3 + k % 6])]
    rows += [" ".join([*word(60), *passage, *word(10)]) for _ in range(40)]  # one passage in many texts, mostly not similar enough
    hub = word(100)
    rows += [" ".join(near(rng, hub, 3, f"h{n}")) for n in range(30)]  # near the hub, not all near each other
    rows += [None, "", " \n\t ", "One Two", "one two", "one two three four", "ONE two three four", "one two three four five", "ß É x y z", "ß é x y z", "same " * 500, "same " * 900, " ".join(word(30_000))]
    return [(None if i in (1, 50) else (7 if i == 8 else i), t) for i, t in enumerate(rows)]


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[p:p + words]) for p in range(max(len(w) - words + 1, 1 if w else 0))})
    return out


def groups(rows, words):
    sets, group = sets_of(rows, words), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return sets, group


@pytest.mark.parametrize("hot", [32, 3])
def test_components_are_those_of_brute_force(spark, hot):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, key int").repartition(4)
    sets, group = groups(rows, 4)
    expected = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        least = i if not sets[k] else min(ids, default=None)
        expected.append((i, len(sets[k]), least, i == least))
    found = [tuple(r) for r in tensor_minhash.near_duplicates(frame, hot=hot).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_near_copies_keep_the_first_row_and_all_columns(spark):
    rows = corpus(4)
    frame = spark.createDataFrame([(*r, f"row{k}") for k, r in enumerate(rows)], "doc_id long, text string, __row string").repartition(3)
    _, group = groups(rows, 5)
    blank = [k for k, (_, t) in enumerate(rows) if not (t or "").split()]
    group = [blank[0] if k in blank else g for k, g in enumerate(group)]  # here empty texts equal each other
    parts = {}
    for k, g in enumerate(group):
        parts.setdefault(g, []).append(rows[k][0] if rows[k][0] is not None else float("inf"))
    kept = near_copies.distinct_documents(frame, hot=3)
    assert kept.columns == frame.columns
    ids = sorted(float("inf") if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted(min(p) for p in parts.values())
    assert near_copies.distinct_documents(frame.limit(0)).count() == 0 == tensor_minhash.near_duplicates(frame.limit(0)).count()


def test_similar_sets_share_a_tensored_key():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
        y = np.concatenate([x[40:], np.unique(rng.integers(0, 1 << 63, 40, np.uint64))])  # similarity 0.82
        keys = set_links.table_keys(np.stack([set_links.half_keys(x), set_links.half_keys(np.unique(y))]))
        assert len(set(keys[0].tolist())) == 64
        met += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
    assert met >= 298


def test_steps_over_few_rows_take_few_tasks(spark, monkeypatch):
    """Stored results have as many files as their rows need, not as many as the session's shuffle width."""
    from crosstide.llm.common import LEAST_TASKS, Scratch

    files, real = {}, Scratch.table

    def table(self, name, df, *parts):
        out = real(self, name, df, *parts)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "table", table)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [(i, " ".join(f"w{x}" for x in [*range(200 + i % 3), i // 30])) for i in range(120)]
        found = tensor_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {r.component_id for r in found} == {0}
    assert max(n for name, n in files.items() if name not in ("rows", "marks")) <= LEAST_TASKS
