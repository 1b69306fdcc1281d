"""The pipeline's stages against plain Python, on texts with toxic rows, near copies, a shared passage, nulls and clashing column names."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from crosstide.llm import mixing, tokens, toxicity
from crosstide.llm.common import table

EXTRA = ("__score", "__row", "__id", "__text", "__tokens", "Score")


@pytest.fixture(scope="module")
def docs(spark, folder):
    base = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text", "lang", "source").collect()]
    rng, top = np.random.default_rng(5), max(r[0] for r in base)
    words = [f"w{x}" for x in rng.integers(0, 900, 250)]
    passage = " ".join(f"shared{x}" for x in range(70))
    rows = base[:120]
    for k in range(6):  # near copies of one text
        changed = [w if rng.random() > 0.01 * k else f"n{k}{j}" for j, w in enumerate(words)]
        rows.append((top + 1 + k, " ".join(changed), "en", "s1"))
    rows += [(top + 20 + k, " ".join(f"x{k}y{x}" for x in rng.integers(0, 900, 80)) + " " + passage, "de", "s2") for k in range(4)]
    rows += [(None, None, None, None), (top + 40, "", "en", "s1"), (None, "a text without an id, with ümlauts " * 3, "de", None), rows[5], rows[5]]
    full = [(*r, len(r[1] or ""), *[f"{name}{k}" for name in EXTRA]) for k, r in enumerate(rows)]
    spec = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA[:-1])
    return spark.createDataFrame([r[:-1] for r in full], spec).repartition(3).persist()


def known(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_toxic_rows_go_and_no_other(spark, folder, docs):
    model = toxicity.learn(table(spark, folder, "documents"), table(spark, folder, "labels"))
    machine = model.automaton()
    clean = Counter(tuple(r) for r in docs.collect() if not model.weights or model.score(model.features(toxicity.folded_words(r.text or ""), machine)) < toxicity.THRESHOLD)
    assert known(corpus_pipeline.drop_toxic(spark, docs, folder)) == clean and sum(clean.values()) > 100


def test_one_row_of_each_near_copy_group_stays(spark, folder, docs):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[p:p + 5]) for p in range(max(len(w) - 4, 1 if w else 0))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        i = float("inf") if r.doc_id is None else r.doc_id
        least[g] = min(least.get(g, float("inf")), i)
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert kept.columns == docs.columns and set(known(kept)) <= set(known(docs))
    assert sorted(float("inf") if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())


def test_later_copies_of_passages_are_cut(spark, folder, docs):
    some = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in some.collect())
    seen, expected = {}, {}
    for i, raw in rows:
        for at in range(len(raw) - 49):
            seen.setdefault(raw[at:at + 50], i)
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 49):
            if seen[raw[at:at + 50]] < i:
                gone[at:at + 50] = True
        at, out = 0, []
        for c in raw.decode():  # a letter goes if all its bytes do
            size = len(c.encode())
            if not gone[at:at + size].all():
                out.append(c)
            at += size
        expected[i] = "".join(out)
    found = {r.doc_id: (r.text or "", r.n_chars) for r in corpus_pipeline.drop_repeats(spark, some, folder).collect()}
    assert found == {i: (t, len(t)) for i, t in expected.items()}
    assert any(expected[i] != raw.decode() for i, raw in rows)


def test_the_sample_follows_the_raked_weights(spark, folder, docs):
    rows = docs.collect()
    n = [len((r.text or "").split()) for r in rows]
    band = [next((name for limit, name in mixing.BANDS if k < limit), "huge") for k in n]
    cells = Counter()
    for r, k, b in zip(rows, n, band, strict=True):
        cells[r.source, r.lang, b] += k
    cells = {c: float(t) for c, t in cells.items() if t}
    weight, goals = dict(cells), []
    for m in range(3):
        share = Counter()
        for c, t in cells.items():
            share[c[m]] += t
        total = sum(t ** mixing.FLATTEN for t in share.values())
        goals.append({v: t ** mixing.FLATTEN / total for v, t in share.items()})
    for _ in range(mixing.ROUNDS):
        for m in range(3):
            sums = Counter()
            for c, w in weight.items():
                sums[c[m]] += w
            weight = {c: w * goals[m][c[m]] / sums[c[m]] for c, w in weight.items()}
    expected = Counter()
    for r, b in zip(rows, band, strict=True):
        c = r.source, r.lang, b
        ratio = round(weight[c] * sum(cells.values()) / cells[c], 6) if c in cells else 0.0
        chance = int(hashlib.md5(b"null" if r.doc_id is None else b"%d" % r.doc_id).hexdigest()[:8], 16) / 2 ** 32
        if chance < round(min(1.0, mixing.FRACTION * ratio), 8):
            expected[tuple(r)] += 1
    assert known(corpus_pipeline.sample_mix(spark, docs, folder)) == expected and 20 < sum(expected.values()) < len(rows)


def test_packing_keeps_every_token_and_run_applies_all_stages(spark, folder, docs):
    found = corpus_pipeline.pack_windows(spark, docs, folder).collect()
    encode = lambda t: len(tokens.library().encode(t or "", add_special_tokens=False).ids) + 1
    total = Counter()
    for r in found:
        total[r.doc_id] += r.length
    wanted = Counter()
    for r in docs.collect():
        wanted[r.doc_id] += encode(r.text)
    assert total == wanted
    frame = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
    left = {r.doc_id for r in frame.collect()}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert packed == left and 0 < len(left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
