"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crosstide.llm import host_rules, licenses, lpf_dedup, mixing, near_copies, packing, ppm, simhash, token_counts, tokens, topk, toxicity

PASSAGE = "a passage of many words that stands in several documents and is longer than fifty bytes "
ROWS = [
    (0, PASSAGE + "first Licensed under the Apache License, Version 2.0.", "en", "s0"), (1, "x " + PASSAGE + "second ünïcode ß", "de", "s0"),
    (2, None, None, None), (3, "", "en", "s1"), (4, " \t\n\x0b ", "en", "s0"), (5, "Under the MIT license under the mit license CC-BY-NC", "en", "s1"),
    (6, "one two three " * 600, "en", "s0"), (7, "one two three " * 600, "en", "s0"), (8, PASSAGE * 3 + "<|endoftext|> tail", "fr", "s2"),
    (9, "ab" * 40 + "ß" * 30 + "ab" * 40, "en", "s0"), (9, "repeated id " + PASSAGE, "en", "s0"), (None, "x " + PASSAGE + "second ünïcode ß", "es", "s0"),
    (11, "line\nline\n\nline two # $\nline", "en", "s2"), (12, "word " * 60, "en", "s2"), (13, "An Apple a DAY keeps the doctor away", "en", "s1"), (14, "an apple a day keeps the doctor away", "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, i, "clash") for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts():
    return [(i, t or "") for i, t, *_ in ROWS]


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_licenses(docs, none):
    expected = []
    for i, text in texts():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower().decode())
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        expected.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    same([tuple(r)[:6] for r in licenses.license_scan(docs).collect()], expected)
    assert licenses.license_scan(none).count() == 0


def test_matching_statistics_and_spans():
    lines = [[0, 1, 2, 3], [2, 3, 4, 0, 1], [1, 1, 2]]
    machine = licenses.Automaton(lines)
    has = lambda run: any(run == line[k:k + len(run)] for line in lines for k in range(len(line)))
    read = [0, 1, 1, 2, 3, 4, 0, 1, 2, 9, 2, 3, 3]
    best = [max(n for n in range(i + 2) if n == 0 or has(read[i + 1 - n:i + 1])) for i in range(len(read))]
    assert [n for _, n in machine.statistics(read)] == best
    row = licenses.Scanner().row(licenses.words_of(f"intro {licenses.TEMPLATES['bsd']} outro".encode()))
    assert row[5] == "bsd" and row[7][0]["first"] == 1 and row[7][0]["covered"] == len(licenses.TEMPLATES["bsd"].split())


def test_packing_round_trip(docs, none):
    found = packing.pack(docs, window=64, with_ids=True).collect()
    encode = lambda t: tokens.library().encode(t, add_special_tokens=False).ids + [0]
    same(Counter(r.doc_id for r in found if r.start == 0).items(), Counter(i for i, _ in ROWS_IDS).items())
    total = Counter()
    for r in found:
        total[r.doc_id] += r.length
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
    for i in {i for i, _ in ROWS_IDS if i != 9}:
        got = b"".join(r.ids for r in sorted((r for r in found if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == encode(dict(texts())[i])
    windows = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert windows.get(r.sequence_id, 0) == r.offset
        windows[r.sequence_id] = r.offset + r.length
    assert all(n == 64 or n & (n - 1) == 0 for n in windows.values())
    assert packing.pack(none).count() == 0


ROWS_IDS = texts()


def test_index_scores_are_bm25():
    shard = [np.array(x, np.uint32) for x in ([1, 2, 2, 3], [2, 3, 4], [5, 6], [3, 3, 5])]
    index = packing.Index(shard, query_terms=50)
    n, average = 4, np.mean([4, 3, 2, 3])
    df = Counter(t for d in shard for t in set(d.tolist()))
    weight = lambda t, d: math.log1p((n - df[t] + .5) / (df[t] + .5)) * (tf := d.tolist().count(t)) * 2.2 / (tf + 1.2 * (.25 + .75 * len(d) / average))
    for q, seed in enumerate(shard):
        np.testing.assert_allclose(index.scores(q), [sum(weight(t, d) for t in set(seed.tolist()) if df[t] > 1) for d in shard])


def test_common_terms_are_not_asked_by_seed(monkeypatch):
    """Terms of many documents cost a seed no postings; scores stay the sums over all terms, also over several blocks of seeds."""
    rng = np.random.default_rng(5)
    shard = [np.append(rng.integers(40, 4000, 30), np.arange(20)).astype(np.uint32) for _ in range(packing.BLOCK + 50)]
    index, whole = packing.Index(shard), [None] * len(shard)
    for seed in (0, 7, packing.BLOCK - 1, packing.BLOCK, len(shard) - 1):
        whole[seed] = index.of(index.terms[seed])
    asked = []
    monkeypatch.setattr(packing.Index, "of", lambda self, terms, of=packing.Index.of: (asked.extend(np.diff(self.first)[terms].tolist()), of(self, terms))[1])
    for seed in (0, 7, packing.BLOCK - 1, packing.BLOCK, len(shard) - 1):
        np.testing.assert_allclose(index.scores(seed), whole[seed], rtol=1e-12)
    assert max(asked) * packing.COMMON <= len(shard)


def test_pivots_are_asked_for_many_texts_at_once():
    rng = np.random.default_rng(6)
    docs = [np.append(rng.integers(30, 3000, 40), np.arange(15)).astype(np.uint32) for _ in range(70)]
    whole = packing.Whole(1000, 50.0, rng.integers(1, 900, 3001))
    line, table = packing.Pivots([np.unique(d, return_counts=True) for d in docs], whole).dense()
    texts = [*docs[:5], np.array([1, 2, 5000], np.uint32), np.array([9999], np.uint32), np.zeros(0, np.uint32)]
    many = packing.Asked(line, table)
    assert len(many.common) >= 15
    np.testing.assert_allclose(many.scores(texts), [packing.asked(d, line, table) for d in texts], rtol=1e-4)


def test_best_first_is_a_whole_sort():
    score = np.random.default_rng(1).integers(0, 9, 300).astype(float)
    assert [int(x) for x in packing.best_first(score)] == [int(x) for x in np.lexsort((np.arange(300), -score)) if score[x]]


def test_stored_ids_take_two_bytes(docs):
    stored = {r.doc_id: r.ids for r in packing.encoded(docs).collect()}
    for i in {i for i, _ in ROWS_IDS if i != 9}:
        assert np.frombuffer(stored[i], "<u2").tolist() == [*tokens.ids(dict(texts())[i] or "").tolist(), 0]


def test_pattern_splits_like_the_vocabulary(monkeypatch):
    import public_tokenizers

    rng = np.random.default_rng(3)
    alphabet = [" ", " ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "a", "Z", "\u00e9", "e\u0301", "\u4e2d", "9", "\u00b2", "'", "'s", "'LL", "'ve", "'re", ".", "_", "<|endoftext|>", "\U0001f600", "\u200d"]
    odd = ["", " ", "  ", "\n\n", "a ", "a  ", "a  b", "a \n b", *["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(3000)]]
    assert tokens.encoder()._pat_str != public_tokenizers.PATTERN
    fast = [tokens.ids(x).tolist() for x in odd]
    monkeypatch.setattr(tokens, "PATTERN", public_tokenizers.PATTERN)
    slow = tokens.encoder.__wrapped__()
    assert fast == [slow.encode(x, allowed_special="all") for x in odd]


def test_packing_finds_neighbours_of_other_partitions(spark):
    rng = np.random.default_rng(5)
    topics = [[f"t{k}{chr(97 + j)}{chr(97 + k)}" for j in range(20)] for k in range(8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8], 60))) for i in range(160)]  # no two neighbours in reading order share a topic
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = packing.pack(frame, window=1024, shard_docs=20, pivots=32).collect()
    assert sorted(r.doc_id for r in found if r.start == 0) == list(range(160))
    windows = {}
    for r in found:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id)
    met = [(a % 8) == (b % 8) for w in windows.values() for a in w for b in w if a < b]
    assert np.mean(met) > 0.6  # by chance one in eight


def test_packing_counts_and_terms_of_the_whole_table(spark, docs):
    shard = [np.array(x, np.uint32) for x in ([1, 2, 2, 3], [2, 3, 4], [5, 6], [3, 3, 5])]
    whole = packing.Whole(1000, 5.0, np.array([0, 900, 800, 3, 2, 700, 1]))
    weight = lambda t, d: math.log1p((1000 - whole.df[t] + .5) / (whole.df[t] + .5)) * (tf := d.tolist().count(t)) * 2.2 / (tf + 1.2 * (.25 + .75 * len(d) / 5))
    index = packing.Index(shard, whole=whole)
    np.testing.assert_allclose(index.scores(0), [sum(weight(t, d) for t in (2, 3)) for d in shard])
    long = [np.arange(40, dtype=np.uint32), np.arange(40, dtype=np.uint32)]
    assert len(packing.Index(long).terms[0]) == 40
    encode = lambda t: [*tokens.library().encode(t, add_special_tokens=False).ids, 0]
    counts = packing.counted(packing.encoded(docs))
    expected = Counter(x for _, t in texts() for x in set(encode(t)))
    assert counts.n == len(ROWS) and {t: n for t, n in enumerate(counts.df.tolist()) if n} == expected
    assert counts.mean == np.mean([len(encode(t)) for _, t in texts()])


@pytest.mark.parametrize("length", [50, 9])
def test_suffix_dedup(docs, none, length):
    order = sorted(((i if i is not None else math.inf), t.encode()) for i, t in texts())
    first = {}
    for i, raw in order:
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p:p + length], i)
    expected = []
    for i, text in texts():
        raw, gone = text.encode(), bytearray(len(text.encode()))
        for p in range(len(raw) - length + 1):
            if first[raw[p:p + length]] < (i if i is not None else math.inf):
                gone[p:p + length] = b"\1" * length
        expected.append((i, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    same([tuple(r) for r in lpf_dedup.removed(docs, length, chunk_bytes=900, bucket_bytes=400).collect()], expected)
    kept = lpf_dedup.removed(docs, length, keep=True)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert lpf_dedup.removed(none).count() == 0


def test_smaller_before_and_suffix_ranks():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.integers(0, 6, 40)
        assert lpf_dedup.smaller_before(v).tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(40)]
        data = rng.integers(97, 99, 200).astype(np.uint8)
        at = np.arange(150)
        ranks = lpf_dedup.suffix_ranks(data, at, 20)
        parts = [data[p:p + 20].tobytes() for p in at]
        place = {s: k for k, s in enumerate(sorted(set(parts)))}
        assert np.argsort(ranks, kind="stable").tolist() == np.argsort([place[s] for s in parts], kind="stable").tolist()


def test_toxicity(spark, docs, none):
    bad = [(i, f"you are an idiot and a pathetic m0ron number {i} in this long sentence of words", 1) for i in range(60)]
    good = [(i, f"a calm sentence about number {i} and the weather in this long list of words", 0) for i in range(60, 600)]
    spared = [(i, f"the idiot savant number {i} is only the name of a film here", 0) for i in range(600, 620)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in bad + good + spared], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in bad + good + spared], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, labels)
    assert model.exceptions.get("idiot savant") and toxicity.folded_words("M0rоn id1ot!") == ["moron", "idiot"]
    y = {i: v for i, _, v in bad + good + spared}
    scores = {r.doc_id: r["__score"] for r in toxicity.scored(frame, model).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == (v == 1) for i, v in y.items() if zlib.crc32(b"%d" % i) % 3 == 1)
    found = toxicity.scored(docs, model)
    assert found.columns == [*docs.columns, "__score"] and all(0 <= r["__score"] <= 1 for r in found.collect()) and toxicity.scored(none, model).count() == 0
    assert {r["__score"] for r in toxicity.scored(docs, toxicity.learn(frame.limit(0), labels)).collect()} == {0.0}


def test_host_rules(docs, none):
    def counts(text):
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
        return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)
    expected = []
    for i, text in texts():
        c = counts(text)
        expected.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    found = host_rules.host_rules(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found], expected)
    assert all(not r.kept for r in found if r.base_failed) and host_rules.host_rules(none).count() == 0


def test_ppm(docs, none):
    lower = [(i, t.encode().lower()) for i, t in texts()]
    learn = [zlib.crc32(b"null" if i is None else b"%d" % i) % 5 != 1 for i, _ in lower]
    counts = Counter(w for (_, t), use in zip(lower, learn, strict=True) if use for w in [*t.split(), b""])
    n, v = sum(counts.values()), len(counts)
    nodes = {}
    for (_, t), use in zip(lower, learn, strict=True):
        padded = bytes(8) + t
        for at in range(8, len(padded) + 1) if use else ():
            for k in range(4):
                nodes.setdefault((k, padded[at - k:at]), Counter())[padded[at] if at < len(padded) else 256] += 1

    def logp(padded, at):
        symbol, out, p = padded[at] if at < len(padded) else 256, set(), 0.0
        for k in range(3, -1, -1):
            node = nodes.get((k, padded[at - k:at]), Counter())
            left = {s: c for s, c in node.items() if s not in out}
            total, fresh = sum(left.values()), len(left)
            if symbol in left:
                return p + math.log10(left[symbol] / (total + fresh))
            if fresh:
                p += math.log10(fresh / (total + fresh))
            out |= set(node)
        return p - math.log10(257 - len(out))

    expected = {}
    for (i, t), use in zip(lower, learn, strict=True):
        words = [*t.split(), b""]
        row = (not use, len(words), sum(counts[w] > 0 for w in words), n)
        expected.setdefault(i, []).append((row, sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in words), sum(logp(bytes(8) + t, at) for at in range(8, len(t) + 9))))
    found = {}
    for r in ppm.score_documents(docs, order=3, chunk_bytes=3000, bucket_bytes=1000).collect():
        found.setdefault(r.doc_id, []).append((tuple(r)[1:5], r.base_score, r.score))
    for i, rows in expected.items():
        for a, b in zip(sorted(found[i]), sorted(rows), strict=True):
            assert a[0] == b[0]
            np.testing.assert_allclose(a[1:], b[1:], rtol=1e-5)
    assert ppm.score_documents(none).count() == 0


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash(spark, docs, none, hot):
    from xxhash import xxh64_intdigest
    near = [(100 + k, " ".join(f"w{j}" for j in range(300)) + f" t{k}", "en", "s", 0, "") for k in range(30)]
    frame = docs.union(spark.createDataFrame(near, docs.schema))

    def mark(text):
        words = text.encode().lower().split()
        hashes = [xxh64_intdigest(b" ".join(words[k:k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    rows = [(r.doc_id, mark(r.text or "")) for r in frame.collect()]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                    group[a] = min(group[a], group[b])
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    same([tuple(r) for r in simhash.near_duplicates(frame, hot=hot).collect()], [(i, f"{f:016x}", least[g]) for (i, f), g in zip(rows, group, strict=True)])
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_near_copies_stage(spark, hot):
    import corpus_pipeline
    rng = np.random.default_rng(7)
    rows = []
    for k in range(60):  # bases, each with copies that differ in 0 to 12 words of 300
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for j, changed in enumerate((0, 1, 3, 5, 8, 12)[:2 + k % 5]):
            copy = list(base)
            for at in rng.choice(300, changed, replace=False):
                copy[at] = f"new{k}x{j}x{at}"
            rows.append((10 * k + j, " ".join(copy)))
    rows += [(1000 + j, " ".join(f"c{x}" for x in range(200)) + f" end{j}") for j in range(12)]
    sets = [{tuple(t.split()[p:p + 5]) for p in range(len(t.split()) - 4)} for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = near_copies.distinct_documents(frame, hot=hot) if hot != 64 else corpus_pipeline.drop_near_copies(spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[g][0] for g in group})


def test_token_counts(docs, none):
    expected = [(i, len(t.encode()), len(tokens.library().encode(t, add_special_tokens=False).ids)) for i, t in texts()]
    same([tuple(r) for r in token_counts.token_counts(docs, 100, 8).collect()], expected)
    for text in ("a" * 900 + " b" * 90, "x  y\n\n z " * 90, "<|endoftext|> hi there<|endoftext|>" * 40, "ß ü日本 語" * 70):
        assert token_counts.spliced_count(text, 64, 8) == len(tokens.library().encode(text, add_special_tokens=False).ids)
    assert token_counts.token_counts(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(240)] + [(240, [1.0] * 6), (241, [1.0] * 6), (250, None), (300, [float("nan")] * 6), (350, [1.0, None] + [0.0] * 4), (400, [1.0, 2.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    valid = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in valid if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(valid[q], v, strict=True)), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    same([tuple(r) for r in topk.top_k(frame, block=50).collect()], expected)
    assert topk.top_k(frame.limit(0)).count() == 0
    x = rng.integers(-100, 100, (200, 64)) + np.arange(200)[:, None]
    assert topk.block_top(x[:4], np.arange(4), x, np.arange(200), 5)[3] < 4 * 199


def test_mixing(docs, none):
    found = mixing.mixed(docs, {"lang": {"en": 0.5, "de": 0.5}}, rounds=40).toPandas()
    assert len(found) == len(ROWS) and set(docs.columns) <= set(found.columns)
    share = (found["__tokens"] * found["__ratio"]).groupby(found["lang"].fillna("")).sum() / found["__tokens"].sum()
    assert share["es"] == 0 and share["fr"] == 0
    assert ((found["__weight"] * found["__probability"] - 0.5 * found["__ratio"]).abs() < 1e-4).all()
    assert mixing.mixed(none).count() == 0


def test_pipeline_keeps_what_it_should(spark, folder, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "mix", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).count() > 0
        docs = spark.read.parquet(str(tmp_path / name))


def test_pivots_give_the_scores_of_the_index():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 300, n).astype(np.uint32) for n in (5, 40, 900, 6000, 1)]
    whole = packing.Whole(1000, 50.0, rng.integers(1, 900, 301))
    index, pivots = packing.Index(docs, whole=whole), packing.Pivots([np.unique(d, return_counts=True) for d in docs], whole)
    line, table = pivots.dense()
    for k, d in enumerate(docs):
        got = packing.asked(np.append(d, 5000).astype(np.uint32), line, table)
        wanted = [sum(index.weight[(index.doc == j) & (np.repeat(index.term, np.diff(index.first)) == t)].sum() for t in set(d.tolist())) for j in range(5)]
        np.testing.assert_allclose(got, wanted, rtol=1e-4)
        np.testing.assert_allclose(packing.asked(d, *pivots.dense(3)), wanted[:3], rtol=1e-4)
