"""Alignment of two tokenizers against a plain version that works on single bytes and occurrences."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from crosstide.llm import token_alignment

TEXTS = [None, "", " ", "Hello world", "Hello world", "hello, world! 12345", "ünïcödé ß 日本語 テキスト 🤦🏼‍♂️", "x▁y", "<|endoftext|> and <s> </s> <unk> <0x41>", "tab\tand\n\nlines\r\n  four    blanks     ", "aaaaaaaaaaaaaaaaaaaaaaaaaaa bbb", "the cat the hat the cat " * 30,
         "\u0000 nul", "a" * 3000, "🙂" * 500, " leading", "trailing  ", "word " * 20_000, "internationalization of tokenizers " * 5, "ﬁ ligature ½ Ⅷ", "    　x"]
ROWS = [(None if i == 4 else (3 if i == 9 else i), t) for i, t in enumerate(TEXTS)]


def byte_decoder():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_groups():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b, back = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_decoder()
    out = []
    for _, text in ROWS:
        if not text:
            out.append([])
            continue
        left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if not b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode():
            out.append([])
            continue
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (left, right)]
        both, groups = sorted(ends[0] & ends[1]), []
        for lo, hi in zip([0, *both[:-1]], both, strict=True):
            group = []
            for side in (left, right):
                at, mine = 0, []
                for i, x in side if hi - lo < 10**9 else ():
                    if lo <= at < hi:
                        mine.append(i)
                    at += len(x)
                    if at >= hi:
                        break
                group.append(mine)
            groups.append(group)
        out.append(groups)
    return out


@pytest.fixture(scope="module")
def expected():
    short = [k for k, (_, t) in enumerate(ROWS) if len(t or "") < 5000]
    groups, counts = plain_groups_of(short), Counter()
    for g in groups.values():
        counts.update({(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for k in short:
        g = groups[k]
        linked = [(x, y) for a, b in g for x in a for y in b]
        said = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
        rows.append((ROWS[k][0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(linked), sum(counts[p] == best[p[0]] for p in linked), sum(counts[p] for p in linked), said))
    return short, rows


def plain_groups_of(short):
    global ROWS
    kept, ROWS = ROWS, [ROWS[k] for k in short]
    try:
        return dict(zip(short, plain_groups(), strict=True))
    finally:
        ROWS = kept


@pytest.mark.parametrize("hot_share", [100_000, 1, 40])
def test_every_column_against_the_plain_version(spark, expected, hot_share):
    short, rows = expected
    frame = spark.createDataFrame([(*ROWS[k], 5, "x") for k in short], "doc_id long, text string, row int, pairs string").repartition(3)
    found = [tuple(r) for r in token_alignment.align(frame, hot_share=hot_share).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, rows))


def test_very_long_texts_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "word " * 20_000), (2, "🙂" * 20_000), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in token_alignment.align(frame).collect()}
    assert found[1].n_groups > 19_000 and found[1].n_links >= found[1].n_groups and found[2].n_groups == 20_000 and found[3].groups_sha256 == ""
    assert token_alignment.align(frame.limit(0)).count() == 0


def test_wide_groups_are_linked_by_distinct_ids():
    class Small:
        size_b, same = 10, np.array([-1, 5, -1, -1])

    a, b = np.array([1, 2] * 100 + [1]), np.array([5, 6, 7] * 40 + [5])
    got = token_alignment.links(a, b, np.array([200, 1]), np.array([120, 1]), Small)
    assert [x.tolist() for x in got] == [[1], [100 * 40 + 1], [16, 17, 25, 26, 27], [4000] * 5]


def test_the_identity_array_holds_equal_bytes():
    v = token_alignment.vocabularies()
    known = np.flatnonzero(v.same >= 0)
    assert len(known) > 5000 and all(v.a_bytes[i] == v.b_bytes[v.same[i]] for i in known.tolist())
