"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, replaces homoglyphs and digit or sign substitutions inside words by plain letters, and turns everything else
into single spaces. The lexicon is learned from labelled rows: folded words and word beginnings of 4 to 7 letters, each with the
log odds of its document frequencies in toxic and other rows. Exception phrases (a term with its neighbour word, found in
other rows only, or given by the caller) take back the weight of the term they contain. The sum of weights, also normalised by
length, goes through a logistic curve fitted on the same rows.

Learning reads at most `sample` labelled rows, those with the smallest hash of their id (a documented bound); scoring reads every
row and whole texts. Null texts are empty, with the score of a text without matches. A null id is scored like any other. Repeated
rows are scored alike. Without labelled rows of both kinds every score is 0. An empty table gives none."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import text_bytes

SAMPLE, LIMIT, MIN_SUPPORT, MIN_ODDS, THRESHOLD = 20_000, 2_000, 8, 3.0, 0.7
PREFIXES = range(4, 8)

_PAIRS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o"}
"""Fixed values: signs, Cyrillic and Greek letters that stand for Latin ones."""

_FOLD = str.maketrans(_PAIRS)
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"(?<=\w)[@$!|](?=\w)|(?<!\w)[@$](?=\w)")
_WIDE = str.maketrans({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys("​‌‍⁠­﻿"))


def folded_words(text: str) -> list[str]:
    """Words after folding; a token of digits only stays as it is."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_WIDE)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _ODD.sub(lambda m: _PAIRS[m[0]], text)
    words = _WORD.findall(text)
    if text.isascii() and not any(c in text for c in "013457"):
        return words
    return [w if w.isdigit() else w.translate(_FOLD) for w in words]


def terms_of(words: list[str]) -> set[str]:
    """Whole words ' w ' and word beginnings ' w' of a document."""
    kinds = set(words)
    return {f" {w} " for w in kinds} | {f" {w[:k]}" for w in kinds for k in PREFIXES if len(w) >= k}


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the labelled rows that may be learned from: crc32 of the id modulo 3 is not 1."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 3 <> 1")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id").select("text", "toxic")


def _counted(make):
    def run(batches):
        counts = {0: Counter(), 1: Counter()}
        rows = lambda: pa.RecordBatch.from_pydict({"term": pa.array([t for c in counts.values() for t in c], pa.string()), "toxic": pa.array([k for k, c in counts.items() for _ in c], pa.int32()), "n": pa.array([n for c in counts.values() for n in c.values()], pa.int64())})
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(make(folded_words(text)))
            if sum(map(len, counts.values())) > 200_000:
                yield rows()
                counts = {0: Counter(), 1: Counter()}
        yield rows()
    return run


def _sums(rows: DataFrame, make, support: int) -> DataFrame:
    counted = rows.mapInArrow(_counted(make), "term string, toxic int, n long")
    return counted.groupBy("term").agg(F.sum(F.expr("CASE WHEN toxic = 1 THEN n ELSE 0 END")).alias("bad"), F.sum(F.expr("CASE WHEN toxic = 0 THEN n ELSE 0 END")).alias("good")).filter(F.greatest("bad", "good") >= support)


class Model:
    """Lexicon, exceptions and the fitted curve; small, so it goes with the task."""

    def __init__(self, weights: dict[str, float], exceptions: dict[str, str] | None = None, curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions or {}, curve

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (0, len(term), weight, ""))
        for phrase, term in self.exceptions.items():
            machine.add_word(f" {phrase} ", (1, len(phrase) + 2, 0.0, term))
        machine.make_automaton()
        return machine

    def features(self, words: list[str], machine) -> tuple[float, float]:
        """Sum of weights, a word counting once by its strongest term, and that sum per thousand words, both as log(1 + x)."""
        if not len(machine):
            return 0.0, 0.0
        text = f" {' '.join(words)} "
        best, spared = {}, []
        for end, (kind, size, weight, term) in machine.iter(text):
            begin = end - size + 1
            if kind:
                spared.append((begin, end, term))
            elif weight > best.get(begin, 0.0):
                best[begin] = weight
        for begin, end, term in spared:
            at = text.find(term, begin, end + 1)
            best.pop(at, None)
        total = sum(best.values())
        return math.log1p(total), math.log1p(1000 * total / max(len(words), 1))

    def score(self, features: tuple[float, float]) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-min(60, max(-60, a + b * features[0] + c * features[1]))))


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression with both slopes kept at or above zero, by Newton steps; classes weigh as they occur."""
    x = np.column_stack([np.ones(len(x)), x])
    use, w = [0, 1, 2], np.zeros(3)
    while True:
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w[use], -60, 60)))
            penalty = ridge * np.array([0.01, 1, 1])[use]
            step = np.linalg.solve((x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + np.diag(penalty), x[:, use].T @ (p - y) + penalty * w[use])
            w[use] -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        if (w[1:] >= 0).all():
            return tuple(float(v) for v in w)
        use = [i for i in use if i == 0 or w[i] >= 0]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = LIMIT, min_support: int = MIN_SUPPORT, min_odds: float = MIN_ODDS, exceptions: dict[str, str] | None = None) -> Model:
    """Fit on at most `sample` rows; at most `limit` terms (bounded, so they may come to the driver)."""
    from crosstide.llm.common import Scratch

    scratch = Scratch(docs.sparkSession)
    rows = scratch.table("labelled", training_rows(docs, labels, sample))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model({})
    support = max(min(min_support, bad), math.ceil(0.01 * bad))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    found = _sums(rows, terms_of, support).filter(F.col("bad") >= support).withColumn("odds", odds).filter(F.col("odds") >= min_odds)
    found = found.orderBy(F.desc(F.col("odds") * F.log1p("bad")), "term").limit(limit).collect()
    weights = {r["term"]: float(r["odds"]) for r in found}
    heads = {t.strip() for t in weights}
    bare = lambda w: w in heads or any(w[:k] in heads for k in PREFIXES)

    def pairs(words):
        return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if bare(a) or bare(b)}

    learned = {}
    for r in _sums(rows, pairs, 3).filter("bad = 0 AND good >= 3").orderBy(F.desc("good"), "term").limit(limit).collect():
        a, b = r["term"].split(" ")
        learned[r["term"]] = f" {a if bare(a) else b}"
    model = Model(weights, learned | (exceptions or {}))

    def measured(batches):
        machine = model.automaton()
        for batch in batches:
            x = [model.features(folded_words(t), machine) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in x], pa.float64()), "b": pa.array([v[1] for v in x], pa.float64()), "toxic": batch.column("toxic").cast(pa.int32())})

    fit = rows.mapInArrow(measured, "a double, b double, toxic int").orderBy("a", "b", "toxic").toPandas()  # at most `sample` rows
    scratch.drop("labelled")
    return Model(weights, model.exceptions, _fitted(fit[["a", "b"]].to_numpy(), fit["toxic"].to_numpy()))


def scored(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """Every column of docs, and a score from 0 to 1 under a name that docs must not have."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name}; give the score another name")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        machine = model.automaton()
        for batch in batches:
            offsets, data = text_bytes(batch)
            values = [model.score(model.features(folded_words(str(data[a:b], "utf-8", "replace")), machine)) if model.weights else 0.0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, f"{fields}, `{name}` double")
