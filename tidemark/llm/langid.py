"""Language identification: known words first, then ever shorter character n-grams.

A word that the model knows scores by its log frequency in each language.  An unseen word
backs off: its n-grams of the longest order of which the model knows any vote with their
mean log frequency; if it knows none, the next shorter order is tried, down to one
character.  A text's scores are summed over its words; the best language wins.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every
text if the model has no language at all.  Ties go to the alphabetically first language.
A text whose words tell nothing is given the language most common in training.  Equal texts
get equal answers; other columns of the input are carried along untouched.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import TEXTS, few_texts, map_batches, texts

UNDETERMINED = "und"
ORDERS = (4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of a text that are split into words at a time.
_SPAN = 1 << 20


@dataclass(frozen=True)
class Model:
    """Log frequencies: ``words[w]`` and ``grams[n][g]`` are rows of ``table``, a column a language."""

    langs: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray
    words: dict[str, int]
    grams: dict[int, dict[str, int]]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs_per_lang: int = 2000) -> Model:
    """Learn from at most ``max_docs_per_lang`` different texts of each language.

    The texts are those with the smallest hashes, so the same whatever the partitions; copies
    count once, so neither can a text that is repeated often fill the sample nor be left out
    with all its copies.  That bound is the only one: the model holds all words and n-grams of
    the sample, split just as prediction splits.  Counting runs in Spark; priors are counted over
    all rows.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # more than are wanted, as the number drawn is an estimate; the rest leave by rank
    few, sizes = few_texts(rows, 1.5 * max_docs_per_lang + 10 * math.sqrt(max_docs_per_lang), "lang")
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros(0), np.zeros((0, 0)), {}, {})
    prior = np.log(np.array([sizes[k] for k in langs], dtype=float) / sum(sizes.values()))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h1", "h2"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= max_docs_per_lang)
    # ranked in a task a language, counted in more
    sample = sample.repartition(max(1, sum(min(n, max_docs_per_lang) for n in sizes.values()) // TEXTS), "h1")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[tuple[str, str]] = Counter()
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in _cuts(x):
                seen.update((k, w) for w in _WORD.findall(piece.lower()))
        k, w = zip(*seen) if seen else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(w, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "w", "n"])

    def backed(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[tuple[int, str, str]] = Counter()
        for k, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            seen[0, w, k] += n
            for order in ORDERS:
                for g in grams(w, order):
                    seen[order, g, k] += n
        order, g, k = zip(*seen) if seen else ((), (), ())
        columns = [pa.array(order, pa.int32()), pa.array(g, pa.string()), pa.array(k, pa.string()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["order", "g", "lang", "n"])

    by_lang = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(langs)]
    # words meet first, so that each is taken apart once
    words = map_batches(sample.select("lang", "text"), split, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    counted = map_batches(words, backed, "order int, g string, lang string, n long")
    table = counted.groupBy("order", "g").agg(*by_lang).toArrow()
    order, units = table.column("order").to_numpy(), table.column("g").to_pylist()
    counts = np.stack([table.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(float) if len(order) else np.zeros((0, len(langs)))
    known: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
    for n in known:
        at = np.flatnonzero(order == n)
        if len(at):
            counts[at] = np.log((counts[at] + 0.5) / (counts[at].sum(axis=0) + 0.5 * len(at)))
        known[n] = {units[i]: int(i) for i in at}
    return Model(langs, prior, counts.astype(np.float32), known.pop(0), known)


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word, its ends marked by spaces; single characters without the marks."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Names:
    """A dictionary of strings to rows of the table in twelve bytes an entry: sorted 64-bit hashes."""

    def __init__(self, known: dict[str, int]):
        order = sorted((xxhash.xxh3_64_intdigest(w), k) for w, k in known.items())
        self.hashes, self.places = array("Q", [h for h, _ in order]), array("I", [k for _, k in order])

    def get(self, word: str) -> int | None:
        h = xxhash.xxh3_64_intdigest(word)
        i = bisect_left(self.hashes, h)
        return self.places[i] if i < len(self.hashes) and self.hashes[i] == h else None


def packed(model: Model) -> Model:
    """The model as executors hold it: Python workers live on, so a large dictionary would stay in their memory."""
    return replace(model, words=Names(model.words), grams={n: Names(g) for n, g in model.grams.items()})


class Scorer:
    """Scores texts with a model; remembers words up to a bound."""

    def __init__(self, model: Model, memory: int = 50_000):
        self.model = model
        self.memory = memory
        self.seen: dict[str, list[int]] = {}
        self.known = [model.grams.get(n, {}) for n in ORDERS]

    def _unseen(self, word: str) -> list[int]:
        for n, known in zip(ORDERS, self.known):
            if hit := [k for g in grams(word, n) if (k := known.get(g)) is not None]:
                return hit
        return []

    def rows(self, word: str) -> list[int]:
        """The model's rows whose mean scores a word; none if the model can't tell."""
        hit = self.seen.get(word)
        if hit is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            k = self.model.words.get(word)
            hit = self.seen[word] = self._unseen(word) if k is None else [k]
        return hit

    def text(self, text: str) -> tuple[str, float]:
        """(language, its share of the posterior)."""
        m = self.model
        counts: Counter[str] = Counter()
        for piece in _cuts(text):
            counts.update(_WORD.findall(piece.lower()))
        if not m.langs or not any(w.isalpha() or any(map(str.isalpha, w)) for w in counts):
            return UNDETERMINED, 0.0
        used: list[int] = []
        weight: list[float] = []
        for w, n in counts.items():
            hit = self.rows(w)
            used += hit
            if len(hit) == 1:
                weight.append(n)
            elif hit:
                weight += [n / len(hit)] * len(hit)
        total = m.prior
        if used:
            total = total + np.array(weight) @ m.table[used]
        best = int(np.argmax(total))
        score = 1.0 / float(np.exp(np.maximum(total - total[best], -700)).sum())
        return m.langs[best], min(1.0, max(0.0, score)) if math.isfinite(score) else 0.0


def _cuts(text: str):
    """The text in pieces of bounded length that break no word."""
    at = 0
    while len(text) - at > _SPAN:
        end = at + _SPAN
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``df``'s columns ``keep`` (all by default) with ``lang_pred`` and ``score``, named after ``prefix``.

    The model is bounded (see :func:`fit`), so it is broadcast whatever the size of ``df``.
    Columns of ``df`` that have the results' names give way to them.
    """
    names = [prefix + "lang_pred", prefix + "score"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(packed(model))
    more = [] if text in keep else [F.col(text)]
    source = df.select(*[F.col(c) for c in keep], *more)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    at = source.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _scorer(shared)
        out = [scorer.text(x) for x in texts(batch.column(at))]
        more = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *more], names=[*keep, *names])

    return map_batches(source, run, ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double"]))


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """One scorer per broadcast model and process; only the latest is kept."""
    key = id(shared.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def rejected(lang_pred: str = "lang_pred", score: str = "score", least: float = 0.5):
    """Documents to drop: no language could be told, or none has even ``least`` of the posterior."""
    return (F.col(lang_pred) == UNDETERMINED) | (F.col(score) < least)
