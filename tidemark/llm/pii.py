"""Personal data: exact patterns, then a skip-chain conditional random field over each document.

The base patterns decide first and are never taken back.  The field's nodes are the base
spans, whose labels are observed, and every other word that could be personal (it has an at
sign or two digits).  Words that hold more than an address or number could (rows of values,
URLs, text without spaces) also give their parts as nodes, and long words only those.  Where
a part and the word around it both become spans of one kind, the part alone does.  Neighbouring nodes form a chain; nodes far apart that repeat each
other, wholly or in their last seven digits or in an address's local part, are tied by skip
edges, each occurrence to the one before, so edges grow with the nodes.  A word that repeats
a base span is also tied to it itself, however far away; as the base span is observed, that
tie is evidence of the word's own, which outweighs the floor of its traits and its
neighbours in the chain.  Loopy belief propagation then spreads labels until they no longer
change: a word that no pattern matches becomes a span if its belief is ``least`` or more and
a path of skip edges leads to a base span of that kind, so documents without any base span
are left alone.

Weights are log ratios of counts from a bounded sample (:func:`fit`).  Only base spans are
labelled there, so the weight of agreement is counted over base spans that repeat each other, as
if one of the two were masked; unlabelled repeats tell nothing of it.

Defined results: null text counts as empty.  Offsets are code points, ends exclusive.
Repeated rows are answered alike; other columns never matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TEXTS, few_texts, map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
_AT_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_AT_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A digit run only starts a match at its first digit: from a later one the rest reads the same.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_IP_AGAIN = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
# What can stand in an address or number, and a number within it.
_PART = re.compile(r"[A-Za-z0-9._%+@()-]+")
_NUMBER = re.compile(r"[0-9][0-9().+-]*[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
#: A longer word can't be an address or number as a whole.
WORD = 64
_EDGE = "\"'`()[]{}<>.,;:!?%$#*&="


@dataclass(frozen=True, order=True)
class Span:
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the digits pass the check that card numbers pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of the address pattern, found from its at signs, in time linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _AT_LEFT.match(text[start - 1]):
            start -= 1
        found = _AT_RIGHT.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    at = 0
    found = _IP.search(text)
    while found:
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found[0].split(".")):
            yield found.span()
        at = found.end()
        # a match may end within a run of dots and digits: there the next may start at once
        found = _IP_AGAIN.match(text, at) or _IP.search(text, at)


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, by kind in the order of ``KINDS``, then by start."""
    out = [Span("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, find in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            out += [Span(kind, *s) for s in find(text)]
    return out


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    label: int | None
    word: str


def pieces(word: str) -> list[tuple[int, int]]:
    """Places in a word of what could be personal: the word, its parts and numbers within those, less what surrounds them."""
    found = [(0, len(word))] if len(word.strip(_EDGE)) <= WORD else []
    if not found or not _PART.fullmatch(word.strip(_EDGE)):
        found += [m.span() for m in _PART.finditer(word)]
    for start, end in list(found):
        part = word[start:end]
        if _LETTER.search(part) and _PART.fullmatch(part):
            found += [(start + m.start(), start + m.end()) for m in _NUMBER.finditer(part) if len(_DIGIT.findall(m[0])) >= 7]
    out = set()
    for start, end in found:
        part = word[start:end]
        core = part.strip(_EDGE)
        if core and ("@" in core or len(_DIGIT.findall(core)) >= 2):
            start += len(part) - len(part.lstrip(_EDGE))
            out.add((start, start + len(core)))
    return sorted(out, key=lambda p: (p[0], -p[1]))


def nodes(text: str, base: list[Span]) -> list[Node]:
    """Base spans (first by kind where they overlap) and the other candidate words, in text order."""
    taken: list[Node] = []
    for s in base:
        taken.append(Node(s.start, s.end, 1 + KINDS.index(s.kind), text[s.start : s.end]))
    taken.sort(key=lambda n: (n.start, n.label))
    kept: list[Node] = []
    for n in taken:
        if not kept or n.start >= kept[-1].end:
            kept.append(n)
    out, k = list(kept), 0
    for m in _WORD.finditer(text):
        word = m[0]
        if "@" not in word and len(_DIGIT.findall(word)) < 2:
            continue
        for start, end in pieces(word):
            core = word[start:end]
            start, end = m.start() + start, m.start() + end
            while k < len(kept) and kept[k].end <= start:
                k += 1
            if not (k < len(kept) and kept[k].start < end):
                out.append(Node(start, end, None, core))
    out.sort(key=lambda n: (n.start, -n.end))
    return out


def traits(node: Node, text: str) -> list[str]:
    """What a node looks like and which word stands before it."""
    digits = sum(c.isdigit() for c in node.word)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", node.word))[:12]
    before = text[max(0, node.start - 24) : node.start].split()
    return [f"digits {min(digits, 20)}", f"shape {shape}", f"at {'@' in node.word}", f"before {before[-1].lower()[:12] if before else ''}"]


def keys(node: Node) -> list[str]:
    """What ties a node to others that resemble it."""
    word = node.word.lower()
    digits = "".join(_DIGIT.findall(word))
    out = ["is " + word]
    if len(digits) >= 7:
        out.append("ends " + digits[-7:])
    local = word.partition("@")[0]
    if len(local) >= 4 and ("@" in word or len(digits) >= 2):
        out.append("local " + local)
    return out


def skips(ns: list[Node]) -> list[tuple[int, int]]:
    """Pairs of nodes that share a key, each node with the one before it."""
    last: dict[str, int] = {}
    out = set()
    for i, n in enumerate(ns):
        for k in keys(n):
            if k in last:
                out.add((last[k], i))
            last[k] = i
    return sorted(out)


def anchors(ns: list[Node]) -> list[dict[int, int]]:
    """Of each node that isn't a base span: labels of the base spans it shares a key with, and one such node for each."""
    seen: dict[str, dict[int, int]] = {}
    for i, n in enumerate(ns):
        if n.label:
            for k in keys(n):
                seen.setdefault(k, {}).setdefault(n.label, i)
    return [{} if n.label else {y: j for k in keys(n) for y, j in seen.get(k, {}).items()} for n in ns]


#: What a node's traits can say against a label at most, in log odds.
FLOOR = 4.0


@dataclass(frozen=True)
class Model:
    """Log weights: of traits by label, of labels in a chain, of agreement over a skip edge."""

    prior: np.ndarray
    traits: dict[str, np.ndarray]
    chain: np.ndarray
    skip: float

    def anchor(self) -> float:
        """The weight of a tie to a base span: more than traits and both neighbours in the chain can say against it."""
        spread = max(float(np.ptp(self.chain, axis=0).max()), float(np.ptp(self.chain, axis=1).max()))
        return self.skip + FLOOR + 2 * spread


def fit(docs: DataFrame, text: str = "text", max_docs: int = 20_000) -> Model:
    """Count labels that the base patterns give in about ``max_docs`` different texts chosen by hash.

    Counting runs on the executors.  That bound is the only one: all traits of the sample are learned.
    """
    rows = docs.select(F.col(text).alias("text"), F.lit(0).alias("all")).where(F.col("text").rlike("[0-9@]"))
    few, sizes = few_texts(rows, max_docs, "all")
    rows = few.repartition(max(1, min(max_docs, sum(sizes.values())) // TEXTS), "h1").select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[tuple[str, int]] = Counter()
        for x in batch.column(0):
            whole = x.as_py() or ""
            ns = nodes(whole, base_spans(whole))
            labels = [n.label or 0 for n in ns]
            for n, y in zip(ns, labels):
                seen["label", y] += 1
                seen.update(("trait " + t, y) for t in traits(n, whole))
            seen.update((f"chain {a}", b) for a, b in zip(labels, labels[1:]))
            # base spans that repeat each other: masked, either tells whether the tie would give its label back
            seen.update(("skip", int(labels[i] == labels[j])) for i, j in skips(ns) if labels[i] and labels[j])
        names, values = zip(*seen) if seen else ((), ())
        columns = [pa.array(names, pa.string()), pa.array(values, pa.int32()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["what", "label", "n"])

    counted = map_batches(rows, run, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n").alias("n"))
    table = counted.groupBy("what").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(LABELS))])
    counts = {r["what"]: np.array([r[f"n{k}"] for k in range(len(LABELS))], dtype=float) for r in table.collect()}
    none = np.zeros(len(LABELS))
    label = counts.get("label", none) + 1
    agree = counts.get("skip", none)
    chain = np.array([counts.get(f"chain {a}", none) + 1 for a in range(len(LABELS))])
    chain = chain / chain.sum(axis=1, keepdims=True) / (label / label.sum())
    return Model(
        np.log(label / label.sum()),
        {k[6:]: np.log((v + 0.1) / (label + 0.5)) for k, v in counts.items() if k.startswith("trait ")},
        np.clip(np.log(chain), -2, 2),
        float(np.clip(math.log((agree[1] + 9) / (agree[0] + 1)), 2, 6)),
    )


def beliefs(unary: np.ndarray, edges: list[tuple[int, int]], potentials: list[np.ndarray], sweeps: int | None = None) -> np.ndarray:
    """Marginals by loopy belief propagation, exact on trees.

    Messages are passed until they no longer change (or ``sweeps`` times where it is given).
    Only once they had time to cross the whole graph, steps become smaller, so that messages
    that go back and forth come to rest too.
    """
    n, k = unary.shape
    if not edges:
        out = np.exp(unary - unary.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)
    src = np.array([e[0] for e in edges] + [e[1] for e in edges])
    dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pots = np.stack([*potentials, *[p.T for p in potentials]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(src), k))
    step, turn = 0.5, 0
    while sweeps is None or turn < sweeps:
        turn += 1
        total = unary.copy()
        np.add.at(total, dst, messages)
        out = total[src] - messages[back]
        new = np.logaddexp.reduce(out[:, :, None] + pots, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = (1 - step) * messages + step * new
        if change * min(1.0, 2 * step) < 1e-4:
            break
        if turn > n and turn % 100 == 0:
            step /= 2
    total = unary.copy()
    np.add.at(total, dst, messages)
    total -= np.logaddexp.reduce(total, axis=1, keepdims=True)
    return np.exp(total)


def field(text: str, ns: list[Node], model: Model) -> tuple[np.ndarray, list[tuple[int, int]], list[np.ndarray], list[tuple[int, int]]]:
    """A document's field: unaries, edges with their potentials, and which of the edges are skip edges."""
    unary = np.zeros((len(ns), len(LABELS)))
    near, weight = anchors(ns), model.anchor()
    for i, n in enumerate(ns):
        if n.label:
            unary[i] = -1e6
            unary[i, n.label] = 0.0
        else:
            unary[i] = model.prior
            for t in traits(n, text):
                if t in model.traits:
                    unary[i] += model.traits[t]
            unary[i] = np.maximum(unary[i] - unary[i].max(), -FLOOR)
            unary[i, list(near[i])] += weight
    tied = skips(ns)
    chain = [(i, i + 1) for i in range(len(ns) - 1)]
    same = np.eye(len(LABELS)) * model.skip
    return unary, [*chain, *tied], [model.chain] * len(chain) + [same] * len(tied), tied


def more_spans(text: str, base: list[Span], model: Model, least: float = 0.5, marginals=beliefs) -> list[Span]:
    """Spans the field adds to the base ones; ``marginals`` of (unaries, edges, potentials) decide."""
    if not base:
        return []
    ns = nodes(text, base)
    if all(n.label for n in ns):
        return []
    unary, edges, potentials, tied = field(text, ns, model)
    found = marginals(unary, edges, potentials)
    top = list(range(len(ns)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for i, j in tied:
        top[root(i)] = root(j)
    reach: dict[int, set[int]] = {}
    for i, n in enumerate(ns):
        if n.label:
            reach.setdefault(root(i), set()).add(n.label)
    out = []
    for i, n in enumerate(ns):
        best = int(np.argmax(found[i]))
        if not n.label and best and found[i, best] >= least and best in reach.get(root(i), ()):
            out.append(Span(KINDS[best - 1], n.start, n.end))
    # in order of start, wider first, a span that holds another of its kind is followed by it
    after: dict[str, Span] = {}
    narrow = []
    for s in reversed(out):
        if s.kind not in after or after[s.kind].end > s.end or after[s.kind].start >= s.end:
            narrow.append(s)
            after[s.kind] = s
    return narrow[::-1]


def joined(spans: list[Span]) -> str:
    """kind:start:end, by kind in the order of ``KINDS``, then by start, joined by commas."""
    order = sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in order)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def find(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, least: float = 0.5, prefix: str = "", redacted: bool = True) -> DataFrame:
    """``keep`` (all columns by default) with counts by kind, the base spans' digest, all spans, and ``redacted``.

    Results are named after ``prefix``; columns of ``df`` that have their names give way.
    Without ``redacted``, texts only go to the workers, not back.
    """
    names = [prefix + n for n in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["redacted"] * redacted)]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)
    more = [] if text in keep else [F.col(text)]
    source = df.select(*[F.col(c) for c in keep], *more)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    at = source.columns.index(text)
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.column(at):
            value = x.as_py()
            whole = value or ""
            base = base_spans(whole)
            spans = base + more_spans(whole, base, shared.value, least)
            seen = Counter(s.kind for s in base)
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            clean = [redact(whole, spans) if spans else value] if redacted else []
            rows.append((*(seen[k] for k in KINDS), digest, joined(spans), *clean))
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * (2 + redacted)
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *names])

    types = ["long"] * len(KINDS) + ["string"] * (2 + redacted)
    return map_batches(source, run, ", ".join([*fields, *(f"`{n}` {t}" for n, t in zip(names, types))]))
