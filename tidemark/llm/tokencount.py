"""Token counts that follow edits without encoding a document again.

A document is cut at places where a pre-token surely ends (before white space, and between
letters, digits and marks) into segments of about ``SEGMENT`` characters.  A binary tree over the segments
holds sums of characters and of tokens.  An edit descends the tree to the segments it
touches, takes one more on the left as boundary context, and walks right until a pre-token
begins where an old segment begins; only that region is encoded again and only the sums
above it change.  Pre-tokens are matched from left to right with no memory, so from such a
place on all counts stay as they were: the total is exactly that of a full encoding.

Defined results: null text and null replacements count as empty; positions beyond the text
clip to its end, and an end before the start counts as the start; edits of a document apply
in order of ``seq``, each to the text the one before left, ties in order of their values;
edits of unknown documents are ignored.  A text, old or new, in which a special token's
string occurs is encoded anew, as such strings cut pre-tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import SAFE, ByteBpe, load, safe_between
from tidemark.llm.common import map_batches

SEGMENT = 256
#: Unedited characters that must precede an edit in the region encoded again: the pattern looks ahead less.
_CONTEXT = 4


@dataclass(frozen=True)
class Edit:
    """Replace characters ``start`` to ``end`` by ``text``."""

    start: int
    end: int
    text: str


def cut(text: str, size: int = SEGMENT) -> list[str]:
    """The text in segments, each but the last ending where a pre-token surely does."""
    out, at = [], 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    if at < len(text):
        out.append(text[at:])
    return out


class TokenTree:
    """Segments of one document under a tree of character and token sums."""

    def __init__(self, text: str, bpe: ByteBpe):
        self.bpe = bpe
        self.encoded = 0
        self._build(self._cut(text))

    def _cut(self, text: str) -> list[str]:
        return [text] if self.bpe.whole(text) else cut(text)

    def _count(self, segment: str) -> int:
        self.encoded += len(segment)
        return self.bpe.count(segment)

    def _build(self, segments: list[str], counts: list[int] | None = None) -> None:
        self.segments = segments
        self.width = 1 << max(0, len(segments) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        for i, s in enumerate(segments):
            self.sums[self.width + i] = len(s), self._count(s) if counts is None else counts[i]
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def text(self) -> str:
        return "".join(self.segments)

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, at: int) -> tuple[int, int]:
        """(segment that holds character ``at``, that segment's first character); the last one at the end."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if at - before < left or self.sums[2 * node + 1, 0] == 0:
                node = 2 * node
            else:
                before += left
                node = 2 * node + 1
        return min(node - self.width, max(0, len(self.segments) - 1)), before

    def _set(self, i: int, segment: str) -> None:
        self.segments[i] = segment
        node = self.width + i
        change = np.array([len(segment), self._count(segment)]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def apply(self, edit: Edit) -> None:
        """Change the text and bring all sums up to date."""
        start = min(max(0, edit.start), self.chars)
        end = min(max(start, edit.end), self.chars)
        if not self.segments:
            self._build(self._cut(edit.text))
            return
        first, begin = self._find(start)
        while first and start - begin < _CONTEXT:
            first -= 1
            begin -= len(self.segments[first])
        last, at = self._find(end)
        at += len(self.segments[last])
        region = "".join(self.segments[first : last + 1])
        region = region[: start - begin] + edit.text + region[end - begin :]
        after = last + 1
        while after < len(self.segments) and not safe_between(region, self.segments[after]):
            region += self.segments[after]
            after += 1
        if any(k in self._near(first, region, after) for k in self.bpe.special):
            whole = "".join(self.segments[:first]) + region + "".join(self.segments[after:])
            self.segments, self.sums = [whole], np.zeros((2, 2), dtype=np.int64)
            self.width = 1
            self.sums[1] = len(whole), self._count(whole)
            return
        parts = cut(region)
        if len(parts) <= after - first:
            for i in range(first, after):
                self._set(i, parts[i - first] if i - first < len(parts) else "")
            return
        counts = self.sums[self.width : self.width + len(self.segments), 1].tolist()
        self._build(
            self.segments[:first] + parts + self.segments[after:],
            counts[:first] + [self._count(p) for p in parts] + counts[after:],
        )

    def _near(self, first: int, region: str, after: int) -> str:
        """The region with as much of its surroundings as a special token could reach."""
        most = max(map(len, self.bpe.special), default=0)
        left, right = "", ""
        while first and len(left) < most:
            first -= 1
            left = self.segments[first] + left
        while after < len(self.segments) and len(right) < most:
            right += self.segments[after]
            after += 1
        return left[-most:] + region + right[:most] if most else region


def count_edits(
    docs: DataFrame, edits: DataFrame, path: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_tokens, n_edits, n_tokens_after, n_chars_after, n_chars_encoded) of each document.

    ``edits`` has (key, seq, start, end, replacement).  Its rows are gathered by document
    before they meet the texts, so each document crosses the network at most once.
    """
    by_doc = edits.select(
        F.col(key), F.struct("seq", "start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")).alias("e")
    ).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("edits"))
    return count_listed(docs.select(key, text).join(by_doc, key, "left"), path, text, key)


def count_listed(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", edits: str = "edits") -> DataFrame:
    """As :func:`count_edits`, for documents that carry their list of edits in a column."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        rows = []
        for x, listed in zip(batch.column(1), batch.column(2)):
            tree = TokenTree(x.as_py() or "", bpe)
            before, tree.encoded = tree.tokens, 0
            todo = listed.as_py() or []
            for e in todo:
                tree.apply(Edit(e["start"], e["end"], e["replacement"] or ""))
            rows.append((before, len(todo), tree.tokens, tree.chars, tree.encoded))
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = ", ".join([f"`{key}` {kind}", *(f"{n} long" for n in names[1:])])
    return map_batches(docs.select(key, text, edits), run, schema)


def drawn_edits(text: str = "text", key: str = "doc_id"):
    """A column of four edits drawn from a document's id: a replacement, an insertion, a deletion and an append."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    at = [F.pmod(F.xxhash64(F.col(key), F.lit(k)), n + 1).cast("long") for k in range(3)]
    kinds = [(at[0], at[0] + 12, " revised wording"), (at[1], at[1], "in-serted "), (at[2], at[2] + 40, ""), (n.cast("long"), n.cast("long"), " (updated)")]
    return F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("seq"), a.alias("start"), b.alias("end"), F.lit(t).alias("replacement"))
            for i, (a, b, t) in enumerate(kinds)
        ]
    )
