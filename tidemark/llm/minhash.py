"""Near duplicates by BagMinHash: weighted Jaccard similarity of multisets of word shingles.

Signatures.  A shingle that occurs w times owns Poisson processes over the weight ranges
[0,1), [1,2), [2,4), [4,8), ... up to w, each with a stream drawn from the shingle and the
range.  A range of width r yields points at rate r, each at a place within the range and for
one component of the signature; points beyond w are thinned out.  A component keeps its
earliest point.  Two texts agree in a component with probability exactly their weighted
Jaccard similarity.  Points come in order of time and stop once no component can still
improve, all shingles of a batch advancing together in numpy.

Candidates.  Each different text is signed once.  Components are banded.  Within a bucket all members are compared with one
leader, not with each other.  Linked texts form classes; only where a bucket still holds
different classes are their members compared across classes: in small buckets by a join
(weighted Jaccard distance is a metric, so pairs whose distances to the leader differ by
more than the threshold allows are left out without loss), in large ones inside tasks that return
links alone: first in parts, each text once, which leaves few classes, then texts outside of a
bucket's largest class against all others of it.  Every link is verified on whole texts.

Defined results: words are runs of letters and digits in lower case; a text of one to four
words is one shingle; texts without words are only equal to texts that are the same string,
null counting as empty.  Texts that are the same string are always one class.  The class id
is its smallest key.  Rows that share a key are kept and count as one document: their texts,
however different, are in one class, and so is whatever is near any of them.  Rows with a null
key are documents of their own; a class of which all keys are null has a null id.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key128, map_batches, materialize
from tidemark.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
_WORD = re.compile(r"\w+")
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_MULT = np.array([0xD6E8FEB86659FD93, 0xA5CB9243D3AA1B5F, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25], dtype=_U)
#: Shingles whose points are drawn together, and words hashed before the memory of hashes is emptied.
_GROUP, _MEMORY = 200_000, 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _step(n: int) -> np.uint64:
    """The ``n``-th multiple of an odd constant, modulo 2**64."""
    return _U(int(_GOLD) * n & (1 << 64) - 1)


_HASHES: dict[str, int] = {}


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of a text's word shingles, with repeats; none if it has no word."""
    words = _WORD.findall(text.lower())
    if len(_HASHES) > _MEMORY:
        _HASHES.clear()
    known = _HASHES
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    a = np.array(ids, dtype=_U)
    if len(a) == 0:
        return a
    n = max(1, len(a) - SHINGLE + 1)
    out = np.full(n, min(len(a), SHINGLE), dtype=_U)
    for j in range(min(len(a), SHINGLE)):
        out += a[j : j + n] * _MULT[j]
    return mix(out)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each as sorted values and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def signatures(bags: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (bags, m) of multisets of hashes; rows of empty bags are infinite."""
    best = np.full((len(bags), m), np.inf)
    flat = best.ravel()
    who, value, weight = [], [], []
    for i, bag in enumerate(bags):
        v, n = np.unique(bag, return_counts=True)
        who.append(np.full(len(v), i))
        value.append(v)
        weight.append(n)
    if not who or not sum(map(len, who)):
        return best
    who, value, weight = np.concatenate(who), np.concatenate(value), np.concatenate(weight).astype(float)
    parts, level, low, rate = [], 0, 0.0, 1.0
    while True:
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        parts.append((who[at], mix(value[at] + _step(level + 1)), weight[at], np.full(len(at), low), np.full(len(at), rate)))
        low, rate, level = low + rate, low + rate, level + 1
    who, seed, weight, low, rate = (np.concatenate(c) for c in zip(*parts))
    time, turn = np.zeros(len(who)), 0
    scale = 1.0 / (1 << 53)
    while len(who):
        turn += 1
        x = mix(seed + _step(2 * turn))
        y = mix(seed + _step(2 * turn + 1))
        time = time - np.log(((x >> _U(11)).astype(float) + 1.0) * scale) / (m * rate)
        inside = low + rate * ((y >> _U(32)).astype(float) / (1 << 32)) < weight
        place = who * m + ((y & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64)
        np.minimum.at(flat, place[inside], time[inside])
        go = time < best.max(axis=1)[who]
        if not go.all():
            who, seed, weight, low, rate, time = (c[go] for c in (who, seed, weight, low, rate, time))
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(sig[:, : bands * rows]).view(_U).reshape(len(sig), bands, rows) >> _U(12)
    out = np.tile(np.arange(1, bands + 1, dtype=_U) * _GOLD, (len(sig), 1))
    for r in range(rows):
        out = mix(out ^ bits[:, :, r]) + _GOLD
    return out


def distinct(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(node, t1, t2, least, z): each different text once, compressed, with a number of its own and its smallest key.

    Copies meet by aggregation that begins before the exchange, so a text that fills a third of
    all rows reaches no task more than once per partition.
    """
    t1, t2 = key128(F.col(text))
    source = docs.select(F.col(key).alias("k"), t1.alias("t1"), t2.alias("t2"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["k"].dataType.simpleString()

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=3)
        column = [z.compress(x.as_py().encode("utf-8")) for x in batch.column(3)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(column, pa.binary())], names=["k", "t1", "t2", "z"])

    packed = map_batches(source, squeeze, f"k {kind}, t1 long, t2 long, z binary")
    once = packed.groupBy("t1", "t2").agg(F.first("z").alias("z"), F.min("k").alias("least"))
    return materialize(once.select(F.monotonically_increasing_id().alias("node"), "t1", "t2", "least", "z"))


def banded(bodies: DataFrame, bands: int, rows: int) -> DataFrame:
    """(node, keys, size): band keys of each text, null if it has no word, and how many shingles it has."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        plain = zstandard.ZstdDecompressor()
        out: list = []
        sizes: list[int] = []
        group: list[np.ndarray] = []
        total = 0

        def close() -> None:
            if group:
                keys = band_keys(signatures(group, bands * rows), bands, rows).view(np.int64)
                out.extend(k if len(b) else None for k, b in zip(keys, group))
                group.clear()

        for z in batch.column(1):
            group.append(shingles(plain.decompress(z.as_py()).decode("utf-8")))
            sizes.append(len(group[-1]))
            total += sizes[-1]
            if total > _GROUP:
                close()
                total = 0
        close()
        columns = [batch.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["node", "keys", "size"])

    return map_batches(bodies.select("node", "z"), run, "node long, keys array<long>, size long")


def verify(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """(u, v, similarity) of pairs (u, v), from ``packed`` texts (node, z)."""
    a = packed.select(F.col("node").alias("u"), F.col("z").alias("zu"))
    b = packed.select(F.col("node").alias("v"), F.col("z").alias("zv"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        plain = zstandard.ZstdDecompressor()

        @functools.lru_cache(maxsize=64)
        def bag(z: bytes):
            return np.unique(shingles(plain.decompress(z).decode("utf-8")), return_counts=True)

        out = [similarity(bag(zu.as_py()), bag(zv.as_py())) for zu, zv in zip(batch.column(2), batch.column(3))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.float64())], names=["u", "v", "similarity"])

    # many pairs share a v, few a u: the skewed join comes first, where it is cheap to split
    met = pairs.join(b, "v").join(a, "u").select("u", "v", "zu", "zv")
    return map_batches(met, run, "u long, v long, similarity double")


def block_links(bags: list[np.ndarray], may: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i, j), i < j, that ``may`` allows and whose similarity reaches the threshold.

    Repeats of a shingle count as shingles of their own, which makes multisets sets; all
    intersections come from products of incidence matrices, a stretch of the vocabulary at
    a time.
    """
    sizes = np.array([len(b) for b in bags], dtype=np.float32)
    owner, value = [], []
    for i, bag in enumerate(bags):
        v, n = np.unique(bag, return_counts=True)
        again = np.concatenate([np.arange(k) for k in n]) if len(n) else n
        value.append(mix(np.repeat(v, n) + again.astype(_U) * _GOLD))
        owner.append(np.full(len(bag), i))
    owner, value = np.concatenate(owner), np.concatenate(value)
    _, code, seen = np.unique(value, return_inverse=True, return_counts=True)
    useful = seen[code] > 1
    owner, code = owner[useful], np.unique(code[useful], return_inverse=True)[1]
    both = np.zeros((len(bags), len(bags)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, z = np.searchsorted(code, [low, low + 4096])
        part = np.zeros((len(bags), 4096), dtype=np.float32)
        part[owner[a:z], code[a:z] - low] = 1
        both += part @ part.T
    total = sizes[:, None] + sizes[None, :] - both
    return np.argwhere(np.triu(may & (both >= threshold * total - 1e-4), 1))


#: Shingles that one side of a comparison may hold in a task's memory, unless a single text has more.
_SHINGLES = 1_000_000


def homes(large: DataFrame, signed: DataFrame, block: int) -> DataFrame:
    """(node, size, home, part): each text of ``large`` once, in a part of about ``block`` texts and a bounded number of shingles.

    A text may be in as many large buckets as there are bands, nearly all with the same others; here it
    is in one place, with those that have the same smallest leader.
    """
    home = materialize(large.groupBy("node").agg(F.min("leader").alias("home")).join(signed.select("node", "size"), "node"))
    count = home.groupBy("home").agg(_parts(block).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return materialize(home.join(count, "home").select("node", "size", "home", part.alias("part")))


def _parts(block: int):
    """In how many parts a group of texts is compared."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / _SHINGLES), F.lit(1)).cast("int")


def _links(t: pa.Table, threshold: float) -> pa.Table:
    """(u, v) of the links among the texts of a task that differ in label, share a bucket and, if that is told, in ``here``."""
    ids, label = t.column("node").to_numpy(), t.column("label").to_numpy()
    names = np.array(t.column("keys").to_pylist(), dtype=np.int64)
    may = np.zeros((len(ids), len(ids)), dtype=bool)
    for k in range(names.shape[1]):
        may |= names[:, k][:, None] == names[:, k][None, :]
    may &= label[:, None] != label[None, :]
    if "here" in t.column_names:
        here = t.column("here").to_numpy()
        may &= here[:, None] != here[None, :]
    found = np.zeros((0, 2), dtype=int)
    if may.any():
        plain = zstandard.ZstdDecompressor()
        found = block_links([shingles(plain.decompress(z).decode("utf-8")) for z in t.column("z").to_pylist()], may, threshold)
    return pa.table([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["u", "v"])


def within_parts(large: DataFrame, places: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of links across classes within parts of :func:`homes`; a text is shipped once."""
    rows = places.select("node", "home", "part").join(large.select("node", "label").distinct(), "node")
    several = rows.groupBy("home", "part").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    dealt = rows.join(several.select("home", "part"), ["home", "part"], "left_semi").join(texts, "node")
    return dealt.groupBy("home", "part").applyInArrow(lambda _, t: _links(t, threshold), "u long, v long")


def in_blocks(large: DataFrame, places: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """(u, v) of the links across classes within large buckets ``large`` (band, h, node, label).

    Texts outside of a bucket's largest class visit the parts (:func:`homes`) in which other members
    of the bucket are; of two texts in different classes at least one does.  A part takes its visitors
    in groups of about ``block`` texts, and returns links alone.  Buckets that hold the same texts lead
    to the same visits, which happen once.  Only texts that share a bucket count.
    """
    labels = large.groupBy("band", "h", "label").agg(F.count(F.lit(1)).alias("m"))
    most = materialize(labels.groupBy("band", "h").agg(F.max_by("label", F.struct("m", "label")).alias("most")))
    calls = materialize(large.join(most, ["band", "h"]).where("label <> most").select("band", "h", "node", "label"))
    lie = materialize(large.select("band", "h", "node").join(places.select("node", "home", "part"), "node").select("band", "h", "home", "part").distinct())
    visits = calls.join(lie, ["band", "h"]).select("node", "label", "home", "part").distinct()
    visits = materialize(visits.join(places.select("node", "size"), "node"))
    groups = materialize(visits.groupBy("home", "part").agg(_parts(block).alias("groups")))
    group = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("groups")).cast("int")
    guests = visits.join(groups, ["home", "part"]).select("home", "part", group.alias("group"), "node", "label", F.lit(False).alias("here"))
    there = large.select("node", "label").distinct().join(places.select("node", "home", "part"), "node").join(groups, ["home", "part"])
    there = there.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = materialize(guests.unionByName(there.select("home", "part", "group", "node", "label", F.lit(True).alias("here"))))
    return dealt.join(texts, "node").groupBy("home", "part", "group").applyInArrow(lambda _, t: _links(t, threshold), "u long, v long")


def still_open(placed: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, but for the leaders, with ``n``, their bucket's members."""
    mixed = materialize(
        placed.groupBy("band", "h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a <> b").select("band", "h", "n")
    )
    return materialize(placed.join(mixed, ["band", "h"]).where("node <> leader"))


def same_key(rows: DataFrame) -> DataFrame:
    """(u, v) that tie the texts of rows that share a key, from (k, node); null keys tie nothing."""
    several = materialize(
        rows.where("k IS NOT NULL").groupBy("k").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").drop("last")
    )
    return rows.join(several, "k").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def classes(
    docs: DataFrame, text: str = "text", key: str = "doc_id",
    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    block: int = 512,
) -> DataFrame:
    """(key, class_id, is_first) of every row.

    Nodes are different texts, whatever their keys; keys join at the end.  Members of buckets of
    up to ``block`` / 8 texts meet by a join, at most so many a text; those of larger ones in
    parts of about ``block`` texts.
    """
    bodies = distinct(docs, text, key)
    signed = materialize(banded(bodies, bands, rows))
    cells = signed.where("keys IS NOT NULL").select("node", F.posexplode("keys").alias("band", "h"))
    # written before it is joined, so that both sides are plain exchanges, which Spark splits
    # where a bucket is hot
    buckets = materialize(cells.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n"))
    members = materialize(cells.join(buckets, ["band", "h"]))
    packed = materialize(bodies.select("node", "z").join(members.select("node").distinct(), "node", "left_semi"))

    first = members.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    tested = materialize(verify(first, packed))
    linked = tested.where(F.col("similarity") >= threshold).select("u", "v")
    t1, t2 = key128(F.col(text))
    placed_rows = docs.select(F.col(key).alias("k"), t1.alias("t1"), t2.alias("t2")).join(bodies.select("t1", "t2", "node"), ["t1", "t2"]).select("k", "node")
    placed_rows = materialize(placed_rows)
    shared = materialize(same_key(placed_rows))
    if not shared.isEmpty():
        linked = linked.unionByName(shared)
    found = components(linked)
    # where a bucket still has several classes, compare across them
    far = F.map_from_entries(F.collect_list(F.struct("v", 1 - F.col("similarity"))))
    known = tested.groupBy(F.col("u").alias("node")).agg(far.alias("far"))  # to its leaders, one a band at most
    known = known.join(found, "node", "full_outer")
    placed = materialize(members.join(known, "node", "left").select(
        "band", "h", "node", "leader", F.coalesce("label", "node").alias("label"),
        F.coalesce(F.try_element_at("far", F.col("leader")), F.lit(0.0)).alias("far"),
    ))
    # in large buckets texts are compared within parts first: that ties most of what has several links, at a row a text
    open_ = still_open(placed)
    large = open_.where(F.col("n") > block // 8)
    if not large.isEmpty():
        places = homes(large, signed, block)
        texts = signed.select("node", "keys").join(packed.join(places.select("node"), "node", "left_semi"), "node")
        texts = materialize(texts)
        tied = materialize(within_parts(large, places, texts, threshold))
        if not tied.isEmpty():
            linked = linked.unionByName(tied)
            found = components(linked)
            placed = materialize(placed.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
            open_ = still_open(placed)
            large = open_.where(F.col("n") > block // 8)
    small = open_.where(F.col("n") <= block // 8)
    x, y = small.alias("x"), small.alias("y")
    near = F.abs(F.col("x.far") - F.col("y.far")) <= 1 - threshold + 1e-9
    across = x.join(
        y,
        (F.col("x.band") == F.col("y.band")) & (F.col("x.h") == F.col("y.h"))
        & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & near,
    ).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    # a leader is the smallest of its bucket, so tested pairs have the smaller text as v
    across = across.join(tested.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")
    more = verify(across, packed).where(F.col("similarity") >= threshold).select("u", "v")
    if not large.isEmpty():
        more = more.unionByName(in_blocks(large, places, texts, threshold, block))
    more = materialize(more)
    if not more.isEmpty():
        found = components(linked.unionByName(more))
    named = bodies.select("node", "least").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named)
    class_id = named.groupBy("label").agg(F.min("least").alias("class_id"))
    whole = placed_rows.join(named.join(class_id, "label").select("node", "class_id"), "node")
    return whole.select(F.col("k").alias(key), "class_id", F.col("k").eqNullSafe(F.col("class_id")).alias("is_first"))
