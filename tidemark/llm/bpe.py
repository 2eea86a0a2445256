"""BPE encoding with reuse of chunks that documents share, and decoding.

1. Every text is cut into content-defined chunks; only their 128-bit hashes leave the scan.
2. A hash that occurs twice or more is shared; its first occurrence owns it.
3. Texts meet their roles.  Owners encode the inside of their shared chunks, once for all;
   a document that needs no other's chunks is finished there and then.
4. The remaining documents receive the ids of the shared chunks they hold and encode only
   what lies between them.

Ids of a chunk's inside hold in any context because it begins and ends where a pre-token
surely ends (:data:`tidemark.llm.bytebpe.SAFE`): before white space, and between letters, digits
and marks.  At each join the region to encode again
grows from the chunk border both ways until it reaches such places, from which on the
chunk's own ids and those of the whole text agree exactly.  A chunk without such places
joins the region whole.

Defined results: null text counts as empty; an empty text has no ids and decodes to an empty
text.  Repeated rows and keys are kept row by row.  A text in which a special token's string
occurs is encoded as a whole, and so is every text if the vocabulary isn't plain byte-level BPE.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import SAFE, ByteBpe, load
from tidemark.llm.chunks import bounds
from tidemark.llm.common import map_batches, materialize

def split(text: str) -> tuple[list[str], list[bytes]]:
    """A text's chunks and their hashes."""
    raw = text.encode("utf-8")
    cuts = bounds(raw)
    parts = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
    return [p.decode("utf-8") for p in parts], [hashlib.blake2b(p, digest_size=16).digest() for p in parts]


def inside(chunk: str) -> tuple[int, int] | None:
    """First and last place in a chunk where a pre-token surely ends, or None if they don't differ."""
    first = SAFE.search(chunk)
    if not first:
        return None
    reach = 64
    while True:
        begin = max(first.end() + 1, len(chunk) - reach)
        last = None
        for last in SAFE.finditer(chunk, begin):
            pass
        if last:
            return first.end(), last.end()
        if begin == first.end() + 1:
            return None
        reach *= 8


def assemble(parts: list[str], known: dict[int, np.ndarray], bpe: ByteBpe) -> np.ndarray:
    """Ids of the joined parts, given the ids of the inside of some of them."""
    out: list[np.ndarray] = []
    region: list[str] = []
    for i, part in enumerate(parts):
        if i in known and (place := inside(part)):
            out += [bpe.encode("".join([*region, part[: place[0]]])), known[i]]
            region = [part[place[1] :]]
        else:
            region.append(part)
    return np.concatenate([*out, bpe.encode("".join(region))])


def reusable(bpe: ByteBpe, text: str) -> bool:
    return bpe.fast is not None and not bpe.whole(text)


def _digest(ids: np.ndarray, bpe: ByteBpe) -> tuple[int, str, str]:
    decoded = bpe.decode(ids)
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


_RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunk_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, pos, h): the chunks of every text; ``th`` tells texts with the same key apart."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        take, pos, hashes = [], [], []
        for i, x in enumerate(batch.column(2)):
            found = split(x.as_py() or "")[1]
            take += [i] * len(found)
            pos += range(len(found))
            hashes += found
        rows = pa.array(take, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(hashes, pa.binary())],
            names=[key, "th", "pos", "h"],
        )

    return map_batches(docs.select(key, "th", text), run, f"`{key}` {kind}, th long, pos int, h binary")


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row; with ``ids`` also the ids as an array."""
    docs = docs.select(F.col(key), F.col(text), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    kind = docs.schema[key].dataType.simpleString()
    chunks = materialize(chunk_hashes(docs, key, text))
    # written before they are joined, so that both sides are plain exchanges, which Spark
    # splits where a chunk is hot
    shared = materialize(
        chunks.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(key), "th", "pos")).alias("owner"))
        .where("n > 1").select("h", "owner")
    )
    here = F.struct(F.col(key), "th", "pos")
    roles = (
        chunks.join(shared, "h")
        .select(F.col(key), "th", F.struct("pos", "h", here.eqNullSafe(F.col("owner")).alias("own")).alias("role"))
        .groupBy(key, "th").agg(F.collect_set("role").alias("roles"))
    )
    packed = docs.select(key, "th", text)

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=3)
        column = [None if x.as_py() is None else z.compress(x.as_py().encode("utf-8")) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(column, pa.binary())], names=[key, "th", "z"])

    packed = map_batches(packed, squeeze, f"`{key}` {kind}, th long, z binary")
    met = _meet(packed, roles, key)
    out_ids = ", ids array<long>" * ids

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, plain = load(path), zstandard.ZstdDecompressor()
        squeezer = zstandard.ZstdCompressor(level=3)
        take, rows = [], []
        for i in range(batch.num_rows):
            body = batch.column("z")[i].as_py()
            whole = plain.decompress(body).decode("utf-8") if body else ""
            listed = batch.column("roles")[i].as_py() or []
            if not listed or not reusable(bpe, whole):
                take.append(i)
                rows.append(("done", None, None, *_row(bpe.encode(whole), bpe, ids)))
                continue
            parts = split(whole)[0]
            known = {}
            for r in listed:
                if r["own"] and (place := inside(parts[r["pos"]])):
                    known[r["pos"]] = bpe.encode(parts[r["pos"]][place[0] : place[1]])
                    take.append(i)
                    rows.append(("chunk", r["h"], squeezer.compress(known[r["pos"]].tobytes()), *_row(None, bpe, ids)))
            take.append(i)
            if all(r["own"] for r in listed):
                rows.append(("done", None, None, *_row(assemble(parts, known, bpe), bpe, ids)))
            else:
                rows.append(("open", None, body, *_row(None, bpe, ids)))
        at = pa.array(take, pa.int64())
        return _batch([batch.column(key).take(at), batch.column("th").take(at)], rows, [key, "th", "state", "h", "z"], ids)

    step = materialize(map_batches(met, first, f"`{key}` {kind}, th long, state string, h binary, z binary, {_RESULT}{out_ids}"))
    results = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    done = step.where("state = 'done'").select(key, *results)
    made = materialize(step.where("state = 'chunk'").groupBy("h").agg(F.first("z").alias("encoded")))
    waiting = step.where("state = 'open'").select(key, "th", "z")
    parts_of = (
        chunks.join(made, "h")
        .select(F.col(key), "th", F.struct("pos", "encoded").alias("part"))
        .join(waiting.select(F.col(key).alias("__k"), F.col("th").alias("__t")).distinct(), F.col(key).eqNullSafe(F.col("__k")) & (F.col("th") == F.col("__t")), "left_semi")
        .groupBy(key, "th").agg(F.collect_set("part").alias("roles"))
    )

    def second(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, plain = load(path), zstandard.ZstdDecompressor()
        rows = []
        for body, listed in zip(batch.column("z"), batch.column("roles")):
            known = {p["pos"]: np.frombuffer(plain.decompress(p["encoded"]), dtype=np.uint32) for p in listed.as_py() or []}
            rows.append(_row(assemble(split(plain.decompress(body.as_py()).decode("utf-8"))[0], known, bpe), bpe, ids))
        return _batch([batch.column(key)], rows, [key], ids)

    rest = map_batches(_meet(waiting, parts_of, key), second, f"`{key}` {kind}, {_RESULT}{out_ids}")
    return done.unionByName(rest)


def _meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    right = right.withColumnsRenamed({key: "__k", "th": "__t"})
    return left.join(right, left[key].eqNullSafe(right["__k"]) & (left["th"] == right["__t"]), "left").drop("__k", "__t")


def _row(found: np.ndarray | None, bpe: ByteBpe, ids: bool) -> tuple:
    if found is None:
        return (None,) * (3 + ids)
    return (*_digest(found, bpe), *([found.tolist()] if ids else []))


def _batch(front: list, rows: list[tuple], names: list[str], ids: bool) -> pa.RecordBatch:
    more = {"state": pa.string(), "h": pa.binary(), "z": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int64())}
    names = [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    columns = [pa.array([r[i] for r in rows], more[n]) for i, n in enumerate(names[len(front) :])]
    return pa.RecordBatch.from_arrays([*front, *columns], names=names)


def decode(docs: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of rows of ids; null ids give null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        back = [None if x.as_py() is None else bpe.decode(np.array(x.as_py(), dtype=np.uint32)) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=[key, "text"])

    return map_batches(docs.select(key, ids), run, f"`{key}` {kind}, text string")
