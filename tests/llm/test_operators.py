"""Each operator on odd rows and against a brute-force version or a round trip."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from tidemark.llm import ann, bpe, bytebpe, common, graph, html, langid, linededup, media, minhash, packing, pii, tokencount

PATH = bytebpe.default_path()
WORDS = "the river runs past old mills where people bake bread and sell apples every market day in spring".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def odd_rows():
    """(doc_id, text, source, and columns whose names operators also use)."""
    draw = random.Random(1)
    long = "\n".join(prose(draw, 40) for _ in range(400))
    texts = [None, "", " ", "\n\n", "one", "Ünïcode ñ 漢字 🎈", "x" * 60_000, " " * 60_000, long, long, "a <|endoftext|> b"]
    texts += ["mail joe.smith7@mail.example.org or +1 (743) 555-3824", "no\nletters 123"]
    texts += [prose(draw, draw.randint(3, 300)) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}", 1, 2.0, "c") for i, t in enumerate(texts)]
    return [*rows, rows[-1], rows[-1], (None, "null key", None, None, None, None), (None, texts[20], "s1", 1, 1.0, "")]


SCHEMA = "doc_id long, text string, source string, k long, score double, th string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_materialized_tables_can_be_released(spark):
    made = common.materialize(spark.range(5))
    file = made.inputFiles()[0]
    assert made.count() == 5 and common.release(spark) >= 1 and common.release(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(file)


# language ID


def test_language(spark, odd, none):
    draw = random.Random(3)
    parts = {"aa": ["ra", "li", "mo", "ta"], "bb": ["zu", "ki", "qo", "xe"], "cc": ["wem", "thor", "nfi", "gry"]}
    make = lambda k: " ".join("".join(draw.choice(parts[k]) for _ in range(draw.randint(1, 4))) for _ in range(30))
    rows = [(i, make(k), k) for i, k in enumerate(list(parts) * 60)]
    labelled = spark.createDataFrame([*rows, (999, None, "aa"), (998, "no label", None)], "doc_id long, text string, lang string")
    model = langid.fit(labelled.where(~langid.held_out()))
    assert model.langs == ("aa", "bb", "cc")
    got = langid.predict(labelled, model).where(langid.held_out()).collect()
    assert got and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got if r["doc_id"] < 900)
    again = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert set(odd.columns) - {"score"} | {"lang_pred", "score"} == set(again[0].asDict())
    assert [again[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and again[0]["score"] == 0.0
    assert again[4]["lang_pred"] in model.langs and again[6]["lang_pred"] in model.langs
    assert langid.predict(none, model).count() == 0
    empty = langid.fit(labelled.where("false"))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert {r["doc_id"] for r in labelled.where(langid.held_out()).collect()} == {i for i, *_ in labelled.collect() if zlib.crc32(str(i).encode()) % 5 == 0}


def test_languages_of_copies(spark):
    """A language that has one text only, however often, is learned; copies don't fill the sample."""
    rows = [("wem thor gry nfi", "cc")] * 500 + [("ra li mo ta " * 5 + str(i), "aa") for i in range(30)] + [("zu ki qo xe", "bb")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), max_docs_per_lang=10)
    assert model.langs == ("aa", "bb", "cc") and {"wem", "thor", "zu", "mo"} <= set(model.words)
    assert langid.Scorer(model).text("gry wem")[0] == "cc"
    assert math.exp(model.prior[2]) == pytest.approx(500 / 531)


def test_samples_hold_the_smallest_hashes(spark):
    """Against sorting all hashes: the texts below a cutoff, each once, however often the hottest is repeated."""
    rows = [("hot", "aa")] * 3000 + [(f"text {i}", "aa" if i % 4 else "bb") for i in range(4000)] + [("lone", "cc")]
    few, sizes = common.few_texts(spark.createDataFrame(rows, "text string, lang string").repartition(5), 400, "lang")
    assert sizes == {"aa": 6000, "bb": 1000, "cc": 1}
    got: dict = {}
    for r in few.collect():
        got.setdefault(r["lang"], []).append((r["h1"], r["text"]))
    every = spark.createDataFrame(sorted(set(rows)), "text string, lang string").selectExpr("lang", "xxhash64(text) AS h", "text").collect()
    for k, found in got.items():
        assert sorted(found) == sorted((r["h"], r["text"]) for r in every if r["lang"] == k)[: len(found)]
    assert got["cc"][0][1] == "lone" and all(300 < len(got[k]) < 500 for k in ("aa", "bb"))
    assert common.few_texts(spark.createDataFrame([], "text string, lang string"), 5, "lang")[0].count() == 0


def test_shared_folder_of_a_cluster_must_be_named():
    class Session:
        class sparkContext:
            master = "spark://host:7077"
            applicationId = "a"

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_backoff_takes_the_longest_order_known():
    table = np.array([[0.0, -9.0], [-9.0, 0.0], [-1.0, -2.0]])
    model = langid.Model(("a", "b"), np.zeros(2), table, {"word": 0}, {4: {"oose": 1}, 3: {}, 2: {"xz": 2}, 1: {"q": 0}})
    s = langid.Scorer(model)
    assert s.rows("word") == [0] and s.rows("goose") == [1] and s.rows("xz") == [2] and s.rows("q") == [0] and s.rows("vvv") == []
    assert s.text("Word! goose")[0] in "ab" and s.text("12 34") == ("und", 0.0)


# media


def test_media_round_trip(odd, none):
    stored = media.store(odd).collect()
    for r in stored:
        codec, rate, data = media.read_wave(bytes(r["media"]))
        assert rate == 8000 and len(data) % 64 == 0 and len(data) >= 64 and codec in ("mulaw", "alaw", "ima_adpcm")
    got = defaultdict(set)
    for r in media.features(media.store(odd)).collect():
        got[r["doc_id"]].add(tuple(r)[1:])
    for i, text, *_ in odd_rows():
        if i is None:
            continue
        n, payload = media.payload_of(text or "")
        assert got[i] == {next(iter(got[i]))}
        row = next(iter(got[i]))
        assert row[:4] == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.features(media.store(none)).count() == 0
    where = media.store(odd)
    assert where.inputFiles() and media.features(where).count() == odd.count()
    heard = {r["doc_id"]: media.read_wave(bytes(r["pcm"])) for r in media.store_pcm(where).collect()}
    codecs = {r["doc_id"]: media.read_wave(bytes(r["media"])) for r in where.collect()}
    assert all(h[:2] == ("pcm", 16000) for h in heard.values())
    assert all(len(h[2]) == (4 * len(codecs[i][2]) if codecs[i][0] != "ima_adpcm" else len(codecs[i][2]) // 64 * 121 * 4) for i, h in heard.items())


def test_telephony_codecs():
    # fixed points of G.711
    assert [int(media.MULAW[c]) for c in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(media.ALAW[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(media.ALAW.tolist())) == 256
    # every code against the segments of the standard, written out
    for code in range(256):
        c = code ^ 0x55
        exponent, mantissa = c >> 4 & 7, c & 15
        size = mantissa * 16 + 8 if exponent == 0 else (mantissa * 16 + 264) * 2 ** (exponent - 1)
        assert media.ALAW[code] == (size if c & 0x80 else -size)
        c = 255 - code
        size = (2 * (c & 15) + 33) * 2 ** (c >> 4 & 7) * 4 - 132
        assert media.MULAW[code] == (-size if c & 0x80 else size)
    t = np.arange(121 * 50)
    wave = (8000 * np.sin(t / 9) + 3000 * np.sin(t / 31)).astype(np.int16).reshape(50, 121)
    back = media.decode_adpcm(media.encode_adpcm(wave)).astype(float)
    assert np.sqrt(((back - wave) ** 2).mean()) < 0.12 * wave.std()
    slow = []
    for block in media.encode_adpcm(wave)[:5]:
        value, index = struct.unpack("<h", block[:2].tobytes())[0], int(block[2])
        row = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = media.IMA_STEPS[index]
                change = step // 8 + (step // 4) * (code & 1) + (step // 2) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + media.IMA_INDEX[code & 7]))
                row.append(value)
        slow.append(row)
    assert media.decode_adpcm(media.encode_adpcm(wave)[:5]).tolist() == slow
    up = media.resample(wave.ravel(), 8000, 16000)
    assert len(up) == 2 * wave.size and (up[::2] == wave.ravel()).all()
    middle = 8000 * np.sin((t + 0.5) / 9) + 3000 * np.sin((t + 0.5) / 31)
    assert np.abs(up[1::2][8:-8] - middle[8:-8]).max() < 60
    assert len(media.resample(wave.ravel(), 16000, 8000)) == math.ceil(wave.size / 2)
    tone = lambda hz, rate, n=8000: (10_000 * np.sin(2 * np.pi * hz * np.arange(n) / rate)).astype(np.int16)
    level = lambda x: np.abs(x[200:-200].astype(float)).max() / 10_000
    for hz, low, high in ((6000, 0, 0.01), (4800, 0, 0.1), (1000, 0.97, 1.03)):
        assert low <= level(media.resample(tone(hz, 16000), 16000, 8000)) <= high
    assert 0.97 <= level(media.resample(tone(1000, 44100), 44100, 8000)) <= 1.03 and level(media.resample(tone(9000, 44100), 44100, 8000)) < 0.02
    assert len(media.resample(tone(1000, 44100), 44100, 8000)) == math.ceil(8000 * 80 / 441)
    for codec in media.FORMATS:
        assert media.read_wave(media.write_wave(b"\1" * 64, codec)) == (codec, 8000, b"\1" * 64)
    with pytest.raises(ValueError):
        media.read_wave(b"RIFF")


# line dedup


def boilerplate(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, text, source, *_ in rows:
        for line in (text or "").split("\n"):
            line = line.strip(" ")
            if line:
                sites[line].add(source)
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    return {x: first.get(x) for x, s in sites.items() if len(s) >= min_sites}


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(8)
    common = [prose(draw, 6) for _ in range(12)]
    rows = []
    for i in range(300):
        lines = [prose(draw, 9) for _ in range(draw.randint(0, 4))] + draw.choices(common[: draw.randint(1, 12)], k=draw.randint(0, 5)) + ["", " "]
        draw.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{min(draw.randint(0, 30), draw.randint(0, 30))}" if i % 50 else None))
    rows += [(500, None, "s1"), (501, "", "s1"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for least in (3, 8, 12):
        gone = boilerplate(rows, least)
        want = Counter()
        for i, text, source in rows:
            lines = None if text is None else text.split("\n")
            kept = [x for x in lines or [] if not (x.strip(" ") in gone and gone[x.strip(" ")] != i)]
            want[i, None if text is None else "\n".join(kept), source, len(lines or []), len(lines or []) - len(kept)] += 1
        assert Counter(tuple(r) for r in linededup.remove(docs, least).collect()) == want


def test_line_dedup_of_odd_rows(odd, none):
    got = linededup.remove(odd, 3)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and got.count() == odd.count()
    assert linededup.remove(none, 3).count() == 0
    assert "ArrowEval" not in got._jdf.queryExecution().toString() and "mapIn" not in got._jdf.queryExecution().toString()


def test_line_dedup_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = linededup.remove(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_lines", "n_removed", F.md5("text"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(linededup.ORACLE).fetchall())


# token counts


def test_edits_keep_counts_exact():
    draw = random.Random(5)
    b = bytebpe.load(PATH)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "re", "1", "22", "!", "é", " x", "<|endoftext|>", "<|end", "oftext|>", "word ", "\t", "。", "𝒜"]
    for i in range(600):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(300))) if i % 3 else prose(draw, draw.randrange(500))
        tree = tokencount.TokenTree(text, b)
        for _ in range(4):
            p = draw.randrange(len(text) + 1)
            q = p + draw.choice([0, 0, 1, 3, 50, 600])
            new = "".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 2, 5, 300])))
            tree.apply(tokencount.Edit(p, q, new))
            text = text[:p] + new + text[q:]
            assert tree.text == text and tree.chars == len(text) and tree.tokens == b.count(text)


def test_cuts_are_safe_in_any_text():
    """Both sides of every safe place are encoded as they are within the whole; all kinds of characters."""
    draw = random.Random(15)
    b = bytebpe.load(PATH)
    parts = ["a", "Z", "é", "ж", "字", "か", "한", "0", "9", "٣", "²", "'", "'s", "'ll", "!", "-", ".", "。", "，", "’", "…", "🎈", "\u0301", "𝒜", "ⅷ"]
    parts += [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "\u2028", "\x00", "ʼ", "ª", "¹", "_", "(", "“"]
    seen = 0
    for _ in range(8000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(2, 14)))
        whole = b.encode(text).tolist()
        for m in bytebpe.SAFE.finditer(text):
            seen += 1
            assert b.encode(text[: m.end()]).tolist() + b.encode(text[m.end() :]).tolist() == whole, (text, m.end())
    assert seen > 10_000
    for c in [*range(0x3100), *range(0x3100, 0x30000, 53)]:
        if not 0xD800 <= c < 0xE000:
            for text in (f"a{chr(c)}1", f"1{chr(c)}a", f"!{chr(c)}b", f" {chr(c)}.", f"字{chr(c)} x"):
                for m in bytebpe.SAFE.finditer(text):
                    assert b.encode(text[: m.end()]).tolist() + b.encode(text[m.end() :]).tolist() == b.encode(text).tolist(), (hex(c), text)


@pytest.mark.parametrize("kind", ["prose", "cjk", "lines", "double", "csv"])
def test_edits_touch_little_in_any_script(kind):
    draw = random.Random(3)
    make = {
        "prose": lambda: prose(draw, 20_000), "double": lambda: prose(draw, 20_000).replace(" ", "  "), "lines": lambda: prose(draw, 20_000).replace(" ", "\n"),
        "cjk": lambda: "".join(draw.choice("的一是在不了有和人这，。") if draw.random() < 0.2 else chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(120_000)),
        "csv": lambda: ",".join(str(draw.randint(0, 10**6)) for _ in range(20_000)),
    }[kind]
    b = bytebpe.load(PATH)
    text = make()
    tree = tokencount.TokenTree(text, b)
    assert tree.tokens == b.count(text)
    tree.encoded = 0
    at = len(text) // 2
    tree.apply(tokencount.Edit(at, at + 3, "xyz"))
    assert tree.encoded < 2_000 and tree.tokens == b.count(text[:at] + "xyz" + text[at + 3 :])


def test_edits_touch_little():
    b = bytebpe.load(PATH)
    tree = tokencount.TokenTree(prose(random.Random(2), 20_000), b)
    tree.encoded = 0
    tree.apply(tokencount.Edit(50_000, 50_003, "xyz"))
    assert tree.encoded < 2_000


def test_count_edits_over_tables(spark, odd, none):
    edits = spark.createDataFrame([(4, 2, 3, 3, " more"), (4, 1, 0, 1, "O"), (0, 1, 5, 2, "new"), (777, 1, 0, 0, "x"), (5, 1, 0, 10**6, None)], "doc_id long, seq long, start long, end long, replacement string")
    got = {r["doc_id"]: r for r in tokencount.count_edits(odd, edits, PATH).collect()}
    b = bytebpe.load(PATH)
    assert got[4]["n_tokens_after"] == b.count("One more") and got[4]["n_edits"] == 2
    assert got[0]["n_tokens"] == 0 and got[0]["n_tokens_after"] == b.count("new") and got[5]["n_tokens_after"] == 0
    for i, text, *_ in odd_rows():
        assert i is None or got[i]["n_tokens"] == b.count(text or "")
    assert tokencount.count_edits(none, edits, PATH).count() == 0


# packing


def test_packing_odd_rows(odd, none):
    rows = packing.pack(packing.pieces(odd, PATH, 64), 64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and 1 <= length <= 64
            at += length
        assert at <= 64
    exact = bytebpe.load(PATH).exact
    want = Counter()
    for i, text, *_ in odd_rows():
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        bounds = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
            want[i, k, a, z - a, zlib.crc32(struct.pack(f"<{z - a}I", *ids[a:z]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack(packing.pieces(none, PATH, 64), 64).count() == 0


# nearest neighbours


def vectors(draw, n, dim=16):
    centres = draw.normal(size=(20, dim))
    return [(i, (centres[i % 20] + 0.3 * draw.normal(size=dim)).astype("f4").tolist()) for i in range(n)]


def brute(rows, picked, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if picked(q):
            out[q] = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in good if i != q)[:k]
    return out


def test_nearest_neighbours(spark):
    rows = vectors(np.random.default_rng(0), 1500)
    rows += [(2000 + i, rows[0][1]) for i in range(300)]
    rows += [(3000, None), (3020, []), (3040, [0.0] * 16), (3060, [float("nan")] * 16), (3080, [1.0, None] * 8), (3100, [1.0] * 3), (3120, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).repartition(4)
    want = brute(rows, lambda q: q % 20 == 0, 10)
    for cell in (20_000, 100):
        got = defaultdict(list)
        for r in ann.search(df, F.col("id") % 20 == 0, 10, cell=cell).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["score"], r["vec_id"]))
            assert r["rank"] == len(got[r["query_id"]])
        assert set(got) == set(want)
        hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        for q, found in got.items():
            assert len(found) == 10 and found == sorted(found) and q not in {i for _, i in found}
        assert [i for _, i in got[0]] == [i for _, i in want[0]]


def test_few_vectors(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("id") == 0, 10).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)]
    assert ann.search(df.where("vec_id = 0"), F.col("id") == 0, 10).count() == 0
    assert ann.search(df.where("false"), F.col("id") == 0, 10).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.search(same, F.col("id") == 5, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_perturbations_come_in_order():
    draw = np.random.default_rng(1)
    low = draw.uniform(0, 2, 4)
    cost = {}
    for moves in np.ndindex(3, 3, 3, 3):
        c = sum({0: 0.0, 1: x * x, 2: (2 - x) ** 2}[m] for m, x in zip(moves, low))
        cost[moves] = c
    got = ann.perturbations(low, 2.0, 81)
    as_moves = [tuple({-1: 1, 1: 2}[dict(s)[i]] if i in dict(s) else 0 for i in range(4)) for s in got]
    assert len(set(as_moves)) == 81
    costs = [cost[m] for m in as_moves]
    assert costs == sorted(costs)


# BPE


def test_bpe_equals_tokenizers(spark, odd, none):
    exact = bytebpe.load(PATH).exact
    draw = random.Random(6)
    passage = [prose(draw, 700) for _ in range(3)]
    passage += [x.replace(" ", "\n") for x in passage] + ["".join(chr(draw.randint(0x4E00, 0x9FA5)) if i % 7 else "，" for i in range(4000))]
    more = [(1000 + i, prose(draw, draw.randint(0, 60)) + draw.choice(passage) + " " * (i % 3) + prose(draw, 30) + draw.choice(passage), "s", 0, 0.0, "") for i in range(30)]
    docs = odd.unionByName(spark.createDataFrame([*more, more[0]], SCHEMA))
    want = Counter()
    for i, text, *_ in [*odd_rows(), *more, more[0]]:
        ids = exact.encode(text or "", add_special_tokens=False).ids
        back = exact.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode(docs, PATH).collect()) == want
    with_ids = bpe.encode(docs.where("doc_id > 3"), PATH, ids=True)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(with_ids, PATH).collect()}
    assert all(texts[i] == text for i, text, *_ in more)
    assert bpe.encode(none, PATH).count() == 0


def test_fast_encoder_is_exact():
    b = bytebpe.load(PATH)
    assert b.fast is not None
    for c in [*range(0x3000), *range(0x3000, 0x20000, 37)]:
        if 0xD800 <= c < 0xE000:
            continue
        s = f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} {chr(c)}\n{chr(c)}'s"
        assert b.encode(s).tolist() == b.exact.encode(s, add_special_tokens=False).ids


# near duplicates


def partition(rows, threshold=0.8):
    """Classes by comparing every pair."""
    bags = [(i, t or "", Counter(minhash.shingles(t or "").tolist())) for i, t in rows]
    up = {i: i for i, _, _ in bags}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s, p) in enumerate(bags):
        for j, t, q in bags[:a]:
            both = sum((p & q).values())
            if s == t or p and q and both / (sum(p.values()) + sum(q.values()) - both) >= threshold:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in up}


def test_near_duplicates_equal_brute_force(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for _ in range(40):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(6, 200))]
        for _ in range(draw.choice([1, 1, 2, 5])):
            rows.append((len(rows), " ".join(words)))
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
    # one large group of copies, each with a change of its own
    words = [draw.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        changed = list(words)
        for at in draw.sample(range(120), draw.randint(1, 4)):
            changed[at] = draw.choice(vocabulary)
        rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "", "!", "?", "a b", "A  b", "a b c", rows[0][1], rows[0][1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = partition(rows)
    assert len(set(want.values())) > 40
    for block in (512, 64, 16):
        found = {r["doc_id"]: r for r in minhash.classes(docs, block=block).collect()}
        assert {i: r["class_id"] for i, r in found.items()} == want
    assert all(r["is_first"] == (i == r["class_id"]) for i, r in found.items())


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash.classes(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by[0] == by[1] == 0 and by[2] == 2 and by[8] == by[9] == 8
    assert {r["class_id"] for r in got if r["doc_id"] is None} == {None, 20}
    assert minhash.classes(none).count() == 0


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 300).astype(np.uint64)
    a = np.repeat(base[:200], draw.integers(1, 7, 200))
    b = np.repeat(base[100:], draw.integers(1, 7, 200))
    p, q = (np.unique(x, return_counts=True) for x in (a, b))
    m = 4000
    sig = minhash.signatures([a, b, a.copy()], m)
    assert (sig[0] == sig[2]).all() and np.isfinite(sig).all()
    agree = (sig[0] == sig[1]).mean()
    assert abs(agree - minhash.similarity(p, q)) < 4 * math.sqrt(0.25 / m)
    # weights matter: twice the bag is half as far again
    twice = minhash.signatures([a, np.concatenate([a, a])], m)
    assert abs((twice[0] == twice[1]).mean() - 0.5) < 4 * math.sqrt(0.25 / m)


def test_block_links_equal_pairs():
    draw = random.Random(9)
    bags = [np.array([draw.randint(0, 30) for _ in range(draw.randint(0, 40))], dtype=np.uint64) for _ in range(60)]
    bags += [np.append(b, np.uint64(3)) for b in bags[:20]]
    may = np.array([[(i + j) % 3 != 0 for j in range(len(bags))] for i in range(len(bags))])
    want = set()
    for i in range(len(bags)):
        for j in range(i + 1, len(bags)):
            s = minhash.similarity(np.unique(bags[i], return_counts=True), np.unique(bags[j], return_counts=True))
            if may[i, j] and s >= 0.8 and len(bags[i]) and len(bags[j]):
                want.add((i, j))
    got = {tuple(p) for p in minhash.block_links(bags, may, 0.8).tolist() if len(bags[p[0]]) and len(bags[p[1]])}
    assert got == want and want


def test_components(spark):
    draw = random.Random(7)
    edges = [(i, i + 1) for i in range(100)] + [(200, draw.randint(201, 240)) for _ in range(60)] + [(300, 300), (5, 4)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        up[max(find(u), find(v))] = min(find(u), find(v))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    links = spark.createDataFrame(edges, "u long, v long").repartition(3)
    for few in (0, 50, 10_000):
        assert {r["node"]: r["label"] for r in graph.components(links, few).collect()} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# pages


def blocks(body):
    """(tag, text) of each simple block, by a pattern of its own."""
    return re.findall(r"<(div|p)>(.*?)</\1>", body)


def aligned(a, b):
    """Places in ``a`` of a longest common subsequence, by the table of all lengths (lines of a page are different here)."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


@pytest.mark.parametrize("main", [False, True])
def test_pages_equal_brute_force(spark, main):
    draw = random.Random(3)
    quotes = [prose(draw, 7) + f" {i}" for i in range(6)]
    rows = []
    for i in range(150):
        host = f"h{draw.randint(0, 3)}.example"
        own = [f"<p>{prose(draw, 4)} {i} {j}</p>" for j in range(draw.randint(1, 5))] + [f"<p>{q}</p>" for q in draw.sample(quotes, draw.randint(0, 2))]
        own = "".join(own)
        own = f"<article>{own}</article>" if main and i % 3 else own
        rows.append((i, f"http://{host}/{draw.choice('ab')}/{draw.randint(0, 400)}", f"<body><div>Site {host}</div><div>Menu {draw.randint(0, 2)}</div>{own}<div>Imprint {host}</div></body>", "x"))
    rows += [(500, None, None, "x"), (501, "nonsense", "", "x"), (502, "http://lonely/", "<p>all mine</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string").repartition(7)
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    order = defaultdict(list)
    for i, url, body, _ in rows[:150]:
        host, _, path = url.partition("://")[2].partition("/")
        order[host].append(("/" + path, i, body))
    for pages_of in order.values():
        pages_of.sort(key=lambda p: p[:2])
        for at, (path, i, body) in enumerate(pages_of):
            mine, found = blocks(body), []
            for j in (at - 1, at + 1):
                if 0 <= j < len(pages_of):
                    other, theirs = pages_of[j][0], blocks(pages_of[j][2])
                    both = aligned(mine, theirs)
                    agree = len(os.path.commonprefix([path, other]))
                    copy = len(both) >= min(len(mine), len(theirs))
                    paragraphs = {n for n in both if mine[n][0] == "p"}
                    version = 2 * len(paragraphs) >= sum(t == "p" for t, _ in mine)
                    found.append(((not copy, agree, j < at), set() if copy else both - paragraphs, set() if copy or version else paragraphs))
            gone = max(found)[1] | (found[0][2] & found[1][2] if len(found) == 2 else set())
            inside = blocks(re.search("<article>(.*)</article>", body)[1]) if "<article>" in body else None
            text = " ".join(t for n, (_, t) in enumerate(mine) if n not in gone) if inside is None else " ".join(t for _, t in inside)
            assert got[i] == (rows[i][1], text, len(text))
    assert got[500] == (None, "", 0) and got[501] == ("nonsense", "", 0) and got[502][1] == "all mine"


def test_repeated_and_no_pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>", "c"), (1, "http://a/1", "<p>x</p>", "c"), (1, "http://a/1", "<p>y</p>", "c"), (None, "http://a/2", "<p>z</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string")
    assert Counter((r["page_id"], r["text"]) for r in html.extract(pages).collect()) == {(1, "x"): 2, (1, "y"): 1, (None, "z"): 1}
    assert html.extract(pages.where("false")).count() == 0


# personal data


def test_personal_data_over_tables(odd, none):
    model = pii.fit(odd)
    got = {r["doc_id"]: r for r in pii.find(odd, model).collect()}
    assert got[11]["n_email"] == 1 and got[11]["n_phone"] == 1 and got[11]["spans"].startswith("email:5:")
    assert got[11]["redacted"] == "mail [EMAIL] or [PHONE]" and got[0]["redacted"] is None and got[4]["redacted"] == "one"
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["spans"] == ""
    assert pii.find(none, pii.fit(none)).count() == 0


def by_document(rows):
    """Class ids of rows (key, text), rows that share a key being one document; null keys stand alone."""
    alone = partition([(i, t) for i, (_, t) in enumerate(rows)])
    up = {i: i for i in range(len(rows))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for i, (k, _) in enumerate(rows):
        for j in (alone[i], *([first.setdefault(k, i)] if k is not None else [])):
            up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, least.get(find(i))) for i, (k, _) in enumerate(rows))


def test_near_duplicates_of_shared_and_null_keys(spark):
    draw = random.Random(14)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    make = lambda: " ".join(draw.choice(vocabulary) for _ in range(60))
    a, b = make(), make()
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " also"), (None, a + " again"), (None, make()), (None, make())]
    assert by_document(rows)[5, 5] == 2 and by_document(rows)[8, 5] == 1
    texts = [make() for _ in range(40)]
    for _ in range(160):
        text = draw.choice(texts) + draw.choice(["", "", " x", " y z"])
        rows.append((draw.choice([None, *range(100, 190)]), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (512, 16):
        got = minhash.classes(docs, block=block).collect()
        assert Counter((r["doc_id"], r["class_id"]) for r in got) == by_document(rows)


def test_large_buckets_of_several_classes_equal_brute_force(spark):
    """Texts of one template, at similarities on both sides of the threshold: buckets stay mixed and large."""
    draw = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(300):
        words = list(base[: draw.randint(110, 150)])
        for at in draw.sample(range(len(words)), draw.randint(0, 12)):
            words[at] = f"x{draw.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = partition(rows)
    for block in (8, 64):
        assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs, block=block).collect()} == want


def test_large_buckets_ship_each_text_a_few_times(spark, monkeypatch):
    """A text that shares a large bucket a band with the same others isn't sent to tasks for each of them."""
    draw = random.Random(22)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in draw.sample(range(150), draw.randint(2, 8)):
            words[at] = f"x{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    shipped = []
    apply = GroupedData.applyInArrow

    def counted(self, *args):
        shipped.append(self._df.count())
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = partition(rows)
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs, block=128).collect()} == want
    assert shipped and sum(shipped) < 12 * len(rows)


def test_neighbours_that_repeat_ids(spark):
    """Rows that repeat an id or a vector: each row has a rank, and a repeated id hides no other."""
    draw = np.random.default_rng(5)
    near = draw.normal(size=8).astype("f4").tolist()
    rows = [(0, near)] * 13 + [(7, near), (8, near), (8, near)]
    rows += [(100 + i, (np.array(near) + draw.normal(size=8)).astype("f4").tolist()) for i in range(60)] + [(100, rows[-1][1])] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in ann.search(df, F.col("id").isin(0, 7, 110), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((round(r["score"], 6), r["vec_id"]))
    for q in (0, 7, 110):
        own = next(np.array(v, dtype=float) for i, v in rows if i == q)
        want = sorted((round(float(np.sqrt(((np.array(v, dtype=float) - own) ** 2).sum())), 6), i) for i, v in rows if i != q)[:10]
        assert got[q] == want
    assert [i for _, i in got[0]][:3] == [7, 8, 8] and {i for _, i in got[7]} == {0}
