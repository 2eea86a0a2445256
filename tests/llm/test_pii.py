import random
import re

import numpy as np

from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are written, with no shortcut."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(7)
    parts = ["a", "b9", "@", ".", "-", " ", "+", "(", ")", "1", "255", "300", "4111111111111111", "1.2.3.4", "x@y.z", "é", "%", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert [(s.kind, s.start, s.end) for s in pii.base_spans(text)] == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + " @", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@" * 100_000):
        pii.base_spans(text)


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(3)
    unary, pots = rng.normal(size=(4, 3)), [rng.normal(size=(3, 3)) for _ in range(3)]
    edges = [(0, 1), (1, 2), (1, 3)]
    joint = np.zeros((3, 3, 3, 3))
    for y in np.ndindex(3, 3, 3, 3):
        joint[y] = sum(unary[i, y[i]] for i in range(4)) + sum(p[y[a], y[b]] for (a, b), p in zip(edges, pots))
    p = np.exp(joint) / np.exp(joint).sum()
    found = pii.beliefs(unary, edges, pots, sweeps=200)
    for i in range(4):
        assert np.allclose(found[i], p.sum(axis=tuple(j for j in range(4) if j != i)), atol=1e-3)


def exact(unary, edges, potentials):
    """Marginals by enumerating every labelling."""
    n, k = unary.shape
    joint = np.zeros((k,) * n)
    for i in range(n):
        joint = joint + unary[i].reshape([k if j == i else 1 for j in range(n)])
    for (a, b), p in zip(edges, potentials):
        a, b, p = (a, b, p) if a < b else (b, a, p.T)
        joint = joint + p.reshape([k if j in (a, b) else 1 for j in range(n)])
    p = np.exp(joint - joint.max())
    p /= p.sum()
    return np.array([p.sum(axis=tuple(j for j in range(n) if j != i)) for i in range(n)])


def test_decisions_of_loopy_fields_equal_enumeration(spark):
    """Random documents of up to eight nodes, most with loops: the spans added are those that exact marginals add."""
    draw = random.Random(13)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = pii.fit(docs)
    whole = ["+1 (743) 555-3824", "ann.lee@mail.example", "4485275742308327", "10.20.30.40", "+44 20 7946 0958"]
    parts = ["743-555-3824", "7435553824", "ann.lee@mail", "ann.lee", "4485-2757", "742308327", "room 12-34", "2079460958", "a1b2c3", "10.20", "990-2", "x7@y"]
    loops = added = 0
    for _ in range(400):
        words = [draw.choice(whole) for _ in range(draw.randint(1, 2))] + [draw.choice(parts) for _ in range(draw.randint(1, 6))]
        draw.shuffle(words)
        text = " then ".join(words)
        base = pii.base_spans(text)
        ns = pii.nodes(text, base)
        if len(ns) > 8:
            continue
        for m in (fitted, model()):
            got, want = pii.more_spans(text, base, m), pii.more_spans(text, base, m, marginals=exact)
            assert got == want, text
            added += len(got)
        _, edges, _, tied = pii.field(text, ns, fitted)
        loops += len(set(edges)) >= len(ns)
    assert loops > 100 and added > 100


def masked(texts):
    """(text, places) with a later repeat of a base span written so that no pattern matches it."""
    other = {
        "email": lambda w: w.partition("@")[0] + "@mail",
        "phone": lambda w: re.sub("[^0-9]", "", w)[-10:],
        "card": lambda w: w[-7:], "ip": lambda w: re.sub(r"[.][0-9]+$", "", w),
    }
    for text in texts:
        for s in pii.base_spans(text)[:1]:
            word = other[s.kind](text[s.start : s.end])
            if not pii.base_spans(word):
                yield s.kind, word, f"{text} see {word} again"


def test_masked_repeats_are_found_in_documents_held_out(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text RLIKE '[0-9@]'").collect()]
    fitted = pii.fit(spark.createDataFrame([(t,) for i, t in docs if i % 2], "text string"))
    asked = right = extra = 0
    for kind, word, text in masked(t for i, t in docs if i % 2 == 0):
        found = {(s.kind, text[s.start : s.end]) for s in pii.more_spans(text, pii.base_spans(text), fitted)}
        tied = kind in ("phone", "card") or kind == "email" and len(word.partition("@")[0]) >= 4
        asked += tied
        right += tied and (kind, word) in found
        extra += len(found - {(kind, word)} if tied else found)
    print("masked repeats:", asked, "found:", right, "other spans:", extra)
    assert asked >= 10 and right >= 0.9 * asked and extra <= 0.1 * asked


def model():
    k = len(pii.LABELS)
    return pii.Model(np.full(k, -np.log(k)), {}, np.zeros((k, k)), 4.0)


def test_repeats_of_a_found_number_are_found_and_clean_text_is_left_alone():
    text = "call +1 (743) 555-3824 now, or 743-555-3824, room 12-34 and 99887"
    base = pii.base_spans(text)
    more = pii.more_spans(text, base, model())
    assert [text[s.start : s.end] for s in more] == ["743-555-3824"] and more[0].kind == "phone"
    assert pii.redact(text, base + more) == "call [PHONE] now, or [PHONE], room 12-34 and 99887"
    clean = "no number like 743-555-3824 counts alone"
    assert pii.more_spans(clean, pii.base_spans(clean), model()) == []


def test_empty():
    assert pii.base_spans("") == [] and pii.joined([]) == ""


def test_all_repeats_of_a_found_number_are_found_by_a_fitted_model(spark):
    """However many repeats follow, or stand before, though words of that shape are mostly nothing."""
    rows = [(f"see 2{i % 10}1-555-{1000 + i} or +1 (743) 555-{1000 + i} then",) for i in range(600)]
    rows += [(f"part 3{i % 10}2-444-{1000 + i} and 4{i % 10}3-444-{2000 + i} here",) for i in range(2000)]
    fitted = pii.fit(spark.createDataFrame(rows, "text string"))
    for n in (1, 2, 20, 200):
        for filler in (" or ", " part 302-444-1234 and "):
            repeats = filler + filler.join(["743-555-3824"] * n)
            for text in ("call +1 (743) 555-3824" + repeats, repeats + " call +1 (743) 555-3824"):
                more = pii.more_spans(text, pii.base_spans(text), fitted)
                assert [(s.kind, text[s.start : s.end]) for s in more] == [("phone", "743-555-3824")] * n


def test_beliefs_cross_a_long_chain():
    n = 60
    unary = np.zeros((n, 2))
    unary[0] = (-50, 0)
    found = pii.beliefs(unary, [(i, i + 1) for i in range(n - 1)], [np.eye(2) * 6.0] * (n - 1))
    want = 0.5 + 0.5 * np.tanh(3.0) ** (n - 1)
    assert abs(found[-1, 1] - want) < 0.01


def test_repeats_within_long_words_are_found():
    head = "call +1 (743) 555-3824 or ann.lee@mail.example; "
    for around in (
        "{},Paris,12.50,2024-01-02," + "x" * 60, "x" * 80 + ",{}", "https://a.example/" + "path/" * 20 + "{}/end?q=12&r=34",
        '{{"id":12,"name":"' + "n" * 70 + '","phone":"{}","zip":"75001"}}', "字" * 70 + "{}" + "字" * 70, "a,{},b", "tel:{}",
    ):
        for word, kind in (("743-555-3824", "phone"), ("ann.lee@mail", "email")):
            text = head + around.format(word)
            more = pii.more_spans(text, pii.base_spans(text), model())
            assert [(s.kind, text[s.start : s.end]) for s in more] == [(kind, word)], text
    text = head + "x" * 80 + "743-555-3824" + "y" * 80
    assert [text[s.start : s.end] for s in pii.more_spans(text, pii.base_spans(text), model())] == ["743-555-3824"]
    text = head + "1" * 100_000 + "," + "a1b2," * 20_000
    assert pii.more_spans(text, pii.base_spans(text), model()) == []
