import hashlib
import random
import re

import pandas as pd
from cases import collected, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from latebound.llm.pii import (KINDS, _best, _scan, base_spans, find_personal_data, redacted_documents, span_text,
                               sweep)


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def plain(t):
    """The contract's patterns as they stand."""
    o = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
          if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            o.append((2, *m.span()))
    return o + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


CARD, CARD2 = "4532015112830366", "4111111111111111"
PARTS = ["a@b.co", "x.y+z@mail.example.com", "@", "a@b", "@b.c@d.e", "1.2.3.4", "300.1.1.1", "1.2.3", "0001.2.3.4.5",
         CARD, "4532 0151 1283 0366", CARD2 + "9", "+1 (555) 123-4567", "+49 30 1234567", "+1", "12345", " ", "-", ".", "é", "\n", "名"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text("a1.@+- (", max_size=40))
def test_base_spans_of_any_text(text):
    assert base_spans(text) == plain(text)


def test_searches_are_linear():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "1 " * 150_000, "((((" * 80_000):
        base_spans(text)
    assert time.time() - began < 20


def corpus(spark, n=400):
    rows = []
    for i in range(n):
        card = f"4{i:014d}"
        card += next(str(d) for d in range(10) if luhn(card + str(d)))
        phone = f"+1 ({200 + i % 700}) 555-{1000 + i}"
        rows.append((i, f"plain words here {phone} and so on. pay {card} now, mail u{i}@mail{i % 9}.example.com or host 10.{i % 250}.3.4 end"))
        rows.append((n + i, f"nothing private in text {i}, version 1.{i}.2 of 2020-01-{i % 28 + 1:02d} and number {i * 7919}"))
    rows.append((5000, f"call +1 (555) 123-4567 {CARD} today"))  # read greedily, neither is found
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_base_and_added_spans(spark):
    docs = corpus(spark)
    out = {r["doc_id"]: r for r in find_personal_data(docs, keep=("text",)).collect()}
    for r in out.values():
        base = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert base == plain(r["keep_text"]) and set(base) <= set(spans) and spans == sorted(spans)
    joined = out[5000]
    assert not joined["base"]
    found = {(KINDS[s["kind"]], joined["keep_text"][s["start"]:s["end"]]) for s in joined["spans"]}
    assert ("card", CARD) in found and ("phone", "+1 (555) 123-4567") in found
    assert all(not r["spans"] for i, r in out.items() if 400 <= i < 800)  # clean documents stay clean


def test_digest_and_redaction(spark):
    docs = corpus(spark, 60)
    one = find_personal_data(docs).filter("doc_id = 3").select(span_text("spans").alias("s")).first()["s"]
    text = docs.filter("doc_id = 3").first()["text"]
    assert one == ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(text))
    assert len(hashlib.sha256(one.encode()).hexdigest()) == 64
    clean = {r["doc_id"]: r["text"] for r in redacted_documents(docs).collect()}
    assert "@" not in clean[3] and "[EMAIL]" in clean[3] and "[CARD]" in clean[3] and "[PHONE]" in clean[3] and "[IP]" in clean[3]


def test_odd_documents(spark):
    docs = documents(spark)
    out = redacted_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    # no personal data: texts stay; n_chars is what the text has
    assert [r[1] for r in collected(out.select("doc_id", "text"))] == [r[1] for r in collected(docs.select("doc_id", "text"))]
    assert find_personal_data(empty(spark)).count() == 0


def test_other_formats_are_found(spark):
    planted = {6000: ("email", "write to jane.doe [at] mail3 [dot] example [dot] org soon", "jane.doe [at] mail3 [dot] example [dot] org"),
               6001: ("email", "or joe (at) host.example.org is right", "joe (at) host.example.org"),
               6002: ("phone", "ring (555) 123-4567 at noon", "(555) 123-4567"),
               6003: ("phone", "ring 555-123-4567 at noon", "555-123-4567"),
               6004: ("phone", "ring 555.123.4567 at noon", "555.123.4567"),
               6005: ("card", "pay 3782 822463 10005 now", "3782 822463 10005"),
               6006: ("card", f"card {CARD} {CARD2} twice", CARD)}
    clean = ["from 1998-04-17 on", "in 1990-1995 or so", "release 10.2.31.4000 of it", "about 12 000 000 people", "look (at) this",
             "row 123456789 of it", "pay 3782 822463 10006 now", "on 17.04.1998 again"]
    rows = [(i, t) for i, (_, t, _) in planted.items()] + [(7000 + i, t) for i, t in enumerate(clean)]
    docs = corpus(spark).union(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r["doc_id"]: (r["keep_text"], r["spans"]) for r in find_personal_data(docs, keep=("text",)).collect()}
    for i, (kind, _, want) in planted.items():
        text, spans = out[i]
        assert (kind, want) in {(KINDS[s["kind"]], text[s["start"]:s["end"]]) for s in spans}, text
    assert [out[7000 + i][0] for i in range(len(clean)) if out[7000 + i][1]] == []
    assert all(not s for i, (_, s) in out.items() if 400 <= i < 800)


def test_sweep_and_best_equal_the_plain_search():
    rnd = random.Random(1)
    for _ in range(500):
        spans = [(a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 12)))]
        overlaps = sweep(spans)
        for a in range(0, 70, 7):
            assert overlaps(a, a + 4) == any(x < a + 4 and a < y for x, y in spans)
        group = [{"kind": 0, "start": a, "end": b, "p": rnd.random()} for a, b in spans]
        chosen = []
        for c in sorted(group, key=lambda c: (-c["p"], c["start"] - c["end"], c["start"], c["kind"])):
            if not any(x["start"] < c["end"] and c["start"] < x["end"] for x in chosen):
                chosen.append({k: c[k] for k in ("kind", "start", "end")})
        assert _best.func(pd.Series([group]))[0] == sorted(chosen, key=lambda c: c["start"])


def test_many_numbers_in_one_text():
    """Proposals are held against the spans in one sweep: twice the numbers take about twice the time."""
    import time

    def seconds(n):
        frame = pd.DataFrame({"_text": [" ".join(f"+49 30 {i:07d}" for i in range(n))], "id": [1]})
        began = time.process_time()
        list(_scan(iter([frame]), ["id"]))
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 3 * seconds(4000) + 0.5


def test_training_documents_are_drawn(spark):
    """Few documents are searched for labels; without a limit all are, however the table is split."""
    from latebound.llm.pii import draw_training, scan_documents, training_rows

    texts = [f"write to u{i}@mail{i % 9}.example.org or call +1 555 {i:03d} {i:04d}, on 2020-01-{1 + i % 28:02d}" for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scan = scan_documents(docs, {"id": "doc_id"}, "text")
    known = scan.agg({"known": "sum"}).first()[0]
    assert known >= 800

    def draw(df, n):
        return sorted((r["h"], r["right"], tuple(r["f"])) for r in draw_training(df, scan, "doc_id", "text", n).collect())

    every, few = draw(docs, 10**6), draw(docs, known // 8)
    assert len(every) == sum(len(training_rows(t)) for t in texts)
    assert len(every) / 16 < len(few) < len(every) / 4 and set(few) <= set(every)
    assert few == draw(docs.repartition(7), known // 8)


def test_all_labelled_rows_train(spark, monkeypatch):
    """Whatever their number, all rows with a label reach the trees or the thresholds; equal rows are one with a weight."""
    from latebound.llm import pii

    seen = []
    plain = pii.materialize
    monkeypatch.setattr(pii, "materialize", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    texts = [f"write to u{i}@mail.example.org or call +1 555 {i % 50:03d} {i % 70:04d} x" for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pii.find_personal_data(docs, trees=1)
    table = next(t for n, t in seen if n == "pii_train")
    want = sum(len(pii.training_rows(t)) for t in texts)
    assert want > 20_000 and table.agg({"n": "sum"}).first()[0] == want and table.count() < want / 10


def test_texts_left_out_hold_nothing():
    from latebound.llm.pii import _MAY, candidate_spans

    rnd, parts = random.Random(5), ["@", "a.b", "1", "23", "4567", "+", " ", "-", ".", "(", ")", "[at]", "{ AT }", "x", "é"]
    out = 0
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        if not re.search(_MAY, text):
            out += 1
            assert not base_spans(text) and not candidate_spans(text), text
    assert out > 1000


def test_pieces_are_the_whole():
    texts = [" ".join(f"+49 30 {i:07d}" for i in range(n)) for n in (0, 900, 2500, 3, 1)] + [None]
    frame = pd.DataFrame({"_text": texts, "id": range(6)})
    pieces = list(_scan(iter([frame]), ["id"]))
    assert len(pieces) > 1 and [i for p in pieces for i in p["id"]] == list(range(6))
    assert [len(b) for p in pieces for b in p["base"]] == [len(base_spans(t or "")) for t in texts]
