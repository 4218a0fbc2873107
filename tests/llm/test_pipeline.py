from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__ as entry
from cases import documents, empty, words
from test_mixing import plain_targets
from test_pii import plain as plain_spans
from test_simhash import plain_groups, plain_print

SF001 = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_by_brute_force(spark):
    """Every stage over the whole small table, held against what its contract says of its own input."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF001), "test_stage")
        if name != "best-fit packing":
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        held[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        docs = out
    before, after = held["quality rules"]
    kept = {r["doc_id"] for r in after}
    assert all(r in before for r in after)
    for r in before:
        w = words(r["text"])
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        if len(w) < 20 or 100 * len(covered) > 30 * len(w):
            assert r["doc_id"] not in kept
    before, after = held["SimHash near-dedup"]
    prints = [(r["doc_id"], plain_print(r["text"])) for r in before]
    assert {r["doc_id"] for r in after} == set(plain_groups(prints, 4)) and all(r in before for r in after)
    before, after = held["PII"]
    clean = {r["doc_id"]: r for r in after}
    for r in before:
        spans = plain_spans(r["text"])
        got = clean[r["doc_id"]]["text"]
        assert (got == r["text"]) == (not spans) or not spans and "[" in got
        assert not plain_spans(got) and all(r["text"][a:b] not in got for _, a, b in spans)
    before, after = held["mixing"]
    sizes, taken, per_doc = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
        per_doc[r["doc_id"]] += len(words(r["text"]))
    target = plain_targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 64 for s in sizes)
    own = {r["doc_id"]: len(words(r["text"])) for r in before}
    assert all(n <= 2 * own[i] for i, n in per_doc.items())
    before, after = held["best-fit packing"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    places = defaultdict(list)
    for r in after:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == -(-sum(r["length"] for r in after) // 2048)


def test_odd_and_empty_documents(spark):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (documents(spark).select(*cols), empty(spark).select(*cols)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF001), "test_stage")
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                                "sequences", "lower_bound", "proven"]
    assert docs.count() == 0
