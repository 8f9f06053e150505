"""The pipeline's stages on a small corpus, each held against what plain code gives for its input."""

import random
import struct
from collections import Counter

import corpus_pipeline
from ledgerspark.llm import bpe
from ledgerspark.llm.common import words_of


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls, ties, repeated rows, very long texts, clashing column names."""
    sf = str(tmp_path / "odd")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, key string, toxic int, size long"
    long = " ".join(f"word{k % 977} and" for k in range(30_000)) + " mail@example.org"
    rows = [(k, t, None, s, 1, 0.5, k, "k", 0, 1) for k, (t, s) in enumerate([(long, "a"), ("one two three four five six", "b"), ("one two three four five six", "b"), ("", "b"), (None, None), ("you idiot you stupid moron", "a")])]
    rows += [rows[1], (None, "one two three four five six", None, None, None, None, None, None, None, None), (None,) * 10]
    docs = spark.createDataFrame(rows, schema)
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, sf)
            found = out.collect()
            assert name == "encode" or out.columns == docs.columns
            assert found or d is not docs
            if d is not docs:
                assert not found
        if d is docs:
            kept = corpus_pipeline.drop_near_duplicates(spark, d, sf).collect()
            assert sorted((str(q["doc_id"]) for q in kept), key=str) == sorted(["0", "1", "3", "4", "5", "None"])
            clean = {q["doc_id"]: q for q in corpus_pipeline.redact_personal_data(spark, d, sf).collect() if q["doc_id"] is not None}
            assert clean[0]["text"].endswith(" [EMAIL]") and clean[4]["text"] is None and clean[0]["n_chars"] == len(clean[0]["text"])


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice(["an", "be", "ti", "or", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows, labels, clean = [], [], {}
    for k in range(80):
        text = prose(60)
        if k % 8 == 0:
            text += " you idiot and " + r.choice(["moron", "scum"])
        elif k % 8 == 1:
            text += f" reach mail{k}@example.com now"
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, int(k % 8 == 0)))
    rows += [(100 + k, rows[k][1], "en", "s0", rows[k][4]) for k in (2, 3)] + [(110, rows[4][1] + " more", "en", "s1", 1), (120, None, None, None, None), (121, "", "en", "s1", 0)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {q["doc_id"]: q["text"] for q in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        seen[name] = spark.read.parquet(f"{sf}/{name}")
        if name != "encode":
            assert out.columns == docs.columns
        docs = seen[name]
    assert list(stage) == ["drop_toxic", "drop_near_duplicates", "redact_personal_data", "mix_sources", "encode"]
    ids = lambda name: sorted(q["doc_id"] for q in seen[name].select("doc_id").collect())
    assert ids("drop_toxic") == sorted(k for k in before if k % 8 or k >= 100)
    assert ids("drop_near_duplicates") == sorted(k for k in before if (k % 8 or k >= 120) and k not in (102, 103, 110))
    redacted = {q["doc_id"]: q for q in seen["redact_personal_data"].collect()}
    for k, q in redacted.items():
        assert q["text"] == (before[k] if before[k] is None else before[k].replace(f"mail{k}@example.com", "[EMAIL]"))
        assert q["n_chars"] == (None if q["text"] is None else len(q["text"]))
    sizes, taken = Counter(), Counter()
    for k, q in redacted.items():
        sizes[q["source"]] += len(words_of(q["text"]))
    for q in seen["mix_sources"].collect():
        w = words_of(q["text"])
        taken[q["source"]] += len(w)
        assert w == words_of(redacted[q["doc_id"]]["text"])[: len(w)]
    weights = {"s0": 5, "s1": 2, "s2": 1}
    total = sum(sizes.values())
    assert all(abs(taken[s] - total * x / 8) <= 1 for s, x in weights.items())
    t = Tokenizer.from_file(bpe.located(bpe.VOCABULARY))
    mixed = sorted(q["text"] for q in seen["mix_sources"].collect())
    want = sorted(struct.pack(f"<{len(e)}I", *e) for e in (t.encode(x, add_special_tokens=False).ids for x in mixed))
    assert sorted(bytes(q["ids"]) for q in seen["encode"].collect()) == want
