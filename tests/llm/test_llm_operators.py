"""Corpus operators on small tables: brute force, nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import ann, bpe, components, html_text, lm_scoring, mixing, near_dedup, pii, quality, suffix_dedup, toxicity
from ledgerspark.llm.common import WORD_RE, lower_ascii, words_of

SCHEMA = "doc_id long, text string, source string, size int, key string, score double"


def prose(r, n):
    return " ".join("".join(r.choice(["an", "be", "ti", "or", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def cases(spark):
    """Copies, near copies, null and blank texts, repeated rows, null ids, odd columns."""
    r = random.Random(8)
    base = [prose(r, r.randint(30, 120)) for _ in range(25)]
    near = [" ".join(w if k != 20 else "changed" for k, w in enumerate(t.split(" "))) for t in base[:8]]
    texts = base + near + base[:3] + [None, "", "  \n ", "one two", "one two", "Café naïve ÉTÉ", prose(r, 4000)]
    rows = [(k, t, None if k % 9 == 0 else f"s{k % 4}", k, "x", 0.5) for k, t in enumerate(texts)]
    rows += [rows[5], (None, base[0], "s1", 1, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_follow_the_six_spaces():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("ab \t\n\x0b\x0c\r\x1c\x85\xa0 éÀZ") for _ in range(r.randint(0, 12)))
        assert words_of(t) == WORD_RE.findall(t) and lower_ascii(t) == re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_pii_base_spans_equal_the_plain_rules():
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
        digits = lambda s: re.sub("[^0-9]", "", s)
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        return sorted(out)

    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("a1.@2-+ 9(0é") for _ in range(r.randint(1, 40)))
        assert plain(t) == pii.base_spans(t)


def test_pii_counts_and_hashes(spark):
    def want(t):
        base = pii.base_spans(t or "")  # held against the plain rules above
        named = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(base))
        return *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(named.encode()).hexdigest()

    texts = ["mail a.b@c.de and 10.0.0.1 or 4111 1111 1111 1111, call +49 30 1234567", None, "", "x " * 60_000 + "z@y.org 300.1.1.1"]
    rows = [(k, t, 5, "s") for k, t in enumerate(texts)] + [(0, texts[0], 5, "s"), (None, texts[0], None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_email int, spans string")
    columns = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    got = sorted(((q["doc_id"], *(q[c] for c in columns)) for q in pii.find_spans(d).collect()), key=repr)
    assert got == sorted(((i, *want(t)) for i, t, *_ in rows), key=repr)
    docs = {q["doc_id"]: q["text"] for q in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(tuple(q[c] for c in columns) == want(docs[q["doc_id"]]) for q in pii.query(spark, "/root/testdata/sf0.001").collect())


def test_pii_learns_secrets_and_redacts(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(k, f'prose words here token = "{key[k % 7:]}ab{k}" and mail{k}@example.com') for k in range(40)] + [(99, None), (98, ""), (97, "version 3.0 of plain words")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_spans(d).collect()}
    assert "secret:" in got[1]["spans"] and got[1]["n_email"] == 1 and got[97]["spans"] == got[99]["spans"] == ""
    assert got[98]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact_documents(d).collect()}
    assert "@" not in clean[1] and "[EMAIL]" in clean[1] and clean[99] is None
    assert pii.find_spans(d.limit(0)).isEmpty()


def test_pii_rejected_run_does_not_hide_a_number():
    # by these weights only iban (5) and ssn (6) are accepted, or secrets (4) as well
    weights = np.zeros(len(pii.KINDS) + 3 * pii.N_VOTERS + 12)
    weights[:7] = [-1, -1, -1, -1, -1, 1, 1]
    for text, inner in (("ref/123-45-6789/ab", (4, 6, 15)), ("iban/DE89370400440532013000", (5, 5, 27))):
        assert pii.spans_of(text, weights)[1] == [inner]
        also = weights.copy()
        also[4] = 1
        assert pii.spans_of(text, also)[1] == [(0, 4, len(text))]


def test_quality(spark, cases):
    d, rows = cases
    got = quality.clean_lines(d).collect()
    assert len(got) == len(rows)
    assert quality.repeat_words("a b c x a b c".split()) == 6 and quality.repeat_words(["w"] * 5) == 5 and quality.repeat_words(["a", "b"]) == 0
    good = "\n".join("This is a sentence of words that ends well." for _ in range(1)) + " " + " ".join(f"word{k}" for k in range(60)) + "."
    assert quality.judge(good)["kept"] and quality.judge(None)["base_failed"]
    menu = "\n".join(f"home{k} | about{k} | shop{k} | cart{k} | help{k} | more{k}" for k in range(12))
    v = quality.judge(menu)
    assert not v["base_failed"] and not v["kept"] and v["lost_chars"] == v["word_chars"]
    assert quality.judge("a b\na b\n\n c")["n_dup_lines"] == 1


def test_line_rules_in_four_languages():
    for line in ("Todos los derechos reservados.", "Alle Rechte vorbehalten", "Tous droits réservés - site", "© All rights reserved"):
        assert quality.line_fails(line, line.split()) == "boilerplate"
    shout = " ".join(f"WORD{k}!!" for k in range(9))
    bare = " ".join(f"word{k}" for k in range(30))
    assert quality.line_fails(shout, shout.split()) == quality.line_fails(bare, bare.split()) == "punctuation"
    assert quality.line_fails(bare + ".", (bare + ".").split()) is None and quality.line_fails("A short title", ["A", "short", "title"]) is None
    verdict = quality.judge("\n".join(f"{bare} {k}" for k in range(3)))
    assert verdict["n_failed_lines"] == 3 and not verdict["kept"]


def quality_by_plain_code(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of the contract, word by word."""
    text = text or ""
    w = WORD_RE.findall(text)
    lines = [x for x in text.split("\n") if WORD_RE.search(x)]
    windows = defaultdict(list)
    for k in range(len(w) - 2):
        windows[tuple(w[k : k + 3])].append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def test_quality_query_equals_plain_code(spark, cases):
    d, rows = cases
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(([q["doc_id"], *(q[c] for c in columns)] for q in quality.clean_lines(d, with_text=False).collect()), key=repr)
    assert got == sorted(([i, *quality_by_plain_code(t)] for i, t, *_ in rows), key=repr)
    texts = {q["doc_id"]: q["text"] for q in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for q in quality.query(spark, "/root/testdata/sf0.001").collect():
        assert tuple(q[c] for c in columns) == quality_by_plain_code(texts[q["doc_id"]]) and not (q["base_failed"] and q["kept"])
    assert quality.clean_lines(empty(spark)).isEmpty()


def test_nearest_with_aim_one_is_exact_where_all_rows_are_the_sample(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (60, 6)) * r.uniform(0.5, 2, (60, 1))
    x[10] = x[11] = x[12]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    odd = [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [1.0]), (5, rows[5][1])]
    got = defaultdict(list)
    for q in ann.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, aim=1.0).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append((q["vec_id"], q["score"]))
    assert sorted(got) == [0, 20, 40]
    for i, found in got.items():
        s = x @ x[i]
        want = [k for k in np.lexsort((np.arange(60), -np.round(s, 9))) if k != i][:20]
        assert [k for k, _ in found] == want and found[0][1] == pytest.approx(s[want[0]])


def test_nearest_gives_k_ids_when_rows_repeat(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (60, 6))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    other = r.normal(0, 1, (60, 30, 6))  # an id with thirty more vectors each
    for name, more in (("rows", rows * 25), ("vectors", rows + [(k, [float(c) for c in v]) for k in range(30) for v in other[k]])):
        best = defaultdict(lambda: defaultdict(lambda: -np.inf))
        for q, v in more:
            if q in (40, 59):
                for i, w in more:
                    if i != q:
                        best[q][i] = max(best[q][i], float(np.dot(v, w)))
        got = defaultdict(list)
        for q in ann.nearest(spark.createDataFrame(more, "vec_id long, embedding array<double>"), F.col("vec_id").isin(40, 59), aim=1.0).orderBy("query_id", "rank").collect():
            got[q["query_id"]].append(q["vec_id"])
        assert dict(got) == {q: sorted(best[q], key=lambda i: (-round(best[q][i], 9), i))[:20] for q in (40, 59)}, name


def test_nearest_against_brute_force_below_and_above_the_sample(spark, monkeypatch):
    r = np.random.default_rng(6)
    fits, fit = [], ann.fitted
    monkeypatch.setattr(ann, "fitted", lambda *a: fits.append(fit(*a)) or fits[-1])
    for n, sample in ((300, 20_000), (6000, 3000)):
        x = r.normal(0, 1, (n, 24)) + 1.5 * r.normal(0, 1, (40, 24))[np.arange(n) % 40]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = spark.createDataFrame([(k, v.tolist(), k, "x", 0.5) for k, v in enumerate(x)], "vec_id long, embedding array<double>, rank long, v string, score double")
        got = ann.nearest(d, F.col("vec_id") % 20 == 0, sample=sample, block=500).collect()
        score = x @ x.T - 9 * np.eye(n)
        best = {k: set(np.argsort(-score[k])[:20].tolist()) for k in range(0, n, 20)}
        assert sum(q["vec_id"] in best[q["query_id"]] for q in got) / (20 * len(best)) > 0.9
        assert all(q["score"] == pytest.approx(score[q["query_id"], q["vec_id"]], abs=1e-12) for q in got)
        codes, count = fits[-1]
        own, tried = codes.of(x), [codes.probes(x[::20], t, count) for t in range(codes.tables)]
        reranked = np.mean([np.any([np.isin(own[:, t], tried[t][i]) for t in range(codes.tables)], 0).mean() for i in range(0, n // 20, 5)])
        assert reranked < (0.8 if n < 1000 else 0.35)
    assert fits[1][0].bits > fits[0][0].bits > 1 and len(fits[1][0].axes) > 1
    for n in (0, 1, 2):
        assert ann.nearest(d.where(F.col("vec_id") < n), F.lit(True)).count() == max(0, n * (n - 1))


def test_one_vector_of_another_length_does_no_harm(spark):
    r = np.random.default_rng(7)
    rows = [(k, r.normal(0, 1, 64).tolist()) for k in range(100)] + [(100, r.normal(0, 1, 65).tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), aim=1.0).collect()
    assert len(got) == 2000 and all(q["query_id"] < 100 and q["vec_id"] < 100 for q in got)


def test_probes_come_best_first():
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (50, 32))
    codes = ann.Codes(32, float(np.linalg.norm(x, axis=1).max()), False, 2, 9)
    whole = codes.probes(x, 1, 512)
    assert codes.axes == [32, 4] and all(sorted(w) == list(range(512)) for w in whole) and (codes.probes(x, 1, 20) == whole[:, :20]).all()
    assert (codes.of(x)[:, 1] == whole[:, 0]).mean() > 0.9 and np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_mixing(spark, cases):
    d, rows = cases
    plan = mixing.plan_mix(d)
    got = plan.select("__row.doc_id", "__row.source", "size", "source_size", "target", "taken", "passes").collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["taken"]
        per[r["source"]][2] = r["target"]
    assert sum(t for *_, t in per.values()) == pytest.approx(sum(s for s, *_ in per.values()))
    assert all(abs(taken - t) <= 1 and t <= 3 * s + 1e-6 for s, taken, t in per.values())
    at = [r["position"] for r in mixing.training_order(plan).collect()]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert mixing.mix_documents(d).columns == d.columns and mixing.plan_mix(empty(spark)).isEmpty()


def test_mixing_against_its_twin(spark):
    import duckdb

    got = mixing.query(spark, "/root/testdata/sf0.001")
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    order = "doc_id, size, source_size, target, taken, position"
    assert sorted(map(tuple, got.select(*order.split(", ")).collect()), key=repr) == sorted(c.sql(f"SELECT {order} FROM ({mixing.SQL})").fetchall(), key=repr)


def test_inverse_demand_inverts(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(11).select((F.col("id") / 10).alias("x")).select("x", mixing.inverse_demand(F.col("x"), knots).alias("t")).collect()
        grid = np.linspace(0, 1, 100001)
        w = np.interp(grid, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        for r in rows:
            assert np.interp(r["t"], grid, area / area[-1]) == pytest.approx(r["x"], abs=1e-4)


def test_lm_scores(spark, cases):
    d, rows = cases
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = lambda t: WORD_RE.findall(lower_ascii(t or "")) + ["\n"]
    counts = defaultdict(int)
    for i, t, *_ in rows:
        if crc(i) != 1:
            for w in tokens(t):
                counts[w] += 1
    total, kinds = sum(counts.values()), len(counts)
    got = lm_scoring.score_documents(d, lm_scoring.fold("doc_id", 5) != 1, head=100, warm_docs=10).collect()
    want = sorted((len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t)), 6)) for _, t, *_ in rows)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == total and np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_scoring.score_documents(empty(spark), F.lit(True)).isEmpty()


def test_lm_is_normalised():
    r = np.random.default_rng(1)
    model = lm_scoring.start(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    ctx = r.integers(0, lm_scoring.CLASSES, (1, lm_scoring.CONTEXT)).repeat(lm_scoring.CLASSES, 0)
    assert (10 ** lm_scoring.log10_classes(model, np.arange(lm_scoring.CLASSES), ctx)).sum() == pytest.approx(1, abs=1e-4)


def test_toxicity_held_out(spark, cases):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        bad, w = k % 5 == 0, prose(r, 40).split()
        if bad:
            w[r.randint(0, 39)] = r.choice(["idiot", "vequna", "vequlo", "vequti"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = {q["doc_id"]: q for q in toxicity.score_documents(d, y).collect()}
    held = [(k, t) for k, t in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k]["predicted"] == t for k, t in held) / len(held) > 0.95
    odd = toxicity.score_documents(cases[0], y, names=("__s", "__p")).collect()
    assert len(odd) == len(cases[1]) and all(0 <= q["__s"] <= 1 for q in odd)
    assert toxicity.score_documents(d, y.limit(0)).count() == 400 and toxicity.score_documents(d.limit(0), y).isEmpty()


def test_toxicity_query_and_clashing_names(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(q["held_out"] == (zlib.crc32(str(q["doc_id"]).encode()) % 4 == 2) and q["predicted"] == int(q["score"] >= 0.3) and 0 <= q["score"] <= 1 for q in got)
    d = spark.createDataFrame([(1, "you idiot", 9.0, "x"), (1, "you idiot", 9.0, "x"), (2, None, None, None)], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([], "ident long, bad int")
    out = toxicity.score_documents(d, labels, label_id="ident", label_col="bad")
    assert out.columns == ["doc_id", "text", "score", "predicted"] and len(out.select("score", "predicted").collect()) == 3


def test_words_of_letters():
    r = random.Random(7)
    for _ in range(5000):
        t = "".join(r.choice("abZÉß 1_²«»\xa0\u2019.\n-İ٣ªǅ") for _ in range(r.randint(0, 14)))
        assert toxicity.words(t) == re.findall(r"[^\W\d_]+", t.lower())


def test_disguised_seeds_and_long_texts():
    assert toxicity.disguised_seed("you id1ot.") and toxicity.disguised_seed("such stup!d words") and not toxicity.disguised_seed("mail45@example.org a1b2 3com 4you")
    lexicon = toxicity.Lexicon({f"word{a}": 3.0 for a in "abcdefghij"})
    text = " ".join(f"word{'abcdefghij'[k % 10]}" for k in range(100_000))
    ws = toxicity.words(text)
    cols, votes = lexicon.document(text, ws, lexicon.hits(set(ws)))
    assert len(votes) == toxicity.N_VOTERS and set(range(10)) <= set(cols)


def test_toxicity_keeps_every_token_that_passes(spark):
    words = [f"{a}{b}{c}rimo" for a in "bdfgklmn" for b in "aeiou" for c in "bdfgklmnprst"]
    rows = [(" ".join(words[k % 40 :: 40]), 1) for k in range(200)] + [("plain harmless prose", 0)] * 200
    got = toxicity.mine(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(words) == 480 and set(words) <= set(got.index)


def removed_by_brute_force(rows):
    """Per id, the sorted figures of its rows."""
    first, want = {}, defaultdict(list)
    data = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t, *_ in rows]
    for o, _, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(o, first.get(b[k : k + 50], o))
    for o, i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < o:
                gone[k : k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i].append((len(b), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in want.items()}


def removed(d, **options):
    got = defaultdict(list)
    for q in suffix_dedup.remove_repeats(d, **options).collect():
        got[q["doc_id"]].append((q["n_bytes"], q["n_removed"], q["n_spans"], q["kept_sha256"]))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("crowd", [4096, 2])
def test_suffix_dedup_against_brute_force(spark, cases, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4000)
    d, rows = cases
    assert removed(d, crowd=crowd) == removed_by_brute_force(rows)
    assert suffix_dedup.remove_repeats(empty(spark)).isEmpty()


def test_suffix_dedup_of_one_passage_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    r = random.Random(21)
    passage = prose(r, 30)
    rows = [(k, prose(r, r.randint(0, 20)) + passage[r.randint(0, 9) :] + "é" * (k % 3) + prose(r, r.randint(0, 20))) for k in range(90)] + [(3, passage), (4, passage[:50]), (5, passage[:49])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(d, crowd=10) == removed(d) == removed_by_brute_force(rows)


def test_passages_cover_every_start_once():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 3, 49, 50, 51, 400, 70_000]))) for _ in range(25)]
    ends = np.cumsum([0] + [len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    anchor, place, start, count, doc = suffix_dedup.passages(raw, ends, 50)
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(start, count)])
    want = np.concatenate([np.arange(ends[k], ends[k + 1] - 49) for k in range(len(texts))])
    assert (at == want).all() and ((place >= start + count - 1) & (place + 16 <= start + 50)).all()
    named = dict()
    for a, s, n in zip(anchor.tolist(), start.tolist(), count.tolist()):
        for k in range(s, s + n):
            assert named.setdefault(raw[k : k + 50].tobytes(), a) == a


def test_merged_transforms_find_equal_prefixes():
    r = random.Random(6)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(12, 40))) for _ in range(60)]
    lows, bounds = suffix_dedup.lowest_ids(texts, np.arange(60), 8, shard=64)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert lows[a:b].tolist() == [min(k for k, u in enumerate(texts) if t[s : s + 8] in u) for s in range(len(t) - 8 + 1)]


def test_html():
    model = html_text.default_model()
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>A title &amp; more</h1><p><b>First  words of\n the text go on here.<br><p>Second part of it, with an end.</p></article><div class='comments'><p>Nice post, I liked it.</p></div><footer>&copy; x</footer>"
    assert html_text.main_text(page, model) == "A title & more\n\nFirst words of the text go on here.\n\nSecond part of it, with an end."
    assert html_text.main_text(None, model) == html_text.main_text("", model) == html_text.main_text("<p>", model) == ""
    assert html_text.blocks_of("<b>" * 50000 + "x" + "</i>" * 50000)[0][0] == "x"
    held = html_text.labelled_blocks(html_text.labelled_pages(60, seed=77))
    wrong = sum(a != b for f, y in held for a, b in zip(model.decode(f), y))
    assert wrong <= 0.02 * sum(len(y) for _, y in held)


def test_html_extraction_through_spark(spark):
    page = "<nav><a href='/a'>Home</a></nav><article><h1>One title here</h1><p>Some words of an article, ending here.</p></article>"
    rows = [(k, f"u{k}", p, "x", 7) for k, p in enumerate([page, page, None, "", "<p>", "<!" * 20000 + page, "a < b <! unclosed", page * 50])] + [(None, None, page, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(q) for q in html_text.extract(d).collect()), key=repr)
    model = html_text.default_model()
    assert got == sorted(((i, u, html_text.main_text(p, model), len(html_text.main_text(p, model))) for i, u, p, *_ in rows), key=repr)
    assert html_text.main_text(page, model) == "One title here\n\nSome words of an article, ending here." and html_text.extract(d.limit(0)).isEmpty()


def test_unclosed_declarations_take_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        html_text.blocks_of("<!" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(400_000) < 1


def components_by_brute_force(rows, width=4):
    """(id, set size, smallest id reachable) of each row, and the number of groups."""
    sets = []
    for _, t, *_ in rows:
        w = WORD_RE.findall(lower_ascii(t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    lowest = {}
    for k, (i, *_) in enumerate(rows):
        lowest[find(k)] = min((x for x in (i, lowest.get(find(k))) if x is not None), default=None)
    return sorted(((i, len(sets[k]), lowest[find(k)]) for k, (i, *_) in enumerate(rows)), key=repr), len({find(k) for k in range(len(rows)) if sets[k]}) + sum(not s for s in sets)


def test_near_duplicates_against_brute_force(spark, cases):
    d, rows = cases
    want, groups = components_by_brute_force(rows)
    got = sorted(((q["id"], q["n"], q["component"]) for q in near_dedup.group_documents(d, width=4).collect()), key=repr)
    assert got == want
    kept = near_dedup.drop_near_duplicates(d, width=4)
    assert kept.columns == d.columns and kept.count() == groups
    assert near_dedup.group_documents(empty(spark)).isEmpty() and near_dedup.drop_near_duplicates(empty(spark)).isEmpty()


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Copies far and near around a base, a chain in which only neighbours link, and a shared passage."""
    r = random.Random(12)
    words = lambda n: prose(r, n).split()
    base, rows = words(90), []
    for k in range(120):
        t = list(base)
        for _ in range(k % 9):
            t[r.randrange(len(t))] = f"edit{r.randrange(10 ** 6)}"
        rows.append(" ".join(t))
    chain = words(160)
    rows += [" ".join(chain[4 * k : 4 * k + 80]) for k in range(20)]
    passage = words(40)
    rows += [" ".join(passage + words(r.randint(2, 60))) for _ in range(60)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    d, want = spark.createDataFrame(rows, "doc_id long, text string"), components_by_brute_force(rows)[0]
    assert sorted(((q["id"], q["n"], q["component"]) for q in near_dedup.group_documents(d, width=4).collect()), key=repr) == want
    monkeypatch.setattr(near_dedup.link_classes, "__defaults__", (0,))  # hubs to the end
    assert sorted(((q["id"], q["n"], q["component"]) for q in near_dedup.group_documents(d, width=4).collect()), key=repr) == want


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, "one two three four five six", 7, b"x", 3), (2, "one two three four five six", 8, b"y", 4), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int, key binary, c0 int")
    assert sorted(map(tuple, near_dedup.drop_near_duplicates(d).collect())) == [tuple(rows[0][:3]) + (bytearray(b"x"), 3), rows[2]]


def test_unrelated_texts_of_one_id_both_stay(spark):
    r = random.Random(9)
    a, b = prose(r, 60), prose(r, 60)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert sorted(map(tuple, kept.collect())) == sorted([(1, a), (1, b)])


def test_similar_sets_share_a_band():
    r = np.random.default_rng(3)
    shared = []
    for _ in range(3000):
        x = r.integers(0, 2**63, 180).astype(np.uint64)  # 160 of 200 in common
        a, b = (near_dedup.registers(v).reshape(near_dedup.BANDS, -1) for v in (x, np.concatenate([x[20:], r.integers(0, 2**63, 20).astype(np.uint64)])))
        shared.append(int((a == b).all(1).sum()))
    assert min(shared) >= 1 and abs(np.mean(shared) - near_dedup.BANDS * 0.8**5) < 0.2


def test_bitmaps_differ_in_no_more_bits_than_sets():
    r = np.random.default_rng(4)
    for n in (5, 150, 5000):
        x = r.integers(0, 2**64, n, dtype=np.uint64)
        a, b = np.unique(x[: n * 4 // 5]), np.unique(x[n // 3 :])
        differ = sum(int(v).bit_count() for v in (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64))
        assert 0 < differ <= len(np.setxor1d(a, b))


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = near_dedup.registers(x[:2000]), near_dedup.registers(x[400:2400])
    assert (np.maximum(a, b) == near_dedup.registers(x[:2400])).all()
    est = near_dedup.likely(a[None], b[None], np.array([2000]), np.array([2000]))[0]
    assert abs(est - 1600 / 2400) < 0.15


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {q["node"]: q["root"] for q in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100}
    with pytest.raises(RuntimeError):
        components.components(edges, most=1)


def test_bpe_equals_the_library(spark, cases):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.located(bpe.VOCABULARY))
    d, rows = cases
    extra = ["a<|endoftext|>b <|startoftext|><|endoftext|>", "it's I'M we'LL x\xa0y\x1cz é ½ ２ 🙂👍🏽 İstanbul ǅ", "aaaaaaaa" * 40, "</w> ẛʼn ﬁ ﻿ ŉ ß"]
    coder = bpe.WordCoder(bpe.VOCABULARY, cache=20_000)
    for x in [r[1] or "" for r in rows] + extra:
        e = t.encode(x, add_special_tokens=False)
        assert coder.encode([x])[0] == (struct.pack(f"<{len(e.ids)}I", *e.ids), t.decode(e.ids, skip_special_tokens=False).encode())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe.digests(d).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(empty(spark)).isEmpty()
