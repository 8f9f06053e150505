"""Ranked search, language identification and phrase mining against plain code."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ledgerspark.llm import language_id, lexical, phrases, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_phrase_mining"])
def test_query_equals_its_twin(spark, oracle, name):
    got, rel = queries.QUERIES[name](spark, SF), oracle.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == sorted(tuple(r[rel.columns.index(c)] for c in sorted(rel.columns)) for r in rel.fetchall())


# op11


def searched(rows, items, best):
    """Rows (id, text), items (id, text): the ranks by the rules, a row being a document of its own."""
    term = lambda t: lexical.TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(k, i, Counter(term(t))) for k, (i, t) in enumerate(rows) if term(t)]
    n, total = len(docs), sum(sum(c.values()) for _, _, c in docs)
    df = Counter(t for _, _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for k, i, c in docs:
            size = sum(c.values())
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, k))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical, "ITEM_ROWS", 11)
    r = random.Random(2)
    text = lambda: " ".join(r.choice(["The", "the", "Éa", "b2", "c-d", "x", "rare%d" % r.randint(0, 9), "ÀB"]) for _ in range(r.randint(0, 30)))
    rows = [(k, text()) for k in range(60)] + [(7, text()), (None, "x the"), (100, None), (101, ""), (102, "... !"), (103, "the " * 500), (104, "\x00nul\x00 the")]
    items = [(k, text()) for k in range(6)] + [(90, None), (91, ""), (3, "x c"), (None, "the x"), (92, "nowhere")]
    docs = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, term string, score int").repartition(3)
    asked = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, w int")
    index = lexical.index(docs)
    found = lexical.search(index, asked, best=9)
    index.drop()
    got = sorted([(q["item"], q["rank"], q["id"], q["score"]) for q in found.collect()], key=repr)
    want = searched(rows, items, 9)
    # rows with one id and one score may change places
    assert got == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("postings_")]


def test_search_in_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for docs, items in ((none, some), (some, none), (none, none)):
        index = lexical.index(docs)
        assert lexical.search(index, items, "doc_id").count() == 0
        index.drop()


# op12


def plain_grams(text):
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return [t[k : k + w] for w in language_id.WIDTHS for k in range(len(t) - w + 1) if " " not in t[k + 1 : k + w - 1]]


@pytest.mark.parametrize("chunk", [5, 16, 997, 1 << 19])
def test_grams_do_not_hang_on_chunks(monkeypatch, chunk):
    r = random.Random(1)
    text = "".join(r.choice("ab é zßİ1.") for _ in range(2000))
    whole = np.sort(np.concatenate(list(language_id.grams(text))))
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    got = np.sort(np.concatenate(list(language_id.grams(text))))
    assert (got == whole).all() and len(got) == len(plain_grams(text)) and len(set(got.tolist())) == len(set(plain_grams(text)))


def test_filters_count_like_sets(spark):
    """Looked up bit by bit in sets of slots, and near the true memberships after correction."""
    r = random.Random(3)
    words = {f"l{k:02d}": ["".join(r.choice("abcdefghij"[k % 5 :]) for _ in range(r.randint(2, 7))) for _ in range(150)] for k in range(10)}
    rows = [(lang, " ".join(r.choice(ws) for _ in range(60))) for lang, ws in words.items() for _ in range(25)]
    filters = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    assert filters.names == sorted(words) and filters.slots.shape[1] == 2
    for lang, text in rows[::40] + [("", "zzzz qqqq"), ("", "Ab" * 300)]:
        found, total = filters.counts(text)
        h = np.concatenate(list(language_id.grams(text)))
        assert total == len(h)
        for k in range(10):
            has = lambda x: all(filters.slots[int(language_id.probe(np.array([x], np.uint64), p, len(filters.slots))[0]), k // 8] >> (k % 8) & 1 for p in range(language_id.PROBES))
            assert found[k] == sum(has(x) for x in h)
        if lang:
            name, score = filters.predict(text)
            assert name == lang and 0 < score <= 1
    assert filters.predict(None) == filters.predict("") == filters.predict("12 .. 3") == ("und", 0.0)
    assert filters.predict("ŧŧŧŧ") == (filters.names[0], 0.0) or filters.predict("ŧŧŧŧ")[1] >= 0


def test_language_query(spark):
    got = {q["doc_id"]: q for q in language_id.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= got[d["doc_id"]]["score"] <= 1 for d in docs)
    held = [d for d in docs if got[d["doc_id"]]["held_out"] and d["text"] and any(c.isalpha() for c in d["text"])]
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.98 * len(held)


def test_language_of_odd_tables(spark):
    schema = "lang string, text string"
    assert language_id.train(spark.createDataFrame([], schema)).predict("abc") == ("und", 0.0)
    filters = language_id.train(spark.createDataFrame([("x", "aaa bbb ccc")] * 3 + [("y", "ddd eee fff"), ("y", "ddd eee ggg"), ("x", "aaa bbb")], schema))
    d = spark.createDataFrame([(1, None, "s", 7), (2, "", "s", 7), (3, "aaa bbb", "s", 7), (3, "aaa bbb", "s", 7), (None, "eee ddd " * 40000, "s", 7), (4, "12", "s", 7)], "id long, text string, score string, lang_pred int")
    got = sorted(((q["id"] or 0, q["lang_pred"]) for q in language_id.identify(d, filters).collect()))
    assert got == [(0, "y"), (1, "und"), (2, "und"), (3, "x"), (3, "x"), (4, "und")]
    assert language_id.identify(d.limit(0), filters).count() == 0


# op13


def mined(rows, least, best):
    """Rows (text, lang): the phrases by the rules, counted plainly."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    f[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), p, count[p[:k]], count[p[k:]]))
        for rank, (s, a, text, _, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, text.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("slice_words,best,group", [(3, 7, 5), (50, 2000, 1 << 16)])
def test_phrases_against_plain_counting(spark, monkeypatch, slice_words, best, group):
    monkeypatch.setattr(phrases, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 700)
    monkeypatch.setattr(phrases, "RANGE_KEYS", 300)
    monkeypatch.setattr(phrases, "GROUP_ROWS", group * 8)
    r = random.Random(slice_words)
    word = lambda: r.choice(["a", "A", "b", "é", "\x01c", "a\x01", "d\x1f", "rare%d" % r.randint(0, 60), "of", "the", "the"])
    text = lambda: "".join(word() + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ": "]) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "fr", None, "und"])) for _ in range(120)] + [(None, "en"), ("", None), ("of the of the of the " * 200, "en"), ("New York city hall " * 30, "fr")] * 2
    got = phrases.mine(spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, rank int").repartition(3), least=6, best=best)
    assert sorted(tuple(q[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for q in got.collect()) == mined(rows, 6, best)


def test_phrases_of_an_empty_table(spark):
    for rows in ([], [(None, None)], [("one two three", "en")]):
        assert phrases.mine(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_radix_order_is_stable_and_right():
    r = np.random.default_rng(3)
    for top in (1, 3, 1 << 20, 1 << 63):
        a, b = (r.integers(0, top, 500, dtype=np.uint64) for _ in range(2))
        assert (phrases.radix_order(a, b) == np.lexsort((b, a))).all()
    high, low, n = phrases.run_lengths(np.array([2, 1, 2, 2], np.uint64), np.array([0, 5, 0, 1], np.uint64), np.array([3, 1, 4, 1]))
    assert high.tolist() == [1, 2, 2] and low.tolist() == [5, 0, 1] and n.tolist() == [1, 7, 1]
