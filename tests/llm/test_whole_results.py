"""Whole results of queries against known articles, plain loops and an empty catalog."""

import math
import os
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import html_text, near_dedup, suffix_dedup, toxicity
from ledgerspark.llm.common import SPACES, shared_dir, table

SF = "/root/testdata/sf0.001"
INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "mark", "u", "time", "abbr", "cite", "q", "label"}


class Article(HTMLParser):
    """The blocks of the first article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.done, self.blocks, self.text = 0, 0, False, [], []

    def flush(self):
        words = "".join(" " if c in SPACES else c for c in "".join(self.text)).split(" ")
        if any(words):
            self.blocks.append(" ".join(w for w in words if w))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "article" and not self.done:
            self.inside += 1
        elif self.inside and tag in ("script", "style", "aside", "form", "nav", "footer", "header"):
            self.hidden += 1
        if self.inside and tag not in INLINE and tag != "br":
            self.flush()
        if self.inside and tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if self.inside and tag not in INLINE:
            self.flush()
        if tag == "article" and self.inside:
            self.inside -= 1
            self.done = not self.inside
        elif self.inside and self.hidden and tag in ("script", "style", "aside", "form", "nav", "footer", "header"):
            self.hidden -= 1

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.text.append(data)


def test_html_query_gives_the_articles(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    got = html_text.query(spark, SF).collect()
    assert len(got) == len(pages)
    known = 0
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if "<article" in pages[r["page_id"]]:
            p = Article()
            p.feed(pages[r["page_id"]])
            p.close()
            known += 1
            assert r["text"] == "\n\n".join(p.blocks), r["page_id"]
    assert known >= 0.5 * len(pages)


def test_generated_pages_give_their_known_articles(spark):
    made = list(html_text.labelled_pages(80, seed=1234))
    d = spark.createDataFrame([(k, "u", page) for k, (page, _) in enumerate(made)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(d).collect()}
    right = sum(got[k] == "\n\n".join(article) for k, (_, article) in enumerate(made))
    assert right >= 0.95 * len(made)


def test_unclosed_heads_take_linear_time():
    def took(n):
        began = time.perf_counter()
        html_text.blocks_of("<head>" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(64_000) < 40 * max(took(8_000), 0.005)
    assert html_text.blocks_of("<head><title>t</title><p>one</p>")[-1][0] == "one"


def test_toxicity_scores_by_a_plain_loop(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    lexicon, classifier = model = toxicity.train(docs, labels)
    got = {q["doc_id"]: q["score"] for q in toxicity.score_documents(docs, labels, model=model).collect()}
    for r in docs.collect():
        z = classifier.w[-1]
        for c in toxicity._read([r["text"]], lexicon)[0][0]:
            z += classifier.w[c]
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-z))) < 1e-9
    again = {q["doc_id"]: q["score"] for q in toxicity.query(spark, SF).collect()}
    assert again.keys() == got.keys() and max(abs(again[k] - got[k]) for k in got) < 1e-6


@pytest.mark.parametrize("parts", [1, 5])
def test_gradients_add_up_in_groups(spark, parts):
    r = np.random.default_rng(parts)
    rows = [([int(c) for c in np.flatnonzero(r.random(6) < 0.3)], int(r.integers(1, 5))) for _ in range(200)]
    rows = [(c, n, n * (0.9 if 2 in c else 0.2)) for c, n in rows]
    d = spark.createDataFrame(rows, "cols array<int>, n long, y double").repartition(7)
    w = toxicity.fit(d, 6, parts=parts).w
    plain, speed, penalty = np.zeros(7), np.zeros(7), np.array([1.0] * 6 + [1e-3])
    for _ in range(25):
        at = plain + 0.5 * speed
        gradient, bend = np.zeros(7), np.zeros(7)
        for cols, n, y in rows:
            p = 1 / (1 + math.exp(-(at[-1] + sum(at[c] for c in cols))))
            for c in [*cols, 6]:
                gradient[c] += n * p - y
                bend[c] += n * max(p * (1 - p), 0.01) * (len(cols) + 1)
        new = at - np.clip((gradient + penalty * at) / (bend + penalty), -2, 2)
        speed, plain = new - plain, new
        if np.abs(speed).max() < 1e-4:
            break
    assert np.abs(w - plain).max() < 1e-6


def test_suffix_dedup_leaves_nothing_behind(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    done = suffix_dedup.query(spark, SF)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dealt_")]
    left = {n.split("-")[0] for n in set(os.listdir(folder)) - before}
    assert left <= {"cut"} and done.count() == table(spark, SF, "documents").count()


def test_blocks_of_a_bucket_lose_no_link(spark):
    """One bucket's members met in squares of blocks give the groups that one task gives."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(k % 5):
            words[(7 * k + j) % 60] = f"x{k}{j}"
        rows.append((k, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for block in (3, 1024):
        link = near_dedup.link_classes
        near_dedup.link_classes = lambda *a, b=block, **k: link(*a, **k, block=b)
        try:
            got[block] = sorted((q["id"], q["component"]) for q in near_dedup.group_documents(d, width=2).collect())
        finally:
            near_dedup.link_classes = link
    assert got[3] == got[1024]
