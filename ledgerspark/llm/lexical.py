"""Ranked lexical search with integer scores over a term-bucketed postings table.

Terms are the maximal runs of ASCII letters, digits and code points beyond
ASCII; only A-Z are lower-cased. `index` writes one posting per document and
term, bucketed by (term, block of documents), so that a term that every document
holds is spread over as many buckets as there are blocks; a block has about
2^14 documents. `search` joins the items' terms (one row for each block), sums
document frequencies, deals the matched postings out by document, expands them
to the items in blocks of at most `ITEM_ROWS` (item, term) rows, each of which
is broadcast, sums per item and document without a further shuffle, and numbers
the best by a window.

Scores, all in 64-bit integers but the weight: w = floor(1000 ln((2N+2)/(2df+1))),
m = 50 + (50 n N) div L, score = sum of w ((10^9 tf) div (1000 tf + 20 m)). A
term with w = 0 adds nothing and is left out of the expansion.

Defined cases: documents and items that are null or have no term match nothing
and count neither in N nor in L; each row is a document of its own, also where
ids repeat or are null (equal scores then go by id, nulls last, then by row);
items with one id are ranked as one item with the terms of both; an item with a
null id is ranked like any other; empty tables give an empty result; columns of
other names are not read; texts are read whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import delete_folder, lower_ascii, map_arrow, materialize, shared_dir, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK_DOCS = 1 << 14
ITEM_ROWS = 1 << 18


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(lower_ascii(text)) if text else []


def document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, text) to (row, id, n, terms, tfs), for documents that have a term."""
    for batch in batches:
        keep, size, terms, counts = [], [], [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            found = terms_of(text)
            if found:
                tf = Counter(found)
                keep.append(k)
                size.append(len(found))
                terms.append(list(tf))
                counts.append(list(tf.values()))
        at = pa.array(keep, pa.int64())
        arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "n", "terms", "tfs"])


@dataclass
class Postings:
    """The index: its bucketed table, its blocks and the corpus figures N and L."""

    rows: DataFrame
    name: str
    path: str
    buckets: int
    blocks: int
    documents: int
    terms: int

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_folder(self.rows.sparkSession, self.path)


def block_of(row, blocks: int):
    return F.pmod(F.xxhash64(row), F.lit(blocks))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Postings:
    """Postings (term, block, row, id, tf, n) of all rows, bucketed by term and block."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = 1 + docs.count() // BLOCK_DOCS
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = map_arrow(rows, document_terms, f"row long, id {kind}, n long, terms array<string>, tfs array<long>", size=2 << 20)
    postings = found.select("row", "id", "n", block_of("row", blocks).alias("block"), F.posexplode(F.arrays_zip("terms", "tfs")).alias("place", "posting"))
    # the first posting of a document stands for it where N is counted
    postings = postings.select(F.col("posting.terms").alias("term"), "block", "row", "id", F.col("posting.tfs").alias("tf"), "n", (F.col("place") == 0).alias("first"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(50_000, blocks))
    name = f"postings_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    postings.repartition(buckets, "term", "block").write.option("compression", "zstd").option("path", path).bucketBy(buckets, "term", "block").saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    rows = spark.table(name)
    n, total = rows.agg(F.coalesce(F.count_if("first"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    return Postings(rows, name, path, buckets, blocks, n, total)


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(dict.fromkeys(terms_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["item", "terms"])


def search(postings: Postings, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, best: int = 50) -> DataFrame:
    """(item, rank, id, score): each item's best documents of the index, which may be dropped afterwards."""
    spark, kind = items.sparkSession, items.schema[id_col].dataType.simpleString()
    asked = map_arrow(items.select(items[id_col].alias("item"), items[text_col].alias("text")), item_terms, f"item {kind}, terms array<string>")
    asked = materialize(asked.select("item", F.explode("terms").alias("term")).distinct(), "item-terms")
    # a term's row for each block meets the postings of that block only
    wanted = asked.select("term").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(postings.blocks - 1).cast("long"))))
    matched = materialize(postings.rows.join(wanted, ["term", "block"]).select("term", "row", "id", "tf", "n"), "matched")
    weights = matched.groupBy("term").agg(F.count("*").alias("df"))
    n, total = postings.documents, max(postings.terms, 1)
    weights = weights.select("term", F.floor(F.log((2.0 * n + 2) / (2 * F.col("df") + 1)) * 1000).cast("long").alias("w")).where("w > 0")
    numbered = numbered_rows(asked.join(weights, "term"))
    dealt = matched.withColumn("m", F.lit(50) + F.expr(f"(50L * n * {n}L) div {total}L"))
    dealt = dealt.select("term", "row", "id", F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)").alias("x")).repartition("row")
    parts = []
    for at in range(0, max(1, numbered.total), ITEM_ROWS):
        some = numbered.rows.where((F.col("number") >= at) & (F.col("number") < at + ITEM_ROWS)).select("term", "item", "w")
        parts.append(dealt.join(F.broadcast(some), "term").groupBy("item", "row").agg(F.first("id").alias("id"), F.sum(F.col("w") * F.col("x")).alias("score")))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    if len(parts) > 1:  # an item may lie across two blocks
        scored = scored.groupBy("item", "row").agg(F.first("id").alias("id"), F.sum("score").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("item", "rank", "id", "score")


@dataclass
class Numbered:
    rows: DataFrame
    total: int


def numbered_rows(rows: DataFrame) -> Numbered:
    """rows with consecutive numbers from 0 in the column `number`: a written table's partitions, offset by their sizes."""
    own = F.monotonically_increasing_id()
    held = materialize(rows.select("*", F.shiftright(own, 33).alias("__part"), own.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "numbered")
    sizes = sorted((r["__part"], r["count"]) for r in held.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    known = held.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    return Numbered(held.join(F.broadcast(known), "__part").withColumn("number", F.col("__offset") + F.col("__place")).drop("__part", "__place", "__offset"), total)


def query(spark, sf_dir: str) -> DataFrame:
    postings = index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = search(postings, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    postings.drop()  # search has written what it matched
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
), size AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), all_docs AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, all_docs GROUP BY term, docs
), x AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN size USING (doc_id), all_docs GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
