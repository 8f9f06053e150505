"""Language identification by language-bitmask n-gram filters.

One Bloom filter per learned language, bit-sliced: slot s of the shared array
holds a bitmask with bit l set if language l's filter has bit s. Three probes of
an n-gram, and-ed, give all languages whose filters contain it at once. A text's
n-grams are looked up, the bits are counted per language, and each count is
corrected for its filter's false positives (fill ** probes); the language with
the largest corrected count is predicted, of equal ones the first by name.

n-grams are of three and four code points of a lower-cased word between spaces;
a word is a run of letters. A language's filter holds the n-grams that at least
``min_docs`` of its documents have and whose share of the language's n-grams is
at least ``ratio`` of the largest share in any language.

Training reads about ``max_labelled`` distinct texts of each language (all,
where there are fewer), drawn by hash. The filter has at most ``MAX_SLOTS`` slots.

Defined cases: a null text and one without a letter give ``und`` and 0, as does
every text if nothing was learned; a text with letters none of whose n-grams is
known gets the first language by name and 0; equal texts get equal results;
repeated rows stay; an empty table gives an empty result; other columns are not
read; long texts are read whole, in chunks of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fold, map_arrow, materialize, table

WIDTHS = (3, 4)
PROBES = 3
MAX_SLOTS = 1 << 24
CHUNK = 1 << 19


@cache
def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the text's n-grams, every occurrence, in chunks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), CHUNK):
        # a window belongs to the chunk where it starts; one blank stands before the first and after the last
        part = np.zeros(min(CHUNK, len(codes) - at) + max(WIDTHS), np.uint64)
        here = codes[max(at - 1, 0) : at + CHUNK + max(WIDTHS) - 1]
        start = int(at == 0)
        part[start : start + len(here)] = np.where(letters()[here], here, 0)[: len(part) - start]
        for width in WIDTHS:
            n = min(CHUNK, len(codes) - at) + (1 if at + CHUNK >= len(codes) else 0)
            n = min(n, len(part) - width + 1)
            good, h = np.ones(n, bool), np.full(n, width, np.uint64)
            for k in range(width):
                c = part[k : k + n]
                if 0 < k < width - 1:
                    good &= c > 0
                h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            if n:
                yield h[good]


@dataclass
class Filters:
    """slots[s]: the bitmask of the languages (words of 8 bits) whose filter has bit s."""

    names: list[str]
    slots: np.ndarray

    def __post_init__(self) -> None:
        fill = np.array([(self.slots[:, k // 8] >> (k % 8) & 1).mean() for k in range(len(self.names))])
        self.false = np.minimum(fill**PROBES, 0.999)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """How many of the text's n-grams each filter has, and how many there are."""
        found, total = np.zeros(len(self.names)), 0
        values = np.arange(256)[:, None] >> np.arange(8) & 1
        for h in grams(text):
            total += len(h)
            masks = self.slots[probe(h, 0, len(self.slots))]
            for k in range(1, PROBES):
                masks &= self.slots[probe(h, k, len(self.slots))]
            for byte in range(self.slots.shape[1]):
                seen = np.bincount(masks[:, byte], minlength=256) @ values
                found[8 * byte : 8 * byte + 8] += seen[: len(self.names) - 8 * byte]
        return found, total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return "und", 0.0
        found, total = self.counts(text)
        if not total:
            return "und", 0.0
        likely = np.clip((found - total * self.false) / (1 - self.false), 0, None)
        best = int(np.argmax(likely))
        return self.names[best], float(likely[best] / likely.sum()) if likely[best] > 0 else 0.0


def probe(h: np.ndarray, k: int, slots: int) -> np.ndarray:
    return ((h >> np.uint64(8)) + np.uint64(k) * (h >> np.uint64(35) | np.uint64(1))) & np.uint64(slots - 1)


def drawn_per_language(rows: DataFrame, want: int) -> DataFrame:
    """About `want` distinct texts of each language by hash; all of one that has fewer rows.

    A text goes by its own hash and stays once, so copies weigh nothing, however
    many. The broadcast has a row for each language, as the model itself has.
    """
    sizes = [(r["lang"], min(1.0, (want + 10 * want**0.5) / r["count"])) for r in rows.groupBy("lang").count().collect()]
    shares = rows.sparkSession.createDataFrame(sizes, "lang string, __share double")
    chosen = F.pmod(F.xxhash64(F.lit(71), "text"), F.lit(1 << 31)) <= F.col("__share") * (1 << 31)
    return rows.join(F.broadcast(shares), "lang").where(chosen).select("lang", "text").dropDuplicates()


def document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents of the batch with it) of batches of (lang, text)."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if found := list(grams(text)):
                by.setdefault(lang, []).append(np.unique(np.concatenate(found)))
        for lang, found in by.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "docs"])


def train(labelled: DataFrame, *, max_labelled: int = 20_000, min_docs: int = 2, ratio: float = 0.2) -> Filters:
    """Filters from (lang, text), neither of them null."""
    counted = map_arrow(drawn_per_language(labelled, max_labelled), document_grams, "lang string, gram long, docs long", size=1 << 20)
    counted = materialize(counted.groupBy("lang", "gram").agg(F.sum("docs").alias("docs")), "lang-grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("docs").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        return Filters([], np.zeros((1, 1), np.uint8))
    spark = labelled.sparkSession
    known = spark.createDataFrame([(n, k, float(totals[n])) for k, n in enumerate(names)], "lang string, code int, total double")
    shared = counted.join(F.broadcast(known), "lang").withColumn("share", F.col("docs") / F.col("total"))
    most = F.max("share").over(Window.partitionBy("gram"))
    kept = materialize(shared.withColumn("most", most).where((F.col("docs") >= min_docs) & (F.col("share") >= ratio * F.col("most"))).select("code", "gram"), "lang-kept")
    largest = kept.groupBy("code").count().agg(F.max("count")).first()[0] or 1
    slots = min(MAX_SLOTS, max(1 << 12, 1 << int(8 * largest - 1).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy().astype(np.int64)
            h = batch.column(1).to_numpy().view(np.uint64)
            at = np.concatenate([probe(h, k, slots) for k in range(PROBES)]).astype(np.int64)
            code = np.tile(code, PROBES)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(code // 8), pa.array(1 << code % 8)], ["slot", "byte", "bit"])

    # at most MAX_SLOTS rows for eight languages: the model itself
    found = map_arrow(kept, bits, "slot long, byte long, bit long", rows=100_000).groupBy("slot", "byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    filters = np.zeros((slots, (len(names) + 7) // 8), np.uint8)
    filters[found["slot"].to_numpy(), found["byte"].to_numpy()] = found["bits"].to_numpy()
    return Filters(names, filters)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its share of the corrected counts, in the named columns."""
    model = docs.sparkSession.sparkContext.broadcast(filters)
    columns = [c for c in docs.columns if c not in names]
    kept = docs.select(*[docs[c] for c in columns], docs[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.value.predict(t) for t in batch.column("__text").to_pylist()]
            arrays = [batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], [*columns, *names])

    schema = kept.drop("__text").schema.add(names[0], "string").add(names[1], "double")
    return map_arrow(kept, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where((fold("doc_id", 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    filters = train(learned)
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return identify(rows, filters).drop("text")
