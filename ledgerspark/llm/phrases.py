"""Phrase mining: id n-grams as fixed-width binary keys, range-partitioned, radix-sorted, run-length counted.

1. `blocks`: documents are cut into blocks of a few MB of one language; a block
   keeps its words once, their counts, and the text as codes of them (0 breaks).
2. `dictionary`: words with ``least`` occurrences in their language get dense
   ids; only such words can be in a phrase with ``least`` occurrences. A block's
   ids come back to it by a join of its distinct words, not of its tokens, so
   no size of the dictionary changes the plan and nothing of it is broadcast.
3. `packed`: in a block, other words break pieces as well; windows of two to four
   ids become keys of 128 bits (32 for each id, 0 for none), radix-sorted and
   run-length counted at once, so that a hot phrase leaves one entry a block.
4. `counted`: keys are partitioned by ranges. A key's range is its place in the
   product of the words' distributions, (start(first) + f(first) start(second) /
   F) / F with start the running sum of f: monotone in the key, even where a
   first word is hot, and known without sampling. Each range merges its entries
   by radix sort and run lengths.
5. `phrases`: cuts, scores and containment are joins and group-bys on the keys of
   the candidates; the best of a language are found in levels of salted windows.

Scores are exact (decimals of 38 digits). Ids have 32 bits: a corpus with 2^32
frequent words raises an error.

Defined cases: a null text is empty and an empty one adds nothing; a null lang
is ``und`` (together with rows that say so); repeated rows count each time; a
text of any length is read whole, in slices that overlap; ties are settled by
a, then by the bytes of the phrase; an empty table gives an empty result; ids
and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_ascii, map_arrow, materialize, table, trim

BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rf"[{BREAKS}]|[^ \t{BREAKS}]+")
LONGEST = 4
BLOCK_BYTES = 4 << 20
SLICE_WORDS = 1 << 19
RANGE_KEYS = 2 << 20
GROUP_ROWS = 1 << 16


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(memoryview(np.ascontiguousarray(values)).cast("B"), codec="zstd", asbytes=True) if len(values) else b""


def opened(blob: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd"), kind) if size else np.zeros(0, kind)


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, lang, text) to a row for each language of a batch; code 0 breaks, words count from len(BREAKS)."""
    for batch in batches:
        by: dict[str, tuple[int, dict[str, int], list[np.ndarray]]] = {}
        for row, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            _, ids, found = by.setdefault(lang, (row, dict.fromkeys(BREAKS, 0), []))
            tokens = TOKEN.findall(lower_ascii(text))
            found.append(np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.uint32, len(tokens)))
            found.append(np.zeros(1, np.uint32))
        out: dict[str, list] = {"block": [], "lang": [], "size": [], "codes": [], "words": [], "counts": []}
        for lang, (row, ids, found) in by.items():
            codes = np.concatenate(found)
            for name, value in zip(out, (row, lang, len(codes), squeezed(codes), list(ids)[len(BREAKS) :], np.bincount(codes, minlength=len(ids))[len(BREAKS) :])):
                out[name].append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (lang, word, f): the partition, the place in it, and the running sum of f before it."""
    part, place, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        f = batch.column(2).to_numpy()
        start = before + np.cumsum(f) - f
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(f), part)), pa.array(place + np.arange(len(f))), pa.array(start)], ["lang", "word", "f", "part", "place", "start"])
        place, before = place + len(f), before + int(f.sum())


def dictionary(blocks: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(lang, word, f, id, start) of the frequent words, ids from 1, and the sum of all f."""
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    held = materialize(map_arrow(words.where(F.col("f") >= least), placed, "lang string, word string, f long, part long, place long, start long", rows=50_000), "dictionary")
    offsets, ids, total = [], 1, 0
    for r in sorted(held.groupBy("part").agg(F.count("*").alias("n"), F.sum("f").alias("f")).collect()):  # a row for each partition
        offsets.append((r["part"], ids, total))
        ids, total = ids + r["n"], total + r["f"]
    if ids >= 1 << 32:
        raise ValueError(f"{ids} frequent words do not fit ids of 32 bits")
    known = held.sparkSession.createDataFrame(offsets, "part long, first long, base long")
    found = held.join(F.broadcast(known), "part")
    return found.select("lang", "word", "f", (F.col("first") + F.col("place")).alias("id"), (F.col("base") + F.col("start")).alias("start")), total


def radix_order(*columns: np.ndarray) -> np.ndarray:
    """The stable order of rows by columns of 64 bits, most significant first: a pass for each 16 bits that differ."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        differ = np.bitwise_or.reduce(column ^ column[0]) if len(column) else 0
        for shift in (0, 16, 32, 48):
            if int(differ) >> shift & 0xFFFF:
                order = order[np.argsort((column[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


def run_lengths(high: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys as one, in order, with the sum of their counts."""
    if not len(high):
        return high, low, count
    order = radix_order(high, low)
    high, low, count = high[order], low[order], count[order]
    heads = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[heads], low[heads], np.add.reduceat(count, heads)


def windows(ids: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of two to four ids that start before `last` and hold no 0."""
    highs, lows = [], []
    for width in range(2, LONGEST + 1):
        n = min(last, len(ids) - width + 1)
        if n <= 0:
            break
        good = ids[:n] > 0
        for k in range(1, width):
            good &= ids[k : n + k] > 0
        at = np.flatnonzero(good)
        highs.append(ids[at] << np.uint64(32) | ids[at + 1])
        lows.append((ids[at + 2] << np.uint64(32) if width > 2 else np.zeros(len(at), np.uint64)) | (ids[at + 3] if width > 3 else np.uint64(0)))
    return (np.concatenate(highs), np.concatenate(lows)) if highs else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def packed(total: int, ranges: int):
    """(size, codes, n_words, [local code, id, f, start]) of blocks to (range, n, highs, lows, counts), highs as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, blob, n_words, known in zip(*(batch.column(k) for k in range(4))):
                known, n_words = known.values, n_words.as_py()
                local, own, f, start = (known.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                ids = np.zeros(len(BREAKS) + n_words, np.uint64)
                ids[local] = own.astype(np.uint64)
                # by id, for the ranges of keys
                by_id = np.argsort(own)
                own, f, start = own[by_id].astype(np.uint64), f[by_id].astype(float), start[by_id].astype(float)
                sequence = ids[opened(blob.as_py(), size.as_py(), np.uint32)]
                for at in range(0, len(sequence), SLICE_WORDS):
                    high, low = windows(sequence[at : at + SLICE_WORDS + LONGEST - 1], SLICE_WORDS)
                    if not len(high):
                        continue
                    high, low, count = run_lengths(high, low, np.ones(len(high), np.int64))
                    first, second = np.searchsorted(own, high >> np.uint64(32)), np.searchsorted(own, high & np.uint64(0xFFFFFFFF))
                    place = (start[first] + f[first] * (start[second] / total)) / total
                    to = np.minimum((place * ranges).astype(np.int64), ranges - 1)
                    heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                    out = [(int(to[a]), int(b - a), squeezed(np.diff(high[a:b], prepend=np.uint64(0))), squeezed(low[a:b]), squeezed(count[a:b].astype(np.uint32))) for a, b in zip(heads, [*heads[1:], len(to)])]
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["range", "n", "highs", "lows", "counts"])

    return run


def count_range(least: int):
    """The keys of a range that have `least` occurrences, as big-endian bytes without the empty ids, and their counts."""

    def run(group: pa.Table) -> pa.Table:
        parts, waiting = [], 0
        for n, highs, lows, counts in zip(*(group.column(k).to_pylist() for k in range(1, 5))):
            parts.append((np.cumsum(opened(highs, n, np.uint64), dtype=np.uint64), opened(lows, n, np.uint64), opened(counts, n, np.uint32).astype(np.int64)))
            waiting += n
            if waiting > 2 * RANGE_KEYS:  # copies of a key become one before more are read
                parts = [run_lengths(*(np.concatenate(c) for c in zip(*parts)))]
                waiting = len(parts[0][0]) // 2
        high, low, count = run_lengths(*(np.concatenate(c) for c in zip(*parts)))
        often = count >= least
        high, low, count = high[often], low[often], count[often]
        raw = np.stack([high, low], 1).astype(">u8").tobytes()
        width = np.where(low == 0, 8, np.where(low & np.uint64(0xFFFFFFFF) == 0, 12, 16)).tolist()
        keys = [raw[16 * k : 16 * k + w] for k, w in enumerate(width)]
        trim()
        return pa.table({"key": pa.array(keys, pa.binary()), "a": pa.array(count)})

    return run


def part(key, first, size):
    """`size` ids of a key from the `first` on (from 0)."""
    return F.substring(key, first * 4 + 1, size * 4)


def best_of(rows: DataFrame, per, order: list, best: int) -> DataFrame:
    """The `best` rows of each `per` with their rank: windows over salted groups of about GROUP_ROWS rows, level by level."""
    groups = rows.count() // GROUP_ROWS + 1
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    while groups > 1 and 2 * best <= GROUP_ROWS:
        w = Window.partitionBy(per, "__group").orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)
        groups = -(-groups * best // GROUP_ROWS)
        rows = rows.withColumn("__group", F.pmod(F.col("__group"), F.lit(groups)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= best).drop("__group")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 30, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text")).where(F.octet_length("text") > 0)
    blocks = materialize(map_arrow(rows, coded, "block long, lang string, size long, codes binary, words array<string>, counts array<long>", rows=1 << 20, size=BLOCK_BYTES), "blocks")
    words, total = dictionary(blocks, least)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (LONGEST - 1) * total // RANGE_KEYS)
    own = blocks.select("block", "lang", F.posexplode("words").alias("local", "word")).join(words, ["lang", "word"])
    own = own.groupBy("block").agg(F.collect_list(F.struct((F.col("local") + len(BREAKS)).alias("local"), "id", "f", "start")).alias("known"))
    ready = blocks.select("block", "size", "codes", F.size("words").alias("n_words")).join(own, "block").select("size", "codes", "n_words", "known")
    entries = map_arrow(ready, packed(total, ranges), "range long, n long, highs binary, lows binary, counts binary", rows=1)
    found = materialize(entries.groupBy("range").applyInArrow(count_range(least), "key binary, a long"), "phrases").withColumn("size", (F.octet_length("key") / 4).cast("int"))
    return ranked(found, words, blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")), best)


def ranked(found: DataFrame, words: DataFrame, sizes: DataFrame, best: int) -> DataFrame:
    """Scores of the counted phrases (key, a, size), those inside more frequent longer ones dropped, and the best of each language."""
    key = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    counts = found.select("key", "a").unionByName(words.select(key.alias("key"), F.col("f").alias("a")))
    cuts = found.select("key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": part(F.col("key"), F.lit(0), F.col("k")), "right": part(F.col("key"), F.col("k"), F.col("size") - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    wide = lambda c: c.cast("decimal(38,0)")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("key").agg(F.first("a").alias("a"), F.first("size").alias("size"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = found.where("size > 2").select("a", "size", "key", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inside = inside.select("a", "key", "length", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("length"))).alias("at"))
    inside = inside.groupBy(part(F.col("key"), F.col("at"), F.col("length")).alias("key")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, "key", "left").where(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * 80))
    kept = kept.select("key", "a", "size", F.col("cut.score").alias("score"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))
    spelt = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: part(F.col("key"), k, F.lit(1)))).alias("at", "word_key"))
    spelt = spelt.join(words.select(key.alias("word_key"), "lang", "word"), "word_key").groupBy("key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    named = materialize(kept.join(spelt, "key").select("key", "lang", F.concat_ws(" ", F.col("spelt.word")).alias("phrase"), "a", "l", "r", "score"), "named")
    top = best_of(named, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], best)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece,
    generate_subscripts(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+'), 1) AS place
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, doc_id, place, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS w1, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS pos FROM t
), s AS (
  SELECT *, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY doc_id, place ORDER BY pos)
), n AS (
  SELECT lang, count(*) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, [w1] AS p, count(*) AS f FROM s GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM s WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), x AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM c WHERE len(p) > 1
), y AS (
  SELECT x.lang, x.p, x.a, x.k, l.f AS l, r.f AS r, (2000000::HUGEINT * x.a) // (l.f + r.f) AS score
  FROM x JOIN c l ON l.lang = x.lang AND l.p = x.p[1:x.k] JOIN c r ON r.lang = x.lang AND r.p = x.p[x.k + 1:]
), z AS (
  SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(f) AS longer FROM c, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) v(i, m) WHERE m < len(p) AND i + m - 1 <= len(p) GROUP BY ALL
), kept AS (
  SELECT z.* FROM z LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a
), best AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""
