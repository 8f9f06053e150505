"""Near-duplicate documents by SetSketch registers, banding, likelihood and full verification.

A document is the set of its word shingles. Register i of its SetSketch is the
largest of floor(1 - log_b(h)) over its elements' exponential hashes h: an
exponentially spaced, truncated minimum. Registers merge by maximum and agree
between two sets about as often as the sets overlap. Five registers make a
band; documents that share a band value meet in that value's bucket.

Documents with equal sets become one class first. Then buckets are worked off
by hubs. In each round a bucket's hub, its member that meets most others over
all its buckets, is compared with the members of other components; it has then
met all of them and leaves. Components that links join are contracted, buckets
with one component left are closed, and the number of hubs doubles from round
to round. Members that provably link with nobody leave too: of the shingles
that x shares with anyone in an open bucket there are c(x), so a link with y
needs min(c(x), c(y)) to be large enough for both sizes. Once the pairs that are
left are no more than a fixed number for each entry, they are met at once. So
every pair of a bucket is compared, excluded for certain, or already joined; a
large group of near copies costs a few rows per copy and never all its pairs.

A set also has a parity bitmap: the bits in which two bitmaps differ are at most
as many as the shingles in which the sets differ, which excludes pairs for
certain. What is left is estimated by maximum likelihood from both registers and
sizes, and confirmed on the full sets of shingles.

Defined cases: null, blank or empty texts have empty sets and link with nothing;
equal rows fall into one class; a null id has no say in a component's id; an
empty table gives an empty result; columns keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import forget, map_arrow, materialize, table
from .components import components
from .shingles import shingle_set

ROWS, BANDS = 5, 34
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: 34 bands of 5: a pair of similarity 0.8 shares none with probability 1.4e-6, one of 0.85 with 6e-9.
_SEED = np.random.default_rng(20240607)
_A = (_SEED.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _SEED.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of hashed elements; the maximum of two sketches is that of the union."""
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    x = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at : at + 2048] * _A + _B).min(1), out=low)
    h = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


WORDS = 16
BITS = [f"b{k}" for k in range(WORDS)]


def parities(elements: np.ndarray) -> np.ndarray:
    """For each of 1,024 cells whether an odd number of elements falls in it, as 16 longs."""
    odd = np.bincount((elements >> np.uint64(54)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def may_link(a: str, b: str, na, nb, percent: int):
    """Whether the bitmaps (columns under these prefixes) allow sets of these sizes to be similar enough."""
    differ = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in BITS), F.lit(0))
    return differ * (100 + percent) <= (na + nb) * (100 - percent)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each row pair of sketches, given the set sizes.

    With u, v the shares of the sizes, a register is larger on the first side
    with probability p(u - vJ), on the second with p(v - uJ), and equal otherwise,
    where p(x) = -log_b(1 - x (b - 1) / b).
    """
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    score = above * np.log(up + tiny) + below * np.log(down + tiny) + (a.shape[1] - above - below) * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(grid, score.argmax(1)[:, None], 1)[:, 0]


def key_of(elements: np.ndarray) -> bytes | None:
    """Names a set; None names the empty one."""
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def sketched(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """docs with its columns as c0, c1, ... and of each row the set's key, its size, registers (packed), bitmap and a row number.

    Written to the shared folder, so that a row keeps its number.
    """
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(at).to_pylist()]
            more = [pa.array([key_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())]
            bits = np.array([parities(s) for s in sets], np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, *[pa.array(bits[:, k]) for k in range(WORDS)]], [*batch.schema.names, "key", "n", "regs", *BITS])

    schema = StructType([*plain.schema.fields, StructField("key", BinaryType()), StructField("n", LongType()), StructField("regs", BinaryType()), *[StructField(c, LongType()) for c in BITS]])
    return materialize(map_arrow(plain, run, schema).withColumn("row", F.monotonically_increasing_id()), "sketches")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets overlap enough: by bitmaps, by likelihood, then in full. The roots ru, rv go along."""
    slack = percent / 100 - 5 * np.sqrt(0.16 / REGISTERS)
    kept = ["u", "v", "ru", "rv"]

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(likely(a, b, na, nb) >= slack)) for c in kept], kept)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("tu").to_pylist(), batch.column("tv").to_pylist()
            sets = {t: shingle_set(t, width) for t in {*left, *right}}
            hit = []
            for x, y in ((sets[a], sets[b]) for a, b in zip(left, right)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(hit, pa.bool_())) for c in kept], kept)

    schema = "u long, v long, ru long, rv long"
    side = lambda k, x: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), *[F.col(c).alias(x + c) for c in BITS])
    rows = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(may_link("a", "b", F.col("na"), F.col("nb"), percent))
    near = materialize(map_arrow(rows.select(*kept, "na", "nb", "ra", "rb"), estimate, schema), "near")
    full = near.join(texts.toDF("u", "tu"), "u").join(texts.toDF("v", "tv"), "v")
    links = materialize(map_arrow(full.select(*kept, "tu", "tv"), verify, schema, rows=200), "links")
    forget(near)
    return links


def still_open(entries: DataFrame) -> DataFrame:
    """Entries of the buckets in which two components meet."""
    mixed = entries.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).where("lo < hi").drop("lo", "hi")
    return entries.drop("least").join(mixed, "value")


def shared_sizes(entries: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(cid, shared): how many shingles of each class another class of these entries has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), cid)), pa.array(s.view(np.int64))], ["cid", "shingle"])

    left = texts.join(entries.select("cid").distinct(), "cid", "left_semi").select("cid", "text")
    single = map_arrow(left, run, "cid long, shingle long").groupBy("shingle").agg(F.min("cid").alias("cid"), F.count("*").alias("c")).where("c = 1")
    return single.groupBy("cid").agg(F.count("*").alias("alone"))


def fits(n, m, percent: int):
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def link_classes(rows: DataFrame, classes: DataFrame, text: str, width: int, percent: int, each: int = 32, *, block: int = 1024) -> DataFrame:
    """(cid, root) for every class (cid: the row that stands for it, n, regs, bitmap).

    Pairs are met at once when there are at most `each` for every entry of a bucket.
    """
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])
    entries = classes.select("cid", "n", F.explode(bands).alias("value"))
    counted = entries.groupBy("value").agg(F.count("*").alias("met")).where("met > 1")
    shared = materialize(entries.join(counted, "value"), "buckets")
    total = shared.count()
    central = shared.groupBy("cid").agg(F.sum("met").alias("weight"))
    texts = materialize(rows.select(F.col("row").alias("cid"), F.col(text).alias("text")).join(central.select("cid"), "cid", "left_semi"), "texts")
    left = materialize(shared.join(central, "cid").select("value", "cid", "n", "weight", F.col("cid").alias("root")), "open")
    forget(shared)
    roots, hubs_each = classes.select("cid", F.col("cid").alias("root")), 1

    def contract(left: DataFrame, roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        moved = components(links.select(F.col("ru").alias("u"), F.col("rv").alias("v"))).withColumnRenamed("root", "moved_to").withColumnRenamed("node", "root")
        follow = lambda d: d.join(moved, "root", "left").withColumn("root", F.coalesce("moved_to", "root")).drop("moved_to")
        return follow(left), follow(roots)

    while total:
        slot = F.pmod(F.xxhash64(F.lit(hubs_each), "cid"), F.lit(hubs_each))
        hubs = left.groupBy("value", slot.alias("slot")).agg(F.max(F.struct("weight", "cid", "n", "root")).alias("hub")).select("value", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.root").alias("hub_root"))
        hubs = materialize(hubs, "hubs")
        met = left.join(hubs, "value").where((F.col("root") != F.col("hub_root")) & fits(F.col("n"), F.col("hub_n"), percent))
        pairs = met.select(F.least("cid", "hub").alias("u"), F.greatest("cid", "hub").alias("v"), F.least("root", "hub_root").alias("ru"), F.greatest("root", "hub_root").alias("rv")).distinct()
        links = confirmed(pairs, classes, texts, width, percent)
        rest = left.join(hubs.select("value", F.col("hub").alias("cid")), ["value", "cid"], "left_anti")
        rest, roots = contract(rest, roots, links)
        before, left = left, materialize(still_open(rest), "open")
        forget(before, hubs, links)
        if left.isEmpty():
            break
        alone = shared_sizes(left, texts, width)
        known = left.join(alone, "cid", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("c") * (100 + percent) >= (F.col("n") + F.col("least")) * percent)
        before, left = left, materialize(still_open(known.drop("alone")), "open")
        forget(before)
        per_root = left.groupBy("value", "root").agg(F.count("*").alias("c"))
        size = F.col("c").cast("double")
        pairs_left = per_root.groupBy("value").agg(((F.sum(size) * F.sum(size) - F.sum(size * size)) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
        if pairs_left <= each * total:
            # a bucket of m entries becomes a square of blocks, of about `block` entries a side, so that no task meets all its pairs
            sizes = per_root.groupBy("value").agg(F.ceil(F.sum("c") / block).alias("blocks"))
            of = left.join(classes.select("cid", *BITS), "cid").join(sizes, "value").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "cid"), F.col("blocks")))
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
            place = {"u": ("own", "other"), "v": ("other", "own")}
            side = lambda k, x: of.withColumn("other", every).select("value", *[F.col(c).alias(to) for c, to in zip(place[k], ("i", "j"))], F.col("cid").alias(k), *[F.col(c).alias(x + c) for c in ("n", "c", "root", *BITS)])
            can = (F.col("u") < F.col("v")) & (F.col("aroot") != F.col("broot")) & (F.least("ac", "bc") * (100 + percent) >= (F.col("an") + F.col("bn")) * percent)
            pairs = side("u", "a").join(side("v", "b"), ["value", "i", "j"]).where(can & may_link("a", "b", F.col("an"), F.col("bn"), percent))
            pairs = pairs.select("u", "v", F.col("aroot").alias("ru"), F.col("broot").alias("rv")).distinct()
            roots = contract(left, roots, confirmed(pairs, classes, texts, width, percent))[1]
            forget(left)
            break
        hubs_each *= 2
        left = left.drop("c", "least")
    forget(texts)
    return roots


def rooted(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and per class: key, id (the smallest), cid, root (the cid of one class of its group)."""
    rows = sketched(docs, text_col, width)
    of = f"c{docs.columns.index(id_col)}"
    first = F.struct(F.col(of).isNull().alias("none"), F.col(of).alias("id"), "row", "n", "regs", *BITS)
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(first).alias("first")).select("key", "first.id", F.col("first.row").alias("cid"), "first.n", "first.regs", *[f"first.{c}" for c in BITS])
    classes = materialize(classes, "classes")
    roots = link_classes(rows, classes, f"c{docs.columns.index(text_col)}", width, percent)
    return rows, classes.select("key", "id", "cid").join(roots, "cid")


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, key, n (set size), component (smallest id reachable, the row's own if it is alone)."""
    rows, placed = rooted(docs, id_col, text_col, width, percent)
    names = placed.groupBy("root").agg(F.min("id").alias("component"))
    found = placed.join(names, "root").select("key", "component")
    rows = rows.select(F.col(f"c{docs.columns.index(id_col)}").alias("id"), "key", "n")
    blank = rows.where("key IS NULL").select("id", "key", "n", F.col("id").alias("component"))
    return rows.where("key IS NOT NULL").join(found, "key").select("id", "key", "n", "component").unionByName(blank)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the smallest id; rows with empty sets all stay."""
    rows, placed = rooted(docs, id_col, text_col, width, percent)
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cid")).alias("best")).select(F.col("best.cid").alias("row"))
    chosen = rows.where("key IS NOT NULL").join(best, "row", "left_semi").unionByName(rows.where("key IS NULL"))
    return chosen.select(*[F.col(f"c{k}") for k in range(len(docs.columns))]).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = group_documents(docs, width=4, percent=80)
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
