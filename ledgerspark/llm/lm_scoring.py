"""Text probabilities from a log-bilinear neural model trained by noise-contrastive estimation.

P(word | last two words) = P(class | last two classes) * P(word | class).
The first factor is the log-bilinear model: context vectors, multiplied by one
matrix per distance and added, predict the next class by dot products, and the
batched products are normalised by a softmax over all classes, so that the
probabilities of all words and of "some unknown word" sum to one. The commonest
words and the end of the text are classes of their own; all other words are
classed by their last two characters. The second factor is counted, with
absolute discounting that leaves room for unknown words.

Training: word counts over all training documents, by Spark; then the network,
by noise-contrastive estimation in numpy: a start on ``warm_docs`` documents,
then each task goes through all of its training documents, and the tasks'
parameters are averaged by their token counts.

Vocabulary: only words above a count that at most ``head`` words reach are sent
to the workers (a bound on the broadcast); the others are joined by word, and
being rare they are no hot keys.

Defined cases: a null or empty text is its end token alone; equal rows score
alike and each counts in training; without training documents every word is
unknown and the model is its starting point; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drawn, fold, lower_ascii, map_arrow, materialize, table, words_of

END = "\n"  # no word holds a line feed
OWN, TAIL = 208, 48
CLASSES, BEGIN = OWN + TAIL, OWN + TAIL
CONTEXT, WIDTH = 2, 12


def tail_class(word: str) -> int:
    return OWN + zlib.crc32(word[-2:].encode()) % TAIL


class Vocabulary:
    """The head words with counts, the class figures and what else the formulas need."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int, classes: dict[int, tuple[int, int, int, int]]):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        own = [END, *[w for w, _ in head if w != END][: OWN - 1]]
        self.index = {w: k for k, (w, _) in enumerate(head)}
        own_at = {w: k for k, w in enumerate(own)}
        self.by_end: dict[str, int] = {}
        self.cls = np.array([own_at[w] if w in own_at else tail_class(w) for w, _ in head] or [0], np.int64)
        counts = np.array([c for _, c in head] or [0], float)
        self.total, self.distinct = total, distinct
        # figures of the tail classes, own words taken out
        self.size, self.kinds, ones, twos = (np.zeros(CLASSES) for _ in range(4))
        for k, (n, v, n1, n2) in classes.items():
            self.size[k], self.kinds[k], ones[k], twos[k] = n, v, n1, n2
        for w, c in head:
            if w in own_at and w != END:
                k = tail_class(w)
                self.size[k] -= c
                self.kinds[k] -= 1
                ones[k] -= c == 1
                twos[k] -= c == 2
        self.cut = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.05, 0.9)
        self.log_base = np.log10(counts + 0.5)
        k = self.cls
        self.log_word = np.where(k < OWN, 0.0, np.log10(np.maximum(counts - self.cut[k], 1e-9)) - np.log10(np.maximum(self.size[k], 1)))
        self.counts = counts
        weights = np.concatenate([np.zeros(OWN), self.size[OWN:]])
        for w, j in own_at.items():
            if w in self.index:
                weights[j] = counts[self.index[w]]
        self.noise = (weights + 1) / (weights + 1).sum()

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index in the head (-1: not there) and class of each token; the end included."""
        get = self.index.get
        at = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        cls = self.cls[at]
        ends = self.by_end
        for j in np.flatnonzero(at < 0).tolist():
            end = words[j][-2:]
            if (k := ends.get(end)) is None:
                k = ends[end] = 0 if end == END else tail_class(end)
            cls[j] = k
        return at, cls


def start(noise: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random vectors over the class frequencies, so that training starts from these."""
    r = np.random.default_rng(seed)
    return {
        "word": r.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32), "context": r.normal(0, 0.1, (CLASSES + 1, WIDTH)).astype(np.float32),
        "matrix": np.stack([np.eye(WIDTH, dtype=np.float32) / (j + 1) for j in range(CONTEXT)]), "bias": np.log(noise).astype(np.float32),
    }


def contexts(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The classes before each token, nearest first; first marks each text's first token."""
    out = np.full((len(cls), CONTEXT), BEGIN)
    since = np.arange(len(cls)) - np.maximum.accumulate(np.where(first, np.arange(len(cls)), 0))
    for j in range(1, CONTEXT + 1):
        ok = since >= j
        out[ok, j - 1] = cls[np.flatnonzero(ok) - j]
    return out


def predicted(model: dict, ctx: np.ndarray) -> np.ndarray:
    return sum(model["context"][ctx[:, j]] @ model["matrix"][j] for j in range(CONTEXT))


def log10_classes(model: dict, cls: np.ndarray, ctx: np.ndarray, step: int = 4096) -> np.ndarray:
    """log10 P(class | context) of each token, normalised over all classes."""
    out = np.empty(len(cls))
    for at in range(0, len(cls), step):
        s = predicted(model, ctx[at : at + step]) @ model["word"].T + model["bias"]
        s -= s.max(1, keepdims=True)
        own = s[np.arange(len(s)), cls[at : at + step]]
        out[at : at + step] = (own - np.log(np.exp(s).sum(1))) / math.log(10)
    return out


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that share an index."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[ordered[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation by Adagrad, with noise words shared by a batch."""

    def __init__(self, model: dict, noise: np.ndarray, seed: int, rate: float = 0.1, samples: int = 24):
        self.m = {k: v.copy() for k, v in model.items()}
        self.sums = {k: np.full_like(v, 1.0) for k, v in model.items()}
        self.noise, self.rate, self.samples = noise, rate, samples
        self.random = np.random.default_rng(seed)
        self.offset = (np.log(noise) + math.log(samples)).astype(np.float32)
        self.seen = 0

    def _step(self, name: str, gradient: np.ndarray) -> None:
        self.sums[name] += gradient * gradient
        self.m[name] += self.rate * gradient / np.sqrt(self.sums[name])

    def learn(self, cls: np.ndarray, ctx: np.ndarray, batch: int = 4096) -> None:
        m, n = self.m, len(cls)
        order = self.random.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            y, c = cls[pick], ctx[pick]
            z = self.random.choice(CLASSES, self.samples, p=self.noise)
            x = [m["context"][c[:, j]] for j in range(CONTEXT)]
            q = sum(a @ w for a, w in zip(x, m["matrix"]))
            up = 1 / (1 + np.exp(np.clip((q * m["word"][y]).sum(1) + m["bias"][y] - self.offset[y], -30, 30)))
            down = -1 / (1 + np.exp(-np.clip(q @ m["word"][z].T + m["bias"][z] - self.offset[z], -30, 30)))
            g_q = up[:, None] * m["word"][y] + down @ m["word"][z]
            g_word = summed(y, q * up[:, None], CLASSES)
            np.add.at(g_word, z, down.T @ q)
            g_bias = np.bincount(y, up, CLASSES).astype(np.float32)
            np.add.at(g_bias, z, down.sum(0))
            g_context = np.zeros_like(m["context"])
            g_matrix = np.empty_like(m["matrix"])
            for j in range(CONTEXT):
                g_matrix[j] = x[j].T @ g_q
                g_context += summed(c[:, j], g_q, CLASSES + 1) @ m["matrix"][j].T
            scale = np.float32(1 / math.sqrt(len(y)))
            for name, g in (("word", g_word), ("context", g_context), ("matrix", g_matrix), ("bias", g_bias)):
                self._step(name, g * scale)
            self.seen += len(y)


def _tokens(text: str | None) -> list[str]:
    ws = words_of(lower_ascii(text)) if text else []
    ws.append(END)
    return ws


def count_words(docs: DataFrame, text_col: str, flush: int = 400_000) -> DataFrame:
    """(word, c) over all rows; summed in the workers before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_tokens(text))
            if len(counts) > flush:
                yield out()
                counts.clear()
        yield out()

    return map_arrow(docs.select(text_col), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count from which words are in its head."""
    tail = F.when(F.col("word") == END, F.lit(0)).otherwise(F.crc32(F.right("word", F.lit(2)).cast("binary")) % TAIL + OWN)
    one = lambda k: F.sum((F.col("c") == k).cast("long"))
    figures = {r["k"]: (r["n"], r["v"], r["n1"], r["n2"]) for r in counts.groupBy(tail.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), one(1).alias("n1"), one(2).alias("n2")).collect()}
    total, distinct = sum(f[0] for f in figures.values()), sum(f[1] for f in figures.values())
    # how many words have at least 2^k occurrences: a few rows, whatever the corpus
    steps = sorted(((r["k"], r["v"]) for r in counts.groupBy(F.floor(F.log2("c") * 4).alias("k")).agg(F.count("*").alias("v")).collect()), reverse=True)
    limit, words = 1 << 62, 0
    for k, v in steps:
        if words + v > head:
            break
        words, limit = words + v, math.ceil(2 ** (k / 4) - 1e-9)
    rows = counts.where(F.col("c") >= limit).collect()
    return Vocabulary([(r["word"], r["c"]) for r in rows], total, distinct, {k: f for k, f in figures.items() if k >= OWN}), limit


def _classes(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    split = [_tokens(t) for t in texts]
    _, cls = vocab.codes([w for ws in split for w in ws])
    first = np.zeros(len(cls), bool)
    first[np.concatenate([[0], np.cumsum([len(ws) for ws in split])[:-1]]).astype(int)] = True
    return cls, contexts(cls, first)


def train_network(docs: DataFrame, text_col: str, id_col: str, vocab, warm_docs: int, parts: int = 1024) -> dict[str, np.ndarray]:
    """vocab: a broadcast Vocabulary. All training documents are learned from once, after the warm start."""
    base = start(vocab.value.noise)
    # every training document has one end token
    known = int(vocab.value.counts[vocab.value.index[END]]) if END in vocab.value.index else 0
    warm = drawn(docs, known, warm_docs, id_col, text_col).select(text_col) if warm_docs else None

    def run_with(model: dict, epochs: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = None
            for batch in batches:
                if batch.num_rows:
                    trainer = trainer or Trainer(model, vocab.value.noise, seed=batch.num_rows, rate=0.1 if epochs > 1 else 0.05)
                    cls, ctx = _classes(batch.column(0).to_pylist(), vocab.value)
                    for _ in range(epochs):
                        trainer.learn(cls, ctx)
            if trainer:
                flat = np.concatenate([trainer.m[k].ravel() for k in sorted(base)]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([flat * trainer.seen], pa.list_(pa.float64()))], ["seen", "flat"])

        return run

    def add(group: pa.Table) -> pa.Table:
        flat = np.stack([np.array(x) for x in group["flat"].to_pylist()]).sum(0)
        return pa.table({"seen": pa.array([sum(group["seen"].to_pylist())], pa.int64()), "flat": pa.array([flat], pa.list_(pa.float64()))})

    def averaged(rows: DataFrame, model: dict, epochs: int) -> dict:
        got = map_arrow(rows, run_with(model, epochs), "seen long, flat array<double>")
        # tasks' parameters are added up in groups, so that the driver gets `parts` vectors at most
        got = got.groupBy((F.xxhash64("seen", F.spark_partition_id()) % parts).alias("g")).applyInArrow(add, "seen long, flat array<double>").collect() if epochs == 1 else got.collect()
        seen = sum(r["seen"] for r in got)
        if not seen:
            return model
        flat, out, at = sum(np.array(r["flat"]) for r in got) / seen, {}, 0
        for k in sorted(base):
            out[k] = flat[at : at + base[k].size].reshape(base[k].shape).astype(np.float32)
            at += base[k].size
        return out

    model = averaged(warm.coalesce(1), base, 4) if warm is not None else base
    return averaged(docs.select(text_col), model, 1)


SCHEMA = "uid long, id {kind}, n_tokens long, n_known long, base double, score double, tails array<struct<w:string,k:int,n:int>>"


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", *, head: int = 200_000, warm_docs: int = 2_000) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score. training: a condition on docs."""
    spark = docs.sparkSession
    learn = docs.where(training)
    counts = materialize(count_words(learn, text_col), "words")
    vocab, limit = vocabulary(counts, head)
    shared = spark.sparkContext.broadcast(vocab)
    model = train_network(learn, text_col, id_col, shared, warm_docs)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            split = [_tokens(t) for t in batch.column(2).to_pylist()]
            lengths = np.array([len(ws) for ws in split])
            if not len(lengths):
                continue
            every = [w for ws in split for w in ws]
            at, cls = v.codes(every)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            first = np.zeros(len(every), bool)
            first[begin] = True
            log_class = log10_classes(model, cls, contexts(cls, first))
            known = at >= 0
            base = np.add.reduceat(np.where(known, v.log_base[at], 0.0), begin)
            score = np.add.reduceat(log_class + np.where(known, v.log_word[at], 0.0), begin)
            n_known = np.add.reduceat(known.astype(np.int64), begin)
            tails: list[Counter] = [Counter() for _ in split]
            rare = np.flatnonzero(~known)
            for j, d in zip(rare.tolist(), (np.searchsorted(begin, rare, "right") - 1).tolist()):
                tails[d][every[j]] += 1
            listed = [[{"w": w, "k": 0 if w == END else tail_class(w), "n": n} for w, n in t.items()] for t in tails]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(n_known), pa.array(base), pa.array(score), pa.array(listed, pa.list_(pa.struct([("w", pa.string()), ("k", pa.int32()), ("n", pa.int32())])))], names
            )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = materialize(map_arrow(rows, run, SCHEMA.format(kind=kind)), "scored")
    per_class = lambda x: F.element_at(F.array(*[F.lit(float(y)) for y in x]), F.col("t.k") + 1)
    size, kinds, cut = per_class(vocab.size), per_class(vocab.kinds), per_class(vocab.cut)
    c = F.coalesce("c", F.lit(0)).cast("double")
    # log10 P(word | class): its discounted share; or what the discounts leave to unknown words, all of it in an empty class
    word = F.when((size <= 0) | (F.col("t.k") < OWN), F.lit(0.0)).when(c > 0, F.log10(c - cut) - F.log10(size)).otherwise(F.log10(cut * kinds / size))
    rare = rows.select("uid", F.explode("tails").alias("t"))
    joined = rare.join(counts.where(F.col("c") < limit), F.col("t.w") == F.col("word"), "left")
    sums = joined.groupBy("uid").agg(
        F.sum(F.col("t.n") * F.log10(c + 0.5)).alias("b"), F.sum(F.col("t.n") * word).alias("s"), F.sum(F.when(c > 0, F.col("t.n")).otherwise(0)).alias("k")
    )
    nothing = F.lit(0)
    return rows.drop("tails").join(sums, "uid", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("k", nothing)).cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", nothing.cast("double")) - F.col("n_tokens") * F.lit(math.log10(vocab.total + 0.5 * (vocab.distinct + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("s", nothing.cast("double"))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fold("doc_id", 5) != 1).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
