"""Toxicity by weak supervision: correlated lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicons: from labelled training rows (at most ``max_labelled``, those with
   the smallest hash of their id), words and word beginnings that lean to
   toxic documents are mined; a fixed seed list joins them.
2. Voters: seven that read lexicons and five that read patterns of their own
   (orders and threats, disguised spelling, shouting, exclamations, address) vote
   +1, 0 or -1 on every document of the corpus. Only counts per vote pattern
   leave the workers (3^12 patterns at most, by known label).
3. Label model: expectation-maximisation over these counts fits, per class, each
   voter's behaviour given its neighbour in a dependency tree, chosen by
   class-conditional mutual information (Chow and Liu): accuracies and
   correlations together. Known labels are held fixed.
4. Classifier: logistic regression on lexicon hits and patterns, trained on the
   posterior labels of all documents of the corpus (a known label is its own
   posterior, and counts among its vote pattern's), by gradients that the workers
   sum.

Defined cases: a null or empty text has no hits and gets the classifier's base
score; labels that are null or contradict each other for one id (the larger
counts) never crash; without any training labels the seed list alone votes;
equal rows get equal scores; language, source and id are no inputs; an empty
table gives an empty result; a column of docs that has the name of an output
gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import drawn, fold, forget, map_arrow, materialize, table

#: Insults that need no corpus to be known.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns bastard filth vermin imbecile retard jerk".split())
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ADDRESSED = re.compile(r"\b(?:you|du|tu|vous|usted|ihr)\b[^.!?\n]{0,12}$", re.I)
# Orders, threats and dismissals, in the corpus' four languages.
ORDERS = (
    "shut up", "get lost", "go to hell", "drop dead", "hate you", "kill you", "screw you", "halt die klappe", "verschwinde", "ich hasse", "tais-toi", "te hais", "cállate", "lárgate", "te odio",
)
#: Letters of a word given way to signs: id1ot, stup!d, l0ser, tr@sh.
SIGNS = "01345@$!*"
_SIGNS = re.compile(r"[01345@$!*]+(?=[a-z])")
_PLAINED = str.maketrans(SIGNS, "oieasasii")
_CAPITALS = bytes(range(65, 91))
#: Lengths of word beginnings that are mined, besides whole words.
STEMS = (4, 5, 6)
N_VOTERS = 12
#: Columns of the classifier besides the lexicon's: seeds, several hits, several strong ones, and the five patterns.
PATTERNS = 8


def words(text: str) -> list[str]:
    """The runs of letters, lower-cased: what _WORD finds, of which ASCII signs and digits are split off by table."""
    found = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).decode("utf-8", "surrogatepass").split()
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ((w,) if w.isalpha() else _WORD.findall(w))]


def disguised_seed(lower: str) -> bool:
    """Whether a seed word is spelled with signs for letters."""
    if not any(c in lower for c in SIGNS):
        return False
    for m in _SIGNS.finditer(lower):
        s, e = m.span()
        if s and lower[s - 1].isalpha():
            while s and not lower[s - 1].isspace() and m.start() - s < 16:
                s -= 1
            while e < len(lower) and not lower[e].isspace() and e - m.end() < 16:
                e += 1
            if lower[s:e].strip(".,;:?()\"'").translate(_PLAINED) in SEEDS:
                return True
    return False


def tokens(word: str) -> list[str]:
    """What the lexicons know a word by: itself, and its beginnings marked with *."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) >= k]]


class Lexicon:
    """Mined tokens with their log odds; one column of the classifier each."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.index = {t: k for k, t in enumerate(sorted(odds))}
        self.size = len(self.index) + PATTERNS

    def hits(self, vocabulary: set[str]) -> dict[str, list[str]]:
        """The words of a batch that hit anything, with what they hit."""
        out = {}
        for w in vocabulary:
            found = [t for t in tokens(w) if t in self.odds]
            if found or w in SEEDS:
                out[w] = found
        return out

    def document(self, text: str, ws: list[str], hits: dict[str, list[str]]) -> tuple[list[int], tuple[int, ...]]:
        """Classifier columns set, and votes."""
        here = hits.keys() & set(ws)
        base = len(self.index)
        lower = text.lower()
        ordered = any(p in lower for p in ORDERS)
        disguised = disguised_seed(lower)
        raw = text.encode("utf-8", "surrogatepass")
        capitals = 3 * (len(raw) - len(raw.translate(None, _CAPITALS))) >= len(raw) > 0
        exclaimed = 8 * text.count("!") >= len(ws) > 0
        if not here:
            cols = [base + k for k, on in ((3, ordered), (4, disguised), (5, capitals), (6, exclaimed)) if on]
            return cols, (-1, -1, -1, -1, -1, -1, 0, 1 if ordered else 0, 1 if disguised else 0, 1 if capitals else 0, 1 if exclaimed else 0, -1)
        found = {t for w in here for t in hits[w]}
        seeds = sum(w in SEEDS for w in here)
        strong = [t for t in found if self.odds[t] >= 4]
        stems = [t for t in found if t.endswith("*")]
        most = max((self.odds[t] for t in found), default=0.0)
        aimed = False
        for w in here:
            at = lower.find(w)
            if at >= 0 and _ADDRESSED.search(lower[max(0, at - 16) : at]):
                aimed = True
                break
        dense = 20 * sum(w in here for w in ws) >= len(ws)
        votes = (
            1 if seeds else -1,
            1 if any(not t.endswith("*") for t in strong) else 0 if found else -1,
            1 if any(len(t) == 5 for t in stems) else -1,
            1 if any(len(t) > 5 for t in stems) else -1,
            1 if len(here) >= 2 else 0,
            1 if most >= 4 else 0 if most >= 2.5 else -1,
            1 if aimed else 0,
            1 if ordered else 0,
            1 if disguised else 0,
            1 if capitals else 0,
            1 if exclaimed else 0,
            1 if dense else 0,
        )
        flags = (seeds > 0, len(here) >= 2, len(strong) >= 2, ordered, disguised, capitals, exclaimed, aimed)
        return sorted(self.index[t] for t in found) + [base + k for k, on in enumerate(flags) if on], votes


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """text and toxic of the training rows, at most max_labelled ids: those with the smallest hash."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # max_labelled ids of 16 bytes: a proven bound for the broadcast
    known = drawn(known, known.count(), max_labelled, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def mine(sample: DataFrame, least: int = 4, odds: float = 2.0) -> Lexicon:
    """Tokens that lean to toxic documents: counted in the workers, all kept that pass; the labelled sample bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows[bool(toxic)] += 1
                (bad if toxic else good).update({t for w in set(words(text or "")) for t in tokens(w)})
        keys = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*keys, "\n"], pa.string()), pa.array([*(bad[k] for k in keys), rows[1]], pa.int64()), pa.array([*(good[k] for k in keys), rows[0]], pa.int64())], ["token", "bad", "good"]
        )

    counts = map_arrow(sample.select("text", "toxic"), run, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = counts.where(F.col("token") == "\n").first()
    if total is None or not total["bad"]:
        return Lexicon({})
    lean = F.log((F.col("bad") + 0.5) / (total["bad"] + 1)) - F.log((F.col("good") + 0.5) / (total["good"] + 1))
    best = counts.where((F.col("token") != "\n") & (F.col("bad") >= least)).withColumn("lean", lean).where(F.col("lean") >= odds)
    rows = best.orderBy("token").collect()
    return Lexicon({r["token"]: r["lean"] for r in rows})


def _read(batch_texts: list[str | None], lexicon: Lexicon):
    split = [words(t) if t else [] for t in batch_texts]
    hits = lexicon.hits(set().union(*split))
    return [lexicon.document(t or "", ws, hits) for t, ws in zip(batch_texts, split)]


def _code(votes: tuple[int, ...]) -> int:
    key = 0
    for v in votes:
        key = key * 3 + v + 1
    return key


def _decode(key: np.ndarray) -> np.ndarray:
    return np.stack([key // 3 ** (N_VOTERS - 1 - j) % 3 for j in range(N_VOTERS)], 1)


class LabelModel:
    """P(votes | class) along a tree of voters, and the class prior."""

    def __init__(self, key: np.ndarray, n: np.ndarray, gold: np.ndarray, rounds: int = 30):
        """key: vote pattern; n: how often; gold: 0, 1 or -1 where unknown."""
        x = _decode(key)
        q = np.where(gold >= 0, gold, np.clip(0.2 + 0.15 * (x - 1).sum(1), 0.02, 0.9)).astype(float)
        self.parents = [-1] * N_VOTERS
        for phase in range(2):  # first as if independent, then along the tree
            for _ in range(rounds):
                self._fit(x, np.stack([1 - q, q], 1) * n[:, None])
                q = np.where(gold >= 0, gold, self.posterior(key))
            if phase == 0:
                self.parents = self._tree(x, np.stack([1 - q, q], 1) * n[:, None])

    def _fit(self, x: np.ndarray, weight: np.ndarray) -> None:
        self.prior = (weight.sum(0) + 1) / (weight.sum() + 2)
        self.tables = []
        for j, p in enumerate(self.parents):
            t = np.full((3, 3, 2), 0.5)  # parent's vote, own vote, class
            np.add.at(t, (x[:, p] if p >= 0 else np.zeros(len(x), int), x[:, j]), weight)
            self.tables.append(t / t.sum(1, keepdims=True))

    def posterior(self, key: np.ndarray) -> np.ndarray:
        x, score = _decode(key), np.tile(np.log(self.prior), (len(key), 1))
        for j, p in enumerate(self.parents):
            score += np.log(self.tables[j][x[:, p] if p >= 0 else 0, x[:, j]])
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -30, 30)))

    @staticmethod
    def _tree(x: np.ndarray, weight: np.ndarray) -> list[int]:
        """Maximum spanning tree of class-conditional mutual information, grown from voter 0."""
        info = np.zeros((N_VOTERS, N_VOTERS))
        for i in range(N_VOTERS):
            for j in range(i):
                t = np.full((3, 3, 2), 1e-9)
                np.add.at(t, (x[:, i], x[:, j]), weight)
                c = t.sum((0, 1), keepdims=True)
                info[i, j] = info[j, i] = (t * np.log(t * c / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)))).sum()
        parents, inside = [-1] * N_VOTERS, {0}
        while len(inside) < N_VOTERS:
            _, p, j = max((info[p, j], -p, -j) for p in inside for j in range(N_VOTERS) if j not in inside)
            parents[-j] = -p
            inside.add(-j)
        return parents


class Classifier:
    """Logistic regression on columns that are there or not; the last weight is the constant's."""

    def __init__(self, weights: np.ndarray):
        self.w = weights

    def score(self, cols: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.w[-1] + self.w[cols].sum()))))


def _sums(cols: pa.Array, n: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature bound of the log loss over rows of columns with counts and summed labels."""
    lengths = np.asarray(pa.compute.fill_null(cols.value_lengths(), 0))
    flat, row = np.asarray(cols.flatten(), np.int64), np.repeat(np.arange(len(n)), lengths)
    score = w[-1] + np.bincount(row, w[flat], len(n))
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    out = np.zeros((2, len(w)))
    pull, bend = n * p - y, n * np.maximum(p * (1 - p), 0.01) * (lengths + 1)
    np.add.at(out[0], flat, pull[row])
    np.add.at(out[1], flat, bend[row])
    out[:, -1] = pull.sum(), bend.sum()
    return out


def add(group: pa.Table) -> pa.Table:
    """The sum of the vectors of a group."""
    vectors = group["sums"].combine_chunks()
    total = np.asarray(vectors.flatten()).reshape(len(vectors), -1).sum(0)
    return pa.table({"sums": pa.array([total], pa.list_(pa.float64()))})


def fit(rows: DataFrame, size: int, ridge: float = 1.0, rounds: int = 25, parts: int = 32) -> Classifier:
    """rows: cols, n, y (summed posterior labels). Each round the workers sum gradients, the driver takes a damped step.

    The step of a column is its gradient over a bound of the curvature, so that the loss does not rise.
    """
    w, speed = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        at = w + 0.5 * speed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, size + 1))
            for batch in batches:
                total += _sums(batch.column(0), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy(), at)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

        # partitions' sums are added up in groups, so that the driver gets `parts` vectors at most
        sums = map_arrow(rows, run, "sums array<double>", rows=20_000).groupBy((F.spark_partition_id() % parts).alias("g")).applyInArrow(add, "sums array<double>")
        got = np.array([r["sums"] for r in sums.collect()])
        gradient, bend = got.sum(0).reshape(2, size + 1) if len(got) else np.zeros((2, size + 1))
        new = at - np.clip((gradient + penalty * at) / (bend + penalty), -2, 2)
        speed, w = new - w, new
        if np.abs(speed).max() < 1e-4:
            break
    return Classifier(w)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, trust: float = 5.0) -> tuple[Lexicon, Classifier]:
    """max_labelled bounds the labelled rows that the lexicons are mined from and the label model knows."""
    sample = labelled_rows(docs, labels, max_labelled)
    lexicon = mine(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _read(batch.column(0).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([_code(v) for _, v in found], pa.int64()), batch.column(1)], ["cols", "key", "gold"])

    # the label of a training row goes along (-1: unknown); rows with the same columns, votes and label are one row
    golden = F.broadcast(sample.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("gold")))
    marked = docs.join(golden, "doc_id", "left").select("text", F.coalesce("gold", F.lit(-1)).alias("gold"))
    rows = materialize(map_arrow(marked, features, "cols array<int>, key long, gold int").groupBy("cols", "key", "gold").agg(F.count("*").alias("n")), "hits")
    patterns = sorted((r["key"], r["gold"], r["n"]) for r in rows.groupBy("key", "gold").agg(F.sum("n").alias("n")).collect())
    if not patterns:
        forget(rows)
        return lexicon, Classifier(np.zeros(lexicon.size + 1))
    key, gold, n = np.array(patterns, np.int64).T
    model = LabelModel(key, n.astype(float), gold)
    # known labels of a pattern weigh against its posterior, which counts as `trust` documents
    agree, known_n = Counter(), Counter()
    for k, g, c in patterns:
        if g >= 0:
            agree[k] += g * c
            known_n[k] += c
    posterior = {k: (trust * p + agree[k]) / (trust + known_n[k]) for k, p in zip(key.tolist(), model.posterior(key).tolist())}

    def soften(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            soft = np.array([posterior[k] for k in batch.column(1).to_pylist()])
            known = batch.column(2).to_numpy()
            soft = np.where(known >= 0, known, soft)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(soft * batch.column(3).to_numpy())], ["cols", "n", "y"])

    targets = materialize(map_arrow(rows, soften, "cols array<int>, n long, y double", rows=20_000), "posteriors")
    classifier = fit(targets, lexicon.size)
    forget(rows, targets)
    return lexicon, classifier


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_labelled: int = 20_000, threshold: float = 0.3, model=None, names: tuple[str, str] = ("score", "predicted"), label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Per row of docs: its columns, and the score and prediction under `names`."""
    labels = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("toxic"))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lexicon, classifier = model or train(plain, labels, max_labelled)
    docs = docs.drop(*[c for c in names if c not in (id_col, text_col)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [classifier.score(c) for c, _ in _read(batch.column(at).to_pylist(), lexicon)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*batch.schema.names, *names])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
