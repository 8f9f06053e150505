"""Byte-pair encoding by depth-first traversal of a prefix-sharing trie of distinct words.

A token sequence is a BPE encoding exactly if each adjacent pair of tokens is
the encoding of its own joined text. The encoding of a prefix is therefore
known from its last token alone: the encoding of the prefix before that token,
then the token. Distinct words of a batch are walked depth first as a trie
(in sorted order, with the path from the root on a stack, so the trie needs no
memory beyond one path); each prefix shared by several words gets its
last-token state once, and a word's tokens are read off by following the states
back. Only whether two tokens may stand side by side is simulated, and kept.

Defined cases: a null or empty text has no tokens; special-token strings in a
text are encoded as special tokens, as the library does; equal rows are encoded
alike; white space is dropped; a text without white space is one word of any
length; an empty table gives an empty result. No document leaves its task; the
table of words that a worker keeps is bounded by ``cache`` bytes.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table, words_of

#: The vocabulary file, a parameter of every function here: a path, or the bare name of a public vocabulary.
VOCABULARY = "word_bpe_49k.json"
END = "</w>"

#: Words of ASCII and of letters that NFC leaves alone and that have one lower-case letter each;
#: all others take the library's own normaliser and pretokeniser.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+").fullmatch
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+").findall


def _tails(tokens) -> dict[str, tuple[int, ...]]:
    """By their last four symbols, the lengths of the tokens that end so, longest first, and 3, 2, 1."""
    found: dict[str, set[int]] = {}
    for t in tokens:
        if len(t) > 3:
            found.setdefault(t[-4:], {1, 2, 3}).add(len(t))
    return {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in found.items()}


_SHORT = (3, 2, 1)


class TrieEncoder:
    """Encodes pieces (strings of byte symbols, the last one carrying the word end)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.names = {k: t for t, k in vocab.items()}
        self.shift = max(vocab.values()).bit_length()
        size = max(vocab.values()) + 1
        #: Of each token the rank of the merge that makes it (-1: a symbol) and that merge's sides.
        self.rank, self.left, self.right = [-1] * size, [*range(size)], [*range(size)]
        self.pairs: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault(x << self.shift | y, k)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, x, y
        self.ends = {t[: -len(END)]: k for t, k in vocab.items() if t.endswith(END)}
        self.inner = {t: k for t, k in vocab.items() if not t.endswith(END)}
        self.inner_tails, self.end_tails = _tails(self.inner), _tails(self.ends)
        self.fits: dict[int, bool] = {}
        self.visited = 0

    def fit(self, x: int, y: int) -> bool:
        """Whether BPE keeps the tokens x and y apart when they are joined.

        Undo their merges from the latest on; if the symbols at the seam merge
        earlier than the merge just undone, the seam does not hold.
        """
        rank, left, right, pairs, shift = self.rank, self.left, self.right, self.pairs, self.shift
        limit = 1 << 60
        while True:
            if pairs.get(x << shift | y, limit) < limit:
                return False
            a, b = rank[x], rank[y]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, x = a, right[x]
            else:
                limit, y = b + 1, left[y]

    def encode_all(self, pieces) -> Iterator[tuple[str, list[int]]]:
        """(piece, token ids) for distinct pieces; shared prefixes are visited once.

        states[i] is the last token of the encoding of the first i symbols.
        """
        inner, ends, fits, shift = self.inner, self.ends, self.fits, self.shift
        inner_tails, end_tails = self.inner_tails.get, self.end_tails.get
        if len(fits) > 500_000:
            fits.clear()
        states, sizes, before = [-1], [0], ""
        for piece in sorted(pieces):
            n = len(piece)
            k, most = 0, min(len(states) - 1, n - 1)
            while k < most and piece[k] == before[k]:
                k += 1
            del states[k + 1 :], sizes[k + 1 :]
            self.visited += n - k
            for i in range(k + 1, n + 1):
                if i < n:
                    known, sizes_here = inner, inner_tails(piece[i - 4 : i], _SHORT) if i > 3 else _SHORT
                else:
                    known, sizes_here = ends, end_tails(piece[i - 4 : i], _SHORT) if i > 3 else _SHORT
                for size in sizes_here:
                    j = i - size
                    if j < 0 or (token := known.get(piece[j:i])) is None:
                        continue
                    key = states[j] << shift | token if j else -1 - token
                    if (ok := fits.get(key)) is None:
                        ok = fits[key] = self.fit(states[j], token) if j else self.whole(token)
                    if ok:
                        break
                else:
                    raise ValueError(f"no token ends {piece[:i]!r}")
                if i < n:
                    states.append(token)
                    sizes.append(i - j)
            tokens, at = [token], j
            while at:
                tokens.append(states[at])
                at -= sizes[at]
            yield piece, tokens[::-1]
            before = piece

    def whole(self, token: int) -> bool:
        """Whether BPE makes this token of its own symbols: its sides do so and only its last merge joins them."""
        if self.rank[token] < 0:
            return True
        x, y = self.left[token], self.right[token]
        parts = self.pairs.pop(x << self.shift | y)
        try:
            return self.whole_sides(x, y)
        finally:
            self.pairs[x << self.shift | y] = parts

    def whole_sides(self, x: int, y: int) -> bool:
        return self.fit(x, y) and self.whole(x) and self.whole(y)


def located(vocabulary: str) -> str:
    """Where the file lies on this machine, which may be any executor."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


#: What a word of the table takes besides its characters: a string, a tuple, two byte strings, its place in a dict.
_ENTRY = 280
CACHE = 144 << 20


class WordCoder:
    """Texts to ids and back through a table of the distinct words met so far."""

    def __init__(self, vocabulary: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        path = located(vocabulary)
        spec = json.load(open(path, encoding="utf-8"))
        model, self.cache = spec["model"], cache
        self.trie = TrieEncoder(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        whole = Tokenizer.from_file(path)
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.size = 0
        #: Byte symbols of the characters that the short way below handles.
        self.bytes = {c: self.cut(chr(c))[0][0] for c in [*range(33, 127), *range(0xC0, 0x180)]}
        self.coded = [(struct.pack("<I", k), (" " + self.trie.names.get(k, "")).encode()) for k in range(max(self.trie.vocab.values()) + 1)]

    def pieces(self, word: str) -> list[str]:
        """The pretokens of a word, special tokens standing for themselves."""
        if "<|" in word and (marks := [(word.find(m), m) for m in self.special if m in word]):
            left, mark, right = word.partition(min(marks)[1])
            return [*self.pieces(left), mark, *self.pieces(right)]
        if not word:
            return []
        if _PLAIN(word):
            word = word.lower()
            if word.isascii():
                return [word] if word.isalpha() else _CUT(word)
            return [p.translate(self.bytes) for p in _CUT(word)]
        return [p for p, _ in self.cut(self.normalize(word))]

    def learn(self, words: set[str]) -> None:
        """Put all these words in the table.

        The table has a young and an old half; words that turn up again move to
        the young half, and when that is full it becomes the old one.
        """
        young, old = self.known, self.old
        if self.size > self.cache // 2:
            self.old, self.known, self.size = young, {}, 0
            young, old = self.known, self.old
        missing = words.difference(young)
        back = missing.intersection(old)
        for w in back:
            young[w] = old.pop(w)
        fresh = missing - back
        self.size += _ENTRY * len(missing) + 4 * sum(map(len, missing))
        parts, coded = {p: (struct.pack("<I", k), (" " + p).encode()) for p, k in self.special.items()}, self.coded
        cut = [(w, self.pieces(w)) for w in fresh]
        for p, tokens in self.trie.encode_all({p for _, ps in cut for p in ps} - parts.keys()):
            if len(tokens) == 1:
                parts[p] = coded[tokens[0]]
            else:
                both = [coded[t] for t in tokens]
                parts[p] = b"".join([x[0] for x in both]), b"".join([x[1] for x in both])
        for word, ps in cut:
            if len(ps) == 1:
                self.known[word] = parts[ps[0]]
            else:
                self.known[word] = b"".join([parts[p][0] for p in ps]), b"".join([parts[p][1] for p in ps])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian uint32, decoded text in UTF-8) of each text."""
        # the table holds many small objects and no cycles: collecting would only scan it
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        split = [words_of(t) for t in texts]
        self.learn(set().union(*split))
        known, out = self.known.__getitem__, []
        for ws in split:
            ids, decoded = zip(*map(known, ws)) if ws else ((), ())
            out.append((b"".join(ids), b"".join(decoded)[1:]))
        return out


_CODERS: dict[tuple[str, int], WordCoder] = {}


def coder_of(path: str, cache: int) -> WordCoder:
    """One coder for all tasks of a Python worker."""
    if (path, cache) not in _CODERS:
        _CODERS[path, cache] = WordCoder(path, cache)
    return _CODERS[path, cache]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY, cache: int = CACHE) -> DataFrame:
    """Per row: the id, ids (binary, little-endian uint32), decoded text."""
    return _mapped(docs, id_col, text_col, vocabulary, cache, "ids binary, decoded string", lambda found: [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1].decode() for x in found], pa.string())])


def _mapped(docs, id_col, text_col, vocabulary, cache, columns, build) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = coder_of(vocabulary, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), *build(coder.encode(batch.column(1).to_pylist()))], names)

    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY, cache: int = CACHE) -> DataFrame:
    """encode_documents() with ids and text as SHA-256, so that no long value leaves the worker."""

    def build(found):
        return [
            pa.array([len(x[0]) // 4 for x in found], pa.int64()),
            pa.array([hashlib.sha256(x[0]).hexdigest() for x in found]),
            pa.array([hashlib.sha256(x[1]).hexdigest() for x in found]),
        ]

    return _mapped(docs, id_col, text_col, vocabulary, cache, "n_tokens long, ids_sha256 string, decoded_sha256 string", build)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
