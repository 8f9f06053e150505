"""Exact repeats of 50 bytes and more across documents, by merging shard Burrows-Wheeler transforms.

A string of `width` bytes is removed from a document if it also starts in a
document with a smaller id. Which strings are equal is decided by merging the
Burrows-Wheeler transforms of shards by iterative interleave refinement: each
round sorts the interleave by one more symbol, stably, through the shards' own
LF mappings; after `width` rounds the blocks that have not split are exactly the
sets of suffixes with a common prefix of `width` (their LCP intervals), and no
suffix of the merged text was sorted again.

To spread that over a cluster, equal strings have to meet. Documents are dealt
once into batches of some megabytes, kept as a table bucketed by batch, so that
the passes below move no text.
1. The anchor of a string is its lowest-hashed 16-byte window, so equal strings
   have equal anchors; strings with consecutive starts and one anchor make a
   passage. A batch asks for each of its anchors (32 bits and a route) whether
   two documents have it; the answers come back in the order of the questions.
2. Of passages with such anchors a batch sends the anchor, a 64-bit hash of the
   passage, and its smallest id. Passages are numbered. An anchor with one
   passage everywhere is settled: the smallest id holds for all its strings.
3. The bytes of every other distinct passage are sent once, by one batch, and
   the transforms of all passages of an anchor are merged in one task.
4. The smallest id of each string goes back to the batches, which cut.
An anchor met more than `crowd` times has its passages cut into pieces of four
starts, whose anchor is the hash of all bytes that the four strings share; that
spreads the contexts of a very common passage over many tasks.

Defined cases: null and empty texts have no bytes; rows with equal ids do not
cut each other, whatever their texts; a null id is larger than all others;
texts below 50 bytes stay whole; an empty table gives an empty result; very long
texts cost memory in proportion to themselves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import delete_folder, forget, map_arrow, materialize, shared_dir, table
from .shingles import mix

_U = np.uint64
GRAM = 16
_BLOCK = 1 << 15
_STEP = 4
_LAST = np.iinfo(np.int64).max
#: Bytes of a batch's texts on average; anchors of a route on average.
BATCH_BYTES, ROUTE_ANCHORS = 2 << 20, 1 << 20


def runs(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, position of the anchor) of each run of starts with one anchor: the leftmost window of least hash."""
    total, reach = len(raw) - width + 1, width - GRAM + 1
    firsts, places, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], -1
    index = np.arange(_BLOCK + width, dtype=_U)
    for at in range(0, total, _BLOCK):
        h, step, power = raw[at : at + _BLOCK + width - 1].astype(np.uint32) + np.uint32(1), 1, 0x01000193
        while step < GRAM:
            h = h[:-step] * np.uint32(power) + h[step:]
            step, power = 2 * step, power * power % 2**32
        for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        key = (h.astype(_U) << _U(32)) | index[: len(h)]
        size = 1
        while 2 * size <= reach:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < reach:
            key = np.minimum(key[: len(key) - (reach - size)], key[reach - size :])
        place = (key & _U(2**32 - 1)).astype(np.int64) + at
        first = np.flatnonzero(np.concatenate([[place[0] != last], place[1:] != place[:-1]]))
        firsts.append(first + at)
        places.append(place[first])
        last = place[-1]
    return np.concatenate(firsts), np.concatenate(places)


def passages(raw: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its position, first start, number of starts, document) of the passages of texts laid end to end.

    ends has the texts' bounds, from 0 on; every start of a whole string is in exactly one passage.
    """
    firsts, places = runs(raw, width)
    if not len(firsts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none, none
    # cuts in order, by marks: starts of runs and texts, and the first start that no longer holds a whole string
    total = len(raw) - width + 1
    begins = np.zeros(len(raw) + 1, bool)
    begins[firsts] = True
    run = np.cumsum(begins[:total], dtype=np.int32)
    begins[ends[:-1]] = True
    begins[np.maximum(ends[1:] - width + 1, ends[:-1])] = True
    cuts = np.flatnonzero(begins[:total])
    doc = np.searchsorted(ends, cuts, "right") - 1
    count = np.diff(np.append(cuts, total))
    whole = cuts + width <= ends[doc + 1]
    place = places[run[cuts] - 1][whole]
    words = raw[place[:, None] + np.arange(GRAM)].view("<u8").astype(_U)
    anchor = mix(words[:, 0] * _U(0x9E3779B97F4A7C15) + mix(words[:, 1] + _U(1)))
    return anchor, place, cuts[whole], count[whole], doc[whole]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The starts of text's rotations, sorted by at least `depth` symbols (prefix doubling from five)."""
    n = len(text)
    low, index = _U(n.bit_length()), np.arange(n, dtype=_U)
    mask, h = (_U(1) << low) - _U(1), 5 if n < 1 << 18 else 2
    wide = text.astype(_U)
    key = wide
    for k in range(1, h):
        key = (key << _U(9)) | np.concatenate([wide[k:], wide[:k]])
    while True:
        both = np.sort((key << low) | index)  # the place rides along
        order = (both & mask).astype(np.int64)
        both >>= low
        rank = np.zeros(n, _U)
        rank[order[1:]] = np.cumsum(both[1:] != both[:-1]).astype(_U)
        if h >= depth or rank.max(initial=0) == n - 1:
            return order
        key = rank * _U(n) + np.concatenate([rank[h % n :], rank[: h % n]])
        h *= 2


def several(symbol: np.ndarray, lf: np.ndarray, radix: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of `steps` LF steps as one number, the last step's leading, and where the steps lead."""
    code, back, taken = None, None, 0
    part, size = (symbol, lf), 1
    while steps:
        if steps & 1:
            code, back = part if code is None else (part[0][back] * _U(radix**taken) + code, part[1][back])
            taken += size
        steps >>= 1
        if steps:
            part, size = (part[0][part[1]] * _U(radix**size) + part[0], part[1][part[1]]), 2 * size
    return code, back


def merged_classes(shards: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, LCP-interval size) of every rotation start of the concatenated shards: equal classes share `width` symbols.

    Each shard is a text of its own (symbols 1 to 256, with 0 ending each passage).
    A round of refinement takes as many symbols at once as a word has room for.
    """
    bwt, lf, starts, base = [], [], [], 0
    for text in shards:
        order = suffix_order(text, width)
        place = np.empty(len(text), np.int64)
        place[order] = np.arange(len(text))
        bwt.append(text[order - 1])
        lf.append(place[order - 1] + base)
        starts.append(order + base)
        base += len(text)
    bwt, lf, starts = np.concatenate(bwt), np.concatenate(lf), np.concatenate(starts)
    used = np.zeros(257, bool)
    used[bwt] = True
    radix, symbol = int(used.sum()), (np.cumsum(used) - 1).astype(_U)[bwt]
    low = _U(base.bit_length())
    each = min(width, max(1, int((63 - int(low)) / np.log2(max(radix, 2)))))
    # the interleave: positions in the shards' transforms, first shard by shard
    now, block, index = np.arange(base), np.zeros(base, np.int32), np.arange(base, dtype=_U)
    rounds = [several(symbol, lf, radix, each)] * (width // each) + ([several(symbol, lf, radix, width % each)] if width % each else [])
    for symbols, back in rounds:
        key = np.sort((symbols[now] << low) | index)  # stable: a place breaks ties
        order = (key & ((_U(1) << low) - _U(1))).astype(np.int64)
        key >>= low
        now, block = back[now[order]], block[order]
        split = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        block = np.concatenate([[0], np.cumsum(split, dtype=np.int32)]).astype(np.int32)
    classes = np.empty(base, np.int64)
    classes[starts[now]] = block
    return classes, np.bincount(block)


def lowest_ids(texts: list[bytes], ids: np.ndarray, width: int, shard: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """For each `width`-byte string of each text, text by text, the lowest id of all texts that hold it; and the texts' bounds there."""
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths)
    symbols = np.zeros(ends[-1], np.uint16)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False  # 0 ends each text
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    last = np.flatnonzero(np.append(np.diff(ends // shard) > 0, True))
    classes, sizes = merged_classes(np.split(symbols, ends[last[:-1]]), width)
    counts = lengths - width
    bounds = np.append(0, np.cumsum(counts))
    at = np.repeat(ends - lengths - bounds[:-1], counts) + np.arange(bounds[-1])
    of = classes[at]
    low = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(low, of, np.repeat(ids, counts))
    return low[of], bounds


def joined(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes laid end to end, and their bounds."""
    a = pc.fill_null(pa.concat_arrays([c.cast(pa.large_binary()) for c in texts.chunks] or [pa.array([], pa.large_binary())]), b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and ends[-1] else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


class Routes:
    """The upper bits of a hash choose one of 2^bits routes; its next 32 bits stand for it there."""

    def __init__(self, bits: int):
        self.bits = bits

    def split(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(route of each part, bounds of the parts, the 32 bits) of sorted hashes."""
        route = (sorted_hashes >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(sorted_hashes), np.int64)
        at = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]])) if len(route) else np.zeros(0, np.int64)
        return route[at], np.append(at, len(route)), (sorted_hashes >> _U(32 - self.bits)).astype(np.uint32)


def _blobs(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def _whole(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def anchors_of(raw, ends, width) -> tuple:
    """The passages, the distinct anchors in order, and in how many documents of the batch (255 at most) each is."""
    found = passages(raw, ends, width)
    order = np.lexsort((found[4], found[0]))
    a, d = found[0][order], found[4][order]
    new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    other = new | np.concatenate([[True], d[1:] != d[:-1]]) if len(a) else new
    group = np.cumsum(new) - 1
    return found, a[new], np.minimum(np.bincount(group[other], minlength=int(new.sum())), 255).astype(np.uint8)


def ask(group: pa.Table, width: int, routes: Routes) -> pa.Table:
    """For each route the batch's anchors that go there."""
    _, anchors, counts = anchors_of(*joined(group["text"]), width)
    route, bounds, rest = routes.split(anchors)
    return pa.table({"route": pa.array(route, pa.int64()), "batch": pa.array(np.full(len(route), group["batch"][0].as_py()), pa.int64()), "anchors": _blobs(bounds, rest), "counts": _blobs(bounds, counts)})


def answer(group: pa.Table, crowd: int) -> pa.Table:
    """For each question 0 (one document has the anchor), 1 (several have it) or 2 (more than `crowd`)."""
    rests = group["anchors"].to_pylist()
    rest, count = _whole(rests, np.uint32), _whole(group["counts"].to_pylist(), np.uint8)
    _, inverse = np.unique(rest, return_inverse=True)
    met = np.bincount(inverse, weights=count)[inverse]
    told = (met > 1).astype(np.uint8) + (met > crowd)
    bounds = np.concatenate([[0], np.cumsum([len(b) // 4 for b in rests])])
    return pa.table({"batch": group["batch"], "kind": pa.array(np.zeros(len(rests), np.int32)), "key": group["route"], "first": _blobs(bounds, told.astype(np.uint8)), "second": pa.nulls(len(rests), pa.binary()), "third": pa.nulls(len(rests), pa.binary())})


ANSWER = "batch long, kind int, key long, first binary, second binary, third binary"


class Batch:
    """A batch's texts, and its passages that may repeat elsewhere, crowded ones in pieces."""

    def __init__(self, docs: pa.Table, answers: pa.Table, width: int):
        self.width = width
        self.number = docs["batch"][0].as_py()
        self.ids = docs["id"].to_numpy() if not docs["id"].null_count else np.array([_LAST if i is None else i for i in docs["id"].to_pylist()], np.int64)
        self.raw, self.ends = joined(docs["text"])
        self.data = self.raw.tobytes()
        self.answers = {k: answers.filter(pc.equal(answers["kind"], k)).sort_by("key") for k in range(3)}
        (a, place, start, count, doc), anchors, _ = anchors_of(self.raw, self.ends, width)
        told = _whole(self.answers[0]["first"].to_pylist(), np.uint8)
        of = told[np.searchsorted(anchors, a)] if len(a) else np.zeros(0, np.uint8)
        one = of == 1
        more = self.pieces(place[of == 2], start[of == 2], count[of == 2], doc[of == 2])
        self.anchor = np.concatenate([a[one], more[0]])
        self.start, self.count, self.doc = (np.concatenate([x, y]) for x, y in zip((start[one], count[one], doc[one]), more[1:]))
        data = self.data
        self.hash = np.array([xxhash.xxh3_64_intdigest(data[s : s + n + width - 1]) for s, n in zip(self.start.tolist(), self.count.tolist())], _U)
        order = np.lexsort((self.ids[self.doc], self.hash, self.anchor))
        x, h = self.anchor[order], self.hash[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (h[1:] != h[:-1])]) if len(x) else np.zeros(0, bool)
        #: Of the distinct passages one occurrence, that of the smallest id; and of each occurrence its distinct passage.
        self.first = order[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def pieces(self, place, start, count, doc) -> tuple:
        """(anchor, start, count, document): passages of crowded anchors by four starts, anchored by the bytes these share."""
        out = ([], [], [], [])
        data, width = self.data, self.width
        for p, s, n, d in zip(place.tolist(), start.tolist(), count.tolist(), doc.tolist()):
            at = s
            while at < s + n:
                step = (p - at) // _STEP  # the anchor lies step * _STEP to step * _STEP + 3 bytes behind these starts
                size = min(s + n - at, p - at - step * _STEP + 1)
                shared = data[p - step * _STEP : p - step * _STEP - _STEP + 1 + width]
                for column, value in zip(out, (xxhash.xxh3_64_intdigest(shared, seed=step), at, size, d)):
                    column.append(value)
                at += size
        return np.array(out[0], _U), *(np.array(x, np.int64) for x in out[1:])

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.count[k] + self.width - 1]

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct passage: its smallest id, its state (0 settled, 1 other passages share its anchor, 2 its bytes are asked for here), its number."""
        got = self.answers[1]
        low, state = _whole(got["first"].to_pylist(), np.int64), _whole(got["second"].to_pylist(), np.uint8)
        label = np.full(len(state), -1)
        label[state > 0] = _whole(got["third"].to_pylist(), np.int64)
        return low, state, label


def offer(docs: pa.Table, answers: pa.Table, width: int, routes: Routes) -> pa.Table:
    """For each route the batch's distinct passages: 32 bits of the anchor, hash, smallest id."""
    if not docs.num_rows:
        return pa.table({"route": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("anchors", "hashes", "lows")}})
    b = Batch(docs, answers, width)
    route, bounds, rest = routes.split(b.anchor[b.first])
    return pa.table({
        "route": pa.array(route, pa.int64()), "batch": pa.array(np.full(len(route), b.number), pa.int64()),
        "anchors": _blobs(bounds, rest), "hashes": _blobs(bounds, b.hash[b.first]), "lows": _blobs(bounds, b.ids[b.doc[b.first]]),
    })


def number(group: pa.Table) -> pa.Table:
    """Numbers a route's distinct passages; settles those whose anchor has no other, asks one batch for the bytes of the rest."""
    rests = group["anchors"].to_pylist()
    rest, h, low = _whole(rests, np.uint32), _whole(group["hashes"].to_pylist(), _U), _whole(group["lows"].to_pylist(), np.int64)
    order = np.lexsort((low, h, rest))
    r, x = rest[order], h[order]
    first_r = np.concatenate([[True], r[1:] != r[:-1]])
    first = first_r | np.concatenate([[True], x[1:] != x[:-1]])
    which, anchor = np.cumsum(first) - 1, np.cumsum(first_r) - 1
    mixed = np.bincount(anchor[first])[anchor] > 1
    lows, state, label = (np.empty(len(order), kind) for kind in (np.int64, np.uint8, np.int64))
    lows[order] = low[order][first][which]  # sorted by id within a passage
    state[order] = mixed.astype(np.uint8) + (mixed & first)
    label[order] = (np.int64(group["route"][0].as_py()) << 36) + which
    bounds = np.concatenate([[0], np.cumsum([len(b) // 4 for b in rests])])
    labels = pa.array([label[a:b][state[a:b] > 0].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
    return pa.table({"batch": group["batch"], "kind": pa.array(np.ones(len(rests), np.int32)), "key": group["route"], "first": _blobs(bounds, lows), "second": _blobs(bounds, state), "third": labels})


def send(docs: pa.Table, answers: pa.Table, width: int, tasks: int) -> pa.Table:
    """The passages that the batch was asked for, with the task that merges their anchor."""
    if not docs.num_rows:
        return pa.table({"task": pa.array([], pa.int64()), "anchor": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "passage": pa.array([], pa.binary())})
    b = Batch(docs, answers, width)
    low, state, label = b.settled()
    asked = np.flatnonzero(state == 2)
    at = b.first[asked]
    return pa.table({
        "task": pa.array((mix(b.anchor[at]) % _U(tasks)).astype(np.int64)), "anchor": pa.array(b.anchor[at].view(np.int64)), "label": pa.array(label[asked], pa.int64()),
        "low": pa.array(low[asked], pa.int64()), "passage": pa.array([b.bytes_of(k) for k in at.tolist()], pa.binary()),
    })


def merge(group: pa.Table, width: int, symbols: int = 1 << 16) -> pa.Table:
    """The smallest id of each string of each passage, by merging the transforms of all passages of an anchor.

    Anchors are merged some at a time, about `symbols` symbols together (or one
    anchor's, if it has more); passages of different anchors share no string.
    """
    group = group.sort_by("anchor")
    texts, low, anchor = group["passage"].to_pylist(), group["low"].to_numpy(), group["anchor"].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.cumsum([len(t) + 1 for t in texts])[np.append(begin[1:], len(texts)) - 1]
    ends = np.append(begin[1:], len(texts))
    last = np.flatnonzero(np.append(np.diff(size // symbols) > 0, True))
    out, at = [], 0
    for end in ends[last].tolist():
        lows, bounds = lowest_ids(texts[at:end], low[at:end], width)
        same = np.minimum.reduceat(lows, bounds[:-1]) == np.maximum.reduceat(lows, bounds[:-1])
        data = lows.tobytes()
        out += [data[8 * a : 8 * a + 8 if one else 8 * b] for a, b, one in zip(bounds[:-1].tolist(), bounds[1:].tolist(), same.tolist())]  # the same for all strings: once
        at = end
    return pa.table({"label": group["label"], "lows": pa.array(out, pa.binary())})


def cut(docs: pa.Table, answers: pa.Table, width: int, with_text: bool) -> pa.Table:
    """The figures of the batch's documents after cutting what a smaller id has."""
    out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    if docs.num_rows:
        b = Batch(docs, answers, width)
        low, state, label = b.settled()
        merged = dict(zip(b.answers[2]["key"].to_pylist(), b.answers[2]["first"].to_pylist()))
        lows = [merged[x] if x >= 0 else b"" for x in label.tolist()]
        one = np.array([len(x) == 8 for x in lows], bool)
        low = low.copy()
        low[one] = _whole([x for x in lows if len(x) == 8], np.int64)
        whole = one | (state == 0)  # one id for all strings of the passage
        own, edge = b.ids[b.doc], np.zeros(len(b.raw) + 1, np.int32)
        hit = np.flatnonzero(whole[b.which] & (low[b.which] < own))
        np.add.at(edge, b.start[hit], 1)
        np.add.at(edge, b.start[hit] + b.count[hit] + width - 1, -1)
        parts = np.flatnonzero(~whole[b.which])
        if len(parts):
            n = b.count[parts]
            each = _whole([lows[k] for k in b.which[parts].tolist()], np.int64)
            at = np.repeat(b.start[parts] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = at[each < np.repeat(own[parts], n)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
        covered = np.concatenate([np.cumsum(edge[:-1]) > 0, [False]])
        for k, i in enumerate(docs["id"].to_pylist()):
            s, e = b.ends[k], b.ends[k + 1]
            gone = covered[s:e]
            kept = b.raw[s:e][~gone].tobytes()
            out["id"].append(i)
            out["n_bytes"].append(int(e - s))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept)
    kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items() if with_text or k != "kept"})


def dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(batch, id, text) as a table bucketed by batch, the number of its buckets, and the bytes of all texts.

    A row's batch is drawn from its place, so that equal rows do not gather.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, size // BATCH_BYTES)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, size >> 28))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)))
    name = f"dealt_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows.repartition(buckets, "batch").write.option("compression", "zstd").option("path", path).bucketBy(buckets, "batch").saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    rows = spark.table(name)
    rows._dealt = (name, path)
    return rows, buckets, size


def drop_dealt(rows: DataFrame) -> None:
    """The table that dealt() wrote goes, from the catalog and from the shared folder."""
    name, path = rows._dealt
    rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    delete_folder(rows.sparkSession, path)


def each_group(f, **options):
    def run(group: pa.Table) -> pa.Table:
        return f(group, **options)

    return run


def each_batch(f, **options):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return f(docs, answers, **options)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 50, crowd: int = 4096, with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, with_text).

    The result is written to the shared folder; every table made on the way goes.
    """
    rows, tasks, size = dealt(docs, id_col, text_col)
    routes = Routes(max(tasks, size // (18 * ROUTE_ANCHORS)).bit_length())
    batches = lambda answers: rows.groupBy("batch").cogroup(answers.groupBy("batch"))
    asked = rows.groupBy("batch").applyInArrow(each_group(ask, width=width, routes=routes), "route long, batch long, anchors binary, counts binary")
    told = materialize(asked.groupBy("route").applyInArrow(each_group(answer, crowd=crowd), ANSWER), "told")
    offered = batches(told).applyInArrow(each_batch(offer, width=width, routes=routes), "route long, batch long, anchors binary, hashes binary, lows binary")
    numbered = materialize(offered.groupBy("route").applyInArrow(number, ANSWER), "numbered")
    asked_all, told = told, told.unionByName(numbered)
    sent = batches(told).applyInArrow(each_batch(send, width=width, tasks=tasks), "task long, anchor long, label long, low long, passage binary")
    merged = materialize(sent.groupBy("task").applyInArrow(each_group(merge, width=width), "label long, lows binary"), "merged")

    def labels(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in found:
            for batch, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                label = np.frombuffer(blob, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), batch)), pa.array(label)], ["batch", "label"])

    back = map_arrow(numbered.select("batch", "third"), labels, "batch long, label long").join(merged, "label")
    back = back.select("batch", F.lit(2).alias("kind"), F.col("label").alias("key"), F.col("lows").alias("first"), F.lit(None).cast("binary").alias("second"), F.lit(None).cast("binary").alias("third"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    done = materialize(batches(told.unionByName(back)).applyInArrow(each_batch(cut, width=width, with_text=with_text), schema), "cut")
    drop_dealt(rows)
    forget(asked_all, numbered, merged)
    return done.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
