"""Line-first cleaning: drop failing lines by rule, then reject documents that lose too much.

Each line with a word is tested on its own: navigation (several short entries
between separators, or lists of links), boilerplate (phrases of notices and
calls to act, in four languages), symbol noise, and punctuation: too much (half
of the words end in ! or ?) or, on long lines, hardly any and none at the end.
Lines that
fail are removed; a document is rejected if it then keeps less than
``min_kept`` of its word characters. The base rules (too few words, too many
repeated three-word windows) reject before the method is asked.

Defined cases: a null or empty text has no words and fails the base rules; equal
rows are judged alike; a line without words is neither failed nor counted; an
empty table gives an empty result; only the id and the text are read, whatever
other columns there are; no document leaves its task, so long texts cost time
and memory in proportion to themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, map_arrow, table, words_of

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_END = (".", "!", "?", "…", ":", ";", '"', "'", ")", "]", "”", "’", "»", "。", "！", "？")
_SHOUT = ("!", "?", "！", "？")
_NAV = re.compile(r"\s[|»›>·•/]\s")
# Phrases of notices and calls to act, in the corpus' four languages.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "sign up", "log in",
    "subscribe to", "click here", "read more", "share this", "follow us", "powered by", "lorem ipsum", "enable javascript",
    "skip to content", "back to top", "use of cookies", "add to cart",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "utilisation de cookies", "cliquez ici",
    "lire la suite", "abonnez-vous", "suivez-nous", "se connecter", "ajouter au panier", "retour en haut",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "verwendung von cookies", "hier klicken",
    "weiterlesen", "newsletter abonnieren", "folgen sie uns", "jetzt anmelden", "in den warenkorb", "nach oben",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso", "uso de cookies", "haga clic aquí",
    "leer más", "suscríbete", "síguenos", "iniciar sesión", "añadir al carrito", "volver arriba",
)
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)


def line_fails(line: str, words: list[str]) -> str | None:
    """The rule that a line with words fails, or None."""
    n = len(words)
    if n >= 4 and 2 * (len(_NAV.findall(line)) + 1) >= n:
        return "navigation"
    if n <= 30 and _BOILER.search(line):
        return "boilerplate"
    if 4 * len(_SYMBOL.findall(line)) > n and n >= 4:
        return "symbols"
    if n >= 4 and 2 * sum(w.endswith(_SHOUT) for w in words) >= n:
        return "punctuation"
    if n >= 12 and not line.rstrip(SPACES).endswith(_END) and 40 * sum(w.endswith(_END) for w in words) < n:
        return "punctuation"
    return None


def repeat_words(words: list[str], width: int = 3) -> int:
    """Words inside a window of `width` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base = len(ids)
    if base**width < 2**62:
        key = code[:n].copy()
        for k in range(1, width):
            key = key * base + code[k : n + k]
    else:
        key = np.zeros(n, np.int64)
        for k in range(width):
            _, key = np.unique(key * base + code[k : n + k], return_inverse=True)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return 0
    hit = np.isin(key, twice)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[width : n + width] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge(text: str | None, min_kept: float = 0.3) -> dict:
    """All figures of one document, its cleaned text and the verdict."""
    text = text or ""
    n_words = chars = lost = dup = 0
    seen: set[str] = set()
    all_words: list[str] = []
    kept_lines: list[str] = []
    failed: dict[str, int] = {}
    for line in text.split("\n"):
        words = words_of(line)
        if not words:
            kept_lines.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        all_words += words
        here = sum(map(len, words))
        chars += here
        if rule := line_fails(line, words):
            lost += here
            failed[rule] = failed.get(rule, 0) + 1
        else:
            kept_lines.append(line)
    n_words, repeats = len(all_words), repeat_words(all_words)
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": dup, "n_repeat_words": repeats,
        "base_failed": base_failed, "kept": not base_failed and chars - lost >= min_kept * chars,
        "n_failed_lines": sum(failed.values()), "lost_chars": lost, "cleaned": "\n".join(kept_lines),
    }


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_failed_lines long, lost_chars long"
)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = True, min_kept: float = 0.3) -> DataFrame:
    """One row per input row: the id, the figures, the verdict and (with_text) the cleaned text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(t, min_kept) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), *[pa.array([r[c] for r in out], t) for c, t in _TYPES.items()]]
            names = ["id", *_TYPES]
            if with_text:
                cols.append(pa.array([r["cleaned"] for r in out], pa.string()))
                names.append("cleaned")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = map_arrow(rows, run, f"id {kind}, {SCHEMA}" + ", cleaned string" * with_text)
    return found.withColumnRenamed("id", id_col)


_TYPES = {c: pa.bool_() if t == "boolean" else pa.int64() for c, t in (x.split() for x in SCHEMA.split(", "))}


def query(spark, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
