"""Statistics of whole texts that the quality operators share."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

WORDS = re.compile(S.WORD)
#: Symbols that the base rule counts (fixed value).
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:?'\"()-"
#: Inputs of the quality score: shape of the text only.
FEATURES = (
    "log_words", "mean_word", "spread_word", "symbols", "upper", "digits", "punctuation", "pipes", "shouts", "line_words",
    "dup_lines", "repeats", "distinct", "short_words", "long_words", "capital_words", "other_bytes", "sentences",
)
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<float>"


def repeated_words(words: list[str], window: int = 5) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    name = ids
    for k in range(1, window):  # exact names of windows that grow by a word
        pair = name[: len(words) - k] * len(seen) + ids[k:]
        _, name = np.unique(pair, return_inverse=True)
    hot = np.bincount(name)[name] > 1
    if not hot.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += hot
    edge[window : window + n] -= hot
    return int((np.cumsum(edge[:-1]) > 0).sum())


def describe(text: str) -> tuple[int, int, int, int, int, list[float]]:
    """The base counts and the features of one text; an empty text has zeros."""
    words = WORDS.findall(text)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, chars, symbols = len(words), int(lengths.sum()), int(raw[list(SYMBOLS)].sum())
    lines = [line for line in text.split("\n") if WORDS.search(line)] if "\n" in text else [text] * bool(n)
    dup, repeats = len(lines) - len(set(lines)), repeated_words(words)
    if not n:
        return 0, 0, symbols, dup, repeats, [0.0] * len(FEATURES)
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    sample = [
        np.log1p(n), chars / n, float(lengths.std()), symbols / chars, raw[65:91].sum() / letters, raw[48:58].sum() / chars,
        raw[list(PUNCTUATION)].sum() / chars, raw[124] / n, raw[33] / n, np.log1p(n / len(lines)),
        dup / len(lines), repeats / n, np.log1p(len(set(words))) / np.log1p(n), (lengths <= 3).mean(), (lengths >= 12).mean(),
        sum(map(str.istitle, words)) / n, raw[128:].sum() / chars, text.count(". ") / n,
    ]
    return n, chars, symbols, dup, repeats, [float(x) for x in sample]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of numbers per document, in one pass over the texts."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = zip(*map(describe, batch.column(1).to_pylist()), strict=True)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features")
        return {"doc_id": batch.column(0)} | dict(zip(names, rows, strict=True))

    return S.map_batches(S.texts(docs, id_col, text_col), run, COLUMNS)


def remainder(doc_id: str, folds: int = 5):
    """Fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(folds))
