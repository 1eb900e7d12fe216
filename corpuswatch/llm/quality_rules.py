"""Quality rules: base counts, and tokenizer fertility under two public vocabularies with bands per language or script.

Fertility is measured on words: each distinct word of a slice of rows is encoded once, so long texts cost no more than their vocabulary.
A document's tokens are those of its words in turn. Measured are code points per token, the share of byte-fallback
tokens (characters that the vocabulary lacks) and the entropy of the document's token distribution in bits, all three under a
vocabulary of pieces, and code points per token under a byte-level vocabulary for many languages, which wrongly decoded text breaks up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm import words as W
from corpuswatch.llm.arrow_rows import veiled, with_measures

TOKENIZERS = "/opt/tokenizers"
#: Vocabularies that measure: pieces with byte fallback, and byte-level ranks for many languages.
VOCABULARY, SECOND_VOCABULARY = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NAMES = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "n_tokens": "bigint", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double", "second_chars_per_token": "double", "script": "string",
}


@dataclass(frozen=True)
class Band:
    """What a document must show to stay; token entropy is in bits."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    min_second_chars_per_token: float = 0.0


#: Bands per script (the script of most letters), and per language where its own is narrower. Random Latin letters give 1.5 to 1.6
#: characters per token (and 1.4 to 1.5 in the second vocabulary), hexadecimal and base64 1.0 to 1.3, Latin text decoded twice 1.5 to 1.7
#: (1.1 to 1.5); prose gives 1.7 or more, of common words 3 to 5.
SCRIPTS = {
    "latin": Band(1.6, 6.0, 0.10, 4.5, 1.5),
    "two_byte": Band(0.6, 5.0, 0.60, 3.5, 0.5),  # Greek, Cyrillic, Hebrew, Arabic and others of two bytes in UTF-8
    "wide": Band(0.2, 3.0, 0.95, 3.0, 0.2),  # three and four bytes: Indic, Thai, Han, Hangul, symbols
    "none": Band(0.0, 0.0, 0.0, 0.0),  # no letters at all: never inside
}
LANGUAGES: dict[str, Band] = {
    "en": Band(1.75, 6.0, 0.05, 4.5, 1.55), "de": Band(1.75, 6.0, 0.05, 4.5, 1.55), "es": Band(1.65, 6.0, 0.05, 4.5, 1.5), "fr": Band(1.65, 6.0, 0.05, 4.5, 1.5),
}


def _line_copies(text: bytes) -> int:
    seen: set[bytes] = set()
    copies = 0
    for line in text.split(b"\n"):
        if line in seen:
            copies += 1
        elif line.strip():
            seen.add(line)
    return copies


class Measure:
    """Measures of a slice of rows; made once per task, since it loads the vocabulary."""

    def __init__(self, path: str, second: str):
        import base64

        import sentencepiece
        import tiktoken

        with open(second, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.second = tiktoken.Encoding(second, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def tokens(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all words in turn, the text of each token, and the number of tokens of each word in the second vocabulary."""
        _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        words = [w.data[w.start[i] : w.end[i]].tobytes().decode(errors="replace") for i in first]
        pieces = self.model.encode(words, num_threads=1)
        second = np.fromiter((len(self.second._encode_single_piece(" " + word)) for word in words), dtype=np.int64, count=len(words))
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.fromiter((t for p in pieces for t in p), dtype=np.int64, count=int(length.sum()))
        begin = np.cumsum(length) - length
        n = length[which]
        at = np.arange(n.sum()) + np.repeat(begin[which] - (np.cumsum(n) - n), n)
        return flat[at], np.repeat(w.doc, n), second[which]

    def __call__(self, part: pa.RecordBatch) -> list:
        texts = part.column("text")
        w = W.words_of(texts, lower=False)
        n_docs, data, offsets = part.num_rows, w.data, w.offsets
        lead = (data & 0xC0) != 0x80
        inside = W.NOT_BLANK[data]

        def per_doc(mask: np.ndarray) -> np.ndarray:
            return W.sums(mask.astype(np.int64), offsets)

        chars = per_doc(lead & inside)
        copies = [_line_copies(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        hashes, whole = w.windows(3)
        doc = w.doc
        keys = W.mixed(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[whole]
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = np.flatnonzero(whole)[count[which] > 1] if len(keys) else np.zeros(0, np.int64)
        edge = np.zeros(len(w.hash) + 3, dtype=np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 3, -1)
        repeated = W.sums((np.cumsum(edge)[: len(w.hash)] > 0).astype(np.int64), w.first)

        token, of, second = self.tokens(w)
        n_tokens = np.bincount(of, minlength=n_docs)
        n_bytes = np.bincount(of, weights=self.is_byte[token], minlength=n_docs)
        pair, count = np.unique(of * self.size + token, return_counts=True)
        weighted = np.bincount(pair // self.size, weights=count * np.log2(count), minlength=n_docs)
        some = np.maximum(n_tokens, 1)
        entropy = np.where(n_tokens > 0, np.log2(some) - weighted / some, 0.0)

        n_second = np.maximum(np.bincount(doc, weights=second, minlength=n_docs), 1)

        latin = per_doc(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)) + per_doc((data >= 0xC3) & (data <= 0xC9))
        two, wide = per_doc((data >= 0xCA) & (data <= 0xDF)), per_doc(data >= 0xE0)
        kinds = np.array(["latin", "two_byte", "wide"])[np.argmax(np.stack([latin, two, wide]), axis=0)]
        kinds = np.where(latin + two + wide > 0, kinds, "none")
        integers = [w.counts, chars, per_doc(SYMBOLS[data]), np.array(copies, dtype=np.int64), repeated, n_tokens]
        return [
            *[pa.array(x, pa.int64()) for x in integers],
            *[pa.array(np.where(n_tokens > 0, x, 0.0), pa.float64()) for x in (chars / some, n_bytes / some, entropy, chars / n_second)],
            pa.array(kinds.tolist(), pa.string()),
        ]


def measured(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, second: str = SECOND_VOCABULARY) -> DataFrame:
    """``documents`` with all its columns plus the measures of ``NAMES``, row by row. Null texts count as empty: all zero."""
    paths = [f"{tokenizers.rstrip('/')}/{v}" for v in (vocabulary, second)]
    return with_measures(documents, NAMES, lambda: Measure(*paths))


def inside_bands(lang: Column, scripts: dict[str, Band], languages: dict[str, Band]) -> Column:
    """Whether the measures lie inside the band of the document's language, else of its script."""

    def fits(b: Band) -> Column:
        fertile = F.col("chars_per_token").between(b.min_chars_per_token, b.max_chars_per_token)
        fertile &= F.col("second_chars_per_token") >= b.min_second_chars_per_token
        return fertile & (F.col("byte_share") <= b.max_byte_share) & (F.col("token_entropy") >= b.min_entropy) & (F.col("n_tokens") > 0)

    out = F.lit(False)
    for name, band in scripts.items():
        out = F.when(F.col("script") == name, fits(band)).otherwise(out)
    for name, band in languages.items():
        out = F.when(lang == name, fits(band)).otherwise(out)
    return out


def judged(
    documents: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, scripts: dict[str, Band] = SCRIPTS, languages: dict[str, Band] = LANGUAGES,
    tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``documents`` plus the measures, ``base_failed`` and ``kept``.

    Words are runs without ASCII blanks. ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of the
    words in 3-word windows that occur twice or more in the text. ``kept``: not base_failed, and the fertility
    measures inside the band of the language (column ``lang``, if there is one and it has a band) or of the script. Null,
    empty and blank texts have no words and fail; a null or unknown language falls back to the script; rows that repeat are
    judged alike. Columns named like the measures are replaced. An empty table gives no rows.
    """
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    out = measured(documents, tokenizers, vocabulary)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside_bands(lang, scripts, languages), F.lit(False)))


def kept_documents(documents: DataFrame, **parameters) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with their own columns."""
    plain, restored = veiled(documents, ("text", "lang"))
    return restored(judged(plain, **parameters).where("kept"))
