"""Token counts as delta-maintained rollups: signed rows update additive totals by source, language and tokenizer version.

A change is a signed row: +1 and its tokens for a document that came, -1 and minus its tokens for one that went; a revised count is one of
each. A batch is summed by key and written to a folder of its own; then one row in the log names the folder and the batches that it
holds. Only folders in the log are read, so an attempt that was cut off leaves nothing but an unused folder, and a batch that is
committed again changes nothing. Compaction folds batches into a base whose log row names them all: readers take the newest base
and those batches that it does not name, so a batch that comes late still counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Tokenizer versions, and the vocabulary file (ranks of byte-level BPE) and split pattern of each.
VOCABULARIES = {"byte-bpe-50k": "byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, docs long, tokens long"
LOG = "at bigint, kind string, batches array<bigint>, folder string"
#: Runs of Unicode white space that are encoded without the split pattern, which looks ahead from each of their characters.
LONG_BLANKS = re.compile("[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4000,}")
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(encoder, text: str) -> int:
    """Tokens of a whole text.

    The split pattern takes a run of blanks as one part, but for its last character before a word. Long runs are cut off there by hand: the
    parts, and so the count, are the same.
    """
    total, at = 0, 0
    for m in LONG_BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:]))


def counted(documents: DataFrame, version: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Rows (doc_id, source, lang, version, tokens), one for each row of ``documents`` (doc_id, text, source, lang).

    Whole texts are encoded, also very long ones and ones of blanks alone; null and empty texts have 0 tokens. Other columns are ignored.
    """
    path = f"{tokenizers.rstrip('/')}/{VOCABULARIES[version]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            n = [token_count(encoder, t.as_py()) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    rows = source.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return rows.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Changes (source, lang, version, docs, tokens) that add (+1) or take back (-1) counted documents."""
    return counts.select(*KEYS, F.lit(sign).cast("bigint").alias("docs"), (F.lit(sign) * F.col("tokens")).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the counts ``old`` by ``new``."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals below one folder, which all executors must reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _summed(self, changes: DataFrame) -> DataFrame:
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("docs", "tokens")]
        return changes.groupBy(*KEYS).agg(*sums)

    def _log(self) -> list:
        """One row for each folder that was written whole; batches are few, so the driver holds them."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _write(self, rows: DataFrame, kind: str, batches: list[int], at: int) -> None:
        folder = f"{kind}-{uuid.uuid4()}"
        rows.write.parquet(f"{self.root}/data/{folder}")
        self.spark.createDataFrame([(at, kind, batches, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _current(self) -> tuple[list[str], set[int]]:
        """Folders that hold every applied batch once, and the batches."""
        log = self._log()
        base = max((r for r in log if r.kind == "base"), key=lambda r: (len(r.batches), r.folder), default=None)
        held = set(base.batches) if base else set()
        folders = {r.batches[0]: r.folder for r in sorted(log, key=lambda r: r.folder, reverse=True) if r.kind == "batch" and r.batches[0] not in held}
        return ([base.folder] if base else []) + sorted(folders.values()), held | set(folders)

    def applied(self) -> set[int]:
        """Ids of the batches that were committed."""
        return self._current()[1]

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply the changes of a batch. Committing the same batch again, whole or after a failure, gives the same totals."""
        if batch not in self.applied():
            self._write(self._summed(changes), "batch", [batch], batch)

    def compact(self) -> None:
        """Fold all committed batches into a new base. A batch may still come later, whatever its id."""
        folders, batches = self._current()
        if batches:
            self._write(self._summed(self._read(folders)), "base", sorted(batches), max(batches))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def totals(self) -> DataFrame:
        """Rows (source, lang, version, docs, tokens); keys whose documents all went are left out. Null keys are keys of their own."""
        return self._summed(self._read(self._current()[0])).where("docs <> 0 or tokens <> 0")
