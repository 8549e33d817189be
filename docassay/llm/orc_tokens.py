"""Token ids in ORC files: stripes of run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of ``doc_id`` and sorted inside each range, so the files together are in ascending
order and every stripe covers a narrow span of ids. ORC's writer encodes the id lists with its integer run-length
encoding and keeps minimum, maximum and a Bloom filter of ``doc_id`` for each group of rows; readers take stripes in
parallel and skip files, stripes and row groups by that metadata. ``part`` and ``local_start`` give each document's place
in the whole stream without a second pass over the ids: the ids before it are those of earlier parts and its own
``local_start``.

Encoding goes word by word through a cache, since the tokenizer never joins anything across ASCII white space and words
repeat. A word that is one run of lower-case Latin letters is one pre-token and goes to the library's BPE model as it is;
any other word goes through the whole tokenizer. Both give the ids that the whole text would give (tested).
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docassay.llm.tokens import pieces, settled

END = 1
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Words remembered by a Python worker; a full cache is emptied and filled again.
CACHE = 800_000
FILE_SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
#: ORC settings: rows of an index group, and a Bloom filter with few false hits on the ids.
LAYOUT = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.compress": "ZSTD"}
_LETTERS = re.compile(r"""([a-zß-öø-ÿ]+)([!"#$%&()*+,./:;=?@\[\\\]^_`{|}~-]*)""")


class WordIds(dict):
    """UTF-8 word to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.marks: dict[str, bytes] = {}
        # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
        pre = self.whole.pre_tokenizer.pre_tokenize_str("abéÿ")
        self.direct = [p[0] for p in pre] == [self._mapped("abéÿ")] and self.whole.normalizer.normalize_str("aBc") == "abc"

    def _mapped(self, s: str) -> str:
        return "".join(map(self.letter.__getitem__, s.encode()))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode()
        lower = text.lower()
        m = _LETTERS.fullmatch(lower) if self.direct and len(text) <= 200 else None
        if m and (m[2] or lower != text):
            # the letters and the marks behind them are words of their own in the cache, shared by all such words
            out = self[m[1].encode()] + (self._marks(m[2]) if m[2] else b"")
        elif m:
            out = self._packed(t.id for t in self.model.tokenize(text if text.isascii() else self._mapped(text)))
        else:
            out = self._packed(self.whole.encode(text, add_special_tokens=False).ids)
        self[word] = out
        return out

    @staticmethod
    def _packed(ids: Iterable[int]) -> bytes:
        return array("I", ids).tobytes() if _LITTLE else np.array(list(ids), dtype="<u4").tobytes()

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= CACHE:
                self.marks.clear()
            self.marks[marks] = self._packed(t.id for t in self.model.tokenize(marks))
        return self.marks[marks]

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


_loaded: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's encoder of a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tokenised(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Rows of the file format from ``doc_id, text``, dealt out and sorted by ``doc_id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before, stop = encoder(tokenizer), TaskContext.get().partitionId(), 0, np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for piece in pieces(texts.to_pylist(), 8 << 20):
                rows = [words.encode(t) + stop for t in texts[piece].to_pylist()]
                n = np.array([len(r) // 4 for r in rows], dtype=np.int64)
                offsets = np.concatenate(([0], np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))
                yield pa.record_batch([pa.array(np.full(len(n), part), pa.int32()), ids[piece], pa.array(before + offsets[:-1]), pa.array(n), lists],
                                      ["part", "doc_id", "local_start", "n_tokens", "ids"])
                before += int(offsets[-1])

    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(
        "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(settled(run), FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Write ``docs`` (doc_id, text) as token files. A null or empty text is the end id alone; rows with one id follow
    each other by text; a null id comes first; an empty table gives an empty but readable folder."""
    tokenised(docs, tokenizer, end).write.options(**LAYOUT).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows, of all documents or of a list of ids; the filter reaches file, stripe and row-group metadata."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    rows = read_tokens(spark, path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written file, whatever the number of documents
    offsets = parts.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            crc = [zlib.crc32(values[a:b].astype("<i4", copy=False)) for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = rows.join(F.broadcast(offsets), "part")
    return placed.select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids").mapInArrow(
        settled(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
