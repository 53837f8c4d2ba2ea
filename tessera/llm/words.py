"""Words of whole texts in Arrow and numpy: cut at single bytes, and each distinct word looked at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Translations of UTF-8 bytes after which a space, and nothing else, parts words.
WHITE_SPACE = bytes(32 if i in _WHITE else i for i in range(256))
WHITE_SPACE_LOWER = bytes(32 if i in _WHITE else _LOWER[i] for i in range(256))
ALPHANUMERIC_LOWER = bytes(_LOWER[i] if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def translated(texts: pa.Array, table: bytes | None) -> pa.Array:
    """Null texts as empty ones, every byte of the others by `table`; no offset."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, 8 * texts.offset)
    raw = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(raw.translate(table) if table else raw)])


class Words:
    """distinct: the distinct words (binary). word: for each word of all texts, one after another, its row there.
    lengths: words of each text. doc: the text of each word."""

    def __init__(self, texts: pa.Array, table: bytes, distinct_only: bool = False):
        cut = pc.split_pattern(translated(texts, table), " ")
        n_cut = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(cut).dictionary_encode()
        self.distinct = coded.dictionary
        word, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(n_cut)), n_cut)
        empty = pc.index(self.distinct, pa.scalar(b"", self.distinct.type)).as_py()
        if empty >= 0:
            held = word != empty
            word, doc = word[held], doc[held]
        self.word, self.doc = word.astype(np.int64), doc
        self.lengths = np.bincount(doc, minlength=len(n_cut)).astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def listed(self) -> list[bytes]:
        return self.distinct.to_numpy(zero_copy_only=False).tolist()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of k words begin, and their texts. Shorter texts have none."""
        n = np.maximum(self.lengths - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return np.arange(int(n.sum())) + np.repeat(self.begins - (np.cumsum(n) - n), n), doc


def annotate(df: DataFrame, keep: list[str], work: Callable[[], Callable[[pa.Array], list[pa.Array]]], added: str, column: str = "text", max_bytes: int = 4 << 20) -> DataFrame:
    """Columns `row`, a struct of the columns in `keep`, and those in `added` (DDL), which the function that `work`
    makes for each task computes from the whole texts in `column`."""
    picked = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{column}`").cast("string").alias("text"))
    new = T.StructType.fromDDL(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in small_batches(batches, "text", max_bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0), *compute(batch.column(1))], names=["row", *new.names])

    return picked.mapInArrow(run, T.StructType([picked.schema["row"], *new.fields]))
