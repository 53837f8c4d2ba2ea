"""Order-preserving packing: dynamic programming over window cuts.

Documents of a partition, in its order, make one stream of ids. Cuts may fall after a document (free), after a sentence
(`SENTENCE` ids' worth) or, where none of these comes for `STEP` ids, inside a sentence (`INSIDE`). Among all ways to cut
the stream into windows of at most `size` ids, the one with the least padding plus penalties is chosen: the best start
of a window that ends at j is the least f(i) + i of the last `size` positions, which a monotone queue holds; windows of
a power of two from `LEAST_POWER` need no padding and are tried as well. No shuffle is needed; a partition's last window
may be split into powers of two.

Memory: cuts are settled for about `horizon` ids at a time; all but the last few windows are then given out.

Defined results: a null text is an empty one and gives the end id. Each row is packed, repeated and null doc_ids too; the
pieces of a row follow one another in its partition's stream. An empty table gives no pieces. sequence_id is unique,
rising in a partition, with gaps between partitions. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import record_batch, small_batches

SIZE, END_ID = 4096, 2
SENTENCE, INSIDE, STEP, LEAST_POWER, WINDOW = 16.0, 96.0, 128, 256, 4.0
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*(</w>)?$")


def sentence_ends(tokenizer) -> np.ndarray:
    """A flag for each id: a sentence ends after it."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    flags = np.zeros(max(vocab.values()) + 1, bool)
    flags[[i for token, i in vocab.items() if _SENTENCE_END.search(token)]] = True
    return flags


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, rising, and what each cut costs."""
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    cost[1:][ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]] = SENTENCE
    cost[doc_ends] = 0.0
    cost[0] = cost[n] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        per = (gaps[wide] - 1) // step
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + 1
        cost[np.repeat(at[wide], per) + k * step] = INSIDE
        at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """The cuts of the cheapest cover of at[0] to at[-1]; neighbours in `at` are at most `size` apart."""
    places, costs = at.tolist(), cost.tolist()
    n = len(places)
    index = {p: i for i, p in enumerate(places)}
    powers = [p for p in (1 << k for k in range(size.bit_length())) if LEAST_POWER <= p < size]
    total, back, key = [0.0] * n, [0] * n, [0.0] * n
    key[0] = float(places[0])
    queue = deque([0])
    for j in range(1, n):
        here = places[j]
        while places[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - here
        for power in powers:
            k = index.get(here - power)
            if k is not None and total[k] < best:
                best, i = total[k], k
        total[j] = best = best + costs[j] + WINDOW
        back[j] = i
        key[j] = own = best + here
        while queue and key[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return [places[0], *cuts[::-1]]


def padding(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def split_tail(cuts: list[int], size: int = SIZE) -> list[int]:
    """Cuts the last window into powers of two if that costs less than its padding."""
    begin, end = cuts[-2:]
    length = end - begin
    if bin(length).count("1") * INSIDE >= padding(length, size):
        return cuts
    out = cuts[:-1]
    for k in reversed(range(length.bit_length())):
        if length >> k & 1:
            out.append(out[-1] + (1 << k))
    return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, horizon: int = 64, with_ids: bool = False) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).
    horizon: windows that are settled at a time."""
    fields = [(x.split()[0], pa.int64()) for x in _PIECE.split(", ")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    hold = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        ends_sentence = sentence_ends(encoder.tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        ids = np.empty(0, np.uint32)  # what is not given out yet, with its documents: id, length, ids given out before
        owners: list[tuple[int | None, int, int]] = []

        def settle(last: bool) -> pa.RecordBatch | None:
            nonlocal ids, owners, sequence
            own_ends = np.cumsum([n - given for _, n, given in owners])
            cuts = best_cuts(*candidates(ids, own_ends, ends_sentence), size)
            if last:
                cuts = split_tail(cuts, size)
            elif len(cuts) <= hold + 1:
                return None
            else:
                cuts = cuts[:-hold]
            upto = cuts[-1]
            own_begins = np.concatenate([[0], own_ends[:-1]]).astype(np.int64)
            edges = np.unique(np.concatenate([cuts, own_begins[own_begins < upto]]))
            begins, ends = edges[:-1], edges[1:]
            owner = np.searchsorted(own_begins, begins, side="right") - 1
            window = np.searchsorted(cuts, begins, side="right") - 1
            given = np.array([g for _, _, g in owners], np.int64)
            out = {
                "doc_id": [owners[k][0] for k in owner], "start": begins - own_begins[owner] + given[owner], "length": ends - begins,
                "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())], "doc_tokens": [owners[k][1] for k in owner],
                "sequence_id": sequence + window, "offset": begins - np.array(cuts, np.int64)[window],
            }
            if with_ids:
                out["ids"] = [ids[a:b].tolist() for a, b in zip(begins, ends)]
            sequence += len(cuts) - 1
            first = int(np.searchsorted(own_ends, upto, side="right"))
            rest = owners[first:]
            if rest:
                doc_id, n, g = rest[0]
                rest[0] = (doc_id, n, g + upto - int(own_begins[first]))
            ids, owners = ids[upto:], rest
            return record_batch(schema, out)

        for batch in small_batches(batches, "text", 4 << 20, tokenizer):
            found, counts = encoder.encode(batch.column(1))
            ends = np.cumsum(counts)
            stream = np.insert(found.astype(np.uint32), ends, np.uint32(end_id))
            ids = np.concatenate([ids, stream])
            owners += [(d, int(n) + 1, 0) for d, n in zip(batch.column(0).to_pylist(), counts)]
            if len(ids) >= horizon * size and (out := settle(False)) is not None:
                yield out
        if len(ids):
            yield settle(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE + ", ids array<long>" * with_ids)


def op4_order_preserving(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or tokens.default_path("word_bpe_49k.json"))
