"""Token ids in a binary file format: canonical length-limited Huffman codes from global counts.

`encode_corpus` writes a folder of three Parquet tables, which any Hadoop file system holds:

- `blocks`: whole documents in ascending doc_id order, about `block_tokens` ids a block. A block is independent: it has
  the documents' ids and lengths, the packed bits (most significant bit first), and a checkpoint, the bit offset, at
  every `stride`-th id.
- `codebook`: (id, bits), the code length of each id that occurs. Lengths fix a canonical code.
- `shards`: (shard, base), the number of ids before each shard.

`decode_corpus` reads them back by table: all checkpoints of a block are decoded side by side.

Defined results: a null text is an empty one, so it has the end id only. Null doc_ids come first. Repeated doc_ids are
kept, in the order of length and checksum. An empty table gives empty tables. Columns besides doc_id and text are not
read, whatever their names. No text is cut; a very long one makes a longer block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import drop_path, materialize, partitions, record_batch, small_batches, work_path

END_ID = 2
MAX_BITS = 16


# --- the code -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `max_bits` bits, by merging packages (coins of equal width) level by level.
    An id with count 0 has length 0. A single id has length 1."""
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit in {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(len(order), bool)]
    for _ in range(max_bits - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        is_leaf.append(rank < len(order))
    take = 2 * (len(order) - 1)
    for flags in reversed(is_leaf):
        n_leaves = int(flags[:take].sum())
        lengths[order[:n_leaves]] += 1
        take = 2 * (take - n_leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next `width` bits: id * 32 + code length."""
    width = max(1, int(lengths.max(initial=0)))
    codes = canonical_codes(lengths)
    table = np.zeros(1 << width, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (width - lengths[order].astype(np.int64))
    filled = int(span.sum())
    table[:filled] = np.repeat(order.astype(np.uint32) * 32 + lengths[order], span)
    assert not len(order) or int(codes[order[-1]]) + 1 << (width - int(lengths[order[-1]])) == filled
    return table, width


def pack_bits(codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all codes, of up to 16 bits each, and where every second one begins. Neighbours are joined first."""
    codes, lengths = codes.astype(np.uint64), lengths.astype(np.uint64)
    if len(codes) % 2:
        codes, lengths = np.append(codes, np.uint64(0)), np.append(lengths, np.uint64(0))
    codes = codes[::2] << lengths[1::2] | codes[1::2]
    lengths = lengths[::2] + lengths[1::2]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    if not len(ends):
        return b"", begins.astype(np.int64)
    words = np.zeros((int(ends[-1]) + 31 >> 5) + 1, np.uint64)
    at = (begins >> np.uint64(5)).astype(np.int64)
    codes <<= np.uint64(64) - (begins & np.uint64(31)) - lengths
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # a code is no longer than a word, so none is skipped
    into = at[first]
    words[into] += np.add.reduceat(codes >> np.uint64(32), first)
    words[into + 1] += np.add.reduceat(codes & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: int(ends[-1]) + 7 >> 3], begins.astype(np.int64)


def unpack_ids(bits: bytes, checkpoints: np.ndarray, n: int, stride: int, table: np.ndarray, width: int) -> np.ndarray:
    """The `n` ids of a block: one lane for each checkpoint, one table look-up for each lane and step."""
    if not n:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.asarray(checkpoints, np.int64).copy()
    out = np.empty((min(stride, n), len(at)), np.uint32)
    last = n - stride * (len(at) - 1)
    mask, up = np.uint32((1 << width) - 1), 32 - width
    for step in range(len(out)):
        if step == last:
            at = at[:-1]
        entry = table[window[at >> 3] >> (up - (at & 7)).astype(np.uint32) & mask]
        out[step, : len(at)] = entry >> 5
        at = at + (entry & 31)
    return out.T.reshape(-1)[:n]


# --- tables -------------------------------------------------------------------------------------------------------


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, crc, ids, tally): the ids of each whole text and the end id, as compressed little-endian
    integers. tally, in the first row of each batch, has the batch's ids and how often each occurs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()), ("tally", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for batch in small_batches(batches, "text", 8 << 20, tokenizer):
            ids, counts = encoder.encode(batch.column(1))
            ids, ends = ids.astype(np.uint32), np.cumsum(counts)
            times = np.bincount(ids, minlength=end_id + 1)
            times[end_id] += len(counts)
            seen = np.flatnonzero(times)
            tally = packer.compress(np.concatenate([seen, times[seen]]).astype(np.int64).tobytes())
            packed, crcs = [], []
            for begin, end in zip(ends - counts, ends):
                own = np.append(ids[begin:end], np.uint32(end_id))
                crcs.append(zlib.crc32(own.tobytes()))
                packed.append(packer.compress(own.astype(np.uint16).tobytes() if encoder.dtype == np.uint16 else own.tobytes()))
            yield record_batch(schema, {"doc_id": batch.column(0), "n_tokens": counts + 1, "crc": crcs, "ids": packed, "tally": [tally, *[None] * (len(counts) - 1)]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, crc long, ids binary, tally binary")


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def id_counts(table: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the tallies; each task sums up what it reads before the shuffle."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                seen, times = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64).reshape(2, -1)
                if seen[-1] >= len(counts):
                    counts = np.concatenate([counts, np.zeros(seen[-1] + 1 - len(counts), np.int64)])
                counts[seen] += times
        ids = np.flatnonzero(counts)
        if len(ids):
            yield record_batch(schema, {"id": ids, "n": counts[ids]})

    return table.select("tally").filter("tally is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = 1 << 18, stride: int = 256, max_bits: int = MAX_BITS) -> None:
    """Writes the format described above to the folder `path`. stride: an even number."""
    if max_bits > 16 or stride % 2:
        raise ValueError("codes of more than 16 bits, or an odd stride")
    spark = docs.sparkSession
    held = work_path(spark, "tokens")
    table = materialize(token_table(docs, tokenizer, end_id), "tokens", held, codec="uncompressed")
    counts = {r.id: r.n for r in id_counts(table).collect()}  # as many rows as the vocabulary has ids at most
    weights = np.zeros(max(counts, default=0) + 1, np.int64)
    weights[list(counts)] = list(counts.values())
    lengths = code_lengths(weights, max_bits)
    shared = spark.sparkContext.broadcast(lengths)
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_lengths = shared.value
        codes, shard, block, start = canonical_codes(own_lengths), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        doc_tokens: list[int] = []
        parts: list[np.ndarray] = []
        gathered = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            bits, begins = pack_bits(codes[ids], own_lengths[ids])
            return record_batch(schema, {"shard": [shard], "block": [block], "start": [start], "n_tokens": [len(ids)], "doc_ids": [doc_ids], "doc_tokens": [doc_tokens], "checkpoints": [begins[:: stride // 2]], "bits": [bits]})

        for batch in small_batches(batches, "ids", 1 << 20):
            for doc_id, n, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                doc_ids.append(doc_id)
                doc_tokens.append(n)
                parts.append(_unpacked(packed, n))
                gathered += n
                if gathered >= block_tokens:
                    yield flush()
                    block, start = block + 1, start + gathered
                    doc_ids, doc_tokens, parts, gathered = [], [], [], 0
        if parts:
            yield flush()

    ordered = table.repartitionByRange(partitions(spark), "doc_id", "n_tokens", "crc").sortWithinPartitions("doc_id", "n_tokens", "crc")
    blocks = ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, "shard int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, bits binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_path(spark, held)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    # one row for each shard that was written, as many as there are partitions
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    bases = np.cumsum([0] + [r.n for r in sizes])
    spark.createDataFrame([(r.shard, int(b)) for r, b in zip(sizes, bases)], "shard int, base long").coalesce(1).write.parquet(f"{path}/shards")


def decode_corpus(spark: SparkSession, path: str, stride: int = 256, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files alone."""
    lengths = np.zeros(0, np.uint8)
    if book := spark.read.parquet(f"{path}/codebook").collect():  # the vocabulary bounds it
        lengths = np.zeros(max(r.id for r in book) + 1, np.uint8)
        for r in book:
            lengths[r.id] = r.bits
    shared = spark.sparkContext.broadcast(lengths)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = decoding_table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["bits"], np.array(row["checkpoints"]), row["n_tokens"], stride, table, width)
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                own = [ids[b:e] for b, e in zip(ends - counts, ends)]
                out = {"doc_id": row["doc_ids"], "start": row["base"] + row["start"] + ends - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(x.tobytes()) for x in own]}
                yield record_batch(schema, out | ({"ids": [x.tolist() for x in own]} if with_ids else {}))

    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")
    blocks = blocks.select("start", "base", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op1_huffman(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = work_path(spark, "huffman")
    encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer or tokens.default_path("byte_bpe_50k.json"))
    return decode_corpus(spark, path)
