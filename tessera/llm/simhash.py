"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the text's 3-word
shingles, repeats included. Bit i gets one of the seven non-zero vectors of three bits, and mask v keeps the bits
whose vector has an odd product with v. For any two bits some v is even with both, so two fingerprints that differ in at
most two bits agree under some of the seven masks: every linked pair meets in some table (Pagh's covering codes for
radius 2).

Inside a bucket no pairs are made. Two of its fingerprints are within two bits exactly if there is a point within one
bit of both, so each fingerprint of a shared bucket is sent to itself and to its neighbours in the bits that the mask
leaves out. What meets at a point is within two bits of one another, at most 65 fingerprints, and is linked as a star.
Only distinct fingerprints take part, so copies cost nothing. Components come from alternating large-star and
small-star steps, each written to the shared folder.

Two bits are far less than a similarity of 0.8: copies with one word in 50 changed differ in 3 to 11 bits, and masks for so
many can't be afforded. So `dedup` also links, by `near_copies`, distinct texts that are similar in their 5-word shingles:
whose Jaccard similarity is `SIMILAR` or more, or of whose words that share or more lies in shared shingles (in both,
of the longer one's words), since each changed word breaks five shingles but is one word. Shingles are put in an order, rare
ones first. Two texts at a Jaccard similarity of 0.8 share one of the first n - ceil(0.8 n) + 1 of their n shingles each, so
the texts that meet there and are about as long are candidates, and are verified on whole texts. Where many are, bitmaps of
shingles are held against codes of shingles first: these tell of most pairs that are not similar, and of none that is. Of a shingle that many
texts have, a few are held against all others, then, in rounds, more and more, until what is left lies in
one component: only pairs that are linked already, directly or not, are left out. So no pair at a Jaccard similarity of 0.8 is
lost but by colliding 64-bit hashes. A pair below it whose words are covered is found if one of the rarest fifth of its
shingles is shared: at a Jaccard similarity of 0.4 and 100 words, all but about one in 10,000. Work is linear for copies of one text, and the
number of pairs for texts that share rare shingles and are not copies.

Defined results: a null text is an empty one; its fingerprint is zero, linked like any other. Texts of one or two words
have one shingle. A component's id is its smallest doc_id; null doc_ids are ignored in it, and it is null if all are.
Repeated rows are kept, with equal results. An empty table gives no rows. `dedup` keeps the row with the smallest doc_id
of each component of all these links (null last, then the first as read), with all columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, record_batch, release, small_batches, work_path
from .words import WHITE_SPACE_LOWER, Words, annotate, translated

SHINGLE, SEED, BITS = 3, 42, 64
#: Words in a verified shingle; a pair at this similarity is linked; bounds are taken so much wider than they round.
COPY_SHINGLE, SIMILAR, SLACK = 5, 0.8, 1e-6
#: Texts, about, from which common shingles are known, and how many of these are kept; only an order depends on them.
ORDER_SAMPLE, MOST_ORDERED = 10_000, 100_000
#: Texts of a shingle that are held against all others in the first round, and how many times as many in each next one.
FIRST_HUBS, MORE_HUBS = 4, 16
#: Parts in which the texts of a shingle are put in order, before the first of each part are.
ORDER_PARTS = 32
#: Bits of a sketch for each distinct shingle, a multiple of 8: one in nine others seems to be there. Bits of a shingle's code.
SKETCH_BITS, CODE_BITS = 8, 16
#: Pairs that are verified without looking for spare ones first; pairs, and share of the texts, that move at a time.
FEW_PAIRS, MOST_PAIRS, MOVED_SHARE = 10_000, 500_000, 0.5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_VECTORS = [1 + i % 7 for i in range(BITS)]
#: Mask v - 1: the bits that table v keeps.
MASKS = [sum(1 << i for i, m in enumerate(_VECTORS) if (m & v).bit_count() & 1) for v in range(1, 8)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(texts: pa.Array) -> np.ndarray:
    words = Words(texts, WHITE_SPACE_LOWER)
    n = len(words.lengths)
    # each text's words with single spaces between, so that a shingle is a stretch of bytes
    length = np.fromiter(map(len, listed := words.listed()), np.int64, len(words.distinct))[words.word]
    ends = np.cumsum(length + 1) - 1
    begins = ends - length
    text = b" ".join(listed[w] for w in words.word.tolist())
    starts, doc = words.windows(SHINGLE)
    short = np.flatnonzero((words.lengths > 0) & (words.lengths < SHINGLE))
    first = np.concatenate([starts, words.begins[short]])
    last = np.concatenate([starts + SHINGLE - 1, words.begins[short] + words.lengths[short] - 1])
    owner = np.concatenate([doc, short])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    n_shingles = np.bincount(owner, minlength=n)
    out = np.zeros(n, np.uint64)
    held = np.flatnonzero(n_shingles)
    if len(held):
        if len(short):
            order = np.argsort(owner, kind="stable")
            hashes = hashes[order]
        counts = np.zeros((len(held), BITS), np.int64)
        at = np.concatenate([[0], np.cumsum(n_shingles[held])])
        step, i = 1 << 15, 0
        while i < len(held):  # some texts at a time, for bounded memory
            j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
            for k in range(at[i], at[j], step):
                own = hashes[k : min(k + step, at[j])]
                bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                if j == i + 1:
                    counts[i] += bits.sum(axis=0, dtype=np.int32)
                else:
                    counts[i:j] = np.add.reduceat(bits, at[i:j] - at[i], axis=0, dtype=np.int32)
            i = j
        set_bits = counts * 2 > n_shingles[held][:, None]
        out[held] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`row`, a struct of the columns in `keep`, and `fp`, the fingerprint as a signed long."""
    return annotate(docs, keep, lambda: lambda texts: [pa.array(fingerprints(texts).view(np.int64))], "fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b: stars that connect what is within two bits. distinct: (fp), each once."""
    tables = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(MASKS)))).alias("t")).select("fp", "t.v", "t.key")
    shared = tables.groupBy("v", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("v", "key")
    members = tables.join(shared, ["v", "key"], "left_semi")
    free = F.array(*(F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1)).cast("array<long>") for m in MASKS))
    near = members.select("fp", F.explode(F.element_at(free, F.col("v") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = near.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    low = F.array_min("fps")
    return met.select(low.alias("b"), F.explode("fps").alias("a")).filter("a <> b").select("a", "b").distinct()


def components(edges: DataFrame, most_rounds: int = 60, under: str | None = None) -> DataFrame:
    """(node, root) for each node of `edges` (a, b); root is the least node of its component. The rounds' tables are dropped
    once the next one is written. under: the path that the last one goes with."""
    spark = edges.sparkSession
    path, used = work_path(spark, "edges", under), []
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "", path)
    for _ in range(most_rounds):
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        used = [path, work_path(spark, "least", under)]
        # written first, so that Spark can split a node with very many neighbours in the join
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "", used[1])
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        path = work_path(spark, "edges", under)
        edges = materialize(small, "", path)
        for old in used:
            drop_path(spark, old)
        # settled once all edges make stars: each upper end has one lower end, and no end is both
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
    raise RuntimeError(f"components were not settled in {most_rounds} rounds")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of `fps` (doc_id, fp)."""
    by_fp = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = by_fp.join(components(links(by_fp.select("fp"))), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = materialize(found, "roots")
    return found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)


def _ordered(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the 5-word shingles of texts of as many words, in order, repeats included; and the hash of each word."""
    listed = words.listed()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in listed), np.uint64, len(listed))[words.word]
    starts, doc = words.windows(COPY_SHINGLE)
    found = np.zeros(len(starts), np.uint64)
    for i in range(COPY_SHINGLE):
        found = found * _ODD + hashes[starts + i]
    return doc, found, hashes


def _distinct(doc: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[first], found[first]


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct 5-word shingles of each text, a shorter text being one and an empty one having none;
    and the words of each text."""
    words = Words(texts, WHITE_SPACE_LOWER)
    doc, found, hashes = _ordered(words)
    short = np.flatnonzero((words.lengths > 0) & (words.lengths < COPY_SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for i in range(COPY_SHINGLE - 1):
        held = words.lengths[short] > i
        whole[held] = whole[held] * _ODD + hashes[words.begins[short[held]] + i]
    found = _mixed(np.concatenate([found, whole + words.lengths[short].astype(np.uint64)]))
    return *_distinct(np.concatenate([doc, short]), found), words.lengths


def _binary(n: np.ndarray, data: np.ndarray) -> pa.Array:
    """`data` cut into stretches of n[i] bytes."""
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a binary column begins, with an end, and the bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def sketches(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Of each text of `COPY_SHINGLE` words or more: a code of two bytes for each shingle, in order; a bitmap of about
    `SKETCH_BITS` for each distinct one, in which its code sets a bit; how many these are; and of each text, its words."""
    words = Words(texts, WHITE_SPACE_LOWER)
    doc, found, _ = _ordered(words)
    found = _mixed(found)
    code = (found >> np.uint64(64 - CODE_BITS)).astype("<u2")
    n = np.bincount(_distinct(doc, found)[0], minlength=len(texts))
    size = np.minimum(n * SKETCH_BITS, 1 << CODE_BITS) // 8
    bit = code % (8 * size)[doc]
    bits = np.zeros(size.sum(), np.uint8)
    np.bitwise_or.at(bits, (np.cumsum(size) - size)[doc] + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return _binary(2 * np.bincount(doc, minlength=len(texts)), code), _binary(size, bits), n, words.lengths


def likely(codes: pa.Array, sketch: pa.Array, n: np.ndarray, other_n: np.ndarray, words: np.ndarray, other_words: np.ndarray) -> np.ndarray:
    """Whether the text that codes[i], n[i] and words[i] are of and that of sketch[i], other_n[i] and other_words[i] may be
    similar; it is False only if they aren't. A shingle that both have is always found in the bitmap, so what is counted
    here is no less than what they share. Texts without shingles may be."""
    (first, code), (begins, bits) = _bytes(codes), _bytes(sketch)
    code = code.view("<u2")
    held, size = np.diff(first) // 2, 8 * np.diff(begins)
    out = (held == 0) | (size == 0)
    held = np.where(out, 0, held)
    owner = np.repeat(np.arange(len(held)), held)
    at = np.arange(held.sum()) + np.repeat(first[:-1] // 2 - (np.cumsum(held) - held), held)
    bit = code[at] % size[owner]
    hit = np.flatnonzero(bits[begins[owner] + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1)
    by = owner[hit]
    covers = np.full(len(hit), COPY_SHINGLE)
    covers[1:] = np.where(by[1:] == by[:-1], np.minimum(COPY_SHINGLE, np.diff(at[hit])), COPY_SHINGLE)
    shared, covered = np.bincount(by, minlength=len(held)), np.bincount(by, covers, minlength=len(held))
    jaccard = shared >= (n + other_n) * (SIMILAR / (1 + SIMILAR)) - SLACK
    return out | jaccard | (covered >= np.maximum(words, other_words) * SIMILAR - SLACK)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in order and how often a sample of texts has each. They only order shingles: any order
    gives the same pairs, and this one makes few candidates."""
    share = ORDER_SAMPLE / max(1, texts.count())
    point = F.pmod(F.xxhash64(F.lit("order"), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield record_batch(schema, {"shingle": shingle_hashes(batch.column(0))[1].view(np.int64)})

    counted = texts.filter(point < share).select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    rows = counted.filter("n > 2").orderBy(F.desc("n"), "shingle").limit(MOST_ORDERED).collect()
    hashes, n = np.array([r.shingle for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """texts: (id, text). (id, n, words, place, shingle, common): the rarest of the n shingles of each text, as many as two
    texts whose Jaccard similarity is `SIMILAR` can't both lack, the place of each in the order, and whether it is among
    the common ones."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("words", pa.int32()), ("place", pa.int32()), ("shingle", pa.int64()), ("common", pa.bool_())])
    known, times = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            doc, found, n_words = shingle_hashes(batch.column(1))
            often = np.zeros(len(found), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                often = np.where(known[at] == found, times[at], 0)
            order = np.lexsort((found, often, doc))
            doc, found, often = doc[order], found[order], often[order]
            n = np.bincount(doc, minlength=batch.num_rows)
            place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
            held = place <= n[doc] - np.ceil(SIMILAR * n[doc] - SLACK)
            doc = doc[held]
            yield record_batch(schema, {"id": batch.column(0).to_numpy()[doc], "n": n[doc].astype(np.int32), "words": n_words[doc].astype(np.int32), "place": place[held].astype(np.int32), "shingle": found[held].view(np.int64), "common": often[held] > 0})

    return texts.select("id", "text").mapInArrow(run, "id long, n int, words int, place int, shingle long, common boolean")


def _first(rows: DataFrame, hubs: int, path: str, single: bool) -> DataFrame:
    """rows: (id, shingle, root, share, ...). The first `hubs` texts of each shingle, with `rank` from 1. The order: texts of
    the smaller classes, then those that share most. It is made in parts and then among the first of each part, so that a
    shingle of very many texts isn't one task's. single: each text is a class of its own."""
    order = ("held", F.desc("share"), "id")
    if single:
        sized = rows.withColumn("held", F.lit(1).cast("long"))
    else:
        # written first, so that Spark can split a class of very many texts in the join
        sizes = materialize(rows.groupBy("shingle", "root").agg(F.count("*").alias("held")), "", f"{path}-sizes")
        sized = rows.join(sizes, ["shingle", "root"])
    parted = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(ORDER_PARTS)))
    parted = parted.withColumn("part_rank", F.row_number().over(Window.partitionBy("shingle", "part").orderBy(*order))).filter(F.col("part_rank") <= hubs)
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("shingle").orderBy(*order))).filter(F.col("rank") <= hubs)
    return materialize(first.drop("part", "part_rank", "held", "share"), "", f"{path}-first")


def similarity(a: str, b: str) -> float:
    """The greater of two: the Jaccard similarity of the sets of 5-word shingles (of whole texts, if they are shorter), and
    the words that lie in shared shingles, in the text that has less of them, as a share of the longer text's words."""

    def words(text: str) -> list[bytes]:
        return [w for w in text.encode().translate(WHITE_SPACE_LOWER).split(b" ") if w]

    def covered(shingles: list[tuple[bytes, ...]], shared: set[tuple[bytes, ...]]) -> int:
        total = end = 0
        for i, x in enumerate(shingles):
            if x in shared:
                total, end = total + i + COPY_SHINGLE - max(i, end), i + COPY_SHINGLE
        return total

    x, y = words(a), words(b)
    longest = max(len(x), len(y))
    if min(len(x), len(y)) < COPY_SHINGLE:
        return float(x == y)
    x, y = (list(zip(*(w[i:] for i in range(COPY_SHINGLE)))) for w in (x, y))
    p, q = set(x), set(y)
    shared = p & q
    return max(len(shared) / (len(p) + len(q) - len(shared)), min(covered(x, shared), covered(y, shared)) / longest)


def _turns(n_pairs: int, n_texts: int, moved: int) -> int:
    """Turns in which pairs go to all tasks, if each moves so many texts."""
    return max(1, -(-n_pairs // MOST_PAIRS), math.ceil(moved * n_pairs / max(1, n_texts) / MOVED_SHARE))


def _weighed(pairs: DataFrame, n_pairs: int, texts: DataFrame, n_texts: int, path: str) -> DataFrame:
    """(a, b, likely) of each of `pairs` (a, b). Texts don't move: of a, a bitmap does for each pair, of about a byte a word, and
    of b two bytes a word, once for all its pairs of a turn."""
    spark = texts.sparkSession
    drawn_schema = pa.schema([("id", pa.int64()), ("codes", pa.binary()), ("sketch", pa.binary()), ("n", pa.int64()), ("words", pa.int64())])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likely", pa.bool_())])

    def drawn(batches: Iterator[pa.RecordBatch], end: str) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            codes, sketch, n, words = sketches(batch.column(1))
            none = pa.nulls(len(n), pa.binary())
            yield record_batch(drawn_schema, {"id": batch.column(0), "codes": codes.cast(pa.binary()) if end == "b" else none, "sketch": sketch.cast(pa.binary()) if end == "a" else none, "n": n, "words": words})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "codes", 1 << 20):
            n, other_n, words, other_words = (batch.column(i).to_numpy() for i in range(4, 8))
            yield record_batch(schema, {"a": batch.column(0), "b": batch.column(1), "likely": likely(batch.column(2), batch.column(3), n, other_n, words, other_words)})

    turns = _turns(n_pairs, n_texts, 1)
    turn = lambda c: F.pmod(F.xxhash64(F.lit("turn"), c), F.lit(turns))
    for k in range(turns):
        now = pairs.select("a", "b").filter(turn("b") == k)
        ends = {}
        for c in "ab":
            of = texts.select("id", "text").join(F.broadcast(now.select(F.col(c).alias("id")).distinct()), "id", "left_semi")
            of = of.mapInArrow(lambda batches, c=c: drawn(batches, c), "id long, codes binary, sketch binary, n long, words long")
            ends[c] = of.select(F.col("id").alias(c), "codes" if c == "b" else "sketch", F.col("n").alias(f"n_{c}"), F.col("words").alias(f"words_{c}"))
        held = ends["a"].join(F.broadcast(now), "a").join(ends["b"], "b").select("a", "b", "codes", "sketch", "n_b", "n_a", "words_b", "words_a")
        materialize(held.mapInArrow(weigh, "a long, b long, likely boolean"), "", f"{path}-weighed-{k}")
        release(spark)
    return spark.read.schema("a long, b long, likely boolean").parquet(*(f"{path}-weighed-{k}" for k in range(turns)))


def _verified(pairs: DataFrame, n_pairs: int, texts: DataFrame, n_texts: int, path: str) -> DataFrame:
    """(a, b, similar) of each of `pairs` (a, b), by whole texts, but for those that sketches show not to be similar. As many
    pairs at a time as `MOST_PAIRS` and `MOVED_SHARE` let go to all tasks; only the texts in them move, and their shuffles go
    before the next are made, so what lies on disk doesn't grow with the pairs."""
    spark = texts.sparkSession
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similar", pa.bool_())])
    apart = None
    if n_pairs > FEW_PAIRS:
        weighed = _weighed(pairs, n_pairs, texts, n_texts, path)
        apart = weighed.filter("not likely").select("a", "b", F.lit(False).alias("similar"))
        pairs = weighed.filter("likely")
        n_pairs = pairs.count()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            yield record_batch(schema, {"a": a, "b": b, "similar": [similarity(s or "", t or "") >= SIMILAR for s, t in zip(x, y)]})

    turns = _turns(n_pairs, n_texts, 2)
    turn = lambda c: F.pmod(F.xxhash64(F.lit("turn"), c), F.lit(turns))
    for k in range(turns):
        now = pairs.select("a", "b").filter(turn("b") == k)
        other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).filter(turn("b") == k).join(F.broadcast(now.select("b").distinct()), "b", "left_semi")
        held = texts.select(F.col("id").alias("a"), "text").join(F.broadcast(now), "a").join(other, "b")
        materialize(held.select("a", "b", "text", "text_b").mapInArrow(verify, "a long, b long, similar boolean"), "", f"{path}-checked-{k}")
        release(spark)
    found = spark.read.schema("a long, b long, similar boolean").parquet(*(f"{path}-checked-{k}" for k in range(turns)))
    return found if apart is None else found.union(apart)


def near_copies(texts: DataFrame, under: str | None = None) -> DataFrame:
    """texts: (id, text), ids unique. (a, b) of verified near copies, whose components are those of all pairs at
    `SIMILAR` or more. under: the path that they go with."""
    spark = texts.sparkSession
    work = work_path(spark, "near")
    # a text that shares none of its rarest shingles goes no further
    # common shingles are known to be shared, so their rows needn't meet to be counted
    apart = F.when(F.col("common"), F.xxhash64("id")).otherwise(F.lit(0).cast("long"))
    found = _prefixes(texts, _common(texts)).withColumn("apart", apart).withColumn("among", F.count("*").over(Window.partitionBy("shingle", "apart")))
    shared = materialize(found.filter("common or among > 1").drop("among", "apart", "common"), "", f"{work}/shared")
    release(spark)
    share = shared.groupBy("id").agg((F.count("*") / F.first("n")).alias("share"))
    rows = materialize(shared.join(share, "id").withColumn("root", F.col("id")), "", f"{work}/rows-0")
    drop_path(spark, f"{work}/shared")
    n_texts = texts.count()
    checked, hubs, turn = None, FIRST_HUBS, 0

    def verified(pairs: DataFrame, n: int, name: str) -> None:
        nonlocal checked
        now = _verified(pairs, n, texts, n_texts, f"{work}/{name}-{turn}")
        checked = now if checked is None else checked.union(now)

    while True:
        # the first texts of a shingle are held against all others of it
        first = _first(rows, hubs, f"{work}/ranked-{turn}", single=not turn)
        drop_path(spark, f"{work}/ranked-{turn}-sizes")
        release(spark)
        hub = first.select("shingle", *(F.col(c).alias(f"hub_{c}") for c in ("id", "n", "words", "place", "root")))
        # shingles that two texts at SIMILAR share at least; all of them are at or after the first shared one in order
        least = (F.col("n") + F.col("hub_n")) * (SIMILAR / (1 + SIMILAR)) - SLACK
        jaccard = (F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place")) >= least) & (F.least("n", "hub_n") >= least)
        covered = F.least("words", "hub_words") >= F.greatest("words", "hub_words") * SIMILAR - SLACK
        fits = (F.col("root") != F.col("hub_root")) & (jaccard | covered)
        pairs = rows.drop("share").join(hub, "shingle").filter(fits).groupBy(F.greatest("id", "hub_id").alias("a"), F.least("id", "hub_id").alias("b")).agg(F.count("*").alias("times"))
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "", f"{work}/pairs-{turn}")
        release(spark)
        n_pairs = pairs.count()
        if n_pairs > FEW_PAIRS:
            # each text with the one that it shares most with; of the other pairs, those that these don't link already
            best = materialize(pairs.groupBy("a").agg(F.max(F.struct("times", F.col("b").alias("b"))).alias("m")).select("a", "m.b"), "", f"{work}/best-{turn}")
            verified(best, best.count(), "best")
            roots = materialize(components(checked.filter("similar").select("a", "b"), under=work), "", f"{work}/roots-{turn}")
            left = pairs.join(best, ["a", "b"], "left_anti")
            for end in "ab":
                left = left.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
            left = materialize(left.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "", f"{work}/left-{turn}")
            for name in ("pairs", "best", "roots"):
                drop_path(spark, f"{work}/{name}-{turn}")
            verified(left, left.count(), "rest")
            drop_path(spark, f"{work}/left-{turn}")
        else:
            verified(pairs, n_pairs, "all")
            drop_path(spark, f"{work}/pairs-{turn}")
        links = checked.filter("similar").select("a", "b")
        # shingles with more texts than were held against all others
        more = first.filter(F.col("rank") == hubs).select("shingle")
        rest = rows.join(more, "shingle", "left_semi").join(first.select("shingle", "id"), ["shingle", "id"], "left_anti")
        rest = materialize(rest.drop("root"), "", f"{work}/rest-{turn}")
        for name in (f"rows-{turn}", f"ranked-{turn}-first"):
            drop_path(spark, f"{work}/{name}")
        release(spark)
        if rest.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
        roots = components(links, under=work).withColumnRenamed("node", "id").withColumnRenamed("root", "now")
        rest = rest.join(roots, "id", "left").withColumn("root", F.coalesce("now", "id")).drop("now")
        turn, hubs = turn + 1, hubs * MORE_HUBS
        # what is left of a shingle and lies in one class needs no check
        mixed = rest.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
        rows = materialize(rest.join(mixed, "shingle", "left_semi"), "", f"{work}/rows-{turn}")
        drop_path(spark, f"{work}/rest-{turn - 1}")
        release(spark)
        if rows.isEmpty():
            break
    found = materialize(links, "", work_path(spark, "copies", under))
    drop_path(spark, work)
    return found


def text_keys(texts: pa.Array) -> pa.Array:
    """128 bits of each text's words, of which two texts have the same only if they are equal but for white space and
    the case of A to Z."""
    return pa.array([xxhash.xxh3_128_digest(b" ".join(t.split())) for t in translated(texts, WHITE_SPACE_LOWER).to_pylist()], pa.binary())


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """`rows` whose id is among `ids`, which go to all tasks as bitmaps, a bit for each id up to the largest of a partition: the
    rows, with their texts, don't move."""
    block = F.shiftright("id", 15)
    maps = ids.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("id").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    byte = "cast(conv(hex(substring(bits, cast(shiftright(id & 32767, 3) + 1 as int), 1)), 16, 10) as int)"
    held = F.expr(f"({byte} & shiftleft(1, cast(id & 7 as int))) <> 0")
    return rows.withColumn("block", block).join(F.broadcast(maps), "block").filter(held).drop("block", "bits")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of `docs`."""
    spark = docs.sparkSession
    print_and_key = lambda: lambda texts: [pa.array(fingerprints(texts).view(np.int64)), text_keys(texts)]
    work = work_path(spark, "dedup")
    held = materialize(annotate(docs, docs.columns, print_and_key, "fp long, key binary").withColumn("id", F.monotonically_increasing_id()), "", f"{work}/simhash")
    order = F.struct(F.col("row.doc_id").isNull().alias("x"), F.col("row.doc_id").alias("y"), F.col("id").alias("z"))
    # one row for each distinct text stands for it; equal texts have equal fingerprints
    distinct = materialize(held.groupBy("key").agg(F.min(order).alias("first"), F.first("fp").alias("fp")).select("first", "fp", F.col("first.z").alias("id")), "", f"{work}/first")
    # others can't stay, so these rows are all that is needed from here on
    kept = work_path(spark, "distinct")
    rows = materialize(_with_ids(held.select("id", "row"), distinct.select("id")), "", kept)
    drop_path(spark, f"{work}/simhash")
    release(spark)
    by_fp = materialize(distinct.groupBy("fp").agg(F.min("id").alias("of_fp")), "", f"{work}/fingerprints")
    ends = by_fp.select(F.col("fp").alias("a"), F.col("of_fp").alias("a_id")), by_fp.select(F.col("fp").alias("b"), F.col("of_fp").alias("b_id"))
    prints = links(by_fp.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = distinct.join(by_fp, "fp").filter("id <> of_fp").select(F.col("id").alias("a"), F.col("of_fp").alias("b"))
    linked = components(prints.union(same).union(near_copies(rows.select("id", F.col("row.text").alias("text")), work)), under=work)
    last = distinct.join(linked, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id")).agg(F.min("first").alias("first"))
    last = materialize(last.select(F.col("first.z").alias("id")), "last")
    drop_path(spark, work)
    release(spark)
    return _with_ids(rows, last).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op9_covering_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = materialize(with_fingerprint(docs, ["doc_id"]).select("row.doc_id", "fp"), "simhash")
    return fps.join(classes(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
