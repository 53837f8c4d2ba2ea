"""Token files, media, sharding and packing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import gif, huffman, packing, sharding, tokens
from tessera.llm.common import small_batches

from .conftest import TEXTS, listed

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def whole(name, text, end=True):
    ids = tokens.encoder(tokens.default_path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids + [2] * end


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- ids ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_stretches_give_the_ids_of_whole_texts(name):
    encoder = tokens.Encoder(tokens.default_path(name), keep=40)
    alphabet = ["a", "The", "dog", "é", "ǆ", "Σ", "٣", "7", ",", ".", "!", "'s", "'", " ", " ", "\n", "\t", " ", "\r", "\0", "日", "́", "<|endoftext|>"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(3000)] + [t or "" for _, t, *_ in TEXTS]
    for i in range(0, len(texts), 100):
        own = texts[i : i + 100]
        ids, counts = encoder.encode(own)
        for text, part in zip(own, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == whole(name, text, False), repr(text)


def test_no_texts():
    assert [len(x) for x in tokens.Encoder(tokens.default_path(BYTE)).encode([])] == [0, 0]


# --- Huffman ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=0, max_size=300), st.integers(9, 16))
def test_codes_are_complete_and_limited(counts, most):
    lengths = huffman.code_lengths(np.array(counts, np.int64), most).astype(int)
    used = lengths[np.array(counts, np.int64) > 0]
    assert (lengths <= most).all() and (lengths[np.array(counts, np.int64) == 0] == 0).all() and (used > 0).all()
    if len(used) > 1:
        assert sum(2.0 ** -used) == 1.0


def test_lengths_are_optimal():
    import heapq

    rng = np.random.default_rng(3)
    for n in (2, 3, 10, 60):
        counts = rng.integers(1, 1000, n)
        heap = [(int(c), i, ()) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        cost, k = 0, n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], k, ()))
            k += 1
        assert int((huffman.code_lengths(counts, 40) * counts).sum()) == cost
    # Fibonacci counts want codes of 20 bits; at 6 a dynamic programme over Kraft sums finds the same cost
    fib = [1, 1]
    while len(fib) < 20:
        fib.append(fib[-1] + fib[-2])
    lengths = huffman.code_lengths(np.array(fib), 6).astype(int)
    best = {0: 0}
    for c in fib:
        best = min_merge(best, c, 6)
    assert lengths.max() <= 6 and int((lengths * fib).sum()) == min(v for k, v in best.items() if k <= 64)


def min_merge(best, count, most):
    out = {}
    for used, cost in best.items():
        for n in range(1, most + 1):
            k = used + (1 << (most - n))
            if k <= 1 << most:
                out[k] = min(out.get(k, 1 << 60), cost + n * count)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(0, 4000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=5)) if n else np.zeros(0, np.uint8)
    bits, begins = huffman.pack_bits(huffman.canonical_codes(lengths)[ids], lengths[ids]) if n else (b"", np.zeros(0, np.int64))
    table, width = huffman.decoding_table(lengths)
    assert huffman.unpack_ids(bits, begins[::128], n, 256, table, width).tolist() == ids.tolist()
    if n > 256:  # a checkpoint is enough to begin at
        assert huffman.unpack_ids(bits, begins[128::128], n - 256, 256, table, width).tolist() == ids[256:].tolist()


def test_token_files(spark, odd, tmp_path):
    path = f"file://{tmp_path}/files"
    huffman.encode_corpus(odd, path, tokens.default_path(BYTE), block_tokens=500, stride=64)
    found = listed(huffman.decode_corpus(spark, path, stride=64, with_ids=True))
    assert Counter((r[0], tuple(r[4])) for r in found) == Counter((i, tuple(whole(BYTE, t))) for i, t, *_ in TEXTS)
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in found), key=lambda x: (x is not None, x or 0))
    at = 0
    for _, start, n, c, ids in found:
        assert (start, n, c) == (at, len(ids), crc(ids))
        at += n


def test_token_files_of_nothing(spark, none, tmp_path):
    huffman.encode_corpus(none, f"file://{tmp_path}/files", tokens.default_path(BYTE))
    assert listed(huffman.decode_corpus(spark, f"file://{tmp_path}/files")) == []


def test_op1(spark, docs, docs_dir):
    found = {r.doc_id: r for r in huffman.op1_huffman(spark, docs_dir).collect()}
    at = 0
    for doc in docs.orderBy("doc_id").collect():
        ids = whole(BYTE, doc.text)
        assert (found[doc.doc_id].start, found[doc.doc_id].n_tokens, found[doc.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(found) == docs.count()


# --- GIF ----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 30))
def test_lzw_round_trip(data, times):
    assert gif.lzw_decode(gif.lzw_encode(data * times), 8) == data * times


@pytest.mark.parametrize("bits", [2, 3, 7, 8])
def test_lzw_of_few_colours_and_full_tables(bits):
    data = bytes(random.Random(bits).randrange(1 << bits) for _ in range(40_000))
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits) == data


def slow_lzw(codes, bits):
    """By the book, a code at a time."""
    clear, out, table, before = 1 << bits, b"", [], None
    for code in codes:
        if code == clear:
            table, before = [bytes([i]) for i in range(clear)] + [b"", b""], None
        elif code == clear + 1:
            break
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            before = entry
    return out


def pack_codes(codes, bits):
    """Widths as a decoder has them, the table kept when full."""
    clear, value, at, size, fresh, width = 1 << bits, 0, 0, 0, True, bits + 1
    for code in codes:
        value |= code << at
        at += width
        if code == clear:
            size, fresh, width = clear + 2, True, bits + 1
        else:
            size, fresh = (size if fresh else min(size + 1, 4096)), False
            width = min(12, max(width, size.bit_length())) if size >= 1 << width else width
    return value.to_bytes((at + 7) // 8, "little")


def test_lzw_with_clear_codes_anywhere_and_a_deferred_clear():
    rng = random.Random(5)
    for deferred in (False, True):
        codes, size = [256], 258
        fresh = True
        for _ in range(9000):
            if not deferred and rng.random() < 0.002:
                codes.append(256)
                size, fresh = 258, True
                continue
            top = size if not fresh and size < 4096 else size - 1
            code = rng.randrange(256) if fresh else rng.choice([rng.randrange(256), rng.randrange(258, top + 1) if top >= 258 else 65])
            codes.append(code)
            size, fresh = (size if fresh else min(size + 1, 4096)), False
        codes.append(257)
        assert gif.lzw_decode(pack_codes(codes, 8), 8) == slow_lzw(codes, 8)


def test_a_code_too_high_is_an_error():
    with pytest.raises(ValueError):
        gif.lzw_decode(pack_codes([256, 65, 300, 257], 8), 8)


RED, GREEN, BLUE, BLACK = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)


def test_palettes_disposal_transparency_and_times():
    palette = bytes(sum((RED, GREEN, BLUE, BLACK), ()))
    frames = [
        {"samples": bytes([0] * 16), "delay_ms": 100, "disposal": gif.KEEP},
        {"samples": bytes([1, 3, 3, 1]), "left": 1, "top": 1, "width": 2, "height": 2, "delay_ms": 200, "disposal": gif.BACKGROUND, "transparent": 3},
        {"samples": bytes([2]), "left": 3, "top": 3, "width": 1, "height": 1, "delay_ms": 30, "disposal": gif.PREVIOUS},
        {"samples": bytes([0, 1]), "width": 2, "height": 1, "palette": bytes((9, 9, 9, 8, 8, 8)), "disposal": 0},
        {"samples": bytes(range(2)) * 8, "interlaced": True, "palette": bytes(RED + GREEN)},
    ]
    data = gif.write(4, 4, palette, frames)
    (w, h), shown = gif.decode(data)
    shown = list(shown)
    at = lambda f, x, y: tuple(int(v) for v in f.canvas[y, x])
    assert (w, h) == (4, 4) and [f.delay_ms for f in shown] == [100, 200, 30, 0, 0] and [f.disposal for f in shown] == [1, 2, 3, 0, 1]
    assert at(shown[0], 0, 0) == (*RED, 255)
    assert at(shown[1], 1, 1) == (*GREEN, 255) and at(shown[1], 2, 1) == (*RED, 255) and shown[1].transparent == 3
    assert at(shown[2], 1, 1) == (0, 0, 0, 0) and at(shown[2], 3, 3) == (*BLUE, 255)  # the area before was cleared
    assert at(shown[3], 3, 3) == (*RED, 255) and at(shown[3], 0, 0) == (9, 9, 9, 255)  # what was there before is back
    assert [at(shown[4], x, y) for y in range(4) for x in range(2)] == [(*RED, 255), (*GREEN, 255)] * 4
    assert gif.histogram(shown[0].canvas).sum() == 16 and gif.histogram(shown[2].canvas).sum() == 12


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"nothing", gif.encode_payload(b"a" * 64)[:-40]])
def test_broken_media_are_one_row(spark, data):
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(gif.encode_payload(b"b" * 64))), (3, None)], "doc_id long, media binary")
    found = {r.doc_id: r for r in gif.frame_table(df).collect()}
    assert found[1].error and found[3].error and found[2].error is None and found[2].frame == 0 and sum(found[2].histogram) == 64


def test_timed_frames(spark):
    media = gif.encode_payload(gif.pad(bytes(range(256)) * 600))
    found = gif.frame_table(spark.createDataFrame([(1, bytearray(media))], "doc_id long, media binary")).orderBy("frame").collect()
    assert [r.at_ms for r in found] == [100 * i for i in range(len(found))] and len(found) == 5 and sum(r.height * r.width for r in found) == 256 * 600


def test_media_of_odd_texts(spark, odd, none):
    found = listed(gif.payload_features(gif.media_table(odd)))
    wanted = Counter()
    for i, t, *_ in TEXTS:
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        wanted[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter(r[:5] for r in found) == wanted
    by_payload = defaultdict(set)
    for r in found:
        by_payload[r[3]].add(str(r[5:]))
    assert all(len(v) == 1 for v in by_payload.values())
    assert listed(gif.payload_features(gif.media_table(none))) == []


def test_frames_tell_their_samples_by_colour(spark):
    data = bytes(range(256)) * 700
    payload, frames, colours = gif.decode_payload(gif.encode_payload(gif.pad(data)))
    assert payload == data and len(frames) == len(colours) == 6
    # each of the 64 colours counts four byte values
    assert sum(colours).tolist() == [4 * 700] * 64
    one = gif.decode_payload(gif.encode_payload(gif.pad(b"\xff" * 64)))[2][0]
    assert one[63] == 64 and one.sum() == 64


def test_frames_are_stored_beside_the_digests(spark, docs, docs_dir):
    found = gif.payload_features(gif.media_table(docs)).collect()
    assert len(found) == docs.count()
    for r in found:
        assert len(r.frames) == r.n_frames and [f.at_ms for f in r.frames] == [100 * i for i in range(r.n_frames)]
        assert sum(sum(f.histogram) for f in r.frames) == r.payload_bytes == sum(f.width * f.height for f in r.frames)
        assert [sum(c) for c in zip(*(f.histogram for f in r.frames))] == [int(x) for x in r.feature.split(",")]


def test_media_that_claim_too_much_are_errors(spark, monkeypatch):
    small = gif.write(1, 1, bytes(6), [{"samples": b"\0"}])
    huge = small[:6] + b"\xff\xff\xff\xff" + small[10:]
    codes = gif.write(1, 1, bytes(768), [{"samples": bytes(3_000_000)}])  # codes for millions of samples, a frame of one
    df = spark.createDataFrame([("a", bytearray(huge), 1), ("b", bytearray(codes), 2), ("c", bytearray(small), 3)], "doc_id string, media binary, frame int")
    found = {r.doc_id: r for r in gif.frame_table(df).collect()}
    assert "canvas" in found["a"].error and found["b"].error is None and sum(found["b"].histogram) == 1 and found["c"].frame == 0
    assert len(gif.lzw_decode(gif.lzw_encode(bytes(3_000_000)), 8, 1)) < 1 << 24
    monkeypatch.setattr(gif, "MOST_DRAWN", 2)
    with pytest.raises(ValueError, match="frames"):
        list(gif.decode(gif.write(1, 1, bytes(6), [{"samples": b"\0"}] * 3))[1])


def test_op2(spark, docs, docs_dir):
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in gif.op2_gif(spark, docs_dir).collect():
        payload = gif.pad(texts.pop(r.doc_id))
        media = gif.encode_payload(payload)
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
    assert not texts


# --- sharding -----------------------------------------------------------------------------------------------------


def test_shards_split_only_where_needed(spark, docs):
    limit = 20_000
    found = sharding.assign(docs, limit).collect()
    sizes = Counter()
    for r in found:
        bits = f"{r.hash:060b}"
        assert bits.startswith(r.shard) and len(r.shard) == r.depth
        sizes[r.shard] += r.n_bytes
    total = Counter()
    for r in found:
        for k in range(61):
            total[f"{r.hash:060b}"[:k]] += r.n_bytes
    for r in found:
        assert r.shard_bytes == sizes[r.shard] and (r.shard_bytes <= limit) != r.overflow
        if r.depth and not r.overflow:
            assert total[r.shard[:-1]] > limit  # its parent was oversized
    assert len(found) == docs.count() and len(sizes) > 10


def test_shards_of_odd_rows(spark, odd, none, tmp_path):
    found = listed(sharding.assign(odd, 100))
    assert len(found) == len(TEXTS) and {r[0] for r in found if r[6]} == {4, 5}
    assert len({r[3] for r in found if r[0] is None}) == 1
    assert listed(sharding.assign(none, 100)) == [] and {r[3] for r in listed(sharding.assign(odd, 1 << 40))} == {""}
    name = sharding.write_shards(odd, f"file://{tmp_path}/s", 100)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert name == "shard__" and Counter(listed(back.select(odd.columns))) == Counter(listed(odd))


def test_buckets_below_one_prefix(spark):
    import random

    rng = random.Random(9)
    for n, limit in ((1, 5), (3, 0), (40, 30), (3000, 200)):
        cells = sorted(rng.sample(range(4096), n))
        sizes = {c: rng.randrange(20) for c in cells}
        spans = {c: (c << 4, (c << 4) + rng.randrange(2)) for c in cells}
        depth, size = sharding.settle(np.array(cells), np.array([sizes[c] for c in cells]), np.array([spans[c][0] for c in cells]), np.array([spans[c][1] for c in cells]), limit)
        for c, d, b in zip(cells, depth.tolist(), size.tolist()):
            wanted = -1, 0
            for bits in range(13):
                group = [x for x in cells if x >> 12 - bits == c >> 12 - bits]
                if sum(sizes[x] for x in group) <= limit or (len(group) == 1 and spans[c][0] == spans[c][1]):
                    wanted = bits, sum(sizes[x] for x in group)
                    break
            assert (d, b) == wanted


def test_deep_splits(spark):
    """Ids whose hashes share more than a round's bits."""
    rows = spark.createDataFrame([((7 << 40) + (i << 10), 10) for i in range(64)] + [(1 << 59, 5)], "hash long, n_bytes long")
    rounds = sharding.directory(rows, 25)
    assert [b for b, _ in rounds] == [12, 24, 36, 48, 60]
    shards = {(r.depth, r.cell >> (b - r.depth)): r.shard_bytes for b, f in rounds for r in f.collect()}
    assert sum(n for _, n in shards.items() if n == 20) == 32 * 20 and len(shards) == 33
    assert sharding.directory(rows.limit(0), 25)[0][1].count() == 0


# --- packing ------------------------------------------------------------------------------------------------------


def brute_cost(at, cost, size):
    best = {int(at[0]): 0.0}
    for j in range(1, len(at)):
        ways = []
        for i in range(j):
            n = int(at[j] - at[i])
            if n <= size:
                free = packing.LEAST_POWER <= n < size and n & (n - 1) == 0
                ways.append(best[int(at[i])] + (0 if free else size - n))
        best[int(at[j])] = min(ways) + cost[j] + packing.WINDOW
    return best[int(at[-1])]


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(25):
        at = np.concatenate([[0], np.cumsum(rng.choice([1, 7, 64, 100, 128, 256], 60))])
        cost = rng.choice([0.0, packing.SENTENCE, packing.INSIDE], len(at))
        cost[0] = 0
        cuts = packing.best_cuts(at, cost, 1024)
        by = dict(zip(at.tolist(), cost.tolist()))
        paid = 0.0
        for a, b in zip(cuts, cuts[1:]):
            n = b - a
            free = packing.LEAST_POWER <= n < 1024 and n & (n - 1) == 0
            assert n <= 1024
            paid += (0 if free else 1024 - n) + by[b] + packing.WINDOW
        assert paid == pytest.approx(brute_cost(at, cost, 1024))


def check_pieces(found, rows):
    pieces, windows = defaultdict(list), defaultdict(list)
    for doc_id, start, length, c, total, seq, offset, ids in found:
        assert len(ids) == length > 0 and c == crc(ids)
        pieces[doc_id].append((start, ids, total))
        windows[seq].append((offset, length))
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    wanted = defaultdict(Counter)
    for i, t in rows:
        wanted[i][tuple(whole(WORD, t))] += 1
    for i, texts in wanted.items():
        if sum(texts.values()) == 1:
            ids = [x for _, part, _ in sorted(pieces[i]) for x in part]
            assert tuple(ids) in texts and all(t == len(ids) for *_, t in pieces[i])
        assert Counter(x for _, part, _ in pieces[i] for x in part) == sum((Counter({x: n * k for x, n in Counter(t).items()}) for t, k in texts.items()), Counter())
    return [sum(n for _, n in own) for own in windows.values()]


def test_packing_odd_rows(spark, odd, none):
    check_pieces(listed(packing.pack(odd, tokens.default_path(WORD), with_ids=True)), [(i, t) for i, t, *_ in TEXTS])
    assert listed(packing.pack(none, tokens.default_path(WORD))) == []


@pytest.mark.parametrize("horizon", [1, 20])
def test_packing_documents(spark, docs, horizon):
    found = listed(packing.pack(docs, tokens.default_path(WORD), with_ids=True, horizon=horizon))
    sizes = check_pieces(found, listed(docs.select("doc_id", "text")))
    assert sum(packing.padding(n) for n in sizes) < 0.03 * sum(sizes)


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"text": ["a" * n for n in (10, 0, 900, 20, 1000, 3)]})
    parts = [b.column(0).to_pylist() for b in small_batches([batch], "text", 100)]
    assert sum(parts, []) == batch.column(0).to_pylist() and len(parts) > 3


def test_workers_let_go_of_what_others_keep():
    from tessera.llm.common import KEPT

    path = tokens.default_path(WORD)
    held = tokens.encoder(path)
    list(small_batches([], "text", keeps=path))
    assert tokens.encoder(path) is held
    list(small_batches([], "text"))
    assert path not in KEPT
