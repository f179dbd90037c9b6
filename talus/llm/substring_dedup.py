"""Exact substring dedup with a compressed FM-index per shard.

Words of a document that lie in a window of `window` words that also starts in a document
with a smaller id are removed. Streaming every document through every shard's index would
be quadratic, so shards are cut by content: each window names its smallest word k-gram (its
anchor), equal windows name the same one, and all windows with one anchor go to one shard.
What a document holds around an anchor that other documents hold too is a context of it.
An FM-index over wavelet trees is built on the contexts of a shard, and the contexts are
streamed through it: backward search gives their matching statistics, and each stretch that
matches `window` words or more reports its intervals, from which the smallest document of
every window follows.

What moves between tasks: anchors (packed by bucket), texts (compressed) to meet the shared
anchors, contexts (packed by bucket), the removed stretches, and texts again to lose them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import SharedTable, Words, count_rows, mix64, spread, text_chunks, window_hashes, within_documents, word_hashes, words_of
from talus.llm.fm_index import FMIndex

WINDOW, GRAM = 13, 4
#: Contexts in one index, about.
SHARD_CONTEXTS = 6_000
#: An anchor that more documents hold than this is dealt out by its single windows, if they are also more than one in MOST_HOT of all
#: places of shared anchors: so the list of hot anchors has at most MOST_HOT numbers at any size.
HOT_ANCHOR, MOST_HOT = 2_000, 1_000_000
#: Anchors, and contexts, that a task gathers before it hands them on.
HELD_ANCHORS, HELD_CONTEXTS = 1_000_000, 100_000
#: Bytes of text whose anchors, and whose contexts, go to one bucket on average, at most.
ANCHOR_BYTES, CONTEXT_BYTES = 4 << 20, 1 << 20
#: A context with more places in one task than this does not take them along to its shard.
WIDE = 16
SUBS = 256
#: Places whose windows are laid out at a time.
PLACE_BLOCK = 1 << 16


def anchors(data: np.ndarray, w: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window, number of windows) of each run of windows that name
    one anchor; windows are numbered by their first word in the document."""
    g = window_hashes(hashes, gram)
    starts = np.flatnonzero(within_documents(w, window))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    best, at = g[starts], starts.copy()
    for j in range(1, window - gram + 1):
        other = g[starts + j]
        less = other < best
        best = np.where(less, other, best)
        at[less] = starts[less] + j
    doc = spread(w.first)[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    runs = np.diff(np.concatenate((new, [len(starts)])))
    return (best[new] >> np.uint64(16)).astype(np.int64), doc[new], starts[new] - w.first[doc[new]], runs


# ------------------------------------------------------------------ packed columns
def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, their bytes by significance, compressed."""
    stacked = np.stack([c.astype(np.int64) for c in columns])
    planes = stacked.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.array(raw.reshape(columns, 8, -1).transpose(0, 2, 1), order="C").view(np.int64).reshape(columns, -1)


def _unpack_all(blobs: list[bytes], columns: int) -> np.ndarray:
    return np.concatenate([unpack(b, columns) for b in blobs], axis=1) if blobs else np.zeros((columns, 0), np.int64)


def _cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def _bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, part of the bucket) of each key."""
    mixed = mix64(keys.astype(np.uint64))
    return (mixed % np.uint64(buckets)).astype(np.int64), (mixed // np.uint64(buckets) % np.uint64(SUBS)).astype(np.int64)


def bucket_number(partitions: int, text_bytes: int, bucket_bytes: int) -> int:
    """Buckets for texts of so many bytes: their number follows the texts, so that a bucket,
    which one task holds, stays as large at any size; more of them where there are more tasks."""
    return max(1, partitions, -(-text_bytes // bucket_bytes))


# ------------------------------------------------------------------ shared anchors
def _anchor_blobs(window: int, gram: int, buckets: int):
    """(bucket, proven, blob): the anchors of each document, once. Anchors that several
    documents of a task hold are known to be shared: those places are proven and need not
    meet; one row stands for them, so that a hot anchor sends one row for each task."""

    def flush(a: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, a))
        a, ids = a[order], ids[order]
        once = np.concatenate(([True], (a[1:] != a[:-1]) | (ids[1:] != ids[:-1])))
        a, ids = a[once], ids[once]
        cut = _cuts(a)
        size = np.diff(cut)
        several = np.repeat(size > 1, size)
        rows: list[tuple] = []
        for lo in range(0, int(several.sum()), 1 << 16):
            part = a[several][lo : lo + (1 << 16)]
            own = ids[several][lo : lo + (1 << 16)]  # any bucket will do: not the one that every task's first shared anchor names
            rows.append((int(_bucket(own[:1] ^ part[:1], buckets)[0][0]), True, pack(np.diff(part, prepend=0), own)))
        stand, ids = a[cut[:-1]], ids[cut[:-1]]
        bucket = _bucket(stand, buckets)[0]
        order = np.argsort(bucket, kind="stable")
        stand, ids, size, bucket = stand[order], ids[order], size[order], bucket[order]
        edge = _cuts(bucket)
        for lo, hi in zip(edge, edge[1:]):
            rows.append((int(bucket[lo]), False, pack(np.diff(stand[lo:hi], prepend=0), ids[lo:hi], size[lo:hi])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "proven", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for c in text_chunks(batches, "text"):
            w = words_of(c.data, c.offsets)
            a, doc, _, _ = anchors(c.data, w, word_hashes(c.data, w), window, gram)
            if len(a):
                held.append((a, c.ids("doc").astype(np.int64)[doc]))
            if sum(len(x) for x, _ in held) >= HELD_ANCHORS:
                yield flush(*(np.concatenate(x) for x in zip(*held)))
                held = []
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _shared(hot_from: int):
    """One bucket: (doc, anchor) of every place of an anchor that two documents or more hold,
    and (no doc, anchor, places) for anchors of more than `hot_from` places."""

    def run(table: pa.Table) -> pa.Table:
        proven = table["proven"].to_numpy()
        blobs = table["blob"].to_pylist()
        docs, found, many = [], [], []
        rows = []
        for known, blob in zip(proven, blobs):
            x = unpack(blob, 2 if known else 3)
            x[0] = np.cumsum(x[0])
            if known:
                found.append(x[0])
                docs.append(x[1])
            else:
                rows.append(x)
        if rows:
            a, doc, n = np.concatenate(rows, axis=1)
            order = np.argsort(a, kind="stable")
            a, doc, n = a[order], doc[order], n[order]
            cut = _cuts(a)[:-1]
            total = np.add.reduceat(n, cut)
            several = (np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)) | (np.maximum.reduceat(n, cut) > 1)
            keep = np.repeat(several, np.diff(np.append(cut, len(a)))) & (n == 1)
            found.append(a[keep])
            docs.append(doc[keep])
            hot = total > hot_from
            many = [a[cut][hot], total[hot]]
        found, docs = np.concatenate(found), np.concatenate(docs)
        pairs = pa.table([pa.array(docs), pa.array(found), pa.nulls(len(docs), pa.int64())], ["doc", "anchor", "places"])
        if not len(many) or not len(many[0]):
            return pairs
        return pa.concat_tables([pairs, pa.table([pa.nulls(len(many[0]), pa.int64()), pa.array(many[0]), pa.array(many[1])], ["doc", "anchor", "places"])])

    return run


def _hot_anchors(shared: DataFrame) -> np.ndarray:
    """Sorted; at most MOST_HOT, as each holds more than that part of all places."""
    least = max(HOT_ANCHOR, count_rows(shared.where("doc is not null")) // MOST_HOT)
    return np.sort(shared.where((F.col("doc").isNull()) & (F.col("places") > least)).select("anchor").toArrow()["anchor"].to_numpy())


# ------------------------------------------------------------------ texts
def _packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for c in text_chunks(batches, "text"):
            ids = c.batch.column(c.batch.schema.get_field_index("doc"))
            raw, offs = c.data.tobytes(), c.offsets.tolist()
            yield pa.RecordBatch.from_arrays([ids, pa.array([coder.compress(raw[a:b]) for a, b in zip(offs, offs[1:])], pa.binary())], ["doc", "packed"])

    return docs.select("doc", "text").mapInArrow(run, "doc bigint, packed binary")


def _text_groups(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Texts of a batch in groups of about `limit` bytes, unpacked one group at a time."""
    coder = zstandard.ZstdDecompressor()
    at, part, total = 0, [], 0
    for i, packed in enumerate(column):
        part.append(coder.decompress(packed.as_py()))
        total += len(part[-1])
        if total >= limit:
            yield at, i + 1, part
            at, part, total = i + 1, [], 0
    if part:
        yield at, len(column), part


def _mark(text: bytes) -> int:
    """A number that tells texts of one id apart."""
    return zlib.crc32(text) - (1 << 31)


# ------------------------------------------------------------------ contexts
CONTEXTS = "bucket bigint, rid binary, words binary, counts binary, places binary, wide binary"


def _spaced(data: np.ndarray, w: Words) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each starts (and the end, after a space)."""
    size = w.ends - w.starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inside + np.repeat(at[:-1], size)] = data[inside + np.repeat(w.starts, size)]
    return out.tobytes(), at


def _contexts(window: int, gram: int, buckets: int, hot, most: int):
    """Contexts by bucket, each once for a task with its places: (document, mark of its text,
    first window). A context with many places keeps only an id and its smallest and largest
    document; its places go by that id in rows of their own."""

    def flush(seen: dict[bytes, int], held: list[np.ndarray]) -> pa.RecordBatch:
        words = list(seen)
        j, key, doc, mark, first = np.concatenate(held, axis=1)
        n = np.bincount(j, minlength=len(words))
        keys = np.zeros(len(words), np.int64)
        keys[j] = key
        bucket, sub = _bucket(keys, buckets)
        order = np.lexsort((sub, bucket))
        at = np.empty(len(words), np.int64)
        at[order] = np.arange(len(words))
        by = np.argsort(at[j], kind="stable")
        doc, mark, first = doc[by], mark[by], first[by]
        bucket, sub, n, words = bucket[order], sub[order], n[order], [words[i] for i in order.tolist()]
        cut = np.concatenate(([0], np.cumsum(n)))
        wide = n > most
        low, high = np.where(wide, np.minimum.reduceat(doc, cut[:-1]), 0), np.where(wide, np.maximum.reduceat(doc, cut[:-1]), 0)
        narrow_place = np.repeat(~wide, n)
        rows: list[tuple] = []
        rids: dict[int, bytes] = {}
        for i in np.flatnonzero(wide).tolist():
            places = pack(doc[cut[i] : cut[i + 1]], mark[cut[i] : cut[i + 1]], first[cut[i] : cut[i + 1]])
            rids[i] = hashlib.blake2b(words[i] + b"\n" + places, digest_size=16).digest()
            rows.append((int.from_bytes(rids[i][:8], "little") % buckets, rids[i], None, None, places, None))  # not the context's own bucket, which may be hot
        edge = _cuts(bucket)
        coder = zstandard.ZstdCompressor(level=3)
        for lo, hi in zip(edge.tolist(), edge[1:].tolist()):
            inside = slice(cut[lo], cut[hi])
            mine = narrow_place[inside]
            counts = pack(sub[lo:hi], np.where(wide[lo:hi], 0, n[lo:hi]), low[lo:hi], high[lo:hi])
            places = pack(doc[inside][mine], mark[inside][mine], first[inside][mine])
            rows.append((int(bucket[lo]), None, coder.compress(b"\n".join(words[lo:hi])), counts, places, b"".join(rids[i] for i in (lo + np.flatnonzero(wide[lo:hi])).tolist())))
        kinds = (pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "rid", "words", "counts", "places", "wide"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, part in _text_groups(batch.column(1)):
                data = np.frombuffer(b"".join(part), np.uint8)
                w = words_of(data, np.concatenate(([0], np.cumsum([len(x) for x in part]))))
                h = word_hashes(data, w)
                anchor, doc, first, runs = anchors(data, w, h, window, gram)
                tagged = lambda d, a: a.astype(np.uint64) ^ mix64(d.astype(np.uint64))
                own = np.repeat(np.arange(hi - lo), [len(lists[i]) for i in range(lo, hi)])
                shared = np.isin(tagged(doc, anchor), tagged(own, lists.slice(lo, hi - lo).flatten().to_numpy()))
                anchor, doc, first, runs = (x[shared] for x in (anchor, doc, first, runs))
                if not len(doc):
                    continue
                split = np.isin(anchor, hot.value)
                times = np.where(split, runs, 1)
                inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                anchor, doc, first, runs, split = (np.repeat(x, times) for x in (anchor, doc, first, np.where(split, 1, runs), split))
                first = first + inside
                begin = w.first[doc] + first
                key = np.where(split, window_hashes(h, window)[begin].view(np.int64), anchor)
                marks = np.array([_mark(x) for x in part])
                raw, at = _spaced(data, w)
                j = [seen.setdefault(raw[a:b], len(seen)) for a, b in zip(at[begin].tolist(), (at[begin + runs + window - 1] - 1).tolist())]
                held.append(np.stack((np.array(j, np.int64), key, ids[lo:hi][doc], marks[doc], first)))
                if len(seen) >= HELD_CONTEXTS or sum(x.shape[1] for x in held) >= 8 * HELD_CONTEXTS:
                    yield flush(seen, held)
                    seen, held = {}, []
        if held:
            yield flush(seen, held)

    return run


# ------------------------------------------------------------------ shards
MATCHES = "doc bigint, mark int, start int, windows int, rid binary, firsts array<bigint>, places binary"
_MATCH_KINDS = (("doc", pa.int64()), ("mark", pa.int32()), ("start", pa.int32()), ("windows", pa.int32()), ("rid", pa.binary()), ("firsts", pa.list_(pa.int64())), ("places", pa.binary()))


def _matches(n: int, **columns) -> pa.Table:
    return pa.table([pa.nulls(n, k) if columns.get(c) is None else pa.array(columns[c], k) for c, k in _MATCH_KINDS], [c for c, _ in _MATCH_KINDS])


def first_documents(contexts: list[bytes], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, cut): for the windows of context i, in order, firsts[cut[i] : cut[i + 1]] is
    the smallest document in which the window starts; `least` is that of whole contexts."""
    lists = [x.split(b" ") for x in contexts]
    size = np.array([len(x) for x in lists])
    symbols = pd.factorize(np.array([x for words in lists for x in words], dtype=object))[0] + 1
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(begin[-1], np.int64)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(size)), size)] = symbols
    windows = size - window + 1
    cut = np.concatenate(([0], np.cumsum(windows)))
    ends = np.arange(cut[-1]) - np.repeat(cut[:-1], windows) + np.repeat(begin[:-1], windows) + window - 1
    index = FMIndex(text)
    length, low, high = index.matching_statistics(text, ends, ends - np.repeat(begin[:-1], windows) + 1, window)
    firsts = np.repeat(least, windows)
    match = np.flatnonzero(length >= window)
    if len(match):
        lows, one, at = np.unique(low[match], return_index=True, return_inverse=True)
        wide = high[match][one] - lows
        edge = np.cumsum(wide) - wide
        rows = np.arange(int(wide.sum())) - np.repeat(edge, wide) + np.repeat(lows, wide)
        owner = np.searchsorted(begin, index.locate(rows), side="right") - 1
        firsts[match] = np.minimum.reduceat(least[owner], edge)[at]
    return firsts, cut


def _covered(firsts: np.ndarray, cut: np.ndarray, which: np.ndarray, doc: np.ndarray, mark: np.ndarray, first: np.ndarray) -> pa.Table:
    """Removed stretches of places of the contexts `which`: runs of windows whose first
    document is smaller than the place's. Places of copies are many, and each is as long as
    its windows, so they are laid out a block at a time."""
    blocks = (slice(lo, lo + PLACE_BLOCK) for lo in range(0, len(which), PLACE_BLOCK))
    return pa.concat_tables([_matches(0), *(_covered_block(firsts, cut, which[b], doc[b], mark[b], first[b]) for b in blocks)])


def _covered_block(firsts: np.ndarray, cut: np.ndarray, which: np.ndarray, doc: np.ndarray, mark: np.ndarray, first: np.ndarray) -> pa.Table:
    n = (cut[1:] - cut[:-1])[which]
    edge = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(edge, n)
    gone = firsts[inside + np.repeat(cut[which], n)] < np.repeat(doc, n)
    before = np.concatenate(([False], gone[:-1])) & (inside > 0)
    start = np.flatnonzero(gone & ~before)
    after = np.concatenate((gone[1:], [False])) & (np.concatenate((inside[1:], [0])) > 0)
    end = np.flatnonzero(gone & ~after)
    place = np.repeat(np.arange(len(which)), n)[start]
    return _matches(len(start), doc=doc[place], mark=mark[place], start=first[place] + inside[start], windows=end - start + 1)


def _search(window: int, shard: int):
    """One bucket of contexts: its indexes, the stretches removed at places that came along,
    and the first documents of contexts whose places did not."""

    def solve(words: list[bytes], n: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray, rids: list[bytes]) -> Iterator[pa.Table]:
        ids: dict[bytes, int] = {}
        own = np.array([ids.setdefault(x, len(ids)) for x in words])
        doc, mark, first = places
        at = np.repeat(own, n)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, at, doc)
        wide = n == 0
        np.minimum.at(least, own[wide], low[wide])
        firsts, cut = first_documents(list(ids), least, window)
        yield _covered(firsts, cut, at, doc, mark, first)
        lists = [firsts[cut[i] : cut[i + 1]] for i in own[wide].tolist()]
        some = [i for i, x in enumerate(lists) if x.min() < high[wide][i]]
        yield _matches(len(some), rid=[rids[i] for i in some], firsts=[lists[i] for i in some])

    def run(table: pa.Table) -> pa.Table:
        alone = table.filter(pc.is_valid(table["rid"]))
        out = [_matches(len(alone), rid=alone["rid"].combine_chunks(), places=alone["places"].combine_chunks())]
        table = table.filter(pc.is_null(table["rid"]))
        coder = zstandard.ZstdDecompressor()
        words = [x for blob in table["words"].to_pylist() for x in coder.decompress(blob).split(b"\n")]
        if not words:
            return out[0]
        sub, n, low, high = _unpack_all(table["counts"].to_pylist(), 4)
        places = _unpack_all(table["places"].to_pylist(), 3)
        joined = b"".join(table["wide"].to_pylist())
        order = np.argsort(sub, kind="stable")
        place_order = np.argsort(np.repeat(sub, n), kind="stable")
        rid_order = np.argsort(sub[n == 0], kind="stable")
        rids = [joined[16 * i : 16 * i + 16] for i in rid_order.tolist()]
        sub, n, low, high, places, words = sub[order], n[order], low[order], high[order], places[:, place_order], [words[i] for i in order.tolist()]
        edge, start = _cuts(sub), 0
        place_cut, wide_cut = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n == 0)))
        for end in edge[1:].tolist():
            if end - start >= shard or end == len(words):
                part = slice(start, end)
                out += solve(words[part], n[part], low[part], high[part], places[:, place_cut[start] : place_cut[end]], rids[wide_cut[start] : wide_cut[end]])
                start = end
        return pa.concat_tables(out)

    return run


def _wide_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed stretches of the places that met the first documents of their context."""
    for batch in batches:
        for firsts, blob in zip(batch.column(0), batch.column(1)):
            firsts = firsts.values.to_numpy()
            doc, mark, first = unpack(blob.as_py(), 3)
            found = _covered(firsts, np.array([0, len(firsts)]), np.zeros(len(doc), np.int64), doc, mark, first)
            yield from found.select(["doc", "mark", "start", "windows"]).to_batches()


# ------------------------------------------------------------------ what is left
RUNS = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))


def _keep(window: int):
    """(doc, n_words, n_removed, removed_runs, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for lo, hi, part in _text_groups(batch.column(1)):
                data = np.frombuffer(b"".join(part), np.uint8)
                w = words_of(data, np.concatenate(([0], np.cumsum([len(x) for x in part]))))
                gone = np.zeros(len(w.starts) + 1, np.int64)
                for i in range(hi - lo):
                    if not spans[lo + i].is_valid:
                        continue
                    mark, start, windows = (spans[lo + i].values.field(k).to_numpy() for k in range(3))
                    mine = mark == _mark(part[i])
                    np.add.at(gone, w.first[i] + start[mine], 1)
                    np.add.at(gone, w.first[i] + start[mine] + windows[mine] + window - 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                keep = ~gone
                left = Words(w.starts[keep], w.ends[keep], np.concatenate(([0], np.cumsum(keep)))[w.first])
                raw, at = _spaced(data, left)
                kept = [raw[a : max(a, b - 1)] for a, b in zip(at[left.first[:-1]].tolist(), at[left.first[1:]].tolist())]
                doc = spread(w.first)
                edge = np.flatnonzero(gone & np.concatenate(([True], keep[:-1] | (doc[1:] != doc[:-1])))) if len(gone) else np.zeros(0, np.int64)
                stop = np.flatnonzero(gone & np.concatenate((keep[1:] | (doc[1:] != doc[:-1]), [True]))) + 1 if len(gone) else edge
                runs = pa.StructArray.from_arrays([pa.array((edge - w.first[doc[edge]]).astype(np.int32)), pa.array((stop - edge).astype(np.int32))], ["first", "words"])
                offsets = np.searchsorted(edge, w.first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(w.counts()), pa.array(w.counts() - left.counts()),
                        pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    ["doc", "n_words", "n_removed", "removed_runs", "kept_text"],
                )

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, n_words, n_removed, removed_runs, kept_text), a row per row of `docs`.

    Windows are judged on the input. Null and empty texts have no words; texts shorter than
    a window lose none. Rows that repeat an id are one document, each with its own text
    (texts of one id are told apart by CRC-32, and what they share with others meets in one
    row of that id); rows without an id keep all words and take none from others. An empty
    table gives no rows. Other columns are not read.
    """
    if not 1 <= gram <= window < gram + 15:
        raise ValueError("window must be gram to gram + 14 words")
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_number(2 * partitions, size, ANCHOR_BYTES)
    blobs = named.where("doc is not null").mapInArrow(_anchor_blobs(window, gram, buckets), "bucket bigint, proven boolean, blob binary")
    met = blobs.groupBy("bucket").applyInArrow(_shared(HOT_ANCHOR), "doc bigint, anchor bigint, places bigint")
    shared = SharedTable(met, "shared-anchors")
    hot = spark.sparkContext.broadcast(_hot_anchors(shared.df))
    by_doc = shared.df.where("doc is not null").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))
    texts = _packed(named)
    # In one order, so that a task that runs again gathers the same contexts.
    placed = texts.join(by_doc, "doc").select("doc", "packed", F.sort_array("anchors").alias("anchors")).sortWithinPartitions("doc", "packed")
    buckets = bucket_number(4 * partitions, size, CONTEXT_BYTES)
    contexts = placed.mapInArrow(_contexts(window, gram, buckets, hot, WIDE), CONTEXTS)
    matches = SharedTable(contexts.groupBy("bucket").applyInArrow(_search(window, SHARD_CONTEXTS), MATCHES), "matches")
    shared.drop()
    found = matches.df
    wide = found.where("firsts is not null").select("rid", "firsts").join(found.where("places is not null").select("rid", "places"), "rid")
    stretch = wide.select("firsts", "places").mapInArrow(_wide_places, "doc bigint, mark int, start int, windows int")
    stretches = found.where("doc is not null").select("doc", "mark", "start", "windows").unionByName(stretch)
    spans = stretches.groupBy("doc").agg(F.collect_list(F.struct("mark", "start", "windows")).alias("spans"))
    joined = texts.join(spans, "doc", "left").select("doc", "packed", "spans")
    return joined.mapInArrow(_keep(window), "doc bigint, n_words bigint, n_removed bigint, removed_runs array<struct<first:int,words:int>>, kept_text string")
