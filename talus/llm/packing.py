"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document becomes token ids and a closing id 0. Longer ones are cut into full pieces,
of which only the first may be shorter. Pieces are dealt to shards of bounded size by a
hash; each shard packs by bin completion: around the largest piece, undominated fillings
are enumerated in a branch-and-bound search whose incumbent is the best-fit solution and
whose branches are cut by the waste that a better solution may still have. The emptiest
sequences of many shards are then opened and packed again together, so that sharding costs
about one sequence for each group of shards.

Documents may have an order, such as that of a mix. Then shards are stretches of it instead,
and sequences stand in the order of their longest pieces, so that they follow it.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import SharedTable, count_rows, free_name, text_chunks
from talus.operators.ranking import global_rank

SEQUENCE = 2048
#: Pieces in a shard, on average; the largest shard of a hash is a few per cent larger.
SHARD_PIECES = 4096
#: Shards whose emptiest sequences are packed again together, and how many each gives.
POOL_SHARDS, POOL_SEQUENCES = 256, 8
#: Search effort of a shard after best fit: nodes, and fillings that are tried at a node.
NODES, FILLINGS = 2_000, 12
#: Sequences that one search packs anew, the emptiest ones first.
SEARCHED = 24
#: Words whose ids a worker remembers at a time.
CACHED_WORDS = 600_000
END_OF_TEXT = "<|endoftext|>"

_UNITS: dict[str, _Units] = {}


class _Units:
    """Token ids of texts, unit by unit: a single space before a visible character always
    starts a new pre-token of a byte-level BPE, so that what lies between such spaces can be
    encoded once and remembered. Texts with a space before white space, or with the special
    token, are encoded as a whole."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {} if END_OF_TEXT.encode() in ranks else {END_OF_TEXT: len(ranks)}
        self.coder = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        size = np.zeros(len(ranks) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        self.size, self.known = size, {}
        self.whole = re.compile(r" \s")

    def _plain(self, text: str) -> bytes:
        ids = self.coder.encode(text, allowed_special={END_OF_TEXT})
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """All new units in one call; each starts with the only space it has, so that the
        bytes of the tokens tell where it ends."""
        joined = " " + " ".join(new)
        ids = self.coder.encode_to_numpy(joined, disallowed_special=()).astype("<u4")
        raw = joined.encode()
        units = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)[1:], len(raw))
        stops = 4 * (np.searchsorted(np.cumsum(self.size[ids]), units) + 1)
        tokens, stops = ids.tobytes(), stops.tolist()
        self.known.update(zip(new, [tokens[a:b] for a, b in zip([0, *stops], stops)]))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split: list[list[str] | None] = [None if self.whole.search(t) or END_OF_TEXT in t else t.split(" ") for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        used: set[str] = set()
        for words in split:
            if words:
                used.update(words[1:])
        new = used.difference(self.known)
        if "" in new:  # a space at the end of a text
            new.discard("")
            self.known[""] = self._plain(" ")
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        for text, words in zip(texts, split):
            if words is None:
                yield self._plain(text)
            else:
                yield self._plain(words[0]) + b"".join(map(get, words[1:]))


def _units() -> _Units:
    import public_tokenizers

    if "units" not in _UNITS:
        _UNITS["units"] = _Units(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _UNITS["units"]


def token_pieces(docs: DataFrame, length: int = SEQUENCE, text: str = "text", id_col: str = "doc_id", order: Column | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every whole document; with
    `order`, its value for the document follows as `place`.

    A null text is an empty one: the closing id alone. Repeated rows are packed each.
    """
    kind = dict(docs.dtypes)[id_col]
    name = free_name([id_col.lower(), text.lower()], "place")
    rows = docs.select(id_col, text, *([] if order is None else [order.alias(name)]))
    also = [f"place {k}" for c, k in rows.dtypes if c == name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in text_chunks(batches, text):
            ids = c.batch.column(c.batch.schema.get_field_index(id_col))
            raw, offs = c.data.tobytes(), c.offsets.tolist()
            texts = [raw[a:b].decode() for a, b in zip(offs, offs[1:])]
            row, piece, start, size, crc = [], [], [], [], []
            for i, tokens in enumerate(_units().encode(texts)):
                tokens += b"\0\0\0\0"
                n = len(tokens) // 4
                at, k = 0, 0
                step = (n - 1) % length + 1  # the first piece takes the rest
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(step)
                    crc.append(zlib.crc32(tokens[4 * at : 4 * (at + step)]))
                    at, k, step = at + step, k + 1, length
            of = pa.array(row, pa.int64())
            places = [c.batch.column(2).take(of)] if also else []
            yield pa.RecordBatch.from_arrays(
                [ids.take(of), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)], *places],
                ["id", "piece", "start", "length", "ids_crc32", *["place" for _ in places]],
            )

    return rows.mapInArrow(run, ", ".join([f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", *also]))


# ------------------------------------------------------------------ one shard
def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: pieces over half a bin stand alone, and what cannot go
    beside the largest of them needs bins of its own (the bound of Martello and Toth)."""
    s = np.sort(sizes)[::-1]
    best = -(-int(s.sum()) // capacity)
    sums = np.concatenate(([0], np.cumsum(s)))
    up = lambda x: int(np.searchsorted(-s, -x, side="left"))  # noqa: E731  pieces larger than x
    half = up(capacity // 2)
    for k in np.unique(s[s <= capacity // 2]).tolist() if len(s) else []:
        alone, least = up(capacity - k), int(np.searchsorted(-s, -k, side="right"))
        free = (half - alone) * capacity - int(sums[half] - sums[alone])
        best = max(best, half + max(0, -(-(int(sums[least] - sums[half]) - free) // capacity)))
    return max(best, half)


def best_fit(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first: each piece goes where it leaves the least room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            free, b = capacity - sizes[i], len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            free -= sizes[i]
        if free:
            insort(room, (free, b))
    return bins


def _fillings(gap: int, values: list[int], left: dict[int, int]) -> list[tuple[int, ...]]:
    """Undominated ways to fill `gap`, least waste first. A filling is dominated if a piece
    that is left over fits beside it, or could take the place of one or two of its pieces."""
    found: dict[tuple[int, ...], int] = {}
    steps = 0

    def undominated(chosen: list[int], slack: int) -> bool:
        rest = [v for v in values if left[v] > chosen.count(v)]
        for v in rest:
            if v <= slack or any(x < v <= x + slack for x in chosen):
                return False
            if any(x + y <= v <= x + y + slack for a, x in enumerate(chosen) for y in chosen[:a]):
                return False
        return True

    def grow(at: int, room: int, chosen: list[int]) -> bool:
        nonlocal steps
        steps += 1
        if room == 0 or at == len(values) or steps > 400:
            key = tuple(chosen)
            if key not in found and undominated(chosen, room):
                found[key] = room
            return room == 0 or len(found) >= FILLINGS or steps > 400
        at = next((k for k in range(at, len(values)) if values[k] <= room), len(values))
        if at == len(values):
            return grow(at, room, chosen)
        v = values[at]
        for n in range(min(left[v], room // v), -1, -1):
            if grow(at + 1, room - n * v, chosen + [v] * n):
                return True
        return False

    grow(0, gap, [])
    return sorted(found, key=found.get)


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Indices of `sizes` by bin. Best fit is the incumbent; while it misses the lower bound,
    depth-first bin completion looks for one bin less: among the SEARCHED emptiest bins, then
    among the next emptiest, and from the start after each success, until `nodes` are spent."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins = best_fit(order, sizes, capacity)
    bound, at = lower_bound(np.array(sizes, np.int64), capacity), 0
    while len(bins) > bound and at < len(bins) and nodes > 0:
        bins.sort(key=lambda b: sum(sizes[i] for i in b))
        part = [i for b in bins[at : at + SEARCHED] for i in b]
        found, nodes = _complete([sizes[i] for i in part], capacity, len(bins[at : at + SEARCHED]) - 1, nodes)
        if found is None:
            at += SEARCHED
        else:
            bins, at = bins[:at] + [[part[i] for i in b] for b in found] + bins[at + SEARCHED :], 0
    return bins


def _complete(sizes: list[int], capacity: int, goal: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """(indices by bin of a packing into `goal` bins, if the search finds one; nodes left)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left: dict[int, int] = {}
    for s in sizes:
        left[s] = left.get(s, 0) + 1
    total, best = sum(sizes), None
    # An explicit stack: bins so far and, at each of them, the fillings not tried yet.
    stack: list[tuple[list[tuple[int, ...]], tuple[int, ...] | None, int]] = []
    waste, rest = 0, len(sizes)

    def options() -> list[tuple[int, ...]]:
        values = sorted((v for v, n in left.items() if n), reverse=True)
        big = values[0]
        left[big] -= 1
        out = [(big, *f) for f in _fillings(capacity - big, values, left)]
        left[big] += 1
        return out

    def take(filling: tuple[int, ...], sign: int) -> None:
        nonlocal waste, rest
        for v in filling:
            left[v] -= sign
        waste += sign * (capacity - sum(filling))
        rest -= sign * len(filling)

    if total > goal * capacity:
        return None, nodes
    stack.append((options(), None, 0))
    while stack and nodes:
        nodes -= 1
        choices, taken, _ = stack.pop()
        if taken:
            take(taken, -1)
        while choices:
            filling = choices.pop(0)
            take(filling, 1)
            if waste <= goal * capacity - total:
                break
            take(filling, -1)
        else:
            continue
        stack.append((choices, filling, 0))
        if not rest:
            best = [t for _, t, _ in stack if t]
            break
        stack.append((options(), None, 0))
    if best is None:
        return None, nodes
    by_size: dict[int, list[int]] = {}
    for i in order:
        by_size.setdefault(sizes[i], []).append(i)
    return [[by_size[v].pop() for v in filling] for filling in best], nodes


# ------------------------------------------------------------------ all shards
def _packer(capacity: int, pool: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        ties = ["place"] if "place" in group else ["id", "piece", "ids_crc32"]
        group = group.sort_values(["length", *ties], ascending=[False, *[True for _ in ties]], kind="stable").reset_index(drop=True)
        place = group["place"].tolist() if "place" in group else None
        sizes = group["length"].tolist()
        bins = bin_completion(sizes, capacity)
        free = [capacity - sum(sizes[i] for i in b) for b in bins]
        worst = set(sorted(range(len(bins)), key=lambda b: -free[b])[:pool]) if pool else set()
        seq, off, is_open = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for b, members in enumerate(bins):
            at, number = 0, b
            if place:
                number, members = place[min(members)], sorted(members, key=place.__getitem__)  # rows are sorted: the first one is the longest
            for i in members:
                seq[i], off[i], is_open[i] = number, at, b in worst and free[b] * 20 > capacity
                at += sizes[i]
        group["sequence_id"] = seq if place else seq + (group["shard"].to_numpy(np.int64) << 24)
        group["offset"], group["open"] = off, is_open
        return group

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """`pieces` (id, piece, start, length, ids_crc32) with sequence_id and offset.

    Places in a sequence are gapless from 0. Shards have a bounded number of pieces at any
    size of the corpus, because both numbers of shards follow the number of pieces, and
    repeated rows are dealt out like others.

    If `pieces` has a column `place`, shards are stretches of its order (pieces of a document
    by `piece`), and sequence_id is the number of the sequence's longest piece in it, the first
    of equal ones: in the order of sequence_id, what fills the sequences comes as in that
    order. The few sequences that are packed again take from up to POOL_SHARDS stretches.
    """
    n = count_rows(pieces)
    shards = max(1, -(-n // SHARD_PIECES))
    if "place" in pieces.columns:
        order = [F.asc("place"), F.asc("piece")]
        numbered = global_rank(pieces, order, buckets=min(4096, 1 + n // (4 * SHARD_PIECES)), name="number")
        dealt = numbered.select(*[c for c in pieces.columns if c != "place"], (F.col("number") - 1).cast("long").alias("place"))
        dealt = dealt.withColumn("shard", F.floor(F.col("place") / SHARD_PIECES).cast("long"))
    else:
        row = F.monotonically_increasing_id()  # `pieces` is a written table: a task that runs again numbers its rows alike
        dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", row), F.lit(shards)).cast("long"))
    kind = ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", sequence_id bigint, offset bigint, open boolean"
    first = SharedTable(dealt.groupBy("shard").applyInPandas(_packer(capacity, POOL_SEQUENCES), kind), "packed").df
    columns = [*[c for c in pieces.columns if c != "place"], "sequence_id", "offset"]
    again = first.where("open").drop("sequence_id", "offset", "open")
    again = again.withColumn("shard", -1 - F.floor(F.col("shard") / POOL_SHARDS).cast("long"))
    again = again.groupBy("shard").applyInPandas(_packer(capacity, 0), kind)
    return first.where("not open").select(columns).unionByName(again.select(columns))


def pack_documents(docs: DataFrame, length: int = SEQUENCE, text: str = "text", id_col: str = "doc_id", order: Column | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every
    document, in `order` where one is given. An empty table gives no rows; null ids are packed
    like others."""
    return pack_pieces(SharedTable(token_pieces(docs, length, text, id_col, order), "pieces").df, length)
