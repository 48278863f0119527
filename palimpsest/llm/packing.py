"""Filling fixed-capacity containers with documents, by bounded-space online packing.

Each task keeps at most ``OPEN`` containers open. A document goes into the open container
that it fills best; if none has room and all places are taken, the fullest is emitted. What
is still open at the end is merged in rounds over ever fewer tasks. A document longer than
a container is cut into full containers and one remainder, which is packed as an item.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import cut

CAPACITY, OPEN, FAN_IN = 2_048, 256, 16
TOKENIZERS = "/opt/tokenizers"


@lru_cache(maxsize=2)
def _encoding(folder: str):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class OpenBins:
    """At most ``limit`` open containers, found by their free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []  # (free space, container)
        self.items: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, item) -> list[tuple[int, list]]:
        """Place one item; gives the containers that had to leave, as (used, items)."""
        gone = []
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, c = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                space, c = self.free.pop(0)
                gone.append((self.capacity - space, self.items.pop(c)))
            space, c = self.capacity, self.next
            self.next += 1
            self.items[c] = []
        self.items[c].append(item)
        if space == size:
            gone.append((self.capacity, self.items.pop(c)))
        else:
            insort(self.free, (space - size, c))
        return gone

    def rest(self) -> list[tuple[int, list]]:
        return [(self.capacity - space, self.items[c]) for space, c in self.free]


_PACKED = "container string, doc_id bigint, part_no int, first_token int, tokens int, used int, open boolean"


def _packer(capacity: int, limit: int, folder: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(folder).encode_ordinary
        pid, count = TaskContext.get().partitionId(), 0
        bins = OpenBins(capacity, limit)

        def rows(done: list, is_open: bool) -> pa.RecordBatch:
            nonlocal count
            out = []
            for used, items in done:
                name, count = f"{pid}-{count}", count + 1
                out += [(name, *x, used, is_open) for x in items]
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["container", "doc_id", "part_no", "first_token", "tokens", "used", "open"])

        for b in batches:
            done: list = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(encode(text)) if text else 0
                part = 0
                while n - part * capacity > capacity:
                    done.append((capacity, [(doc, part, part * capacity, capacity)]))
                    part += 1
                if left := n - part * capacity:
                    done += bins.put(left, (doc, part, part * capacity, left))
            yield rows(done, False)
        yield rows(bins.rest(), True)

    return pack


def _merger(capacity: int, limit: int, tag: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        every = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        bins, done = OpenBins(capacity, limit), []
        for name, used in sorted(every, key=lambda x: (-x[1], x[0])):
            done += [(u, i, False) for u, i in bins.put(used, name)]
        done += [(u, i, True) for u, i in bins.rest()]
        out = [(name, f"{tag}-{pid}-{k}", u, o) for k, (u, names, o) in enumerate(done) for name in names]
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.bool_()])], ["container", "merged", "used", "open"])

    return merge


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, limit: int = OPEN, folder: str = TOKENIZERS) -> DataFrame:
    """(container, doc_id, part_no, first_token, tokens, used): which tokens of which document stand in which container.

    ``documents`` has (doc_id, text); other columns are ignored, repeated rows are items of their
    own. Every token of every document is in exactly one container; null and empty texts have no
    token and no row. Only a document longer than ``capacity`` has several parts.
    """
    packed = cut(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_packer(capacity, limit, folder), _PACKED))
    closed = packed.where("not open").drop("open")
    state = packed.where("open")
    tasks, round_ = state.rdd.getNumPartitions(), 0
    while True:
        tasks, round_ = max(1, -(-tasks // FAN_IN)), round_ + 1
        # one row for each open container: at most ``limit`` of each task of the round before
        bins = state.groupBy("container").agg(F.max("used").alias("used"))
        # in rounds before the last, containers stay open only while the limit lasts; the last takes all at once
        bins = bins.coalesce(1) if tasks == 1 else bins.repartition(tasks, "container")
        moved = bins.mapInArrow(_merger(capacity, limit if tasks > 1 else 1 << 30, f"m{round_}"), "container string, merged string, used int, open boolean")
        state = cut(state.drop("used", "open").join(moved, "container").drop("container").withColumnRenamed("merged", "container"))
        columns = ["container", "doc_id", "part_no", "first_token", "tokens", "used"]
        if tasks == 1:
            return closed.select(columns).unionByName(state.select(columns))
        closed = closed.select(columns).unionByName(state.where("not open").select(columns))
        state = state.where("open")
