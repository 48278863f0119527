"""Deduplicating message batches against everything accepted before.

A message is a case if it matches an accepted one; it is accepted otherwise, in order of id.
Two messages match if both have MIN_WORDS distinct words, share JACCARD of all of them, and
hold the same runs of digits equally often.

* Full copies (same word set and digits) are found by one 128-bit hash; a class of copies
  stands or falls together, so only its first message of a batch goes on.
* Near copies share a signature: word sets are ordered rarest word first; two sets of
  similarity 0.8 share a word of their prefixes (n - ceil(0.8 n) + 1 words). A rare one is a
  signature by itself, common ones in pairs (see ``signatures``). A signature plays the part
  of a paragraph hash for messages of one paragraph; coverage is then checked exactly. Full
  copies share all signatures, and have at least one.
* History (``DedupIndex``) is two bucketed tables of accepted messages: signatures, bucketed by
  key, and word sets, bucketed by id. Only the batch is shuffled, into their buckets; bucket by
  bucket its rows meet those of equal key, and what is accepted is appended.

Inside a batch no signature's group is ever paired with itself as a whole: first the smallest
open message of each signature decides for the others (linear work, so a group of near copies of
any size collapses onto its first), only what no leader decides is compared among itself.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.words import words
from palimpsest.runtime import delete, folder_bytes, publish_text, read_text, shuffle_partitions, store

MIN_WORDS = 8
#: Words with at least 1/COMMON_WORDS of all word occurrences count as common, so there are at most COMMON_WORDS of them.
COMMON_WORDS = 262_144
LEADER_ROUNDS = 2
#: The common words are counted anew, and all signatures formed anew, when the history is REFIT times as large as when counted last or has MOST_PARTS parts.
REFIT, MOST_PARTS = 16, 256
#: A key matters if it joins two messages (role 2), or one with fewer rare words and one with more.
_JOINS = "first < last and (least = 2 or least < most)"
PARSED = "id bigint, h binary, digits bigint, words array<int>"
KEYS = "id bigint, key bigint, role tinyint"
#: Texts of so many characters are parsed at once, and about so many keys formed at once.
AT_ONCE = 1 << 24
KEYS_AT_ONCE = 1 << 20
#: What remains of the bytes of a text: its words, if it is ASCII, and its digits.
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_DIGIT_BYTES = bytes(c if 48 <= c < 58 else 32 for c in range(256))


def _pieces(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Runs of rows with AT_ONCE characters, or one longer row."""
    own, size = [], 0
    for r in rows:
        if own and size + len(r[1]) > AT_ONCE:
            yield own
            own, size = [], 0
        own.append(r)
        size += len(r[1])
    yield own


def _parsed(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    """(id, class hash, digits hash, sorted word hashes) of the texts with enough words."""
    raw = [t.encode() for _, t in rows]
    # `words` of ASCII is a matter of bytes; other texts go through it
    plain = pa.array([r.translate(_WORD_BYTES) if r.isascii() else " ".join(words(t)).encode() for r, (_, t) in zip(raw, rows)], pa.string())
    split = pc.ascii_split_whitespace(plain)
    coded = split.values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    narrow = np.fromiter((xxhash.xxh32_intdigest(w) for w in names), np.int64, len(names))
    wide = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    real = np.fromiter((w != "" for w in names), bool, len(names))
    code, at = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(rows)), np.diff(split.offsets.to_numpy()))
    keep = real[code]
    pairs = np.sort((at[keep] << 32) | code[keep])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    at, code = pairs >> 32, pairs & 0xFFFFFFFF
    n = np.bincount(at, minlength=len(rows))
    keep = (n >= MIN_WORDS)[at]
    at, code = at[keep], code[keep]
    order = np.argsort((at << 32) | narrow[code])
    code, kept = code[order], np.flatnonzero(n >= MIN_WORDS)
    ends = np.concatenate([[0], np.cumsum(n[kept])])
    content, digits, h = wide[code].tobytes(), [], []
    for k, a, b in zip(kept.tolist(), (8 * ends[:-1]).tolist(), (8 * ends[1:]).tolist()):
        sig = b" ".join(sorted(raw[k].translate(_DIGIT_BYTES).split()))
        digits.append(xxhash.xxh3_64_intdigest(sig) - (1 << 63))
        h.append(xxhash.xxh3_128_digest(sig + b"\n" + content[a:b]))
    own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((narrow[code] - (1 << 31)).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in kept.tolist()], pa.int64()), pa.array(h, pa.binary()), pa.array(digits, pa.int64()), own], ["id", "h", "digits", "words"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows in _pieces([r for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if r[1]]):
            yield _parsed(rows)


_PRIME_1, _PRIME_2, _PRIME_5 = (np.array([p], np.uint64) for p in (11400714785074694791, 14029467366897019727, 2870177450012600261))


def _lane(x: np.ndarray) -> np.ndarray:
    """Python's hash of whole numbers."""
    size = (np.abs(x).view(np.uint64) % np.uint64((1 << 61) - 1)).view(np.int64)
    own = np.where(x < 0, -size, size)
    return np.where(own == -1, -2, own).view(np.uint64)


def tuple_hashes(*columns: np.ndarray) -> np.ndarray:
    """Python's hash of each tuple of whole numbers; it is not salted, so all workers and runs agree on it."""
    acc = _PRIME_5
    for x in columns:
        acc = acc + _lane(x) * _PRIME_2
        acc = ((acc << np.uint64(31)) | (acc >> np.uint64(33))) * _PRIME_1
    acc = acc + np.uint64(len(columns) ^ (2870177450012600261 ^ 3527539))
    return np.where(acc == np.uint64((1 << 64) - 1), np.uint64(1546275796), acc).view(np.int64)


def signatures(ends: np.ndarray, own: np.ndarray, digits: np.ndarray, common: np.ndarray, often: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the message, key, role) of messages whose sorted words are ``own``, from ``ends[k]`` to ``ends[k + 1]``.

    The first word that two matching messages share, rarest first, is in both prefixes. If it is
    rare it is a key by itself (role 2: all pairs count). If it is common, they share no rare word
    at all and a second common word; then the similarity bounds the rare words of the partner
    by 1.25 * (number of common words) - (number of words), so the key also holds both numbers of
    rare words, and a pair counts between the side with fewer (role 0) and with more (role 1) only.
    ``common`` is sorted, ``often`` has the number of messages of each.
    """
    n, own = np.diff(ends).astype(np.int64), own.astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    place = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
    frequent = common[place] == own if len(common) else np.zeros(len(own), bool)
    prefix = n - (4 * n + 4) // 5 + 1
    rare, lone = at[~frequent], own[~frequent]
    r = np.bincount(rare, minlength=len(n))
    first = np.arange(len(rare)) - (np.cumsum(r) - r)[rare] < prefix[rare]
    yield rare[first], tuple_hashes(lone[first], digits[rare[first]]), np.full(int(first.sum()), 2, np.int8)
    # pairs of the rarest common words, for messages whose rare words don't fill the prefix
    few = r < prefix
    keep = frequent & few[at]
    at, own, count = at[keep], own[keep], often[place[keep]]
    order = np.lexsort((own, count, at))
    own, start = own[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(n)))])
    wide, most = prefix + 1 - r, (5 * (n - r)) // 4 - n
    shapes = np.flatnonzero(few & (most >= 0))
    for width, last in np.unique(np.stack([wide[shapes], most[shapes]]), axis=1).T.tolist():
        left, right = np.triu_indices(width, 1)
        alike, step = shapes[(wide[shapes] == width) & (most[shapes] == last)], max(1, KEYS_AT_ONCE // len(left))
        for low in range(0, len(alike), step):
            some = alike[low : low + step]
            near = own[start[some][:, None] + np.arange(width)]
            rows, a, c = np.repeat(some, len(left)), near[:, left].ravel(), near[:, right].ravel()
            d, mine = digits[rows], r[rows]
            for q in range(last + 1):
                yield rows, tuple_hashes(a, c, d, np.minimum(mine, q), np.maximum(mine, q)), np.where(mine == q, 2, np.where(mine < q, 0, 1)).astype(np.int8)


def _signer(bc):
    """The keys of parsed rows (id, digits, words)."""

    def batch(parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts), (pa.int64(), pa.int64(), pa.int8()))], ["id", "key", "role"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = bc.value
        for b in batches:
            ids, digits, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            ends, parts, size = own.offsets.to_numpy(), [], 0
            for k, key, role in signatures(ends - ends[:1], own.flatten().to_numpy(), digits, common, often):
                parts.append((ids[k], key, role))
                size += len(k)
                if size > KEYS_AT_ONCE:
                    yield batch(parts)
                    parts, size = [], 0
            if parts:
                yield batch(parts)

    return sign


def _keys(parsed: DataFrame, common: dict[int, int]) -> DataFrame:
    """(id, key, role): the signatures of parsed rows."""
    every = sorted(common.items())
    bc = parsed.sparkSession.sparkContext.broadcast((np.array([w for w, _ in every], np.int64), np.array([k for _, k in every], np.int64)))
    return parsed.select("id", "digits", "words").mapInArrow(_signer(bc), KEYS)


def common_words(parsed: DataFrame) -> dict[int, int]:
    """Hashes of the common words with their number of messages: at most COMMON_WORDS entries, counted over all rows."""
    total = parsed.select(F.sum(F.size("words"))).first()[0] or 0
    counts = parsed.select(F.explode("words").alias("w")).groupBy("w").count()
    return {r[0]: r[1] for r in counts.where(F.col("count") > max(2.0, total / COMMON_WORDS)).collect()}


def _matching(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that match; ``left`` and ``right`` have (id, digits, words)."""
    a = left.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("digits").alias("da"))
    b = right.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("digits").alias("db"))
    return (
        pairs.distinct().join(a, "a").join(b, "b")
        .where((F.col("da") == F.col("db")) & (9 * F.size(F.array_intersect("wa", "wb")) >= 4 * (F.size("wa") + F.size("wb"))))
        .select("a", "b")
    )


_PAIRED = "(role = 2 and role_b = 2 or role <> role_b)"


def _pairs(live: DataFrame, other: DataFrame) -> DataFrame:
    """(a, b) with a common key, b before a; ``live`` and ``other`` have (id, key, role)."""
    b = other.select("key", F.col("id").alias("b"), F.col("role").alias("role_b"))
    return live.join(b, "key").where(f"b < id and {_PAIRED}").select(F.col("id").alias("a"), "b")


class Resolution:
    """Outcome of one batch: ``cases`` (kept_id, duplicate_id), and the parsed rows of what was accepted if they are still there."""

    def __init__(self, cases: DataFrame, accepted: DataFrame | None):
        self.cases, self.accepted = cases, accepted


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of the keys that matter. One shuffle by key."""
    by = Window.partitionBy("key")
    spans = [f("role").over(by).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))] + [f("id").over(by).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    return keys.select("*", *spans).where(_JOINS).select("id", "key", "role")


def _resolve(parsed: DataFrame, common: dict[int, int], history: tuple[DataFrame, DataFrame] | None, scratch: list[str], once: bool = False) -> Resolution:
    """Decide a batch of parsed rows against a history of (signatures, word sets); the rows are a stored table.

    With ``once`` everything in ``scratch`` goes as soon as it isn't needed, also the parsed rows.
    """
    # full copies: all but the first of each class follow the first
    copies = store(parsed.select("id", F.min("id").over(Window.partitionBy("h")).alias("rep")).where("id <> rep").distinct(), scratch)
    keys = _keys(parsed, common)
    if history is not None:
        keys = store(keys.join(copies.select("id"), "id", "left_anti"), scratch)
        near = _shared(keys).distinct()
    else:  # the copies' keys are few beside the keys that nothing shares, so these go first
        near = _shared(_shared(keys).join(copies.select("id"), "id", "left_anti")).distinct()
    kept_parts = []
    if history is not None:
        past = history[0].select("key", F.col("id").alias("b"), F.col("role").alias("role_b"))
        met = store(keys.join(past, "key").where(_PAIRED).select(F.col("id").alias("a"), "b").distinct(), scratch)
        own = parsed.join(met.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("id", "digits", "words").dropDuplicates(["id"])
        hits = store(_matching(met, own, history[1]).groupBy("a").agg(F.min("b").alias("b")), scratch)
        kept_parts.append(hits)
        near = near.join(hits.select(F.col("a").alias("id")), "id", "left_anti")
    near = store(near, scratch)
    sets = store(parsed.join(near.select("id").distinct(), "id", "left_semi").select("id", "digits", "words").dropDuplicates(["id"]), scratch)
    if once:
        delete(parsed.sparkSession, scratch.pop(0))
    open_, accepted = near.select("id").distinct(), None
    for _ in range(LEADER_ROUNDS):
        live = near.join(open_, "id", "left_semi")
        led = live.join(live.groupBy("key").agg(F.min("id").alias("lead")), "key")
        first = store(led.groupBy("id").agg(F.min(F.col("lead") == F.col("id")).alias("first")).where("first").select("id"), scratch)
        # a leader's every signature has it as the only new accepted message: work is linear in the signatures
        pairs = led.where("id <> lead").join(first.select(F.col("id").alias("lead")), "lead", "left_semi").select(F.col("id").alias("a"), F.col("lead").alias("b"))
        hits = _matching(pairs, sets, sets).select(F.col("a").alias("id")).distinct()
        accepted = first if accepted is None else accepted.union(first)
        open_ = store(open_.join(first, "id", "left_anti").join(hits, "id", "left_anti"), scratch)
    live = near.join(open_, "id", "left_semi")
    links = store(_matching(_pairs(live, live), sets, sets), scratch)
    # whoever has no open link is accepted and turns those linked to it into cases; each round decides at least the smallest open message
    while not open_.isEmpty():
        free = store(open_.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), scratch)
        out = links.join(free.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        accepted = accepted.union(free)
        still = store(open_.join(free, "id", "left_anti").join(out, "id", "left_anti"), scratch)
        links = store(links.join(still.withColumnRenamed("id", "a"), "a", "left_semi").join(still.withColumnRenamed("id", "b"), "b", "left_semi"), scratch)
        open_ = still
    accepted = store(accepted, scratch)
    # each case's smallest accepted match, over all its signatures
    kept = _matching(_pairs(near.join(accepted, "id", "left_anti"), near.join(accepted, "id", "left_semi")), sets, sets).groupBy("a").agg(F.min("b").alias("b"))
    for part in kept_parts:
        kept = kept.unionByName(part)
    kept = store(kept, scratch)
    followers = copies.join(kept.withColumnRenamed("a", "rep"), "rep", "left").select(F.coalesce("b", "rep").alias("kept_id"), F.col("id").alias("duplicate_id"))
    cases = store(followers.unionByName(kept.select(F.col("b").alias("kept_id"), F.col("a").alias("duplicate_id"))).distinct())
    if once:
        for at in scratch:
            delete(parsed.sparkSession, at)
        return Resolution(cases, None)
    return Resolution(cases, parsed.join(cases.select(F.col("duplicate_id").alias("id")), "id", "left_anti").dropDuplicates(["id"]))


def _read(messages: DataFrame, common: dict[int, int] | None, scratch: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """The parsed rows of a batch, stored, and the common words, counted in the batch itself if not given."""
    rows = messages.select(F.col("id").cast("bigint"), "content").where("id is not null and content is not null")
    parsed = store(rows.mapInArrow(_parse, PARSED), scratch)
    return parsed, common_words(parsed) if common is None else common


def resolve(messages: DataFrame) -> Resolution:
    """Decide all messages as one batch without a history; ``messages`` has (id, content), other columns are ignored.

    Rows with a repeated id count once; null ids and null, empty and short contents match nothing and
    are neither cases nor hashed. The table may be empty.
    """
    scratch: list[str] = []
    return _resolve(*_read(messages, None, scratch), None, scratch, once=True)


class DedupIndex:
    """Signatures and word sets of the accepted messages in two bucketed tables under ``path``; each batch appends a part to both.

    ``CURRENT`` names the parts that are live and is replaced by one rename, so a batch that fails
    half way leaves the index as it was. One writer at a time. The number of buckets is fixed when
    the index is made: choose it so that one bucket of the history fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        text = read_text(spark, os.path.join(path, "CURRENT"))
        self.state = json.loads(text) if text else {"generation": 0, "buckets": buckets or shuffle_partitions(spark), "parts": [], "counted": 0}
        self._common: tuple[int, dict[int, int]] | None = None

    def _table(self, name: str) -> str:
        """The name in the session's catalogue, under which Spark knows the buckets."""
        generation = self.state["generation"]
        full = f"palimpsest_{name}_{xxhash.xxh3_64_hexdigest(self.path)}_{generation}"
        columns, by = {"keys": ("key bigint, id bigint, role tinyint, part string", "key"), "sets": ("id bigint, h binary, digits bigint, words array<int>, part string", "id")}[name]
        at = os.path.join(self.path, f"{name}-{generation}")
        self.spark.sql(f"create table if not exists {full} ({columns}) using parquet clustered by ({by}) into {self.state['buckets']} buckets location '{at}'")
        return full

    def _rows(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name)).where(F.col("part").isin(self.state["parts"])).drop("part")

    def common(self) -> dict[int, int] | None:
        generation = self.state["generation"]
        if not self.state["parts"]:
            return None
        if self._common is None or self._common[0] != generation:
            pairs = json.loads(read_text(self.spark, os.path.join(self.path, f"common-{generation}")))
            self._common = generation, dict(pairs)
        return self._common[1]

    def _append(self, parsed: DataFrame, common: dict[int, int], part: str) -> None:
        for name, rows, by in (("keys", _keys(parsed, common).select("key", "id", "role"), "key"), ("sets", parsed.select("id", "h", "digits", "words"), "id")):
            rows.withColumn("part", F.lit(part)).repartition(self.state["buckets"], by).write.insertInto(self._table(name))

    def _publish(self, common: dict[int, int] | None = None) -> None:
        if common is not None:
            publish_text(self.spark, os.path.join(self.path, f"common-{self.state['generation']}"), json.dumps(list(common.items())))
        publish_text(self.spark, os.path.join(self.path, "CURRENT"), json.dumps(self.state))

    def add(self, messages: DataFrame) -> DataFrame:
        """Resolve one batch against all before it, append what is accepted, give the cases (kept_id, duplicate_id).

        ``messages`` as in ``resolve``; all ids must be larger than those of the history. Any batch may be empty.
        """
        scratch: list[str] = []
        parsed, common = _read(messages, self.common(), scratch)
        done = _resolve(parsed, common, (self._rows("keys"), self._rows("sets")) if self.state["parts"] else None, scratch)
        first, part = not self.state["parts"], uuid.uuid4().hex
        self._append(done.accepted, common, part)
        size = folder_bytes(self.spark, os.path.join(self.path, f"sets-{self.state['generation']}"))
        self.state = self.state | {"parts": [*self.state["parts"], part], "counted": size if first else self.state["counted"]}
        self._publish(common if first else None)
        if size > REFIT * self.state["counted"] or len(self.state["parts"]) >= MOST_PARTS:
            self.recount()
        for at in scratch:
            delete(self.spark, at)
        return done.cases

    def recount(self) -> None:
        """Count the common words of the whole history, sign it anew with them and fold its parts into one. By REFIT, its cost is a share of all appends'."""
        sets = self._rows("sets")
        common, old = common_words(sets), self.state
        part = uuid.uuid4().hex
        self.state = old | {"generation": old["generation"] + 1}
        self._append(sets, common, part)
        self.state |= {"parts": [part], "counted": max(1, folder_bytes(self.spark, os.path.join(self.path, f"sets-{self.state['generation']}")))}
        self._publish(common)
        new, self.state = self.state, old
        self._forget()
        self.state = new

    def _forget(self) -> None:
        for name in ("keys", "sets"):
            self.spark.sql(f"drop table if exists {self._table(name)}")
            delete(self.spark, os.path.join(self.path, f"{name}-{self.state['generation']}"))

    def drop(self) -> None:
        """Delete the index."""
        self._forget()
        delete(self.spark, self.path)


def in_batches(messages: DataFrame, path: str, batch: str = "batch_no", buckets: int | None = None) -> DataFrame:
    """The cases of all batches, which enter a new index one after the other, in order of id; the index is deleted in the end.

    A batch is all rows from its smallest id up to the next batch's, so rows without a batch number belong to the one around them.
    """
    starts = messages.where(f"{batch} is not null and id is not null").groupBy(batch).agg(F.min("id").alias("at")).select("at").distinct().orderBy("at")
    bounds = [r[0] for r in starts.collect()]  # one row for each batch
    index, every = DedupIndex(messages.sparkSession, path, buckets), None
    for low, high in zip([None, *bounds[1:]], [*bounds[1:], None]):
        own = messages
        if low is not None:
            own = own.where(F.col("id") >= low)
        if high is not None:
            own = own.where(F.col("id") < high)
        cases = index.add(own)
        every = cases if every is None else every.unionByName(cases)
    if every is None:
        every = index.add(messages)
    index.drop()
    return every
