"""Entity profiles, pair statistics and style vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.runtime import store

BUCKETS, SIZES = 256, (3, 4, 5)
#: A task remembers the buckets of GRAM_SLOTS grams, takes ROWS texts and STRETCH characters at a time and holds the sums of SENDERS senders.
GRAM_SLOTS, ROWS, STRETCH, SENDERS = 1 << 20, 1_024, 1 << 18, 4_096


def profiles(m: DataFrame) -> DataFrame:
    """(entity, message_count, avg_length, uses_emoji, n_partners, first_ts, last_ts) of each sender in lower case; one shuffle."""
    return m.where("sender <> ''").groupBy(F.lower("sender").alias("entity")).agg(
        F.count("*").alias("message_count"), F.round(F.avg(F.length("content")), 4).alias("avg_length"), F.max(F.col("content").rlike(L.EMOJI).cast("int")).alias("uses_emoji"),
        F.count_distinct(F.when(F.col("recipient") != "", F.lower("recipient"))).alias("n_partners"), F.min(F.when(F.col("ts") != "", F.col("ts"))).alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def relationships(m: DataFrame) -> DataFrame:
    """(entity, partner, message_count, primary_category): the most frequent category of each directed pair."""
    pairs = m.where("sender <> '' and recipient <> ''").groupBy(F.lower("sender").alias("entity"), F.lower("recipient").alias("partner"), "category").agg(F.count("*").alias("n"))
    return pairs.groupBy("entity", "partner").agg(F.sum("n").alias("message_count"), F.max_by("category", F.struct("n", "category")).alias("primary_category"))


def communication_pattern(m: DataFrame, a: str, b: str) -> DataFrame:
    """One row of statistics of the messages between two parties, with the first, last and longest message's id."""
    a, b = a.lower(), b.lower()
    s, r = F.lower("sender"), F.lower("recipient")
    rows = m.where(((s == a) & (r == b)) | ((s == b) & (r == a)))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(s == a).alias("n_from_a"), F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.max_by("id", F.struct("ts", "id")).alias("last_id"),
        F.max_by("id", F.struct(F.length("content"), -F.col("id"))).alias("longest_id"),
    )


def style_grams(rows: DataFrame, keep: list[str], text: str = "content") -> DataFrame:
    """(keep..., bucket, c): counts of hash buckets of all character 3-, 4- and 5-grams; a bucket is the first byte of a gram's md5.

    Grams are exploded before they are hashed, so the hashing runs in generated code.
    """
    t = rows.select(*keep, F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ").alias("t"))
    every = None
    for n in SIZES:
        part = t.where(F.length("t") >= n).select(*keep, "t", F.explode(F.sequence(F.lit(1), F.length("t") - (n - 1))).alias("i")).select(*keep, F.substr("t", "i", F.lit(n)).alias("g"))
        every = part if every is None else every.unionByName(part)
    return every.select(*keep, F.conv(F.substring(F.md5("g"), 1, 2), 16, 10).cast("int").alias("bucket")).groupBy(*keep, "bucket").agg(F.count("*").alias("c"))


class _Buckets:
    """Buckets of character grams, hashed once and remembered in a table of one gram a slot; grams are compared whole."""

    def __init__(self) -> None:
        self.low, self.high, self.bucket = np.zeros(GRAM_SLOTS, np.uint64), np.zeros(GRAM_SLOTS, np.uint64), np.zeros(GRAM_SLOTS, np.uint8)

    def of(self, codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The buckets of the grams of n code points that begin at ``at``; a key holds code points from 1 on in 21 bits each."""
        c = [codes[at + k].astype(np.uint64) + np.uint64(1) for k in range(n)]
        low, high = c[0] | c[1] << np.uint64(21) | c[2] << np.uint64(42), np.zeros(len(at), np.uint64)
        for k in range(3, n):
            high |= c[k] << np.uint64(21 * (k - 3))
        slot = (low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - GRAM_SLOTS.bit_length() + 1)
        out, open_ = self.bucket[slot], np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        while len(open_):  # of the unknown grams of one slot one is hashed in each round
            _, first = np.unique(slot[open_], return_index=True)
            new = open_[first]
            grams = codes[at[new][:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le")
            self.low[slot[new]], self.high[slot[new]] = low[new], high[new]
            self.bucket[slot[new]] = [hashlib.md5(grams[i : i + n].encode(), usedforsecurity=False).digest()[0] for i in range(0, len(grams), n)]
            known = (self.low[slot[open_]] == low[open_]) & (self.high[slot[open_]] == high[open_])
            out[open_[known]] = self.bucket[slot[open_[known]]]
            open_ = open_[~known]
        return out


def _gram_counts(texts: list[str], buckets: _Buckets) -> np.ndarray:
    """Counts of the buckets of each text's grams, one row for each text."""
    length = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(texts)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters from here to the text's end
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for begin in range(0, len(codes), STRETCH):
        for n in SIZES:
            at = begin + np.flatnonzero(left[begin : begin + STRETCH] >= n)
            counts += np.bincount(row[at] * BUCKETS + buckets.of(codes, at, n), minlength=len(counts))
    return counts.reshape(-1, BUCKETS)


def _style_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, bucket, v) from (entity, t): sums of the texts' unit vectors, handed on when there are more than SENDERS senders."""
    buckets, place, sums = _Buckets(), {}, np.zeros((SENDERS + ROWS, BUCKETS))

    def held() -> pa.RecordBatch:
        e, bucket = np.nonzero(sums[: len(place)])
        names = pa.array(list(place), pa.string()).take(pa.array(e))
        return pa.RecordBatch.from_arrays([names, pa.array(bucket.astype(np.int32)), pa.array(sums[e, bucket])], ["entity", "bucket", "v"])

    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            counts = _gram_counts(b.column(1).to_pylist(), buckets).astype(float)
            norm = np.sqrt((counts * counts).sum(1))
            for r, entity in enumerate(b.column(0).to_pylist()):
                if norm[r]:
                    sums[place.setdefault(entity, len(place))] += counts[r] / norm[r]
            if len(place) > SENDERS:
                yield held()
                place.clear()
                sums[:] = 0
    if place:
        yield held()


def style_vectors(m: DataFrame) -> DataFrame:
    """(entity, bucket, value): the mean of the senders' unit style vectors, sparse and of length 1.

    The grams are those of ``style_grams``, counted within the scan; only the senders' sums are shuffled. A message's norm is over
    its own buckets only.
    """
    text = F.regexp_replace(F.lower(F.trim("content")), r"\s+", " ")
    t = m.where("sender <> '' and trim(content) <> ''").select(F.lower("sender").alias("entity"), text.alias("t"))
    mean = t.mapInArrow(_style_sums, "entity string, bucket int, v double").groupBy("entity", "bucket").agg(F.sum("v").alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("entity")))  # at most BUCKETS rows
    return mean.select("entity", "bucket", F.round(F.col("v") / length, 6).alias("value"))


def style_similarity(vectors: DataFrame, entity: str) -> DataFrame:
    """(entity, cosine) of every entity's style to that of one. The vectors are formed once and kept for both sides."""
    vectors = store(vectors)
    one = vectors.where(F.col("entity") == entity.lower()).select("bucket", F.col("value").alias("w"))  # at most BUCKETS rows
    return vectors.join(F.broadcast(one), "bucket").groupBy("entity").agg(F.round(F.sum(F.col("value") * F.col("w")), 4).alias("cosine"))


# Words of topics, traits and preferences.
TOPICS = {
    "startup/business": "startup company founded revenue funding investor pitch valuation mrr arr series seed raise", "technology": "code deploy database api backend frontend server aws cloud repo kubernetes docker github python go rewrite migrate typescript javascript",
    "health/fitness": "gym run running workout health marathon sleep meditation therapy doctor weight", "relationships": "dating anniversary valentine proposal ring wedding girlfriend boyfriend partner love",
    "food/dining": "restaurant coffee tacos sushi dinner lunch breakfast eat cook bar", "finance": "salary savings money bank mortgage house rent 401k investment budget expense", "career": "job quit hired hiring employee cofounder cto ceo role interview offer equity promotion",
    "pets": "dog puppy vet walk shelter pet", "entertainment": "show movie netflix hulu watch concert festival book game", "family": "mom dad sister brother parents family thanksgiving christmas birthday",
}
TRAITS = {
    "ambitious": "goal|growth|scale|expand|raise|million|revenue|build|launch|grind", "anxious": "worried|anxious|stress|panic|what if|scared|nervous|can't sleep|overwhelmed", "caring": "love|miss you|thinking of you|proud of|care about|how are you|check in|support",
    "analytical": "data|metrics|numbers|analysis|measure|calculate|percentage|accuracy|benchmark", "social": "drinks|party|hang out|get together|dinner with|let's meet|catch up|plans", "health-conscious": "gym|workout|run|meditation|sleep|diet|healthy|fitness|organic|supplements",
    "technical": "code|deploy|api|database|server|algorithm|architecture|framework|debug", "family-oriented": "mom|dad|sister|family|parents|thanksgiving|christmas|birthday|home|visit", "entrepreneurial": "startup|founder|company|pitch|investor|equity|valuation|raise",
    "loyal": "always|forever|promise|never leave|count on|trust|got your back|support",
}
CASUAL = "lol haha omg gonna wanna gotta yeah yep nah bruh dude tbh idk imo btw ngl fr rn lmao".split()


def topics(m: DataFrame) -> DataFrame:
    """(entity, topic, hits): topics of which a sender used at least two words, counted once for each message and word."""
    words = F.array_distinct(F.split(F.lower("content"), r"\s+"))
    counts = [F.sum(F.size(F.array_intersect("w", F.array(*map(F.lit, ws.split()))))).alias(t) for t, ws in TOPICS.items()]
    per = m.where("sender <> ''").select(F.lower("sender").alias("entity"), words.alias("w")).groupBy("entity").agg(*counts)
    return per.unpivot(["entity"], list(TOPICS), "topic", "hits").where("hits >= 2")


def traits(m: DataFrame) -> DataFrame:
    """(entity, trait, hits): traits with at least max(2, n / 50) indicators in a sender's n messages."""
    low = F.lower("content")
    hits = [F.sum(F.size(F.filter(F.array(*map(F.lit, ws.split("|"))), _within(low)))).alias(t) for t, ws in TRAITS.items()]
    per = m.where("sender <> ''").groupBy(F.lower("sender").alias("entity")).agg(F.count("*").alias("n"), *hits)
    return per.unpivot(["entity", "n"], list(TRAITS), "trait", "hits").where(F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("n") / 50))).drop("n")


def _within(text: Column):
    return lambda w: F.contains(text, w)


def formality(m: DataFrame) -> DataFrame:
    """(entity, formality): casual above .65 of short casual messages against formal ones, formal below .35, else mixed."""
    c = F.col("content")
    short = F.length(c) < 50
    casual = (F.arrays_overlap(F.split(F.lower(c), r"\s+"), F.array(*map(F.lit, CASUAL))) | (c == F.lower(c)) | c.rlike(L.EMOJI)) & short
    formal = ~casual & ((c.rlike(r"^[A-Z]") & c.rlike(r"\.\s*$")) | (F.length(c) > 200))
    per = m.where("sender <> ''").groupBy(F.lower("sender").alias("entity")).agg(F.count_if(casual).alias("casual"), F.count_if(formal).alias("formal"))
    r = F.col("casual") / (F.col("casual") + F.col("formal"))
    return per.select("entity", "casual", "formal", F.when(F.col("casual") + F.col("formal") == 0, "mixed").when(r > 0.65, "casual").when(r < 0.35, "formal").otherwise("mixed").alias("formality"))


# Words that open a greeting.
GREETINGS = ("hey", "hi", "hello", "yo", "sup", "what's up", "good morning", "morning", "heyy", "heyyy")


def greeting_of(content: str = "content") -> Column:
    """The greeting that a message begins with, in two words or one; '' if it begins with none."""
    w = F.split(F.trim(F.lower(content)), r"\s+")
    two = F.array_join(F.slice(w, 1, 2), " ")
    return F.when(two.isin(*GREETINGS), two).when(w[0].isin(*GREETINGS), w[0]).otherwise("")


def greetings(m: DataFrame) -> DataFrame:
    """(entity, greeting, n): the most frequent greeting of each sender, in order of letters on ties."""
    per = m.where("sender <> ''").select(F.lower("sender").alias("entity"), greeting_of().alias("greeting")).where("greeting <> ''").groupBy("entity", "greeting").agg(F.count("*").alias("n"))
    return per.groupBy("entity").agg(F.min_by("greeting", F.struct(-F.col("n"), "greeting")).alias("greeting"), F.max("n").alias("n"))


def greeting(own: DataFrame) -> str:
    top = greetings(own).first()
    return top["greeting"] if top else ""


# Words of messages that tell of preferences.
PREFERENCES = {
    "food": (
        "eat|eating|ate|lunch|dinner|breakfast|brunch|restaurant|restaurants|food|cook|cooking|cooked|pizza|sushi|tacos|burger|burgers|steak|chicken|salad|ramen|pasta|sandwich|bbq|brisket|ribs|coffee|latte|espresso|tea|beer|wine|cocktail|"
        "drinks|bar|brewery|pub|oat milk|oats|eggs|smoothie|vegan|vegetarian|omakase|charcuterie|appetizer|dessert|cuisine|dish|meal|snack|recipe|diner|cafe"
    ),
    "activities": (
        "gym|run|running|ran|workout|exercise|lift|lifting|crossfit|yoga|meditation|meditate|swim|swimming|hike|hiking|bike|biking|cycling|watch|watched|watching|show|movie|film|read|reading|book|podcast|music|concert|festival|game|gaming|play|"
        "played|golf|tennis|soccer|basketball|football|baseball|marathon|race|trail|climb|climbing|surf|surfing|ski|skiing"
    ),
    "fears": (
        "worried|worries|worry|worrying|scared|scary|afraid|anxious|anxiety|nervous|panic|panicking|stress|stressed|stressful|fear|fears|terrified|what if|freaking out|freak out|can't sleep|overwhelmed|overwhelming|burnout|burn out|imposter|"
        "imposter syndrome|doubt|doubts|uncertain|uncertainty|insecure|insecurity|chest tightness|worst case|nightmare|dread"
    ),
    "routines": (
        "morning|mornings|every day|daily|routine|routines|always|usually|every morning|every night|every week|weekly|habit|habits|schedule|ritual|wake up|woke up|alarm|6am|7am|bedtime|night routine|morning routine|workout routine|every monday|every friday"
    ),
    "values": (
        "important|priority|priorities|value|values|believe|believes|belief|principle|principles|decision|decided|choose|chose|choice|commit|committed|commitment|boundary|boundaries|hard stop|non-negotiable|matter|matters|care about|stand for|mission"
    ),
}


def preferences(m: DataFrame) -> DataFrame:
    """(entity, bucket, text, keywords, first_ts): what senders' messages tell of food, activities, fears, routines and values.

    Texts are cut at 300 characters, texts that begin with the same 80 count once (the first by ts and id); up to five of the
    bucket's words that occur, in their order. Directives are left out.
    """
    low = F.lower("content")
    hit = F.filter(
        F.array(*(F.struct(F.lit(b).alias("bucket"), F.slice(F.filter(F.array(*map(F.lit, ws.split("|"))), lambda w: F.contains(low, w)), 1, 5).alias("keywords")) for b, ws in PREFERENCES.items())), lambda x: F.size(x["keywords"]) > 0
    )
    rows = m.where("not directive and sender <> ''").select(F.lower("sender").alias("entity"), "id", "ts", F.left("content", F.lit(300)).alias("text"), F.explode(hit).alias("b")).select("entity", "id", "ts", "text", "b.*")
    first = F.min_by(F.struct("text", "keywords", "ts"), F.struct("ts", "id"))
    return rows.groupBy("entity", "bucket", F.left("text", F.lit(80)).alias("start")).agg(first.alias("r")).select("entity", "bucket", "r.text", "r.keywords", F.col("r.ts").alias("first_ts"))


def preferred_people(m: DataFrame) -> DataFrame:
    """(entity, person, message_count): whom senders write to, as spelled."""
    return m.where("not directive and sender <> '' and recipient <> ''").groupBy(F.lower("sender").alias("entity"), F.col("recipient").alias("person")).agg(F.count("*").alias("message_count"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles (entity, message_count, avg_length) after further messages, for use on every micro-batch."""
    both = old.select("entity", "message_count", "avg_length").unionByName(new.select("entity", "message_count", "avg_length"))
    return both.groupBy("entity").agg(F.sum("message_count").alias("message_count"), (F.sum(F.col("message_count") * F.col("avg_length")) / F.sum("message_count")).alias("avg_length"))


def resolve(entities: DataFrame, name: str) -> DataFrame:
    """The entity that a name means: exact, else the only one that contains it, else the first that does (in order of names)."""
    n = name.lower().strip()
    hit = entities.where(F.contains("entity", F.lit(n))).select("entity", F.when(F.col("entity") == n, 0).otherwise(1).alias("far"))
    return hit.orderBy("far", "entity").limit(1).select("entity")
