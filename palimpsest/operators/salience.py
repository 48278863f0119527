"""Salience, entity boosts and surprise, as column expressions and windows over bounded pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L

FEATURES = ("f_noise", "f_emoji", "f_length", "f_num", "f_money", "f_date", "f_mod", "f_nl", "f_bul", "f_excl", "f_caps", "f_arou", "f_life")
BLOCKED_SOURCES = ("personality", "profile", "style_vec", "summary", "contradiction")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _hits(low: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))).cast("double")


def _cap(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def salience_features(content: str = "content", modality: str | None = "modality") -> dict[str, Column]:
    """The thirteen features of a message; without ``modality`` all are chat."""
    t = F.trim(F.col(content))
    low = F.lower(t)
    bare = F.regexp_replace(low, r"^[!?.… ]+|[!?.… ]+$", "")
    n = F.length(t)
    return {
        "f_noise": bare.isin(*L.NOISE).cast("double"), "f_emoji": F.when(n > 0, _cap(_count(t, L.EMOJI) / n)).otherwise(0.0), "f_length": F.log1p(n) / 7.0,
        "f_num": F.log1p(_count(t, L.NUMBER)) / 3.0, "f_money": _cap(_count(t, L.MONEY) / 2.0), "f_date": _cap(_count(t, L.MONTH_DAY) / 2.0),
        "f_mod": F.lower(modality).isin(*L.HIGH_SIGNAL).cast("double") if modality else F.lit(0.0), "f_nl": (F.contains(t, F.lit("\n")) & (n > 50)).cast("double"), "f_bul": t.rlike(r"(?m)^[-*•]\s").cast("double"),
        "f_excl": _cap(_count(t, "!") / 3.0), "f_caps": _cap(_count(t, L.CAPITALS) / 5.0), "f_arou": _cap(_hits(bare, L.AROUSAL) / 3.0), "f_life": _cap(_hits(bare, L.LIFE_EVENTS) / 2.0),
    }


def salience(content: str = "content", modality: str | None = "modality") -> Column:
    """Logistic salience in [0, 1]; blank text has 0."""
    f = salience_features(content, modality)
    z = F.lit(L.SALIENCE_BIAS)
    for name, w in zip(FEATURES, L.SALIENCE_WEIGHTS):
        z = z + w * f[name]
    return F.when(F.trim(F.col(content)) == "", 0.0).otherwise(1 / (1 + F.exp(-z)))


def salience_additive(content: str = "content", modality: str = "modality") -> Column:
    """The additive score that holds without trained weights."""
    t = F.trim(F.col(content))
    bare = F.regexp_replace(F.lower(t), r"^[!?.… ]+|[!?.… ]+$", "")
    n, f = F.length(t), salience_features(content, modality)
    excl, caps = _count(t, "!"), _count(t, L.CAPITALS)
    s = (
        F.lit(0.3) - 0.3 * f["f_noise"] - F.when(t.rlike(rf"^(?:{L.EMOJI}|\s)+$"), 0.2).otherwise(0.0) + F.when(n < 10, -0.1).when(n < 30, 0.0).when(n < 100, 0.1).when(n < 200, 0.2).otherwise(0.25)
        + F.when(t.rlike(L.MONEY), 0.15).when(t.rlike(L.NUMBER) | t.rlike(L.MONTH_DAY), 0.1).otherwise(0.0) + 0.15 * f["f_mod"] + 0.05 * f["f_nl"] + 0.05 * f["f_bul"]
        + F.when(excl >= 3, 0.15).when(excl >= 1, 0.05).otherwise(0.0) + F.least(F.lit(0.1), caps * 0.05) + F.least(F.lit(0.2), _hits(bare, L.AROUSAL) * 0.1) + F.least(F.lit(0.3), _hits(bare, L.LIFE_EVENTS) * 0.15)
    )
    return F.when(F.col(content) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def salience_guard(pool: DataFrame, floor: float, rescue: list[int] = ()) -> DataFrame:
    """Pool rows of at least ``floor`` salience; rescued ids stay."""
    keep = salience() >= floor
    return pool.withColumn("salience", salience()).where(keep | F.col("id").isin(list(rescue)) if rescue else keep)


def entity_boost(pool: DataFrame, entities: list[str]) -> DataFrame:
    """``entity_boost``: +30 % of the best score from or to a target, +20 % if one is mentioned, else -15 %; with ``boosted`` the sum."""
    es = [e.lower() for e in entities]
    top = F.max("score").over(Window.partitionBy(F.lit(0)))  # a bounded pool
    top = F.when(top <= 0, 0.01).otherwise(top)
    low = F.lower("content")
    direct = F.lower("sender").isin(*es) | F.lower("recipient").isin(*es)
    named = F.exists(F.array(*map(F.lit, es)), lambda e: F.contains(low, e))
    raw = F.when(direct, 0.30).otherwise(0.0) + F.when(named, 0.20).otherwise(0.0)
    boost = top * F.when(raw == 0, -0.15).otherwise(raw)
    return pool.withColumn("entity_boost", boost).withColumn("boosted", F.col("score") + boost)


def sender_saturation(pool: DataFrame) -> DataFrame:
    """With more than five senders, the n-th row of a sender (n > 3) loses 0.03 (n - 3), down to 0.01."""
    order = [F.desc("boosted"), F.col("id").cast("string")]
    n = F.row_number().over(Window.partitionBy(F.lower("sender")).orderBy(*order))
    many = F.size(F.collect_set(F.when(F.col("sender") != "", F.lower("sender"))).over(Window.partitionBy(F.lit(0))))
    out = pool.withColumn("nth", n).withColumn("many", many)
    hit = (F.col("many") > 5) & (F.col("nth") > 3) & (F.col("sender") != "")
    return out.withColumn("final", F.when(hit, F.greatest(F.lit(0.01), F.col("score") - 0.03 * (F.col("nth") - 3)) + F.col("entity_boost")).otherwise(F.col("boosted"))).drop("many")


def surprise_boost(pool: DataFrame, surprise: DataFrame, alpha: float = 0.2) -> DataFrame:
    """score * (1 + alpha * surprise); rows of blocked sources and rows without a surprise stay."""
    s = surprise.select(F.col("message_id").alias("id"), "surprise")
    blocked = F.arrays_overlap(F.split("source", r"\+"), F.array(*map(F.lit, BLOCKED_SOURCES)))
    return pool.join(s, "id", "left").withColumn("score", F.when(~blocked & F.col("surprise").isNotNull(), F.col("score") * (1 + max(0.0, alpha) * F.col("surprise"))).otherwise(F.col("score"))).drop("surprise")


# Words that are capitalised without naming anything, and words of events.
COMMON_NOUNS = (
    "I The A An Is It He She We They My Your His Her Our This That What When Where Who How Why But And Or So If Not No Yes Can Will Just Do Did Has Have Had Was Were Are Been Be Would Could Should May Might Let Also Still "
    "Even Too Very Really About Like Here There Now Then Well Hey Yeah Yep Thanks Thank Sure Ok For With From Into Over After Before Between During Through Some Any All Each Every New Good Great First Last Going Looking Don"
).split()
EVENT_WORDS = (
    "quit hired fired joined started founded launched raised closed signed moved switched migrated decided announced incorporated accepted rejected bought sold promoted deployed released published graduated married engaged diagnosed recovered completed won lost"
).split()
ISO_OR_NAMED_DATE = r"(?i)\b\d{4}-\d{2}-\d{2}\b|\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2}(?:,?\s*\d{4})?"
DEFINITION = r"(\w[\w\s]{2,30})\s+(?:is|are|was|were)\s+(\w[\w\s]{2,30})"


def fact_fingerprints(content: str = "content") -> Column:
    """The distinct facts of a message: num:, entity:, date:, event: (with two words around) and def: strings."""
    c = F.col(content)
    all_of = lambda p, g=0: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    numbers = F.transform(all_of(L.FACT_NUMBERS), lambda x: F.concat(F.lit("num:"), F.regexp_replace(F.lower(F.trim(x)), ",", "")))
    nouns = F.transform(F.filter(all_of(L.PROPER_NOUN), lambda x: ~x.isin(*COMMON_NOUNS) & (F.length(x) > 1)), lambda x: F.concat(F.lit("entity:"), F.lower(x)))
    dates = F.transform(all_of(ISO_OR_NAMED_DATE), lambda x: F.concat(F.lit("date:"), F.lower(F.trim(x))))
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    at = F.filter(F.transform(words, lambda w, i: F.when(F.regexp_replace(w, r"^[.,!?\"'()]+|[.,!?\"'()]+$", "").isin(*EVENT_WORDS), i)), lambda i: i.isNotNull())
    lo = lambda i: F.greatest(F.lit(0), i - 2)
    events = F.transform(at, lambda i: F.concat(F.lit("event:"), F.array_join(F.slice(words, lo(i) + 1, i + 3 - lo(i)), " ")))
    pairs = F.arrays_zip(F.transform(all_of(DEFINITION, 1), lambda x: F.lower(F.trim(x))).alias("s"), F.transform(all_of(DEFINITION, 2), lambda x: F.lower(F.trim(x))).alias("p"))
    defs = F.transform(F.filter(pairs, lambda x: (F.length(x["s"]) > 3) & (F.length(x["p"]) > 3)), lambda x: F.concat(F.lit("def:"), x["s"], F.lit("="), x["p"]))
    return F.array_distinct(F.concat(numbers, nouns, dates, events, defs))


def surprise_index(m: DataFrame) -> DataFrame:
    """(message_id, surprise, fact_count, new_fact_count): a fact is new in the first message (by ts, id) that has it.

    The sequential fold over all messages becomes one minimum for each fact: map-side combined, so a
    fact in a third of all messages costs no task more than its share.
    """
    rows = m.select("id", "ts", "content", fact_fingerprints().alias("facts"))
    facts = rows.select("id", "ts", F.explode("facts").alias("fact"))
    first = facts.groupBy("fact").agg(F.min(F.struct("ts", "id")).alias("at"))
    new = first.groupBy(F.col("at.id").alias("id")).agg(F.count("*").alias("new"), F.count_if(F.startswith("fact", F.lit("event:"))).alias("new_events"))
    j = rows.join(new, "id", "left").withColumn("n", F.size("facts")).fillna(0, ["new", "new_events"])
    stripped = F.regexp_replace(F.lower(F.trim("content")), r"(?U)[^\w\s]", "")
    size = F.length("content")
    noise = stripped.isin(*L.SURPRISE_NOISE) | (F.length(stripped) < 4)
    few = F.filter(F.split(stripped, r"\s+"), lambda w: w != "")
    noise = noise | ((F.size(few) <= 2) & F.forall(few, lambda w: w.isin(*[x for x in L.SURPRISE_NOISE if " " not in x])))
    detail = F.regexp_count("content", F.lit(L.FACT_NUMBERS)) + F.regexp_count("content", F.lit(ISO_OR_NAMED_DATE))
    score = (
        F.col("new") / F.col("n") * 0.6 + F.when(size > 300, 0.15).when(size > 150, 0.10).when(size > 80, 0.05).otherwise(0.0)
        + F.least(F.lit(0.15), detail * 0.05) + F.least(F.lit(0.10), F.col("new_events") * 0.05)
    )
    value = (
        F.when(noise, 0.05).when((F.col("n") == 0) & (size < 30), 0.1).when((F.col("n") == 0) & (size < 80), 0.2).when(F.col("n") == 0, 0.3)
        .when(F.col("new") == 0, 0.1).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score)))
    )
    return j.select(F.col("id").alias("message_id"), F.round(value, 4).alias("surprise"), F.col("n").cast("bigint").alias("fact_count"), F.col("new").alias("new_fact_count"))
