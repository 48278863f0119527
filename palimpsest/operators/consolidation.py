"""Derived tables: supersession chains of changed facts, summaries, structured facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L

ALWAYS = ("explicit_change", "informal_correction", "negation_change", "retraction")
NEVER = ("status_change", "invalidation")


def normalised_subject(raw: Column, context: Column) -> Column:
    """The canonical subject of the first keyword in the value or anywhere in the message, else the value in snake case."""
    out = F.substring(F.regexp_replace(F.trim(F.lower(raw)), r"\s+", "_"), 1, 50)
    for word, subject in reversed(L.SUBJECTS.items()):
        out = F.when(F.contains(F.lower(raw), F.lit(word)) | F.contains(F.lower(context), F.lit(word)), subject).otherwise(out)
    return out


def changes(m: DataFrame) -> DataFrame:
    """(id, ts, kind, subject, old_fact, new_fact, p, k): every phrase of change, in order of pattern p and match k.

    All patterns are matched in one projection, whose matches are exploded once.
    """
    def found(p: int, kind: str, category: str, pattern: str) -> Column:
        two = kind in ("explicit_change", "pricing")
        first, second = (F.regexp_extract_all("content", F.lit(pattern), F.lit(g)) for g in ((1, 2) if two else (1, 1)))

        def match(g: Column, k: Column) -> Column:
            a, b, none = F.trim(g["a"]), F.trim(g["b"]), F.lit(None).cast("string")
            if kind == "explicit_change":
                cols = (normalised_subject(a, F.col("content")), a, b)
            elif kind == "pricing":
                cols = (F.concat(F.lit("pricing_"), F.lower(b)), none, a)
            elif kind in ("location_change", "schedule_change"):
                cols = (F.lit({"location": "office_location", "schedule": "gym_schedule"}[category]), none, a)
            elif kind == "status_change":
                cols = (F.concat(F.lit("status_"), F.regexp_replace(F.lower(a), r"\s+", "_")), none, a)
            else:
                subject = normalised_subject(F.lit(""), F.col("content"))
                cols = (F.when(subject == "", F.lit("correction")).otherwise(subject), none, a)
            return F.struct(F.lit(kind).alias("kind"), cols[0].alias("subject"), cols[1].alias("old_fact"), cols[2].alias("new_fact"), F.lit(p).alias("p"), k.alias("k"))

        return F.when(F.col("content").rlike(pattern), F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), match))

    every = F.flatten(F.filter(F.array(*(found(p, *x) for p, x in enumerate(L.CHANGES))), lambda x: x.isNotNull()))
    return m.where("not directive").select("id", "ts", F.explode(every).alias("c")).select("id", "ts", "c.*")


def supersessions(found: DataFrame) -> DataFrame:
    """(subject, fact, id, ts, seq, superseded_by, valid_from, valid_to, status): one chain for each subject.

    The entry before is always the last of its subject, so lead over the subject's order decides.
    A subject's first explicit change also records the old value. A following entry supersedes if
    its kind always does, or if its value differs (prices exactly, places and times in any case).
    """
    w = Window.partitionBy("subject").orderBy("ts", "id", "p", "k", "half")
    first = F.row_number().over(Window.partitionBy("subject").orderBy("ts", "id", "p", "k")) == 1
    new = F.struct(F.col("new_fact").alias("fact"), F.lit(1).alias("half"))
    halves = F.when(first & (F.col("kind") == "explicit_change"), F.array(F.struct(F.col("old_fact").alias("fact"), F.lit(0).alias("half")), new)).otherwise(F.array(new))
    rows = found.select("subject", "id", "ts", "kind", "p", "k", halves.alias("h")).select("subject", "id", "ts", "kind", "p", "k", F.inline("h"))
    rows = rows.withColumn("seq", F.row_number().over(w))
    nxt = F.lead(F.struct("kind", "fact", "ts", "seq")).over(w)
    rows = rows.withColumn("nx", nxt)
    rule = (
        F.col("nx.kind").isin(*ALWAYS) | ((F.col("nx.kind") == "pricing") & (F.col("nx.fact") != F.col("fact")))
        | (F.col("nx.kind").isin("location_change", "schedule_change") & (F.lower("nx.fact") != F.lower("fact")))
    )
    over = F.coalesce(rule, F.lit(False))
    return rows.select(
        "subject", "fact", "id", "ts", "seq", F.when(over, F.col("nx.seq")).alias("superseded_by"), F.col("ts").alias("valid_from"), F.when(over, F.col("nx.ts")).alias("valid_to"),
        F.when(over, "superseded").otherwise("active").alias("status"),
    )


def changed_fact_search(chain: DataFrame, words: list[str]) -> DataFrame:
    """(subject, current, history, relevance): subjects whose name or a fact holds a query word.

    ``current`` is the last fact that isn't superseded; relevance counts the words, halved if all are superseded.
    """
    low = F.concat_ws(" ", F.lower("subject"), F.lower("fact"))
    n = F.size(F.filter(F.array(*map(F.lit, words)), lambda x: F.contains(low, x)))
    per = chain.withColumn("hits", n).groupBy("subject").agg(
        F.max("hits").alias("hits"), F.max_by(F.when(F.col("status") == "active", F.col("fact")), F.when(F.col("status") == "active", F.col("seq"))).alias("current"), F.count("*").alias("versions")
    )
    return per.where("hits > 0").select("subject", "current", "versions", F.when(F.col("current").isNull(), F.col("hits") * 0.5).otherwise(F.col("hits") * 1.0).alias("relevance"))


def density(content: str = "content") -> Column:
    """Information density of a message in [0, 1]: length, numbers, words of decision, proper nouns."""
    c = F.col(content)
    n = F.length(c)
    numbers = sum((F.regexp_count(c, F.lit(p if p.startswith("(?i)") else f"(?i){p}")) for p in L.SUMMARY_NUMBERS), F.lit(0))
    words = F.size(F.filter(F.array(*map(F.lit, L.DECISIONS)), lambda w: F.contains(F.lower(c), w)))
    s = F.when(n > 200, 0.3).when(n > 100, 0.2).when(n > 50, 0.1).when(n < 20, -0.2).otherwise(0.0)
    s = s + F.least(F.lit(0.3), numbers * 0.1) + F.least(F.lit(0.3), words * 0.1) + F.least(F.lit(0.1), F.regexp_count(c, F.lit(L.PROPER_NOUN)) * 0.02)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def month(ts: str = "ts") -> Column:
    m = F.regexp_extract(ts, r"^(\d{4}-\d{2})", 1)
    return F.when(m == "", "unknown").otherwise(m)


def sentence_score(s: Column) -> Column:
    n, low = F.length(s), F.lower(s)
    words = F.size(F.filter(F.array(*map(F.lit, L.SENTENCE_EVENTS)), lambda w: F.contains(low, w)))
    return (
        F.when(n > 100, 0.2).when(n > 50, 0.1).otherwise(0.0) + F.when(s.rlike(r"\d"), 0.15).otherwise(0.0) + F.when(s.rlike(r"\$[\d,.]+"), 0.2).otherwise(0.0)
        + F.least(F.lit(0.3), words * 0.1) + F.least(F.lit(0.1), F.regexp_count(s, F.lit(L.PROPER_NOUN)) * 0.02)
    )


def sentences(text: Column) -> Column:
    """Sentences of more than ten characters."""
    parts = F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) > 10)


def monthly_messages(m: DataFrame, change_counts: DataFrame | None = None) -> DataFrame:
    """The messages that a month's summary is made of: (month, id, sal, rn, top_count).

    ring = #(sal > .5) + 2 * #changes; the number kept is max(25, n / 3) above 10, max(15, n / 5) above 5,
    else max(8, n / 8), floor divisions. Months are counted with map-side combine; ranks use a group limit.
    """
    rows = m.where("not directive").select("id", "ts", month().alias("month"), F.round(density(), 6).alias("sal"))
    if change_counts is not None:
        rows = rows.join(change_counts, "id", "left").fillna(0, ["n_changes"])
    else:
        rows = rows.withColumn("n_changes", F.lit(0))
    per = rows.groupBy("month").agg(F.count("*").alias("n"), (F.count_if(F.col("sal") > 0.5) + 2 * F.sum("n_changes")).alias("ring"))
    n = F.col("n")
    per = per.withColumn("top_count", F.when(F.col("ring") > 10, F.greatest(F.lit(25), F.floor(n / 3))).when(F.col("ring") > 5, F.greatest(F.lit(15), F.floor(n / 5))).otherwise(F.greatest(F.lit(8), F.floor(n / 8))))
    w = Window.partitionBy("month").orderBy(F.desc("sal"), "ts", "id")
    return rows.join(per, "month").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("top_count")).select("month", "id", "sal", "rn", "top_count")


def monthly_summaries(m: DataFrame, change_counts: DataFrame | None = None, kept: int = 20) -> DataFrame:
    """(month, n_sentences, summary): the best max(20, n / 3) sentences of each month's messages, in order of time."""
    top = monthly_messages(m, change_counts).join(m.select("id", "ts", "content"), "id")
    s = top.select("month", "id", "ts", "sal", F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))
    s = s.withColumn("score", F.round(sentence_score(F.col("sentence")) + 0.3 * F.col("sal"), 6))
    w = Window.partitionBy("month").orderBy(F.desc("score"), "ts", "id", "pos")
    best = s.withColumn("rn", F.row_number().over(w)).join(s.groupBy("month").agg(F.count("*").alias("n")), "month")
    best = best.where(F.col("rn") <= F.greatest(F.lit(kept), F.floor(F.col("n") / 3)))
    line = F.array_sort(F.collect_list(F.struct("ts", "id", "pos", "sentence")))  # a month's kept sentences
    return best.groupBy("month").agg(F.count("*").alias("n_sentences"), F.array_join(F.transform(line, lambda x: x["sentence"]), " ").alias("summary"))


def entity_months(m: DataFrame, least: int = 10, least_month: int = 3) -> DataFrame:
    """(entity, month, n, kept): senders of at least ten messages, their months of at least three, and max(5, n / 4) kept messages."""
    rows = m.where("not directive and sender <> ''").select(F.lower("sender").alias("entity"), month().alias("month"))
    per = rows.groupBy("entity", "month").agg(F.count("*").alias("n"))
    total = per.groupBy("entity").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    return per.join(total.select("entity"), "entity").where(F.col("n") >= least_month).select("entity", "month", "n", F.greatest(F.lit(5), F.floor(F.col("n") / 4)).alias("kept"))


def key_numbers(m: DataFrame) -> DataFrame:
    """(id, number): the numbers that summaries keep, pattern by pattern."""
    every = F.concat(*(F.regexp_extract_all("content", F.lit(p if p.startswith("(?i)") else f"(?i){p}"), F.lit(0)) for p in L.SUMMARY_NUMBERS))
    return m.select("id", F.explode(every).alias("number"))


def overlap_search(chain: DataFrame, words: list[str], month_: str | None = None) -> DataFrame:
    """Rows (subject, fact, seq) by the number of query words in them, doubled for the timeline, +2 in the asked month."""
    low = F.concat_ws(" ", F.lower("subject"), F.lower("fact"))
    n = F.size(F.filter(F.array(*map(F.lit, words)), lambda x: F.contains(low, x)))
    bonus = F.when(month() == month_, 2).otherwise(0) if month_ else F.lit(0)
    return chain.withColumn("relevance", n * 2 + bonus).where(n > 0).select("subject", "fact", "seq", "relevance")


# Phrases of roles, hires and places.
ROLE = r"(?i)\b(\w+(?:\s+\w+)?)\s+(?:is|as)\s+(?:our\s+)?(?:the\s+)?(CTO|CEO|COO|CFO|VP|lead|manager|engineer|designer|intern|cofounder|co-founder)"
HIRE = r"(?i)(?:hired|brought on|recruited|onboarded)\s+(\w+(?:\s+\w+)?)"
PLACES = (r"(?i)(?:office|headquarters|hq)\s+(?:at|in|is)\s+(.+?)(?:[.,!?]|$)", r"(?i)(?:moved|relocated|based)\s+(?:to|in)\s+(.+?)(?:[.,!?]|$)")


def places(m: DataFrame) -> DataFrame:
    """(place): distinct places of 4 to 49 characters that messages name."""
    found = F.concat(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in PLACES))
    return m.where("not directive").select(F.explode(found).alias("p")).select(F.trim("p").alias("place")).where("length(place) > 3 and length(place) < 50").distinct()


def roster(m: DataFrame) -> DataFrame:
    """(name, role): capitalised people with their last stated role (by ts, id), 'member' for hires without one."""
    rows = m.where("not directive").select("id", "ts", "content")
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(ROLE), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(ROLE), F.lit(2)).alias("r"))
    said = rows.select("id", "ts", F.posexplode(pairs).alias("k", "p")).select("id", "ts", "k", F.trim("p.n").alias("name"), F.trim("p.r").alias("role"))
    hired = rows.select("id", "ts", F.posexplode(F.regexp_extract_all("content", F.lit(HIRE), F.lit(1))).alias("k", "n")).select("id", "ts", "k", F.trim("n").alias("name"), F.lit(None).cast("string").alias("role"))
    every = said.unionByName(hired).where(F.col("name").rlike(r"^[A-Z].") )
    return every.groupBy("name").agg(F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("ts", "id", "k"))), F.lit("member")).alias("role"))
