"""BM25 keyword retrieval over words in lower case without accents.

``scan_search`` scores in one pass over the documents with column expressions; the corpus
statistics are one aggregate row. ``build_postings`` materialises an inverted index, from
which ``postings_search`` reads the query's terms only. ``Index`` keeps postings of stems on
disk, in buckets of the term, so that a search reads the buckets of its terms.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palimpsest.runtime import publish_text, read_text

K1, B, FLOOR = 1.2, 0.75, 1e-6
FIELDS = ("content", "sender", "recipient", "category", "modality")
TOKEN = r"[\p{L}\p{N}]+"
_PYTHON_TOKEN = re.compile(r"[^\W_]+")


def _folds() -> tuple[str, str]:
    """Accented Latin letters in lower case, and the letters that are left without their marks."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


FOLD_FROM, FOLD_TO = _folds()
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def folded(text: Column) -> Column:
    """Text in lower case, accents taken off; marks that stand by themselves are dropped."""
    return F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), r"[\u0300-\u036F]", "")


def fold(text: str) -> str:
    return re.sub(r"[\u0300-\u036F]", "", text.lower().translate(_FOLD))


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(pattern), F.lit(0))


def document_text(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.concat_ws(" ", *fields)


def query_terms(query: str) -> dict[str, int]:
    """Terms with their number in the query (a repeated term counts again)."""
    return dict(Counter(_PYTHON_TOKEN.findall(fold(query))))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.log((n - df + 0.5) / (df + 0.5)))


def _occurrences(word: str) -> Column:
    return F.size(F.filter("__t", lambda x: x == word))


def scan_search(docs: DataFrame, query: str, fields: tuple[str, ...] = FIELDS, keep: Column | None = None) -> DataFrame:
    """``docs`` with bm25 > 0 for the query. ``keep`` filters hits only: statistics stay corpus-wide."""
    terms = query_terms(query)
    t = docs.withColumn("__t", tokens(document_text(fields)))
    if not terms:
        return docs.withColumn("bm25", F.lit(0.0)).limit(0)
    tf = {w: _occurrences(w) for w in terms}
    stats = t.agg(F.count("*"), F.coalesce(F.avg(F.size("__t")), F.lit(1.0)), *(F.count_if(tf[w] > 0) for w in terms)).first()  # one row over the whole corpus
    hit = t.where(F.arrays_overlap("__t", F.array(*map(F.lit, terms))))
    if keep is not None:
        hit = hit.where(keep)
    score = F.lit(0.0)
    for i, (w, q) in enumerate(terms.items()):
        norm = tf[w] + K1 * (1 - B + B * F.size("__t") / F.lit(float(stats[1]) or 1.0))
        score = score + q * idf(F.lit(stats[0]), F.lit(stats[2 + i])) * tf[w] * (K1 + 1) / norm
    return hit.withColumn("bm25", score).select(*docs.columns, "bm25")


def best(scored: DataFrame, k: int, score: str = "bm25") -> DataFrame:
    """The k best rows; ties by the id as text."""
    return scored.orderBy(F.desc(score), F.col("id").cast("string")).limit(k)


def min_max(df: DataFrame, score: str, out: str, by: tuple[str, ...] = (), flat: float = 1.0) -> DataFrame:
    """Scores of a bounded pool scaled to [0, 1] (per group); ``flat`` where all are equal."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi == lo, F.lit(flat)).otherwise((F.col(score) - lo) / (hi - lo)))


Score = Callable[..., DataFrame]


def search(m: DataFrame, query: str, k: int, directives: bool = False, score: Score = scan_search) -> DataFrame:
    """Top k with score in [0, 1]: the best has 1; all equal have 1."""
    keep = None if directives else ~F.col("directive")
    return min_max(best(score(m, query, keep=keep), k), "bm25", "score")


def search_by_sender(m: DataFrame, query: str, sender: str, k: int) -> DataFrame:
    return min_max(best(scan_search(m, query, keep=~F.col("directive") & (F.col("sender") == sender)), k), "bm25", "score")


def search_in_range(m: DataFrame, query: str, after: str, before_exclusive: str, k: int, score: Score = scan_search) -> DataFrame:
    """Candidates clamp(10 k, 100, 1000), then the time filter, then scaling, then the trim to k."""
    pool = best(score(m, query, keep=~F.col("directive")), min(1000, max(100, 10 * k)))
    within = pool.where((F.col("ts") != "") & (F.col("ts") >= after) & (F.col("ts") < before_exclusive))
    return best(min_max(within, "bm25", "score"), k, "score")


def build_postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(postings(term, id, tf, positions), docstats(id, dl)); write postings bucketed and sorted by term."""
    t = docs.select("id", tokens(document_text(fields)).alias("t"))
    p = t.select("id", F.posexplode("t").alias("pos", "term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return p, t.select("id", F.size("t").alias("dl"))


def postings_search(postings: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(id, bm25) from the index: only the query's terms are read, then one shuffle by id."""
    terms = query_terms(query)
    hits = postings.where(F.col("term").isin(list(terms))).select("term", "id", "tf")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n, avg = stats.agg(F.count("*"), F.avg("dl")).first()  # one row
    q = F.create_map(*(F.lit(x) for kv in terms.items() for x in kv))
    joined = hits.join(F.broadcast(df), "term").join(stats, "id")  # df: a row for each query term
    part = q[F.col("term")] * idf(F.lit(n), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avg or 1)))) 
    return joined.groupBy("id").agg(F.sum(part).alias("bm25"))


def phrase_hits(postings: DataFrame, phrase: str) -> DataFrame:
    """(id, n): documents in which the words of a phrase stand next to each other."""
    return phrase_at(postings, _PYTHON_TOKEN.findall(fold(phrase)))


def phrase_at(postings: DataFrame, words: list[str]) -> DataFrame:
    """(id, n): documents in which the terms stand next to each other, by shifted positions."""
    at = postings.where(F.col("term").isin(sorted(set(words)))).select("id", "term", F.explode("positions").alias("p"))
    place = F.array(*map(F.lit, words))
    starts = at.select("id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda i: F.element_at(place, i + 1) == F.col("term"))).alias("i"), "p")
    return starts.groupBy("id", (F.col("p") - F.col("i")).alias("s")).agg(F.count("*").alias("c")).where(F.col("c") == len(words)).groupBy("id").agg(F.count("*").alias("n"))


@F.pandas_udf(ArrayType(StringType()))
def stemmed(words):  # noqa: ANN001, ANN201
    """Porter stems of token arrays."""
    from palimpsest.functions.stemmer import stem

    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


class Index:
    """Postings of stems under ``path``: (term, id, tf, positions) and (id, dl), in BUCKETS folders by term and by id.

    Made once for a table of documents by ``build``; ``search`` takes the place of ``scan_search``. A
    token with inner marks (don't) counts as an adjacent phrase of its words.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        text = read_text(spark, os.path.join(path, "STATS"))
        self.stats = json.loads(text) if text else None

    def build(self, docs: DataFrame) -> Index:
        from palimpsest.functions.stemmer import stem  # noqa: F401  shipped to the workers

        t = docs.select("id", stemmed(tokens(document_text())).alias("t"))
        p = t.select("id", F.posexplode("t").alias("pos", "term")).groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(self.BUCKETS)).cast("int")
        p.withColumn("bucket", bucket("term")).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(self.path, "postings"))
        sizes = t.select("id", F.size("t").alias("dl"))
        sizes.write.mode("overwrite").parquet(os.path.join(self.path, "sizes"))
        n, avg = self._sizes().agg(F.count("*"), F.avg("dl")).first()
        self.stats = {"n": n, "avg": avg or 1.0}
        publish_text(self.spark, os.path.join(self.path, "STATS"), json.dumps(self.stats))
        return self

    def _sizes(self) -> DataFrame:
        return self.spark.read.schema("id bigint, dl int").parquet(os.path.join(self.path, "sizes"))

    def _postings(self, terms: list[str]) -> DataFrame:
        rows = self.spark.read.schema("term string, id bigint, tf int, positions array<int>, bucket int").parquet(os.path.join(self.path, "postings"))
        own = self.spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(self.BUCKETS)).cast("int") for t in terms)))).distinct()
        return rows.where(F.col("bucket").isin([r[0] for r in own.collect()]) & F.col("term").isin(terms))  # a folder for each term at most

    def hits(self, query: str) -> DataFrame:
        """(id, bm25) of all documents with a term or phrase of the query."""
        from palimpsest.functions.stemmer import stem

        units = Counter(tuple(stem(w) for w in _PYTHON_TOKEN.findall(fold(x))) for x in query.split())
        units.pop((), None)
        if not units or self.stats is None:
            return self.spark.createDataFrame([], "id bigint, bm25 double")
        rows = self._postings(sorted({t for u in units for t in u}))
        every = None
        for u, q in units.items():
            one = rows.where(F.col("term") == u[0]).select("id", "tf") if len(u) == 1 else phrase_at(rows, list(u)).select("id", F.col("n").cast("int").alias("tf"))
            one = one.select("id", "tf", F.lit(" ".join(u)).alias("unit"), F.lit(q).alias("q"))
            every = one if every is None else every.unionByName(one)
        df = every.groupBy("unit").agg(F.count("*").alias("df"))
        joined = every.join(F.broadcast(df), "unit").join(self._sizes(), "id")  # df: a row for each word of the query
        tf = F.col("tf")
        part = F.col("q") * idf(F.lit(self.stats["n"]), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(self.stats["avg"]))))
        return joined.groupBy("id").agg(F.sum(part).alias("bm25"))

    def search(self, docs: DataFrame, query: str, keep: Column | None = None) -> DataFrame:
        """``docs`` with bm25, like ``scan_search``."""
        found = docs.join(self.hits(query), "id")
        return (found if keep is None else found.where(keep)).select(*docs.columns, "bm25")
