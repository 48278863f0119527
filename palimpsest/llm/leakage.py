"""Held-out test texts found inside a training corpus, by runs of shared words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import words
from palimpsest.runtime import store

#: Tests are broadcast in rounds of so many words (about 300 bytes each in a worker), in pieces of so many words.
RUN, BROADCAST_WORDS, PIECE = 10, 500_000, 5_000
SPANS = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint"
_WORD = re.compile(r"[^\W_]+")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``words(text)`` begin and end in the text itself; some letters are several in lower case."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    at = [k for k, c in enumerate(text) for _ in c.lower()]
    return [(at[a], at[b - 1] + 1) for a, b in spans]


def _index(items: list[tuple[int, str]], n: int) -> tuple[dict, dict]:
    """Word numbers, and the items of each n-gram of word numbers."""
    number: dict[str, int] = {}
    grams: dict[tuple, set] = {}
    for item, text in items:
        ids = [number.setdefault(w, len(number)) for w in words(text)]
        for i in range(len(ids) - n + 1):
            grams.setdefault(tuple(ids[i : i + n]), set()).add(item)
    return number, grams


def _scanner(bc, n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, grams = bc.value
        get = number.get
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                ids = list(map(get, words(text)))
                hits: dict[int, list[int]] = {}
                start = 0
                while start + n <= len(ids):
                    # a window with a word that no test has can't match; go on behind its last such word
                    end = start + n - 1
                    while end >= start and ids[end] is not None:
                        end -= 1
                    if end >= start:
                        start = end + 1
                        continue
                    for item in grams.get(tuple(ids[start : start + n]), ()):
                        hits.setdefault(item, []).append(start)
                    start += 1
                for item, at in hits.items():
                    run = at[0]
                    for x, y in zip(at, [*at[1:], None]):
                        if y is None or y > x + n:
                            out.append((doc, item, run, x + n - run))
                            run = y
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "first_word", "n_words"])

    return scan


def _pieces(n: int):
    """Tests cut into pieces of PIECE words, each reaching n - 1 words into the next, so no n-gram is lost."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                out += [(item, at // PIECE, len(ws[at : at + PIECE + n - 1]), " ".join(ws[at : at + PIECE + n - 1])) for at in range(0, max(1, len(ws)), PIECE)]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["item_id", "piece", "n", "text"])

    return cut


def find_leaks(documents: DataFrame, items: DataFrame, n: int = RUN, most: int = BROADCAST_WORDS) -> DataFrame:
    """Word spans of documents that share at least ``n`` consecutive words with a test item.

    ``documents`` has (doc_id, text), ``items`` (item_id, item_text); other columns are ignored.
    Gives (doc_id, item_id, first_word, n_words), spans of one item merged where they touch.
    Null or short texts match nothing; either side may be empty; repeated rows repeat nothing
    but their own spans. Tests are broadcast in rounds of about ``most`` words, each of which
    scans the documents once; one round holds them all unless there are more words.
    """
    spark = documents.sparkSession
    tests = items.select(F.col("item_id").cast("bigint"), "item_text").where("item_id is not null and item_text is not null")
    pieces = store(tests.mapInArrow(_pieces(n), "item_id bigint, piece int, n int, text string"))
    size = pieces.agg(F.sum("n")).first()[0] or 0
    rounds, out = max(1, -(-size // most)), None
    docs = documents.select(F.col("doc_id").cast("bigint"), "text")
    for k in range(rounds):
        own = pieces if rounds == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(rounds)) == k)
        index = _index([tuple(r) for r in own.select("item_id", "text").collect()], n)  # about ``most`` words
        found = docs.mapInArrow(_scanner(spark.sparkContext.broadcast(index), n), SPANS)
        out = found if out is None else out.unionByName(found)
    return out if rounds == 1 else _merged(out)


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of several rounds: those of one document and item that touch become one."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "item_id").orderBy("first_word", "n_words")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("first_word") + F.col("n_words")
    new = F.coalesce((F.col("first_word") > F.max(end).over(before)).cast("int"), F.lit(1))
    return (
        spans.distinct().withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("doc_id", "item_id", "run")
        .agg(F.min("first_word").alias("first_word"), (F.max(end) - F.min("first_word")).alias("n_words")).drop("run")
    )


def leaked_documents(documents: DataFrame, items: DataFrame, n: int = RUN) -> DataFrame:
    """Distinct (doc_id, item_id) with at least ``n`` consecutive words in common."""
    return find_leaks(documents, items, n).select("doc_id", "item_id").distinct()


def remove_leaks(documents: DataFrame, leaks: DataFrame, whole: bool = False) -> DataFrame:
    """Documents without leaked spans, or without the leaked documents (``whole``). Columns stay as they are."""
    if whole:
        return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
    spans = leaks.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "n_words")).alias("__spans"))  # spans of one document

    @F.pandas_udf("string")
    def without(text, spans):  # noqa: ANN001, ANN202
        def one(t, ss):  # noqa: ANN001, ANN202
            if ss is None or t is None or len(ss) == 0:
                return t
            at = word_spans(t)
            drop = sorted((at[s["first_word"]][0], at[min(s["first_word"] + s["n_words"], len(at)) - 1][1]) for s in ss if s["first_word"] < len(at))
            out, pos = [], 0
            for a, b in drop:
                out.append(t[pos:a] if a > pos else "")
                pos = max(pos, b)
            return "".join(out) + t[pos:]

        import pandas as pd

        return pd.Series([one(t, s) for t, s in zip(text, spans)])

    return documents.join(spans, "doc_id", "left").withColumn("text", without("text", "__spans")).drop("__spans")
