"""The store behind the operators: messages in versioned Parquet with add, get, update, delete and search.

A write makes a new version of the message table by adding a folder of rows; ``CURRENT`` names
the folders that are live and is replaced by one rename. Within a version the newest row of an id holds; a
deleted id has a row that says so. ``compact`` folds all folders into one. Derived tables (vectors,
fact chains, surprise, clusters, summaries) are kept beside the messages and lose the rows of what is
deleted. ``index`` makes postings, from which searches of that version read their words only.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import keyword_search as kw, relational as rel, salience as sal, search, vector_search as vs
from palimpsest.runtime import delete, publish_text, read_text
from palimpsest.sources.messages import MESSAGE, messages_view
from palimpsest.streaming.streams import RecallCache

MAX_CONTENT, MAX_METADATA, MAX_QUERY, MAX_LIMIT = 50_000, 10_000, 2_000, 200
#: Derived tables with the column that holds a message's id.
DERIVED = {"vectors": "id", "separation": "id", "timeline": "id", "landmarks": "id", "surprise": "message_id", "clusters": "id"}
Embedder = Callable[[list[str]], list[list[float]]]


class Memory:
    """``embed`` turns texts into vectors of one length; ``model`` names it, and vectors of another model or length are refused."""

    def __init__(self, spark: SparkSession, path: str, embed: Embedder | None = None, model: str = ""):
        self.spark, self.path, self.embed, self.model = spark, path, embed, model
        self.cache = RecallCache()

    def _at(self, *names: str) -> str:
        return os.path.join(self.path, *names)

    def _state(self) -> dict:
        text = read_text(self.spark, self._at("CURRENT"))
        return json.loads(text) if text else {"rows": [], "derived": {}, "index": None}

    def _publish(self, state: dict) -> None:
        before = self._state()
        publish_text(self.spark, self._at("CURRENT"), json.dumps(state))
        for gone in {*before["rows"], *before["derived"].values()} - {*state["rows"], *state["derived"].values()}:
            delete(self.spark, self._at(gone))

    def _write(self, rows: DataFrame, replace: bool = False) -> None:
        name, state = f"rows-{uuid.uuid4().hex}", self._state()
        rows.withColumn("version", F.lit(0 if replace else len(state["rows"])).cast("int")).write.parquet(self._at(name))
        self._publish(state | {"rows": [name] if replace else [*state["rows"], name], "index": None})

    def derived(self, name: str) -> DataFrame | None:
        """A derived table, None if it was never stored."""
        folder = self._state()["derived"].get(name)
        return None if folder is None else self.spark.read.parquet(self._at(folder))

    def store_derived(self, name: str, rows: DataFrame) -> None:
        folder, state = f"{name}-{uuid.uuid4().hex}", self._state()
        rows.write.parquet(self._at(folder))
        self._publish(state | {"derived": state["derived"] | {name: folder}})

    def messages(self) -> DataFrame:
        """The live message view."""
        parts = [self._at(f) for f in self._state()["rows"]]
        schema = f"{MESSAGE}, deleted boolean, version int"
        if not parts:
            return self.spark.createDataFrame([], MESSAGE)
        rows = self.spark.read.schema(schema).parquet(*parts)
        if len(parts) > 1:  # the newest row of each id; one folder holds each id once
            rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))).where("r = 1").drop("r")
        return rows.where("not deleted").drop("version", "deleted")

    def load(self, raw: DataFrame) -> None:
        """Replace everything by ``raw`` (id and content needed); blank contents are left out."""
        self._write(messages_view(raw).where(F.trim("content") != "").withColumn("deleted", F.lit(False)), replace=True)

    def add_all(self, raw: DataFrame) -> None:
        """Append rows; ids that exist are replaced."""
        self._write(messages_view(raw).where(F.trim("content") != "").withColumn("deleted", F.lit(False)))

    def add(self, content: str, sender: str = "", recipient: str = "", timestamp: str = "", category: str = "", modality: str = "", directive: bool = False, metadata: dict | None = None) -> int | None:
        """Store one message and give its id; blank text is skipped, an equal directive is not stored twice."""
        if not content.strip():
            return None
        text = json.dumps(metadata or {}, sort_keys=True, separators=(",", ":"))
        if len(content) > MAX_CONTENT or len(text) > MAX_METADATA:
            raise ValueError("content or metadata is too long")
        m = self.messages()
        if directive and (same := m.where(F.col("directive") & (F.col("content") == content)).select("id").first()):
            return same["id"]
        new = (m.agg(F.max("id")).first()[0] or 0) + 1
        row = Row(id=new, content=content, sender=sender, recipient=recipient, ts=timestamp, category=category, modality=modality, directive=directive, metadata=text, deleted=False)
        self._write(self.spark.createDataFrame([row], f"{MESSAGE}, deleted boolean"))
        return new

    def get(self, id: int) -> Row | None:
        return self.messages().where(F.col("id") == id).first()

    def get_all(self, limit: int = MAX_LIMIT, offset: int = 0) -> DataFrame:
        return self.messages().orderBy(F.desc("id")).offset(offset).limit(max(1, min(MAX_LIMIT, limit)))

    def update(self, id: int, content: str) -> bool:
        row = self.get(id)
        if row is None or not content.strip():
            return False
        self._write(self.spark.createDataFrame([Row(**(row.asDict() | {"content": content, "deleted": False}))], f"{MESSAGE}, deleted boolean"))
        return True

    def _forget(self, gone: DataFrame) -> int:
        """Delete messages with everything that was derived from them."""
        n = gone.count()
        if not n:
            return 0
        ids = self.messages().join(gone.select("id"), "id", "left_semi").select("id", "sender", "recipient")
        ids = self.spark.createDataFrame(ids.collect(), ids.schema) if n <= 10_000 else ids.checkpoint()  # the view changes with the next write
        self._write(gone.withColumn("deleted", F.lit(True)))
        for name, column in DERIVED.items():
            if (rows := self.derived(name)) is not None:
                self.store_derived(name, rel.forget(rows, column, ids.select("id")))
        if (rows := self.derived("summaries")) is not None and "message_ids" in rows.columns:
            self.store_derived("summaries", rel.forget_summaries(rows, ids.select("id")))
        if (rows := self.derived("profiles")) is not None:  # derived from all messages of the people involved
            people = ids.select(F.explode(F.array(F.lower("sender"), F.lower("recipient"))).alias("entity")).distinct()
            self.store_derived("profiles", rows.join(people, "entity", "left_anti"))
        return n

    def delete(self, ids: list[int]) -> int:
        """Forget messages by id with all derived rows; gives how many there were."""
        return self._forget(self.messages().where(F.col("id").isin(ids)))

    def delete_sender(self, sender: str) -> int:
        return self._forget(self.messages().where(F.lower("sender") == sender.lower()))

    def delete_all(self) -> None:
        """Forget everything."""
        state = self._state()
        self._publish({"rows": [], "derived": {}, "index": None})
        if state["index"]:
            delete(self.spark, self._at(state["index"]))

    def compact(self) -> None:
        self._write(self.messages().withColumn("deleted", F.lit(False)), replace=True)

    def stats(self) -> Row:
        return self.messages().agg(F.count("*").alias("messages"), F.count_if("directive").alias("directives"), F.count_distinct("sender").alias("senders"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).first()

    def directives(self, limit: int = 50) -> DataFrame:
        return self.messages().where("directive").orderBy(F.desc("id")).limit(limit)

    def index(self) -> None:
        """Make postings of the present version; later searches of it read them instead of all texts."""
        name, state = f"index-{uuid.uuid4().hex}", self._state()
        kw.Index(self.spark, self._at(name)).build(self.messages())
        if state["index"]:
            delete(self.spark, self._at(state["index"]))
        self._publish(state | {"index": name})

    def _score(self) -> kw.Score:
        name = self._state()["index"]
        return kw.Index(self.spark, self._at(name)).search if name else kw.scan_search

    def _embedded(self, rows: DataFrame, text: str) -> DataFrame:
        """(id, vec, model) of rows by the embedder, normalised; empty and non-finite vectors are left out."""
        embed, model = self.embed, self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vecs = embed(b.column(1).to_pylist()) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(float, v)) for v in vecs], pa.list_(pa.float64())), pa.array([model] * b.num_rows)], ["id", "vec", "model"])

        return vs.normalised(rows.select("id", text).mapInArrow(run, "id bigint, vec array<double>, model string"), "vec")

    def build_vectors(self) -> None:
        """Embed the messages that have no vector yet, and their separation texts; a stored run of another model is refused."""
        if self.embed is None:
            raise ValueError("no embedder")
        m = self.messages()
        for name, text in (("vectors", F.col("content")), ("separation", vs.separation_text())):
            have = self.derived(name)
            self._guard(have)
            rows = m.withColumn("__text", text)
            new = self._embedded(rows if have is None else rows.join(have.select("id"), "id", "left_anti"), "__text")
            self.store_derived(name, new if have is None else have.unionByName(new))

    def _guard(self, have: DataFrame | None) -> None:
        first = None if have is None else have.select("model", F.size("vec").alias("dim")).first()
        if first is None or self.embed is None:
            return
        dim = len(self.embed(["x"])[0])
        if (first["model"], first["dim"]) != (self.model, dim):
            raise ValueError(f"stored vectors are of {first['model']!r} with {first['dim']} numbers, the embedder is {self.model!r} with {dim}")

    def embed_single(self, id: int) -> bool:
        """Embed one message that was added after ``build_vectors``."""
        have, row = self.derived("vectors"), self.get(id)
        if self.embed is None or row is None:
            return False
        self._guard(have)
        new = self._embedded(self.spark.createDataFrame([(id, row["content"])], "id bigint, content string"), "content")
        self.store_derived("vectors", new if have is None else have.where(F.col("id") != id).unionByName(new))
        return True

    def _options(self, query: str, options: dict) -> dict:
        """Stored vectors, chains and summaries, unless the caller brings their own."""
        out = {"score": self._score()} | options
        if self.embed is not None and "vector" not in options and (v := self.derived("vectors")) is not None:
            self._guard(v)
            out |= {"vectors": v.select("id", "vec"), "vector": list(self.embed([query])[0])}
            if (s := self.derived("separation")) is not None:
                out["separation"] = s.select("id", "vec")
        for name, key in (("timeline", "chain"), ("summaries", "summaries"), ("surprise", "surprise")):
            if key not in options and (rows := self.derived(name)) is not None:
                out[key] = rows
        return out

    def search(self, query: str, limit: int = 10, sender: str | None = None, **options) -> DataFrame:  # noqa: ANN003
        """Ranked memories; with ``sender`` three times as many are ranked before the filter. A query above MAX_QUERY characters is refused."""
        if len(query) > MAX_QUERY:
            raise ValueError("the query is too long")
        limit = max(1, min(MAX_LIMIT, limit))
        key, version, now = (query, limit, sender), json.dumps(self._state(), sort_keys=True), time.time()
        if not options and (held := self.cache.get(key, version, now)) is not None:
            return held
        rows = search.pipeline(self.messages(), query, 3 * limit if sender else limit, **self._options(query, options))
        rows = search.settled(rows.where(F.col("sender") == sender).limit(limit) if sender else rows)
        if not options:
            self.cache.put(key, version, now, rows)
        return rows

    def search_vectors(self, query: str, limit: int = 10) -> DataFrame:
        """(id, content, sender, ts, score) of the nearest messages without directives; empty without an embedder."""
        v = self.derived("vectors")
        if self.embed is None or v is None:
            return self.messages().select("id", "content", "sender", "ts", F.lit(0.0).alias("score")).limit(0)
        self._guard(v)
        m = self.messages().where("not directive")
        near = vs.nearest(v.join(m.select("id"), "id", "left_semi"), list(self.embed([query])[0]), max(1, min(MAX_LIMIT, limit)))
        return m.join(F.broadcast(near), "id").select("id", "content", "sender", "ts", vs.distance_score(F.col("cosine")).alias("score")).orderBy(F.desc("score"), F.col("id").cast("string"))

    def search_simple(self, query: str, limit: int = 10) -> DataFrame:
        return kw.search(self.messages(), query, max(1, min(MAX_LIMIT, limit)), score=self._score())

    def search_deep(self, query: str, limit: int = 10, **options) -> DataFrame:  # noqa: ANN003
        """The multi-round search; surprise is computed once for a version and stored."""
        if len(query) > MAX_QUERY:
            raise ValueError("the query is too long")
        if "surprise" not in options and self.derived("surprise") is None:
            self.store_derived("surprise", sal.surprise_index(self.messages()))
        return search.multi_round(self.messages(), query, max(1, min(MAX_LIMIT, limit)), **self._options(query, options))

    def recall(self, sender: str | None = None, limit: int = 25, tag: str = "memory") -> str:
        """The context block for a new session: directives, newest first and up to half of the rows, then the best rows of RECALL_QUERIES."""
        from palimpsest.operators.ingest import context_block

        every = self.directives(max(1, limit // 2)).withColumn("score", F.lit(2.0)).select("id", "content", "sender", "ts", "score")
        quota = max(1, limit // len(RECALL_QUERIES))
        for q in RECALL_QUERIES:
            rows = self.search(q, 3 * quota, sender).orderBy(F.desc("score"), F.col("id").cast("string")).limit(quota)
            every = every.unionByName(rows.select("id", "content", "sender", "ts", "score"))
        once = every.groupBy("id").agg(F.max_by(F.struct("content", "sender", "ts", "score"), "score").alias("r")).select("id", "r.*").dropDuplicates(["content"])
        row = context_block(once, "context", tag).first()
        return row["block"] if row else ""


#: What a new session asks its memory.
RECALL_QUERIES = ("user preferences and favorites", "personal facts name job location", "recent decisions and commitments", "current projects and work", "corrections and changes")
