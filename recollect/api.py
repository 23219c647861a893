"""Tool-style functions over a store: the limits and checks of each call, then one DataFrame program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import context, facts, maintenance
from recollect.plans.search import SearchRequest, recall, search
from recollect.sources.frames import Store, StoreError, stats

# Limits of the calls.
MOST_SEARCH, MOST_RECALL, MOST_GRAPH = 200, 100, 500


class Memory:
    """Remember, search and recall over tables of frames (frame_id, content, metadata, ..) and vectors.

    Writes are DataFrames of mutations that :class:`Store` commits; reads are lazy.
    """

    def __init__(self, spark: SparkSession, frames: DataFrame, vectors: DataFrame | None = None, store: Store | None = None):
        self.spark, self.frames, self.vectors, self.store = spark, frames, vectors, store
        self.session: int | None = None

    # ------------------------------------------------------------- reading
    def _scoped(self, session_id: int | None) -> DataFrame:
        wanted = session_id if session_id is not None else self.session
        return self.frames if wanted is None else self.frames.filter(F.col("metadata")["session_id"] == str(wanted))

    def search(self, questions: DataFrame, *, mode: str = "hybrid", top_k: int = 10, session_id: int | None = None, **settings) -> DataFrame:
        """Raw results; hybrid without embeddings is a text search."""
        if not 0 <= top_k <= MOST_SEARCH:
            raise StoreError(f"top_k must be within 0..{MOST_SEARCH}")
        if mode == "hybrid" and "embedding" not in questions.columns:
            mode = "text"
        return search(self._scoped(session_id), self.vectors, questions, SearchRequest(mode=mode, top_k=top_k, **settings))

    def recall(self, questions: DataFrame, *, limit: int = 24, session_id: int | None = None, **budget) -> DataFrame:
        """Context items within the budget."""
        if not 0 <= limit <= MOST_RECALL:
            raise StoreError(f"limit must be within 0..{MOST_RECALL}")
        return recall(self._scoped(session_id), self.vectors, questions, SearchRequest(top_k=limit), **budget)

    def stats(self) -> DataFrame:
        return stats(self.frames)

    def session_stats(self, session_id: int) -> DataFrame:
        return maintenance.session_stats(self._scoped(session_id).select(F.lit(session_id).alias("session_id"), "content"))

    # ------------------------------------------------------------- writing
    def remember(self, documents: DataFrame, *, base: int = 0, **windows) -> DataFrame:
        """Frames of documents (doc_id, content) and their chunks, to be committed."""
        made = context.remembered(documents.filter(F.regexp_replace("content", r"\s+", "") != ""), base, **windows)
        tag = F.create_map(F.lit("session_id"), F.lit(str(self.session))) if self.session is not None else F.create_map().cast("map<string,string>")
        return made.withColumn("metadata", tag)

    def flush(self, mutations: DataFrame) -> int:
        """Commit mutations as a new generation; its number."""
        if self.store is None:
            raise StoreError("this memory has no store")
        return self.store.commit(mutations)

    def start_session(self, session_id: int) -> None:
        self.session = session_id

    def end_session(self) -> None:
        self.session = None

    def handoff(self, session_id: int, content: str, project: str | None = None) -> DataFrame:
        """A handoff frame."""
        if not content.strip():
            raise StoreError("a handoff must not be empty")
        return self.spark.createDataFrame([("handoff", content, {"session_id": str(session_id)} | ({"project": project} if project else {}))], "kind string, content string, metadata map<string,string>")

    def latest_handoff(self, project: str | None = None) -> DataFrame:
        rows = self.frames.filter(context.is_handoff())
        if project is not None:
            rows = rows.filter(F.col("metadata")["project"] == project)
        return rows.orderBy(F.desc("ts_ms"), F.desc("frame_id")).limit(1)

    # --------------------------------------------------------------- facts
    @staticmethod
    def entity_upsert(known: DataFrame, new: DataFrame) -> DataFrame:
        bad = new.filter(~facts.valid_identifier(F.col("key"))).limit(1).count()
        if bad:
            raise StoreError("keys must have the form <namespace>:<id>")
        return facts.upsert_entities(known, new)

    @staticmethod
    def facts_query(f: DataFrame, spans: DataFrame, entities: DataFrame, predicates: DataFrame, *, limit: int = 50, **at) -> DataFrame:
        if not 0 < limit <= MOST_GRAPH:
            raise StoreError(f"limit must be within 1..{MOST_GRAPH}")
        return facts.ordered_facts(facts.facts_about(f, spans, entities, predicates, **at), limit)

    entity_resolve = staticmethod(facts.resolve)
    fact_assert = staticmethod(facts.assert_facts)
    fact_retract = staticmethod(facts.retract)
