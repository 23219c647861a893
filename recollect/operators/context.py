"""Chunks, budgets, surrogates and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scores
from recollect.functions.tokens import BytePairs
from recollect.functions.text import once, segments, sentences, terms
from recollect.session import spread

TARGET_TOKENS, OVERLAP_TOKENS = 400, 40
# Budgets of a context.
CONTEXT_TOKENS, EXPANSION_TOKENS, EXPANSION_BYTES = 1500, 600, 2 * 1024 * 1024
SNIPPET_TOKENS, MOST_SNIPPETS, SURROGATE_TOKENS, MOST_SURROGATES = 200, 24, 60, 8
# Sentences and tokens of the surrogate tiers.
TIERS = {"full": (8, 100, "\n"), "gist": (3, 25, " "), "micro": (1, 8, " ")}
#: Pieces that a byte-pair tokenizer starts from; their count stands for its tokens where no vocabulary is at hand.
PIECE = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def token_count(text: Column, vocabulary: BytePairs | None = None) -> Column:
    return F.size(pieces(text)) if vocabulary is None else vocabulary.count(text)


def truncated(text: Column, most: int | Column, vocabulary: BytePairs | None = None) -> Column:
    """The first tokens of a text."""
    if vocabulary is not None:
        return vocabulary.truncated(text, most)
    limit = F.lit(most) if isinstance(most, int) else most
    # A token has one character at least, so a short text needs no count; in the lambda the pieces are found once.
    cut = F.get(F.transform(F.array(pieces(text)), lambda p: F.when(F.size(p) <= limit, text).otherwise(F.array_join(F.slice(p, F.lit(1), limit), ""))), F.lit(0))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def window_step(target: int, overlap: int) -> int:
    return target - overlap if 0 < overlap < target else target


def window_starts(n: Column, target: int, overlap: int) -> Column:
    """Zero-based starts of windows over n tokens; with an overlap that would stall, windows don't overlap."""
    step = window_step(target, overlap)
    last = F.greatest(F.lit(0), F.ceil((n - target) / F.lit(step)).cast("int")) * step
    return F.sequence(F.lit(0), last, F.lit(step))


def chunks(texts: DataFrame, *, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, vocabulary: BytePairs | None = None) -> DataFrame:
    """doc_id, chunk, content, tokens: a text that fits is one chunk; blank chunks are left out.

    Windows are over the tokens of a vocabulary, or else over the pieces that a byte-pair tokenizer starts from.
    """
    if vocabulary is not None:
        out = vocabulary.windows(texts, target, window_step(target, overlap))
    else:
        cut = texts.filter(F.col("content").isNotNull()).select("doc_id", "content", pieces(F.col("content")).alias("p"))
        each = cut.select("doc_id", "content", F.size("p").alias("n"), "p", F.posexplode(window_starts(F.size("p"), target, overlap)).alias("chunk", "start"))
        each = each.select("doc_id", "chunk", "content", "n", F.slice("p", F.col("start") + 1, target).alias("own"))
        out = each.select("doc_id", "chunk", F.when(F.col("n") <= target, F.col("content")).otherwise(F.array_join("own", "")).alias("content"), F.size("own").alias("tokens"))
    return out.filter(F.regexp_replace("content", r"\s+", "") != "")


def remembered(documents: DataFrame, base: int = 0, **windows) -> DataFrame:
    """frame rows of documents (doc_id, content) and their chunks; only chunks carry text for the index."""
    from recollect.sources.frames import numbered

    cut = chunks(documents, **windows).withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    rows = documents.select("doc_id", F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("chunks"), F.lit(None).cast("string").alias("search_text"), F.lit("document").alias("role")).unionByName(cut.select("doc_id", "chunk", "chunks", F.col("content").alias("search_text"), F.lit("chunk").alias("role")))
    return numbered(rows, base, "doc_id", "chunk")


# ---------------------------------------------------------------- budgets
def prefix_budget(items: DataFrame, budget: int, *, by: str = "query_id", order: str = "position") -> DataFrame:
    """Items up to the first that would overflow the budget (costs aren't negative)."""
    running = F.sum("tokens").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("used", running).filter(F.col("used") <= budget)


def greedy_budget(items: DataFrame, budget: int, most: int, *, by: str = "query_id", order: str = "position") -> DataFrame:
    """Items in order, each only if it fits what is left; those that don't are skipped.

    All candidates of a query are one list, folded in one expression.
    """
    listed = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("position"), "frame_id", "tokens"))).alias("items"))
    kind = "struct<left:bigint,taken:array<struct<position:bigint,frame_id:bigint,tokens:bigint>>>"
    start = F.from_json(F.lit(f'{{"left":{budget},"taken":[]}}'), kind)

    def step(acc: Column, x: Column) -> Column:
        fits = (x["tokens"] <= acc["left"]) & (F.size(acc["taken"]) < most)
        item = F.struct(x["position"].cast("bigint").alias("position"), x["frame_id"].cast("bigint").alias("frame_id"), x["tokens"].cast("bigint").alias("tokens"))
        return F.when(fits, F.struct((acc["left"] - x["tokens"]).cast("bigint").alias("left"), F.concat(acc["taken"], F.array(item)).alias("taken"))).otherwise(acc)

    return listed.select(by, F.explode(F.aggregate("items", start, step)["taken"]).alias("item")).select(by, "item.*")


# -------------------------------------------------------------- surrogates
def micro_surrogate(texts: DataFrame) -> DataFrame:
    """doc_id, micro, score: the sentence that says most, cut to the micro tier's tokens; the first of equals (to nine digits); the highest
    score as it is.  Both are null where a text has no sentence."""
    seen = F.transform(segments(F.col("content")), lambda s: F.struct(s.alias("text"), scores.long_words(s).alias("words")))
    scored = F.transform(seen, lambda s: F.struct(s["text"].alias("text"), scores.salience(s["text"], s["words"]).alias("score")))
    best = once(scored, lambda all_: F.struct(F.array_max(F.transform(all_, lambda s, i: F.struct(F.round(s["score"], 9).alias("near"), (-i).alias("back"), s["text"].alias("text"))))["text"].alias("text"), F.array_max(F.transform(all_, lambda s: s["score"])).alias("score")))
    return texts.filter(F.col("content").isNotNull()).select("doc_id", best.alias("best")).select("doc_id", truncated(F.col("best.text"), TIERS["micro"][1]).alias("micro"), F.col("best.score").alias("score"))


def surrogate_tiers(texts: DataFrame) -> DataFrame:
    """doc_id, full, gist, micro by maximal marginal relevance over a text's sentences.

    Sentences and scores come from column expressions; the greedy choice runs in Arrow batches, one document
    at a time.  Equal sentences count once, at their first place.
    """
    cut = F.transform(F.array_distinct(segments(F.coalesce("content", F.lit("")))), lambda s: F.struct(s.alias("text"), scores.long_words(s).alias("words")))
    ready = spread(texts.select("doc_id", "content")).select("doc_id", cut.alias("seen"))
    ready = ready.select("doc_id", F.transform("seen", lambda s: F.struct(s["text"].alias("text"), F.array_distinct(s["words"]).alias("tokens"), scores.salience(s["text"], s["words"]).alias("score"))).alias("sentences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [choose(s.as_py() or []) for s in batch.column(1)]  # one document is unpacked at a time
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in zip(*rows, strict=True)]], names=["doc_id", *TIERS])

    out = ready.mapInArrow(run, "doc_id long, full string, gist string, micro string")
    return out.select("doc_id", *[truncated(F.col(k), v[1]).alias(k) for k, v in TIERS.items()])


def choose(sentences: list[dict]) -> list[str]:
    """The tiers of a list of sentences."""
    most = max(n for n, _, _ in TIERS.values())
    sets = [set(s["tokens"]) for s in sentences]
    left, taken = list(range(len(sentences))), []
    nearest = [0.0] * len(sentences)  # similarity to the closest one taken
    while left and len(taken) < most:
        best = max(left, key=lambda i: (sentences[i]["score"] * (1 - nearest[i]), sentences[i]["score"], -i))
        left.remove(best)
        taken.append(best)
        for i in left:
            common = len(sets[i] & sets[best])
            if common:
                nearest[i] = max(nearest[i], common / (len(sets[i]) + len(sets[best]) - common))
    return [joint.join(sentences[i]["text"] for i in sorted(taken[:n])) for n, _, joint in TIERS.values()]


def decoded_tiers(payload: Column) -> Column:
    """Tiers from JSON; any other text is the full tier of itself."""
    kind = "full string, gist string, micro string, version int"
    parsed = F.from_json(payload, kind, {"mode": "PERMISSIVE"})
    whole = F.struct(payload.alias("full"), payload.alias("gist"), payload.alias("micro"), F.lit(0).alias("version"))
    return F.when(parsed["full"].isNotNull(), parsed).otherwise(whole)


def outdated(frames: DataFrame, made: DataFrame, *, algorithm: str = "extractive", version: int = 1, most: int | None = None) -> DataFrame:
    """Live chunks whose surrogate is missing or was made from other text, or by another algorithm.

    ``made`` has frame_id, source_hash, algorithm and version.
    """
    wanted = frames.filter("status = 'active' AND superseded_by IS NULL AND role = 'chunk'").filter(F.coalesce(F.col("kind"), F.lit("")) != "surrogate")
    wanted = wanted.filter(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", "") != "").select("frame_id", F.sha2("content", 256).alias("hash"))
    state = wanted.join(made, "frame_id", "left")
    fresh = (F.col("source_hash") == F.col("hash")) & (F.col("algorithm") == algorithm) & (F.col("version") == version)
    todo = state.filter(~F.coalesce(fresh, F.lit(False))).select("frame_id", F.when(F.col("source_hash").isNull(), "missing").otherwise("changed").alias("reason"))
    return todo.orderBy("frame_id").limit(most) if most is not None else todo


# ----------------------------------------------------------------- context
def expansion(ranked: DataFrame, contents: DataFrame, vocabulary: BytePairs | None = None) -> DataFrame:
    """query_id, frame_id, text, tokens: of each query the first result with text that isn't too large, cut to its tokens."""
    held = ranked.join(contents, "frame_id").filter((F.coalesce("content", F.lit("")) != "") & (F.octet_length("content") <= EXPANSION_BYTES))
    first = held.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter("n = 1")
    return first.select("query_id", "frame_id", "score", truncated(F.col("content"), EXPANSION_TOKENS, vocabulary).alias("text")).withColumn("tokens", token_count(F.col("text"), vocabulary).cast("long"))


def assemble(ranked: DataFrame, contents: DataFrame, *, surrogates: DataFrame | None = None, budget: int = CONTEXT_TOKENS, vocabulary: BytePairs | None = None) -> DataFrame:
    """query_id, item, kind, frame_id, score, text, tokens: expansion, then surrogates (frame_id, text), then snippets.

    ``ranked`` has query_id, frame_id, position, score and preview, and may have query.  Surrogates are only used if
    given (dense mode); a frame appears once.  A question for a date, place or owner gets whole texts in place of
    snippets, within their tokens.
    """
    first = expansion(ranked, contents, vocabulary)
    rest = ranked.join(first.select("query_id", "frame_id"), ["query_id", "frame_id"], "left_anti")
    options = []
    if surrogates is not None:
        dense = rest.join(surrogates, "frame_id").withColumn("text", truncated(F.col("text"), SURROGATE_TOKENS, vocabulary))
        few = Window.partitionBy("query_id").orderBy("position")
        dense = dense.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= MOST_SURROGATES).drop("n")
        options.append(dense.select("query_id", "frame_id", "score", "text", F.col("position").cast("long"), F.lit(1).alias("lane")))
        rest = rest.join(dense.select("query_id", "frame_id"), ["query_id", "frame_id"], "left_anti")
    shown = F.col("preview")
    if "query" in rest.columns:
        rest = rest.join(contents.select("frame_id", F.col("content").alias("whole")), "frame_id", "left")
        shown = F.when(wants_full_text(F.col("query")) & (F.coalesce("whole", F.lit("")) != ""), F.col("whole")).otherwise(F.col("preview"))
    plain = rest.filter(F.coalesce("preview", F.lit("")) != "").withColumn("text", truncated(shown, SNIPPET_TOKENS, vocabulary))
    options.append(plain.select("query_id", "frame_id", "score", "text", F.col("position").cast("long"), F.lit(2).alias("lane")))
    more = options[0]
    for o in options[1:]:
        more = more.unionByName(o)
    head = first.select("query_id", "frame_id", "score", "text", F.lit(0).cast("long").alias("position"), F.lit(0).alias("lane"))
    every = head.unionByName(more).withColumn("tokens", token_count(F.col("text"), vocabulary).cast("long"))
    every = every.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("lane", "position", "frame_id")).cast("long"))
    taken = greedy_budget(every, budget, 1 + MOST_SURROGATES + MOST_SNIPPETS)
    out = taken.select("query_id", "frame_id", "position").join(every, ["query_id", "frame_id", "position"])
    kind = F.when(F.col("lane") == 0, "expanded").when(F.col("lane") == 1, "surrogate").otherwise("snippet")
    item = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return out.select("query_id", item.alias("item"), kind.alias("kind"), "frame_id", "score", "text", "tokens")


def clamped_config(context: Column, expanded: Column, snippet: Column, penalty: Column) -> dict[str, Column]:
    """Budgets without negatives, the expansion within the context, the penalty in 0..1."""
    whole = F.greatest(context, F.lit(0))
    return {"context": whole, "expansion": F.least(F.greatest(expanded, F.lit(0)), whole), "snippet": F.greatest(snippet, F.lit(0)), "penalty": scores.clamp01(penalty)}


def wants_full_text(query: Column) -> Column:
    """Whether snippets of a question should be whole texts."""
    from recollect.functions.text import intents

    ask = intents(query)
    return ask["asks_date"] | ask["asks_location"] | ask["asks_ownership"]


# ---------------------------------------------------------------- sessions
def is_handoff() -> Column:
    return (F.col("kind") == "handoff") | F.coalesce(F.col("metadata")["kind"] == "handoff", F.lit(False)) | F.coalesce(F.array_contains("labels", "handoff"), F.lit(False))


def latest(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The newest row of each group."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def lexical_sentence(texts: DataFrame) -> DataFrame:
    """query_id, answer: the sentence that shares most of its terms with the query (query_id, query, content, position)."""
    asked = texts.select("query_id", "position", terms(F.col("query")).alias("q"), "content")
    # explode would have Spark filter by the list's size first, which computes it again.
    each = asked.select("query_id", "position", F.explode_outer(scored_sentences(F.col("q"), F.col("content"))).alias("s"))
    scored = each.filter("s IS NOT NULL").select("query_id", "position", "s.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("sentence"), "position", "at")
    return scored.withColumn("n", F.row_number().over(order)).filter("n = 1").select("query_id", F.col("sentence").alias("answer"), "score")


def scored_sentences(q_terms: Column, content: Column) -> Column:
    """at, sentence, score of the sentences of a text that have terms: the share of them that the query has, and a little for digits."""

    def score(s: Column, own: Column) -> Column:
        return F.round(F.size(F.array_intersect(own, q_terms)) / F.greatest(F.size(own), F.lit(1)) + F.when(s.rlike(r"\p{Nd}"), 0.15).otherwise(0.0), 9)

    cut = F.transform(sentences(content), lambda s, i: F.struct(i.alias("at"), s.alias("sentence"), terms(s).alias("own")))
    held = F.filter(cut, lambda x: F.size(x["own"]) > 0)
    return F.transform(held, lambda x: F.struct(x["at"].alias("at"), x["sentence"].alias("sentence"), score(x["sentence"], x["own"]).alias("score")))
