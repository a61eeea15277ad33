"""Contexts from ranked chunks: deduplication, merging of neighbours, budgets, citations, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import model_tokens, word_set


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """Each chunk of a query once, with its highest score, the first of equal ones."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_neighbours(hits: DataFrame, full_run: bool = False) -> DataFrame:
    """Chunks of consecutive places of a document become one, in pairs or as whole runs.

    A run 3, 4, 5, 6 gives (3, 4) and (5, 6): a merged chunk keeps its first
    place, so that a third one is no neighbour of it.
    """
    per = Window.partitionBy("query_id", "document_id").orderBy("chunk_index")
    rows = hits.withColumn("_run", F.col("chunk_index") - F.row_number().over(per))
    place = F.row_number().over(Window.partitionBy("query_id", "document_id", "_run").orderBy("chunk_index"))
    rows = rows.withColumn("_pair", F.lit(0) if full_run else F.floor((place - 1) / 2))
    merged = rows.groupBy("query_id", "document_id", "_run", "_pair").agg(
        F.min("chunk_index").alias("chunk_index"),
        F.min_by("chunk_id", "chunk_index").alias("chunk_id"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("n_merged"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda s: s["text"]), "\n\n").alias("text"),
    )
    return merged.drop("_run", "_pair")


def char_budget(rows: DataFrame, max_tokens: int, order: list[Column], overhead: int = 80) -> DataFrame:
    """Chunks in order while their characters, and `overhead` each, fit four times the tokens; a first one too long is cut."""
    limit = max_tokens * 4
    w = Window.partitionBy("query_id").orderBy(*order)
    rows = rows.withColumn("used", F.sum(F.length("text") + overhead).over(w)).withColumn("source_no", F.row_number().over(w))
    cut = F.when((F.col("source_no") == 1) & (F.col("used") > limit), F.concat(F.substring("text", 1, limit - overhead), F.lit("..."))).otherwise(F.col("text"))
    return rows.withColumn("text", cut).filter((F.col("used") <= limit) | (F.col("source_no") == 1))


def token_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Chunks from the highest score on while their tokens fit; the first always."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = rows.withColumn("used", F.sum(model_tokens(F.col("text"))).over(w)).withColumn("source_no", F.row_number().over(w))
    return rows.filter((F.col("used") <= budget) | (F.col("source_no") == 1))


def per_document_cap(rows: DataFrame) -> DataFrame:
    """At most max(2, n / 3) chunks of one document, n being the query's chunks."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("_cap", F.greatest(F.lit(2), F.floor(n / 3))).withColumn("_n", place).filter("_n <= _cap").drop("_cap", "_n")


def diverse(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """From the highest score on, chunks whose word sets are not alike (Jaccard) to one that was taken before.

    A query's chunks are few by the retrieval's k; they are folded in one array.
    """
    whole = F.struct(*rows.columns)
    item = F.struct((-F.col("score")).alias("order"), "chunk_id", word_set(F.col("text")).alias("words"), whole.alias("whole"))
    held = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def alike(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a["words"], b["words"]))
        total = F.size(a["words"]) + F.size(b["words"]) - common
        return F.when((F.size(a["words"]) == 0) | (F.size(b["words"]) == 0), 0.0).otherwise(common / total) >= threshold

    taken = F.aggregate(
        "items", F.filter("items", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: alike(x, y)), acc).otherwise(F.array_append(acc, x))
    )
    return held.select(F.explode(F.transform(taken, lambda x: x["whole"])).alias("row")).select("row.*")


def header(number: Column, title: Column, page: Column) -> Column:
    """[Source n] | section | Page p, without what is null."""
    return F.concat_ws(" | ", F.concat(F.lit("[Source "), number.cast("string"), F.lit("]")), title, F.concat(F.lit("Page "), page.cast("string")))


def rich_header(number: Column, title: Column, document_id: Column, score: Column) -> Column:
    name = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Document "), F.substring(document_id.cast("string"), 1, 8)))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), name, F.format_string(" (score %.3f)", score))


def context_text(rows: DataFrame) -> DataFrame:
    """(query_id, n_sources, context): blocks of header and text in the order of source_no."""
    block = F.concat(header(F.col("source_no"), F.col("document_id"), F.lit(None).cast("int")), F.lit("\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("source_no", block.alias("block"))))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.transform(blocks, lambda s: s["block"]), "\n\n").alias("context"))


def citations(rows: DataFrame, preview: int = 200) -> DataFrame:
    """One row for each numbered source, resolved against the numbered context."""
    return rows.select("query_id", F.col("source_no").alias("index"), "chunk_id", "document_id", "score", F.substring("text", 1, preview).alias("preview"))


def citation_numbers(text: Column) -> Column:
    """The sources that a text cites by [n], [a-b] (fewer than 20 apart) and [a,b], each once, in order."""
    one = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    first = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)-(\d+)\]"), 1), lambda x: x.cast("int"))
    last = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)-(\d+)\]"), 2), lambda x: x.cast("int"))
    ranges = F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.when((r["a"] <= r["b"]) & (r["b"] - r["a"] < 20), F.sequence(r["a"], r["b"])).otherwise(F.array().cast("array<int>")))
    pairs = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+),\s*(\d+)\]"), g), lambda x: x.cast("int")) for g in (1, 2)))
    return F.array_sort(F.array_distinct(F.concat(one, F.flatten(ranges), pairs)))


def allocation(limit: Column, max_context: Column | None = None, reserved: int = 512) -> Column:
    """How a model's window is shared: context, response, system and history."""
    effective = limit - reserved
    context = F.floor(effective * 0.6) if max_context is None else F.least(max_context, effective)
    response = F.floor(effective * 0.25)
    return F.struct(
        effective.alias("effective"), context.cast("int").alias("context"), response.cast("int").alias("response"), F.lit(1024).alias("system"),
        F.greatest(effective - context - response - 1024, F.lit(0)).cast("int").alias("history"),
    )


def history(turns: DataFrame, budget: int, most: int = 12) -> DataFrame:
    """The last turns of each conversation, `most` of them, while their tokens and 4 each fit, from the newest back."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("back", F.row_number().over(w)).withColumn("used", F.sum(model_tokens(F.col("text")) + 4).over(w))
    return rows.filter((F.col("back") <= most) & (F.col("used") <= budget))


def truncated(text: Column, budget: int) -> Column:
    """Cut to the budget's share of the text's tokens, with a note."""
    tokens = model_tokens(text)
    kept = F.substring(text, F.lit(1), F.floor(F.length(text) * budget / tokens).cast("int"))
    return F.when(tokens <= budget, text).otherwise(F.concat(kept, F.lit("\n[Content truncated]")))


def source_header(number: Column, row: dict[str, Column]) -> Column:
    """[Source n] | title | § section | p.n | [source✓] | score:0.123, without what is null.

    `row` has the columns title (or null), document_id, section, page, source,
    score and rerank. Without a title the document's first eight characters
    stand in; a reranked source is ticked, and its rerank score is the one shown.
    """
    title = F.coalesce(F.nullif(row["title"], F.lit("")), F.concat(F.lit("Document "), F.substring(row["document_id"].cast("string"), 1, 8)))
    return F.concat_ws(
        " | ", F.concat(F.lit("[Source "), number.cast("string"), F.lit("]")), title, F.concat(F.lit("§ "), F.nullif(row["section"], F.lit(""))), F.concat(F.lit("p."), row["page"].cast("string")),
        F.concat(F.lit("["), F.replace(F.nullif(row["source"], F.lit("")), F.lit("_reranked"), F.lit("✓")), F.lit("]")),
        F.when(row["rerank"].isNotNull(), F.format_string("rerank:%.3f", row["rerank"])).otherwise(F.format_string("score:%.3f", row["score"])),
    )


def build_context(rows: DataFrame, budget: int) -> DataFrame:
    """(query_id, n_sources, n_tokens, context): sources chosen by score within a budget of tokens, set in the order of documents.

    Rows have query_id, chunk_id, document_id, chunk_index, text, title,
    section, page, source, score and rerank. From the highest score on, blocks
    of header and text are taken while their tokens fit; if the first does not,
    its text is cut to the budget less fifty. Numbers follow the order in which
    the blocks are shown.
    """
    fields = ("title", "document_id", "section", "page", "source", "score", "rerank")
    block = lambda number: F.concat(source_header(number, {c: F.col(c) for c in fields}), F.lit("\n"), F.trim("text"), F.lit("\n"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    placed = rows.withColumn("place", F.row_number().over(by_score))
    placed = placed.withColumn("tokens", model_tokens(block(F.col("place")))).withColumn("used", F.sum("tokens").over(by_score))
    over = F.col("used") > budget
    kept = placed.filter(~over | (F.col("place") == 1)).withColumn("text", F.when(over, truncated(F.col("text"), budget - 50)).otherwise(F.col("text")))
    shown = kept.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("document_id", "chunk_index")))
    blocks = F.array_sort(F.collect_list(F.struct("number", block(F.col("number")).alias("block"))))
    used = F.coalesce(F.sum(F.when(~over, F.col("tokens"))), F.lit(0))
    return shown.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), used.alias("n_tokens"), F.array_join(F.transform(blocks, lambda b: b["block"]), "\n").alias("context"))


def usage(limit: Column, context: Column, response: Column, system: Column) -> Column:
    """total, percent of the window to one place, remaining, and whether it fits."""
    total = context + response + system
    return F.struct(
        total.alias("total"), F.when(limit > 0, F.round(total / limit * 100, 1)).otherwise(0.0).alias("percent"),
        F.greatest(limit - total, F.lit(0)).alias("remaining"), (total <= limit).alias("within"),
    )


def fits(text: Column, budget: Column) -> Column:
    return model_tokens(F.coalesce(text, F.lit(""))) <= budget


def remaining(text: Column, budget: Column) -> Column:
    return F.greatest(budget - model_tokens(F.coalesce(text, F.lit(""))), F.lit(0))


def references(cited: Column) -> Column:
    """A list of references to be put behind an answer; `cited` is an array of (index, title, section, page). Empty without any."""
    line = lambda c: F.concat_ws(" | ", F.concat(F.lit("["), c["index"].cast("string"), F.lit("]")), F.nullif(c["title"], F.lit("")), F.concat(F.lit("Section: "), F.nullif(c["section"], F.lit(""))), F.concat(F.lit("Page "), c["page"].cast("string")))
    return F.when(F.size(cited) > 0, F.concat(F.lit("\n\n## References\n"), F.array_join(F.transform(cited, line), "\n"))).otherwise("")


def referenced(cited: Column) -> Column:
    """The same sources for a further prompt, each with its preview."""

    def line(c: Column) -> Column:
        place = F.concat_ws(", ", F.concat(F.lit("p. "), c["page"].cast("string")), F.nullif(c["section"], F.lit("")))
        return F.concat(F.lit("["), c["index"].cast("string"), F.lit("] "), F.coalesce(c["title"], F.lit("")), F.when(place != "", F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(""), F.lit(': """'), c["preview"], F.lit('"""'))

    return F.concat_ws("\n", F.lit("## Referenced Sources"), F.array_join(F.transform(cited, line), "\n"))
