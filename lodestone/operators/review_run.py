"""Review of diffs: evidence for each hunk, one model call a hunk, checked comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import HUNK_RELATED, SURROUNDING_LINES
from lodestone.operators import review
from lodestone.operators.prompts import review_turn
from lodestone.operators.providers import complete


def gather(hunks: DataFrame, files: DataFrame, related: DataFrame, key: str = "diff_id") -> DataFrame:
    """Hunks (key, hunk_no, path, low, high) with surrounding lines and related chunks of other files.

    ``files``: path, line_no, line; ``related``: key, hunk_no, path, rank, block.  Both are left joins: a
    hunk without either keeps a note instead of failing.
    """
    ids = [key, "hunk_no"]
    lines = files.withColumnRenamed("path", "file")
    near = (F.col("file") == F.col("path")) & F.col("line_no").between(F.col("low") - SURROUNDING_LINES, F.col("high") + SURROUNDING_LINES)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    around = hunks.join(lines, near).groupBy(*ids).agg(text.alias("surrounding"))
    # the first few are taken before chunks of the changed file are left out, so fewer may remain
    top = related.filter(F.col("rank") <= HUNK_RELATED).withColumnRenamed("path", "other")
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")
    others = hunks.join(top, ids).filter("other <> path").groupBy(*ids).agg(blocks.alias("related"))
    rows = hunks.join(around, ids, "left").join(others, ids, "left")
    note = F.concat_ws("; ", F.when(F.col("surrounding").isNull(), "no file context"), F.when(F.col("related").isNull(), "no related code"))
    return rows.withColumn("notes", note)


def related_code(index, hunks: DataFrame, chunks: DataFrame, embed, key: str = "diff_id") -> DataFrame:
    """key, hunk_no, path, rank, block: what the repository's index finds for each hunk's search (key, hunk_no, search).

    ``embed(rows)`` adds ``vector`` to rows with ``question``; ``chunks`` gives the found ids their place and code.
    """
    from lodestone.functions.text import location
    from lodestone.operators.retrieval import search_code

    asked = hunks.select(F.concat_ws("#", F.col(key).cast("string"), F.col("hunk_no").cast("string")).alias("query_id"), F.col("search").alias("question"), key, "hunk_no")
    found = search_code(index, embed(asked).select("query_id", "question", "vector"), HUNK_RELATED)
    place = F.concat(location(F.col("file_path"), F.col("start_line"), F.col("end_line")), F.lit("  "), F.concat_ws(" ", "kind", "symbol"))
    block = F.concat(place, F.lit("\n```\n"), F.col("code"), F.lit("\n```"))
    rows = found.join(asked.select("query_id", key, "hunk_no"), "query_id").join(chunks, F.col("id") == F.col("chunk_id"))
    return rows.select(key, "hunk_no", F.col("file_path").alias("path"), "rank", block.alias("block"))


def evidence_text(path: Column, diff: Column, surrounding: Column, related: Column) -> Column:
    """All that a model is shown of one hunk; parts that are missing are left out."""
    around = F.concat(F.lit("\n### "), path, F.lit(" around the change\n```\n"), surrounding, F.lit("\n```"))
    others = F.concat(F.lit("\n### Related code of the repository\n\n"), related)
    return F.concat_ws("\n", F.concat(F.lit("### Change to "), path, F.lit("\n")), diff, around, others)


def review_diffs(lines: DataFrame, model, context: DataFrame | None = None, key: str = "diff_id", max_hunks: int = 200) -> tuple[DataFrame, DataFrame]:
    """(comments, cut): comments of at most ``max_hunks`` hunks of each diff, and what was reviewed.

    ``cut`` has, for each diff, how many hunks were cut, and the number of files before the cut.

    Hunks without an added or removed line are never sent to the model.
    """
    wanted = review.reviewable(lines)
    hunks = review.hunk_ranges(wanted, key)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("hunk_no"))
    hunks = hunks.withColumn("nth", nth)
    cut_ = hunks.groupBy(key).agg(F.greatest(F.count("*") - max_hunks, F.lit(0)).alias("cut"), F.countDistinct("path").alias("files"))
    shown = review.render_hunks(wanted, key)
    asked = hunks.filter((F.col("nth") <= max_hunks) & (F.col("added") + F.col("removed") > 0)).join(shown, [key, "hunk_no"])
    if context is not None:
        asked = asked.join(context.select(key, "hunk_no", "surrounding", "related"), [key, "hunk_no"], "left")
    else:
        asked = asked.withColumns({"surrounding": F.lit(None).cast("string"), "related": F.lit(None).cast("string")})
    prompt = review_turn(evidence_text(F.col("path"), F.col("diff"), F.col("surrounding"), F.col("related")))
    replied = complete(asked.withColumn("prompt", prompt), "prompt", model, into="text")
    comments = review.parse_comments(replied, [key, "hunk_no"])
    order = [key, "hunk_no", "ord"]
    by_diff = Window.partitionBy(key, "path", "line", F.lower(F.substring("message", 1, 60))).orderBy(*order)
    comments = comments.withColumn("first", F.row_number().over(by_diff)).filter("first = 1").drop("first")
    return comments, cut_
