"""Question answering over retrieved evidence: prompts, critique rules, retries, attempts.

Requests are rows.  Mechanical rules are column expressions; a model is called, through a
provider, only on the rows that they leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import MAX_ATTEMPTS, MIN_ANSWER_CHARS, PROMPT_CHUNK_CHARS, QUERY_CHARS
from lodestone.functions.text import basename, citation_end, citation_file, citation_start, citations
from lodestone.lineage import cut
from lodestone.operators.prompts import retry_note

NO_EVIDENCE, NO_CITATIONS, FABRICATED, CRITIC = "no_evidence", "no_citations", "fabricated", "critic"
#: How bad a failed attempt is, worst last.
SEVERITY = {"": 0, CRITIC: 1, NO_CITATIONS: 2, FABRICATED: 3, NO_EVIDENCE: 4}
CUT_MARK = "\n… [truncated for length]"

FILE_NAME = r"[\w ./\-]+\.\w{1,6}"
FILE_FIRST = rf"(?U)[`\"']?({FILE_NAME})[`\"']?(?:\s+file)?[^.\n]{{0,40}}?\blines?\s+(\d+)\s*[-–]\s*(\d+)"
RANGE_FIRST = rf"(?U)\blines?\s+(\d+)\s*[-–]\s*(\d+)[^.\n]{{0,40}}?[`\"']({FILE_NAME})[`\"']"


def overlaps(file_a: Column, start_a: Column, end_a: Column, file_b: Column, start_b: Column, end_b: Column) -> Column:
    """Same file name, whatever the folder, and overlapping lines."""
    same = F.lower(basename(file_a)) == F.lower(basename(file_b))
    return same & (start_a <= end_b) & (end_a >= start_b)


def loose_citations(answer: Column) -> Column:
    """(file, start, end) of citations in prose: ``x.js, lines 3-9`` and ``lines 3-9 of `x.js```."""

    def found(pattern: str, file: int, a: int, b: int) -> Column:
        group = lambda i: F.regexp_extract_all(answer, F.lit(pattern), F.lit(i))
        zipped = F.arrays_zip(group(file).alias("f"), group(a).alias("a"), group(b).alias("b"))
        return F.transform(zipped, lambda x: F.struct(F.trim(x["f"]).alias("file"), x["a"].cast("int").alias("start"), x["b"].cast("int").alias("end")))

    return F.concat(found(FILE_FIRST, 1, 2, 3), found(RANGE_FIRST, 3, 1, 2))


def names_file(answer: Column, path: Column) -> Column:
    low = F.lower(answer)
    return F.contains(low, F.lower(path)) | F.contains(low, F.lower(basename(path)))


def cited_ranges(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, citation, file, base, start, end: one row a citation."""
    one = answers.select(key, F.explode(citations(F.col(answer))).alias("citation"))
    c = F.col("citation")
    file = citation_file(c)
    return one.select(key, "citation", file.alias("file"), F.lower(basename(file)).alias("base"), citation_start(c).alias("start"), citation_end(c).alias("end"))


def unsupported_citations(cited: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Citations that no evidence row (key, file, start, end) of the request covers: an anti join.

    The file's base name is an equi key, the overlap of lines the residue.
    """
    rows = evidence.select(F.col(key).alias("k"), F.lower(basename(F.col("file"))).alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
    on = (F.col(key) == F.col("k")) & (F.col("base") == F.col("b")) & (F.col("start") <= F.col("e")) & (F.col("end") >= F.col("s"))
    return cited.join(rows, on, "left_anti")


def verdict(attempts: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``reason`` by the mechanical rules, cheapest first; null kind goes to the critic.

    Needs: answer, evidence (number of evidence rows), cited (array), checkable (boolean),
    unsupported (array).
    """
    silent = (F.size("cited") == 0) & ~F.col("checkable") & (F.length("answer") >= MIN_ANSWER_CHARS)
    kind = F.when(F.col("evidence") == 0, NO_EVIDENCE).when(silent, NO_CITATIONS).when(F.size("unsupported") > 0, FABRICATED)
    reason = (
        F.when(kind == NO_EVIDENCE, "nothing was retrieved")
        .when(kind == NO_CITATIONS, "no claim can be checked")
        .when(kind == FABRICATED, F.concat(F.lit("not retrieved: "), F.array_join(F.slice("unsupported", 1, 3), ", ")))
    )
    follow = F.when(kind == FABRICATED, followup_query(F.col("unsupported"))).otherwise("")
    return attempts.withColumns({"kind": kind, "reason": reason, "followup": follow})


def followup_query(unsupported: Column) -> Column:
    """File names of the fabricated citations, each once, as the next search."""
    names = F.transform(unsupported, lambda c: F.regexp_replace(basename(citation_file(c)), r"\.py$", ""))
    return F.left(F.array_join(F.array_distinct(names), " "), F.lit(QUERY_CHARS))


def parse_critic(reply: Column) -> dict[str, Column]:
    """grounded, reason, query of a critic's reply; the last line of each key counts, malformed means grounded."""

    def last(key: str) -> Column:
        values = F.regexp_extract_all(reply, F.lit(rf"(?im)^[ \t]*{key}[ \t]*:[ \t]*+(.*?)[ \t\r]*$"), F.lit(1))
        return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))

    grounded = ~F.startswith(F.lower(last("GROUNDED")), F.lit("no"))
    asked = F.regexp_extract_all(reply, F.lit(r"(?im)^[ \t]*QUERY[ \t]*:[ \t]*+(?!NONE[ \t\r]*$)(.*?)[ \t\r]*$"), F.lit(1))
    query = F.coalesce(F.try_element_at(asked, F.lit(-1)), F.lit(""))
    return {"grounded": grounded, "reason": last("REASON"), "followup": F.when(grounded, "").otherwise(query), "kind": F.when(grounded, "").otherwise(CRITIC)}


def decision() -> Column:
    """end, rewrite or search, from: grounded, attempts, kind, followup, evidence, queries, uncited (failures so far)."""
    seen = F.col("evidence") > 0
    return (
        F.when(F.col("grounded"), "end")
        .when(F.col("attempts") >= MAX_ATTEMPTS, "end")
        .when(~seen & (F.col("queries") == 0), "end")
        .when((F.col("kind") == NO_CITATIONS) & (F.col("uncited") >= 2), "end")
        .when((F.coalesce("followup", F.lit("")) == "") & seen, "rewrite")
        .otherwise("search")
    )


def uncited_so_far(key: str, attempt: str) -> Column:
    w = Window.partitionBy(key).orderBy(attempt).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum((F.col("kind") == NO_CITATIONS).cast("int")).over(w)


def least_bad(attempts: DataFrame, key: str) -> DataFrame:
    """One attempt a request: the mildest failure, then the longest answer, then the latest."""
    bad = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.coalesce("kind", F.lit(""))), F.lit(1))
    w = Window.partitionBy(key).orderBy(bad, F.desc(F.length("answer")), F.desc("attempt"))
    return attempts.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def merge_evidence(found: DataFrame, key: str) -> DataFrame:
    """Evidence over attempts: each chunk where it was found first, in order: key, id, attempt, rank, ord."""
    w = Window.partitionBy(key, "id").orderBy("attempt", "rank")
    first = found.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("attempt", "rank")))


def excerpt_block(rank: Column, place: Column, kind: Column, symbol: Column, language: Column, code: Column) -> Column:
    """A numbered excerpt of a prompt; code beyond the cap is cut and marked."""
    body = F.when(F.length(code) > PROMPT_CHUNK_CHARS, F.concat(F.left(code, F.lit(PROMPT_CHUNK_CHARS)), F.lit(CUT_MARK))).otherwise(code)
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), place, F.lit("  "), kind, F.lit(" "), symbol, F.lit("  ("), language, F.lit(")\n```\n"), body, F.lit("\n```"))


def evidence_pack(rows: DataFrame, key: str) -> DataFrame:
    """key, context: the excerpts of a request by rank, a blank line between."""
    block = excerpt_block(F.col("rank"), F.col("place"), F.col("kind"), F.col("symbol"), F.col("language"), F.col("code"))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("excerpts"))


def run_agent(questions: DataFrame, retrieve, generate, critic=None, key: str = "query_id") -> DataFrame:
    """Answers a batch of questions in at most MAX_ATTEMPTS passes; the answered ones leave after each pass.

    ``retrieve(rows)``: (key, query) to (key, id, rank, file, start, end, block).  ``generate(rows)``:
    (key, question, context, note, retry) adds ``answer`` and may add input_tokens and output_tokens; ``note``
    is what was wrong with the last attempt, ``retry`` the text that tells the model.  ``critic(rows)`` adds
    ``reply``; without it what passes the mechanical rules counts as grounded.  Each pass is written to
    the checkpoint folder, so that no model is called again for rows that are done.

    Returns key, answer, kind, grounded (of the last critique, even where an earlier answer is given),
    attempts, unsupported (of the last critique), tokens summed over attempts, and the trace: (attempt,
    query, kind, reason, answer) of each attempt.
    """
    active = questions.select(key, "question", F.col("question").alias("query"), F.lit("").alias("note"), F.lit("").alias("retry"))
    seen = done = None
    for attempt in range(1, MAX_ATTEMPTS + 1):
        searched = active.filter("query <> ''")
        found = retrieve(searched.select(key, "query")).withColumn("attempt", F.lit(attempt))
        seen = cut(found if seen is None else seen.unionByName(found))
        evidence = merge_evidence(seen, key)
        context = evidence.groupBy(key).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), "\n\n").alias("context"),
            F.count("*").alias("evidence"),
            F.collect_list("file").alias("files"),
        )
        rows = active.join(context, key, "left").fillna({"evidence": 0, "context": ""})
        answered = generate(rows).withColumn("cited", citations(F.col("answer")))
        for tokens in ("input_tokens", "output_tokens"):
            if tokens not in answered.columns:
                answered = answered.withColumn(tokens, F.lit(0))
        missing = unsupported_citations(cited_ranges(answered, key, "answer"), evidence, key)
        missing = missing.groupBy(key).agg(F.sort_array(F.collect_list("citation")).alias("unsupported"))
        named = F.exists(F.coalesce("files", F.array().cast("array<string>")), lambda f: names_file(F.col("answer"), f))
        judged = answered.join(missing, key, "left").withColumn("unsupported", F.coalesce("unsupported", F.array().cast("array<string>")))
        judged = verdict(judged.withColumn("checkable", named))
        mechanical = judged.filter("kind IS NOT NULL").withColumn("grounded", F.lit(False))
        asked = judged.filter("kind IS NULL")
        if critic is None:
            passed = asked.withColumns({"grounded": F.lit(True), "kind": F.lit("")})
        else:
            asked = critic(asked)
            passed = asked.withColumns(parse_critic(F.col("reply"))).drop("reply")
        now = mechanical.unionByName(passed, allowMissingColumns=True).withColumn("attempt", F.lit(attempt))
        keep = [key, "question", "query", "answer", "kind", "reason", "grounded", "attempt", "followup", "evidence", "unsupported", "input_tokens", "output_tokens"]
        now = cut(now.select(*keep))
        done = now if done is None else done.unionByName(now)
        tried = done.groupBy(key).agg(F.sum((F.col("kind") == NO_CITATIONS).cast("int")).alias("uncited"))
        choice = now.join(tried, key).withColumns({"attempts": F.col("attempt"), "queries": F.lit(1)}).withColumn("next", decision())
        follow = F.when(F.col("followup") == "", F.col("question")).otherwise(F.col("followup"))
        query = F.when(F.col("next") == "search", follow).otherwise("")
        active = cut(choice.filter("next <> 'end'").select(key, "question", query.alias("query"), F.col("kind").alias("note"), retry_note(F.col("kind"), F.col("reason")).alias("retry")))
        if active.isEmpty():
            break
    steps = F.array_sort(F.collect_list(F.struct("attempt", "query", "kind", "reason", "answer")))
    last = done.groupBy(key).agg(
        F.max("attempt").alias("attempts"),
        F.max_by("grounded", "attempt").alias("grounded"),
        F.max_by("unsupported", "attempt").alias("unsupported"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        steps.alias("trace"),
    )
    return least_bad(done, key).select(key, "answer", "kind").join(last, key)
