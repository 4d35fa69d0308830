"""Queries: ingest, stored indexes, judging, agent traces, review sinks, answer streams, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions.text import cited_locations, cost_line, header, uncited_sources
from lodestone.lineage import cut, shared_folder, spread
from lodestone.operators import agent, index_repo, judge, lines, metrics, providers, reports, retrieval, review, review_run
from lodestone.operators.bm25 import ranked
from lodestone.operators.ingest import chunk_documents, ingest
from lodestone.plans.answers import ANSWERS_SQL, CITED_SQL, answers
from lodestone.plans.evaluation import OUTCOMES_SQL, outcomes
from lodestone.plans.registry import register, table
from lodestone.plans.retrieval import BM25_SQL, stats_sql, tokens_sql
from lodestone.plans.search import SEARCH_SQL, corpus
from lodestone.sources import files, gold
from lodestone.sources.ignore import IgnoreRules

# ------------------------------------------------------------------ sources

LISTING = ["a.py", "b.log.py", "gen/x.py", "gen/keep.py", "sub/gen/y.py", "sub/z.py", "deep/tmp1/q.go", "deep/in/tmp1/q.go", "only/here.rs", "not/only/here.rs", "notes.md"]
RULES = [("", "# comment\n*.log.py\n/gen/*\n!gen/keep.py\n**/tmp?/\n/only/here.rs\n"), ("sub", "z.py\n!z.py\ngen/\n")]
KEPT = ["a.py", "gen/keep.py", "not/only/here.rs", "notes.md", "sub/z.py"]


@register("ignored_files", "SELECT unnest([" + ", ".join(f"'{p}'" for p in KEPT) + "]) AS path")
def ignored_files(spark, d):
    listing = spark.createDataFrame([(p, 1) for p in LISTING], "path string, length long")
    return files.select_sources(listing, IgnoreRules(RULES)).select("path")


PATHS = [("src/a.py", "src/a.py"), ("./src//a.py", "src/a.py"), ("src/../b.py", "b.py"), ("../x.py", None), ("a/../../x.py", None), ("/etc/passwd", None), ("..", None), ("", None)]


@register("inside_paths", "SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(a, "NULL" if b is None else f"'{b}'") for a, b in PATHS) + ") t(path, inside)")
def inside_paths(spark, d):
    return spark.createDataFrame([(p,) for p, _ in PATHS], "path string").select("path", lines.inside_path(F.col("path")).alias("inside"))


@register("question_ids", "SELECT item_id, text FROM benchmark WHERE item_id IN (1, 3, 20)")
def question_ids(spark, d):
    rows = table(spark, d, "benchmark").withColumn("id", F.col("item_id").cast("string"))
    return gold.by_ids(rows, ["20", "1", "3"]).select("item_id", "text")


FILES = [("pkg/a.py", "import os\n\ndef f():\n    return 1\n"), ("README.md", "intro\n# One\ntext\n"), ("lib/b.go", "package b\n\nfunc (t *T) Run() {\n}\n"), ("notes.rst", "x\n\ny"), ("img.png", "no"), ("broken.py", None)]
CHUNKS = [("pkg/a.py", "Python", "<module>", "module", 1, 1), ("pkg/a.py", "Python", "f", "function", 3, 4), ("README.md", "Markdown", "README", "doc", 1, 1), ("README.md", "Markdown", "One", "doc", 2, 3),
          ("lib/b.go", "Go", "<module>", "module", 1, 1), ("lib/b.go", "Go", "T.Run", "function", 3, 4), ("notes.rst", "reStructuredText", "notes", "doc", 1, 3)]


@register("ingest_files", f"SELECT * FROM (VALUES {', '.join(map(repr, CHUNKS))}) t(file_path, language, symbol, kind, start_line, end_line)")
def ingest_files(spark, d):
    """Code and documents of one tree in one table of chunks."""
    found = ingest(spark.createDataFrame(FILES, "path string, text string"))
    return found.select("file_path", "language", "symbol", "kind", "start_line", "end_line")


@register(
    "document_chunks",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text <> ''),
w AS (SELECT *, (n - 1) // 200 AS w, max(n) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT 'readme' || doc_id || '.txt' AS file_path, (w + 1)::INT AS part, ((max(last) - 1) // 200 + 1)::INT AS part_count, min(n)::INT AS start_line, max(n)::INT AS end_line,
  md5(left(string_agg(line, chr(10) ORDER BY n), 8000)) AS code_md5 FROM w GROUP BY doc_id, w HAVING bool_or(regexp_matches(line, '\\S'))""",
)
def document_chunks(spark, d):
    docs = table(spark, d, "documents").filter("NOT endswith(text, '\n')")
    rest = table(spark, d, "documents").filter("endswith(text, '\n')").withColumn("text", F.concat("text", F.lit(" ")))  # an empty last line counts here
    rows = docs.union(rest).select(F.concat(F.lit("readme"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    found = chunk_documents(rows)
    return found.select("file_path", "part", "part_count", "start_line", "end_line", F.md5(F.regexp_replace("code", "\n $", "\n")).alias("code_md5"))


STORED_SQL = "(SELECT 'docs/d' || doc_id || '.txt:1-1#1' AS doc_id, 'docs/d' || doc_id || '.txt' || chr(10) || 'Text doc d' || doc_id || chr(10) || chr(10) || text AS text FROM documents)"


@register(
    "stored_search",
    "WITH stored AS "
    + STORED_SQL
    + ", "
    + BM25_SQL.replace(tokens_sql("documents", "doc_id", "text", "toks"), tokens_sql("stored", "doc_id", "text", "toks")).replace(stats_sql("documents"), stats_sql("stored"))
    + " SELECT query_id, id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 8 AND score > 0",
)
def stored_search(spark, d):
    """Documents as chunks, indexed into tables; the ranking reads the stored postings and terms."""
    i = F.col("doc_id").cast("string")
    chunks = spread(table(spark, d, "documents")).select(
        F.col("text").alias("code"), F.lit("Text").alias("language"), F.concat(F.lit("docs/d"), i, F.lit(".txt")).alias("file_path"), F.concat(F.lit("d"), i).alias("symbol"),
        F.lit("doc").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(1).alias("part"), F.lit(1).alias("part_count"),
    )
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index_repo.build_index(spark, chunks, folder, "length", lambda rows: rows.withColumn("vector", F.array(F.length("document").cast("float"))))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = retrieval.search_code(index_repo.open_index(spark, folder), asked, 8, "bm25")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------ judging

JUDGED_SQL = f"""{ANSWERS_SQL}, {CITED_SQL},
asked AS (SELECT doc_id AS question_id, CASE WHEN quality = 1 THEN 'factual' ELSE 'explanatory' END AS kind FROM labels),
g AS (SELECT question_id, 'src/doc' || (CASE WHEN question_id % 4 = 0 THEN question_id + 1 ELSE question_id END) || '.md' AS file, CASE WHEN question_id % 8 = 0 THEN 'K.my' ELSE 'K.absent' END AS symbol FROM asked),
c AS (SELECT doc_id, 'src/doc' || doc_id || '.md' AS file, CASE WHEN doc_id % 8 = 0 THEN 'K.my' ELSE 'K.absent' END AS symbol, text FROM documents)"""


def judged_tables(spark, d):
    i = F.col("question_id")
    symbol = lambda c: F.when(c % 8 == 0, "K.my").otherwise("K.absent")
    asked = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("quality") == 1, "factual").otherwise("explanatory").alias("kind"))
    wanted = asked.select("question_id", F.concat(F.lit("src/doc"), F.when(i % 4 == 0, i + 1).otherwise(i).cast("string"), F.lit(".md")).alias("file"), symbol(i).alias("symbol"))
    docs = table(spark, d, "documents")
    chunks = docs.select(
        F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), symbol(F.col("doc_id")).alias("symbol"),
        F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit(1).alias("part"), F.col("text").alias("code"),
    )
    return asked, wanted, chunks


@register(
    "gold_code",
    f"WITH {JUDGED_SQL} SELECT question_id, md5(g.file || ':1-9  ' || g.symbol || chr(10) || '```' || chr(10) || text || chr(10) || '```') AS code_md5 FROM g JOIN c ON g.file = c.file AND g.symbol = c.symbol",
)
def gold_code(spark, d):
    _, wanted, chunks = judged_tables(spark, d)
    return judge.gold_code(wanted, chunks).select("question_id", F.md5("code").alias("code_md5"))


@register(
    "judged_answers",
    f"""WITH {JUDGED_SQL},
cite AS (SELECT question_id, CASE WHEN EXISTS (SELECT 1 FROM cited x WHERE x.doc_id = question_id AND starts_with(x.c, file || ':')) THEN 1.0::DOUBLE WHEN contains(answer, split_part(symbol, '.', 2)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS accuracy
  FROM g JOIN answers ON doc_id = question_id),
llm AS (SELECT question_id, CASE WHEN c.file IS NULL THEN 0.0::DOUBLE WHEN contains(answer, 'Also other') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS accuracy FROM g JOIN answers ON answers.doc_id = question_id LEFT JOIN c ON g.file = c.file AND g.symbol = c.symbol)
SELECT question_id, accuracy, CASE accuracy WHEN 1 THEN 'correct' WHEN 0.5 THEN 'partial' ELSE 'incorrect' END AS verdict, by_ AS judged_by FROM (
  SELECT *, 'citation' AS by_ FROM cite WHERE question_id IN (SELECT question_id FROM asked WHERE kind = 'factual')
  UNION ALL SELECT *, 'llm' FROM llm WHERE question_id IN (SELECT question_id FROM asked WHERE kind <> 'factual'))""",
)
def judged_answers(spark, d):
    """Factual questions by citation, the others by a scripted judge; without reference code 0 and no call."""
    asked, wanted, chunks = judged_tables(spark, d)
    answered = asked.join(answers(spark, d).withColumnRenamed("doc_id", "question_id"), "question_id").withColumn("question", F.lit("why?"))
    model = providers.get_provider("scripted", {"Also other": "VERDICT: correct"}, "VERDICT: unsure")
    return judge.judged(answered, wanted, chunks, model)


@register("agent_trace", "SELECT * FROM (VALUES (1, 1::BIGINT, 10::BIGINT, 2::BIGINT, ''), (2, 2, 20, 4, 'no_citations,'), (3, 2, 20, 4, 'no_citations,no_citations'), (4, 3, 30, 6, 'no_evidence,no_evidence,no_evidence')) t(query_id, steps, input_tokens, output_tokens, kinds)")
def agent_trace(spark, d):
    """Attempts, their failures and the tokens of all of them, with a scripted provider."""
    asked = spark.createDataFrame([(1, "good"), (2, "fixes itself"), (3, "never cites"), (4, "nothing")], "query_id int, question string")

    def retrieve(rows):
        found = rows.filter("query_id <> 4").select("query_id", F.lit("c1").alias("id"), F.lit(1).alias("rank"), F.lit("src/a.py").alias("file"))
        return found.withColumns({"start": F.lit(1), "end": F.lit(9), "block": F.lit("[1] src/a.py:1-9")})

    def generate(rows):
        told = F.contains("retry", F.lit("cited nothing"))
        answer = F.when((F.col("query_id") == 1) | ((F.col("query_id") == 2) & told), "see src/a.py:2-3").otherwise(F.repeat(F.lit("x "), 150))
        return rows.withColumns({"answer": answer, "input_tokens": F.lit(10), "output_tokens": F.lit(2)})

    found = agent.run_agent(asked, retrieve, generate)
    kinds = F.array_join(F.transform("trace", lambda t: t["kind"]), ",")
    return found.select("query_id", F.size("trace").cast("long").alias("steps"), "input_tokens", "output_tokens", kinds.alias("kinds"))


# ------------------------------------------------------------------ reviews

COMMENTS_SQL = """c AS (SELECT lang AS diff_id, source AS path, (doc_id % 50 + 1)::INT AS line, (['blocker', 'warning', 'suggestion', 'note'])[(doc_id % 4) + 1] AS severity, 'm' || doc_id AS message FROM documents)"""


def table_comments(spark, d):
    levels = F.array(*[F.lit(s) for s in ("blocker", "warning", "suggestion", "note")])
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.col("lang").alias("diff_id"), F.col("source").alias("path"), (i % 50 + 1).cast("int").alias("line"),
        F.element_at(levels, (i % 4 + 1).cast("int")).alias("severity"), F.concat(F.lit("m"), i.cast("string")).alias("message"),
    )


@register(
    "review_json",
    f"""WITH {COMMENTS_SQL}, r AS (SELECT *, list_position(['blocker', 'warning', 'suggestion', 'note'], severity) AS r FROM c)
SELECT diff_id, md5(to_json({{'summary': {{'files': 3, 'hunks': 9, 'comments': count(*), 'by_severity': {{{", ".join(f"'{s}': count(CASE WHEN severity = '{s}' THEN 1 END)" for s in ("blocker", "warning", "suggestion", "note"))}}}, 'model': 'none'}},
  'skipped': ['x.bin: binary'], 'comments': list({{'file': path, 'line': line, 'severity': severity, 'message': message}} ORDER BY r, path, line, message)}})::VARCHAR) AS review_md5 FROM r GROUP BY diff_id""",
)
def review_json(spark, d):
    comments = table_comments(spark, d)
    totals = comments.select("diff_id").distinct().withColumns(
        {"files": F.lit(3), "hunks": F.lit(9), "model": F.lit("none"), "skipped": F.array(F.lit("x.bin: binary"))}
    )
    return reports.review_summary(comments, totals).select("diff_id", F.md5("review").alias("review_md5"))


@register("worst_comments", f"WITH {COMMENTS_SQL} SELECT path, line, severity, message FROM c ORDER BY list_position(['blocker', 'warning', 'suggestion', 'note'], severity), path, line, message LIMIT 30")
def worst_comments(spark, d):
    """The first thirty comments of a review, the worst first."""
    return review.sort_comments(table_comments(spark, d)).select("path", "line", "severity", "message").limit(30)


@register("severity_threshold", f"WITH {COMMENTS_SQL} SELECT diff_id, path, line, severity, message, severity = 'blocker' AS blocking FROM c WHERE severity IN ('blocker', 'warning')")
def severity_threshold(spark, d):
    found = reports.at_least(table_comments(spark, d), "warning")
    blocks = reports.blocking(found).withColumn("blocking", F.lit(True))
    return blocks.unionByName(found.filter("severity <> 'blocker'").withColumn("blocking", F.lit(False)))


@register("review_limits", "SELECT lang AS diff_id, greatest(count(*) - 200, 0) AS cut, count(*) AS files FROM documents GROUP BY lang")
def review_limits(spark, d):
    """One diff a language with a file for each of its documents, reviewed up to 200 hunks."""
    i = F.col("doc_id").cast("string")
    one = F.concat(F.lit("diff --git a/d"), i, F.lit(" b/d"), i, F.lit("\n@@ -0,0 +1 @@\n+x"))
    diffs = table(spark, d, "documents").groupBy(F.col("lang").alias("diff_id")).agg(F.array_join(F.sort_array(F.collect_list(one)), "\n").alias("text"))
    _, limits = review_run.review_diffs(review.parse_diff(diffs), providers.get_provider("scripted", {}, "[]"))
    return limits.select("diff_id", "cut", "files")


@register(
    "hunk_render",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT doc_id, md5('@@ d' || doc_id || '.txt lines 1-' || max(n) || ' @@' || chr(10) || string_agg(lpad(n::VARCHAR, greatest(5, length(n::VARCHAR))::INT, ' ') || ' +' || line, chr(10) ORDER BY n)) AS diff_md5 FROM l GROUP BY doc_id""",
)
def hunk_render(spark, d):
    docs = table(spark, d, "documents")
    head = F.format_string("diff --git a/d b/d%d.txt\n--- /dev/null\n+++ b/d%d.txt\n@@ -0,0 +1,%d @@\n+", F.col("doc_id"), F.col("doc_id"), F.size(F.split("text", "\n", -1)))
    diffs = docs.select("doc_id", F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n+"))).alias("text"))
    return review.render_hunks(review.parse_diff(diffs, "doc_id"), "doc_id").select("doc_id", F.md5("diff").alias("diff_md5"))


# ------------------------------------------------------------------ reports, streams, listings


@register(
    "outcome_cells",
    f"""WITH {OUTCOMES_SQL} SELECT config, printf('%.3f', avg(recall)) AS recall, '0.500' AS mrr, coalesce(printf('%.3f', avg(accuracy)), 'n/a') AS accuracy, printf('%.0fs', sum(seconds)) AS seconds,
{", ".join(f"coalesce(printf('%.3f', avg(CASE WHEN {c} = '{v}' THEN {m} END)), 'n/a') AS {v}_{m}" for m in ("recall", "accuracy") for v, c in reports.BREAKDOWN)} FROM outcomes GROUP BY config""",
)
def outcome_cells(spark, d):
    return reports.outcome_cells(outcomes(spark, d).withColumn("rr", F.lit(0.5)))


@register("matched_answers", """WITH r AS (SELECT conv_id AS query_id, turn + 1 AS position, role AS file, (length(text) % 3)::VARCHAR AS symbol FROM conversations),
g AS (SELECT DISTINCT conv_id AS query_id, a AS answer_id, 'user' AS file, a::VARCHAR AS symbol FROM conversations, (VALUES (0), (1), (2), (3)) t(a))
SELECT g.query_id, answer_id, coalesce(min(position), 0) AS position FROM g LEFT JOIN r USING (query_id, file, symbol) GROUP BY ALL""")  # fmt: skip
def matched_answers(spark, d):
    """First position of a result for each answer (file, symbol) of a question."""
    turns = table(spark, d, "conversations")
    results = turns.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("position"), F.col("role").alias("file"), (F.length("text") % 3).cast("string").alias("symbol"))
    answer = F.explode(F.array(*[F.lit(a) for a in range(4)])).alias("answer_id")
    wanted = turns.select(F.col("conv_id").alias("query_id")).distinct().select("query_id", answer).withColumns({"file": F.lit("user"), "symbol": F.col("answer_id").cast("string")})
    return metrics.matched(results, wanted, ["file", "symbol"]).fillna(0, ["position"])


@register(
    "answer_stream",
    """WITH t AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, count(*) AS drafts, sum(n)::BIGINT AS tokens FROM t GROUP BY conv_id)
SELECT conv_id, kind, count(*)::BIGINT AS events FROM (SELECT conv_id, unnest(list_concat(['meta', 'sources', 'done'], list_transform(range(drafts), lambda x: 'stage'), list_transform(range(drafts - 1), lambda x: 'reset'), list_transform(range(tokens), lambda x: 'token'))) AS kind FROM s)
GROUP BY ALL""",
)
def answer_stream(spark, d):
    """Each assistant turn as a draft; the stream has a reset before every draft but the first."""
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    drafts = turns.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("attempt"), F.split("text", " ", -1).alias("tokens"))
    rows = drafts.groupBy("conv_id").agg(F.max("attempt").alias("attempts"))
    rows = rows.withColumns({"question": F.lit("q"), "answer": F.lit("a"), "grounded": F.lit(True), "sources": F.array(F.lit("x"))})
    return reports.answer_events(rows, drafts, "conv_id").groupBy("conv_id", "kind").agg(F.count("*").alias("events"))


@register(
    "source_listing",
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT lang, rank, printf(' %s %2d. src/d%d.md:1-9  doc d%d', CASE WHEN doc_id % 2 = 0 THEN '*' ELSE ' ' END, rank, doc_id, doc_id) AS text FROM r WHERE rank <= 8""",
)
def source_listing(spark, d):
    docs = table(spark, d, "documents").withColumn("query_id", F.col("lang"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    found = ranked(docs, 8, F.desc("n_chars"), F.asc("doc_id")).select(
        "lang", "rank", F.concat(F.lit("src/"), name, F.lit(".md")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"),
        name.alias("symbol"), F.lit("doc").alias("kind"), F.lit("Markdown").alias("language"), F.lit(0.123456).alias("score"), (F.col("doc_id") % 2 == 0).alias("even"),
    )
    sources = reports.source_rows(found, "lang")
    cited = found.filter("even").select("lang", F.concat("file_path", F.lit(":1-9")).alias("location"))
    return reports.source_listing(sources, cited, "lang")


@register(
    "accumulated_evidence",
    """WITH f AS (SELECT conv_id, length(text) % 4 AS id, turn AS attempt, 1 AS rank FROM conversations UNION ALL SELECT conv_id, length(text) % 3 + 2, turn, 2 FROM conversations),
o AS (SELECT conv_id, id, attempt, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY attempt, rank) AS nth FROM f) WHERE nth = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY attempt, rank) AS ord FROM o),
g AS (SELECT DISTINCT conv_id, a AS id FROM conversations, (VALUES (0), (3), (9)) t(a)),
m AS (SELECT g.conv_id, g.id, min(ord) AS position FROM g LEFT JOIN e USING (conv_id, id) GROUP BY ALL)
SELECT conv_id AS query_id, round(count(CASE WHEN position <= 5 THEN 1 END)::DOUBLE / count(*), 6) AS recall, round(coalesce(1.0::DOUBLE / min(position), 0), 6) AS rr FROM m GROUP BY conv_id""",
)
def accumulated_evidence(spark, d):
    """Recall and reciprocal rank over what all attempts of a request retrieved."""
    rows = table(spark, d, "conversations")
    one = rows.select("conv_id", (F.length("text") % 4).cast("long").alias("id"), F.col("turn").alias("attempt"), F.lit(1).alias("rank"))
    two = rows.select("conv_id", (F.length("text") % 3 + 2).cast("long").alias("id"), F.col("turn").alias("attempt"), F.lit(2).alias("rank"))
    evidence = agent.merge_evidence(one.union(two), "conv_id").withColumnRenamed("conv_id", "query_id")
    gold_rows = rows.select(F.col("conv_id").alias("query_id")).distinct().select("query_id", F.explode(F.array(*[F.lit(a).cast("long") for a in (0, 3, 9)])).alias("id"))
    found = metrics.score_evidence(evidence, gold_rows.withColumn("answer_id", F.col("id")), ["id"])
    return found.select("query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@register(
    "ablation_runs",
    f"WITH {SEARCH_SQL} SELECT 'vector' AS config, query_id AS question_id, rank AS position, id::VARCHAR AS answer_id FROM vec WHERE query_id % 200 <> 0 "
    "UNION ALL SELECT 'bm25', query_id, rank, id::VARCHAR FROM kw UNION ALL SELECT 'vector', doc_id, 1, 'kept' FROM hd WHERE doc_id % 200 = 0",
)
def ablation_runs(spark, d):
    """Two configurations over all questions; outcomes of one that are there already are not computed again."""
    index, questions, held = corpus(spark, d)
    asked = cut(questions).withColumnRenamed("query_id", "question_id")

    def config(name):
        def run(rows):
            found = retrieval.search_code(index, rows.withColumnRenamed("question_id", "query_id"), 20, name)
            return found.select(F.col("query_id").alias("question_id"), F.col("rank").alias("position"), F.col("id").cast("string").alias("answer_id"))

        return run

    prior = held.filter("id % 200 = 0").select(F.lit("vector").alias("config"), F.col("id").alias("question_id"), F.lit(1).alias("position"), F.lit("kept").alias("answer_id"))
    found = providers.run_ablation(asked, {"vector": config("vector"), "bm25": config("bm25")}, prior)
    return found.select("config", "question_id", "position", "answer_id")


@register(
    "chunk_headers",
    """SELECT doc_id, 'd' || doc_id || '.md:' || (doc_id % 9 + 1) || '-' || (doc_id % 9 + 4) || ' doc s' || doc_id || CASE WHEN doc_id % 3 + 1 > 1 THEN ' (part 1/' || (doc_id % 3 + 1) || ')' ELSE '' END || ' [' || lang || ']' AS header,
  source || '  ' || doc_id || ' in / ' || n_chars || ' out' AS cost FROM documents""",
)
def chunk_headers(spark, d):
    i = F.col("doc_id")
    name = i.cast("string")
    one = header(F.concat(F.lit("d"), name, F.lit(".md")), i % 9 + 1, i % 9 + 4, F.lit("doc"), F.concat(F.lit("s"), name), F.col("lang"), F.lit(1), i % 3 + 1)
    return table(spark, d, "documents").select("doc_id", one.alias("header"), cost_line(F.col("source"), i, F.col("n_chars")).alias("cost"))


@register(
    "answer_sources",
    f"""WITH {ANSWERS_SQL}, p AS (SELECT doc_id, list_distinct_ordered.c AS cited, ['src/doc' || doc_id || '.md:' || (doc_id % 7 + 1) || '-' || (doc_id % 7 + 4), 'z.py:1-2'] AS retrieved
  FROM (SELECT doc_id, list(c ORDER BY i) AS c FROM (SELECT doc_id, c, min(i) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(answer, '[\\w./\\-]+\\.\\w+:\\d+-\\d+')) AS c, unnest(range(len(regexp_extract_all(answer, '[\\w./\\-]+\\.\\w+:\\d+-\\d+')))) AS i FROM answers) GROUP BY doc_id, c) GROUP BY doc_id) list_distinct_ordered)
SELECT doc_id, array_to_string(cited, ' ') AS cited, array_to_string(list_filter(retrieved, lambda x: NOT list_contains(cited, x)), ' ') AS uncited, array_to_string(list_filter(cited, lambda x: NOT list_contains(retrieved, x)), ' ') AS unsupported FROM p""",
)
def answer_sources(spark, d):
    """What an answer cites, what it was shown and never cites, and what it cites and never was shown."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    shown = F.array(F.concat(F.lit("src/doc"), s(i), F.lit(".md:"), s(i % 7 + 1), F.lit("-"), s(i % 7 + 4)), F.lit("z.py:1-2"))
    rows = answers(spark, d).select("doc_id", cited_locations(F.col("answer")).alias("c"), shown.alias("r"))
    join = lambda c: F.array_join(c, " ")
    return rows.select("doc_id", join("c").alias("cited"), join(uncited_sources(F.col("c"), F.col("r"))).alias("uncited"), join(uncited_sources(F.col("r"), F.col("c"))).alias("unsupported"))


@register("review_lines", f"WITH {COMMENTS_SQL} SELECT diff_id, count(*) || ' comments (' || concat_ws(', ', {', '.join(f"CASE WHEN count(CASE WHEN severity = '{s}' THEN 1 END) > 0 THEN count(CASE WHEN severity = '{s}' THEN 1 END) || ' {s}' END" for s in ('blocker', 'warning', 'suggestion', 'note'))}) || ') over 9 hunks in 3 files' AS text FROM c GROUP BY diff_id")
def review_lines(spark, d):
    comments = table_comments(spark, d)
    totals = comments.select("diff_id").distinct().withColumns({"files": F.lit(3), "hunks": F.lit(9)})
    return reports.review_line(comments, totals)
