"""Queries: citations, evidence, critique rules, attempts, prompts, judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import citation_file, citations
from lodestone.operators import agent, judge
from lodestone.plans.registry import register, table

# Answers made from the documents: each cites one place twice, another in prose style, and a third only sometimes.
ANSWERS_SQL = """
answers AS (SELECT doc_id, 'See src/doc' || doc_id || '.md:' || (doc_id % 7 + 1) || '-' || (doc_id % 7 + 4) || ' and `my docs/doc' || (doc_id % 5) || '.md:2-3` then src/doc'
  || doc_id || '.md:' || (doc_id % 7 + 1) || '-' || (doc_id % 7 + 4) || '.' || CASE WHEN doc_id % 3 = 0 THEN ' Also other' || doc_id || '.py:10-20' ELSE '' END AS answer FROM documents)"""


def answers(spark, d):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    place = F.concat(F.lit("src/doc"), s(i), F.lit(".md:"), s(i % 7 + 1), F.lit("-"), s(i % 7 + 4))
    text = F.concat(
        F.lit("See "), place, F.lit(" and `my docs/doc"), s(i % 5), F.lit(".md:2-3` then "), place, F.lit("."),
        F.when(i % 3 == 0, F.concat(F.lit(" Also other"), s(i), F.lit(".py:10-20"))).otherwise(""),
    )
    return table(spark, d, "documents").select("doc_id", text.alias("answer"))


CITED_SQL = """
ticked AS (SELECT doc_id, unnest(regexp_extract_all(answer, '`([^`:\\n]+\\.\\w{1,6}:\\d+-\\d+)`', 1)) AS c FROM answers),
bare AS (SELECT doc_id, unnest(regexp_extract_all(answer, '[\\w./\\-]+\\.\\w+:\\d+-\\d+')) AS c FROM answers),
cited AS (SELECT DISTINCT doc_id, c FROM (SELECT * FROM ticked UNION ALL
  SELECT b.* FROM bare b WHERE NOT EXISTS (SELECT 1 FROM ticked t WHERE t.doc_id = b.doc_id AND ends_with(t.c, b.c))))"""


@register("citation_extract", f"WITH {ANSWERS_SQL}, {CITED_SQL} SELECT doc_id, c AS citation, regexp_extract(c, '^(.*):\\d+-\\d+$', 1) AS file FROM cited")
def citation_extract(spark, d):
    c = F.col("citation")
    return answers(spark, d).select("doc_id", F.explode(citations(F.col("answer"))).alias("citation")).select("doc_id", "citation", citation_file(c).alias("file"))


@register(
    "citation_except",
    f"""WITH {ANSWERS_SQL}, {CITED_SQL},
ev AS (SELECT doc_id, 'src/doc' || doc_id || '.md:' || (doc_id % 2 + 1) || '-' || (doc_id % 2 + 4) AS p FROM documents)
SELECT e.doc_id, (SELECT count(*) FROM cited c WHERE c.doc_id = e.doc_id AND c.c <> e.p) AS unsupported, NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = e.doc_id AND c.c = e.p) AS uncited FROM ev e""",
)
def citation_except(spark, d):
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    place = F.concat(F.lit("src/doc"), s(i), F.lit(".md:"), s(i % 2 + 1), F.lit("-"), s(i % 2 + 4))
    cited = citations(F.col("answer"))
    return answers(spark, d).select(
        "doc_id", F.size(F.array_except(cited, F.array(place))).cast("long").alias("unsupported"), (F.size(F.array_except(F.array(place), cited)) > 0).alias("uncited")
    )


EVIDENCE_SQL = "ev AS (SELECT doc_id, 'lib/doc' || doc_id || '.md' AS file, 5 AS s, 9 AS e FROM documents UNION ALL SELECT doc_id, 'my docs/doc0.md', 1, 2 FROM documents)"


def evidence(spark, d):
    docs = table(spark, d, "documents")
    own = docs.select("doc_id", F.concat(F.lit("lib/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.lit(5).alias("start"), F.lit(9).alias("end"))
    return own.union(docs.select("doc_id", F.lit("my docs/doc0.md"), F.lit(1), F.lit(2)))


@register(
    "citation_overlap",
    f"""WITH {ANSWERS_SQL}, {CITED_SQL}, {EVIDENCE_SQL},
p AS (SELECT doc_id, c, lower(regexp_extract(c, '([^/]*):\\d+-\\d+$', 1)) AS base, regexp_extract(c, ':(\\d+)-\\d+$', 1)::INT AS a, regexp_extract(c, ':\\d+-(\\d+)$', 1)::INT AS b FROM cited)
SELECT doc_id, c AS citation FROM p WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.doc_id = p.doc_id AND lower(regexp_extract(ev.file, '([^/]*)$', 1)) = p.base AND p.a <= ev.e AND p.b >= ev.s)""",
)
def citation_overlap(spark, d):
    """Citations that no evidence of the request overlaps: range anti join on the file's name."""
    cited = agent.cited_ranges(answers(spark, d), "doc_id", "answer")
    return agent.unsupported_citations(cited, evidence(spark, d), "doc_id").select("doc_id", "citation")


PROSE = [
    (1, "the `_verify.js` file, line 1-14 does it"),
    (2, "see lines 444-449 of `PLI Website Dev.md` for this"),
    (3, "README.md, lines 68-80 and nothing more"),
    (4, "no reference at all, just lines 3-4"),
]


@register("loose_citations", "SELECT * FROM (VALUES (1, '_verify.js', 1, 14), (2, 'PLI Website Dev.md', 444, 449), (3, 'README.md', 68, 80)) t(id, file, \"start\", \"end\")")
def loose_citations(spark, d):
    rows = spark.createDataFrame(PROSE, "id int, answer string")
    return rows.select("id", F.explode(agent.loose_citations(F.col("answer"))).alias("c")).select("id", "c.file", "c.start", "c.end")


@register(
    "reflect_verdict",
    """WITH a AS (SELECT conv_id, turn, text, turn % 3 AS evidence, CASE WHEN conv_id % 2 = 0 THEN [] ELSE ['x.py:1-2'] END AS cited, conv_id % 5 = 0 AS checkable,
  CASE WHEN conv_id % 4 = 1 THEN ['a/b.py:1-2', 'c.js:3-4'] ELSE [] END AS unsupported FROM conversations),
k AS (SELECT *, CASE WHEN evidence = 0 THEN 'no_evidence' WHEN len(cited) = 0 AND NOT checkable AND length(text) >= 200 THEN 'no_citations' WHEN len(unsupported) > 0 THEN 'fabricated' END AS kind FROM a)
SELECT conv_id, turn, kind, CASE WHEN kind = 'fabricated' THEN 'b c.js' ELSE '' END AS followup FROM k""",
)
def reflect_verdict(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("answer"),
        (F.col("turn") % 3).alias("evidence"),
        F.when(F.col("conv_id") % 2 == 0, none).otherwise(F.array(F.lit("x.py:1-2"))).alias("cited"),
        (F.col("conv_id") % 5 == 0).alias("checkable"),
        F.when(F.col("conv_id") % 4 == 1, F.array(F.lit("a/b.py:1-2"), F.lit("c.js:3-4"))).otherwise(none).alias("unsupported"),
    )
    return agent.verdict(rows).select("conv_id", "turn", "kind", "followup")


ATTEMPTS_SQL = """
att AS (SELECT conv_id, turn AS attempt, text AS answer, (['', 'critic', 'no_citations', 'fabricated', 'no_evidence'])[(length(text) % 5) + 1] AS kind FROM conversations)"""


def attempts(spark, d):
    kinds = F.array(*[F.lit(k) for k in agent.SEVERITY])
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", F.col("turn").alias("attempt"), F.col("text").alias("answer"), F.element_at(kinds, F.length("text") % 5 + 1).alias("kind"))


@register(
    "should_retry",
    f"""WITH {ATTEMPTS_SQL}, u AS (SELECT *, sum((kind = 'no_citations')::INT) OVER (PARTITION BY conv_id ORDER BY attempt) AS uncited FROM att)
SELECT conv_id, attempt, CASE WHEN kind = '' THEN 'end' WHEN attempt + 1 >= 3 THEN 'end' WHEN kind = 'no_evidence' AND attempt = 0 THEN 'end' WHEN kind = 'no_citations' AND uncited >= 2 THEN 'end'
  WHEN kind <> 'fabricated' AND kind <> 'no_evidence' THEN 'rewrite' ELSE 'search' END AS decision FROM u""",
)
def should_retry(spark, d):
    rows = attempts(spark, d).withColumns(
        {
            "grounded": F.col("kind") == "",
            "attempts": F.col("attempt") + 1,
            "followup": F.when(F.col("kind") == "fabricated", "x").otherwise(""),
            "evidence": F.when(F.col("kind") == "no_evidence", 0).otherwise(3),
            "queries": F.col("attempt"),
            "uncited": agent.uncited_so_far("conv_id", "attempt"),
        }
    )
    return rows.select("conv_id", "attempt", agent.decision().alias("decision"))


@register(
    "least_bad",
    f"""WITH {ATTEMPTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY list_position(['', 'critic', 'no_citations', 'fabricated', 'no_evidence'], kind), length(answer) DESC, attempt DESC) AS nth FROM att)
SELECT conv_id, attempt, kind FROM r WHERE nth = 1""",
)
def least_bad(spark, d):
    return agent.least_bad(attempts(spark, d), "conv_id").select("conv_id", "attempt", "kind")


@register(
    "evidence_merge",
    """WITH f AS (SELECT conv_id, length(text) % 4 AS id, turn AS attempt, 1 AS rank FROM conversations UNION ALL SELECT conv_id, length(text) % 3 + 2, turn, 2 FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY attempt, rank) AS nth FROM f)
SELECT conv_id, id, attempt, rank, row_number() OVER (PARTITION BY conv_id ORDER BY attempt, rank) AS ord FROM o WHERE nth = 1""",
)
def evidence_merge(spark, d):
    rows = table(spark, d, "conversations")
    one = rows.select("conv_id", (F.length("text") % 4).cast("long").alias("id"), F.col("turn").alias("attempt"), F.lit(1).alias("rank"))
    two = rows.select("conv_id", (F.length("text") % 3 + 2).cast("long").alias("id"), F.col("turn").alias("attempt"), F.lit(2).alias("rank"))
    return agent.merge_evidence(one.union(two), "conv_id").select("conv_id", "id", "attempt", "rank", "ord")


@register(
    "evidence_pack",
    """WITH r AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT lang, rank, '[' || rank || '] src/doc' || doc_id || '.md:1-9  doc d' || doc_id || '  (' || lang || ')' || chr(10) || '```' || chr(10) ||
  CASE WHEN length(text) > 3000 THEN left(text, 3000) || chr(10) || '… [truncated for length]' ELSE text END || chr(10) || '```' AS block FROM r WHERE rank <= 8)
SELECT lang, count(*) AS excerpts, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM b GROUP BY lang""",
)
def evidence_pack(spark, d):
    from lodestone.operators.bm25 import ranked

    docs = table(spark, d, "documents").withColumn("query_id", F.col("lang"))
    name = F.col("doc_id").cast("string")
    rows = ranked(docs, 8, F.desc("n_chars"), F.asc("doc_id")).select(
        F.col("lang"),
        "rank",
        F.concat(F.lit("src/doc"), name, F.lit(".md:1-9")).alias("place"),
        F.lit("doc").alias("kind"),
        F.concat(F.lit("d"), name).alias("symbol"),
        F.col("lang").alias("language"),
        F.col("text").alias("code"),
    )
    return agent.evidence_pack(rows, "lang").select("lang", "excerpts", F.md5("context").alias("context_md5"))


CRITIC_REPLIES = [
    (1, "GROUNDED: yes\nREASON: fine\nQUERY: NONE"),
    (2, "grounded: No, not at all\nReason: missing code\nQuery: parse_jwt"),
    (3, "nonsense without any form"),
    (4, "GROUNDED: no\nREASON: x\nQUERY: none"),
]


@register("critic_parse", "SELECT * FROM (VALUES (1, true, 'fine', ''), (2, false, 'missing code', 'parse_jwt'), (3, true, '', ''), (4, false, 'x', '')) t(id, grounded, reason, followup)")
def critic_parse(spark, d):
    parsed = agent.parse_critic(F.col("reply"))
    return spark.createDataFrame(CRITIC_REPLIES, "id int, reply string").select("id", *[parsed[c].alias(c) for c in ("grounded", "reason", "followup")])


@register(
    "judge_citation",
    f"""WITH {ANSWERS_SQL}, {CITED_SQL}, g AS (SELECT doc_id, 'src/doc' || (CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 ELSE doc_id END) || '.md' AS file, CASE WHEN doc_id % 8 = 0 THEN 'K.my' ELSE 'K.absent' END AS symbol FROM documents)
SELECT g.doc_id, CASE WHEN EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = g.doc_id AND starts_with(c.c, g.file || ':')) THEN 1.0::DOUBLE
  WHEN contains(answer, split_part(symbol, '.', 2)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM g JOIN answers USING (doc_id)""",
)
def judge_citation(spark, d):
    i = F.col("doc_id")
    file = F.concat(F.lit("src/doc"), F.when(i % 4 == 0, i + 1).otherwise(i).cast("string"), F.lit(".md"))
    symbol = F.when(i % 8 == 0, "K.my").otherwise("K.absent")
    return answers(spark, d).select("doc_id", judge.citation_score(F.col("answer"), file, symbol).alias("score"))


@register("agent_loop", "SELECT * FROM (VALUES (1, true, 1), (2, true, 2), (3, false, 2), (4, false, 3)) t(query_id, grounded, attempts)")
def agent_loop(spark, d):
    """The bounded loop with a scripted provider: answered, corrected, never cited, nothing found."""
    asked = spark.createDataFrame([(1, "good"), (2, "fixes itself"), (3, "never cites"), (4, "nothing")], "query_id int, question string")

    def retrieve(rows):
        found = rows.filter("query_id <> 4").select("query_id", F.lit("c1").alias("id"), F.lit(1).alias("rank"), F.lit("src/a.py").alias("file"))
        return found.withColumns({"start": F.lit(1), "end": F.lit(9), "block": F.lit("[1] src/a.py:1-9")})

    def generate(rows):
        long = F.repeat(F.lit("x "), 150)
        good = F.lit("see src/a.py:2-3")
        return rows.withColumn("answer", F.when(F.col("query_id") == 1, good).when((F.col("query_id") == 2) & (F.col("note") != ""), good).otherwise(long))

    return agent.run_agent(asked, retrieve, generate).select("query_id", "grounded", "attempts")
