"""What models are told: texts of the roles, and the turns that are put together from rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER_RULES = """\
Answer questions about one code base from numbered excerpts of its files.

- The excerpts are all you know. Leave out what they do not show, common practice included.
- After each claim, cite its lines as `path:first-last`, copied from an excerpt's label.
- Where the excerpts do not answer, say which code is missing; half an answer with that said is fine.
- Quote only where the wording matters. Be as short as the question allows.
"""
NO_CONTEXT = "Nothing in the index answers that question."
CRITIC_RULES = """\
Check whether excerpts of code support every claim of an answer. Style and general truth do not matter.

Reply in three lines:
GROUNDED: yes|no
REASON: one sentence
QUERY: words of the code that is missing, to search for next, or NONE

An answer that admits a gap is grounded. One that describes what no excerpt shows, or cites lines that do
not hold the claim, is not.
"""
RETRY_NOTE = "\nYour last answer was not supported: {reason}\nThere may be more excerpts now. Answer again, without what they do not show.\n"
CITE_NOTE = "\nYour last answer cited nothing, so it could not be checked; its content was not found wrong. Give it again in full, each claim followed by its `path:first-last`.\n"
JUDGE_RULES = """\
Grade an answer about a code base against the code that answers the question.

Reply in two lines:
VERDICT: correct|partial|incorrect
REASON: one sentence

correct: it says what the code does and contradicts nothing. partial: some of it is missing or wrong, or it
says that it could not find out. incorrect: it describes something else or contradicts the code.
"""
SEVERITY_GUIDE = {
    "blocker": "breaks the program or loses data",
    "warning": "is probably wrong or will be",
    "suggestion": "would be clearly better another way",
    "note": "is worth knowing, nothing to do",
}
REVIEW_RULES = (
    "Review one hunk of a change, with the code around it and related code of the repository.\n"
    "Report what is wrong and can be pointed at, not style. Levels:\n"
    + "\n".join(f"- {k}: {v}" for k, v in SEVERITY_GUIDE.items())
    + '\nReply with a JSON array of {"line": number of a changed line, "severity": level, "message": text}; [] if nothing is wrong.\n'
)


def question_turn(question: Column, context: Column, excerpts: Column, note: Column | None = None) -> Column:
    """Evidence first, then what was wrong with the last attempt, the question last."""
    lead = F.concat(excerpts.cast("string"), F.lit(" excerpts of the code, most relevant first:\n\n"))
    return F.concat(lead, context, F.lit("\n\n---\n"), F.lit("") if note is None else note, F.lit("\nQuestion: "), question)


def retry_note(kind: Column, reason: Column) -> Column:
    """Nothing on a first attempt; an answer without citations is asked for those, any other for support."""
    generic = F.replace(F.lit(RETRY_NOTE), F.lit("{reason}"), F.coalesce(reason, F.lit("")))
    return F.when(F.coalesce(kind, F.lit("")) == "", "").when(kind == "no_citations", CITE_NOTE).otherwise(generic)


def critic_turn(question: Column, answer: Column, context: Column) -> Column:
    return F.concat(F.lit("Excerpts:\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question, F.lit("\n\n---\n\nAnswer to check:\n\n"), answer)


def judge_turn(question: Column, answer: Column, code: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nReference code:\n\n"), code, F.lit("\n\n---\n\nAnswer to grade:\n\n"), answer)


def review_turn(evidence: Column) -> Column:
    return F.concat(evidence, F.lit("\n\n---\n\nReview the change above."))
