"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

Each line of a transcript is one step of the model.  Hidden states are the roles, each as
the start of a turn or inside one.  Observations are the speaker marker at the line's start
(``User:``, ``### Assistant``, ``<|im_start|>system``, ``Q:`` ...) and features of the line:
whether a row of the table begins there, its length, punctuation, and the length of the row.
Start, transition and observation probabilities are counted on rows with a known role; the
markers also have prior counts.  Viterbi finds the most likely roles of a whole transcript;
the turns are then rendered in one form, markers removed.

A transcript of any length is decoded in chunks: the best scores between every pair of
states across a chunk form a matrix; the matrices of a transcript, joined by max and plus,
give the states at the chunks' edges; each chunk is then decoded between its edges.  That
equals one pass over the whole, so a transcript with a third of all lines is no single task's.

Defined results
---------------
* Null or empty text is one empty line.  A null id is a transcript of its own.
* Lines of a transcript are taken by turn, then text; repeated rows follow each other.
* A row's lines may hold several turns, by markers; a row whose first line goes on with the
  turn before it is marked ``continued`` and rendered without an opening.
* Without any row of known role, all lines are a user's.
* An empty table gives an empty result.

Scale: one range shuffle by (transcript, turn); per transcript that spans chunks, one matrix
a chunk of ``CHUNK_LINES`` lines meets in a task.  The model has a few hundred numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.language import remainder
from lodestone.llm.shared import cut, table

ROLES = ("system", "user", "assistant")
CHUNK_LINES = 20_000
SMOOTH = 0.5
#: How many observations the rates over all states weigh in each state's, by feature; markers have counts of their own.
LEAN = (0.0, 0.01, 5.0, 5.0, 5.0, 5.0)
MARKER_PRIOR = 50.0

#: Names that speaker markers use, by role.
NAMES = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model", "agent"),
}
ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_NAME = "|".join(sorted(ROLE_OF, key=len, reverse=True))
MARKER = re.compile(
    rf"^\s*(?:<\|(?:im_start\|>)?\s*({_NAME})\s*(?:\|>)?\s*|\[({_NAME})\]\s*:?\s*|(?:\#{{1,6}}\s*|\*{{1,2}}|>\s*)?({_NAME})\s*(?:\*{{1,2}})?\s*:(?:\*{{1,2}})?\s*|\#{{2,6}}\s*({_NAME})\s*$)",
    re.IGNORECASE,
)
END = re.compile(r"\s*<\|(?:im_end|end|eot)\|>\s*$")


def split_marker(line: str) -> tuple[str | None, str]:
    """(role of the speaker marker or None, the line without it)."""
    m = MARKER.match(line)
    if not m:
        return None, END.sub("", line)
    return ROLE_OF[next(g for g in m.groups() if g).lower()], END.sub("", line[m.end() :])


def size_class(n: int) -> int:
    return min(15, n.bit_length())


def observe(text: str | None) -> list[tuple]:
    """Features of each line of a row: marker, whether a row begins, the row's length and lines, own length, signs.

    Inside a row, a line with a marker says nothing by its row: None there fits every state alike.
    """
    lines = (text or "").split("\n")
    whole, many = size_class(len(text or "") * len(text or "")), min(6, len(lines))
    out = []
    for i, line in enumerate(lines):
        role, rest = split_marker(line)
        rest = rest.rstrip()
        sign = rest[-1] if rest and not rest[-1].isalnum() else "-"
        row = (None, None, None) if role and i else (i == 0, whole, many)
        out.append((role, *row, size_class(len(rest)), (sign in "?!:", "?" in rest, rest == "")))
    return out



class Model:
    """Log probabilities: states are role * 2 (turn starts here) and role * 2 + 1 (turn goes on)."""

    def __init__(self, first: Counter, moves: Counter, seen: Counter, roles=ROLES):
        n = 2 * len(roles)
        self.roles = roles
        start = np.array([first[s] + SMOOTH if s % 2 == 0 else 0 for s in range(n)], float)
        move = np.array([[moves[a, b] + SMOOTH if b % 2 == 0 or b // 2 == a // 2 else 0 for b in range(n)] for a in range(n)], float)
        with np.errstate(divide="ignore"):
            self.start = np.log(start / start.sum())
            self.move = np.log(move / move.sum(axis=1, keepdims=True))
        seen = Counter(seen)
        for s in range(n):  # a marker opens its role's turn; no marker is usual anywhere
            for i, r in enumerate(roles):
                seen[s, 0, r] += MARKER_PRIOR if s == 2 * i else MARKER_PRIOR / 1000
            seen[s, 0, None] += MARKER_PRIOR
        totals, everywhere = Counter(), Counter()
        for (s, f, v), c in seen.items():
            totals[s, f] += c
            totals[f] += c
            everywhere[f, v] += c
        # a state's rates lean on the rates over all states; a value never seen fits every state alike
        self.table = {
            (f, v): np.log([(seen[s, f, v] + LEAN[f] * c / totals[f]) / (totals[s, f] + LEAN[f]) for s in range(n)])
            for (f, v), c in everywhere.items()
        }
        self.rare = np.zeros(n)

    def emission(self, line: tuple) -> np.ndarray:
        return sum(self.table.get((f, v), self.rare) for f, v in enumerate(line) if f == 0 or v is not None)

    def matrix(self, lines: list[tuple], first: bool) -> np.ndarray:
        """Best scores from the state before the lines to each state at their end; row 0 alone, if they open the transcript."""
        if first:
            now = (self.start + self.emission(lines[0]))[None, :]
            rest = lines[1:]
        else:
            now = self.move + self.emission(lines[0])[None, :]
            rest = lines[1:]
        for line in rest:
            now = (now[:, :, None] + self.move[None]).max(axis=1) + self.emission(line)[None, :]
        return now

    def decode(self, lines: list[tuple], before: int | None = None, last: int | None = None) -> list[int]:
        """The best states of the lines, given the state before them and the state of the last one, where known."""
        now = (self.start if before is None else self.move[before]) + self.emission(lines[0])
        back = []
        for line in lines[1:]:
            ways = now[:, None] + self.move
            back.append(ways.argmax(axis=0))
            now = ways.max(axis=0) + self.emission(line)
        state = int(now.argmax()) if last is None else last
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def fit(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Counts over rows of known role; a row is one turn, and follows its transcript's turn before it.

    Rows are dealt by transcript and turn, so that one long transcript is many tasks'; what stands before a
    task's first row is looked up among the last rows of all tasks.
    """
    from pyspark import TaskContext

    known = rows.filter(F.lower(F.col(role_col)).isin(*ROLES))
    ids = {r: i for i, r in enumerate(ROLES)}
    known = known.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.lower(role_col).alias("role"), F.col(text_col).alias("text"))
    known = cut(known.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if len(batch):
                last = batch.iloc[-1:]
        if last is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "conv": last["conv"].to_numpy(), "role": last["role"].to_numpy()})

    lasts = sorted((r["part"], r["conv"], r["role"]) for r in known.select("conv", "role").mapInPandas(ends, "part int, conv string, role string").collect())  # one a task
    following = {part: (conv, role) for (_, conv, role), (part, *_) in zip(lasts, lasts[1:], strict=False)}

    def with_prior(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = following.get(TaskContext.get().partitionId(), (None, None))
        for batch in batches:
            conv = batch["conv"].to_numpy(object)
            convs, roles = np.append([before[0]], conv[:-1]), np.append([before[1]], batch["role"].to_numpy(object)[:-1])
            if len(batch):
                before = conv[-1], batch["role"].iloc[-1]
            same = np.array([x is not None and x == y for x, y in zip(convs, conv, strict=True)], bool)
            nothing = np.array([x is None and y is None for x, y in zip(convs, conv, strict=True)], bool) & np.array([r is not None for r in roles[: len(conv)]], bool)
            yield pd.DataFrame({"role": batch["role"], "text": batch["text"], "prior": np.where(same | nothing, roles[: len(conv)], None)})

    pairs = known.mapInPandas(with_prior, "role string, text string, prior string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c: Counter = Counter()
            for role, text, prior in zip(batch["role"], batch["text"], batch["prior"], strict=True):
                r = ids[role]
                for i, line in enumerate(observe(text)):
                    s = 2 * r + (i > 0)
                    if i == 0 and prior is None:
                        c["first", s] += 1
                    elif i < 2:
                        # the turn before may have ended on its first line or on a later one: both lead here
                        for before in ((2 * r,) if i else (2 * ids[prior], 2 * ids[prior] + 1)):
                            c["move", before, s] += 1
                    else:
                        c["move", s, s] += 1
                    for f, v in enumerate(line):
                        if f == 0 or v is not None:
                            c["seen", s, f, v] += 1
            yield pd.DataFrame({"what": [repr(k) for k in c], "n": list(c.values())})

    import ast

    first, moves, seen = Counter(), Counter(), Counter()
    for r in pairs.mapInPandas(run, "what string, n long").groupBy("what").agg(F.sum("n").alias("n")).toLocalIterator():
        kind, *rest = ast.literal_eval(r["what"])
        if kind == "first":
            first[rest[0]] += r["n"]
        elif kind == "move":
            moves[rest[0], rest[1]] += r["n"]
        else:
            seen[rest[0], rest[1], rest[2]] += r["n"]
    if not first:
        first[2] += 1
    return Model(first, moves, seen)


# ------------------------------------------------------------------ decoding


def _chunked(rows: DataFrame, chunk_lines: int) -> DataFrame:
    """Rows in order, with the chunk (part, nth) of their transcript they belong to; a chunk is never split over tasks."""
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        current, nth, used, place = object(), 0, 0, 0
        for batch in batches:
            nths, places = [], []
            for key, text in zip(batch["conv_key"], batch["text"], strict=True):
                lines = (text or "").count("\n") + 1
                if key != current:
                    current, nth, used = key, 0, 0
                elif used + lines > chunk_lines:
                    nth, used = nth + 1, 0
                used += lines
                place += 1
                nths.append(nth)
                places.append(place)
            yield batch.assign(part=np.int32(part), nth=np.array(nths, "int32"), place=np.array(places, "int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", part int, nth int, place long"
    ordered = rows.repartitionByRange("conv_key", "turn_key", "text").sortWithinPartitions("conv_key", "turn_key", "text")
    return ordered.mapInPandas(run, schema)


def parse_transcripts(
    rows: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", chunk_lines: int = CHUNK_LINES
) -> DataFrame:
    """conv_id, turn, continued, turns: array of (role, text) that each row's lines hold."""
    conv_kind, turn_kind = rows.schema[conv_col].dataType.simpleString(), rows.schema[turn_col].dataType.simpleString()
    keyed = rows.select(
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv_key"),
        F.coalesce(F.col(turn_col).cast("double"), F.lit(-1.0)).alias("turn_key"),
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    held = rows.sparkSession.sparkContext.broadcast(model)
    chunks = cut(_chunked(keyed, chunk_lines))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        """The rows of each chunk, which lie together."""
        key, kept = None, []
        for batch in batches:
            for k, group in batch.groupby(["conv_key", "part", "nth"], sort=False):
                if k != key and kept:
                    yield key, pd.concat(kept)
                    kept = []
                key = k
                kept.append(group)
        if kept:
            yield key, pd.concat(kept)

    # transcripts of several chunks: where each chunk begins and ends
    sizes = chunks.groupBy("conv_key", "part", "nth").agg(F.count("*").alias("rows"))
    several = sizes.groupBy("conv_key").agg(F.count("*").alias("chunks")).filter("chunks > 1").select("conv_key")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv, part, nth), group in parts(batches):
            lines = [x for text in group["text"] for x in observe(text)]
            m = [held.value.matrix(lines, first).ravel().tolist() for first in (True, False)]
            yield pd.DataFrame([(conv, part, nth, *m)], columns=["conv_key", "part", "nth", "opening", "inner"])

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "nth"])
        states = len(held.value.roles) * 2
        score, backs = np.array(group["opening"].iloc[0]), []
        for inner in group["inner"].iloc[1:]:
            ways = score[:, None] + np.array(inner).reshape(states, states)
            backs.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        state = int(score.argmax())
        last = [state]
        for b in reversed(backs):
            state = int(b[state])
            last.append(state)
        last = last[::-1]
        return group[["conv_key", "part", "nth"]].assign(before=[-1, *last[:-1]], last=last)

    within = chunks.join(several, "conv_key", "left_semi").sortWithinPartitions("conv_key", "part", "nth", "place")
    kinds = "conv_key string, part int, nth int"
    found = within.select("conv_key", "part", "nth", "text").mapInPandas(matrices, f"{kinds}, opening array<double>, inner array<double>")
    bounds = cut(found.groupBy("conv_key").applyInPandas(edges, f"{kinds}, before int, last int"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in parts(batches):
            seen = [observe(text) for text in group["text"]]
            before, last = group["before"].iloc[0], group["last"].iloc[0]
            before = None if pd.isna(before) or before < 0 else int(before)
            last = None if pd.isna(last) else int(last)
            states = held.value.decode([x for row in seen for x in row], before, last)
            turns, continued, at = [], [], 0
            for text, row in zip(group["text"], seen, strict=True):
                own = states[at : at + len(row)]
                at += len(row)
                continued.append(bool(own[0] % 2))
                turns.append(_turns(text, own, held.value.roles))
            yield pd.DataFrame({"conv_id": group["conv_id"], "turn": group["turn"], "continued": continued, "turns": turns})

    whole = chunks.join(bounds, ["conv_key", "part", "nth"], "left").sortWithinPartitions("conv_key", "part", "nth", "place")
    columns = ["conv_key", "part", "nth", "conv_id", "turn", "text", "before", "last"]
    return whole.select(*columns).mapInPandas(
        decode, f"conv_id {conv_kind}, turn {turn_kind}, continued boolean, turns array<struct<role:string,text:string>>"
    )


def _turns(text: str, states: list[int], roles) -> list[dict]:
    out: list[dict] = []
    for line, state in zip(text.split("\n"), states, strict=True):
        body = split_marker(line)[1] if state % 2 == 0 else END.sub("", line)
        if not out or state % 2 == 0:
            out.append({"role": roles[state // 2], "text": body})
        else:
            out[-1]["text"] += "\n" + body
    return [{"role": t["role"], "text": t["text"].strip()} for t in out]


def render(turns_col: str, continued_col: str):
    """Canonical text of a row's turns: ``<|im_start|>role``, the text, ``<|im_end|>``."""
    one = F.transform(
        turns_col,
        lambda t, i: F.concat(
            F.when(F.col(continued_col) & (i == 0), "").otherwise(F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"))), t["text"], F.lit("<|im_end|>\n")
        ),
    )
    return F.array_join(one, "")


def query(spark, sf_dir):
    """Each conversation row with the role that the model finds from its text alone, rendered."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    held_out = F.coalesce(remainder("conv_id", 3) == 1, F.lit(False))
    model = fit(rows.filter(~held_out))
    found = parse_transcripts(rows, model)
    return found.select(
        "conv_id", "turn", held_out.alias("held_out"), F.col("turns")[0]["role"].alias("role_pred"), F.size("turns").alias("turns"), "continued",
        render("turns", "continued").alias("rendered"),
    )
