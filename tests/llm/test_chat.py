import random
import zlib

import numpy as np

from lodestone.llm import chat
from tests.llm.fixtures import words


def conversations(n=120, seed=5):
    rng, rows = random.Random(seed), []
    for c in range(n):
        turn = 0
        if rng.random() < 0.3:
            rows.append((c, turn, "system", "Be brief."))
            turn += 1
        for _ in range(rng.randrange(1, 5)):
            rows.append((c, turn, "user", words(rng, rng.randrange(3, 12)) + "?"))
            rows.append((c, turn + 1, "assistant", "\n".join(words(rng, rng.randrange(20, 60)) + "." for _ in range(rng.randrange(1, 4)))))
            turn += 2
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_markers():
    cases = {"User: hi": ("user", "hi"), "### Assistant: yes": ("assistant", "yes"), "<|im_start|>system": ("system", ""), "Q: why?": ("user", "why?"), "**Human:** x": ("user", "x")}
    cases |= {"Usernames: a": (None, "Usernames: a"), "plain text": (None, "plain text"), "[AI] ok": ("assistant", "ok"), "bye<|im_end|>": (None, "bye")}
    for line, want in cases.items():
        assert chat.split_marker(line) == want, line


def test_roles_of_held_out_rows(spark, tmp_path):
    rows = conversations()
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r["conv_id"], r["turn"]): r for r in chat.query(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    held = [(found[c, t], role) for c, t, role, _ in rows if found[c, t]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k[0]).encode()) % 3 == 1) for k, r in found.items())
    assert sum(r["role_pred"] == role for r, role in held) / len(held) > 0.97


def test_marked_transcript_in_one_row(spark):
    model = chat.fit(table(spark, conversations()))
    text = "System: be kind\nUser: what is it?\nand why\nAssistant: a thing.\n\nit is so.\nUser: thanks"
    found = chat.parse_transcripts(table(spark, [(1, 0, None, text)]), model)
    row = found.select("turns", chat.render("turns", "continued").alias("out")).first()
    assert [(t["role"], t["text"]) for t in row["turns"]] == [
        ("system", "be kind"), ("user", "what is it?\nand why"), ("assistant", "a thing.\n\nit is so."), ("user", "thanks"),
    ]
    assert row["out"].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\n") and row["out"].count("<|im_start|>") == 4


def test_chunks_equal_one_pass(spark):
    model = chat.fit(table(spark, conversations()))
    rng = random.Random(2)
    rows = []
    for t in range(300):
        role = "user" if t % 2 == 0 else "assistant"
        rows.append((7, t, role, words(rng, 6) + "?" if role == "user" else "\n".join(words(rng, 20) + "." for _ in range(2))))
    rows += [(c, t, None, words(rng, 5)) for c in range(20, 26) for t in range(3)]
    whole = chat.parse_transcripts(table(spark, rows), model).collect()
    small = chat.parse_transcripts(table(spark, rows), model, chunk_lines=7).collect()
    key = lambda found: sorted((r["conv_id"], r["turn"], r["continued"], str(r["turns"])) for r in found)
    assert key(whole) == key(small) and len(whole) == len(rows)
    lines = [x for r in rows[:300] for x in chat.observe(r[3])]
    states = model.decode(lines)
    at, want = 0, {}
    for r in rows[:300]:
        want[r[1]] = chat._turns(r[3], states[at : at + len(chat.observe(r[3]))], model.roles)
        at += len(chat.observe(r[3]))
    for r in whole:
        if r["conv_id"] == 7:
            assert [(t["role"], t["text"]) for t in r["turns"]] == [(t["role"], t["text"]) for t in want[r["turn"]]]


def test_viterbi_equals_brute_force(spark):
    import itertools

    model = chat.fit(table(spark, conversations(30)))
    rng = random.Random(1)
    for _ in range(10):
        lines = [x for _ in range(2) for x in chat.observe(words(rng, rng.randrange(1, 30)) + rng.choice(["?", ".", "\nmore"]))][:4]
        e = [model.emission(x) for x in lines]

        def score(path, e=e):
            s = model.start[path[0]] + e[0][path[0]]
            for i in range(1, len(path)):
                s += model.move[path[i - 1], path[i]] + e[i][path[i]]
            return s

        best = max(score(p) for p in itertools.product(range(6), repeat=len(lines)))
        assert np.isclose(score(model.decode(lines)), best)


def test_messy_and_empty(spark):
    model = chat.fit(table(spark, conversations(20)))
    rows = [(None, 0, None, None), (1, None, "user", ""), (1, 0, "x", "a\n" * 5000), (1, 0, "user", "hi"), (1, 0, "user", "hi")]
    assert chat.parse_transcripts(table(spark, rows), model).count() == 5
    assert chat.parse_transcripts(table(spark, []), model).count() == 0
    none = chat.fit(table(spark, []))
    assert chat.parse_transcripts(table(spark, rows), none).count() == 5
