import random

import pytest

from lodestone.operators import chunking, syntax
from lodestone.plans.languages import SAMPLES
from lodestone.sources.languages import LANGUAGES


def chunks(path, source):
    return chunking.chunk_source(source, path, LANGUAGES["." + path.rsplit(".", 1)[1]])


@pytest.mark.parametrize(("name", "path", "source", "want"), SAMPLES, ids=[s[0] for s in SAMPLES])
def test_symbols_and_lines(name, path, source, want):
    found = chunks(path, source)
    assert [(c[3], c[4], c[5], c[6]) for c in found] == want
    assert {c[1] for c in found} == {LANGUAGES["." + path.rsplit(".", 1)[1]]} and all(c[7] == c[8] == 1 for c in found)


def covers(source, found):
    held = {n for c in found for n in range(c[5], c[6] + 1)}
    return all(i in held for i, line in enumerate(source.replace("\r\n", "\n").split("\n"), 1) if line.strip())


@pytest.mark.parametrize(("name", "path", "source", "want"), SAMPLES, ids=[s[0] for s in SAMPLES])
def test_broken_files_lose_no_line(name, path, source, want):
    rng = random.Random(name)
    for _ in range(150):
        text = source
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("{}()[];\"'`/*#<>=\n") + text[at:], text[:at], text[at:]]) or "x"
        assert covers(text, chunks(path, text)), text


def test_every_language_is_read():
    for language in set(LANGUAGES.values()) - {"Python"}:
        assert syntax.spans_of("", language) == ([], [])
    with pytest.raises(syntax.UnknownLanguageError):
        syntax.spans_of("", "COBOL")


def test_long_files_take_linear_time():
    import time

    for _, path, source, _ in SAMPLES:
        text = source * (400_000 // len(source))
        began = time.time()
        assert len(chunks(path, text)) > 1000, path
        assert time.time() - began < 20, path


def test_go_types_in_a_group_and_aliases():
    found = chunks("a.go", "package a\n\ntype (\n\tA struct{ x int }\n\tB int\n)\n\ntype C = A\n")
    assert [(c[3], c[4], c[5], c[6]) for c in found] == [("<module>", "module", 1, 1), ("A", "type", 3, 6), ("<module>", "module", 8, 8)]


def test_functions_in_calls_and_objects():
    text = "module.exports = {\n  run() { return 1; },\n  later: async (x) => {\n    return x;\n  },\n};\n\nif (on) {\n  function inner() {}\n}\n"
    found = {(c[3], c[5], c[6]) for c in chunks("a.js", text) if c[4] == "function"}
    assert found == {("run", 2, 2), ("<anonymous>", 3, 5), ("inner", 9, 10)}
