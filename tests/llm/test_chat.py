import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import chat

CONV = "conv_id long, turn long, role string, text string, key string, transcript string, lines string"


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", "t", "l") for r in rows], CONV)


def test_viterbi_finds_the_likeliest_path():
    rng = np.random.default_rng(4)
    n = len(chat.STATES)
    log = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), s[:-1] or None))
    model = chat.Hmm(log(n), log(n, n), log(n, chat.N_MARKERS), log(n, chat.N_SHAPES))
    seen = [(rng.integers(0, chat.N_MARKERS, k), rng.integers(0, chat.N_SHAPES, k)) for k in (1, 4, 0, 3, 4)]

    def score(path, marks, shapes):
        total = model.start[path[0]]
        for t, s in enumerate(path):
            total += model.marks[s, marks[t]] + model.shapes[s, shapes[t]] + (model.step[path[t - 1], s] if t else 0)
        return total

    for (marks, shapes), path in zip(seen, model.decode(seen), strict=True):
        if len(marks):
            best = max(score(p, marks, shapes) for p in itertools.product(range(n), repeat=len(marks)))
            assert np.isclose(score(path, marks, shapes), best)
        else:
            assert len(path) == 0


def test_roles_are_recovered(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    truth = {}
    for r in talks.orderBy("conv_id", "turn").collect():
        truth.setdefault(r["conv_id"], []).append(r["role"])
    found = {r["conv_id"]: r["roles"] for r in chat.format_chats(talks).collect()}
    assert set(found) == set(truth)
    assert np.mean([found[c] == truth[c] for c in truth]) > 0.9


def test_held_out_transcripts(spark):
    transcripts = chat.to_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    model = chat.learn(transcripts.where("xxhash64(conv_id, 1) % 2 = 0"))
    right = every = 0
    for r in transcripts.where("xxhash64(conv_id, 1) % 2 <> 0").collect():
        _, marks, shapes, _ = chat._observe(r["transcript"])
        states = model.decode([(marks, shapes)])[0]
        right += int((np.array(r["lines"]) // 2 == states // 2).sum())
        every += len(states)
    assert right / every > 0.9


def test_rendering():
    assert chat.render([("user", "hi"), ("assistant", "yo")]) == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n"
    assert chat.marker("User: x") == (1, 6) and chat.marker("plain text") == (3, 0) and chat.marker("### Answer") == (2, 10)


def test_irregular_rows(spark):
    rows = [(1, 0, "user", "a?"), (1, 1, "assistant", "b\nc"), (1, 1, "assistant", "b\nc"), (2, None, None, None), (2, 1, "critic", ""), (3, 0, "USER", "x " * 50_000), (None, 0, "user", "z"), (4, 0, "user", None), (5, 0, "user", "")]
    found = {r["conv_id"]: r for r in chat.format_chats(_conversations(spark, rows)).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    assert all(r["n_turns"] == len(r["roles"]) for r in found.values())
    assert found[4]["n_turns"] == 0 and found[4]["chat"] == ""
    assert len(found[3]["chat"]) > 99_000


def test_empty_table(spark):
    assert chat.format_chats(_conversations(spark, [])).count() == 0
    model = chat.learn(chat.to_transcripts(_conversations(spark, [])))
    blank = spark.createDataFrame([(None, None), (1, ""), (1, " \n ")], "conv_id long, transcript string")
    assert [r["n_turns"] for r in chat.parse_transcripts(blank, model).collect()] == [0, 0, 0]


LIKE_MARKERS = ("* a bullet", "> a quotation", "Answer: four", "Model: T", "Customer: none", "Systematic review: x", "Contextual: y", "#### Answers")


def test_text_that_looks_like_a_marker_stays():
    lines = ["User: Question: why?", "> a quotation", "* a bullet", "Assistant: so", "Answer: four", "Systematic review: x", "Assistant: * again", "User: Customer: none"]
    _, marks, _, cuts = chat._observe("\n".join(lines))
    states = np.array([2, 3, 3, 4, 5, 5, 4, 2])
    assert chat.to_turns(lines, marks, cuts, states) == [
        ("user", "Question: why?\n> a quotation\n* a bullet"),
        ("assistant", "so\nAnswer: four\nSystematic review: x"),
        ("assistant", "* again"),
        ("user", "Customer: none"),
    ]


@pytest.mark.parametrize("line", ["Systematic review: x", "Contextual: y", "Developers: z"])
def test_words_that_begin_like_a_role_are_no_markers(line):
    assert chat.marker(line) == (3, 0)
    assert chat.marker("System: x") == (0, 8) and chat.marker("[system] x") == (0, 9) and chat.marker("System prompt: x") == (0, 15)


def test_rendered_turns_hold_the_original_texts(spark):
    """No word of a turn is lost, with bullets, quotations and words like markers on later lines, and few marks stay as text.
    Where '* ' and '> ' are the marks themselves, a quotation, or a line like another writer's mark, may be taken for a turn."""
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id < 60").select("conv_id", "turn", "role", "text")
    extra = F.element_at(F.array(*map(F.lit, LIKE_MARKERS)), (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(LIKE_MARKERS))) + 1).cast("int"))
    talks = talks.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), extra, F.lit("\nand more"))).cache()
    bare = F.pmod(F.xxhash64("conv_id"), F.lit(len(chat.STYLES))) == len(chat.STYLES) - 1
    texts = {}
    for r in talks.withColumn("bare", bare).orderBy("conv_id", "turn").collect():
        texts.setdefault((r["conv_id"], r["bare"]), []).append(r["text"])
    found = {r["conv_id"]: r["chat"] for r in chat.format_chats(talks).collect()}
    assert len({b for _, b in texts}) == 2
    words = more = 0
    for (conv, bare), said in texts.items():
        kept = re.sub(r"<\|\w+\|>", " ", found[conv]).split()
        want = " ".join(said).split()
        if bare:
            kept, want = ([w for w in x if w not in (">", "Answer:", "Model:")] for x in (kept, want))
        rest = iter(kept)
        lost = [w for w in want if w not in rest]
        assert not lost, (conv, lost[:3], [x[:40] for x in found[conv].split("\n")], [x[:30] for x in said])
        words, more = words + len(want), more + len(kept) - len(want)
    assert more < 0.01 * words, (more, words)


def test_a_mark_whose_colon_stands_far_right():
    line = "system  message" + " " * 40 + ": be kind"
    assert chat.marker(line) == (0, line.index("be"))
    assert chat.marker("Nothing here ends in a mark, although it is long: so") == (len(chat.ROLES), 0)


def test_long_transcripts_are_decoded_beside_short_ones(monkeypatch):
    """Any grouping by length gives what decoding each sequence alone gives."""
    rng = np.random.default_rng(4)
    logs = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    n = len(chat.STATES)
    model = chat.Hmm(logs(n), logs(n, n), logs(n, chat.N_MARKERS), logs(n, chat.N_SHAPES))
    seen = [(rng.integers(0, chat.N_MARKERS, k), rng.integers(0, chat.N_SHAPES, k)) for k in (3, 0, 50_000, 1, 700, 3, 2, 700, 0)]
    alone = [model.decode([s])[0].tolist() for s in seen]
    for most in (1, 10, 1500, 10**9):
        monkeypatch.setattr(chat, "PADDED_LINES", most)
        assert [s.tolist() for s in model.decode(seen)] == alone
