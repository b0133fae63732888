"""Chat formatting: roles of transcript lines by a hidden Markov model, and a canonical rendering of the turns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: States: a role's first line of a turn, and its later lines.
STATES = tuple((role, first) for role in ROLES for first in (True, False))
#: How writers mark who speaks, a style a row: system, user, assistant. In the last style only line breaks and content tell.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("[system] ", "Human: ", "AI: "),
    ("### Instructions\n", "### Question\n", "### Answer\n"),
    ("<|system|>", "<|user|>", "<|assistant|>"),
    ("", "Q: ", "A: "),
    ("* ", "> ", ""),
)
_MARKERS = (
    regex.compile(r"^\s*(?:\[(?:system|developer|context)\]\s*:?|(?:system|developer|context)\b(?:\s+(?:prompt|message|instructions?)\b)?\s*:|<\|system\|>|#+\s*(?:system|instructions?)\b:?|\*(?=\s))[ \t]*", regex.I),
    regex.compile(r"^\s*(?:(?:user|human|prompter|q|question|customer)\s*:|<\|user\|>|#+\s*(?:user|human|question|prompt)\b:?|>(?=\s)|\[user\])[ \t]*", regex.I),
    regex.compile(r"^\s*(?:(?:assistant|ai|bot|a|answer|model|agent)\s*:|<\|assistant\|>|#+\s*(?:assistant|answer|response)\b:?|\[assistant\])[ \t]*", regex.I),
)
N_MARKERS, N_SHAPES = len(_MARKERS) + 1, 16
#: Lines, with those that pad shorter transcripts, that are decoded at once; a transcript of more lines is decoded alone.
PADDED_LINES = 200_000


def marker(line: str) -> tuple[int, int]:
    """(role whose marker the line begins with, or len(ROLES) for none; length of the marker)."""
    if line[:1].isalpha() and ":" not in line:  # a marker that begins with a letter ends in a colon
        return len(ROLES), 0
    for role, expression in enumerate(_MARKERS):
        if m := expression.match(line):
            return role, m.end()
    return len(ROLES), 0


def shape(line: str, previous: str | None) -> int:
    """What a line looks like without its marker: 16 kinds by length, question mark, and the blank line or start before it."""
    size = len(line)
    return (0 if size < 60 else 1 if size < 200 else 2 if size < 600 else 3) * 4 + 2 * ("?" in line) + (previous is None or not previous.strip())


@dataclass(frozen=True)
class Hmm:
    """Log probabilities: start[state], step[from, to], marks[state, marker], shapes[state, shape]."""

    start: np.ndarray
    step: np.ndarray
    marks: np.ndarray
    shapes: np.ndarray

    def decode(self, observed: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Viterbi: the likeliest states of each sequence of (markers, shapes). Sequences of like lengths advance together, a
        line a step, as many as PADDED_LINES allows; of equally likely paths the one with the lower state stays."""
        order = sorted(range(len(observed)), key=lambda i: len(observed[i][0]))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(observed)
        group: list[int] = []
        for i in [*order, None]:
            if group and (i is None or len(observed[i][0]) * (len(group) + 1) > PADDED_LINES):
                for k, states in zip(group, self._decode([observed[k] for k in group]), strict=True):
                    out[k] = states
                group = []
            group.append(i)
        return out

    def _decode(self, observed: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        order = np.argsort([-len(m) for m, _ in observed], kind="stable")
        lengths = np.array([len(observed[i][0]) for i in order], dtype=np.int64)
        live = lengths > 0
        n, most = int(live.sum()), int(lengths[0]) if len(lengths) else 0
        marks, shapes = np.zeros((most, n), dtype=np.int64), np.zeros((most, n), dtype=np.int64)
        for k, i in enumerate(order[:n]):
            marks[: lengths[k], k], shapes[: lengths[k], k] = observed[i]
        back = np.zeros((most, n, len(STATES)), dtype=np.int8)
        score = np.zeros((n, len(STATES)))
        for t in range(most):
            active = int(np.searchsorted(-lengths[:n], -t, side="left"))
            seen = self.marks[:, marks[t, :active]].T + self.shapes[:, shapes[t, :active]].T
            if t == 0:
                score[:active] = self.start + seen
                continue
            paths = score[:active, :, None] + self.step
            back[t, :active] = paths.argmax(axis=1)
            score[:active] = paths.max(axis=1) + seen
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(observed)
        for k, i in enumerate(order[:n]):
            states = np.zeros(lengths[k], dtype=np.int64)
            states[-1] = score[k].argmax()
            for t in range(lengths[k] - 1, 0, -1):
                states[t - 1] = back[t, k, states[t]]
            out[i] = states
        return out


def to_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, transcript, lines): each conversation as the plain text that a writer of one of STYLES would leave, the
    style chosen by conv_id; `lines` names the state of every line, to learn from and to test against.

    Turns follow `turn`, then role and text; null texts count as empty, turns with another role than ROLES keep their
    text without a marker, as assistant's."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    styles = F.array(*(F.array(*map(F.lit, s)) for s in STYLES))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.when(role > 0, role - 1).otherwise(2).cast("int").alias("role"),
        F.concat(F.when(role > 0, F.element_at(F.element_at(styles, (style + 1).cast("int")), role.cast("int"))).otherwise(""), F.coalesce("text", F.lit(""))).alias("said"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said"))).alias("t"))
    states = F.flatten(F.transform("t", lambda t: F.transform(F.split(t["said"], "\n"), lambda _, i: (2 * t["role"] + F.when(i == 0, 0).otherwise(1)).cast("int"))))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda t: t["said"]), "\n").alias("transcript"), states.alias("lines"))


def _observe(text: str) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
    lines = text.split("\n")
    marks = [marker(x) for x in lines]
    shapes = [shape(x[m[1] :], lines[i - 1] if i else None) for i, (x, m) in enumerate(zip(lines, marks, strict=True))]
    return lines, np.array([m[0] for m in marks]), np.array(shapes), [m[1] for m in marks]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes = {"start": (1, len(STATES)), "step": (len(STATES),) * 2, "marks": (len(STATES), N_MARKERS), "shapes": (len(STATES), N_SHAPES)}
    total = {k: np.zeros(s, dtype=np.int64) for k, s in sizes.items()}
    for batch in batches:
        for text, states in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, marks, shapes, _ = _observe(text)
            s = np.array(states)
            total["start"][0, s[0]] += 1
            np.add.at(total["step"], (s[:-1], s[1:]), 1)
            np.add.at(total["marks"], (s, marks), 1)
            np.add.at(total["shapes"], (s, shapes), 1)
    for table, counts in total.items():
        a, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([table] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[a, b])], names=["part", "a", "b", "n"])


def learn(transcripts: DataFrame, smoothing: float = 0.5) -> Hmm:
    """The model of all transcripts: relative frequencies of starts, transitions, markers and shapes, each count raised by smoothing."""
    counted = transcripts.select("transcript", "lines").mapInArrow(_count, "part string, a int, b int, n long").groupBy("part", "a", "b").agg(F.sum("n").alias("n"))
    tables = {"start": np.zeros((1, len(STATES))), "step": np.zeros((len(STATES),) * 2), "marks": np.zeros((len(STATES), N_MARKERS)), "shapes": np.zeros((len(STATES), N_SHAPES))}
    for row in counted.collect():  # a cell of four fixed tables each
        tables[row["part"]][row["a"], row["b"]] = row["n"]
    logs = {k: np.log((t + smoothing) / (t + smoothing).sum(axis=1, keepdims=True)) for k, t in tables.items()}
    return Hmm(logs["start"][0], logs["step"], logs["marks"], logs["shapes"])


def render(turns: Sequence[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def _forms(lines: Sequence[str], marks: Sequence[int], cuts: Sequence[int], states: np.ndarray) -> dict[str, str]:
    """The marker, as written in lower case, that first lines of a role begin with most often, of several the one seen first; a
    role has no entry where as many have none."""
    seen: dict[str, Counter] = {}
    for line, mark, cut, state in zip(lines, marks, cuts, states.tolist(), strict=True):
        role, first = STATES[state]
        if first:
            seen.setdefault(role, Counter())[line[:cut].strip().lower() if mark < len(ROLES) and ROLES[mark] == role else ""] += 1
    most = {role: max(n, key=lambda form, n=n: (n[form], not form)) for role, n in seen.items()}
    return {role: form for role, form in most.items() if form}


def to_turns(lines: Sequence[str], marks: Sequence[int], cuts: Sequence[int], states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn: one begins at a first line, and wherever the role changes. Empty turns go.

    A marker is cut from a role's first line only, where it is that role's and written as it is most often on first lines of
    the role in this transcript; anything else that looks like a marker is text. A role without a mark whose only turn begins like
    one ('Answer: 4'), and a quotation taken for a turn where '>' marks the user, can't be told from marked turns."""
    forms = _forms(lines, marks, cuts, states)
    turns: list[tuple[str, list[str]]] = []
    for line, mark, cut, state in zip(lines, marks, cuts, states.tolist(), strict=True):
        role, first = STATES[state]
        if first or not turns or turns[-1][0] != role:
            turns.append((role, []))
        own = first and mark < len(ROLES) and ROLES[mark] == role and line[:cut].strip().lower() == forms.get(role)
        turns[-1][1].append(line[cut:] if own else line)
    stripped = [(role, "\n".join(x).strip()) for role, x in turns]
    return [t for t in stripped if t[1]]


def _parser(model: Hmm) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = [_observe(t or "") for t in part.column(1).to_pylist()]
                decoded = model.decode([(m, s) for _, m, s, _ in seen])
                turns = [to_turns(lines, marks, cuts, states) for (lines, marks, _, cuts), states in zip(seen, decoded, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([len(t) for t in turns], pa.int32()), pa.array([render(t) for t in turns], pa.string())],
                    names=["conv_id", "roles", "n_turns", "chat"],
                )

    return run


def parse_transcripts(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """(conv_id, roles, n_turns, chat) of every row of transcripts (conv_id, transcript): the roles of its turns, and the
    canonical text. Null, empty and blank transcripts have no turns; null and repeated conv_ids stay as they are."""
    return transcripts.select("conv_id", "transcript").mapInArrow(_parser(model), "conv_id long, roles array<string>, n_turns int, chat string")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, roles, n_turns, chat) for every conversation: laid out as a transcript (see to_transcripts), parsed by a
    model learned from all of them, and rendered canonically.

    Rows with a null conv_id belong to no conversation and are ignored; null turns sort first, repeated rows are turns of
    their own. An empty table gives no rows. Other columns are ignored, whatever their names."""
    transcripts = to_transcripts(conversations)
    return parse_transcripts(transcripts, learn(transcripts))
