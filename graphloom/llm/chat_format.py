"""Chat formatting in budgeted windows.

A conversation's turns go, in order, into windows of at most `budget` tokens: ids of the given tokenizer over the turns as
they are written, roles, marks and backslashes included. (Its pattern never joins a turn's last character with the mark
of the next, so the tokens of a window are the sum of its turns'.) The prefix sums of the turns' tokens choose spans that
end between turns. Leading system turns are repeated at the head of every window; behind them up to `history_turns` turns
of the window before are repeated while they leave the next turn its room. Repeated turns are masked: only an assistant
turn's first appearance lies under the loss mask. One case exceeds the budget, and n_tokens tells it: a turn that is larger
than the budget less the system turns has a window of its own, whole, behind all system turns, which no size takes away.

Template: `<turn role>\n` + text + `</turn>\n`, where in roles and texts a backslash goes before every backslash,
before `<turn`, `</turn` and (in roles) before `>` and newlines; reading takes the backslashes off again.

Turns of a conversation are brought to one partition, sorted, and streamed: memory holds one window, however long a
conversation is. Defined results: null roles and texts count as empty; null turn numbers come first; rows with equal
conv_id and turn follow in the order of role and text; repeated rows are turns of their own; a null conv_id is one
conversation; texts of any length stay whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cost_packing import TextTokenizer

WINDOW = (
    "conv_id long, window_no long, text string, first_turn long, n_system int, n_repeated int, "
    "loss array<struct<start: int, end: int>>, n_tokens long"
)
_TURN = re.compile(r"<turn ((?:[^\\>\n]|\\[\s\S])*)>\n((?:[^\\<]|\\[\s\S]|<(?!/?turn))*)</turn>\n")


def escape(text: str, role: bool = False) -> str:
    text = re.sub(r"\\|<(?=/?turn)", lambda m: "\\" + m[0], text)
    return re.sub(r"[>\n]", lambda m: "\\" + m[0], text) if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def written(role: str, said: str) -> tuple[str, str, str]:
    """Head, body and end of a turn in the template."""
    return f"<turn {escape(role, True)}>\n", escape(said), "</turn>\n"


def _windows(turns, budget: int, history_turns: int, count):
    """(text, first turn, system turns, repeated turns, loss spans, tokens) of the windows of one conversation.

    count gives the tokens of a written turn. Turns are (role, parts, tokens).
    """
    # system turns before turn `first` head the window; prefix sums: tokens up to the span's first turn and up to now
    system, before, held, first, start, total, head = [], [], [], 0, 0, 0, 0
    tokens = lambda some: sum(x[2] for x in some)

    def build():
        heads, keep = system[:first], []
        room = budget - head - (total - start)
        for turn in reversed(before[-history_turns:] if history_turns else []):
            if turn[2] > room:
                break
            room -= turn[2]
            keep.insert(0, turn)
        text, loss, at = [], [], 0
        for k, (role, parts, _) in enumerate([*heads, *keep, *held]):
            if role == "assistant" and k >= len(heads) + len(keep):
                loss.append({"start": at + len(parts[0]), "end": at + len(parts[0]) + len(parts[1])})
            text += parts
            at += sum(map(len, parts))
        return "".join(text), first, len(heads), len(keep), loss, total - start + head + tokens(keep)

    leading = True
    for role, said in turns:
        parts = written(role, said)
        turn = (role, parts, count("".join(parts)))
        leading = leading and role == "system"
        if held and head + total + turn[2] - start > budget:
            yield build()
            first, start = first + len(held), total
            head = tokens(system[:first])
            before, held = held, []
        held.append(turn)
        total += turn[2]
        if leading:
            system.append(turn)
    if held:
        yield build()


def format_windows(turns: DataFrame, tokenizer_path: str, budget: int = 512, history_turns: int = 2) -> DataFrame:
    """Windows of every conversation; the windows of one follow each other in one partition."""

    def run(frames):
        tokenizer = TextTokenizer(tokenizer_path)
        rows, held = [], 0

        def stream():
            for pdf in frames:
                conv = pdf["conv_id"].astype("Int64")
                yield from zip(conv, pdf["role"], pdf["text"])

        source = stream()
        row = next(source, None)
        while row is not None:
            conv = row[0]

            def own():
                nonlocal row
                while row is not None and ((row[0] is pd.NA and conv is pd.NA) or (row[0] is not pd.NA and conv is not pd.NA and row[0] == conv)):
                    yield row[1] or "", row[2] or ""
                    row = next(source, None)

            for n, (text, first, n_system, n_repeated, loss, size) in enumerate(_windows(own(), budget, history_turns, lambda text: len(tokenizer.ids(text)))):
                rows.append((conv, n, text, first, n_system, n_repeated, loss, size))
                held += len(text)
                if held > 4_000_000:
                    yield _frame(rows)
                    rows, held = [], 0
        if rows:
            yield _frame(rows)

    slim = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInPandas(run, WINDOW)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window_no", "text", "first_turn", "n_system", "n_repeated", "loss", "n_tokens"])
    return out.astype({"conv_id": "Int64"})


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a window's text."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text behind the last turn")
    return out


def digests(windows: DataFrame) -> DataFrame:
    """What a reader of the windows gets back, one row for each conversation.

    The windows of a conversation must follow each other in one partition, as format_windows leaves them.
    """

    def run(frames):
        key, state, rows = None, None, []

        def close():
            conv, turns, loss = state["conv"], state["turns"], state["loss"]
            rows.append((conv, state["n"], turns.hexdigest(), state["loss_chars"], loss.hexdigest(), state["chars"], state["windows"]))

        def frame():
            cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
            return pd.DataFrame(rows, columns=cols).astype({"conv_id": "Int64"})

        for pdf in frames:
            for conv, no, text, n_system, n_repeated, loss in zip(pdf["conv_id"].astype("Int64"), pdf["window_no"], pdf["text"], pdf["n_system"], pdf["n_repeated"], pdf["loss"]):
                if no == 0:
                    if state:
                        close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "windows": 0}
                for role, said in read_back(text)[n_system + n_repeated :]:
                    state["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    state["n"] += 1
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state["loss"].update(said.encode("utf-8", "surrogatepass"))
                    state["loss_chars"] += len(said)
                state["chars"] += len(text)
                state["windows"] += 1
            if rows:
                yield frame()
                rows = []
        if state:
            close()
            yield frame()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.mapInPandas(run, schema)
