"""Chat formatting in windows of a token budget, with a loss mask that covers every assistant text once."""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Strings that mark turns here or in other templates; inside a text or a role they are broken up by a backslash.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|/turn\|>\n", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class WindowSettings:
    """``budget`` bounds the tokens of a window (words and signs, plus ``overhead`` per turn); a later window repeats the system turns and at most
    ``history_turns`` turns of at most ``history_tokens`` tokens in all. A turn is never cut: one that doesn't fit makes a window of its own."""

    budget: int = 512
    history_turns: int = 2
    history_tokens: int = 128
    overhead: int = 3


def escape(text: str) -> str:
    """Double every backslash and put one after the first character of every control string."""
    text = text.replace("\\", "\\\\")
    while True:  # strings such as <|> hold two that overlap
        done = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if done == text:
            return done
        text = done


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


class Conversation:
    """Takes the turns of one conversation in order and gives out finished windows."""

    def __init__(self, settings: WindowSettings):
        self.s, self.window = settings, 0
        self.system: list[tuple[str, str]] = []
        self.system_tokens, self.leading = 0, True
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]  # prefix sums of the tokens of ``turns``
        self.fresh = 0  # turns before this place are repeated history

    def add(self, role: str, text: str) -> list[dict]:
        tokens, out = len(_TOKEN.findall(text)) + self.s.overhead, []
        if self.leading and role == "system":
            self.system.append((role, text))
            self.system_tokens += tokens
            return out
        self.leading = False
        if self.fresh < len(self.turns) and self.system_tokens + self.sums[-1] - self.sums[0] + tokens > self.s.budget:
            out.append(self.flush())
            end = len(self.turns)
            room = min(self.s.history_tokens, self.s.budget - self.system_tokens - tokens)
            start = max(end - self.s.history_turns, 0)
            while start < end and self.sums[end] - self.sums[start] > room:
                start += 1
            self.turns, self.sums = self.turns[start:], self.sums[start:]
            self.fresh = len(self.turns)
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + tokens)
        return out

    def flush(self) -> dict:
        parts, spans, at = [], [], 0
        repeated = len(self.system) * (self.window > 0) + self.fresh
        for k, (role, text) in enumerate(self.system + self.turns):
            head, body = f"<|{escape(role)}|>\n", escape(text)
            if role == "assistant" and k >= len(self.system) + self.fresh:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts.append(f"{head}{body}<|/turn|>\n")
            at += len(parts[-1])
        row = {"window": self.window, "text": "".join(parts), "loss": [{"start": a, "end": b} for a, b in spans], "n_repeated": repeated, "n_tokens": self.system_tokens + self.sums[-1] - self.sums[0]}
        self.window += 1
        return row

    def end(self) -> list[dict]:
        return [self.flush()] if self.fresh < len(self.turns) or (self.window == 0 and self.system) else []


WINDOW_FIELDS = [
    T.StructField("window", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("n_repeated", T.LongType()), T.StructField("n_tokens", T.LongType()),
]
_WINDOW_ARROW = [("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_repeated", pa.int64()), ("n_tokens", pa.int64())]


def chat_windows(turns: DataFrame, id_col: str = "conv_id", settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Windows of all conversations: id, window (from 0), text, loss (code point spans of ``text``), n_repeated, n_tokens.

    ``turns`` needs the columns turn, role and text beside the id; others are left out. Turns are ordered by turn, then role and text, NULLs first; a NULL role or text is
    empty; rows with a NULL id make one conversation; repeated rows are turns of their own. The first ``n_repeated`` turns of a window have been in an earlier one
    and are outside the loss mask. A task reads its conversations turn by turn and holds one window. An empty table gives an empty one.
    """
    s = settings
    turns = turns.select(F.col(id_col).alias("id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(id_col, turns.schema["id"].dataType), *WINDOW_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, ids, rows, size = None, object(), [], [], 0
        kind = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(ids, kind)] + [pa.array([r[n] for r in rows], k) for n, k in _WINDOW_ARROW], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                made = []
                if now is None or i != at:
                    if now is not None:
                        made = now.end()
                        ids += [at] * len(made)
                        rows += made
                    now, at = Conversation(s), i
                made = now.add(role, text)
                ids += [i] * len(made)
                rows += made
                size += len(text)
                if size > 1 << 22 and rows:
                    yield out()
                    ids, rows, size = [], [], 0
        if now is not None:
            made = now.end()
            ids += [at] * len(made)
            rows += made
        if rows:
            yield out()

    ordered = turns.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(run, schema)


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the windows hold: per conversation its turns once each, and all text under the loss mask, unescaped."""
    schema = T.StructType([windows.schema[id_col]] + [T.StructField(n, T.LongType() if n.endswith(("turns", "chars")) else T.StringType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kind = object(), None, None
        for batch in batches:
            rows, kind = [], batch.column(0).type
            for i, text, loss, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or i != at:
                    if state is not None:
                        rows.append((at, state))
                    at, state = i, [0, sha256(), 0, sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
            if rows:
                yield pack(rows, kind)
        if state is not None:
            yield pack([(at, state)], kind)

    def pack(rows, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], kind)] + [pa.array([x[k].hexdigest() if k in (1, 3) else x[k] for _, x in rows], pa.string() if k in (1, 3) else pa.int64()) for k in range(5)], names=names
        )

    ordered = windows.select(id_col, "text", "loss", "n_repeated", "window").repartition(id_col).sortWithinPartitions(id_col, "window").select(id_col, "text", "loss", "n_repeated")
    return ordered.mapInArrow(run, schema)
