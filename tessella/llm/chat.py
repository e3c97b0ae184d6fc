"""Chat formatting in budgeted, turn-aligned windows.

Turns of a conversation stream through one task in order (conv_id, turn, role, text) with bounded memory: the system turn, a
limited history and the open window. Running sums of turn tokens close a window before the turn that would pass the budget. Each
later window starts with the system turn and the last turns of at most `history` tokens, repeated and outside the loss mask; then come
new turns. History gives way, oldest first, until a window's first two new turns fit, and the system turn until the first fits; so a window passes the
budget only if it is one turn that alone does. The mask covers the text of every new assistant turn, so each once.

Template: <|im_start|>role LF text <|im_end|> LF. Within texts and roles every `<|` becomes `<||`, so no control string remains; in roles
a backslash and a line feed become `\\\\` and `\\n`. Both are undone on reading.

A null text or role is empty; a null conv_id is a conversation of its own; a null turn comes first, equal turns are ordered by role and
text; repeated rows are turns like any other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column, encoder, materialise, slices

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, window int, text string, context int, turns int, tokens long, loss array<struct<start:int,end:int>>"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return "\\".join(x.replace("\\n", "\n") for x in unescape(role).split("\\\\"))


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = 2048, history: int = 256) -> DataFrame:
    """The windows of all conversations; loss holds the masked spans in code points of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, conv, rows = encoder(tokenizer), object(), []
        system: list[tuple[str, int]] = []  # each turn with its tokens
        recent: deque[tuple[str, int]] = deque()
        past: deque[tuple[str, int]] = deque()  # history of the open window
        head: list[tuple[str, int]] = []  # its system turn
        fresh: list[tuple[str, int, int, int]] = []  # its new turns, with the span of their loss
        window = 0

        def tokens(*lists) -> int:  # noqa: ANN002
            return sum(x[1] for some in lists for x in some)

        def close() -> None:
            nonlocal window, head, past, fresh
            if fresh:
                before = [x for x, _ in (*head, *past)]
                at, spans = sum(map(len, before)), []
                for turn, _, a, b in fresh:
                    if b >= 0:
                        spans.append({"start": at + a, "end": at + b})
                    at += len(turn)
                rows.append((conv, window, "".join((*before, *(x[0] for x in fresh))), len(before), len(fresh), tokens(head, past, fresh), spans))
                window += 1
            head, past, fresh = list(system), deque(recent), []

        def make_room(size: int) -> bool:
            """Whether a turn fits, after as much of the history as it takes has gone."""
            if tokens(head, fresh) + size > budget:
                return False
            while tokens(head, past, fresh) + size > budget:
                past.popleft()
            return True

        for batch in slices(batches):
            formed = []
            for role, text in zip(column(batch, "role").to_pylist(), column(batch, "text").to_pylist()):
                formed.append((f"{START}{escape_role(role or '')}\n", escape(text or ""), role))
            whole = [f"{a}{b}{END}\n" for a, b, _ in formed]
            ends = encode.encode(pa.array(whole, pa.string()))[1]
            sizes = np.diff(ends, prepend=0).tolist()
            for of, (lead, text, role), turn, size in zip(column(batch, "conv_id").to_pylist(), formed, whole, sizes):
                if of != conv:
                    close()
                    conv, window = of, 0
                    system, recent, head, past = [(turn, size)] if role == "system" else [], deque(), [], deque()
                elif tokens(head, past, fresh) + size > budget and not (len(fresh) == 1 and make_room(size)):
                    close()
                    if not make_room(size):
                        head, past = [], deque()
                fresh.append((turn, size, len(lead), len(lead) + len(text) if role == "assistant" else -1))
                if not system or turn is not system[0][0]:
                    recent.append((turn, size))
                    while tokens(recent) > history:
                        recent.popleft()
            if len(rows) >= 256:
                yield batch_of(rows)
                rows = []
        close()
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["conv_id", "window", "text", "context", "turns", "tokens", "loss"])

    ordered = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a window."""
    found = []
    for part in text.split(START)[1:]:
        if not part.endswith(END + "\n"):
            raise ValueError("a turn isn't closed")
        role, _, body = part[: -len(END) - 1].partition("\n")
        found.append((unescape_role(role), unescape(body)))
    return found


def digest(windows: DataFrame) -> DataFrame:
    """Read windows back: one row per conversation, over its windows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, rows = object(), None, []

        def close() -> None:
            if state:
                rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in slices(batches):
            for of, text, context, loss in zip(*(column(batch, x).to_pylist() for x in ("conv_id", "text", "context", "loss"))):
                if of != conv or state is None:
                    close()
                    conv, state = of, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[context:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    masked = unescape(text[span["start"] : span["end"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(rows) >= 1000:
                yield batch_of(rows)
                rows = []
        close()
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = windows.select("conv_id", "window", "text", "context", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, RESULT)


def format_and_read(conversations: DataFrame, tokenizer: str, budget: int = 2048, history: int = 256) -> DataFrame:
    return digest(materialise(format_windows(conversations, tokenizer, budget, history), "chat-windows"))
