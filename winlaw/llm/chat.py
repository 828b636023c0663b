"""Formatting of conversations by a compiled template, with loss marks, and reading them back.

Rows are dealt by conversation and sorted by turn; each task then streams through them, so
a conversation of any length holds one message at a time in memory (format_digests) or its
own output (format_conversations). Turns of equal number keep the order role, text; null
numbers come first; a null text or role is empty; rows without conversation id form one
conversation without id; repeated rows are turns of their own; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template, unescape

START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' }}{{ m.role | escape_line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)


class Reader:
    """Gets formatted output in chunks and calls turn(role, text) for each turn that it finds."""

    def __init__(self, turn: Callable[[str, str], None]):
        self.turn, self.held, self.tail = turn, [], ""

    def feed(self, chunk: str) -> None:
        self.held.append(chunk)
        self.tail = (self.tail + chunk)[-len(END) - 1 :] if len(chunk) <= len(END) else chunk[-len(END) - 1 :]
        if END not in self.tail:
            return
        text = "".join(self.held)
        while (end := text.find(END)) >= 0:
            head = text[:end]
            start = head.find(START)
            if start < 0 or head[:start].strip():
                raise ValueError("a turn doesn't begin with its mark")
            role, _, body = head[start + len(START) :].partition("\n")
            self.turn(unescape(role), unescape(body))
            text = text[end + len(END) :]
        self.held, self.tail = [text], text[-len(END) - 1 :]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict[str, str]]]:
    for batch in batches:
        for key, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            yield key, {"role": role or "", "text": text or ""}


def _groups(rows: Iterator[tuple[int | None, dict]]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation's id and its messages, which are read as they are used."""
    head = next(rows, None)
    while head is not None:
        key = head[0]

        def messages(key=key) -> Iterator[dict]:
            nonlocal head
            while head is not None and head[0] == key:
                yield head[1]
                head = next(rows, None)

        it = messages()
        yield key, it
        for _ in it:  # what the template left unread
            pass


def _dealt(rows: DataFrame) -> DataFrame:
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(rows: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, formatted, and the spans of code points under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for key, messages in _groups(_stream(batches)):
            chunks, spans, at = [], [], 0

            def emit(text: str, generated: bool) -> None:
                nonlocal at
                chunks.append(text)  # noqa: B023
                if generated and text:
                    spans.append({"start": at, "end": at + len(text)})  # noqa: B023
                at += len(text)

            render({"messages": messages}, emit)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array(["".join(chunks)]), pa.array([spans], kind)], names=["conv_id", "formatted", "spans"])

    return _dealt(rows).mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def format_digests(rows: DataFrame, template: str = CHATML) -> DataFrame:
    """Per conversation what is read back from its output: number and digest of turns, size and digest of the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(template), []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for key, messages in _groups(_stream(batches)):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = total = 0
            masked: list[str] = []

            def turn(role: str, text: str) -> None:
                nonlocal n
                n += 1
                turns.update(f"{role}\n{text}\n".encode())  # noqa: B023

            def close() -> None:
                nonlocal chars
                if masked:  # noqa: B023
                    text = unescape("".join(masked))  # noqa: B023
                    chars += len(text)
                    loss.update(text.encode())  # noqa: B023
                    masked.clear()  # noqa: B023

            reader = Reader(turn)

            def emit(text: str, generated: bool) -> None:
                nonlocal total
                total += len(text)
                reader.feed(text)  # noqa: B023
                if generated:
                    masked.append(text)  # noqa: B023
                else:
                    close()  # noqa: B023

            render({"messages": messages}, emit)
            close()
            out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(out) >= 4096:
                yield table()
                out.clear()
        if out:
            yield table()

    return _dealt(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
