"""Chat formatting by token-level assembly.

Role and text of a turn are encoded separately, as ordinary text; the control tokens are
spliced in as reserved ids beyond the vocabulary, so no content can produce one. Control
strings inside a content are escaped all the same (a backslash is put after their ``<``, one
more where some stand there already), so that the rendered text can be read back too.
Marks of +1 where a loss span begins and -1 behind its end give the mask by a prefix sum.

Turns are formatted one by one, before any shuffle. ``conversations`` then streams the turns
of each conversation in order and reads them back from ids and mask; it holds one Arrow batch
at a time, so a conversation of any length fits.

Defined cases: a null role or text reads as empty; a null conversation id is a conversation of
its own; turns that tie (or repeat) are all kept, in the order of their ids; null turns come
first; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeworks.llm.common import text_slices
from lodeworks.llm.packing import TOKENIZER, encoder

# The control strings of the template.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = [START, SEPARATOR, END]
LOSS_ROLE = "assistant"

_NAMES = "|".join(re.escape(c[2:-2]) for c in CONTROLS)
_PLAIN = re.compile(rf"<(\\*)\|({_NAMES})\|>")
_ESCAPED = re.compile(rf"<\\(\\*)\|({_NAMES})\|>")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def reserved(tokenizer: str) -> dict[str, int]:
    """The ids behind the vocabulary (and its own special token)."""
    first = encoder(tokenizer).n_vocab + 1
    return {c: first + i for i, c in enumerate(CONTROLS)}


def assemble(turns: list[tuple[str, str]], tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all turns one after the other, their loss mask, and where each turn ends."""
    encode, control = encoder(tokenizer).encode_ordinary, reserved(tokenizer)
    parts: list[list[int]] = []
    loss: list[bool] = []
    for role, text in turns:
        spoken = role == LOSS_ROLE
        for ids, counts in (
            ([control[START]], False),
            (encode(escape(role)), False),
            ([control[SEPARATOR]], False),
            (encode(escape(text)), spoken),
            ([control[END]], False),
        ):
            parts.append(ids)
            loss.append(counts)
    ends = np.cumsum([len(p) for p in parts])
    total = int(ends[-1]) if len(ends) else 0
    marks = np.zeros(total + 1, dtype=np.int32)
    spans = np.flatnonzero(loss)
    sizes = np.array([len(parts[i]) for i in spans], dtype=np.int64)
    np.add.at(marks, ends[spans] - sizes, 1)
    np.add.at(marks, ends[spans], -1)
    ids = np.fromiter((i for p in parts for i in p), dtype=np.int32, count=total)
    return ids, np.cumsum(marks[:-1]) > 0, ends[4::5]


def format_turns(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``conv_id, turn, ids, mask`` per row of ``conv_id, turn, role, text``. A conversation is
    the concatenation of its turns."""

    def run(batches):
        for part in text_slices(batches):
            roles = part.column("role").fill_null("").to_pylist()
            texts = part.column("text").fill_null("").to_pylist()
            ids, mask, ends = assemble(list(zip(roles, texts, strict=True)), tokenizer)
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), part.column("turn"),
                 pa.ListArray.from_arrays(offsets, pa.array(ids)),
                 pa.ListArray.from_arrays(offsets, pa.array(mask))],
                ["conv_id", "turn", "ids", "mask"],
            )

    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(
        run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, mask array<boolean>"
    )


def render(ids, tokenizer: str = TOKENIZER) -> str:
    """The formatted text of token ids."""
    back = {i: c.encode() for c, i in reserved(tokenizer).items()}
    vocabulary = encoder(tokenizer)
    return b"".join(back.get(i) or vocabulary.decode_single_token_bytes(i) for i in ids).decode()


def read_turn(ids: np.ndarray, mask: np.ndarray, tokenizer: str) -> tuple[str, str, str]:
    """Role, text and loss text of one formatted turn, unescaped."""
    decode, control = encoder(tokenizer).decode_bytes, reserved(tokenizer)
    gap = int(np.flatnonzero(ids == control[SEPARATOR])[0])
    if ids[0] != control[START] or ids[-1] != control[END]:
        raise ValueError("a turn begins and ends with its control tokens")
    role, text, loss = (
        unescape(decode(part.tolist()).decode()) for part in (ids[1:gap], ids[gap + 1 : -1], ids[mask])
    )
    return role, text, loss


class Reading:
    """What is read back of one conversation so far."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray, tokenizer: str) -> None:
        role, text, loss = read_turn(ids, mask, tokenizer)
        self.turns += 1
        self.said.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.loss_chars += len(loss)
        self.chars += len(render(ids.tolist(), tokenizer))

    def row(self) -> tuple:
        return (
            self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars,
            self.loss.hexdigest(), self.chars,
        )


DIGESTS = {
    "n_turns": pa.int64(),
    "turns_sha256": pa.string(),
    "loss_chars": pa.int64(),
    "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(),
}


def read_back(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row of counts and digests per conversation, from its formatted turns."""

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            names = batch.column("conv_id").to_pylist()
            # Arrow gives each list as a view of one flat array.
            ids, mask = batch.column("ids"), batch.column("mask")
            for i, name in enumerate(names):
                if now is None or now.conv_id != name:
                    rows += [now.row()] if now else []
                    now = Reading(name)
                now.add(
                    ids[i].values.to_numpy(), mask[i].values.to_numpy(zero_copy_only=False), tokenizer
                )
            yield to_batch(rows, batch.schema.field("conv_id").type)
        if now:
            yield to_batch([now.row()], batch.schema.field("conv_id").type)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "ids")
        .mapInArrow(
            run,
            f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
            "loss_sha256 string, formatted_chars long",
        )
    )


def to_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = {"conv_id": kind} | DIGESTS
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], list(types)
    )
