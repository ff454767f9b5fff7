"""Chat formatting by columnar byte assembly, and the reader that takes the format apart again.

A turn becomes `<|im_start|>role`, a line break, its text, `<|im_end|>` and a line break. Inside roles and texts each
`<`, backslashes, `|` gets one more backslash, which reading takes away, so control strings of a text never mark a turn;
line breaks and backslashes of roles are written `\\n` and `\\\\`.

For a batch of turns the lengths of all segments are laid out as a matrix, their running sum gives each segment's
offset, and headers and contents are scattered into one preallocated buffer, which becomes the Arrow column as it is.
Turns reach a task sorted by conversation; one that is longer than a batch goes on in further parts, so memory doesn't
grow with a conversation.

Cases: null roles and texts are empty; a null conv_id is a conversation of its own; turns that tie are ordered by role,
then text, null turns first; repeated rows are repeated turns; a very long text is a part of its own; extra columns are not
read, whatever their names; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.batches import bounded
from weftgraph.llm.words import buffers, large, text_slices

START, MID, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
ASSISTANT = "assistant"
_TURN = re.compile(rb"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(rb"<\\(\\*)\|")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text)


def escape_role(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role), flags=re.S)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, the offsets of turns in them, and each text's start and length."""
    n = len(roles)
    (role_data, role_at), (text_data, text_at) = buffers(escape_role(roles)), buffers(escape(texts))
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = len(START), np.diff(role_at), len(MID), np.diff(text_at), len(END)
    at = np.zeros(5 * n + 1, np.int64)
    np.cumsum(lengths.ravel(), out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)
    begin = at[:-1].reshape(n, 5)
    for k, mark in ((0, START), (2, MID), (4, END)):
        out[begin[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for k, data, source in ((1, role_data, role_at), (3, text_data, text_at)):
        moved = np.repeat(begin[:, k] - source[:-1], lengths[:, k]) + np.arange(source[0], source[-1])
        out[moved] = data[source[0] : source[-1]]
    return out, at[::5], begin[:, 3], lengths[:, 3]


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows conv_id, part, formatted, mask_start, mask_length: byte spans of assistants' texts in formatted, to learn from.

    Parts of a conversation are numbered from 0 in the order of its turns; nearly all have one.
    """
    schema = "conv_id bigint, part int, formatted binary, mask_start array<bigint>, mask_length array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = (), 0
        for batch in batches:
            for piece in text_slices(batch):
                conv = piece.column("conv_id")
                ids = np.asarray(pc.fill_null(conv, 0))
                gone = np.asarray(pc.is_null(conv))
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (ids[1:] != ids[:-1]) | (gone[1:] != gone[:-1])
                first = np.flatnonzero(fresh)
                roles = large(piece.column("role"))
                out, at, start, length = assemble(roles, large(piece.column("text")))
                cut = np.append(at[first], at[-1])
                learn = np.flatnonzero(np.asarray(pc.equal(roles, ASSISTANT)))
                owner = np.searchsorted(first, learn, "right") - 1
                spans = pa.array(np.searchsorted(owner, np.arange(len(first) + 1)), pa.int32())
                parts = np.zeros(len(first), np.int32)
                here = conv[0].as_py()
                parts[0] = part = part + 1 if before == (here,) else 0
                if len(first) > 1:
                    part = 0
                before = (conv[len(ids) - 1].as_py(),)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays(
                    [conv.take(pa.array(first)), pa.array(parts), texts.cast(pa.binary()), pa.ListArray.from_arrays(spans, pa.array(start[learn] - cut[owner])), pa.ListArray.from_arrays(spans, pa.array(length[learn]))],
                    ["conv_id", "part", "formatted", "mask_start", "mask_length"],
                )

    rows = bounded(turns).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, schema)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts, from a formatted part."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("bytes between turns")
        at = m.end()
        out.append((unescape_role(m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError("bytes after the last turn")
    return out


def digest_chats(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """A row for each conversation, read back from format_chats: counts and digests of its turns and of its loss mask.

    Parts may come in any order and partition, as from stored tables; they are brought together by conversation and number.
    in_order: formatted is format_chats' own plan, in which they stand together already.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def chars(data: bytes) -> int:
        return len(data.decode())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        open_: tuple | None = None

        def close() -> None:
            if open_:
                rows.append((open_[0], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), total))

        for batch in batches:
            for conv, _, data, starts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ != (conv,):
                    close()
                    open_, n_turns, loss_chars, total, turns, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(data):
                    n_turns += 1
                    turns.update(b"%b\n%b\n" % (role, text))
                for s, n in zip(starts, lengths):
                    text = unescape(data[s : s + n])
                    loss.update(text)
                    loss_chars += chars(text)
                total += chars(data)
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows.clear()
        close()
        if rows:
            yield batch_of(rows)

    formatted = formatted.select("conv_id", "part", "formatted", "mask_start", "mask_length")
    if not in_order:
        formatted = bounded(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as escaped from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(role) + length(escaped)) as bigint) as formatted_chars
from e group by conv_id
"""
