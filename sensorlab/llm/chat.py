"""Chat formatting into windows of a token budget, aligned to turns.

A conversation's turns are streamed in order; prefix sums of their tokens tell
which span still fits. A window repeats the system turn and as many of the
latest turns as fit into HISTORY of the budget, then takes new turns while the
budget lasts, at least one. The loss covers the texts of new assistant turns;
repeated ones are masked. A turn is never cut: one that exceeds the budget has
a window of its own behind the system turn.

Template, a turn after another: ``<|turn|>role\\ntext<|end|>\\n``. Inside roles
and texts a backslash comes after the first character of every control string
and before every backslash, so that no control string is left and `unescape`
restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import small_batches
from sensorlab.llm.tokens import encoder

BUDGET = 1024
HISTORY = 0.5
# Beginnings of control strings of common chat templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>", "<eos>", "<bos>", "<start_of_turn>", "<end_of_turn>")
_ESCAPED = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL), re.IGNORECASE)
TURN, END = "<|turn|>", "<|end|>\n"
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its text begins."""
    head = f"{TURN}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}", len(head)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the place of the escaped text of every turn."""
    return [(unescape(m[1], True), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


@dataclass
class _Windows:
    """Windows of one conversation, turn by turn; holds the turns that may be repeated only."""

    budget: int
    history: int
    system: tuple[str, str, int] | None = None
    past: list[tuple[str, str, int]] = field(default_factory=list)
    new: list[tuple[str, str, int]] = field(default_factory=list)
    repeated: list[tuple[str, str, int]] = field(default_factory=list)
    number: int = 0
    system_is_new: bool = False
    size: int = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if self.system is None and self.number == 0 and not self.new and role == "system":
            self.system, self.system_is_new, self.size = turn, True, tokens
            return
        if self.new and self.size + tokens > self.budget:
            yield self.window()
        if not self.new:
            self._begin(tokens)
        self.new.append(turn)
        self.size += tokens

    def _begin(self, tokens: int) -> None:
        """Repeat the latest turns that leave room for the next one."""
        held = self.system[2] if self.system else 0
        room = min(self.history, self.budget - held - tokens)
        self.repeated = []
        for turn in reversed(self.past):
            if turn[2] > room:
                break
            room -= turn[2]
            self.repeated.insert(0, turn)
        self.past = list(self.repeated)
        self.size = held + sum(t[2] for t in self.repeated)

    def window(self) -> tuple:
        text, starts, ends = [], [], []
        at = 0
        turns = ([self.system] if self.system else []) + self.repeated + self.new
        fresh = len(turns) - len(self.new)
        for k, (role, content, _) in enumerate(turns):
            part, head = render(role, content)
            if k >= fresh and role == "assistant":
                starts.append(at + head)
                ends.append(at + len(part) - len(END))
            text.append(part)
            at += len(part)
        first = 0 if self.system_is_new else fresh
        out = (self.number, "".join(text), starts, ends, first, fresh, self.size)
        self.past += self.new
        kept, room = [], self.history
        for turn in reversed(self.past):
            if turn[2] > room:
                break
            room -= turn[2]
            kept.insert(0, turn)
        self.past, self.new, self.repeated, self.system_is_new = kept, [], [], False
        self.number += 1
        return out

    def close(self) -> Iterator[tuple]:
        if self.new or self.system_is_new:
            yield self.window()


def format_chats(
    turns: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", budget: int = BUDGET, history: float = HISTORY,
) -> DataFrame:
    """One row per window: ``id_col, window, text, loss_starts, loss_ends, first_new, n_system_and_repeated, n_tokens``.

    `loss_starts` and `loss_ends` are places in `text`, in code points; turns
    before number `first_new` of the window have been in an earlier one, but if
    it is 0 the system turn is new and the turns from `n_system_and_repeated`
    on. Rows are ordered by turn, then role, then text, nulls first; repeated
    rows are turns of their own. Null roles and texts count as empty. A system
    turn that isn't the first is an ordinary turn. Rows with a null id are one
    conversation. The windows of a conversation follow one another in their
    partition.
    """
    small_batches(turns.sparkSession)
    names = ["_conv", "_turn", "_role", "_text"]
    rows = turns.select(
        F.col(id_col).cast("long").alias("_conv"), F.col(turn_col).cast("long").alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    fields = ["_conv", "window", "text", "loss_starts", "loss_ends", "first_new", "n_system_and_repeated", "n_tokens"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()]

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, conv, state, found = encoder(tokenizer), None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            roles, texts = batch.column("_role").to_pylist(), batch.column("_text").to_pylist()
            shown = pa.array([render(r, t)[0] for r, t in zip(roles, texts, strict=True)])
            _, ends = coder.encode_all(shown)
            sizes = [b - a for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            for c, role, text, tokens in zip(batch.column("_conv").to_pylist(), roles, texts, sizes, strict=True):
                if state is None or c != conv:
                    if state is not None:
                        found += [(conv, *w) for w in state.close()]
                    conv, state = c, _Windows(budget, int(budget * history))
                found += [(conv, *w) for w in state.add(role, text, tokens)]
            if found:
                yield out(found)
                found = []
        if state is not None:
            found += [(conv, *w) for w in state.close()]
        if found:
            yield out(found)

    ordered = rows.repartition("_conv").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in names))
    schema = f"`{id_col}` long, window long, text string, loss_starts array<int>, loss_ends array<int>, first_new int, n_system_and_repeated int, n_tokens long"
    return ordered.mapInArrow(build, schema.replace(f"`{id_col}`", "_conv")).withColumnRenamed("_conv", id_col)


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, read from its windows.

    ``id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Takes the windows as `format_chats` returns them: in order, a conversation
    in one partition.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv in _streams(batches):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = formatted = 0
            key = None
            for key, text, starts, ends, first, fresh in conv:  # noqa: B007
                formatted += len(text)
                for k, (role, content, _, _) in enumerate(parse(text)):
                    if k >= fresh or (k == 0 and first == 0):
                        turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                for a, b in zip(starts, ends, strict=True):
                    part = unescape(text[a:b])
                    loss.update(part.encode("utf-8", "surrogatepass"))
                    chars += len(part)
            row = [key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    names = ["_conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = windows.withColumnRenamed(id_col, "_conv").select("_conv", "text", "loss_starts", "loss_ends", "first_new", "n_system_and_repeated")
    schema = "_conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(digest, schema).withColumnRenamed("_conv", id_col)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The windows of each conversation in turn, without holding them."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[0]):
        yield group
