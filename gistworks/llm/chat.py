"""Chat formatting: a finite-state machine over roles and a declarative template.

Every turn becomes text segments with loss flags: the template's marks carry
none, its text slot may. Characters that begin a control string are escaped
inside texts, so a mark in the output is always a mark, and a text read back
is the text put in. The machine walks the turns in order and tells, for each,
whether the conversation is well-formed so far; a turn it doesn't allow is
formatted all the same and marked.

Turns are ordered by (turn, role, text), nulls first; repeated rows all stay.
A null text is empty, a null role is the empty role; roles without a template
of their own carry their name in the output and are never allowed. A null
conversation id is a conversation of its own; an empty table gives no rows.

A conversation is one sequential document: its rows are sorted (spilling to
disk) and streamed through one task turn by turn, never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gistworks.llm.common import pick, prepare

#: Role: opening mark, closing mark, whether the text counts for the loss (fixed values of the format).
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role: its name between two marks, then the text and a closing mark.
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
#: State: the roles it allows and the states they lead to. A conversation may end in any of ENDS.
MACHINE = {
    "start": {"system": "asked", "user": "answer"},
    "asked": {"user": "answer"},
    "answer": {"assistant": "turn"},
    "turn": {"user": "answer"},
}
ENDS = ("turn",)
#: Escaped characters and their letters: the escape itself and what control strings begin with.
ESCAPES = {"\\": "b", "[": "s", "<": "l"}


def _escape(text: Column) -> Column:
    for char, letter in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: str) -> str:
    back = {letter: char for char, letter in ESCAPES.items()}
    return re.sub(r"\\(.)", lambda m: back[m[1]], text)


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def segments(role: Column, text: Column) -> Column:
    """The turn's segments, from the template."""
    body = _escape(text)
    made = F.array(_segment(F.lit(OTHER[0]), False), _segment(_escape(role), False), _segment(F.lit(OTHER[1]), False), _segment(body, False), _segment(F.lit(OTHER[2]), False))
    for name, (opening, closing, loss) in TEMPLATE.items():
        own = F.array(_segment(F.lit(opening), False), _segment(body, loss), _segment(F.lit(closing), False))
        made = F.when(role == name, own).otherwise(made)
    return made


def _walk(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, state, fine = object(), 0, "start", True
        for batch in batches:
            places, states, valid = [], [], []
            for conversation, role in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()):
                if conversation != now:
                    now, at, state, fine = conversation, 0, "start", True
                following = MACHINE.get(state, {}).get(role)
                fine = fine and following is not None
                state = following if fine else "broken"
                places.append(at)
                states.append(state)
                valid.append(fine)
                at += 1
            columns = [batch.column("conv_id"), pa.array(places, pa.int64()), batch.column("segments"), pa.array(states, pa.string()), pa.array(valid, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, at, segments (text, loss), state, valid; a conversation's rows adjacent and in order."""
    prepare(turns.sparkSession)
    rows = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    order = ("conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    rows = rows.select("conv_id", "role", segments(F.col("role"), F.col("text")).alias("segments"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, at long, segments array<struct<text: string, loss: boolean>>, state string, valid boolean"
    return rows.mapInArrow(_walk(["conv_id", "at", "segments", "state", "valid"]), schema)


def reader() -> re.Pattern:
    """One turn of formatted text: its own marks and no other control string in between."""
    free = "([^" + "".join(re.escape(c) for c in ESCAPES if c != "\\") + "]*)"
    own = [re.escape(a) + free + re.escape(b) for a, b, _ in TEMPLATE.values()]
    return re.compile("|".join([*own, re.escape(OTHER[0]) + free + re.escape(OTHER[1]) + free + re.escape(OTHER[2])]))


def read_turn(pattern: re.Pattern, formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = pattern.fullmatch(formatted)
    parts = found.groups()
    for k, name in enumerate(TEMPLATE):
        if parts[k] is not None:
            return name, unescape(parts[k])
    return unescape(parts[-2]), unescape(parts[-1])


_DIGEST = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _digest(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, now = reader(), None
        for batch in batches:
            done = []
            for conversation, pieces, state, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segments", "state", "valid"))):
                if now is None or conversation != now[0]:
                    if now:
                        done.append(now)
                    now = [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                formatted = "".join(p["text"] for p in pieces)
                role, text = read_turn(pattern, formatted)
                under = unescape("".join(p["text"] for p in pieces if p["loss"]))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(under)
                now[4].update(under.encode())
                now[5] += len(formatted)
                now[6] = valid and state in ENDS
            if done:
                yield table(done)
        if now:
            yield table([now])

    def table(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*((a, n, t.hexdigest(), c, x.hexdigest(), f, v) for a, n, t, c, x, f, v in rows)))
        return pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(columns)], names)

    return run


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what can be read back from the rows of ``format_chats``, given in their order (integer ids)."""
    schema = _DIGEST.format(kind=formatted.schema["conv_id"].dataType.simpleString())
    return formatted.mapInArrow(_digest([c.split()[0] for c in schema.split(", ")]), schema)
