"""Chat formatting: a finite-state machine over roles, and a declarative template that emits segments with loss flags.

A conversation's turns stand in the order (turn, role, text). Each becomes three segments (opening, text, closing); only
the text of roles with ``loss`` is under the loss mask. Inside texts backslashes are doubled and a backslash is put behind
the first character of each control string, so that no control string occurs in a text and reading back is exact. The
machine accepts an optional system turn, then user and assistant turns in alternation, ending with the assistant;
conversations of another order are formatted all the same and flagged as not valid.

Rows are dealt by conversation, sorted, and written as a stream: of a conversation of any length a worker holds one batch. What is
written is read back as one text, in which a reader finds the turns by their marks alone.

Defined cases: null texts and roles are empty; roles outside the template get a generic opening that names them; repeated
rows are turns of their own; null turns come first; a null conv_id is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared


@dataclass(frozen=True)
class Template:
    """role: (opening, closing, loss). ``control`` lists the strings that mark turns and must not occur in texts."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s> ", " </s>", True)})
    other: tuple = ("<<ROLE>>", "<<SAYS>>", "<</ROLE>>")
    control: tuple = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<<SAYS>>", "<</ROLE>>")

    def __post_init__(self):
        found = sorted(self.control, key=len, reverse=True)
        object.__setattr__(self, "find", re.compile("|".join(map(re.escape, found))))
        object.__setattr__(self, "hidden", re.compile(r"\\\\|" + "|".join(re.escape(c[0] + "\\" + c[1:]) for c in found)))

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return self.hidden.sub(lambda m: "\\" if m[0] == "\\\\" else m[0].replace("\\", "", 1), text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.roles:
            opening, closing, loss = self.roles[role]
        else:
            opening, closing, loss = self.other[0] + self.escape(role) + self.other[1], self.other[2], False
        return [(opening, False), (self.escape(text), loss), (closing, False)]

    def _opened(self, text: str, at: int) -> tuple[str, str, bool, int] | None:
        """Role, closing, loss and start of the text of the turn that opens at ``at``; null where more text is needed to tell."""
        for role, (opening, closing, loss) in self.roles.items():
            if text.startswith(opening, at):
                return role, closing, loss, at + len(opening)
        if text.startswith(self.other[0], at):
            cut = text.find(self.other[1], at)
            return None if cut < 0 else (self.unescape(text[at + len(self.other[0]) : cut]), self.other[2], False, cut + len(self.other[1]))
        rest = text[at : at + max(map(len, self.openings))]
        if any(o.startswith(rest) for o in self.openings):
            return None
        raise ValueError(f"no turn at {at}")

    @property
    def openings(self) -> list[str]:
        return [o for o, _, _ in self.roles.values()] + [self.other[0]]

    def turns(self, text: str) -> tuple[list[tuple[str, str, bool]], int]:
        """(role, text, loss) of the whole turns at the start of formatted text, and where what follows them begins."""
        out, at = [], 0
        while at < len(text):
            opened = self._opened(text, at)
            if opened is None:
                break
            role, closing, loss, start = opened
            found = text.find(closing.strip(), start)
            end = found - (len(closing) - len(closing.lstrip()))
            if found < 0 or not text.startswith(closing, end):
                break
            out.append((role, self.unescape(text[start:end]), loss))
            at = end + len(closing)
        return out, at

    def read(self, formatted: str):
        """(role, text, loss) of each turn of formatted text; a ValueError tells of text outside turns."""
        out, at = self.turns(formatted)
        if at < len(formatted):
            raise ValueError(f"no whole turn at {at}")
        return iter(out)


class Reader:
    """Reads a formatted conversation that comes in pieces cut anywhere: where turns begin and end is found in the text alone."""

    def __init__(self, template: Template):
        self.template, self.rest = template, ""

    def feed(self, piece: str) -> list[tuple[str, str, bool]]:
        self.rest += piece
        out, at = self.template.turns(self.rest)
        self.rest = self.rest[at:]
        return out

    def close(self) -> None:
        if self.rest:
            raise ValueError(f"text behind the last turn: {self.rest[:40]!r}")


#: state, role -> state; anything else goes to "wrong" for good.
MOVES = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}


def step(state: str, role: str) -> str:
    return MOVES.get((state, role), "wrong")


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, segment, text, loss: the formatted output as rows (general interface)."""
    shared.bound_batches(conversations.sparkSession)
    template = template or Template()

    def run(it):
        now, turn = None, 0
        for pdf in it:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                key = None if pd.isna(conv) else int(conv)
                turn = turn + 1 if turn and key == now else 1
                now = key
                out += [(key, turn - 1, k, s, loss) for k, (s, loss) in enumerate(template.segments(role, text))]
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "segment", "text", "loss"]).astype({"conv_id": "Int64"})

    return _ordered(conversations).mapInPandas(run, "conv_id long, turn_no long, segment int, text string, loss boolean")


def conversation_digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, read back from the formatted text."""
    shared.bound_batches(conversations.sparkSession)
    template = template or Template()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(it):
        state = None

        def row(s):
            s["reader"].close()
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["state"] == "assistant")

        def read(s):
            """What was written so far is read back as one text, whose turns the reader finds."""
            piece = "".join(s["written"])
            s["written"] = []
            s["chars"] += len(piece)
            for role, said, loss in s["reader"].feed(piece):
                s["n"] += 1
                s["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    s["loss_chars"] += len(said)
                    s["loss"].update(said.encode("utf-8", "surrogatepass"))
                s["state"] = step(s["state"], role)

        for pdf in it:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                key = None if pd.isna(conv) else int(conv)
                if state is None or state["conv"] != key:
                    if state is not None:
                        read(state)
                        out.append(row(state))
                    state = {"conv": key, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "state": "start", "written": [], "reader": Reader(template)}
                state["written"] += [s for s, _ in template.segments(role, text)]
            if state is not None:
                read(state)
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([row(state)], columns=columns).astype({"conv_id": "Int64"})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return _ordered(conversations).mapInPandas(run, schema)
