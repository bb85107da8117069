r"""Chat formatting with typed content parts.

A visitor flattens the ordered parts of a turn (text, image, audio, document)
into text with placeholders, and records attachment references and the tokens
each placeholder expands to. The template marks turns with control strings;
``\``, ``<`` and ``[`` inside texts are escaped by a backslash, so any unescaped
``<`` or ``[`` begins a control string and the text can be read back.

Flattening and formatting are row-local. The digest of a conversation is a
sequential hash, so its turns stream through one task in order with constant
memory, whatever their number.

Defined results: a null text is empty, a null role is the empty role; turns
with the same number are ordered by role, then text, repeated rows are kept; a
null conversation id is one conversation; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, text_of

# The control strings of the template. Other roles are written between [ROLE] and [/ROLE].
START, END = "<s>", "</s>"
OPEN = {"user": "[INST] ", "assistant": "[ANS] ", "system": "[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": " [/ANS]", "system": " [/SYS]"}
ROLE_OPEN, ROLE_CLOSE = "[ROLE]", "[/ROLE]"
ESCAPED = re.compile(r"[\\<\[]")
READ = re.compile(r"\\.|<s>|</s>|<[a-z]+:\d+>|\[INST\] | \[/INST\]|\[ANS\] | \[/ANS\]|\[SYS\] | \[/SYS\]|\[ROLE\]|\[/ROLE\]|[^\\<\[ ]+|.", re.S)
PLACEHOLDER = re.compile(r"<([a-z]+):(\d+)>")
PATCH, SECOND_TOKENS, PAGE_TOKENS = 14, 25, 600
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


class Flattener:
    """Visits parts in order; afterwards holds text, attachments and expanded tokens."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * SECOND_TOKENS))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self.attach("unknown", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((len(self.attachments), kind, part.get("ref"), max(1, tokens)))
        self.out.append(f"<{kind}:{len(self.attachments) - 1}>")


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def open_turn(role: str) -> str:
    return START + (OPEN[role] if role in OPEN else f"{ROLE_OPEN}{escape(role)}{ROLE_CLOSE}")


def close_turn(role: str) -> str:
    return CLOSE.get(role, "") + END


def read_body(body: str) -> list[tuple[str, str]]:
    """The parts of escaped text in order: ("text", unescaped text), or (kind, place) of a placeholder."""
    out: list[tuple[str, str]] = []
    for token in READ.findall(body):
        found = PLACEHOLDER.fullmatch(token)
        if found:
            out.append((found[1], found[2]))
            continue
        said = token[1:] if token[0] == "\\" else token
        if out and out[-1][0] == "text":
            said = out.pop()[1] + said
        out.append(("text", said))
    return out


def read_turn(formatted: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """Role and typed parts of one formatted turn: the inverse of the visitor, but for sizes, which became token counts."""
    reader = Reader()
    role, body = reader.turn_of(formatted)
    parts = [{"type": kind, "text": said} if kind == "text" else {"type": kind, "ref": attachments[int(said)]["ref"], "tokens": attachments[int(said)]["tokens"]} for kind, said in read_body(body)]
    return role, parts


class Reader:
    """Reads formatted turns one by one and hashes what they say; memory does not grow with their number.

    The loss text is the unescaped slice of the recorded span, not that of a role.
    A placeholder counts as itself behind a zero sign, so that no text equals it.
    """

    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def turn_of(self, formatted: str) -> tuple[str, str]:
        """Role and escaped text of one turn."""
        if not formatted.startswith(START):
            raise ValueError("a turn begins with its control string")
        rest = formatted[len(START) :]
        for role, head in OPEN.items():
            if rest.startswith(head):
                return role, rest[len(head) : len(rest) - len(close_turn(role))]
        stop = rest.index(ROLE_CLOSE)  # an escaped [ does not begin it
        while rest[stop - 1] == "\\" and not self.even(rest, stop):
            stop = rest.index(ROLE_CLOSE, stop + 1)
        role = said([("text", x) for _, x in read_body(rest[len(ROLE_OPEN) : stop])])
        return role, rest[stop + len(ROLE_CLOSE) : len(rest) - len(close_turn(role))]

    @staticmethod
    def even(text: str, at: int) -> bool:
        """Whether an even number of backslashes stands before this place."""
        head = text[:at]
        return (len(head) - len(head.rstrip("\\"))) % 2 == 0

    def feed(self, formatted: str, start: int, end: int) -> None:
        """One whole turn and the span of it under the loss mask."""
        role, body = self.turn_of(formatted)
        self.n_turns += 1
        self.chars += len(formatted)
        self.turns.update(f"{role}\n{said(read_body(body))}\n".encode("utf-8", "surrogatepass"))
        if end > start:
            loss = said(read_body(formatted[start:end]))
            self.loss_chars += len(loss)
            self.loss.update(loss.encode("utf-8", "surrogatepass"))


def said(parts: list[tuple[str, str]]) -> str:
    """Parts as one text."""
    return "".join(x if kind == "text" else f"\0<{kind}:{x}>" for kind, x in parts)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str | None = None, text: str = "text") -> DataFrame:
    """One row for each turn: conv, turn, role, formatted, loss_start, loss_end, attachments, expanded_tokens.

    ``parts`` names a column of arrays of ``PART``; without it the text is the
    only part. The span [loss_start, loss_end) of ``formatted`` (escaped text of
    an assistant) is under the loss mask; it is empty for other roles.
    """
    small_batches(turns.sparkSession)
    one = F.array(F.struct(F.lit("text").alias("type"), text_of(text).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    content = one if parts is None else F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))

    @F.pandas_udf("formatted string, loss_start int, loss_end int, attachments array<struct<place:int,kind:string,ref:string,tokens:int>>, expanded_tokens long")
    def made(roles: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for r, c in zip(roles, contents, strict=True):
            seen = Flattener()
            for part in c:
                seen.visit(part if isinstance(part, dict) else part.asDict())
            head, body, tail = open_turn(r), "".join(seen.out), close_turn(r)
            start, end = (len(head), len(head) + len(body)) if r == "assistant" else (0, 0)
            rows.append((head + body + tail, start, end, [dict(zip(("place", "kind", "ref", "tokens"), a, strict=True)) for a in seen.attachments], sum(a[3] for a in seen.attachments)))
        return pd.DataFrame(rows, columns=["formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    plain = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), text_of(role).alias("role"), content.alias("content"), text_of(text).alias("__tie"))
    return plain.withColumn("__m", made("role", "content")).select("conv", "turn", "role", "__tie", "__m.*")


def digest(formatted: DataFrame) -> DataFrame:
    """Reads each conversation back from its formatted turns, in order.

    Columns: conv, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Rows are sorted outside memory and streamed, so a
    conversation may be of any length.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reader, out = None, None, []

        def close() -> None:
            out.append((now[0], reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        for batch in batches:
            for none, conv, text, start, end in zip(batch["none"], batch["conv"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
                key = (None,) if none else (int(conv),)
                if key != now:
                    if reader:
                        close()
                    now, reader = key, Reader()
                reader.feed(text, start, end)
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=NAMES).astype({"conv": "Int64"})
                out.clear()
        if reader:
            close()
        yield pd.DataFrame(out, columns=NAMES).astype({"conv": "Int64"})

    rows = formatted.select("conv", "turn", "role", "__tie", "formatted", "loss_start", "loss_end").repartition("conv").sortWithinPartitions("conv", "turn", "role", "__tie")
    rows = rows.select(F.coalesce("conv", F.lit(0)).cast("long").alias("conv"), F.col("conv").isNull().alias("none"), "formatted", "loss_start", "loss_end")
    return rows.mapInPandas(work, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


NAMES = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
