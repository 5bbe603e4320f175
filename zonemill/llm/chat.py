"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document).  A visitor
flattens them in order into one escaped string: text is escaped, any other part
becomes a placeholder that names its place in the turn's attachment list, and
counts the tokens it will expand to.  Each turn becomes

    <turn:ROLE>CONTENT</turn>\n

and a conversation is its turns in order, one row each, so a conversation of any
length is never one value.  ``\\``, ``<`` and ``>`` inside texts and roles get a
backslash; nothing inside a text can therefore open or close a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,amount:double>"
FORMATTED = (
    "conv_id long, turn long, formatted string, loss_start int, loss_chars int, "
    "attachments array<struct<type:string,ref:string,offset:int,tokens:long>>, expanded_tokens long"
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_SPECIAL = re.compile(r"[\\<>]")
_TURN = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.|<part:[a-z]+ \d+>)*)</turn>\n", re.S)
_PIECE = re.compile(r"<part:([a-z]+) (\d+)>|\\(.)|([^\\<>]+)", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text) if _SPECIAL.search(text) else text


def unescape(text: str) -> str:
    """The text of ``escape``; placeholders are left out."""
    if "\\" not in text and "<" not in text:
        return text
    return "".join(m[3] or m[4] or "" for m in _PIECE.finditer(text))


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    #: Tokens that one unit of a part expands to: a square of 28 pixels, a second, a page.
    rates: dict[str, float] = field(default_factory=lambda: {"image": 1.0, "audio": 25.0, "document": 500.0})

    def visit(self, parts: list[dict]) -> tuple[str, list[dict], int]:
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []
        self.tokens = 0
        for part in parts:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)
        return "".join(self.out), self.attachments, self.tokens

    def _put(self, piece: str) -> None:
        self.out.append(piece)
        self.size += len(piece)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"type": kind, "ref": part.get("ref"), "offset": self.size, "tokens": tokens})
        self.tokens += tokens
        self._put(f"<part:{kind} {len(self.attachments) - 1}>")

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, max(1, round((part.get("amount") or 0) * self.rates["image"])))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round((part.get("amount") or 0) * self.rates["audio"])))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, round((part.get("amount") or 0) * self.rates["document"])))

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown content part: {part.get('type')!r}")


def format_turn(role: str | None, parts: list[dict]) -> dict:
    content, attachments, tokens = Flattener().visit(parts)
    head = f"<turn:{escape(role or '')}>"
    learns = role == "assistant"
    for a in attachments:
        a["offset"] += len(head)
    return {
        "formatted": f"{head}{content}</turn>\n",
        "loss_start": len(head) if learns else None,
        "loss_chars": len(content) if learns else None,
        "attachments": attachments,
        "expanded_tokens": tokens,
    }


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; placeholders carry no text."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One formatted row for each turn; ``FORMATTED`` is its schema.

    * content is ``parts_col`` (array of ``PART``) if given and not null, else
      the ``text`` column as one text part; null text is empty
    * a null role is empty; only the role ``assistant`` is under the loss mask,
      which is the span ``loss_start``, ``loss_chars`` of ``formatted``
    * null conv_id or turn stay null; repeated rows are formatted each
    * other columns are not read; an empty table gives an empty result
    """
    content = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))
    if parts_col:
        content = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), content)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), content.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attachment = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("offset", pa.int32()), ("tokens", pa.int64())]))
        for batch in batches:
            made = [format_turn(r, p) for r, p in zip(batch["role"].to_pylist(), batch["parts"].to_pylist(), strict=True)]
            kinds = {"formatted": pa.string(), "loss_start": pa.int32(), "loss_chars": pa.int32(), "attachments": attachment, "expanded_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], *(pa.array([m[k] for m in made], t) for k, t in kinds.items())], names=["conv_id", "turn", *kinds]
            )

    return rows.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """A digest of each conversation, from its formatted turns alone (schema ``DIGEST``).

    Turns of a conversation are streamed in order through running hashes, so the
    longest conversation costs time in one task but no memory.  Equal turn
    numbers are ordered by their formatted text.
    """
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_chars").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple] = []

        def close() -> tuple:
            conv, n, turns, loss, chars, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), kinds)], names=names)
            done.clear()
            return batch

        for batch in batches:
            for conv, text, start, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_chars"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(close())
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, said = parse_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    learned = unescape(text[start : start + chars])
                    state[3].update(learned.encode())
                    state[4] += len(learned)
                state[5] += len(text)
            if done:
                yield flush()
        if state is not None:
            done.append(close())
            yield flush()

    return rows.mapInArrow(run, DIGEST)
