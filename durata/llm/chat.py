r"""Chat formatting with typed content parts, reversible escapes and a loss mask.

A turn is a list of parts: text, image, audio or document. A visitor flattens the parts of a
conversation in order: text parts are escaped and written out, the others become placeholders
``<|image|>``, ``<|audio|>``, ``<|document|>``; each placeholder is recorded as an attachment
(ordinal, type, reference, turn, offset) with the number of tokens that it expands to.

Template: every turn is ``<|turn|>`` role ``<|body|>`` content ``<|end|>``. Inside texts a
backslash is doubled and every control string (those of the template and the usual ones of
other templates) gets a backslash after its first character, so no control string of a text
survives in the output and removing the backslashes gives the text back exactly. Text parts
that follow each other are one text before that, so no control string is put together from
several parts. The loss
mask is the list of spans, in code points, of the contents of assistant turns.

A conversation is one output row and is built in one task, as its string is one value; turns
come in order of turn, role and text (nulls first). Null roles and texts count as empty;
repeated rows are turns of their own; null conversation ids form a conversation; null
parts are empty texts; unknown part types raise. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(r"<\|(turn|body|end|image|audio|document)\|>")
#: Side of an image patch, audio tokens a second, tokens of a document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25.0, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "formatted string, loss array<struct<start:bigint,stop:bigint>>, "
    "attachments array<struct<ordinal:bigint,type:string,ref:string,turn:bigint,offset:bigint,tokens:bigint>>, "
    "expanded_tokens bigint"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits typed parts and writes one conversation."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.at = 0
        self.turn = -1
        self.text: list[str] = []
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_turn(self, role: str, parts: list[dict]) -> None:
        self.turn += 1
        self.write(TURN + escape(role) + BODY)
        start = self.at
        for part in parts:
            part = part or {"type": "text", "text": None}
            kind = part["type"] or "text"
            visitor = getattr(self, f"visit_{kind}", None)
            if visitor is None:
                raise ValueError(f"unknown content part: {kind}")
            visitor(part)
        self.flush()
        if role == "assistant":
            self.loss.append({"start": start, "stop": self.at})
        self.write(END)

    def visit_text(self, part: dict) -> None:
        self.text.append(part["text"] or "")

    def flush(self) -> None:
        """Writes the text parts since the last placeholder as one escaped text."""
        self.write(escape("".join(self.text)))
        self.text = []

    def visit_image(self, part: dict) -> None:
        rows = math.ceil((part["height"] or PATCH) / PATCH)
        self.attach(part, rows * math.ceil((part["width"] or PATCH) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, math.ceil((part["seconds"] or 0) * PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, PER_PAGE * max(1, part["pages"] or 1))

    def attach(self, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append(
            {
                "ordinal": len(self.attachments), "type": part["type"], "ref": part["ref"],
                "turn": self.turn, "offset": self.at, "tokens": tokens,
            }
        )
        self.write(PLACEHOLDERS[part["type"]])


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) per turn of a formatted conversation; placeholders stay in the text."""
    turns, role, start, state = [], "", 0, None
    for m in _MARK.finditer(formatted):
        if m[1] == "turn":
            start, state = m.end(), "turn"
        elif m[1] == "body" and state == "turn":
            role, start, state = unescape(formatted[start : m.start()]), m.end(), "body"
        elif m[1] == "end" and state == "body":
            turns.append((role, unescape(formatted[start : m.start()])))
            state = None
    return turns


def format_chat(rows: DataFrame, parts: str | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, loss, attachments, expanded_tokens) per conversation.

    ``rows`` has conv_id, turn, role, and text or, if ``parts`` names one, a column of typed
    parts (``PART``) that takes the text's place where it is not null.
    """
    own = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    own = F.from_json(F.to_json(own), f"array<{PART}>") if parts else own
    content = F.coalesce(F.col(parts).cast(f"array<{PART}>"), own) if parts else own
    turns = rows.select(
        "conv_id", F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"),
            *([F.col("text")] if "text" in rows.columns else []), content.alias("parts"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.parts as parts))").alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {k: [] for k in ("n_turns", "formatted", "loss", "attachments", "expanded_tokens")}
            for turns in batch.column(1).to_pylist():
                f = Flattener()
                for t in turns:
                    f.visit_turn(t["role"], t["parts"])
                made["n_turns"].append(len(turns))
                made["formatted"].append("".join(f.out))
                made["loss"].append(f.loss)
                made["attachments"].append(f.attachments)
                made["expanded_tokens"].append(sum(a["tokens"] for a in f.attachments))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, _ARROW[k]) for k, v in made.items()]],
                names=["conv_id", *made],
            )

    return grouped.mapInArrow(run, f"conv_id {kind}, n_turns long, {FORMATTED}")


_ARROW = {
    "n_turns": pa.int64(), "formatted": pa.string(), "expanded_tokens": pa.int64(),
    "loss": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
    "attachments": pa.list_(
        pa.struct(
            [("ordinal", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("turn", pa.int64()),
             ("offset", pa.int64()), ("tokens", pa.int64())]
        )
    ),
}


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted conversations."""
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns_sha, chars, loss_sha, size = [], [], [], [], []
            for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(formatted)
                learnt = "".join(unescape(formatted[x["start"] : x["stop"]]) for x in loss)
                n.append(len(turns))
                turns_sha.append(
                    hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                )
                chars.append(len(learnt))
                loss_sha.append(hashlib.sha256(learnt.encode()).hexdigest())
                size.append(len(formatted))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()),
                 pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return chats.select("conv_id", "formatted", "loss").mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )


def op3_chat_formatting(conversations: DataFrame) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(2).selectExpr(
        "-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text"
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chat(rows))
