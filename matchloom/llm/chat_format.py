"""Chat formatting with typed content parts.

A visitor walks the parts of a turn (text, image, audio, document) in order and flattens
them into one string: texts are escaped, the others become numbered placeholders whose
references, offsets and expanded token counts are recorded.  Each turn is then
``<|im_start|>role\\ntext<|im_end|>\\n``, with a loss mask over assistant text.

Escaping is reversible: in a text, ``<``, any backslashes and ``|`` get one backslash more, so
no control string (they all begin ``<|``) can come out of a text, and reading back takes one
backslash away.

Turns are separate rows, so no conversation is gathered into one value.  Null texts are
empty, null roles are empty, null turns sort first; turns with equal numbers sort by role,
then text, and all are kept.  Conversations with a null id form one conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "\n"
PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
TURNS = "conv_id long, turn long, seq long, formatted string, mask array<struct<start:long,stop:long>>, attachments array<struct<ordinal:long,kind:string,ref:string,offset:long,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for."""

    patch: int = 28
    audio_per_second: float = 12.5
    per_page: int = 256


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    expansion: Expansion
    ordinal: int = 0
    out: list[str] = field(default_factory=list)
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:
            raise ValueError(f"unknown content part {kind!r}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")

    def settle(self) -> None:
        """Escape the texts that stand next to each other as one, so that none can complete a control string for another."""
        text = escape("".join(self.pending))
        self.pending.clear()
        if text:
            self.spans.append((self.at, self.at + len(text)))
            self.put(text)

    def visit_image(self, part: dict) -> None:
        p = self.expansion.patch
        self.attach("image", part, math.ceil((part.get("width") or p) / p) * math.ceil((part.get("height") or p) / p))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.expansion.audio_per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 1) * self.expansion.per_page)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.settle()
        self.ordinal += 1
        self.attachments.append({"ordinal": self.ordinal, "kind": kind, "ref": part.get("ref"), "offset": self.at, "tokens": tokens})
        self.put(f"<|{kind}_{self.ordinal}|>")

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)


def text_parts(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Give rows of plain text a ``parts`` column with one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).cast("struct<kind:string,text:string>")
    full = F.struct(part["kind"].alias("kind"), part["text"].alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("long").alias("pages"))
    return df.withColumn("parts", F.array(full))


def format_turns(df: DataFrame, *, trained_role: str = "assistant", expansion: Expansion = Expansion()) -> DataFrame:
    """Format rows ``conv_id, turn, role, parts``; one row per turn, conversations whole and in order within a partition.

    ``formatted`` is the turn's piece of the conversation's string, ``mask`` its loss spans
    (code points in the piece), ``attachments`` its placeholders (numbered through the
    conversation; null parts are skipped), ``expanded_tokens`` the tokens they stand for.
    """
    slim = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("parts"))
    key = F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))
    slim = slim.withColumn("k", F.array_join(key, "\u0001")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "k").drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("attachments", pa.list_(pa.struct([("ordinal", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])
        now, seq, ordinal = object(), 0, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    now, seq, ordinal = row["conv_id"], 0, 0
                head = f"{START}{escape_role(row['role'])}{BREAK}"
                visitor = Flattener(expansion, ordinal, [head], len(head))
                for part in row["parts"] or []:
                    if part is not None:
                        visitor.visit(part)
                visitor.settle()
                visitor.put(END)
                ordinal = visitor.ordinal
                mask = visitor.spans if row["role"] == trained_role else []
                rows.append({"conv_id": now, "turn": row["turn"], "seq": seq, "formatted": "".join(visitor.out), "mask": [{"start": a, "stop": b} for a, b in mask], "attachments": visitor.attachments, "expanded_tokens": sum(a["tokens"] for a in visitor.attachments)})
                seq += 1
            yield pa.RecordBatch.from_pylist(rows, schema)

    return slim.mapInArrow(run, TURNS)


def read_turns(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Read (role, text) back from the pieces of one conversation's string, cut anywhere."""
    rest = ""
    for piece in pieces:
        rest += piece
        while (stop := rest.find(END)) >= 0:
            turn, rest = rest[:stop], rest[stop + len(END) :]
            if not turn.startswith(START):
                raise ValueError("a turn must begin with its mark")
            role, _, text = turn[len(START) :].partition(BREAK)
            yield unescape_role(role), unescape(text)
    if rest:
        raise ValueError("the last turn has no end")


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Read formatted turns back: one row per conversation with counts and digests.

    Turns of a conversation stand together and in order, as :func:`format_turns` leaves
    them; hashes are fed turn by turn, so memory holds one turn however long the conversation.
    """
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        names = [f.split()[0] for f in fields.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def close() -> None:
            if state:
                done.append([state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            ids, seqs, texts, masks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "seq", "formatted", "mask"))
            for conv, seq, text, mask in zip(ids, seqs, texts, masks):
                if seq == 0:
                    close()
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, said in read_turns(iter([text])):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                state["chars"] += len(text)
                for span in mask:
                    own = unescape(text[span["start"] : span["stop"]])
                    state["loss_chars"] += len(own)
                    state["loss"].update(own.encode())
            if len(done) > 5000:
                yield flush()
        close()
        yield flush()

    return turns.select("conv_id", "seq", "formatted", "mask").mapInArrow(run, fields)
