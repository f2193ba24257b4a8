"""Chat formatting with typed content parts.

A message is a role and a list of parts (text, image, audio, document). A
visitor flattens the parts in order: text is escaped, every other part becomes a
placeholder, its reference is recorded as an attachment and its expanded token
count is noted. Turns are marked with control strings that cannot occur inside
a text, because the escape changes them there, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Control strings of common chat templates, escaped inside texts beside the own ones.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
CONTROLS = (TURN, TEXT, END, *PLACEHOLDERS.values(), *FOREIGN)
#: Pattern of what follows the first character of a control string.
CONTROL_BODIES = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_CONTROL = re.compile(rf"([<\[])(\\*)({CONTROL_BODIES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({CONTROL_BODIES})")
#: A conversation's output is cut into segments of whole turns of about this size.
SEGMENT_CHARS = 1 << 20


def escape(text: str) -> str:
    """Add a backslash after the first character of every control string, escaped ones too."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return _ESCAPED.sub(r"\1\2\3", text)


@dataclass
class Flattened:
    """Output of a visit: formatted text, attachments (kind, ref, offset, tokens), extra tokens."""

    out: str = ""
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0


class PartVisitor:
    """Flattens content parts; a method per kind."""

    patch, seconds_per_token, tokens_per_page = 28, 0.04, 1024

    def visit(self, parts: Iterable[dict], at: int = 0) -> Flattened:
        """Visit ``parts`` in order; ``at`` is the offset of the output in its segment."""
        done = Flattened()
        for part in parts:
            kind = part.get("kind") or "text"
            getattr(self, f"visit_{kind}", self.visit_text)(part, done, at)
        return done

    def visit_text(self, part: dict, done: Flattened, at: int) -> None:
        done.out += escape(part.get("text") or "")

    def _place(self, kind: str, part: dict, done: Flattened, at: int, tokens: int) -> None:
        done.attachments.append({"kind": kind, "ref": part.get("ref") or "", "offset": at + len(done.out), "tokens": tokens})
        done.out += PLACEHOLDERS[kind]
        done.expanded += tokens

    def visit_image(self, part: dict, done: Flattened, at: int) -> None:
        width, height = part.get("width") or 0, part.get("height") or 0
        self._place("image", part, done, at, max(1, -(-width // self.patch) * -(-height // self.patch)))

    def visit_audio(self, part: dict, done: Flattened, at: int) -> None:
        self._place("audio", part, done, at, max(1, round((part.get("seconds") or 0.0) / self.seconds_per_token)))

    def visit_document(self, part: dict, done: Flattened, at: int) -> None:
        self._place("document", part, done, at, max(1, (part.get("pages") or 0) * self.tokens_per_page))


PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def text_part(text):
    """The parts column of a message that is text alone."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *empty)).cast(f"array<{PART}>")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Segments (conv_id, segment, formatted, loss spans, attachments, expanded) of sorted messages."""
    visitor, conv, number = PartVisitor(), None, 0
    pieces: list[str] = []
    size, spans, attached, expanded, is_open = 0, [], [], 0, False

    def close():
        nonlocal pieces, size, spans, attached, expanded
        row = (conv, number, "".join(pieces), spans, attached, expanded)
        pieces, size, spans, attached, expanded = [], 0, [], [], 0
        return row

    for batch in batches:
        for c, role, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if is_open and (c != conv or size >= SEGMENT_CHARS):
                yield close()
                number = number + 1 if c == conv else 0
            elif not is_open:
                number = 0
            conv, is_open = c, True
            head = TURN + escape(role or "") + TEXT
            flat = visitor.visit(parts or [], size + len(head))
            if role == "assistant":
                spans.append({"start": size + len(head), "end": size + len(head) + len(flat.out)})
            pieces += [head, flat.out, END]
            size += len(head) + len(flat.out) + len(END)
            attached += flat.attachments
            expanded += flat.expanded
    if is_open:
        yield close()


def format_chats(messages: DataFrame) -> DataFrame:
    """Format ``messages`` (conv_id, turn, role, parts) per conversation.

    Returns conv_id, segment, formatted, loss_spans (start, end in the segment;
    what the assistant says), attachments (kind, ref, offset, tokens) and
    expanded_tokens. Turns follow by turn, then role and content, so ties and
    repeated rows have one order; a null turn comes first, a null role is empty,
    a null conv_id is a conversation. A conversation is streamed: its output is
    cut into segments of whole turns, so its length has no bound in memory.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "segment", "formatted", "loss_spans", "attachments", "expanded_tokens"]
    schema = (
        f"conv_id {kind}, segment long, formatted string, loss_spans array<struct<start: long, end: long>>, "
        "attachments array<struct<kind: string, ref: string, offset: long, tokens: long>>, expanded_tokens long"
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    attachment = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())]))

    def run(batches):
        key = pa.int64()

        def keyed():
            nonlocal key
            for b in batches:
                key = b.schema.field(0).type
                yield b

        rows: list[tuple] = []
        held = 0

        def flush():
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key, pa.int64(), pa.string(), span, attachment, pa.int64()))], names)

        for row in _segments(keyed()):
            rows.append(row)
            held += len(row[2])
            if held > SEGMENT_CHARS:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    tie = F.array_join(F.transform("parts", lambda p: F.concat_ws("|", p["kind"], p["text"], p["ref"])), "|")
    ordered = messages.select("conv_id", "role", "parts", "turn", tie.alias("_tie")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "_tie")
    return ordered.select("conv_id", "role", "parts").mapInArrow(run, schema)


_TURN_PARTS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted segment, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _TURN_PARTS.findall(formatted)]


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back, segment after segment, and digest them.

    Expects the rows of :func:`format_chats` in its order (no shuffle between).
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        conv, is_open, rows = None, False, []
        turns = loss = None
        n = chars = total = 0
        key = pa.int64()

        def close():
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            key = batch.schema.field(0).type
            for c, segment, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not is_open or c != conv or segment == 0:
                    if is_open:
                        close()
                    conv, is_open, turns, loss, n, chars, total = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    chars += len(said)
                total += len(text)
            if rows:
                yield flush(rows, key)
                rows = []
        if is_open:
            close()
            yield flush(rows, key)

    def flush(rows, key):
        kinds = (key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "segment", "formatted", "loss_spans").mapInArrow(run, schema)
