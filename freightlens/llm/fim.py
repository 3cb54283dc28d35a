"""Fill-in-the-middle by a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its UTF-8 bytes and the
sentinels. Cutting splits a descriptor, an arrangement permutes the list and sets sentinels between, and the inverse
permutation puts the parts that are read back between sentinels into their old order. Hashes stream the descriptors'
bytes, so no second copy of a text is made for them; a text is copied once, when it is written.

Cuts are drawn from a hash of the seed and the key, so a task that runs again writes the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from freightlens.llm.tables import spare_name, text_slices

TEXT, SENTINELS = 0, 1
PLAIN = "plain"
#: Parts by number in the order of the document; a form names the order in which they are written.
PREFIX, MIDDLE, SUFFIX = range(3)
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class Rule:
    """Sentinels by part, the seed of the draws, the share of documents that is rearranged, and that of them in spm (per cent)."""

    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"
    seed: int = 1
    rearranged: int = 90
    spm: int = 20

    def marks(self) -> list[bytes]:
        return [s.encode() for s in (self.prefix, self.middle, self.suffix)]


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The same bytes with a boundary at byte `at`: the first descriptor that reaches it becomes two, one perhaps empty."""
    out: list[Piece] = []
    for buffer, start, length in pieces:
        if 0 <= at <= length:
            out += [(buffer, start, at), (buffer, start + at, length - at)]
            at = -1
        else:
            out.append((buffer, start, length))
            at -= length if at >= 0 else 0
    return out


def arrange(parts: list[Piece], form: str, marks: list[bytes]) -> list[Piece]:
    """Three parts in the form's order, each after its sentinel."""
    starts = np.cumsum([0, *map(len, marks)]).tolist()
    return [p for k in FORMS[form] for p in ((SENTINELS, starts[k], len(marks[k])), parts[k])]


def read_parts(output: bytes, form: str, marks: list[bytes]) -> list[Piece]:
    """The text's pieces over `output`, in document order: what stands after each sentinel, by the inverse permutation.
    The first place of each sentinel is its own, as no text that is rearranged holds one."""
    order, pieces, at = FORMS[form], [], 0
    for k, following in zip(order, [*order[1:], None]):
        at += len(marks[k])
        end = len(output) if following is None else output.index(marks[following], at)
        pieces.append((TEXT, at, end - at))
        at = end
    return [pieces[i] for i in np.argsort(order)]


def stream(pieces: list[Piece], buffers: tuple[bytes, bytes]) -> Iterator[memoryview]:
    views = [memoryview(b) for b in buffers]
    return (views[buffer][start : start + length] for buffer, start, length in pieces)


def digest(pieces: list[Piece], buffers: tuple[bytes, bytes]) -> str:
    held = hashlib.sha256()
    for part in stream(pieces, buffers):
        held.update(part)
    return held.hexdigest()


def _starts(text: bytes) -> np.ndarray | None:
    """Byte offset of every code point and of the end; None where each is one byte."""
    if text.isascii():
        return None
    return np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))


def _row(key: object, text: bytes, rule: Rule, marks: list[bytes]) -> tuple:
    starts = _starts(text)
    n = len(text) if starts is None else len(starts) - 1
    drawn = hashlib.sha256(f"{rule.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in range(0, 32, 8))
    pieces: list[Piece] = [(TEXT, 0, len(text))]
    buffers = (text, b"".join(marks))
    if not text or any(m in text for m in marks) or h3 % 100 >= rule.rearranged:
        return n, PLAIN, None, None, text, digest(pieces, buffers)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    for at in (first, last):
        pieces = split(pieces, at if starts is None else int(starts[at]))
    form = "spm" if h4 % 100 < rule.spm else "psm"
    written = arrange(pieces, form, marks)
    return n, form, first, last - first, b"".join(stream(written, buffers)), digest(written, buffers)


def _mapped(df: DataFrame, column: str, kind: str, inputs: list[str], make) -> DataFrame:
    """`df` with one struct column more, made from some of its columns a slice of rows at a time."""
    place = {c: i for i, c in enumerate(df.columns)}
    schema = StructType([*df.schema.fields]).add(column, StructType.fromDDL(kind))
    at = [place[c] for c in inputs]

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, at[0]):
                rows = batch.slice(first, len(texts))
                made = make(texts, *[rows.column(i).to_pylist() for i in at[1:]])
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names=[*rows.schema.names, column])

    return df.mapInArrow(run, schema)


def transformed(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", column: str = "fim") -> DataFrame:
    """`docs` and a struct `column` (a spare name if taken): n, form, prefix_chars, middle_chars, output, output_sha256.

    n counts code points, and cuts stand between code points. A NULL text is empty; empty texts, texts that hold a sentinel
    and the share that the rule leaves are `plain`: output is the text, and the counts of parts are NULL. A NULL key draws
    as an empty one. Equal rows get equal outputs; an empty table gives no rows.
    """
    marks = rule.marks()
    kind = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]

    def make(texts, keys):
        rows = [_row(k, (t or "").encode("utf-8", "surrogatepass"), rule, marks) for t, k in zip(texts, keys)]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        columns[4] = [o.decode("utf-8", "surrogatepass") for o in columns[4]]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return _mapped(docs, spare_name(docs, column), kind, [text, key], make)


def restored(df: DataFrame, output: str, form: str, rule: Rule = Rule(), column: str = "restored") -> DataFrame:
    """`df` and a struct `column` (a spare name if taken): text and sha256, rebuilt from the columns `output` and `form`
    alone. A NULL output is empty; forms other than psm and spm are read as plain."""
    marks = rule.marks()

    def make(outputs, forms):
        texts, hashes = [], []
        for written, form in zip(outputs, forms):
            raw = (written or "").encode("utf-8", "surrogatepass")
            pieces = read_parts(raw, form, marks) if form in FORMS else [(TEXT, 0, len(raw))]
            texts.append(b"".join(stream(pieces, (raw, b""))).decode("utf-8", "surrogatepass"))
            hashes.append(digest(pieces, (raw, b"")))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(hashes, pa.string())], ["text", "sha256"])

    return _mapped(df, spare_name(df, column), "text string, sha256 string", [output, form], make)
