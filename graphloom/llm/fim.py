"""Fill-in-the-middle: each text is cut at two places and its middle moved to the end.

Places are found with big integers, one bit a byte of the text.  bytes.translate turns
the bytes of a class into 1 and all others into 0, which reads as a number in base 2;
boolean operations on shifted masks mark where units begin; bit_count gives how many there
are, and the k-th is found by halving: the mask's upper half holds the earlier units, so its
count tells in which half the k-th lies.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parts of a hundred that are left plain, and of the rest that put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
UNITS = ("chars", "words", "lines")


def _table(inside) -> bytes:
    return bytes(49 if inside(b) else 48 for b in range(256))


_CLASSES = {
    "follow": _table(lambda b: 0x80 <= b < 0xC0),  # bytes within a code point
    "space": _table(lambda b: b in b" \t\n\x0b\x0c\r"),
    "feed": _table(lambda b: b == 10),
}


def _mask(data: bytes, name: str) -> int:
    return int(data.translate(_CLASSES[name]), 2)


def starts(data: bytes, unit: str = "chars") -> int:
    """The bytes at which units begin, as bits; the first byte is the highest bit.

    chars: code points; words: runs without white space, each with the white space before it
    (white space at the end is one more); lines: lines with their feeds.
    """
    n = len(data)
    if not n:
        return 0
    every, first = (1 << n) - 1, 1 << (n - 1)
    if unit == "chars":
        return every ^ _mask(data, "follow")
    if unit == "lines":
        return _mask(data, "feed") >> 1 | first
    space = _mask(data, "space")
    begin = space & ~(space >> 1) & every  # the first white space after a word
    return begin | first


def select(mask: int, length: int, k: int) -> int:
    """The place from the left, in a mask of length bits, of its k-th set bit (from 0); length if there are no more than k."""
    if k >= mask.bit_count():
        return length
    at = 0
    while length > 1:
        low = length // 2
        upper = mask >> low
        held = upper.bit_count()
        if k < held:
            mask, length = upper, length - low
        else:
            k -= held
            at += length - low
            mask, length = mask & ((1 << low) - 1), low
    return at


def choices(doc_id, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that a document's id decides."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform_text(doc_id, text: str | None, unit: str = "chars", plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT, seed: int = 1):
    """n, form, units of prefix and middle, code points of prefix and middle (null for plain), output."""
    data = (text or "").encode()
    mask = starts(data, unit)
    n = mask.bit_count()
    h1, h2, h3, h4 = choices(doc_id, seed)
    marked = any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE))
    if not data or marked or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, data
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = select(mask, len(data), i), select(mask, len(data), j)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form = "spm" if h4 % 100 < spm else "psm"
    out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    if unit != "chars":
        i, j = (starts(x).bit_count() for x in (prefix, prefix + middle))
    return n, form, i, j - i, out


def transform(docs: DataFrame, unit: str = "chars", plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output.

    A null or empty text is plain, of no units, and so is one that holds a marker.  A null
    doc_id decides as an empty one; rows with equal ids and texts get equal results; other
    columns are ignored.  Rows stay where they are: there is no shuffle.
    """
    assert unit in UNITS, unit
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 64):  # few texts in their output at a time
                some = ids.slice(at, 64)
                rows = [transform_text(i.as_py(), t.as_py(), unit, plain, spm, seed) for i, t in zip(some, texts.slice(at, 64), strict=True)]
                n, form, before, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [some, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    common.settle(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(form="form", output="output"):
    """The column of the exact texts, from forms and outputs alone: no text but a plain one holds a marker, and none arises at its edges."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
