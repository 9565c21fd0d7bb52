"""Fill-in-the-middle transformation as one numpy kernel over the UTF-8 buffers of a batch.

Each byte gets a class by a table; where two adjacent classes, or a row's first byte, begin a unit, a mask is set. Its running sum,
less the sum before a row's first byte, numbers the units of every row, so that a binary search in the one sum finds the cuts of all
rows together. Lines, words or code points can be the units. The outputs are assembled and rebuilt as Spark columns.

The places of the cuts and the form come from the SHA-256 of a seed and doc_id, so a row that is computed again is the same. Texts that
are empty or hold a mark of the format stay plain: otherwise the marks tell the parts apart again (no mark can arise where a part
meets another mark, since a mark's last character is not its first).

Nulls: a null text counts as the empty text, a null id as the empty string in the hash. Texts are cut whole, whatever their length: the
kernel takes about 10 bytes of memory a byte and works on blocks of ``BLOCK_BYTES``, a longer text is a block. Equal cuts give an empty middle.
Repeated rows give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import prepare_python, table

SEED = 7
#: Percent of the texts that are transformed, and of these with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 4 << 20

#: Classes of bytes: others, the newline, other blanks, and bytes that continue a code point.
_OTHER, _NEWLINE, _BLANK, _CONTINUES = range(4)
CLASSES = np.zeros(256, np.uint8)
CLASSES[[32, 9, 11, 12, 13]] = _BLANK
CLASSES[10] = _NEWLINE
CLASSES[0x80:0xC0] = _CONTINUES


def _begins(kind: str) -> np.ndarray:
    """[class before, class] -> whether a unit of this kind begins."""
    out = np.zeros((4, 4), bool)
    if kind == "line":
        out[_NEWLINE, :] = True
    elif kind == "word":  # with the blanks that follow; blanks at the start are a unit
        out[[_NEWLINE, _BLANK], _OTHER] = True
    elif kind == "char":
        out[:, [_OTHER, _NEWLINE, _BLANK]] = True
    else:
        raise ValueError(f"no unit {kind!r}")
    return out


BEGINS = {kind: _begins(kind) for kind in ("line", "word", "char")}


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offsets begin at 0."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def holds_mark(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row whether its text holds one of the marks."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(raw) >= 3:
        inner = raw[1:-1]
        at = np.flatnonzero((raw[:-2] == ord("<")) & (raw[2:] == ord(">")) & ((inner == ord("P")) | (inner == ord("S")) | (inner == ord("M"))))
        row = np.searchsorted(offsets, at, "right") - 1
        out[row[at + 3 <= offsets[row + 1]]] = True
    return out


def _sums(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums: up to before each byte and the end, and up to and with each byte."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out, out[1:]


def cuts(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray, kind: str = "line") -> dict[str, np.ndarray]:
    """For each row the units n, the bytes ``first`` and ``second`` where prefix and middle end, and the code points of both parts.

    draws: two numbers a row; a part ends after the draw modulo n + 1 units.
    """
    starts, ends = offsets[:-1], offsets[1:]
    if not len(raw):
        none = np.zeros(len(starts), np.int64)
        return {"n": none, "first": starts, "second": starts, "prefix_chars": none, "middle_chars": none}
    classes = CLASSES[raw]
    begins = np.empty(len(raw), bool)
    begins[1:] = BEGINS[kind][classes[:-1], classes[1:]]
    begins[starts[starts < ends]] = True
    upto, total = _sums(begins)
    before = upto[starts].astype(np.int64)
    n = upto[ends] - before
    units = np.sort(draws.astype(np.int64) % (n + 1)[:, None], axis=1)
    byte = np.minimum(np.searchsorted(total, before[:, None] + units + 1), ends[:, None])
    byte = np.where(units == n[:, None], ends[:, None], byte)
    chars, _ = _sums(classes != _CONTINUES)
    first, second = byte[:, 0], byte[:, 1]
    return {"n": n, "first": first, "second": second, "prefix_chars": (chars[first] - chars[starts]).astype(np.int64), "middle_chars": (chars[second] - chars[first]).astype(np.int64)}


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of blocks of at most ``most`` bytes, one row at least."""
    sizes, at, held = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0, 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most:
            yield at, i - at
            at, held = i, 0
        held += size
    if len(sizes):
        yield at, len(sizes) - at


def transformed(texts: pa.Array, digests: pa.Array, kind: str, rate: int, suffix_first: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of one block."""
    raw, offsets = buffers(texts)
    draws = np.frombuffer(b"".join(digests.to_pylist()), ">u4").reshape(len(texts), -1)[:, :4].astype(np.int64)
    cut = cuts(raw, offsets, draws[:, :2], kind)
    plain = holds_mark(raw, offsets) | (np.diff(offsets) == 0) | (draws[:, 2] % 100 >= rate)
    spm = draws[:, 3] % 100 < suffix_first
    data = memoryview(raw)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    parts, sizes = [], []
    for a, b, c, d, whole, flip in zip(offsets[:-1].tolist(), cut["first"].tolist(), cut["second"].tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
        if whole:
            parts.append(data[a:d])
            sizes.append(d - a)
        else:
            parts += (s, data[c:d], p, data[a:b], m, data[b:c]) if flip else (p, data[a:b], s, data[c:d], m, data[b:c])
            sizes.append(d - a + len(p) + len(s) + len(m))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    output = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(parts))])
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [pa.array(cut["n"], pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(cut["prefix_chars"], pa.int64(), mask=plain), pa.array(cut["middle_chars"], pa.int64(), mask=plain), output.cast(pa.string())]


def fill_in_middle(docs: DataFrame, kind: str = "line", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs`` (doc_id, text)."""
    prepare_python(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in blocks(batch.column(1)):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *transformed(part.column(1), part.column(2), kind, rate, suffix_first)], names=names)

    own = F.col("doc_id").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))).cast("binary"), 256))
    return docs.select(own.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_sql(seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> str:
    return f"""
WITH lines AS (
  SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('{seed}:' || coalesce(doc_id::BIGINT::VARCHAR, '')) AS x FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || substr(x, 1, 8))::BIGINT % (len(units) + 1) AS i, ('0x' || substr(x, 9, 8))::BIGINT % (len(units) + 1) AS j,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= {rate} THEN 'plain' WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM lines
), parts AS (
  SELECT *, array_to_string(units[1:least(i, j)], '') AS p, array_to_string(units[least(i, j) + 1:greatest(i, j)], '') AS m, array_to_string(units[greatest(i, j) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM parts"""


OP12_SQL = op12_sql()
