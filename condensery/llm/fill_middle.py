"""Fill-in-middle transformation by displacement scatter, and its inverse.

All texts of a slice lie in one byte array. A scan finds the byte of every cut; a difference array holds, where a segment begins, by how much the shift
of its bytes differs from that of the bytes before; the running sum of it is every byte's way from input to output, and one scatter moves them all.
The inverse finds the sentinels in the outputs, builds the difference array of the way back from them alone, and gathers. Scan, sum, scatter and gather
go block by block, so that work arrays stay small beside even a very long text. Nothing is shuffled: rows stay where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, texts_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents, those left plain and, of the others, those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes whose shifts are worked out at once.
BLOCK = 1 << 18
PLAIN_FORM, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], object)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that depend on the seed and a document's id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each text begins; the last entry is the end."""
    raw = pa.array(texts, pa.large_binary()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    held = raw.buffers()[2]
    return np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def texts_from(out: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(out)]).cast(pa.large_string())


def blocks(n: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, BLOCK):
        yield lo, min(n, lo + BLOCK)


def code_points(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each of the given places."""
    found, before = np.zeros(len(at), np.int64), 0
    for lo, hi in blocks(len(held)):
        counts = np.cumsum((held[lo:hi] & 0xC0) != 0x80)
        inside = (at > lo) & (at <= hi)
        found[inside] = before + counts[at[inside] - lo - 1]
        before += int(counts[-1])
    return found


def places(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The byte at which each of the given code points (counted over the whole array, in rising order) begins; the end for those past the last."""
    found, before = np.full(len(wanted), len(held), np.int64), 0
    for lo, hi in blocks(len(held)):
        starts = np.flatnonzero((held[lo:hi] & 0xC0) != 0x80)
        a, b = np.searchsorted(wanted, [before, before + len(starts)])
        found[a:b] = lo + starts[wanted[a:b] - before]
        before += len(starts)
    return found


def sentinels(held: np.ndarray) -> np.ndarray:
    """Where a sentinel begins."""
    found = []
    for lo, hi in blocks(len(held)):
        x = held[lo : hi + 2]  # two bytes more, so that none is lost between blocks
        x, y, z = x[:-2], x[1:-1], x[2:]
        found.append(lo + np.flatnonzero((x == PREFIX[0]) & (z == PREFIX[2]) & ((y == PREFIX[1]) | (y == SUFFIX[1]) | (y == MIDDLE[1]))))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def shifts(starts: np.ndarray, shift: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, shift of every byte between) over n bytes, where segments begin at ``starts``, in rising order, and move by ``shift``.

    Several segments may begin at one byte; all but the last of them are empty, and their differences add up.
    """
    step = np.diff(shift, prepend=0)
    carry = 0
    for lo, hi in blocks(n):
        a, b = np.searchsorted(starts, [lo, hi])
        difference = np.zeros(hi - lo, np.int64)
        np.add.at(difference, starts[a:b] - lo, step[a:b])
        difference[0] += carry
        moved = np.cumsum(difference)
        carry = int(moved[-1])
        yield lo, hi, moved


def arranged(held: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs' bytes and where each begins, from texts at ``at`` that are cut at the bytes ``first`` and ``second``."""
    begin, end = at[:-1], at[1:]
    moved = forms != PLAIN_FORM
    to = np.concatenate([[0], np.cumsum(end - begin + 9 * moved)])
    prefix, middle, suffix = first - begin, second - first, end - second
    base = to[:-1]
    psm, spm = forms == PSM, forms == SPM
    # Where each segment begins in the output.
    p = base + np.where(psm, 3, np.where(spm, 6 + suffix, 0))
    m = np.where(moved, base + 9 + prefix + suffix, base + prefix)
    s = base + np.where(psm, 6 + prefix, np.where(spm, 3, prefix + middle))
    starts = np.stack([begin, first, second], 1).reshape(-1)
    shift = (np.stack([p, m, s], 1) - np.stack([begin, first, second], 1)).reshape(-1)
    out = np.empty(to[-1], np.uint8)
    for mark, where in ((PREFIX, p), (MIDDLE, m), (SUFFIX, s)):
        for k, byte in enumerate(mark):
            out[where[moved] - 3 + k] = byte
    for lo, hi, by in shifts(starts, shift, len(held)):
        out[np.arange(lo, hi) + by] = held[lo:hi]
    return out, to


def rebuilt(out: np.ndarray, to: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and where each begins, from outputs and forms alone. An output of a moved form has its three sentinels and no others."""
    base, stop = to[:-1], to[1:]
    moved = forms != PLAIN_FORM
    at = np.concatenate([[0], np.cumsum(stop - base - 9 * moved)])
    begin = at[:-1]
    marks = sentinels(out)
    owner = np.searchsorted(to, marks, "right") - 1
    marks = marks[moved[owner]] if len(marks) else marks
    if len(marks) != 3 * moved.sum():
        raise ValueError("an output of a moved form must hold each sentinel once")
    marks = marks.reshape(-1, 3)
    one, two, three = (np.zeros(len(base), np.int64) for _ in range(3))
    one[moved], two[moved], three[moved] = marks[:, 0] + 3, marks[:, 1] + 3, marks[:, 2] + 3
    spm = forms == SPM
    p, s = np.where(spm, two, one), np.where(spm, one, two)
    prefix, suffix = np.where(spm, three - two - 3, two - one - 3), np.where(spm, two - one - 3, three - two - 3)
    # The way of each segment's bytes, from text to output.
    prefix, suffix = np.where(moved, prefix, stop - base), np.where(moved, suffix, 0)
    first, second = begin + prefix, at[1:] - suffix
    shift = np.stack([np.where(moved, p, base) - begin, np.where(moved, three, base + prefix) - first, np.where(moved, s, stop) - second], 1).reshape(-1)
    starts = np.stack([begin, first, second], 1).reshape(-1)
    held = np.empty(at[-1], np.uint8)
    for lo, hi, by in shifts(starts, shift, len(held)):
        held[lo:hi] = out[np.arange(lo, hi) + by]
    return held, at


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null where plain), output.

    A text is cut at two places, drawn from its doc_id and ``seed``. psm is `<P>` prefix `<S>` suffix `<M>` middle, spm is `<S>` suffix `<P>` prefix `<M>` middle. Empty
    texts, texts that contain a sentinel already, and ``plain`` of a hundred others stay as they are. A null text counts as empty, a null doc_id as an
    empty one; repeated rows come back as often; an empty table gives no rows. Texts of any length are taken whole; other columns play no part.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                held, at = bytes_of(texts_of(batch))
                before = code_points(held, at)
                n = np.diff(before)
                draw = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
                one, two = draw[0] % (n + 1), draw[1] % (n + 1)
                low, high = np.minimum(one, two), np.maximum(one, two)
                marked = np.zeros(len(n), bool)
                marked[np.searchsorted(at, sentinels_within(held, at), "right") - 1] = True
                stays = (n == 0) | marked | (draw[2] % 100 >= 100 - plain)
                forms = np.where(stays, PLAIN_FORM, np.where(draw[3] % 100 < suffix_first, SPM, PSM))
                cuts = places(held, (before[:-1, None] + np.stack([low, high], 1)).reshape(-1)).reshape(-1, 2)
                # A cut at a text's end is its own end, not the beginning of a later text after empty ones.
                cuts = np.minimum(cuts, at[1:, None])
                out, to = arranged(held, at, cuts[:, 0], cuts[:, 1], forms)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n), pa.array(FORMS[forms], pa.string()), pa.array(low, mask=stays), pa.array(high - low, mask=stays), texts_from(out, to).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    drawn = docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    return drawn.mapInArrow(transform, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def sentinels_within(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sentinels that begin and end in one text."""
    found = sentinels(held)
    return found[np.searchsorted(at, found, "right") == np.searchsorted(at, found + 2, "right")]


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (output, form and any other columns) with `text` in place of `output`: the text that each output was made of, from output and form alone."""
    kept = [c for c in outputs.columns if c not in ("output", "text")]

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "output"):
                out, to = bytes_of(texts_of(batch, "output"))
                names = batch.column("form").to_numpy(zero_copy_only=False)
                held, at = rebuilt(out, to, np.where(names == "psm", PSM, np.where(names == "spm", SPM, PLAIN_FORM)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts_from(held, at).cast(pa.string())], [*kept, "text"])

    given = outputs.select(*kept, "output")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "output")
    return given.mapInArrow(invert, f"{schema}, text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of each output and of the text rebuilt from it."""
    made = fill_in_middle(docs).withColumn("output_sha256", F.sha2("output", 256))
    return restored(made).withColumn("restored_sha256", F.sha2("text", 256)).drop("text")
