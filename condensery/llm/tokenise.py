"""Token ids of whole texts by the ``tokenizers`` library, with a memo of frequent words in each task.

Both public vocabularies used here cut a text at white space before anything else, so a text's ids are the ids of
its words one after the other. A task asks the library once for each distinct word of a batch and keeps the ids of words that come again, up to ``MEMO_BYTES``, for later batches. Texts for which that cutting is not certain
(white space beside white space, unusual spaces) go to the library whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Memory for the ids of words that came again, for those of words that came once of late, and what one word takes beside its letters and ids.
MEMO_BYTES, RECENT_BYTES, WORD_BYTES = 24 << 20, 12 << 20, 200
#: Text that is cut and encoded at once: the arrays of its words and ids are many times its size.
SLICE_BYTES = 1 << 20
EMPTY = np.zeros(0, np.uint32)
#: Stands for a line break before a word while texts are cut.
BREAK = "\x01"
#: Stands before a full stop or comma that is cut from its word.
JOIN = "\x02"
#: Letters below this one are the same to every pattern and stay composed.
PLAIN = "\u0130"


@functools.cache
def encoder(path: str, leading_space: bool) -> WordEncoder:
    """One encoder for each vocabulary and worker process."""
    return WordEncoder(path, leading_space)


class WordEncoder:
    """Encodes arrays of texts by byte-level vocabularies. ``leading_space``: the vocabulary marks a word's beginning by the space before it;
    otherwise it drops white space."""

    def __init__(self, path: str, leading_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.leading_space = leading_space
        self.break_ids = self.ids(["\n"])[0].tobytes()
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.memo: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.room, self.recent_room = MEMO_BYTES, RECENT_BYTES

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str], often: list[int]) -> list[bytes]:
        """The ids of each word, as bytes. ``often``: how often the batch has it; words that come again are remembered."""
        memo, recent, model, packed = self.memo, self.recent, self.library.model, self.packed
        out = [memo.get(w) for w in words]
        unknown = [i for i, ids in enumerate(out) if ids is None]
        again = [i for i in unknown if words[i] in recent]
        for i in again:
            out[i] = recent[words[i]]
        missing = [i for i in unknown if out[i] is None] if again else unknown
        rest = []
        for i in missing:
            w = words[i]
            letters = w[1:] if w[:1] == " " else w
            if letters.isalpha() and max(letters) < PLAIN:
                # One run of letters: the model's part of the library is enough.
                if not letters.isascii():
                    w = (w if self.leading_space else w.lower()).encode().decode("latin-1")
                    w = w.translate(BYTE_LETTERS)
                elif self.leading_space:
                    w = w.replace(" ", SPACE_LETTER)
                else:
                    w = w.lower()
                out[i] = b"".join([packed[t.id] for t in model.tokenize(w)])
            else:
                rest.append(i)
        for i, ids in zip(rest, self.ids([words[i] for i in rest]), strict=True):
            out[i] = ids.tobytes()
        if self.room > 0:
            kept = again + [i for i in missing if often[i] > 1]
            memo.update((words[i], out[i]) for i in kept)
            self.room -= sum(WORD_BYTES + len(words[i]) + len(out[i]) for i in kept)
        once = [i for i in missing if often[i] == 1]
        if self.recent_room <= 0:
            recent.clear()
            self.recent_room = RECENT_BYTES
        recent.update((words[i], out[i]) for i in once)
        self.recent_room -= sum(WORD_BYTES + len(words[i]) + len(out[i]) for i in once)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and the row offsets into them."""
        original, n_rows = texts, len(texts)
        odd = pc.match_substring_regex(texts, f"[{BREAK}{JOIN}]").to_numpy(zero_copy_only=False).copy()
        for mark in ".,":
            for space in (" ", "\n"):
                texts = pc.replace_substring(texts, mark + space, f" {JOIN}{mark}{space}")
        if self.leading_space:
            texts = pc.replace_substring(texts, "\n", " " + BREAK)
            lists = pc.split_pattern(texts, " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int32)
        coded = flat.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        head = pc.match_substring_regex(names, f"^[{BREAK}{JOIN}]")
        broken = pc.starts_with(names, BREAK).to_numpy(zero_copy_only=False)
        bare = pc.if_else(head, pc.utf8_slice_codeunits(names, 1), names)
        # A cut before a full stop or comma is certain behind a letter or digit, one at white space beside what is visible.
        spaces = pc.match_substring_regex(bare, r"^$|^[\s\pZ\pC]|[\s\pZ\pC]$").to_numpy(zero_copy_only=False)
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        if self.leading_space:
            odd[row[spaces[codes]]] = True
        joined = pc.starts_with(names, JOIN).to_numpy(zero_copy_only=False)
        ends_well = pc.match_substring_regex(bare, r"[\pL\pN]$").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(joined[codes])
        odd[row[at[first[at] | ~ends_well[codes[at - 1]]]]] = True
        k = len(names)
        if self.leading_space:
            # Behind a space, or as it stands: at a text's beginning, after a line break, joined to what is before it.
            plain = head.to_numpy(zero_copy_only=False)
            codes = np.where(first | plain[codes], codes + k, codes)
        if odd.any():
            wanted = ~odd[row]
            codes, row = codes[wanted], row[wanted]
        often = np.bincount(codes, minlength=2 * k)
        need = np.flatnonzero(often)
        strings = bare.take(pa.array(np.where(need < k, need, need - k)))
        del flat, coded, lists
        if self.leading_space:
            strings = pc.binary_join_element_wise(pa.array(np.where(need < k, " ", "")), strings, "")
        got = self.words(strings.to_pylist(), often[need].tolist())
        if self.leading_space:
            for i in np.flatnonzero((need >= k) & broken[need % max(k, 1)]).tolist():
                got[i] = self.break_ids + got[i]
        sizes, begins = np.zeros(2 * k, np.int32), np.zeros(2 * k, np.int32)
        sizes[need] = np.fromiter(map(len, got), np.int32, len(got)) // 4
        pool = np.frombuffer(b"".join(got), np.uint32)
        begins[need] = np.cumsum(sizes[need]) - sizes[need]
        per_row = np.bincount(row, sizes[codes], n_rows).astype(np.int64)
        by_library = dict(zip(np.flatnonzero(odd).tolist(), self.ids([original[int(i)].as_py() for i in np.flatnonzero(odd)]), strict=True)) if odd.any() else {}
        for i, ids in by_library.items():
            per_row[i] = len(ids)
        offsets = np.concatenate([[0], np.cumsum(per_row)])
        taken = gather(pool, begins[codes], sizes[codes])
        if not by_library:
            return taken, offsets
        out = np.empty(offsets[-1], np.uint32)
        out[np.repeat(~odd, per_row)] = taken
        for i, ids in by_library.items():
            out[offsets[i] : offsets[i + 1]] = ids
        return out, offsets


def byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()
SPACE_LETTER = chr(BYTE_LETTERS[32])


def gather(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[begin : begin + size], one after the other."""
    total = int(sizes.sum())
    if not total:
        return EMPTY
    ends = np.cumsum(sizes, dtype=np.int64)
    # Places in the pool: narrow ones where they fit, as there is one for each id.
    kind = np.int32 if max(total, len(pool)) < 2**31 else np.int64
    return pool[np.arange(total, dtype=kind) + np.repeat((begins - (ends - sizes)).astype(kind), sizes)]
