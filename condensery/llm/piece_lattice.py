"""N-best segmentation of texts into the pieces of a SentencePiece model, and decoding.

Pieces with their scores span a lattice over a text. Forward Viterbi scores of every place are exact heuristics for an A-star search backward from the
end, which gives segmentations in order of score. Pieces never reach over the beginning of a word (a run of word marks), so a text's lattice falls into those of
its words: the search runs on words, which tasks remember, and a text's N best are merged from its words' alternatives.
"""

from __future__ import annotations

import functools
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, texts_of

MARK = "▁"
N_BEST = 4
#: Words whose segmentations a task remembers.
MEMO_WORDS = 200_000
UNKNOWN_PENALTY = 10.0
#: Text whose words are looked up at once.
WORDS_BYTES = 8 << 20
#: Text whose segmentations are decoded at once.
JUDGED_BYTES = 2 << 20
#: Pieces that a model never makes have a score below this.
UNUSED = -1e8
#: Of a character that begins no piece: no score, and nothing that goes on.
NOTHING = (None, {})


@functools.cache
def lattice(path: str) -> PieceLattice:
    return PieceLattice(path)


@functools.cache
def decoder(path: str) -> PieceDecoder:
    return PieceDecoder(path)


def piece_bytes(model) -> list[bytes]:
    """The text of each id of a model; control pieces have none."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


class PieceDecoder:
    """Texts of id lists of one model, a batch at once."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = pa.array(piece_bytes(sentencepiece.SentencePieceProcessor(model_file=path)), pa.large_binary())

    def raw(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids; the mark put before the text goes, and a null list stays null."""
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int64())
        joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.pieces.take(ids.flatten())), pa.scalar(b"", pa.large_binary()))
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.large_binary()), pc.replace_substring_regex(joined, pattern="^ ", replacement=""))

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """What ``raw`` gives as strings; bytes that are no UTF-8 are replaced."""
        raw = self.raw(ids)
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([None if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


class PieceLattice:
    """Segments words of one model. Characters outside the model become its byte pieces, at the lowest score less a penalty."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.texts = piece_bytes(model)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over the beginning of a word")
        self.unknown = min(x for x in self.scores.values() if x > UNUSED) - UNKNOWN_PENALTY
        #: By character: the score of the piece that ends with it, None if none does, and the characters that go on from there.
        self.trie: dict[str, tuple] = {}
        for piece in sorted(self.scores):
            level = self.trie
            for c in piece[:-1]:
                level = level.setdefault(c, (None, {}))[1]
            level[piece[-1]] = (self.scores[piece], {})
        self.memo: dict[str, tuple] = {}
        self.others: dict[tuple[str, int], list] = {}

    def forward(self, word: str) -> tuple[list[tuple[int, int, float]], list[float], list[int]]:
        """The edges (begin, end, score) in order of their begins, the best score up to each place, and the begin of the best last edge."""
        n, edges, trie, unknown = len(word), [], self.trie, self.unknown
        best, last = [0.0] + [-1e300] * n, [0] * (n + 1)
        for i in range(n):
            here = best[i]
            score, level = trie.get(word[i], NOTHING)
            if score is None:
                score = unknown
            j = i + 1
            while True:
                if score is not None:
                    edges.append((i, j, score))
                    score += here
                    if score > best[j]:
                        best[j], last[j] = score, i
                if j == n or (found := level.get(word[j])) is None:
                    break
                score, level = found
                j += 1
        return edges, best, last

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return out

    def best(self, word: str) -> tuple[float, bytes, float]:
        """Best score, its ids, and how much less the second-best segmentation scores (infinite if there is none)."""
        edges, best, last = self.forward(word)
        n = len(word)
        total, gap, then, path, j = best[n], float("inf"), [0] * (n + 1), [], n
        while j:
            i = last[j]
            path.append(word[i:j])
            then[i], j = j, i
        # Best scores from each place to the end: an edge off the best path loses what its two halves do.
        back = [-1e300] * n + [0.0]
        for i, j, score in reversed(edges):
            rest = score + back[j]
            if rest > back[i]:
                back[i] = rest
            if then[i] != j:
                loss = total - best[i] - score - back[j]
                if loss < gap:
                    gap = loss
        ids = self.ids_of(path[::-1])
        return total, struct.pack(f"<{len(ids)}I", *ids), gap

    def n_best(self, word: str, n: int) -> list[tuple[float, list[str]]]:
        """Up to n segmentations, best first: A-star from the end, guided by the exact forward scores."""
        edges, best, _ = self.forward(word)
        into: list[list[tuple[int, float, str]]] = [[] for _ in range(len(word) + 1)]
        for i, j, score in edges:
            into[j].append((i, score, word[i:j]))
        agenda, out, order = [(-best[len(word)], 0, len(word), 0.0, ())], [], 0
        while agenda and len(out) < n:
            _, _, place, done, tail = heapq.heappop(agenda)
            if not place:
                pieces = []
                while tail:
                    pieces.append(tail[0])
                    tail = tail[1]
                out.append((done, pieces))
                continue
            for i, score, piece in into[place]:
                order += 1
                heapq.heappush(agenda, (-(best[i] + score + done), order, i, score + done, (piece, tail)))
        return out

    def alternatives(self, word: str, best: bytes, n: int) -> list[tuple[float, bytes]]:
        """The second-best to n-th segmentation beside ``best``: what each loses against the best score, and its ids."""
        found = self.others.get((word, n))
        if found is None:
            ranked = self.n_best(word, n)
            coded = []
            for score, pieces in ranked:
                ids = self.ids_of(pieces)
                coded.append((ranked[0][0] - score, struct.pack(f"<{len(ids)}I", *ids)))
            # Where scores are equal the search may rank another one first, or all n before it.
            found = [c for c in coded if c[1] != best][: n - 1]
            if len(self.others) < MEMO_WORDS:
                self.others[word, n] = found
        return found

    def words(self, words: list[str], often: list[int]) -> list[tuple[float, bytes, float]]:
        memo, out = self.memo, []
        for w, n in zip(words, often, strict=True):
            got = memo.get(w)
            if got is None:
                got = self.best(w)
                if n > 1 and len(memo) < MEMO_WORDS:
                    memo[w] = got
            out.append(got)
        return out

    def decode(self, ids) -> str:
        """Text of ids; the mark put before the text goes."""
        raw = b"".join(self.texts[i] for i in ids).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


def closest(gap: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least gaps in order of place, the leftmost on ties; all places if there are fewer."""
    if len(gap) <= n:
        return np.arange(len(gap))
    near = np.flatnonzero(gap <= np.partition(gap, n - 1)[n - 1])
    return np.sort(near[np.argsort(gap[near], kind="stable")[:n]])


def best_choices(losses: list[list[float]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n choices of at most one from each list that lose least: (loss, which lists and which of each); nothing costs 0."""
    ranked = [(0.0, ())]
    for k, own in enumerate(losses):
        ranked = sorted(ranked + [(loss + x, (*taken, (k, a))) for loss, taken in ranked for a, x in enumerate(own)])[:n]
    return ranked


def segmented(batches: Iterator[pa.RecordBatch], model: str, n: int) -> Iterator[pa.RecordBatch]:
    """What ``segmentations`` gives for batches of doc_id and text, in slices of bounded text."""
    search = lattice(model)
    for whole in batches:
        for batch in slices(whole, limit=WORDS_BYTES):
            texts = texts_of(batch)
            # A word is a run of spaces and what follows it; the cut is at each space behind something else.
            plain = pc.replace_substring_regex(texts, pattern=r"([^ ]) ", replacement="\\1\x00 ")
            lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(" "), plain, ""), "\x00")
            odd = pc.match_substring(texts, "\x00").to_pylist()
            if any(odd):
                lists = pa.array([[w for w in split_words(" " + t)] if o else x for t, o, x in zip(texts.to_pylist(), odd, lists.to_pylist(), strict=True)], pa.list_(pa.string()))
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            names = [w.replace(" ", MARK) for w in coded.dictionary.to_pylist()]
            codes, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            got = search.words(names, np.bincount(codes, minlength=len(names)).tolist())
            score = np.array([g[0] for g in got])
            gap = np.array([g[2] for g in got])
            scores, ids, ends = [], [], [0]
            for k in range(batch.num_rows):
                own = codes[offsets[k] : offsets[k + 1]] if not empty[k] else codes[:0]
                total = float(score[own].sum())
                # Only the n - 1 words whose second choice loses least can take part in the text's n best.
                places = closest(gap[own], n - 1).tolist() if n > 1 else []
                own = own.tolist()
                others = [search.alternatives(names[own[p]], got[own[p]][1], n) for p in places]
                words = [got[c][1] for c in own]
                for loss, taken in best_choices([[x for x, _ in o] for o in others], n):
                    for j, a in taken:
                        words[places[j]] = others[j][a][1]
                    ids.append(b"".join(words))
                    for j, _ in taken:
                        words[places[j]] = got[own[places[j]]][1]
                    scores.append(total - loss)
                ends.append(len(ids))
            inner = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
            outer = pa.array(ends, pa.int32())
            flat = pa.Array.from_buffers(pa.int32(), int(inner[-1]), [None, pa.py_buffer(b"".join(ids))])
            ids = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(inner), flat))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.ListArray.from_arrays(outer, pa.array(scores, pa.float64())), ids], ["doc_id", "text", "scores", "ids"])


def segmentations(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """One row per document: doc_id, text, scores and ids of its best ``n`` segmentations, best first.

    The whole text, with a mark put before it and for each space, is segmented; a null text counts as empty: its one segmentation is empty and scores 0.
    Repeated rows are segmented alike; an empty table gives no rows.
    """
    fields = "doc_id long, text string, scores array<double>, ids array<array<int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: segmented(batches, model, n), fields)


def decoded(rows: DataFrame, model: str, column: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the texts of the id lists in ``column`` as the column ``into``; a null list gives a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], decoder(model).texts(batch.columns[-1])], [*batch.schema.names[:-1], into])

    others = [f for f in rows.schema.fields if f.name != into]
    out = T.StructType([*others, T.StructField(into, T.StringType())])
    return rows.select(*(F.col(f"`{f.name}`") for f in others), F.col(f"`{column}`").cast("array<int>").alias("_ids")).mapInArrow(decode, out)


def n_best_texts(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """One row per document, from ``segmentations``: doc_id, n_pieces and ids_crc32 of the best one, its score, n_best (the scores of the best ``n``),
    n_best_crc32 (the CRC of the ids of each of them), round_trip.

    round_trip: the ids of each of them decode to the text. The tasks judge what they segment before it leaves them: ids of n segmentations are many times the text.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in segmented(batches, model, n):
            for batch in slices(whole, limit=JUDGED_BYTES):
                lists, scores = batch["ids"], batch["scores"].to_pylist()
                ids, often = lists.flatten(), pc.list_value_length(lists).to_numpy()
                rows = np.repeat(np.arange(batch.num_rows), often)
                first = np.cumsum(often) - often
                same = pc.equal(decoder(model).raw(ids), texts_of(batch).cast(pa.large_binary()).take(pa.array(rows))).to_numpy(zero_copy_only=False)
                sizes = pc.list_value_length(ids).to_numpy()
                ends = np.cumsum(sizes, dtype=np.int64) * 4
                raw = memoryview(np.ascontiguousarray(ids.flatten().to_numpy().astype("<u4", copy=False))).cast("B")
                crcs = np.array([zlib.crc32(raw[b - 4 * s : b]) for b, s in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64)
                outer = pa.array(np.append(first, len(rows)), pa.int32())
                columns = [
                    batch["doc_id"], pa.array(sizes[first], pa.int64()), pa.array(crcs[first]), pa.array([x[0] for x in scores], pa.float64()),
                    pa.array([[round(x, 4) for x in own] for own in scores], pa.list_(pa.float64())), pa.ListArray.from_arrays(outer, pa.array(crcs)), pa.array(np.logical_and.reduceat(same, first)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "score", "n_best", "n_best_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, n_pieces long, ids_crc32 long, score double, n_best array<double>, n_best_crc32 array<long>, round_trip boolean")


def split_words(text: str) -> list[str]:
    """Runs of spaces with what follows each."""
    cuts = [0, *(i for i in range(1, len(text)) if text[i] == " " and text[i - 1] != " "), len(text)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
