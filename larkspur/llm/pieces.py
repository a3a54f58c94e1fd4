"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read, shown_id, slices, text_bytes
from .words import CachedEncoder

MARK = "▁".encode()
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
#: Bytes from which on a word is segmented by itself, and bytes of it whose pieces are held at a time.
LONG, BLOCK = 1024, 1 << 18


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): from state s the byte b leads to t = base[s] + b if check[t] == s; value[t] >= 0 ends a key."""
    tree: dict = {}
    for key, v in zip(keys, values, strict=True):
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = v
    base, check, value = (np.full(1 << 16, v, np.int64) for v in (0, -1, -1))
    check[0], low, start, top, todo = 0, 257, 257, 0, [(0, tree)]
    while todo:
        if max(start, top) + 600 > len(check):  # room for the tries below and for a node at the end
            base, check, value = (np.concatenate([a, np.full(len(a), v, np.int64)]) for a, v in ((base, 0), (check, -1), (value, -1)))
        s, node = todo.pop()
        value[s] = node.get(-1, -1)
        kids = sorted(b for b in node if b >= 0)
        if not kids:
            continue
        if len(kids) == 1:  # fills any hole
            at = low
            while check[at] >= 0:
                at += 1
            low = at
            at -= kids[0]
        else:
            # a few tries behind the last place, else at the end; lone children fill the holes
            at, tries, places = max(1, start - kids[0]), 0, np.array(kids)
            while tries < 40 and (check[at + places] >= 0).any():
                at, tries = at + 1, tries + 1
            if tries == 40:
                at = max(1, top + 1 - kids[0])
            start = at + kids[0]
        top = max(top, at + kids[-1])
        base[s] = at
        check[[at + b for b in kids]] = s
        todo += [(at + b, node[b]) for b in kids]
    end = int(np.flatnonzero(check >= 0)[-1]) + 257
    base, check, value = (np.concatenate([a, np.full(257, v, np.int64)]) for a, v in ((base, 0), (check, -1), (value, -1)))
    return base[:end].copy(), check[:end].copy(), value[:end].copy()


class PieceEncoder(CachedEncoder):
    """Best segmentations by the summed log scores of pieces; a piece of Zipf rank r scores -log(r + 2).

    A mark stands before the text and for each space. No piece has a mark behind another character, so the runs
    of one or more spaces with what follows them are segmented independently, all new ones of a slice at once.
    """

    def __init__(self, path: str, remember: int = 500_000) -> None:
        super().__init__(remember)
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any("▁" in self.pieces[i].lstrip("▁") for i in normal):
            raise ValueError("a piece spans words")
        self.scores = np.array([-np.log(2.0 - min(model.get_score(i), 0)) for i in range(n)])
        self.unknown = float(self.scores[normal].min()) - UNKNOWN_PENALTY
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        text = [self.pieces[i].encode().replace(MARK, b" ") for i in range(n)]
        self.base, self.check, self.value = double_array([text[i] for i in normal], normal)
        for b, i in enumerate(self.byte):
            text[i] = bytes([b])
        self.shown = np.frombuffer(b"".join(text), np.uint8)
        self.shown_at = np.cumsum([0, *map(len, text)])

    def spans(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blank = body == 32
        fresh = blank & ~np.append(False, blank[:-1]) if len(body) else blank
        fresh[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(fresh)
        return starts, np.append(starts[1:], len(body))[: len(starts)], np.searchsorted(starts, offsets)

    def encode_new(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.array([*map(len, words)])
        out: list = [None] * len(words)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._long(words[i])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        at = 0
        while at < len(order):  # words of like length share a matrix of about a megabyte
            to = min(len(order), at + max(1, (1 << 20) // int(sizes[order[at]] + 16)))
            to = at + max(1, int(np.searchsorted(sizes[order[at:to]], sizes[order[at]] * 5 // 4 + 2, "right")))
            for i, ids in zip(order[at:to].tolist(), self._viterbi([words[i] for i in order[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _viterbi(self, words: list[bytes]) -> list[list[int]]:
        n, size = len(words), max(map(len, words))
        grid = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size).astype(np.int64)
        sizes = np.array([*map(len, words)])
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        came, by = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        for i in range(size):
            rows = np.flatnonzero((sizes > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            lead = grid[rows, i]
            chars = np.where(lead < 128, 1, np.where(lead < 224, 2, np.where(lead < 240, 3, 4)))
            single = np.zeros(n, bool)
            live, state, k = rows, np.zeros(len(rows), np.int64), i
            one = np.zeros(n, np.int64)
            one[rows] = chars
            while k < size and len(live):
                there = self.base[state] + grid[live, k]
                ok = (self.check[there] == state) & (sizes[live] > k)
                live, state, k = live[ok], there[ok], k + 1
                ends = self.value[state]
                hit = ends >= 0
                who, piece = live[hit], ends[hit]
                single[who[one[who] == k - i]] = True
                score = best[who, i] + self.scores[piece]
                up = score > best[who, k]
                who, piece = who[up], piece[up]
                best[who, k], came[who, k], by[who, k] = score[up], i, piece
            odd = rows[~single[rows]]
            if len(odd):
                to = i + one[odd]
                score = best[odd, i] + self.unknown
                up = score > best[odd, to]
                best[odd[up], to[up]], came[odd[up], to[up]], by[odd[up], to[up]] = score[up], i, -1
        out = []
        for w, m, c, b in zip(words, sizes.tolist(), came, by, strict=True):
            ids: list[int] = []
            while m:
                a, piece = int(c[m]), int(b[m])
                ids += [piece] if piece >= 0 else self.byte[np.frombuffer(w[a:m], np.uint8)][::-1].tolist()
                m = a
            out.append(ids[::-1])
        return out

    def _long(self, word: bytes) -> list[int]:
        """The same for one long word: the pieces at all places of a block at once, then one pass over them."""
        data, n = np.frombuffer(word, np.uint8).astype(np.int64), len(word)
        best, came, by = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("q", [-1]) * (n + 1)
        best[0] = 0.0
        for a in range(0, n, BLOCK):
            lead = data[a : a + BLOCK]
            here = a + np.flatnonzero((lead & 0xC0) != 0x80)
            chars = np.where(data[here] < 128, 1, np.where(data[here] < 224, 2, np.where(data[here] < 240, 3, 4)))
            single = np.zeros(len(here), bool)
            who, state, k, found = np.arange(len(here)), np.zeros(len(here), np.int64), 0, []
            while len(who):
                inside = here[who] + k < n
                who, state = who[inside], state[inside]
                there = self.base[state] + data[here[who] + k]
                ok = self.check[there] == state
                who, state, k = who[ok], there[ok], k + 1
                hit = self.value[state] >= 0
                single[who[hit][chars[who[hit]] == k]] = True
                found.append((who[hit], np.full(int(hit.sum()), k), self.value[state[hit]]))
            odd = np.flatnonzero(~single)
            found.append((odd, chars[odd], np.full(len(odd), -1)))
            place, size, piece = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((piece < 0, place))  # of one place, shorter pieces first and the unknown one last
            place, size, piece = here[place[order]], size[order], piece[order]
            worth = np.where(piece >= 0, self.scores[piece], self.unknown)
            for i, to, p, w in zip(place.tolist(), (place + size).tolist(), piece.tolist(), worth.tolist(), strict=True):
                if best[i] + w > best[to]:
                    best[to], came[to], by[to] = best[i] + w, i, p
        ids: list[int] = []
        m = n
        while m:
            a, p = came[m], by[m]
            ids += [p] if p >= 0 else self.byte[np.frombuffer(word[a:m], np.uint8)][::-1].tolist()
            m = a
        return ids[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: marks become spaces, bytes bytes; the space that was put before the text goes."""
        size = self.shown_at[ids + 1] - self.shown_at[ids]
        at = np.repeat(self.shown_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.shown[at].tobytes()[1:]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array), decoded text of the ids.

    Texts are encoded and decoded where they are read; nothing is shuffled. Null or empty text has no ids; characters
    without a piece become their bytes. A mark in the text itself goes by its bytes, so it stays one. Rows that repeat are encoded
    each; a null id is shown as null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for batch in batches:
            for part in slices(batch):
                text = pc.fill_null(part.column("text"), "")
                led = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(" ", text, ""))
                ids, upto = encoder.encode(*text_bytes(led))
                out = [encoder.decode(ids[a:b].astype(np.int64)).decode() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(out, pa.string()), text], ["doc_id", "ids", "decoded", "text"])

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string, text string")
    return out.withColumn("doc_id", shown_id())


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_sha256 (of the ids as text), decoded_sha256, round_trip for every document."""
    rows = encoded(read(spark, sf_dir, "documents"), piece_bpe_path())
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
