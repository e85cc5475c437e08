"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped (space becomes U+2581, one is put in front) and cut where a U+2581 follows another character: no piece
of the vocabulary crosses such a place, so the words between are encoded on their own, each distinct word once a memo.
All missing words of a batch lie in one flat numpy array of symbols.  In each round every word finds the best rank of
its neighbouring pairs (segmented minimum), merges all leftmost non-overlapping pairs of that rank at once, and the
arrays are compacted; words leave when no pair remains.  Merging at once equals merging one by one as long as no merge
makes a pair of the same or a better rank; a word where that happens is done again pair by pair with a heap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm._words import WordMemo, bounded_batches, chunks, ship, text_slices

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.int32(2**31 - 1)
#: Characters of text that are encoded at once.
SLICE = 2_000_000


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with a BPE model of plain pieces and byte fallback."""

    def __init__(self, model: bytes, memo_words: int = 220_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.eos = sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        byte = [sp.is_byte(i) for i in range(size)]
        if sum(byte) != 256 or sp.encode(" ﬁ Ａ") != sp.encode("▁ﬁ▁Ａ"):
            raise ValueError("only models with byte fallback and no normalisation are supported")
        self.byte_id = [0] * 256
        for i in range(size):
            if byte[i]:
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        plain = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain):
            raise ValueError("a piece crosses a word start")
        #: Symbols: pieces by their id, then characters that only longer pieces hold, then any other character.
        symbols = dict(plain)
        for p in plain:
            for c in p:
                symbols.setdefault(c, size + len(symbols))
        self.first_other = size + 2 * len(symbols)
        self.size = size
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.first_other
        self.char_of = {}
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
                self.char_of[i] = s
        self.span = self.first_other + 0x110000
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.span + b] = (rank_of[sp.get_score(i)], i)
        self._build(pairs)
        self.bytes_of = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_byte = byte
        self.decimal = [str(i).encode() for i in range(size)]
        self.memo = WordMemo(self.encode_words, memo_words)

    def _build(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open-addressing table from a pair's key to its rank and the piece it makes."""
        self.bits = max(10, (4 * len(pairs)).bit_length())
        slots = 1 << self.bits
        self.key, self.rank, self.made = np.full(slots, -1, np.int64), np.full(slots, _NONE, np.int32), np.zeros(slots, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks, made = np.array(list(pairs.values()), np.int64).reshape(-1, 2).T
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.key[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.rank[at[put]], self.made[at[put]] = keys[put], ranks[put], made[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, ranks, made, at = keys[rest], ranks[rest], made[rest], (at[rest] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.span + right
        at = self._slot(keys)
        rank, made = np.full(len(keys), _NONE, np.int32), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.key[at]
            hit = there == keys
            rank[open_[hit]], made[open_[hit]] = self.rank[at[hit]], self.made[at[hit]]
            go = ~hit & (there != -1)
            if not go.any():
                break
            open_, keys, at = open_[go], keys[go], (at[go] + 1) & (len(self.key) - 1)
        return rank, made

    def _pair(self, left: int, right: int) -> tuple[int, int] | None:
        """Rank and piece of one pair."""
        key = left * self.span + right
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (there := int(self.key[at])) != key:
            if there == -1:
                return None
            at = (at + 1) & (len(self.key) - 1)
        return int(self.rank[at]), int(self.made[at])

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """For each word (without the U+2581 that stands before it) its ids as little-endian 32-bit integers."""
        n = len(words)
        if not n:
            return []
        flat = SPACE + SPACE.join(words)
        sym = self.of_char[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")]
        lens = np.fromiter(map(len, words), np.int64, n) + 1
        wid = np.repeat(np.arange(n), lens)
        out_sym, out_wid, again = [], [], []
        rank, made = self._pairs(sym, wid)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], wid[1:] != wid[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            done = best == _NONE
            if done.any():
                out_sym.append(sym[done])
                out_wid.append(wid[done])
                sym, wid, rank, made, best = (x[~done] for x in (sym, wid, rank, made, best))
                if not len(sym):
                    break
            hit = rank == best
            place = np.arange(len(sym))
            opens = hit.copy()
            opens[1:] &= ~hit[:-1]
            run = np.maximum.accumulate(np.where(opens, place, 0))
            take = hit & ((place - run) % 2 == 0)
            sym = np.where(take, made, sym)
            stay = np.ones(len(sym), bool)
            stay[1:] = ~take[:-1]
            new = take.copy()
            new[:-1] |= take[1:]
            new[:-2] |= take[2:] & ~stay[1:-1]
            sym, wid, rank, made, best, new = (x[stay] for x in (sym, wid, rank, made, best, new))
            at = np.flatnonzero(new)
            right = np.minimum(at + 1, len(sym) - 1)
            r, m = self._find(sym[at], sym[right])
            r[(right == at) | (wid[right] != wid[at])] = _NONE
            rank[at], made[at] = r, m
            bad = r <= best[at]
            if bad.any():
                odd = np.unique(wid[at[bad]])
                again.append(odd)
                keep = ~np.isin(wid, odd)
                sym, wid, rank, made = (x[keep] for x in (sym, wid, rank, made))
        return self._gather(words, out_sym, out_wid, again)

    def _pairs(self, sym: np.ndarray, wid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int64)
        at = np.flatnonzero(wid[1:] == wid[:-1])
        rank[at], made[at] = self._find(sym[at], sym[at + 1])
        return rank, made

    def _gather(self, words: Sequence[str], syms: list[np.ndarray], wids: list[np.ndarray], again: list[np.ndarray]) -> list[bytes]:
        sym, wid = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (syms, wids))
        order = np.argsort(wid, kind="stable")
        sym, wid = sym[order], wid[order]
        ends = np.searchsorted(wid, np.arange(len(words)), "right")
        rare = np.unique(wid[sym >= self.size]).tolist()
        data = sym.astype("<i4").tobytes()
        stops = (ends * 4).tolist()
        out, start = [], 0
        for e in stops:
            out.append(data[start:e])
            start = e
        for w in rare:
            out[w] = self._with_bytes(sym[ends[w - 1] if w else 0 : ends[w]].tolist())
        for w in np.concatenate([*again, np.zeros(0, np.int64)]).tolist():
            out[w] = self._with_bytes(self._one_by_one(SPACE + words[w]))
        return out

    def _with_bytes(self, symbols: list[int]) -> bytes:
        ids: list[int] = []
        for s in symbols:
            if s < self.size:
                ids.append(s)
            else:
                char = self.char_of[s] if s < self.first_other else chr(s - self.first_other)
                ids += [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<i4").tobytes()

    def _one_by_one(self, word: str) -> list[int]:
        """The same merges in strict order: best rank first, of equal ranks the leftmost."""
        sym = self.of_char[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")].tolist()
        n = len(sym)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and (found := self._pair(sym[i], sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], live[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s, on in zip(sym, live, strict=True) if on]

    def split(self, text: str) -> list[str]:
        """The words of a text, each without the U+2581 that stands before it."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return [s[1:] for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: Sequence[str | None], eos: bool = True) -> list[np.ndarray]:
        """The ids of every whole text; null counts as empty."""
        tail = np.array([self.eos], "<i4").tobytes() if eos else b""
        out: list[np.ndarray] = []
        for a, b in chunks([len(t or "") for t in texts], SLICE):
            words = [self.split(t or "") for t in texts[a:b]]
            of = self.memo.look_up(words)
            out += [np.frombuffer(b"".join([of[w] for w in ws]) + tail, "<i4") for ws in words]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, the space put in front goes, bytes that are no UTF-8 become U+FFFD."""
        listed = ids.tolist()
        table = self.bytes_of
        data = b"".join([table[i] for i in listed])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_odd(listed)
        first = next((i for i in listed if table[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def _decode_odd(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    n = 1
                del run[:n]

        for i in ids:
            if self.is_byte[i]:
                run += self.bytes_of[i]
            else:
                flush()
                out.append(self.bytes_of[i].decode())
        flush()
        return "".join(out)


_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec a Python worker."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = PieceCodec(model)
    return _CODECS[model]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", eos: bool = True) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row; a null text counts as empty, other columns are not read."""
    model = ship(bounded_batches(docs.sparkSession), model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            for a, b, texts in text_slices(batch, 1, SLICE):
                ids = own.encode(texts, eos)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])
        own.memo.clear()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every whole text encoded, and its ids decoded again.

    Null and empty texts have the end id alone and decode to the empty text.  Texts of any length are encoded whole, about
    two million characters of a batch at a time.  Repeated rows, null ids and an empty table pass through; other columns
    are not read.
    """
    import hashlib

    model = ship(bounded_batches(docs.sparkSession), model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            counts, shas, back = [], [], []
            for _, _, texts in text_slices(batch, 1, SLICE):
                for ids in own.encode(texts):
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(b" ".join([own.decimal[i] for i in ids.tolist()])).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.memo.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
