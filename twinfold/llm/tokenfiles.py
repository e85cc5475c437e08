"""Token-id files: independent zstandard frames, a trailing seek table with a checksum per frame.

A file is a plain zstandard stream in the public seekable layout:

* data frames, each compressed alone, of about ``frame_tokens`` ids in whole documents:
  ``u32 n | u8[n] id is null | i64[n] doc ids | u32[n] lengths | ids (u16 or u32, little-endian)``;
* one index frame: ``u8 bytes an id | u32 frames | i64[frames] first doc id | u32[frames] documents | u64[frames] ids``;
* a skippable frame (magic 0x184D2A5E) with ``u32 compressed | u32 decompressed | u32 checksum`` for each frame, where the
  checksum is the low half of XXH64 of the decompressed bytes, then ``u32 frames | u8 0x80 | u32 0x8F92EAB1``.

A reader takes the footer, the seek table and the index, and decompresses only frames that hold requested documents.
"""

from __future__ import annotations

import codecs
import os
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm._words import bounded_batches, chunks, joined_batches, ship, text_slices
from twinfold.session import materialize, shared_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_TOKENS = 1 << 18
#: Blanks of which the library makes other units than one a blank: texts that hold such go chunk by chunk.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HARD = f" ({_BLANK}|$)|{_BLANK}\n({_BLANK}|$)|\n{_BLANK}({_BLANK}|$)"
#: ASCII punctuation of which a run at the end of a word is one unit; an apostrophe may open a unit with the letters after it.
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Letters below U+0250, which every version of Unicode agrees on.
_LETTER = np.array([chr(c).isalpha() for c in range(0x250)])


class IdStore:
    """Ids of chunks, one after the other in one array, found by a chunk's number; the chunks are an Arrow array."""

    def __init__(self, dtype: np.dtype):
        self.keys = pa.array([], pa.large_string())
        self.flat, self.start, self.size = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, keys: pa.Array, blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """New keys and their ids, in blocks ``(places of the keys, their ids in turn, how many each has)``."""
        n = len(self)
        self.start, self.size = (_grown(x, n + len(keys)) for x in (self.start, self.size))
        for at, ids, sizes in blocks:
            self.flat = _grown(self.flat, self.used + len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[n + at], self.size[n + at] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
        self.keys = pa.concat_arrays([self.keys, keys])

    def find(self, keys: pa.Array) -> np.ndarray:
        """The number of each of these distinct keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        place = pc.index_in(self.keys, value_set=keys)  # the table is made of the fewer
        known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        out[place.drop_null().to_numpy()] = known
        return out

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these in turn, and how many each has."""
        sizes = self.size[numbers]
        done = np.cumsum(sizes)
        total = int(done[-1]) if len(done) else 0
        place = np.int32 if max(total, self.used) < 2**31 else np.int64  # half the memory traffic for all but huge texts
        take = np.repeat((self.start[numbers] - (done - sizes)).astype(place), sizes)
        take += np.arange(total, dtype=place)
        return self.flat[take], sizes


def _grown(x: np.ndarray, least: int) -> np.ndarray:
    if least <= len(x):
        return x
    out = np.zeros(max(least, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class ByteBpe:
    """Ids by the tokenizers library, asked once for each distinct chunk of text.

    The library's pre-tokenizer never joins what stands before a space to what follows it when a character other than
    white space comes next, so the text is cut there and its chunks are encoded on their own.  The library takes an added
    token out of a text before anything else: texts are cut there first, and its id stands between the parts.

    What is known is held in a young and an old store of at most ``memo_chunks // 2`` chunks (with their ids no more than
    ``memo_bytes // 2``) and one slice of texts each; a chunk of the old one that is met again moves to the young one, so frequent ones stay.  No result depends on it.
    """

    def __init__(self, model: bytes, memo_chunks: int = 1_600_000, memo_bytes: int = 128 << 20):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(model.decode())
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.library.get_added_tokens_decoder()
        #: The added token, if there is one that any text around leaves as it is; else texts that hold one go to the library whole.
        self.added = {t.content: np.array([i], self.dtype).tobytes() for i, t in added.items()}
        self.plain_added = len(added) == 1 and not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        #: Bytes of text that each id stands for: byte-level vocabularies write one character a byte.
        self.bytes_of = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], np.int64)
        #: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        place = {b: chr(256 + k) for k, b in enumerate(rest)}
        self.alphabet = "".join(place.get(b, chr(b)) for b in range(256))
        #: The same model without a pre-tokenizer, for units that are cut and written in that alphabet already.
        self.units = Tokenizer(self.library.model)
        #: Ids of the runs of punctuation met so far, one after the other.
        self.tails = self._store()
        self.feed = self._ids("\n")
        self.limit, self.most = memo_chunks, memo_bytes
        self.young, self.old = self._store(), self._store()

    def _store(self) -> IdStore:
        """A store that holds the empty chunk alone."""
        out = IdStore(self.dtype)
        out.add(pa.array([""], pa.large_string()), [(np.array([0]), np.zeros(0, self.dtype), np.array([0]))])
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _known(self, keys: pa.Array) -> np.ndarray:
        """The numbers of keys in the young store, after the missing ones were added."""
        coded = keys.dictionary_encode()
        keys = coded.dictionary
        found = self.young.find(keys)
        gone = np.flatnonzero(found < 0)
        if len(gone):
            missing = keys.take(pa.array(gone))
            before = self.old.find(missing)
            there, new = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            found[gone[there]] = len(self.young) + np.arange(len(there))
            self.young.add(missing.take(pa.array(there)), [(np.arange(len(there)), *self.old.gather(before[there]))])
            found[gone[new]] = len(self.young) + np.arange(len(new))
            missing = missing.take(pa.array(new))
            self.young.add(missing, self._fill(missing))
        return found[coded.indices.to_numpy()]

    def _fill(self, whole: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of ids of new chunks.

        A word of letters is one unit of the pre-tokenizer, a line feed before it and a run of punctuation at its end are
        others: the library's model takes the letters as they are.  All other chunks go to the library whole.
        """
        whole = whole.cast(pa.string())
        core = pc.ascii_rtrim(whole, _TAIL)
        fed, spaced = pc.starts_with(core, "\n"), pc.starts_with(core, " ")
        core = pc.if_else(pc.or_(fed, spaced), pc.utf8_slice_codeunits(core, 1), core)
        front = pc.if_else(pc.or_(fed, spaced), "", "\u0120")
        plain = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        other, shown = self._letters(core.take(pa.array(rest)), front.take(pa.array(rest)))
        out = []
        at = np.flatnonzero(plain)
        words = pc.binary_join_element_wise(front.take(pa.array(at)), core.take(pa.array(at)), "").to_pylist()
        for at_, words_ in ((at, words), (rest[other], shown)):
            ends = self._tails(whole.take(pa.array(at_)))
            feeds = fed.take(pa.array(at_)).to_numpy(zero_copy_only=False)
            sizes = np.fromiter(map(len, words_), np.int64, len(words_))
            for a, b in chunks(sizes.tolist(), 200_000):
                (e,) = self.units.encode_batch_fast([words_[a:b]], is_pretokenized=True, add_special_tokens=False)
                out.append((at_[a:b], *self._composed(feeds[a:b], *self._cut(e.ids, sizes[a:b]), ends[a:b])))
        whole_ = np.ones(len(whole), bool)
        whole_[at], whole_[rest[other]] = False, False
        left = np.flatnonzero(whole_)
        keys = dict(zip(left.tolist(), whole.take(pa.array(left)).to_pylist(), strict=True))
        joined, own = [k for k in keys if keys[k][0] not in " \n"], [k for k in keys if keys[k][0] in " \n"]
        for a, b in chunks([len(keys[k]) + 8 for k in own], 400_000):
            texts = [keys[k][1:] if keys[k][0] == " " else keys[k] for k in own[a:b]]
            found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            out.append((np.array(own[a:b]), np.fromiter(chain.from_iterable(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found))))
        sizes = np.array([len(keys[k].encode()) + 1 for k in joined], np.int64)
        for a, b in chunks(sizes.tolist(), 200_000):
            (e,) = self.library.encode_batch_fast([" " + " ".join([keys[k] for k in joined[a:b]])], add_special_tokens=False)
            out.append((np.array(joined[a:b]), *self._cut(e.ids, sizes[a:b])))
        return out

    def _letters(self, core: pa.Array, front: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Which of these are words of letters below U+0250, and those written in the alphabet."""
        text = "\n".join(core.to_pylist())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            return np.zeros(0, np.int64), []
        feed = codes == 10  # none is in a word of letters, so a word that holds one makes two that are no words here
        if int(feed.sum()) != len(core) - 1:
            flat = [w if "\n" not in w else "" for w in core.to_pylist()]
            return self._letters(pa.array(flat, pa.string()), front)
        ok = feed | ((codes < 0x250) & _LETTER[np.minimum(codes, 0x24F)])
        starts = np.concatenate([[0], np.flatnonzero(feed) + 1])
        empty = np.diff(np.append(starts, len(codes) + 1)) == 1
        good = np.logical_and.reduceat(ok, np.minimum(starts, len(codes) - 1)) & ~empty
        some = np.flatnonzero(good)
        words = pc.binary_join_element_wise(front.take(pa.array(some)), "\n", "").to_pylist()  # a space in front, or nothing
        chosen = "\n".join(core.take(pa.array(some)).to_pylist())
        shown = codecs.charmap_decode(chosen.encode(), "strict", self.alphabet)[0].split(self.alphabet[10])
        return some, [f[:-1] + w for f, w in zip(words, shown, strict=True)] if len(some) else []

    def _tails(self, whole: pa.Array) -> np.ndarray:
        """The numbers in ``tails`` of the runs of punctuation that chunks end in."""
        more = pc.not_equal(pc.binary_length(pc.ascii_rtrim(whole, _TAIL)), pc.binary_length(whole)).to_numpy(zero_copy_only=False)
        out = np.zeros(len(whole), np.int64)
        some = np.flatnonzero(more)
        if len(some):
            run = "[" + "".join("\\" + c for c in _TAIL) + "]"
            coded = pc.replace_substring_regex(whole.take(pa.array(some)), f"(?s)^.*[^{run[1:]}", "").dictionary_encode()
            tails = coded.dictionary.cast(pa.large_string())
            new = tails.take(pa.array(np.flatnonzero(self.tails.find(tails) < 0)))
            if len(new):
                found = [self._ids(t) for t in new.to_pylist()]
                self.tails.add(new, [(np.arange(len(new)), np.concatenate(found), np.array([len(x) for x in found]))])
            out[some] = self.tails.find(tails)[coded.indices.to_numpy()]
        return out

    def _composed(self, feeds: np.ndarray, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words' ids with a line feed before and a run of punctuation behind where they have them."""
        if not feeds.any() and not ends.any():
            return ids, sizes
        both = IdStore(self.dtype)
        base = len(self.tails)
        both.flat = np.concatenate([self.tails.flat[: self.tails.used], self.feed, ids])
        first = self.tails.used + len(self.feed)
        both.start = np.concatenate([self.tails.start[:base], [self.tails.used], first + np.cumsum(sizes) - sizes])
        both.size, both.used = np.concatenate([self.tails.size[:base], [len(self.feed)], sizes]), len(both.flat)
        turns = np.stack([np.where(feeds, base, 0), base + 1 + np.arange(len(sizes)), ends], 1)
        out, counts = both.gather(turns.ravel())
        return out, counts.reshape(-1, 3).sum(1)

    def _cut(self, ids: Sequence[int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of neighbouring chunks of so many bytes each, and how many each chunk has."""
        flat = np.array(ids, np.int64)
        at, ends = np.cumsum(self.bytes_of[flat]), np.cumsum(sizes)
        stops = np.searchsorted(at, ends)
        if not np.array_equal(at[stops], ends):
            raise ValueError("a piece crosses the end of a chunk")
        return flat.astype(self.dtype), np.diff(stops + 1, prepend=0)

    def split(self, text: str) -> list[str]:
        """The chunks of a text with odd blanks: a key that opens with a space stands for what follows that, one that opens with
        a line feed for itself, and any other for a space and itself."""
        if not text:
            return []
        parts = text.split(" ")
        joined: list[list[str]] = [[parts[0]]]
        for p in parts[1:]:
            if p and not p[0].isspace():  # so no chunk but the first opens with a line feed
                joined.append([p])
            else:
                joined[-1].append(p)
        parts = [" ".join(x) for x in joined]
        if parts[0]:
            parts[0] = " " + parts[0]
            return parts
        return parts[1:]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of every whole text; null counts as empty."""
        out: list[bytes] = []
        for a, b in chunks([len(t or "") for t in texts], 8_000_000):
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Texts without odd blanks are cut, made distinct and looked up by Arrow; Python sees new chunks alone."""
        cut = {k: self._around_added(t) for k, t in enumerate(texts) if t and any(a in t for a in self.added)}
        every = pa.array(texts, pa.large_string())
        hard = pc.fill_null(pc.or_(pc.match_substring_regex(every, _HARD), pc.equal(every, "")), True).to_pylist()
        odd = [k for k, h in enumerate(hard) if h and k not in cut]
        plain = [k for k, h in enumerate(hard) if not h and k not in cut]
        if len(self.young) > self.limit // 2 or self.young.keys.nbytes + self.young.used * self.dtype.itemsize > self.most // 2:
            self.young, self.old = self._store(), self.young
        # a line feed is a unit of its own here and stands at the start of a chunk
        parts = pc.split_pattern(pc.replace_substring(every.take(pa.array(plain, pa.int64())), "\n", " \n"), " ")
        ends = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # the first chunk of a text has no space before it; it is empty if the text opens with a space or a line feed
        heads = [" " + w if w else "" for w in words.take(pa.array(index[ends[:-1]])).to_pylist()]
        hard = [self.split(texts[k] or "") for k in odd]
        others = list(dict.fromkeys(chain(heads, *hard)))
        place = {w: len(words) + k for k, w in enumerate(others)}
        index[ends[:-1]] = [place[h] for h in heads]
        every = pa.concat_arrays([words, pa.array(others, pa.large_string())])
        used = np.ones(len(every), bool)
        used[: len(words)] = False
        used[index] = True  # chunks that only ever were the first of a text are of no use as they stand
        number = np.zeros(len(every), np.int64)
        number[used] = self._known(every.filter(pa.array(used)))
        index = np.concatenate([index, np.fromiter((place[w] for ws in hard for w in ws), np.int64)])
        ids, sizes = self.young.gather(number[index])
        stops = np.concatenate([ends, ends[-1] + np.cumsum([len(ws) for ws in hard], dtype=np.int64)])
        stops = (np.concatenate([[0], np.cumsum(sizes)])[stops] * self.dtype.itemsize).tolist()
        data = ids.tobytes()
        done = {k: data[i:j] for k, i, j in zip([*plain, *odd], stops[:-1], stops[1:], strict=True)}
        return [cut[k] if k in cut else done[k] for k in range(len(texts))]

    def _around_added(self, text: str) -> bytes:
        """The ids of a text that holds an added token."""
        if not self.plain_added:
            return self._ids(text).tobytes()
        ((token, one),) = self.added.items()
        return one.join(self.encode(text.split(token)))


class TokenFileWriter:
    """Writes documents in the order they come."""

    def __init__(self, sink, dtype: np.dtype, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        self.sink, self.dtype, self.frame_tokens = sink, np.dtype(dtype).newbyteorder("<"), frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.payloads: list[bytes] = []
        self.held = 0

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if not self.ids:
            return
        size = self.dtype.itemsize
        head = struct.pack("<I", len(self.ids)) + np.array([i is None for i in self.ids], np.uint8).tobytes()
        head += np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array([len(p) // size for p in self.payloads], "<u4").tobytes()
        self._frame(head + b"".join(self.payloads))
        self.index.append((next((i for i in self.ids if i is not None), -(2**63)), len(self.ids), self.held))
        self.ids, self.payloads, self.held = [], [], 0

    def write(self, doc_id: int | None, payload: bytes) -> None:
        self.ids.append(doc_id)
        self.payloads.append(payload)
        self.held += len(payload) // self.dtype.itemsize
        if self.held >= self.frame_tokens:
            self._flush()

    def close(self) -> None:
        self._flush()
        first, docs, ids = np.array(self.index, np.int64).reshape(-1, 3).T
        self._frame(struct.pack("<BI", self.dtype.itemsize, len(self.index)) + first.astype("<i8").tobytes() + docs.astype("<u4").tobytes() + ids.astype("<u8").tobytes())
        seek = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)


class TokenFileReader:
    """Random access to a token file; every frame's checksum is verified as it is read."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        if size < 17:
            raise ValueError("no token file")
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums")
        seek = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.plain, self.sums = seek.T
        self.offset = np.concatenate([[0], np.cumsum(self.packed)])
        index = self._frame(count - 1)
        width, n = struct.unpack_from("<BI", index)
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.first = np.frombuffer(index, "<i8", n, 5)
        self.docs = np.frombuffer(index, "<u4", n, 5 + 8 * n).astype(np.int64)
        self.tokens = np.frombuffer(index, "<u8", n, 5 + 12 * n).astype(np.int64)
        self.frames = n

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offset[k]), int(self.packed[k])), max_output_size=int(self.plain[k]))
        if len(data) != self.plain[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        data = self._frame(k)
        (n,) = struct.unpack_from("<I", data)
        null = np.frombuffer(data, np.uint8, n, 4).tolist()
        ids = np.frombuffer(data, "<i8", n, 4 + n).tolist()
        ends = np.cumsum(np.frombuffer(data, "<u4", n, 4 + 9 * n).astype(np.int64)).tolist()
        flat = np.frombuffer(data, self.dtype, -1, 4 + 13 * n)
        start = 0
        for i, gone, e in zip(ids, null, ends, strict=True):
            yield None if gone else i, flat[start:e]
            start = e

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(self.frames):
            yield from self.frame(k)

    def read(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """The ids of the given documents of a file in ascending doc_id order; other frames stay compressed."""
        wanted = np.unique(np.array(list(doc_ids), np.int64))
        out: dict[int, np.ndarray] = {}
        if len(wanted) and self.frames:
            lo = np.maximum(np.searchsorted(self.first, wanted, "left") - 1, 0)
            hi = np.searchsorted(self.first, wanted, "right")
            asked, need = set(wanted.tolist()), {k for a, b in zip(lo, hi, strict=True) for k in range(a, max(b, a + 1))}
            for k in sorted(need):
                out |= {i: x for i, x in self.frame(k) if i in asked}
        return out


def open_file(uri: str, mode: str = "r"):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path) if mode == "r" else fs.open_output_stream(path, compression=None)


#: One encoder a Python worker; what it knows (about 80 MB when full) stays from task to task.
_BPE: dict[bytes, ByteBpe] = {}


def byte_bpe(model: bytes) -> ByteBpe:
    if model not in _BPE:
        _BPE.clear()
        _BPE[model] = ByteBpe(model)
    return _BPE[model]


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` of every row: the ids of its whole text and the end id as little-endian bytes, two or four each.

    Null and empty texts have the end id alone; long texts are encoded a few at a time; other columns are not read.
    """
    model = ship(bounded_batches(docs.sparkSession), tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(model.value)
        tail = np.array([end_id], bpe.dtype).tobytes()
        for batch in joined_batches(batches, 8_000_000):  # a chunk is looked up once for each of these
            for a, b, texts in text_slices(batch, 1, 8_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([p + tail for p in bpe.encode(texts)], pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def by_ranges(docs: DataFrame, coded: DataFrame, parts: int, id_col: str = "doc_id") -> DataFrame:
    """``coded(id, ids)`` in ``parts`` partitions, ascending by id (nulls first) over them and within them; rows of one id
    by a hash of their ids, then by the ids.

    The cuts are quantiles of the ids of ``docs``, from a scan of that column alone, so no text is read or encoded twice.
    An id that several quantiles fall on is spread over their partitions by that hash.
    """
    share = [k / parts for k in range(1, parts)]
    least = -(2**63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(least))
    cuts = (docs.select(F.percentile_approx(key, share, 20 * parts)).first()[0] if parts > 1 else None) or []
    order = F.coalesce("id", F.lit(least))
    cut = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    # how many cuts lie below the id, and how many are the id itself
    below = F.size(F.filter(cut, lambda c: c < order))
    at = F.size(F.filter(cut, lambda c: c == order))
    place = (F.col("digest").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)  # 0 to 1
    part = below + F.when(at > 1, F.least(F.floor(place * at), at - 1)).otherwise(0)
    dealt = coded.withColumn("digest", F.xxhash64("ids")).withColumn("part", part.cast("int")).repartitionById(parts, "part")
    return dealt.sortWithinPartitions(F.asc_nulls_first("id"), "digest", "ids").select("id", "ids")


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents, ascending by id over files and within them; returns the manifest ``(part, file, docs, tokens)``.

    Null texts count as empty; null ids come first, rows with the same id follow each other ordered by a hash of their ids.
    A task writes a file whose name holds its attempt and reports that name, so a task that runs again, here or on
    another executor, never meets a file that is there, and the manifest names one whole file for each part.
    """
    model = ship(docs.sparkSession, tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok.zst"
        writer = sink = None
        docs_, tokens = 0, 0
        for batch in batches:
            for i, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    dtype = byte_bpe(model.value).dtype
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)  # frames are compressed already
                    writer = TokenFileWriter(sink, dtype)
                data = payload.as_py()
                writer.write(i, data)
                docs_ += 1
                tokens += len(data) // dtype.itemsize
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [f"{folder}/{name}"], "docs": [docs_], "tokens": [tokens]})

    coded = encode_documents(docs, tokenizer_file, end_id, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(by_ranges(docs, coded, parts, id_col).mapInArrow(run, "part long, file string, docs long, tokens long"), "manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files of ``manifest``."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(file) as source:
                    reader = TokenFileReader(source)
                    for k in range(reader.frames):
                        rows = []
                        for i, ids in reader.frame(k):
                            rows.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    # the manifest has one row a file; with a stated number of partitions adaptive execution does not join the reads
    files = manifest.withColumn("start", before.cast("long")).select("file", "start")
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Write ``docs(doc_id, text)`` to token files in the shared folder and describe each document from them."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_digests(write_token_files(docs, folder, tokenizer_file, end_id))
