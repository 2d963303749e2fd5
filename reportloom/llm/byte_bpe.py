"""Byte-level BPE encoding and decoding by a contiguous rank array.

Each short word holds the boundaries of its parts and, beside them, the rank of each pair of neighbouring parts.
The smallest rank is found by a scan, the boundary inside that pair is deleted, and the two ranks next to it are
refreshed, until no neighbours can merge. Words over ``LONG_WORD`` bytes, where scans would take quadratic time,
find the same smallest pair (leftmost on ties) through a heap instead.

The vocabulary is read from a tokenizers JSON file. Words are found by the pattern of byte-level BPE; strings of
special tokens inside texts become their ids first, as is the library's default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts, safe_parts

#: What splits a text into words before merging: a fixed value of byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 48
BLOCK_WORDS = 4096
#: Words that a Python worker remembers at most, and their greatest length.
MEMO_WORDS, MEMO_CHARS = 200_000, 48
NONE = (1 << 31) - 1
#: White space for str.split() that the patterns below do not take as such.
CONTROL_SPACE = re.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")
#: A full stop or comma that continues a run of marks, so that it is no word of its own.
IN_RUN = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])")
_loaded: dict[str, "ByteBPE"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 letters stand for
    themselves, the other bytes in order for the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: The same for vocabularies with an end-of-word suffix; white space between words is dropped.
ENDED_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


BEYOND_LATIN = re.compile(r"[\u0530-\U0010ffff]")


def beyond_latin(text: str) -> bool:
    """Whether a text has letters beyond Latin, Greek and Cyrillic; most texts are settled by one fast encoding."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return BEYOND_LATIN.search(text) is not None
    return False


class ByteBPE:
    """Encoder and decoder of one vocabulary; ``end`` is the suffix of a word's last piece, if it has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        drop = len(self.end)
        joined = [vocab[a + b] for a, b in pairs]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = np.append(keys[order], np.int64(1) << 62), np.append(order, NONE).astype(np.int32)
        self.joined = np.array(joined, np.int32)
        self.ranks = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        self.last = np.array([vocab[c + self.end] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        # ranks of pairs of letters within a word, and at its end
        self.letter_ranks = [self.pair_ranks(np.repeat(self.first, 256), np.tile(right, 256)).reshape(256, 256) for right in (self.first, self.last)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: (bytes(letters[c] for c in p[:-drop]) + b" " if drop and p.endswith(self.end) else bytes(letters[c] for c in p)) for p, i in vocab.items()}
        pieces |= {i: s.encode() for s, i in self.special.items()}
        listed = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_size = np.array([len(p) for p in listed], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.find = regex.compile(ENDED_WORDS if self.end else WORDS).findall
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.memo: dict[str, bytes] = {}
        self.path, self.library = path, None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, NONE where they do not merge."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.rank_of[at], NONE)

    def merge_block(self, words: bytes, size: int) -> list[bytes]:
        """Packed ids of words of ``size`` bytes each: a row of part ids and a row of neighbouring ranks for each word."""
        raw = np.frombuffer(words, np.uint8).reshape(-1, size)
        parts = self.first[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        ranks = self.letter_ranks[0][raw[:, :-1], raw[:, 1:]]
        if size > 1:
            ranks[:, -1] = self.letter_ranks[1][raw[:, -2], raw[:, -1]]
        rows, out = np.arange(len(raw)), np.empty(len(raw), object)
        while len(rows):
            width = ranks.shape[1]
            at = ranks.argmin(axis=1) if width else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            least = ranks[each, at] if width else np.full(len(rows), NONE, np.int32)
            ended = least == NONE
            if ended.any():
                flat, step = parts[ended].tobytes(), 4 * (width + 1)
                out[rows[ended]] = [flat[i : i + step] for i in range(0, len(flat), step)]
            if ended.any():
                go = ~ended
                rows, parts, ranks, at, least = rows[go], parts[go], ranks[go], at[go], least[go]
                each = np.arange(len(rows))
            if not len(rows):
                break
            parts[each, at] = self.joined[least]
            keep = np.arange(width + 1)[None, :] != (at + 1)[:, None]
            parts = parts[keep].reshape(len(rows), width)
            ranks = ranks[keep[:, 1:]].reshape(len(rows), width - 1)
            right = at < width - 1
            ranks[each[right], at[right]] = self.pair_ranks(parts[each[right], at[right]], parts[each[right], at[right] + 1])
            left = at > 0
            ranks[each[left], at[left] - 1] = self.pair_ranks(parts[each[left], at[left] - 1], parts[each[left], at[left]])
        return out.tolist()

    def merge_long(self, word: bytes) -> bytes:
        """As ``merge_block`` for one word, with a heap of (rank, start, left id, right id), outdated ones skipped."""
        n = len(word)
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        live = [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] * self.size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, a, x, y = heapq.heappop(heap)
            b = after[a] if live[a] else n
            if b >= n or ids[a] != x or ids[b] != y:
                continue
            live[b], ids[a], after[a] = False, int(self.joined[rank]), after[b]
            if after[a] < n:
                before[after[a]] = a
            for i, j in ((before[a], a), (a, after[a])):
                if i >= 0 and j < n and (r := ranks.get(ids[i] * self.size + ids[j])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))
        return array("I", [ids[i] for i in range(n) if live[i]]).tobytes()

    def merge(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word; words of one length in UTF-8 are merged together."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w) if w.isascii() else len(w.encode()), []).append(w)
        for size, same in by_size.items():
            if size > LONG_WORD:
                out.update((w, self.merge_long(w.encode())) for w in same)
                continue
            for i in range(0, len(same), BLOCK_WORDS):
                block = same[i : i + BLOCK_WORDS]
                out.update(zip(block, self.merge_block("".join(block).encode(), size), strict=True))
        return out

    def chunk_ids(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids of chunks that no merge crosses: each chunk's words are found and merged once."""
        if self.end and beyond_latin("".join(chunks)):
            return self.library_ids(chunks)
        whole = {c for c in chunks if c.isalpha()}
        found = {c: self.words_of(c) for c in chunks if c not in whole}
        ids = self.merge(list(whole.union(*found.values())))
        return ids | {c: b"".join([ids[w] for w in words]) for c, words in found.items()}

    def library_ids(self, chunks: list[str]) -> dict[str, bytes]:
        """As ``chunk_ids`` where the library finds the words of chunks beyond Latin, Greek and Cyrillic: what is a
        letter there depends on the Unicode version, and a word's last piece has the suffix."""
        own = [c for c in chunks if not beyond_latin(c)]
        ids = self.chunk_ids(own) if own else {}
        rest = list({c for c in chunks if c not in ids})
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        encoded = self.library.encode_batch(rest, add_special_tokens=False)
        return ids | {c: array("I", e.ids).tobytes() for c, e in zip(rest, encoded, strict=True)}

    def words_of(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The words of a chunk; letters alone, or with a full stop or comma after them, need no pattern."""
        if chunk == "":
            return ()
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return (chunk,)
        if chunk[-1:] in (".", ",") and chunk[1:-1].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return (chunk[:-1], chunk[-1])
        return self.find(chunk)

    def pack(self, listed: list[list[str]]) -> list[bytes]:
        """For each list of chunks, their ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        new = set().union(*listed).difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = set().union(*listed)
        meant = {c: c if self.end else self.whole(c) for c in new}
        ids = self.chunk_ids(list(meant.values()))
        memo.update((c, ids[w]) for c, w in meant.items())
        del ids
        out = [b"".join(map(memo.__getitem__, chunks)) for chunks in listed]
        for c in [c for c in new if len(c) > MEMO_CHARS]:
            del memo[c]
        return out

    def whole(self, chunk: str) -> str:
        """What a chunk of ``chunks_of`` stands for: a leading space marks a text's start, none a space before."""
        return chunk[1:] if chunk[:1] == " " else " " + chunk

    def chunks_of(self, text: str) -> list[str]:
        """``text`` cut before each single space that stands between characters that are no white space.

        With an end-of-word suffix the text is first composed (NFC) and lower-cased letter by letter, and cut at
        all white space.
        """
        if self.end:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            if CONTROL_SPACE.search(text):
                return SPACE.split(text)
            if not IN_RUN.search(text):  # then a mark before a space is a word, and fewer chunks differ
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
            return text.split()
        parts = safe_parts(text)
        parts[0] = " " + parts[0]
        return parts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not any(s in t for s in self.special for t in texts):
            return self.pack([self.chunks_of(t) for t in texts])
        cut = [self.cut.split(t) for t in texts]
        packed = iter(self.pack([self.chunks_of(p) for parts in cut for p in parts if p not in self.special]))
        return [b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else next(packed) for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return b""
        which = np.frombuffer(ids, np.uint32)
        sizes = self.piece_size[which]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.piece_start[which] - ends + sizes, sizes)
        return self.piece_bytes[at].tobytes().decode("utf-8", "replace").encode()


def load(path: str) -> ByteBPE:
    """The encoder of a vocabulary file, one for each worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, ids (array of int), decoded (the text decoded from the ids). Null text counts as empty."""

    def make():
        bpe = load(vocab_path)

        def call(texts):
            packed = bpe.encode_all(texts)
            return [[memoryview(p).cast("I").tolist() for p in packed], [bpe.decode(p).decode() for p in packed]]

        return call

    return map_texts(docs, text_col, "ids array<int>, decoded string", make, [id_col])


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_tokens, ids_sha256, decoded_sha256, a row for each row of ``docs``.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded text in
    UTF-8. Null text counts as empty (no ids). Texts of any length are encoded whole. Rows with null or repeated
    ids keep a row each, extra columns are ignored, an empty table gives an empty result.
    """

    def make():
        bpe = load(vocab_path)

        def call(texts):
            packed = bpe.encode_all(texts)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return [[len(p) // 4 for p in packed], [sha(p) for p in packed], [sha(bpe.decode(p)) for p in packed]]

        return call

    return map_texts(docs, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, [id_col])
