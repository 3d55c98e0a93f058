"""Exact token ids at the speed of a dictionary: chunks between which a tokenizer never merges are encoded once each.

White space splits both vocabularies' pre-tokens, so a text's ids are those of its chunks, one after the other. A batch of
texts is cut at its spaces and line ends as one array of bytes; each different chunk is looked up once, and the library
encodes those that are not in the worker's table yet. Texts with other white space, or with runs of it, go one by one. Tokens that a vocabulary adds to its model (such as
<|endoftext|>) are found in raw text, before it is split: a text that holds one goes through the library as a whole.

Defined results: an empty text has no ids; ids are those of the library with add_special_tokens=False, whatever the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

# fixed values: the characters that the tokenizers' \s matches
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: str.split() also splits at these, which to the tokenizers are signs
NOT_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
RUNS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
SIGNS = ".,!?;:$%&*#()"
PLAIN = "\u0250"  # letters below this are in every Unicode version; one of them is two characters in lower case
DOTTED = "\u0130"


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: as itself if it prints, else as the next free letter from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks(dict):
    """Ids of each chunk, with `lead` before it, as little-endian unsigned 32-bit integers.

    A run of letters is one pre-token, and so are the signs after it: letters go straight to the vocabulary's model, and
    a word with signs, or in capitals, is made from its parts. All else goes through the whole tokenizer. Chunks are kept
    from their second time on; when the table is full it becomes the old one, from which what is still used comes back.
    """

    def __init__(self, tokenizer, lowers: bool, lead: str = "", bare: Chunks | None = None, most: int = 120_000):
        self.tokenizer, self.lowers, self.lead, self.most, self.old = tokenizer, lowers, lead, most, {}
        self.seen, self.mask = bytearray(1 << 21), (1 << 21) - 1
        self.bare = self if bare is None else bare
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()
        self.mark = lead.translate(self.letters)  # ASCII letters are spelled as they are
        self.four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())] if bare is None else bare.four

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._made(chunk)
            at = hash(chunk) & self.mask
            if not self.seen[at]:  # most words come once: they are kept from the second time on
                self.seen[at] = 1
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.seen = bytearray(len(self.seen))
        self[chunk] = ids
        return ids

    def _made(self, chunk: str) -> bytes:
        word, four = chunk.rstrip(SIGNS), self.four
        ascii_ = word.isascii()
        if word.isalpha() and (ascii_ or (max(word) < PLAIN and DOTTED not in word and (is_normalized("NFC", word) or not self.lowers))):
            if len(word) < len(chunk):
                return self[word] + self.bare[chunk[len(word) :]]
            if self.lowers and not word.islower():
                low = "".join(map(str.lower, word))  # letter by letter
                if low != word:
                    return self[low]
            spelled = self.mark + (word if ascii_ else word.encode().decode("latin-1").translate(self.letters))
            return b"".join([four[t.id] for t in self.tokenize(spelled)])
        return b"".join([four[i] for i in self.tokenizer.encode(self.lead + chunk, add_special_tokens=False).ids])


class Encoder:
    """ids(text) of a byte-level vocabulary, where a space belongs to the word after it, or of one that drops white space."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space = (tokenizer := Tokenizer.from_file(path)), drops_space
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError(f"{path}: tokens are added after normalising")
        self.added = [t.content for t in added]
        plain = Chunks(tokenizer, drops_space)
        self.chunk, self.spaced = plain.__getitem__, Chunks(tokenizer, drops_space, " ", plain).__getitem__
        self.split = self._without_space if drops_space else self._with_space

    def batch(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts, each with its end id, and where each text's begin, and the last ends."""
        raw = [(t or "").encode() for t in texts]
        plain = plain_texts(raw, [t.encode() for t in self.added])
        parts = {k: np.frombuffer(self.ids(texts[k]), "<u4") for k in np.flatnonzero(~plain).tolist()}
        found, sizes = self._plain_ids([r for r, ok in zip(raw, plain.tolist()) if ok])
        n = np.zeros(len(raw), np.int64)
        n[plain] = sizes
        for k, p in parts.items():
            n[k] = len(p)
        ends = np.cumsum(n + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[ends - 1] = end_id
        mine = np.repeat(plain, n + 1)
        mine[ends - 1] = False
        out[mine] = found
        for k, p in parts.items():
            out[ends[k] - 1 - len(p) : ends[k] - 1] = p
        return out, np.concatenate([[0], ends]).astype(np.int64)

    def _plain_ids(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, one after the other, and how many each has."""
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data = b"\n" + b"\n".join(raw)  # a line end before each text, so that every chunk has a separator in front
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((b == 32) | (b == 10))
        at = np.sort(np.concatenate([at, sign_runs(b, at)]))
        if self.drops_space:  # it lowers letters; one that a mark may follow is left to the library
            b = b.copy()
            upper = np.flatnonzero((b >= 65) & (b <= 90))
            upper = upper[(upper + 1 == len(b)) | (b[np.minimum(upper + 1, len(b) - 1)] < 128)]
            b[upper] |= 32
            data = b.tobytes()
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        first = np.searchsorted(at, np.cumsum(lengths) - lengths)  # the chunk with which each text begins
        offsets = pa.py_buffer(np.append(at, len(b)))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        del at, b, data
        known = [self._chunk_ids(c) for c in chunks.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        which = chunks.indices.to_numpy()
        sizes = np.add.reduceat(size[which], first)
        ids, done = np.empty(int(sizes.sum()), np.uint32), 0
        for s in range(0, len(which), 100_000):  # a part at a time: places take more room than ids
            some = which[s : s + 100_000]
            n = size[some]
            ends = np.cumsum(n)
            ids[done : done + int(ends[-1])] = flat[np.repeat(start[some] - (ends - n), n) + np.arange(int(ends[-1]))]
            done += int(ends[-1])
        if not self.drops_space:  # the line ends that were put there
            keep = np.ones(len(ids), bool)
            keep[np.cumsum(sizes) - sizes] = False
            ids, sizes = ids[keep], sizes - 1
        return ids, sizes

    def _chunk_ids(self, chunk: bytes) -> bytes:
        if chunk[0] not in b" \n":
            return self.chunk(chunk.decode())  # signs after a word
        word = chunk[1:].decode()
        if self.drops_space:
            return self.chunk(word) if word else b""
        if chunk[0] == 32:
            return self.spaced(word)
        return self.chunk("\n") + self.chunk(word) if word else self.chunk("\n")

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(t in text for t in self.added):
            return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        return self.split(text)

    def _without_space(self, text: str) -> bytes:
        if any(c in text for c in NOT_SPACES):
            return b"".join(map(self.chunk, RUNS.findall(text)))
        return b"".join(map(self.chunk, text.split()))

    def _with_space(self, text: str) -> bytes:
        if " ".join(text.split()) != text.replace("\n", " "):  # else single spaces and line ends between words are all
            return b"".join(map(self.chunk, RUNS.findall(text)))
        if any(c in text for c in NOT_SPACES):
            return b"".join(map(self.chunk, RUNS.findall(text)))
        parts = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            parts.append(self.chunk(first) if first else b"")
            parts.extend(map(self.spaced, rest))
            parts.append(self.chunk("\n"))
        return b"".join(parts[:-1])


_LETTER, _SIGN = (np.isin(np.arange(256), list(s.encode())) for s in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", SIGNS))


def sign_runs(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the signs begin that end a chunk of otherwise ASCII letters. at: where chunks begin, with their separators."""
    ends = np.append(at[1:], len(b))
    sign = _SIGN[b]
    runs = np.flatnonzero(sign & ~np.concatenate([[False], sign[:-1]]))  # where signs begin, anywhere
    letters = np.concatenate([[0], np.cumsum(_LETTER[b], dtype=np.int32)])
    signs = np.concatenate([[0], np.cumsum(sign, dtype=np.int32)])
    of = np.searchsorted(at, runs, "right") - 1
    start, end = at[of] + 1, ends[of]
    whole = (runs > start) & (letters[runs] - letters[start] == runs - start) & (signs[end] - signs[runs] == end - runs)
    return runs[whole]


# fixed values: the UTF-8 bytes of white space beyond ASCII
WIDE_SPACES = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE2: (*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"), 0xE3: (b"\x80\x80",)}


def plain_texts(raw: list[bytes], added: list[bytes]) -> np.ndarray:
    """Which texts have single spaces and line ends between their words, and no other control or space, nor an added token."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    starts = np.cumsum(lengths) - lengths
    data = b"\n" + b"\n".join(raw)
    b = np.frombuffer(data, np.uint8)
    odd = [np.flatnonzero((b < 32) & (b != 10))]
    for lead, rests in WIDE_SPACES.items():
        at = np.flatnonzero(b == lead)
        if len(at):
            odd.append(np.array([p for p in at.tolist() if data[p + 1 : p + 3].startswith(rests)], np.int64))
    at = np.flatnonzero((b == 32) | (b == 10))
    near = at[np.flatnonzero(np.diff(np.append(at, len(b))) == 1)]  # with another one, or the end, behind it
    begins = np.zeros(len(b) + 1, bool)
    begins[starts] = begins[len(b)] = True
    odd.append(near[~(begins[near] & begins[near + 1])])  # an empty text is fine
    plain = np.ones(len(raw), bool)
    plain[np.searchsorted(starts, np.concatenate(odd), "right") - 1] = False
    if any(t in data for t in added):
        plain &= np.array([not any(t in r for t in added) for r in raw], bool)
    return plain


def batches_of(texts: pa.Array, most: int = 3 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(where it starts, texts) in runs of about `most` bytes, or of one longer text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes, dtype=np.int64) - sizes) // most if len(sizes) else sizes
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for s, e in zip(edges, edges[1:]):
        if e > s:
            yield s, texts.slice(s, e - s).to_pylist()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One for each worker process, kept between tasks."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
