"""Token ids of whole texts by the tokenizers library, each different pre-token encoded once."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

#: Letters of byte-level BPE vocabularies' pre-token pattern, spelt out for the characters that
#: are not among ODD; and the bytes that stand for themselves in its words.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
PLAIN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Texts with other characters go to the library whole, as character classes may differ there.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\xff\u0100-\u017f]")
#: What a character is to that pattern, by code point, and a byte that is a character or part of one.
SPACE, LETTER, DIGIT, OTHER, STRANGE = range(5)
KIND = np.array([STRANGE if ODD.match(c) else SPACE if c in "\t\n\r " else LETTER if re.match(f"[{LETTERS}]", c) else DIGIT if c in "0123456789" else OTHER for c in map(chr, range(0x180))], np.uint8)
BYTE_KIND = np.where(np.arange(256) < 128, KIND[:256], STRANGE).astype(np.uint8)


def byte_letters() -> dict[int, str]:
    """The letter for each byte: itself, or the next one from 256 on."""
    other = iter(range(256, 512))
    return {b: chr(b if b in PLAIN_BYTES else next(other)) for b in range(256)}


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin in the UTF-8 bytes of texts that lie one after another, and which texts have a character of ODD.

    at: where each text begins, and the end of all. The pre-tokens are the matches of
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|\\s+(?!\\S)|\\s+
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[at] = True
    kind = BYTE_KIND[data]
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    two = two[~first[two + 1]]
    two = two[data[two + 1] & 0xC0 == 0x80]
    kind[two] = kind[two + 1] = KIND[(data[two] & 31).astype(np.int64) << 6 | data[two + 1] & 63]
    strange = np.zeros(len(at) - 1, bool)
    strange[np.searchsorted(at, np.flatnonzero(kind == STRANGE), "right") - 1] = True

    start = first
    texts = np.unique(at)
    start[1:n] |= kind[1:] != kind[:-1]
    # the last of some white space before a word stands alone, or begins the word if it is a space
    word = np.flatnonzero(start[:n])
    word = word[kind[word] != SPACE]
    word = word[(word > 0) & (kind[word - 1] == SPACE)]
    word = word[texts[np.searchsorted(texts, word)] != word]
    start[word - 1] = True
    start[word] = data[word - 1] != 32
    # 's and so on where a pre-token begins
    a = np.flatnonzero(data == 39)
    a = a[start[a]]
    end = texts[np.minimum(np.searchsorted(texts, a, "right"), len(texts) - 1)] - a
    a, end = a[end > 1], end[end > 1]
    x, y = data[a + 1], data[np.minimum(a + 2, n - 1)]
    short = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    long = (end > 2) & ((np.isin(x, np.frombuffer(b"rv", np.uint8)) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
    start[a[short | long] + 1] = False
    start[a[short] + 2] = True
    start[a[long] + 3] = True
    return np.flatnonzero(start[:n]), strange


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + size] of all one after another, and where each begins, with the end."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return flat[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


class Encoder:
    """encode(texts) -> list of int arrays, equal to the library's encode(text, add_special_tokens=False).

    Byte-level BPE treats each pre-token apart, so the library encodes each different one once: ids are
    kept for at most `most` of them (the oftenest stay when room is made) and texts are put together from
    them. Vocabularies of another kind, texts with unusual characters and texts with a special token's
    string take the plain way. column() does the same for an Arrow column, without a Python string for each pre-token.
    """

    def __init__(self, path: str, most: int = 400_000):
        import pyarrow as pa
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tok, self.most, self.letters = Tokenizer.from_file(path), most, byte_letters()
        self.words = Tokenizer(self.tok.model)  # the model alone, for words that are split and spelt already
        self.words.pre_tokenizer = CharDelimiterSplit(self.letters[0])  # no word has a byte 0
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.joined = all(x in vocabulary for x in self.letters.values())
        self.watch = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        pre, norm = self.tok.pre_tokenizer, self.tok.normalizer
        self.fast = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and norm is None
        self.names = pa.array([], pa.large_binary())
        self.flat, self.start, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _make_room(self, keep: int) -> None:
        import pyarrow as pa

        at = np.sort(np.argsort(-self.used, kind="stable")[:keep])
        self.names = self.names.take(pa.array(at))
        self.flat = gather(self.flat, self.start[at], self.size[at])[0]
        self.size, self.used = self.size[at], self.used[at] // 2
        self.start = np.cumsum(self.size) - self.size

    def rest(self) -> None:
        """Between tasks only the oftenest quarter stays in memory."""
        if len(self.names) > self.most // 4:
            self._make_room(self.most // 4)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa

        return self._apart(pa.array(texts, pa.large_string()))

    def _apart(self, texts) -> list[np.ndarray]:
        flat, at = self.column(texts)
        return [flat[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]

    def column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column (null: empty) one after another, and where each text's begin, with the end."""
        import pyarrow as pa

        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts) or not self.fast:
            return self._one_by_one(texts, np.ones(len(texts), bool))
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        begin, odd = split(data, at)
        raw = data.tobytes() if self.watch else b""
        for x in self.watch:
            found = raw.find(x)
            while found >= 0:
                row = int(np.searchsorted(at, found, "right")) - 1
                odd[row] = True
                found = raw.find(x, max(found + 1, int(at[row + 1]) - len(x) + 1))
        if odd.any():
            return self._one_by_one(texts, odd)
        if len(self.names) > self.most:
            self._make_room(self.most // 4)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]).dictionary_encode()
        which, own = tokens.indices.to_numpy(), self._slots(tokens.dictionary)
        self.used[own] += np.bincount(which, minlength=len(own))
        flat, start = gather(self.flat, self.start[own], self.size[own])
        flat, end = gather(flat, start[:-1][which], self.size[own][which])
        return flat, end[np.searchsorted(begin, at)]

    def _one_by_one(self, texts, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """column(), where the texts that are odd go to the library whole."""
        import pyarrow as pa

        plain = iter(self._plain(texts.filter(pa.array(odd)).to_pylist()))
        others = iter([] if odd.all() else self._apart(texts.filter(pa.array(~odd))))
        got = [next(plain if o else others) for o in odd.tolist()]
        at = np.cumsum([0, *map(len, got)], dtype=np.int64)
        return np.concatenate([np.zeros(0, np.int32), *got]), at

    def _slots(self, words) -> np.ndarray:
        """The place of each of these different words; those that are new get one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(words, value_set=self.names)
        own, new = found.fill_null(0).to_numpy().astype(np.int64), found.is_null()
        fresh = words.filter(new)
        if len(fresh):
            own[new.to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(fresh))
            got = [self._ids(fresh.slice(i, 1000)) for i in range(0, len(fresh), 1000)]
            ids, size = (np.concatenate(x) for x in zip(*got))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.flat, self.size = np.append(self.flat, ids), np.append(self.size, size)
            self.names, self.used = pa.concat_arrays([self.names, fresh]), np.append(self.used, np.zeros(len(fresh), np.int64))
        return own

    def _ids(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        words = words.to_pylist()
        spelt = b"\0".join(words).decode("latin-1").translate(self.letters)
        if self.joined:  # one call for all: the ids' lengths in bytes tell the words apart
            ids = np.array(self.words.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, np.int32)
            ends, at = np.cumsum([len(x) for x in words]), np.cumsum(self.width[ids])
            to = np.searchsorted(at, ends) + 1
            if to[-1] == len(ids) and np.array_equal(at[to - 1], ends):
                return ids, np.diff(to, prepend=0)
        each = [e.ids for e in self.words.encode_batch_fast(spelt.split(self.letters[0]), add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)


_made: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary."""
    if path not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path] = Encoder(path)
    return _made[path]


def with_end(flat: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """What column() gives, with end_id after each text's ids."""
    to = at + np.arange(len(at))
    out, own = np.full(int(to[-1]), end_id, "<u4"), np.ones(int(to[-1]), bool)
    own[to[1:] - 1] = False
    out[own] = flat
    return out, to


def runs(sizes: Iterable[int], most: int):
    """(from, to) of runs with a sum of about `most` at most, or one alone."""
    at = n = i = 0
    for i, size in enumerate(sizes, 1):
        if n and n + size > most:
            yield at, i - 1
            at, n = i - 1, 0
        n += size + 1
    if at < i:
        yield at, i


def chunks(texts: list, most_chars: int = 4_000_000):
    """(from, to) of runs of texts with about most_chars characters at most, or one text."""
    return runs(map(len, texts), most_chars)


def encoded(enc: Encoder, texts, end_id: int, most_bytes: int = 4_000_000):
    """(from, to, ids of these texts one after another with an end each, where each text's begin) of runs of an Arrow column."""
    import pyarrow.compute as pc

    for lo, hi in runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most_bytes):
        yield lo, hi, *with_end(*enc.column(texts.slice(lo, hi - lo)), end_id)
