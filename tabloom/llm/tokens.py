"""Exact, cached encoding with the tokenizers library (executor side).

A text is cut only where no token can cross, each different piece goes to the
library once per worker, and the ids of a text are gathered from its pieces.
The result equals ``Tokenizer.encode`` of the whole text (tests compare them).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of one generation; a worker remembers two, and forgets the older when the younger is full.
CACHE_PIECES = 250_000
#: A letter run and what follows of these are separate tokens in every vocabulary used here.
TAIL = ".,!%#*$&|;:?"
#: White space next to white space, or other than space and line end: such texts are not cut.
_UNSAFE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces:
    """Pieces by number, and their ids one after another."""

    def __init__(self, dtype: np.dtype):
        self.number: dict[str, int] = {}
        self.flat, self.at = np.empty(1 << 16, dtype), np.zeros(1 << 12, np.int64)

    def find(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, -1 of unknown ones."""
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.number)
        used = int(self.at[n])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), self.flat.dtype)])
        if n + len(pieces) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(pieces) + 1), np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(pieces)] = used + np.cumsum(lens)
        self.number.update(zip(pieces, range(n, n + len(pieces))))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.at[numbers + 1] - self.at[numbers]
        return self.flat[spread(self.at[numbers], lens)], lens


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after another."""
    stop = np.cumsum(lens)
    total = int(stop[-1]) if len(stop) else 0
    # Within a group, which is bounded, places fit in 32 bits; a longer single text takes 64.
    wide = np.int32 if total < 1 << 31 and (not total or int(starts.max()) < 1 << 30) else np.int64
    out = np.repeat((starts - (stop - lens)).astype(wide), lens)
    out += np.arange(total, dtype=wide)
    return out


class Encoder:
    """Encodes columns of texts; ``loose`` vocabularies drop white space, ``tight`` ones keep it before a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would only wait
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        probe = [self._ids(x) for x in ("a b", "a", "b", " b", "a\nb", "\n")]
        self.loose = probe[0] == probe[1] + probe[2] == probe[4] and probe[5] == []
        self.tight = not self.loose and probe[0] == probe[1] + probe[3] and probe[4] == probe[1] + probe[5] + probe[2]
        # ASCII capitals may be lowered beforehand if the vocabulary lowers them anyway.
        self.lowers = self.loose and all(self._ids(x) == self._ids(x.lower()) for x in ("ABC xyZ", "I\u0307 E\u0301", "IT'S 3D."))
        # Texts that go to the library whole: those in which it may find an added token (told by its first
        # signs, or all of it in any case), and where lowering first would let a letter and a mark compose.
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        whole = [re.match(r"[^\w\s]*", t)[0][:4] or f"(?i:{re.escape(t)})" for t in sorted(added)]
        whole = [x if x.startswith("(?i:") else re.escape(x) for x in whole]
        whole += [r"[A-Z]\pM"] if self.lowers else []
        whole += [_UNSAFE] if self.tight else []
        self.whole = "|".join(whole)
        self.known: dict[str, tuple[_Pieces, _Pieces]] = {}
        # Which ids end a run of letters (loose) or begin one behind a space (tight); None if that doesn't show.
        self.edge = None
        tokens = [t for t, _ in sorted(self.tok.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
        mark = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix") if self.loose else "\u0120"
        if (self.loose or self.tight) and mark and len(tokens) == self.vocab:
            self.edge = np.array([t.endswith(mark) if self.loose else t.startswith(mark) for t in tokens])

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _pieces(self, pieces: list[str], letters: np.ndarray, lead: str) -> tuple[_Pieces, np.ndarray]:
        """What is remembered of pieces (runs of letters or not) written after ``lead``, now with all of these in it, and their numbers."""
        young, old = self.known.get(lead) or (_Pieces(self.dtype), _Pieces(self.dtype))
        if len(young.number) > CACHE_PIECES:
            young, old = _Pieces(self.dtype), young
        self.known[lead] = young, old
        at = young.find(pieces)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = [pieces[i] for i in missing]
            before = old.find(rest)
            have = np.flatnonzero(before >= 0)
            young.add([rest[i] for i in have], *old.take(before[have]))
            new = before < 0
            plain = letters[missing] if self.edge is not None and bool(lead) == self.tight else np.zeros(len(rest), bool)
            for kind, run in ((plain, self._joined), (~plain, self._apart)):
                part = [rest[i] for i in np.flatnonzero(new & kind)]
                for i in range(0, len(part), 20_000):
                    young.add(part[i : i + 20_000], *run(part[i : i + 20_000], lead))
            at[missing] = young.find(rest)
        return young, at

    def _apart(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, and how many: every piece a call of its own."""
        ids = [e.ids for e in self.tok.encode_batch_fast([lead + x for x in pieces] if lead else pieces, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.dtype, int(lens.sum())), lens

    def _joined(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of runs of letters, many to a call: the first (or last) token of each tells where it is cut."""
        texts = [lead + " ".join(pieces[i : i + 200]) for i in range(0, len(pieces), 200)]
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, sum(map(len, ids)))
        at = np.flatnonzero(self.edge[flat])
        if len(at) != len(pieces):  # some piece has tokens of more than one run
            if len(pieces) <= 200:
                return self._apart(pieces, lead)
            ids, lens = zip(*(self._joined(pieces[i : i + 200], lead) for i in range(0, len(pieces), 200)))
            return np.concatenate(ids), np.concatenate(lens)
        return flat, np.diff(at, append=len(flat)) if self.tight else np.diff(at, prepend=-1)

    def _tables(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has.

        Signs behind a run of letters are tokens of their own, so words that
        differ in them only are one piece, encoded and remembered once.
        """
        base = pc.utf8_rtrim(words, TAIL)
        behind = (pc.binary_length(words).to_numpy() - pc.binary_length(base).to_numpy()).astype(np.int64)
        cut = pc.utf8_is_alpha(base).to_numpy(zero_copy_only=False) & (behind > 0) & (behind <= 7)
        pieces = (pc.if_else(pa.array(cut), base, words) if cut.any() else words).dictionary_encode()
        known = pieces.dictionary
        young, numbers = self._pieces(known.to_numpy(zero_copy_only=False).tolist(), pc.utf8_is_alpha(known).to_numpy(zero_copy_only=False), lead)
        numbers = numbers[pieces.indices.to_numpy()]
        starts, lens = young.at[numbers], young.at[numbers + 1] - young.at[numbers]
        at = np.flatnonzero(cut)
        if not len(at):
            return young.flat[spread(starts, lens)], lens
        # The signs of a word as one number, its bytes from the last to the first; few differ.
        ends, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 + at], np.frombuffer(words.buffers()[2], np.uint8)
        code = np.zeros(len(at), np.int64)
        for k in range(int(behind[at].max())):
            more = behind[at] > k
            code[more] |= data[ends[more] - 1 - k].astype(np.int64) << (8 * k)
        codes, which = np.unique(code, return_inverse=True)
        signs = [self._ids(int(c).to_bytes(8, "big").lstrip(b"\0").decode()) for c in codes]
        sign_lens = np.array([len(s) for s in signs], np.int64)
        sign_at = int(young.at[len(young.number)]) + np.cumsum(sign_lens) - sign_lens
        # Two runs a word: its piece, and the signs behind it (none for most).
        two = np.zeros((len(words), 2, 2), np.int64)
        two[:, 0, 0], two[:, 0, 1] = starts, lens
        two[at, 1, 0], two[at, 1, 1] = sign_at[which], sign_lens[which]
        flat = np.concatenate([young.flat[: int(young.at[len(young.number)])], np.fromiter(chain.from_iterable(signs), self.dtype, int(sign_lens.sum()))])
        return flat[spread(two[:, :, 0].ravel(), two[:, :, 1].ravel())], two[:, :, 1].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), and len(texts) + 1 offsets into them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.loose and not self.tight:
            whole = np.ones(len(texts), bool)
        elif self.whole:
            whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        else:
            whole = np.zeros(len(texts), bool)
        cut = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        cut = pc.replace_substring(cut, "\n", " " if self.loose else " \n ")
        cut = pc.ascii_lower(cut) if self.lowers else cut
        lists = pc.split_pattern(cut, " ")
        coded = lists.values.dictionary_encode()
        words, codes, ends = coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        if self.loose:
            ids, lens = self._tables(words, "")
        else:
            # The first word of a text or line has nothing before it, any other word a space.
            line = pc.index(words, pa.scalar("\n", words.type)).as_py()
            first = codes == line
            first[1:] |= codes[:-1] == line
            first[ends[:-1][ends[:-1] < len(codes)]] = True
            tables, base = [], 0
            place = np.empty((2, len(words)), np.int64)
            for k, lead in ((0, " "), (1, "")):
                used = np.flatnonzero(np.bincount(codes[first == k], minlength=len(words)))
                place[k, used] = base + np.arange(len(used))
                tables.append(self._tables(words.take(pa.array(used)), lead))
                base += len(used)
            ids, lens = (np.concatenate(x) for x in zip(*tables))
            codes = place[first.astype(np.int8), codes]
        at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        n = lens[codes]
        stop = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int64)
        out = ids[spread(at[codes], n)]
        offsets = stop[ends]
        if not whole.any():
            return out, offsets
        parts = [np.array(self._ids(texts[i].as_py()), self.dtype) if w else out[offsets[i] : offsets[i + 1]] for i, w in enumerate(whole)]
        return np.concatenate([*parts, np.empty(0, self.dtype)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_made: WeakSet[Encoder] = WeakSet()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    enc = Encoder(path)
    _made.add(enc)
    return enc


def forget() -> None:
    """Drop what this worker remembers of pieces: it serves other tasks too, and they need the memory."""
    for enc in _made:
        enc.known.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers stay, and other operators need it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def groups(texts: pa.Array, chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about that many bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield start, i
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def encode_column(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text in turn; memory follows a bounded number of texts, or one long text."""
    enc = encoder(path)
    for a, b in groups(texts):
        ids, at = enc.encode(texts.slice(a, b - a))
        for i in range(b - a):
            yield ids[at[i] : at[i + 1]]
