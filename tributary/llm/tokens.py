"""Token ids of whole texts from a byte-level BPE file of the tokenizers library.

Encoding a text splits it into pieces that the vocabulary's own splitting
pattern never joins, looks every piece up among those met before, and has the
library encode the rest.  The ids are those of encoding the text at once.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tributary.llm.words import chunks, eights, hashes

#: Pieces remembered in each Python worker, some 100 bytes each; then it starts afresh.
REMEMBERED = 700_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the others follow from
    code point 256 on, in ascending order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 16- or 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.letters = byte_letters()
        self.newline = self._whole("\n")
        self.tails = {t: self._whole(t) for t in (",", ".")}
        self.seen: dict[str, bytes] = {}
        self.blank: set[str] = set()
        self._afresh()

    def _afresh(self) -> None:
        self.seen.clear()
        self.blank.clear()
        self.seen |= {"": b"", "\n": self.newline}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    @staticmethod
    def pieces(text: str) -> list[str] | None:
        """Pieces of a text whose white space seems to be single blanks and line ends, else None.

        A blank or line end between other characters always starts a piece.
        """
        if "\0" in text or len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _learn(self, missing: list[str]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for piece in missing:
            word = piece[1:] if piece[0] == " " else piece
            tail = word[-1:] if word[-1:] in (",", ".") else ""
            if not word[: len(word) - len(tail)].isalpha():
                self.seen[piece] = self._whole(piece)
                if not word or any(map(str.isspace, word)):
                    self.blank.add(piece)
                continue
            head = piece[: len(piece) - len(tail)]
            ids = self.seen.get(head)
            if ids is None:
                if word.isascii():
                    mapped = head.replace(" ", letters[32])
                else:
                    mapped = head.encode().decode("latin-1").translate(letters)
                ids = self.seen[head] = np.array([t.id for t in tokenize(mapped)], dtype=self.kind).tobytes()
            if tail:
                self.seen[piece] = ids + self.tails[tail]

    def pieces_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pieces, as encode() cuts them."""
        tails = {",": ",", ".": "."}
        tokenize, letters, out = self.tokenizer.model.tokenize, self.letters, []
        for piece in pieces:
            tail = tails.get(piece[-1:], "") if len(piece) > 1 else ""
            head = piece[:-1] if tail else piece
            word = head[1:] if head[0] == " " else head
            if not word.isalpha():
                out.append(self._whole(piece))
                continue
            mapped = head.replace(" ", letters[32]) if word.isascii() else head.encode().decode("latin-1").translate(letters)
            ids = np.array([t.id for t in tokenize(mapped)], dtype=self.kind).tobytes()
            out.append(ids + self.tails[tail] if tail else ids)
        return out

    def encode(self, text: str) -> bytes:
        cut = None if any(t in text for t in self.added) else self.pieces(text)
        if cut is None:
            return self._whole(text) if text else b""
        found = list(map(self.seen.get, cut))
        if None in found:
            if len(self.seen) > REMEMBERED:
                self._afresh()
                found = list(map(self.seen.get, cut))
            self._learn(list({p for p, ids in zip(cut, found) if ids is None}))
            found = [self.seen[p] if ids is None else ids for p, ids in zip(cut, found)]
        if self.blank and not self.blank.isdisjoint(cut):
            return self._whole(text)
        return b"".join(found)


LEAD, FAR = np.uint64((1 << 56) - 1), np.uint64(1 << 63)
fingerprints = hashes


def differ(whole: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, lengths: np.ndarray, stored: np.ndarray | None = None) -> np.ndarray:
    """Whether pieces have other bytes than those at places, in the same buffer or in a store of eights."""
    out = sizes != lengths
    same = np.flatnonzero(~out)
    if len(same):
        parts, step, counts = chunks(whole, starts[same], starts[same] + sizes[same])
        if stored is None:
            others = chunks(whole, places[same], places[same] + sizes[same])[0]
        else:
            others = stored[np.repeat(places[same], counts) + step]
        out[same] = np.logical_or.reduceat(parts != others, np.cumsum(counts) - counts)
    return out


class BatchEncoder:
    """Encodes many texts at once, from their bytes laid end to end.

    A piece's key is itself and its length if it has at most seven bytes, else a
    64-bit fingerprint.  Keys are looked up in one sorted array, and ids copied
    from one flat array; the bytes of longer pieces are compared on every hit.
    Texts with other white space than single blanks and line ends, texts that
    hold an added token, and those with a piece whose bytes differ from those
    known under its key are encoded as a whole.
    """

    def __init__(self, path: str):
        self.plain = Encoder(path)
        self.kind = self.plain.kind
        self._afresh()

    def _afresh(self) -> None:
        self.plain._afresh()
        self.keys = np.zeros(0, np.uint64)
        self.which = np.zeros(0, np.int64)
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(1 << 16, self.kind)
        self.used = 0
        # Bytes of longer pieces, by eights.
        self.lengths, self.eight_at, self.eights = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    @staticmethod
    def odd(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may hold other white space, or two white-space characters in a row."""
        blank = (buffer == 32) | (buffer == 10)
        bad = ((buffer >= 9) & (buffer <= 13) & ~blank) | ((buffer >= 28) & (buffer <= 31))
        if len(buffer) > 1:
            lead, follow = buffer[:-1], buffer[1:]
            twice = blank[:-1] & blank[1:]
            # Bytes that begin the characters of white space beyond ASCII.
            wide = (lead == 0xC2) & ((follow == 0x85) | (follow == 0xA0)) | (lead == 0xE1) & (follow == 0x9A)
            wide |= (lead == 0xE2) & ((follow == 0x80) | (follow == 0x81)) | (lead == 0xE3) & (follow == 0x80)
            bad[:-1] |= twice | wide
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(buffer))]
            bad[edges - 1] &= ~(twice | wide)[edges - 1] | ((buffer[edges - 1] >= 9) & (buffer[edges - 1] <= 13) & ~blank[edges - 1])
        total = np.concatenate([[0], np.cumsum(bad)])
        return total[offsets[1:]] > total[offsets[:-1]]

    def marked(self, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may hold a token that the vocabulary file adds."""
        out = np.zeros(len(offsets) - 1, dtype=bool)
        # A pattern reads the array itself; bytes.find would need a copy of it.
        for token in self.plain.added:
            for m in re.finditer(re.escape(token.encode()), buffer):
                out[np.searchsorted(offsets, m.start(), "right") - 1] = True
        return out

    def encode(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and each text's count."""
        n = len(offsets) - 1
        odd = self.odd(buffer, offsets) | self.marked(buffer, offsets)
        begins = np.zeros(len(buffer) + 1, dtype=bool)
        begins[:-1] = (buffer == 32) | (buffer == 10)
        begins[1:] |= np.append(buffer == 10, False)[:-1]
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(buffer))
        doc = np.searchsorted(offsets, starts, "right") - 1
        if odd.any():
            kept = ~odd[doc]
            starts, ends, doc = starts[kept], ends[kept], doc[kept]
        long = ends - starts
        whole = eights(buffer)
        keys = whole[starts] & LEAD | long.astype(np.uint64) << np.uint64(56)
        far = np.flatnonzero(long > 7)
        keys[far] = fingerprints(buffer, starts[far], ends[far]) | FAR
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place, unlike = self._lookup(unique, buffer, whole, starts[first], ends[first])
        which = place[inverse]
        other = unlike[inverse]
        same = first[inverse[far]]
        other[far] |= differ(whole, starts[far], long[far], starts[same], long[same])
        odd[doc[other]] = True
        sizes = self.sizes[which]
        # Copy every piece's ids to its place.
        total = int(sizes.sum())
        ahead = np.cumsum(sizes) - sizes
        source = np.repeat(self.at[which] - ahead, sizes) + np.arange(total)
        ids = self.store[source]
        counts = np.bincount(doc, weights=sizes, minlength=n).astype(np.int64)
        if not odd.any():
            return ids, counts
        bounds = np.concatenate([[0], np.cumsum(counts)])
        parts = []
        for k in range(n):
            if odd[k]:
                text = buffer[offsets[k] : offsets[k + 1]].tobytes().decode()
                own = np.frombuffer(self.plain.encode(text), self.kind)
                counts[k] = len(own)
            else:
                own = ids[bounds[k] : bounds[k + 1]]
            parts.append(own)
        return np.concatenate(parts) if parts else ids, counts

    def _lookup(self, unique: np.ndarray, buffer: np.ndarray, whole: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces in the flat array, those not met before encoded; whether other bytes are known under a key."""
        if len(self.keys) > REMEMBERED:
            self._afresh()
        found = np.searchsorted(self.keys, unique)
        have = np.zeros(len(unique), dtype=bool)
        inside = found < len(self.keys)
        have[inside] = self.keys[found[inside]] == unique[inside]
        out = np.empty(len(unique), dtype=np.int64)
        out[have] = self.which[found[have]]
        unlike = np.zeros(len(unique), dtype=bool)
        met = np.flatnonzero(have & (unique >= FAR))
        unlike[met] = differ(whole, starts[met], (ends - starts)[met], self.eight_at[out[met]], self.lengths[out[met]], self.eights)
        new = np.flatnonzero(~have)
        if len(new):
            data = buffer.tobytes()
            made = self.plain.pieces_of([data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            sizes = np.array([len(m) for m in made], dtype=np.int64) // self.kind.itemsize
            flat = np.frombuffer(b"".join(made), self.kind)
            while self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[self.used : self.used + len(flat)] = flat
            numbers = len(self.sizes) + np.arange(len(new))
            self.at = np.concatenate([self.at, self.used + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used += len(flat)
            self.keys = np.insert(self.keys, found[new], unique[new])
            self.which = np.insert(self.which, found[new], numbers)
            out[new] = numbers
            lengths = (ends - starts)[new]
            parts, _, counts = chunks(whole, starts[new], ends[new])
            counts, parts = np.where(lengths > 7, counts, 0), parts[np.repeat(lengths > 7, counts)]
            self.lengths = np.concatenate([self.lengths, lengths])
            self.eight_at = np.concatenate([self.eight_at, len(self.eights) + np.cumsum(counts) - counts])
            self.eights = np.concatenate([self.eights, parts])
        return out, unlike


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder for a vocabulary file; made once."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]
