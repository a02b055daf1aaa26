"""Token ids by a public tokenizer, with a bounded cache of pieces in each Python worker.

A text is cut where no token can reach across: for tokenizers that drop white
space at ASCII white space, for byte-level ones before a single space or line
feed that has other characters on both sides. Arrow cuts whole batches and lists
their distinct pieces; each of these is encoded once while it stays in the
cache, so the ids equal those of the whole text. A text with white space in
other places is cut by a slower pattern in its own way.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: By default: pieces in a generation of the cache, half as many words, and bytes of text that are cut together, but for a
#: single longer text. At most about 250 MB; smaller values take less memory and more time and give the same ids.
CACHE_PIECES, SLICE_BYTES = 400_000, 4 << 20
#: Bytes of a key that is kept at most.
CACHE_BYTES = 64
#: A plain piece: a space or line feed, letters that each stand for themselves, signs that no letter joins.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|]*)")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_WHITE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space beside white space, or at an end.
_ODD = rf"{_WHITE}{_WHITE}|\A{_WHITE}|{_WHITE}\z"


class Generations:
    """A bounded cache: when the younger generation is full the older one goes and the younger takes its place."""

    def __init__(self, entries: int) -> None:
        self.entries, self.young, self.old = entries, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= CACHE_BYTES:
            self.young[key] = ids

    def turn(self) -> None:
        """Between runs, so that a run's own entries stay."""
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young


class PieceEncoder:
    """Encodes whole texts to ids, little-endian, `width` bytes each.

    Strings of special tokens in a text are ordinary text, as the description of
    the tokenizer files has it.
    """

    def __init__(self, path: str, pieces: int = CACHE_PIECES, slice_bytes: int = SLICE_BYTES) -> None:
        self.slice_bytes = slice_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.drops_space = not self._encode([" "]).ids
        # A text piece and what the model sees of a word can be the same string, so each has a cache of its own.
        self.pieces, self.words = Generations(pieces), Generations(pieces // 2)
        self.letters = {ord(c): self._seen(c) for c in map(chr, range(256)) if _PLAIN.fullmatch(c)}
        self.before = {"": "", "\n": "", " ": "" if self.drops_space else self._seen(" a")[:-1]}
        self.feed = b"" if self.drops_space else self._bytes(self._encode(["\n"]).ids)
        self.signs: dict[str, bytes] = {"": b""}

    def _encode(self, pieces: list[str]):
        return self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)

    def _seen(self, text: str) -> str:
        """What the model gets to see of a text that makes one word."""
        normal = self.tokenizer.normalizer
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)[0][0]

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _word(self, seen: str) -> bytes:
        """Ids of a word as the model sees it."""
        ids = self.words.get(seen)
        if ids is None:
            ids = self._bytes([t.id for t in self.tokenizer.model.tokenize(seen)])
            self.words.put(seen, ids)
        return ids

    def _sign(self, signs: str) -> bytes:
        ids = self.signs.get(signs)
        if ids is None:
            ids = self._bytes(self._encode([signs]).ids)
            if len(self.signs) < 10_000 and len(signs) <= CACHE_BYTES:
                self.signs[signs] = ids
        return ids

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces: plain ones from their word and signs, others through the whole tokenizer."""
        self.pieces.turn()
        self.words.turn()
        young, old, other = self.pieces.young, self.pieces.old, []
        out = list(map(young.get, pieces))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = pieces[i]
            ids = old.get(p)
            if ids is None:
                m = _PLAIN.fullmatch(p)
                if m is None:
                    other.append(i)
                    continue
                space, letters, signs = m.groups()
                ids = self._word(self.before[space] + letters.translate(self.letters))
                if space == "\n":
                    ids = self.feed + ids
                if signs:
                    ids += self._sign(signs)
            if len(p) <= CACHE_BYTES:
                young[p] = ids
            out[i] = ids
        if other:
            found = self._encode([pieces[i] for i in other])
            ids = np.array(found.ids, self.dtype).tobytes()
            cut = (np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(other) + 1)) * self.width).tolist()
            for i, a, b in zip(other, cut, cut[1:], strict=False):
                out[i] = ids[a:b]
                self.pieces.put(pieces[i], ids[a:b])
        return out

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts, and how many each text has."""
        if self.drops_space:
            cut = pc.ascii_split_whitespace(texts)
            return cut.flatten(), pc.list_value_length(cut).to_numpy()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat, n = cut.flatten(), pc.list_value_length(cut).to_numpy()
        # Every piece but a text's first has its space back; one that begins with a line feed had none.
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        kept = first | pc.starts_with(flat, "\n").to_numpy(zero_copy_only=False)
        return pc.if_else(pa.array(kept), flat, pc.binary_join_element_wise("", flat, " ")), n

    def encode_batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of texts: their ids one after the other, and where each text's ids end. A null counts as empty."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.slice_bytes, "right")))
            yield self._encode_run(texts.slice(at, to - at))
            at = to

    def _encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, n = self._pieces(texts)
        known = pc.dictionary_encode(flat)
        ids = self._ids_of(known.dictionary.to_pylist())
        place = known.indices.to_numpy()
        size = np.array([len(x) for x in ids], np.int64) // self.width
        start = np.cumsum(size) - size
        each = size[place]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        all_ids = np.frombuffer(b"".join(ids), self.dtype)[np.arange(total) + np.repeat(start[place] - (ends - each), each)]
        return all_ids, np.concatenate([[0], ends])[np.cumsum(n)]

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if self.drops_space:
            return self._cut(texts)
        odd = pc.match_substring_regex(texts, _ODD)
        if not pc.any(odd).as_py():
            return self._cut(texts)
        flat, n = self._cut(pc.if_else(odd, "", texts))
        own = [_CUT.split(t) for t in texts.filter(odd).to_pylist()]
        # An empty piece stands where a text was cut apart; it has no ids, so pieces are put in its place.
        bad, n = odd.to_numpy(zero_copy_only=False), n.copy()
        at = (np.cumsum(n) - n)[bad]
        more = np.array([len(p) for p in own])
        n[bad] = more
        order = np.ones(len(flat), np.int64)
        order[at] = more
        fill = np.repeat(np.arange(len(flat)), order)
        spot = np.flatnonzero(np.isin(fill, at))
        fill[spot] = len(flat) + np.arange(len(spot))
        every = pa.concat_arrays([flat, pa.array([x for p in own for x in p], flat.type)])
        return every.take(pa.array(fill)), n

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for ids, ends in self.encode_batch(pa.array(texts, pa.string())):
            out += [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, *sizes: int) -> PieceEncoder:
    """This worker's encoder for the tokenizer file, with the sizes of its cache and slices."""
    if (path, *sizes) not in _encoders:
        _encoders.clear()
        _encoders[path, *sizes] = PieceEncoder(path, *sizes)
    return _encoders[path, *sizes]


def with_end(encoder_: PieceEncoder, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """Ids of each text and the end id, `width` bytes each."""
    for ids, ends in encoder_.encode_batch(texts):
        # The end id is put behind each text's ids.
        out = np.insert(ids, ends, np.array(end_id, ids.dtype))
        ends = ends + np.arange(1, len(ends) + 1)
        yield from np.split(out, ends[:-1])
