"""Token ids of whole texts, with each distinct word encoded once.

Both public vocabularies cut a text where white space begins, so a text's ids are those of its pieces
in a row. A slab of documents is cut into pieces as the vocabulary's own pattern would at ASCII white
space, Arrow numbers the distinct ones, and only pieces not met before go to the tokenizers library.
Texts with other white space or with a special token's opening go to the library whole. The result
equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` (tests compare them).
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .kernels import Slab, word_bounds

#: White space beyond ASCII's, the separators 1C to 1F, and what opens a special token.
_WHOLE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
#: Pieces, and words, that a worker remembers from one slab to the next: some 150 MB each at most.
_CACHE = 800_000
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_known: dict[tuple[str, bool], PieceEncoder] = {}


def _may_be_odd(signs: np.ndarray, data: bytes) -> bool:
    """Whether ``_WHOLE`` needs looking for: far quicker than the search itself."""
    return any(x in data for x in (b"<|", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")) or bool(((signs >= 0x1C) & (signs <= 0x1F)).any())


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


_SIGNS = _byte_signs()


def _byte_level(text: str) -> str:
    if text.isascii():
        return text.replace(" ", _SIGNS[32])
    return text.encode().decode("latin-1").translate(_SIGNS)


class PieceEncoder:
    """``spaced``: the vocabulary keeps white space, a word with the one space before it."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.ids: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.mark_id, mark = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = mark.content.encode()

    def _each(self, pieces: list[bytes]) -> None:
        """Looks pieces up that weren't met before. Letters of Latin-1 and the ASCII punctuation behind
        them are one pre-token each, which the library's model gets as it is; other pieces go through
        the whole library, in one call: the special token between them parts them, as the library
        splits a text there before it does anything else."""
        others, tokenize, ids = [], self.tokenizer.model.tokenize, self.ids
        for p in pieces:
            text = p.decode("utf-8", "replace")
            if self.spaced and p[:1] == b" " and p[1:].isalpha():  # ASCII letters alone, as most are
                word, marks = text, ""
            else:
                m = _PLAIN.fullmatch(text if self.spaced else text.strip(" \t\n\v\f\r"))
                if not m or b"<|" in p:
                    others.append(p)
                    continue
                word, marks = m[1] if self.spaced else m[1].lower(), m[2]
            got = self.words.get(word)
            if got is None:
                got = self.words[word] = array("I", [t.id for t in tokenize(_byte_level(word))]).tobytes()
            if marks:
                end = self.marks.get(marks)
                if end is None:
                    end = self.marks[marks] = array("I", [t.id for t in tokenize(_byte_level(marks))]).tobytes()
                got += end
            ids[p] = got
        for at in range(0, len(others), 1024):
            part = others[at : at + 1024]
            joined = self.mark.join(b"" if b"<|" in p else p for p in part).decode("utf-8", "replace")  # texts with <| go whole
            got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(got == self.mark_id).tolist()
            for p, a, b in zip(part, [0, *(c + 1 for c in cuts)], [*cuts, len(got)], strict=True):
                ids[p] = got[a:b].tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, s: Slab) -> np.ndarray:
        """Where each piece begins; a document's pieces cover it without a gap."""
        starts, ends, first = word_bounds(s.data, s.bounds)
        begins = s.bounds[:-1][np.diff(s.bounds) > 0]
        if not self.spaced:
            cut = np.zeros(len(s.data) + 1, bool)
            cut[ends] = cut[begins] = True
            return np.flatnonzero(cut[:-1])
        n = len(s.data)
        edge = np.zeros(n + 1, bool)
        edge[s.bounds] = True
        cut = edge.copy()
        cut[ends] = True
        before = np.where(edge[starts], 0, s.data[starts - 1])
        # a word takes one space before it; any other white space ends a run and stands alone
        cut[starts[before != 0x20]] = True
        cut[starts[before != 0] - 1] = True
        return np.flatnonzero(cut[:n])

    def slab(self, s: Slab) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's begin (one entry more at the end)."""
        if not len(s.data):
            return np.zeros(0, np.uint32), np.zeros(len(s.bounds), np.int64)
        begin = self._pieces(s)
        offsets = np.r_[begin, len(s.data)].astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(s.data))])
        coded = pieces.dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [p for p in distinct if p not in self.ids]
        if len(self.ids) + len(new) > _CACHE:
            self.ids, new = {}, distinct
        self._each(new)
        each = [self.ids[p] for p in distinct]
        if len(self.ids) > _CACHE:
            self.ids = {}
        if len(self.words) > _CACHE:
            self.words, self.marks = {}, {}
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32)
        count = size[code]
        total = np.cumsum(count)
        shift = ((np.cumsum(size) - size)[code] - (total - count)).astype(np.int32)
        ids = flat[np.repeat(shift, count) + np.arange(total[-1], dtype=np.int32)]
        bounds = np.r_[0, total][np.searchsorted(begin, s.bounds)]
        odd = {int(np.searchsorted(s.bounds, m.start(), "right")) - 1 for m in _WHOLE.finditer(data)} if _may_be_odd(s.data, data := s.data.tobytes()) else ()
        if odd:
            parts = [self.whole(s.text(i).decode("utf-8", "replace")) if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(len(s.ids))]
            ids, bounds = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, bounds


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder for each worker process."""
    return _known.setdefault((path, spaced), PieceEncoder(path, spaced)) if (path, spaced) not in _known else _known[path, spaced]
