"""Exact byte-level BPE through the tokenizers library, with remembered pieces."""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: white space other than the blank and the line end
_OTHER_SPACE = ("\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                "\u2028\u2029\u202f\u205f\u3000")
#: places where every byte-level pre-tokenizer also splits: before one blank or line end between visible characters
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
CLOSING = ".,;:!?%&*$#|)\"]}"
#: stands between pieces that are encoded in one call; no merge holds this byte
_SEPARATOR = "\x00"


def cut(text: str) -> list[str]:
    """Pieces whose tokens follow one another; a piece without a leading line end stands after a blank, but for the first."""
    pieces = text.replace("\n", " \n").split(" ")
    if "\n" not in pieces and "" not in pieces and not any(s in text for s in _OTHER_SPACE):
        return pieces
    return [p[1:] if i and p[0] == " " else p for i, p in enumerate(_CUT.split(text))]


def _cuts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """``cut`` of all texts: the first piece of each, the number of its others, these of all texts as places in a list, and that list."""
    lists = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
    pieces, starts = lists.values.dictionary_encode(), lists.offsets.to_numpy()
    distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
    letters = " ".join(distinct)
    if letters.startswith((" ", "\n ")) or letters.endswith((" ", " \n")) or "  " in letters or " \n " in letters or any(s in letters for s in _OTHER_SPACE):
        parts = [cut(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        pieces = pa.array([p for some in parts for p in some], pa.large_string()).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
    place = pieces.indices.to_numpy()
    return [distinct[i] for i in place[starts[:-1]].tolist()], np.diff(starts) - 1, np.delete(place, starts[:-1]), distinct


def check_kind(library) -> None:
    """ValueError unless texts can be cut at blanks: byte-level BPE whose own pattern splits the whole text, nothing before it."""
    kind = json.loads(library.to_str())
    split, model = kind["pre_tokenizer"] or {}, kind["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and kind["normalizer"] is None
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        raise ValueError("only byte-level BPE files with the usual split are read")


class PieceTokenizer:
    """``packed([text])`` holds ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Byte-level BPE never merges across a single blank between two visible characters, so a text is cut there,
    each distinct piece is encoded once by the library, and its ids are remembered. Texts that hold an added token's
    string or a zero byte are encoded whole. The memory is emptied at ``limit`` pieces. Of a call's texts each distinct
    piece is looked up once, and their ids are gathered from there."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        check_kind(self.library)
        self.whole = (_SEPARATOR, *(t.content for t in self.library.get_added_tokens_decoder().values()))
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.merges = self.library.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.letters = "".join("\n" if b == 10 else other.get(b, chr(b)) for b in range(256))
        (self.separator,) = self._ids(_SEPARATOR)
        assert self._ids("a.\x00 b").count(self.separator) == 1 and self._ids("\x00" * 9) == [self.separator] * 9

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _encode(self, raw: list[str]) -> dict[str, bytes]:
        """Ids of pieces that neither hold nor end in white space but for the first character, in one call."""
        ids = np.asarray(self._ids(_SEPARATOR.join(raw)), dtype=f"<u{self.width}")
        data, at, w, out = ids.tobytes(), 0, self.width, {}
        for p, end in zip(raw, [*np.flatnonzero(ids == self.separator).tolist(), len(ids)], strict=True):
            out[p] = data[at * w:end * w]
            at = end + 1
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a blank and are letters, each one pre-token: straight from the library's merges."""
        ids, ends = [], []
        for letters in codecs.charmap_decode("\n".join(words).encode("utf-8"), "strict", self.letters)[0].split("\n") if words else []:
            ids.extend([t.id for t in self.merges("\u0120" + letters)])
            ends.append(len(ids) * self.width)
        data = self.pack(ids)
        return [data[s:e] for s, e in zip([0, *ends], ends)]

    def _learn(self, fresh: list[str]) -> None:
        """Closing punctuation after a letter or digit is a token run of its own: the word before it is looked up alone."""
        known, tails, words, new, later = self.known, self.tails, {}, set(), []
        for p in fresh:
            base = p.rstrip(CLOSING)
            if base.isalpha():
                if base not in known:
                    words[base] = None
                if len(base) < len(p):
                    tail = p[len(base):]
                    later.append((p, base, tail))
                    if tail not in tails:
                        new.add(tail)
            elif p[-1:].isspace() or not p:
                known[p] = self.pack(self._ids(p if p[:1] == "\n" else " " + p))
            else:
                new.add(p if p[0] == "\n" else " " + p)
        known.update(zip(words, self._words(list(words))))
        for raw, ids in (self._encode(list(new)) if new else {}).items():
            if raw[0] == " ":
                known[raw[1:]] = ids
            elif raw[0] == "\n":
                known[raw] = ids
            else:
                tails[raw] = ids
        for p, base, tail in later:
            known[p] = known[base] + tails[tail]

    def _values(self, distinct: list[str]) -> list[bytes]:
        """Ids of pieces, from memory or learned."""
        if len(self.known) > self.limit:
            self.known.clear()
            self.tails.clear()
        values = list(map(self.known.get, distinct))
        fresh = [p for p, v in zip(distinct, values) if v is None]
        if fresh:
            self._learn(fresh)
            values = [self.known[p] if v is None else v for p, v in zip(distinct, values)]
        return values

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes."""
        out: list = [None] * len(texts)
        plain = range(len(texts))
        if any(s in "\n".join(texts) for s in self.whole):
            whole = [i for i, t in enumerate(texts) if any(s in t for s in self.whole)]
            for i, h in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = self.pack(h.ids)
            plain = [i for i, v in enumerate(out) if v is None]
        if not len(plain):
            return out
        heads, counts, place, distinct = _cuts([texts[i] for i in plain])
        heads = [self.pack(h.ids) for h in self.library.encode_batch_fast(heads, add_special_tokens=False)]
        values = self._values(distinct)
        ids = np.frombuffer(b"".join(values), dtype=f"<u{self.width}")
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        many, start = size[place], (np.cumsum(size) - size)[place]
        ends = np.cumsum(many)
        data = ids[np.arange(int(many.sum())) + np.repeat(start - (ends - many), many)].tobytes()
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        for i, head, s, e in zip(plain, heads, ends[:-1], ends[1:]):
            out[i] = head + data[s * self.width:e * self.width]
        return out


_HELD: dict[str, PieceTokenizer] = {}


def held(path: str) -> PieceTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _HELD:
        _HELD[path] = PieceTokenizer(path)
    return _HELD[path]
