"""The exact token count of every prefix of a text, found by dynamic programming over byte-level BPE.

For a pre-token w let last(j) be the last token of BPE(w[:j]). It is the longest vocabulary entry t that ends at j, is its
own encoding, and stands behind last(j - len t) without being merged with it; then count(j) = count(j - len t) + 1.
One pass so gives all prefixes. A text's table is the changes of the count from one code point to the next.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import partial
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, keyed_text, small_batches
from .tokens import CLOSING, cut

_PARTS = regex.compile(r"(?P<joined>'s|'t|'re|'ve|'m|'ll|'d)|(?P<run> ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+)|(?P<space>\s+(?!\S)|\s+)")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Tables of texts under one vocabulary file; what is remembered is emptied at ``limit`` pieces."""

    def __init__(self, path: str, limit: int = 900_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        ids = {b: spec["model"]["vocab"][t] for t, b in raw.items()}
        self.text = {i: b for b, i in ids.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[raw[a], raw[b]] = i
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        made: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.ranks:
            made.setdefault(a + b, (a, b))
        self.edges = {i: (self._edge(b, made, 1), self._edge(b, made, 0)) for b, i in ids.items()}
        self.limit = limit
        self.fits: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.words: dict[str, list[int]] = {}
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        import ahocorasick
        self.ends = ahocorasick.Automaton()  # every token that is its own encoding, found where it ends, longest first
        for b, i in ids.items():
            if self._merged(b) == [b]:
                self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()

    def _merged(self, data: bytes) -> list[bytes]:
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, pair = min(((self.ranks.get(p, len(self.ranks)), p) for p in zip(parts, parts[1:])), key=lambda x: x[0])
            if rank == len(self.ranks):
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _edge(self, token: bytes, made: dict, side: int) -> list[tuple[bytes, int]]:
        """What stands at the right (1) or left (0) end of a token while it is merged together, each with the merge that ends it."""
        out, until = [], len(self.ranks) + 1
        while True:
            out.append((token, until))
            if token not in made:
                return out
            until = self.ranks[made[token]]
            token = made[token][side]

    def _fit(self, before: int, token: int) -> bool:
        """Whether BPE leaves these two tokens side by side: no merge over their border comes due while both its halves stand.

        Of two equal merges the left one comes first, so a half of ``token`` still stands at its own merge's rank."""
        if self.pairs > 2 * self.limit:
            self.fits.clear()
            self.pairs = 0
        rank = self.ranks.get
        none = len(self.ranks) + 1
        known = not any((r := rank((x, y), none)) < x_until and r <= y_until and r < none
                        for x, x_until in self.edges[before][0] for y, y_until in self.edges[token][1])
        self.fits.setdefault(before, {})[token] = known
        self.pairs += 1
        return known

    def _count(self, word: str) -> list[int]:
        """Counts of word[:0], word[:1], ... where every such start is one pre-token."""
        data, fits = word.encode("utf-8"), self.fits
        last, count, at = [-1], [0], -1
        for end, (token, size) in self.ends.iter(data.decode("latin-1")):
            if end == at:
                continue
            i = end + 1 - size
            if i:
                before = last[i]
                try:
                    ok = fits[before][token]
                except KeyError:
                    ok = self._fit(before, token)
                if not ok:
                    continue
            at = end
            last.append(token)
            count.append(count[i] + 1)
        if len(word) < len(data):
            out, j = [0], 0
            for c in word:
                j += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                out.append(count[j])
            return out
        return count

    def word(self, word: str) -> list[int]:
        """Counts of word[:1], word[:2], ..., remembered."""
        known = self.words.get(word)
        if known is None:
            known = self.words[word] = self._count(word)[1:]
        return known

    def _run(self, word: str) -> bytes:
        """Changes of the count along one pre-token as signed bytes, remembered; an OverflowError if one does not fit."""
        known = self.runs.get(word)
        if known is None:
            c = self._count(word)
            known = self.runs[word] = array("b", map(sub, c[1:], c)).tobytes()
        return known

    def counts(self, raw: str) -> np.ndarray:
        """Counts of all starts of a text that holds no added token."""
        out, done, gap = [], 0, ""
        for m in _PARTS.finditer(raw):
            part = m[0]
            if m.lastgroup == "joined":  # cut inside, its letters stand alone
                c = [self.word("'")[0], *([self.word("'")[0] + self.word(part[1])[0]] if len(part) == 3 else []), self.word(part)[-1]]
            else:
                c = self.word(part)
            c = np.asarray(c) + done
            if gap and part[0].isspace():  # cut after its first character, the white space before it reaches to the end
                first = done - self.word(gap)[-1] + self.word(gap + part[0])[-1]
                done = c[-1]
                c = np.concatenate([[first], c[1:]]) if len(c) > 1 or m.end() < len(raw) else c
            done = int(c[-1]) if not (gap and part[0].isspace()) else int(done)
            gap = part if m.lastgroup == "space" else ""
            out.append(c)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _steps(self, raw: str) -> bytes:
        """Changes of the count as signed bytes; empty if one does not fit."""
        if raw[:1] == "\n" and len(raw) > 1 and not raw[1].isspace():  # a line end before a visible character stands alone
            return self._run("\n") + self._steps(raw[1:])
        base = raw.rstrip(CLOSING)
        if base.isalpha() or base[:1] == " " and base[1:].isalpha():  # letters, then perhaps closing marks: two pre-tokens
            try:
                return self._run(base) + self._run(raw[len(base):]) if len(base) < len(raw) else self._run(base)
            except OverflowError:
                return b""
        d = np.diff(self.counts(raw), prepend=0)
        return d.astype("<i1").tobytes() if not len(d) or abs(d).max() < 128 else b""

    def table(self, text: str) -> bytes:
        """One byte with the width of a step (1 or 4), then the steps, one for each code point."""
        if len(self.pieces) > self.limit:
            self.pieces.clear()
            self.words.clear()
            self.runs.clear()
        if self.added and self.added.search(text):
            return self._split(text)
        parts = cut(text)
        get = self.pieces.get
        steps = list(map(get, parts[1:]))
        if None in steps:
            for i in [i for i, s in enumerate(steps) if s is None]:
                p = parts[i + 1]
                steps[i] = self.pieces[p] = self._steps(p if p[:1] == "\n" else " " + p)
        steps.insert(0, self._steps(parts[0]))
        if b"" in steps and (b"" in steps[1:] or parts[0]):
            return b"\x04" + np.concatenate([np.diff(self.counts(p if i == 0 or p[:1] == "\n" else " " + p), prepend=0)
                                             for i, p in enumerate(parts)]).astype("<i4").tobytes()
        return b"\x01" + b"".join(steps)

    def _split(self, text: str) -> bytes:
        """A text with added tokens: each counts one when whole, and is ordinary text while it is cut."""
        out, done, tail = [], 0, ""
        for i, part in enumerate(self.added.split(text)):
            if i % 2 == 0:
                c = unpack(self.table(part)) if part else np.zeros(0, np.int64)
                out.append(c + done)
                before, done = done, done + (int(c[-1]) if len(c) else 0)
                last = cut(part)[-1] if part else ""
                tail = part[len(part) - len(last) - (0 if last == part or last[:1] == "\n" else 1):] if part else ""
                base = before + (int(c[len(part) - len(tail) - 1]) if len(part) > len(tail) else 0)
            else:
                out += [self.counts(tail + part)[len(tail):-1] + base, [done + 1]]
                done += 1
        steps = np.diff(np.concatenate(out), prepend=0)
        return b"\x04" + steps.astype("<i4").tobytes()


def unpack(table: bytes) -> np.ndarray:
    """Counts of all prefixes from one code point to the whole text."""
    return np.cumsum(np.frombuffer(table, "<i4" if table[:1] == b"\x04" else "<i1", offset=1), dtype=np.int64)


def tokens_before(table: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points."""
    c = unpack(table)
    return int(c[min(chars, len(c)) - 1]) if chars > 0 and len(c) else 0


def longest_within(table: bytes, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    fit = np.flatnonzero(unpack(table) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


_HELD: dict[str, PrefixCounter] = {}


def _tables(batches: Iterator[pa.RecordBatch], tokenizer: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    counter = _HELD.setdefault(tokenizer, None) or PrefixCounter(tokenizer)
    _HELD[tokenizer] = counter
    for batch in batches:
        for keys, texts in blocks(batch):
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                                              pa.array([counter.table(t) for t in texts], pa.binary())], schema=schema)


def prefix_tables(df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, n_bytes and ``table``, the counts of all prefixes of the whole text.

    ``tokenizer`` names a byte-level BPE file. A null or empty text has an empty table and no tokens. Repeated rows and null
    keys are kept as they are; other columns are not read. Nothing is shuffled."""
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = keyed_text(df, key, text)
    kind = to_arrow_schema(rows.select("key").schema).field(0).type
    schema = pa.schema([("key", kind), ("n_bytes", pa.int64()), ("table", pa.binary())])
    ddl = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes bigint, table binary"
    return rows.mapInArrow(partial(_tables, tokenizer=tokenizer, schema=schema), ddl).withColumnRenamed("key", key)


def _answers(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = batch.column(batch.num_columns - 1).to_pylist()
        totals = [int(np.frombuffer(t, "<i4" if t[:1] == b"\x04" else "<i1", offset=1).sum(dtype=np.int64)) for t in tables]
        fits = [len(t) // (4 if t[:1] == b"\x04" else 1) - (t[:1] == b"\x01") if n <= budget else longest_within(t, budget) for t, n in zip(tables, totals)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array([n > budget for n in totals]), pa.array(fits, pa.int64())],
                                         names=[*batch.schema.names[:-1], "n_tokens", "over_limit", "fits_chars"])


def budgets(tables: DataFrame, budget: int) -> DataFrame:
    """From stored tables, without encoding again: n_tokens, over_limit, and fits_chars, the longest prefix within ``budget``."""
    *head, last = tables.columns
    assert last == "table"
    kept = ", ".join(f"`{c}` {tables.schema[c].dataType.simpleString()}" for c in head)
    return tables.mapInArrow(partial(_answers, budget=budget), f"{kept}, n_tokens bigint, over_limit boolean, fits_chars bigint")
