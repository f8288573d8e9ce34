"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern. Each piece, mapped to Latin-1, is searched with one automaton of all tokens; from
the longest match at each position the encoder backtracks to shorter ones until neighbouring tokens are compatible, that is,
until merging their bytes alone would give the same two tokens. Compatibility is memoised, a position that cannot be
continued is never tried again, and so a piece costs linear time and gives exactly the tokens of the merges.

Defined cases: null and empty texts have no tokens; a text may be of any length; special tokens are ordinary text; of two matches at one
place the longer is tried first, so there are no ties; rows of equal or null doc_id are each encoded and keep their doc_id; an
empty table has no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import only, steps

#: Entries that the memos of one Python worker hold before they start anew (memory only; results stay the same).
MEMO = 400_000
_NEVER = 1 << 62
_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary()), ("same", pa.bool_())])


class Codec:
    """Encoder and decoder of one rank file; the file must hold all 256 single bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.edges: dict[int, tuple[list[int], list[int]] | None] = {}
        self.prefixes: dict[int, int] = {}
        size = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def merged(self, data: bytes, below: int = _NEVER) -> list[int]:
        """Tokens by plain merging of the pair of least rank under `below`, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def borders(self, token: int) -> tuple[list[int], list[int]] | None:
        """What stands at the left and the right border while the token is merged together, first to last."""
        if token not in self.edges:
            left, right, out = [token], [token], True
            for chain, side in ((left, 0), (right, 1)):
                while out and len(self.tokens[chain[-1]]) > 1:
                    halves = self.merged(self.tokens[chain[-1]], chain[-1])
                    out = len(halves) == 2
                    chain.append(halves[side])
            self.edges[token] = (left[::-1], right[::-1]) if out else None
        return self.edges[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives just a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            one, two = self.borders(a), self.borders(b)
            known = self.merged(self.tokens[a] + self.tokens[b]) == [a, b] if one is None or two is None else self._apart(one[1], two[0])
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _apart(self, right: list[int], left: list[int]) -> bool:
        i = j = 0
        while True:
            across = self.ranks.get(self.tokens[right[i]] + self.tokens[left[j]], _NEVER)
            up = right[i + 1] if i + 1 < len(right) else _NEVER
            down = left[j + 1] if j + 1 < len(left) else _NEVER
            if across < up and across <= down and across < _NEVER:
                return False
            if up == down == _NEVER:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix; -1 if none."""
        found = self.prefixes.get(token)
        if found is None:
            data = self.tokens[token]
            found = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
            self.prefixes[token] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece of text."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [0] * len(data)
        for end, (rank, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = rank
        out: list[int] = []
        dead = bytearray(len(data) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + len(self.tokens[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == len(data):
                    return out
                token = longest[at]
                continue
            token = self.shorter(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.shorter(token)

    def encode(self, text: str) -> np.ndarray:
        known, pieces = self.pieces, self.findall(text)
        try:
            return np.frombuffer(b"".join([known[p] for p in pieces]), np.int32)
        except KeyError:
            out = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = np.array(self.piece(p.encode()), np.int32).tobytes()
                    if len(p) <= 64:
                        if len(known) >= MEMO:
                            known.clear()
                        known[p] = ids
                out.append(ids)
            return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, as an array."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        shift = self.places[ids] - (ends - sizes)
        return self.bytes[np.repeat(shift, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per file in each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, check: bool = False) -> DataFrame:
    """Per row: doc_id, ids array<int>, decoded, the bytes that the ids give back; with `check`, instead of them, same: whether they are the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = codec(path, pattern)
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                raw = data.tobytes()
                own = [tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")) for i in range(b - a)]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                ids = np.concatenate(own)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                back = tokenizer.decode(ids).tobytes()
                ends = np.concatenate([[0], np.cumsum(tokenizer.lengths[ids])])[cuts]
                if check:
                    texts, same = pa.nulls(b - a, pa.binary()), [back[ends[i] : ends[i + 1]] == raw[offsets[i] : offsets[i + 1]] for i in range(b - a)]
                else:
                    texts, same = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(back)]), [None] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), lists, texts, pa.array(same, pa.bool_())], schema=_OUT)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary, same boolean")
