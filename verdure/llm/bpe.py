"""Byte-level BPE that gives exact merges in linear time.

A piece's bytes are mapped to Latin-1, so that an Aho-Corasick automaton over the vocabulary finds the longest token at
each place. The encoder takes longest matches and backtracks to shorter ones where two neighbours could not stand side by
side after merging; whether they can is worked out from the merge ranks and memoised. A place from which no encoding was
found is marked and never tried again, so the work is linear in the piece.

The vocabulary is read in each Python worker from the tokenizer file, which must be at the same path everywhere; ids are
ranks. NULL texts count as empty: no ids, and the digest of nothing. Repeated rows repeat their result; extra columns are
ignored by :func:`digests` and kept by :func:`encoded`.
"""

from __future__ import annotations

import base64
import copy
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import by_text

#: Distinct pieces remembered by a task; the memory is emptied when it is full.
REMEMBERED = 600_000
#: Texts whose ids and bytes are held at once, where these are returned.
AT_ONCE = 256


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.splits: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        self.words: dict[str, int] = {}
        for token, rank in ranks.items():
            parts = self._parts(token, rank)
            if len(token) == 1:
                self.splits[rank] = (rank, rank)
            elif len(parts) == 2:
                left, right = ranks[parts[0]], ranks[parts[1]]
                self.splits[rank], self.pairs[left, right] = (left, right), rank
            else:
                continue  # no sequence of merges ends in it; it is used for a whole piece alone
            self.words[token.decode("latin-1")] = rank
            self.trie.add_word(token.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.widest = max(map(len, self.words))
        self.size = {i: len(b) for i, b in self.tokens.items()}
        self.pack = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def fresh(self) -> Codec:
        """The same vocabulary with a memory of its own, which goes with it."""
        own = copy.copy(self)
        own.fits, own.known = {}, {}
        return own

    def _parts(self, token: bytes, below: int) -> list[bytes]:
        """What merging gives when only merges of a rank under ``below`` are allowed."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def can_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves just these two tokens."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._side_by_side(left, right)
        return known

    def _side_by_side(self, left: int, right: int) -> bool:
        """Undo the later of the two merges, again and again, and look for a merge across the border that came first."""
        a, b, before = left, right, float("inf")
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < before:
                return False
            if a > b:  # the left token was merged last; undo it
                part, whole = self.splits[a][1], a
                if part != whole:
                    a, before = part, whole
                    continue
                part, whole = self.splits[b][0], b
                if part == whole:
                    return True
                b, before = part, whole + 1
            else:
                part, whole = self.splits[b][0], b
                if part != whole:
                    b, before = part, whole + 1
                    continue
                part, whole = self.splits[a][1], a
                if part == whole:
                    return True
                a, before = part, whole

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            b, found = self.tokens[token], -1
            for n in range(len(b) - 1, 0, -1):
                rank = self.ranks.get(b[:n])
                if rank is not None and rank in self.splits:
                    found = rank
                    break
            self.shorter[token] = found
        return found

    def _longest_at(self, text: str, at: int) -> int:
        """The longest token that starts at a place of a Latin-1 text: the trie's longest path, shortened to a token."""
        rest = text[at : at + self.widest]
        words = self.words
        for n in range(self.trie.longest_prefix(rest), 0, -1):
            rank = words.get(rest[:n])
            if rank is not None:
                return rank
        raise KeyError(rest)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        n = len(text)
        greedy = [rank for _, rank in self.trie.iter_long(text)]  # if all neighbours fit, nothing has to be undone
        fits = self.fits
        for pair in zip(greedy, greedy[1:]):
            if not (fits[pair] if pair in fits else self.can_follow(*pair)):
                break
        else:
            if sum(self.size[i] for i in greedy) == n:
                return greedy
        reach = bytearray(b"\x01") * (n + 1)  # 0: no encoding goes through this place
        ids: list[int] = []
        at, token = 0, greedy[0]
        while at < n:
            last = ids[-1] if ids else None
            while True:
                end = at + len(self.tokens[token])
                if reach[end] and (last is None or self.can_follow(last, token)):
                    ids.append(token)
                    at = end
                    token = self._longest_at(text, at) if at < n else -1
                    break
                token = self._next_shorter(token)
                if token < 0:
                    reach[at] = 0
                    ids.pop()
                    at -= len(self.tokens[last])
                    token = last
                    break
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        known, pack, out = self.known, self.pack, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(self.fits) >= REMEMBERED:
                    self.fits.clear()
                ids = b"".join([pack[i] for i in self.merge(piece.encode("utf-8"))])
                if len(ids) <= 256:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (the bytes that the ids stand for), in place
    of columns of these names."""

    def make():
        c = codec(path, pattern).fresh()  # a worker outlives the task: later stages run beside what it still holds
        return lambda texts: [(ids := c.encode(t or ""), c.decode(numbers(ids))) for t in texts]

    return by_text(docs, [c for c in docs.columns if c not in ("ids", "decoded")], "ids binary, decoded binary", make, AT_ONCE)


def numbers(ids: bytes) -> list[int]:
    import numpy as np

    return np.frombuffer(ids, "<u4").tolist()


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: n_tokens, the digest of its ids and of the bytes that they decode to."""

    def make():
        c, sha = codec(path, pattern).fresh(), hashlib.sha256
        return lambda texts: [(len(ids := c.encode(t or "")) // 4, sha(ids).hexdigest(), sha(c.decode(numbers(ids))).hexdigest()) for t in texts]

    return by_text(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
