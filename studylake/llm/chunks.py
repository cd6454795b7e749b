"""Distinct-chunk tables for tokenizers: each distinct chunk is segmented once and its ids are joined
back by position.

A worker keeps the table between batches. It holds at most ``limit`` chunks: when full, chunks that were
asked for again since the last turn stay and the others go, so memory is bounded for any corpus, and
a chunk that is met again is segmented again with the same ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

LIMIT = 300_000
AT_ONCE = 2_000_000


class ChunkTable:
    def __init__(self, segment: Callable[[list[str]], Iterable[bytes]], limit: int = LIMIT):
        self.segment, self.limit = segment, limit
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}

    def encode(self, texts: list[str | None], chunks: Callable[[str], list[str]]) -> list[bytes]:
        """The packed ids of each text; ``chunks`` cuts a text. Texts of about ``AT_ONCE`` characters are cut at a time."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(chunks(text or ""))
            size += len(text or "")
            if size >= AT_ONCE:
                out += self._join(group)
                group, size = [], 0
        return out + self._join(group)

    def _join(self, texts: list[list[str]]) -> list[bytes]:
        distinct: set[str] = set()
        for chunks in texts:
            distinct.update(chunks)
        known = dict(zip(distinct, self.get(list(distinct)), strict=True))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in texts]

    def get(self, distinct: list[str]) -> list[bytes]:
        """The packed ids of each of these chunks, which differ."""
        out = list(map(self.new.get, distinct))
        asked = [i for i, ids in enumerate(out) if ids is None]
        missing = []
        for i in asked:
            out[i] = ids = self.old.get(distinct[i])
            if ids is None:
                missing.append(i)
            else:
                self.new[distinct[i]] = ids
        for i, ids in zip(missing, self.segment([distinct[i] for i in missing]), strict=True):
            out[i] = self.new[distinct[i]] = ids
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        return out
