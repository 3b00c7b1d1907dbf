"""Token ids of whole texts with a public tokenizer, word by word through a cache."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Sequence

import numpy as np

from loci.llm.common import numbered

TOGETHER = 20_000


class WordTokens:
    """Ids of texts with a tokenizer that never joins words across white space.

    Texts are cut at ASCII white space, which such a tokenizer drops; each distinct piece
    is tokenized once.  ``most`` bounds how many pieces are remembered.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(8192, np.uint32), 0

    def _learn(self, pieces: list[bytes]) -> None:
        """Tokenize new pieces, many in one call; offsets tell which ids belong to which piece."""
        for k in range(0, len(pieces), TOGETHER):
            some = pieces[k : k + TOGETHER]
            words = [p.decode("utf-8", "replace") for p in some]
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            begins = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
            sizes = np.bincount(np.searchsorted(begins, at, side="right"), minlength=len(words))
            first, total = len(self.place), len(ids)
            for name, need in (("starts", first + len(some)), ("sizes", first + len(some)), ("flat", self.used + total)):
                held = getattr(self, name)
                if need > len(held):
                    setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
            self.sizes[first : first + len(some)] = sizes
            self.starts[first : first + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : self.used + total] = ids
            self.used += total
            self.place.update(zip(some, range(first, first + len(some)), strict=True))

    def encode(self, texts: Sequence[bytes | None]) -> list[np.ndarray]:
        if len(self.place) > self.most:
            self.clear()
        cut = [(text or b"").split() for text in texts]
        out = []
        for at in numbered(cut, self.place, self._learn):
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            where = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)
            out.append(self.flat[where])
        return out


def shared_tokens(path: str) -> WordTokens:
    """The WordTokens of this process: a worker that runs several tasks keeps what it has learnt."""
    held = sys.modules.setdefault("_loci_llm_process", types.ModuleType("_loci_llm_process")).__dict__.setdefault("tokens", {})
    if path not in held:
        held[path] = WordTokens(path)
    return held[path]
