"""Byte-level BPE of whole texts from a public vocabulary file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters of text encoded at once.  Longer texts are cut where a space follows a character that is none, which no token crosses.
SLICE_CHARS = 1 << 20
_CUT = re.compile(r"\S(?= )")

#: Fixed value: the pattern by which byte-level vocabularies part text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def visible_bytes() -> dict[str, int]:
    """Byte that each character of a byte-level token stands for: visible Latin-1 for itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(spare)): b for b in range(256)}


def slices(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about ``size`` characters; each part but the last ends before a space."""
    size, at = size or SLICE_CHARS, 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class ByteBPE:
    """Token ids as the vocabulary's own library gives them.

    ``token_bytes[i]`` are the bytes of id ``i``.  The file's merges are in the order of
    their ids, as ranks; a file for which that does not hold is refused.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        stands = visible_bytes()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(stands[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        merged = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"]["".join(m)] for m in merged]
        if ids != sorted(ids) or spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.token_bytes = [b""] * (1 + max([*ranks.values(), *self.specials.values()]))
        for token, i in ranks.items():
            self.token_bytes[i] = token
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def encode(self, text: str, specials: bool = True) -> np.ndarray:
        """Ids of a whole text; strings of special tokens are those tokens, or plain text."""
        if specials and any(s in text for s in self.specials):
            parts = [self.coder.encode(s, allowed_special="all", disallowed_special=()) for s in slices(text)]
        else:
            parts = [self.coder.encode_ordinary(s) for s in slices(text)]
        return np.concatenate([np.array(p, dtype=np.uint32) for p in parts])


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """A worker's coder: Spark keeps workers for many tasks, and the vocabulary is parsed once in each."""
    return ByteBPE(path)
