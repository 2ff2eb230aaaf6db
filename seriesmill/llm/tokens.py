"""Byte-level BPE ids of texts, equal to those of the `tokenizers` library for the same vocabulary file.

The ids are computed with `tiktoken` from the ranks in the JSON file, which takes about a fifth of the CPU time; a
text that its pattern engine cannot take (for instance a megabyte of spaces) goes through `tokenizers` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The vocabulary writes printable Latin-1 bytes as themselves and the others as U+0100 onwards, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        chars = _byte_of_char()
        # The fast engine merges by id, the library by place in the list of merges; both must be one order.
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: the ids of its merges are not in the order of the merges")
        ranks = {bytes(chars[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._slow = None

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids; none for a null or empty text. A special token's string is that token, as `tokenizers` has it."""
        if not text:
            return np.zeros(0, np.uint32)
        special = "all" if any(s in text for s in self.special) else set()
        try:
            return self._fast.encode_to_numpy(text, allowed_special=special, disallowed_special=()).astype(np.uint32)
        except BaseException as e:  # the engine's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow_ids(text)

    def slow_ids(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=8)
def largest_id(path: str | None = None) -> int:
    with open(path or default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", []))])


def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
