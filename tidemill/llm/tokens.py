"""Token ids of whole texts, equal to those of the ``tokenizers`` library for a byte-level BPE file.

The library encodes word by word. Its ids for a chunk (a space and what follows up to the next space) don't
depend on the neighbours, except where white space meets white space, so chunks are looked up in a bounded cache;
texts with such runs, with special tokens, or with characters beyond the checked range are encoded whole by the library.
A chunk that is not cached is encoded by ``tiktoken`` from the same vocabulary, which is several times faster.
"""

from __future__ import annotations

import json
import re

import numpy as np

from tidemill.llm.common import sole

#: Cached chunks for each worker; longer chunks than CHUNK_CHARS are rarely seen twice and never kept.
CACHE_CHUNKS, CHUNK_CHARS = 400_000, 24
_RUN = re.compile(r"\s(?:  | \Z)")
_BEYOND = re.compile("[^\x00-ɏ‐-‧€]")
#: The pre-tokenization pattern of the file's byte-level model (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        back = _byte_symbols()
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fast = fast.encode_ordinary
        self.chunks = _Chunks(self.fast)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _RUN.search(text) or any(s in text for s in self.special) or not (text.isascii() or not _BEYOND.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.fast(first), "<u4").tobytes() + b"".join(map(self.chunks.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in sole(_ENCODERS):
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
