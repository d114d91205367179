"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import json
import os
from array import array

ID_BYTES = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


def _ranked(path: str):
    """The file's merges as a ``tiktoken`` encoding, which gives the same ids faster; None where ids do not follow the merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, merges = model["model"].get("vocab", {}), model["model"].get("merges", [])
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if model.get("normalizer") or not pairs or [vocab.get("".join(p)) for p in pairs] != list(range(256, 256 + len(pairs))):
        return None
    byte = _letters()
    ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes texts as a byte-level BPE file of the ``tokenizers`` library does, remembering words.

    The tokenizer's split pattern always begins a new piece at a space between
    two characters that are not white space, so such chunks are encoded once and
    looked up afterwards.  A text with any other space at a chunk's edge, or with
    a special token's string in it, is encoded whole.
    """

    def __init__(self, path: str | None = None, remember: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = path or default_tokenizer()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember = remember
        self.known: dict[str, bytes | None] = {}
        ranked = _ranked(path)
        self.ids = ranked.encode_ordinary if ranked else lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.ids(text)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        known, ids = self.known, self.ids
        if len(known) > self.remember:
            known.clear()
        chunks = [t.split(" ") for t in texts]
        for c in chunks:
            for word in set(c).difference(known):
                known[word] = array("I", ids(" " + word)).tobytes() if word and not word[0].isspace() and not word[-1].isspace() else None
        out = []
        for text, c in zip(texts, chunks):
            found = None
            if not any(s in text for s in self.special) and known[c[0]] is not None:
                try:
                    found = array("I", ids(c[0])).tobytes() + b"".join([known[w] for w in c[1:]])
                except TypeError:  # a chunk with white space at an edge
                    pass
            out.append(self._whole(text) if found is None else found)
        return out
