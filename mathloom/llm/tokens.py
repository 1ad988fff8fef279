"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

# Fixed value: how byte-level BPE of this family splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_known: dict[tuple[str, bool], Callable[[str], np.ndarray]] = {}


def byte_of() -> dict[str, int]:
    """The byte each letter of a byte-level entry stands for: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_vocabulary(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer file; an added token has its text's bytes."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters = byte_of()
    entries = {i: bytes(letters[c] for c in piece) for piece, i in told["model"]["vocab"].items()}
    for token in told["added_tokens"]:
        entries.setdefault(token["id"], token["content"].encode())
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def _plain(path: str) -> Callable[[str], np.ndarray] | None:
    """The same ids from the vocabulary as ranks, several times faster.

    Only where the file is plain byte-level BPE whose ids follow its merges; else None.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    kind = (model.get("type", "BPE"), before.get("type"), before.get("use_regex", True), before.get("add_prefix_space"))
    odd = [told.get("normalizer"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("dropout")]
    if kind != ("BPE", "ByteLevel", True, False) or any(odd) or model.get("ignore_merges"):
        return None
    pieces = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
    if any(model["vocab"].get(piece) != 256 + i for i, piece in enumerate(pieces)):
        return None
    letters = byte_of()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items()}
    return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


def encoder(path: str, specials: bool) -> Callable[[str], np.ndarray]:
    """Text to ids as the tokenizers library gives them without special tokens around it.

    Strings of special tokens inside a text become their ids if ``specials``, else plain text.
    Loaded once per worker process.
    """
    if (path, specials) not in _known:
        with open(path, encoding="utf-8") as f:
            listed = json.load(f)["added_tokens"]
        added = [t["content"] for t in listed if specials or not t["special"]]
        plain = _plain(path)
        loaded: list = []

        def library(text: str) -> np.ndarray:
            if not loaded:
                from tokenizers import Tokenizer

                tokenizer = Tokenizer.from_file(path)
                tokenizer.no_padding()
                tokenizer.no_truncation()
                tokenizer.encode_special_tokens = not specials
                loaded.append(tokenizer)
            return np.array(loaded[0].encode(text, add_special_tokens=False).ids, np.uint32)

        def encode(text: str) -> np.ndarray:
            return library(text) if plain is None or any(a in text for a in added) else plain(text)

        _known[path, specials] = encode
    return _known[path, specials]
