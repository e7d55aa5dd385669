"""Byte-level BPE encoding by a public vocabulary file (a path, never copied).

The JSON file that the `tokenizers` library reads is turned into merge ranks once
per Python worker, and texts are encoded by tiktoken's implementation of the same
algorithm, several times as fast.  tests/llm holds both against each other, ids
equal, over all of Unicode; special tokens in a text are taken as such by both.

That implementation splits by a backtracking pattern, which fails on very long runs
of white space; such runs are cut out by the pattern's own rule before.  A file whose
settings are not those of this family is left to the `tokenizers` library itself.
"""

from __future__ import annotations

import json
import re
from functools import cache

#: The fixed splitting pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What \s is in that pattern; runs from this length on are cut out.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _printable() -> dict[str, int]:
    """The stand-in character of each byte: itself where it prints, else the next
    unused code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def of_family(spec: dict) -> bool:
    """Whether the file's settings are those that PATTERN and merge ranks stand for."""
    model, split = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        return False
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ranks = [model["vocab"].get(a + b, -1) for a, b in pairs]
    return all(a < b for a, b in zip([-1, *ranks], ranks))


@cache
def encoder(path: str):
    """(encode: text -> list of ids) for the vocabulary at this path."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not of_family(spec):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda text: model.encode(text, add_special_tokens=False).ids

    import tiktoken

    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    byte = _printable()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    whole = (lambda text: encoding.encode(text, allowed_special="all")) if special else encoding.encode_ordinary
    marks = tuple(special)

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return whole(text)
        out, at = [], 0
        for run in _SPACES.finditer(text):
            first, end = run.span()
            if end - first < LONG_RUN:
                continue
            # \s+(?!\S): the last one is left for what follows, if anything does
            last = end if end == len(text) or text.startswith(marks, end) else end - 1
            out += whole(text[at:first]) + encoding._encode_single_piece(text[first:last])
            at = last
        return out + whole(text[at:])

    return encode
