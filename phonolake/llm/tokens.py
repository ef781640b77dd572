"""Public vocabularies, loaded once a worker process. Their folder is a parameter."""

from __future__ import annotations

import base64
import os
from functools import cache

import public_tokenizers

#: Where the public vocabulary files lie; every function takes another path too.
FOLDER = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
#: The split rule that belongs to the byte-level vocabulary of 50k entries. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_bpe(path: str = f"{FOLDER}/byte_bpe_50k.tiktoken"):
    """tiktoken's encoding for a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def tokenizer(path: str = f"{FOLDER}/byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def special_strings(path: str = f"{FOLDER}/byte_bpe_50k.json") -> tuple[str, ...]:
    """The strings that the tokenizer maps to an id as a whole wherever they stand."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
