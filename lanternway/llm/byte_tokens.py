"""Token ids of the byte-level vocabulary, whole texts, with an end id behind every document.

The ids are those of the tokenizers library. Its rank form of the same vocabulary gives the same ids
about three times as fast, so texts of plain Latin letters (where both libraries' letter classes are
the same beyond doubt) take that path; any other text, and text that spells a special token, goes to
the tokenizers library itself. A test holds both against each other.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

END = 0
SPECIAL = "<|endoftext|>"
_OTHER = re.compile("[^\x00-ɏ]")
#: Blanks in a row up to which the rank form is asked: it keeps a place for each, and gives up at about a million.
BLANKS = 1 << 16
_BLANK = re.compile(rf"\s{{{BLANKS}}}")


def plain(text: str) -> bool:
    """Whether a text is of Latin letters up to U+024F, spells no special token and has no endless run of blanks."""
    return SPECIAL not in text and (text.isascii() or not _OTHER.search(text)) and not (len(text) >= BLANKS and _BLANK.search(text))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _encoders(path: str) -> tuple:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    full.no_truncation()
    full.no_padding()
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return full, None
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
    return full, tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(texts: list[str], path: str, end: int | None = END) -> list[np.ndarray]:
    """uint32 ids of each text, then the end id."""
    full, fast = _encoders(path)
    out = []
    tail = np.array([] if end is None else [end], np.uint32)
    for t in texts:
        if fast is None or not plain(t):
            ids = np.array(full.encode(t, add_special_tokens=False).ids, np.uint32)
        else:
            ids = fast.encode_to_numpy(t)
        out.append(np.concatenate([ids, tail]))
    return out
