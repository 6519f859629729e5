"""Token ids of whole texts by the public byte-level BPE vocabulary, which comes in the files of two libraries.

Both give the same ids (the tests compare them). The faster one is used for ordinary texts; a text that holds the string of a special
token goes through the other, which gives that token's id.
"""

from __future__ import annotations

import base64
import sys
from array import array


class Tokens:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, end: int | None = None) -> bytes:
        """The ids of a text, then ``end`` if there is one."""
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        made = array("I", ids if end is None else [*ids, end])
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()
