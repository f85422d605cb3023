"""Token ids of texts, word by word, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Iterator

from staffline.llm.common import word_blocks

#: Words remembered by each worker process; beyond, it starts afresh.
REMEMBERED = 500_000
TOKENIZER = "word_bpe_49k.json"
#: An ASCII sign but the apostrophe after a letter from a to z or from U+00C0 to U+017F (bar two signs and U+0130). The tokenizer
#: always splits there, so a space changes nothing; without the sign there are fewer different words. U+0130 is lower-cased to
#: i and a combining dot, which is no letter and stays with the sign.
_SIGN_AFTER_LETTER = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].)|(?<=\xc4[\x80-\xaf\xb1-\xbf].)|(?<=\xc5[\x80-\xbf].))")
#: The letters that byte-level models use for bytes: printable Latin-1 as it is, the others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_OF_BYTE = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Encodes texts with a tokenizer like the default one: lower case, NFC, byte-level BPE within runs of letters or of
    signs and never over white space. So each word is encoded on its own, and remembered (word -> ids).

    ``ordinary_specials`` makes the special tokens' strings in a text ordinary text.
    """

    def __init__(self, path: str, ordinary_specials: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary_specials
        self.model = self.tokenizer.model

    def blocks(self, text: bytes) -> Iterator[bytes]:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers, in pieces."""
        if b"<|" not in text:  # no special token; case does not matter to the tokenizer
            text = _SIGN_AFTER_LETTER.sub(rb" \g<0>", text.lower())
        for words in word_blocks(text):
            yield b"".join(map(self.__getitem__, words))
            if len(self) > REMEMBERED:
                self.clear()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            # One run of lower-case letters: normalising and splitting leave it alone, so only the model is asked.
            letters = text if text.isascii() else word.decode("latin-1").translate(_LETTER_OF_BYTE)
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, ordinary_specials: bool = False) -> WordEncoder:
    """This process's encoder for a tokenizer file."""
    key = (path, ordinary_specials)
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]
