"""Token ids of whole texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import os
import re
from array import array

# The splitting pattern of byte-level BPE, and the same without its look-ahead, which only runs of three
# or more white-space characters, or two at the end of a text, need.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUNS = re.compile(r"\s\s\s|\s\s\Z")
_loaded: dict[str, ByteTokens] = {}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Ids as the ``tokenizers`` library gives them for the file, without special tokens added.

    A vocabulary whose merges stand in the order of their ids is encoded through ``tiktoken``, which is several times
    faster and gives the same ids; any other file goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.special = [t["content"] for t in form.get("added_tokens") or []]
        ranks = self.ranks(form)
        if ranks is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            self.plain = self.exact = None
            self.width = 4
        else:
            import tiktoken

            special = {t["content"]: t["id"] for t in form["added_tokens"]}
            exact = tiktoken.Encoding("exact", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
            self.whole = lambda text: exact.encode(text, allowed_special="all")
            self.exact = exact.encode_ordinary
            self.plain = tiktoken.Encoding("plain", pat_str=PLAIN_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.width = 2 if max([*ranks.values(), *special.values()]) < 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"

    @staticmethod
    def ranks(form: dict) -> dict[bytes, int] | None:
        """Bytes of each token with its id, if merging by lowest id is what the file says; else None."""
        model, before = form["model"], form.get("pre_tokenizer") or {}
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if model["type"] != "BPE" or form.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            return None
        if not before.get("use_regex", True) or model.get("dropout") or any(t.get(f) for t in form.get("added_tokens") or [] for f in flags):
            return None
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary.get(a + b, -1) for a, b in pairs]
        if made != sorted(made) or -1 in made:
            return None
        special = {t["content"] for t in form.get("added_tokens") or []}
        out = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return out if len(out) == len(vocabulary) - len(special & set(vocabulary)) else None

    def encode(self, text: str) -> bytes:
        """Little-endian ids of ``width`` bytes each."""
        if self.plain is None or any(s in text for s in self.special):
            ids = self.whole(text)
        elif _RUNS.search(text):
            ids = self.exact(text)
        else:
            ids = self.plain(text)
        return array(self.code, ids).tobytes()


def byte_tokens(path: str) -> ByteTokens:
    """The vocabulary of a file, loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = ByteTokens(path)
    return _loaded[path]
