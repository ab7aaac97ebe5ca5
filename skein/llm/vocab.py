"""Reading of public tokenizer files: vocabulary, merges, byte alphabet and word splitting.

The file's place is always a parameter; nothing is copied from it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex


def default_path(name: str) -> str:
    """Where the installed public vocabularies keep the file of this name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print as themselves in Latin-1 keep their character; the others take the
    characters from U+0100 on, in the order of the bytes.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, fresh = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(fresh))
            fresh += 1
    return out


class WordVocabulary:
    """A BPE vocabulary over lower-cased words with an end-of-word mark.

    A text, as UTF-8, is split at its special strings, then at ASCII white space; each chunk is
    normalised and cut into words. Chunks don't influence one another, since neither pattern nor
    normalisation crosses white space. Printable ASCII is lower-cased and cut here by the file's
    pattern; for all other chunks, which depend on a version of Unicode, the library's own
    normaliser and splitter are asked. Words are spelt in the byte alphabet.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        parts = Tokenizer.from_file(path)
        self.normalizer, self.splitter = parts.normalizer, parts.pre_tokenizer
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges]
        self.special: dict[bytes, int] = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        self.alphabet = byte_alphabet()
        self.symbol = {c: self.ids[c] for c in self.alphabet}
        self.final_symbol = {c: self.ids[c + self.suffix] for c in self.alphabet}
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.marks = tuple(self.special)

    def segments(self, raw: bytes) -> list[tuple[bytes, bytes | None]]:
        """(text before a special string, that string), at last (the rest, None)."""
        if not any(m in raw for m in self.marks):
            return [(raw, None)]
        out, at = [], 0
        for m in self.special_pattern.finditer(raw):
            out.append((raw[at : m.start()], m[0]))
            at = m.end()
        return [*out, (raw[at:], None)]

    def words(self, chunk: bytes) -> list[str]:
        """The words of one chunk in the byte alphabet, in which printable ASCII stands for itself."""
        text = chunk.decode()
        if text.isascii() and text.isprintable():
            return self.pattern.findall(text.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def symbols(self, word: str) -> list[int]:
        """The identifiers of a word's bytes; the last one carries the end-of-word mark."""
        out = [self.symbol[c] for c in word]
        out[-1] = self.final_symbol[word[-1]]
        return out


class Memo(dict):
    """A dictionary that computes what it lacks and forgets the older half beyond a size.

    It only saves time: a value is a function of its key alone. Keys longer than LONG aren't kept.
    """

    LONG = 64

    def __init__(self, compute: Callable, most: int = 400_000) -> None:
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.LONG:
                return value
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
