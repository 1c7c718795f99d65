"""Tokenizers inside tasks: one instance for each worker process, looked up by file name."""

from __future__ import annotations

import os
import re


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; a name with a slash is a path itself."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the worker process; bound what goes in.

    This module travels with each task, so it is the library's module that holds it.
    """
    import tokenizers

    return tokenizers.__dict__.setdefault("_kept", {}).setdefault(name, {})


def tokenizer(name: str):
    """The ``tokenizers`` object of a vocabulary file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
    from tokenizers import Tokenizer

    loaded = worker_cache("by file")
    if name not in loaded:
        tok = Tokenizer.from_file(tokenizer_path(name))
        tok.no_truncation()
        tok.no_padding()
        loaded[name] = tok
    return loaded[name]


#: Normalizers that change a text word by word, and never across a blank.
_WORDWISE = {"NFC", "NFD", "Lowercase", "StripAccents"}


def splits_at_blanks(tok) -> bool:
    """Whether a text's ids are those of its words between blanks, one after another.

    That is so if blanks are dropped, not kept in tokens, and neither a normalizer
    nor a special string reaches across one.
    """
    import json

    spec = json.loads(tok.to_str())

    def wordwise(step) -> bool:
        if step is None or step["type"] in _WORDWISE:
            return True
        if step["type"] == "Sequence":
            return all(map(wordwise, step["normalizers"]))
        return step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "

    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    if not wordwise(spec["normalizer"]) or any(c.isspace() for t in added for c in t) or tok.pre_tokenizer is None:
        return False
    if any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return False
    # No character but blanks next to them may make a difference, whatever its class.
    sample = ["a", "Z", "é", "日", "7", "!", "'s", "_", "<", "\u0301", "\U0001f600", "\x85", "\x1c"]
    split = lambda t: [piece for piece, _ in tok.pre_tokenizer.pre_tokenize_str(t)]
    return split(" ") == split("\n") == [] and all(
        split(f"{a}{gap}{b}") == split(a) + split(b) for a in sample for b in sample for gap in (" ", "\n", " \n ")
    )


#: Letters and then marks, without quotes and angle brackets: two pre-tokens for most vocabularies of words.
_MARKS = r"[!-&(-/:;=?@\[-`{-~]*"
_SIMPLE = [re.compile(f"([{letters}]+)({_MARKS})") for letters in ("A-Za-zÀ-ÖØ-öø-ÿ", "A-Za-z")]


class WordIds:
    """Ids of words between blanks. Simple words go straight to the model, if the tokenizer treats them simply.

    Simple are letters of Latin-1, or else of ASCII, with ASCII marks behind them.
    """

    def __init__(self, tok):
        self.tok, self.marks = tok, {"": []}
        self.written: dict[int, str] = {}
        self.simple = next((p for p in _SIMPLE if self._simple(p)), None)

    def _simple(self, pattern: re.Pattern) -> bool:
        """Whether a simple word is its letters in lower case and its marks, each a pre-token as it stands or, of letters beyond ASCII, as ``written``."""
        tok = self.tok
        cased = "".join(chr(k) for k in range(65, 256) if pattern.fullmatch(chr(k)))
        letters = "".join(dict.fromkeys(cased.lower()))
        marks = [chr(k) for k in range(33, 127) if pattern.fullmatch("a" + chr(k)) and not chr(k).isalpha()]
        if any(pattern.fullmatch("a" + t.content) for t in tok.get_added_tokens_decoder().values()):
            return False
        if tok.normalizer is None or tok.normalizer.normalize_str(cased + "".join(marks)) != cased.lower() + "".join(marks):
            return False
        split = lambda t: [piece for piece, _ in tok.pre_tokenizer.pre_tokenize_str(t)]
        alone = {c: split(c) for c in letters}
        if any(len(p) != 1 or (c.isascii() and p != [c]) for c, p in alone.items()):
            return False
        self.written = {ord(c): p[0] for c, p in alone.items() if not c.isascii()}
        write = lambda t: t.translate(self.written)
        return (
            split(letters) == [write(letters)]
            and all(split(f"{c}b{c}{marks[0]}") == [write(f"{c}b{c}"), marks[0]] for c in letters)
            and all(split(f"{c}{a}{b}") == [write(c), a + b] for c in ("ab", letters[-1]) for a in marks for b in marks)
        )

    def __call__(self, words: list[str]) -> list[list[int]]:
        if not words:
            return []
        out, rest = [None] * len(words), []
        model, simple = self.tok.model.tokenize, self.simple.fullmatch if self.simple else lambda word: None
        for k, word in enumerate(words):
            found = simple(word)
            if found is None:
                rest.append(k)
                continue
            head, tail = found.groups()
            if tail not in self.marks:
                if len(self.marks) > 100_000:
                    self.marks = {"": []}
                self.marks[tail] = [t.id for t in model(tail)]
            head = head.lower()
            out[k] = [t.id for t in model(head if head.isascii() else head.translate(self.written))] + self.marks[tail]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for k, e in zip(part, self.tok.encode_batch_fast([words[k] for k in part], add_special_tokens=False)):
                out[k] = e.ids
        return out
