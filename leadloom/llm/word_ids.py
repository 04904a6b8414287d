"""Token ids of whole texts from a lower-casing word tokenizer, through caches of pieces between blanks.

The tokenizer drops white space and never joins what white space separates, so a text's ids are the ids of its pieces
between blanks, one after the other. Each worker keeps the ids of pieces it has met, within a bound.
"""

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np

#: ASCII punctuation that may follow a word without being part of it; the apostrophe starts contractions and stays out.
PUNCTUATION = ".,;:!?$%&*#)(|\"-"
#: Pieces that a worker keeps, and characters up to which it keeps them, so that texts without blanks do not fill the memory.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
#: Characters of the texts whose new pieces are looked up together.
GROUP_CHARS = 1 << 18


def letters(stem: str) -> bool:
    """Whether a word is letters alone to the tokenizer too, after its normalizer: composing and lower-casing may give combining marks, which it joins with punctuation."""
    return stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha())


class WordIds:
    """Ids of texts as little-endian bytes, `width` bytes for each id."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.entries = entries
        self.splits = splits_at_blanks(json.loads(self.tokenizer.to_str()))
        self.id_bytes = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}

    def fresh(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        """Give new pieces entries. A word and the punctuation after it are apart for the tokenizer, so they are looked up apart."""
        if len(self.stems) > self.entries:
            self.stems.clear()
        parts = {}
        for piece in pieces:
            stem = piece.rstrip(PUNCTUATION)
            if len(stem) == len(piece) or not letters(stem):
                parts[piece] = (piece.lower() if piece.isascii() and piece.isalpha() else piece,)
            else:
                parts[piece] = (stem.lower() if stem.isascii() else stem, piece[len(stem):])
        stems, tokenize, id_bytes = self.stems, self.tokenizer.model.tokenize, self.id_bytes
        new = set().union(*parts.values()).difference(stems)
        plain = [p for p in new if p.isascii() and p.isalpha()]  # already what the model is given: one lower-case word
        stems.update((p, b"".join([id_bytes[t.id] for t in tokenize(p)])) for p in plain)
        rest = list(new.difference(plain))
        stems.update(zip(rest, self.fresh(rest)))
        self.pieces.update((piece, stems[both[0]] if len(both) == 1 else stems[both[0]] + stems[both[1]]) for piece, both in parts.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text has no ids."""
        if not self.splits:
            return self.fresh([t or "" for t in texts])
        found = []
        for group in groups([t or "" for t in texts]):
            words = [t.replace("\n", " ").split(" ") for t in group]
            if len(self.pieces) > self.entries:
                self.pieces = {"": b""}
            new = set().union(*words).difference(self.pieces)
            long = [w for w in new if len(w) > CACHE_CHARS]
            self.learn(new.difference(long))
            self.pieces.update((w, self.fresh([w])[0]) for w in long)
            found.extend([b"".join(map(self.pieces.__getitem__, w)) for w in words])
            for w in long:
                del self.pieces[w]
        return found


def groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in stretches that end once they hold GROUP_CHARS characters."""
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def splits_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer's description shows that blanks separate and vanish, and that no special token holds or takes one."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return bool(drops and plain and kinds == ["NFC", "Replace", "Lowercase"] and not spec.get("post_processor"))


_held: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, entries: int = CACHE_ENTRIES) -> WordIds:
    """The one encoder that a Python worker keeps for a tokenizer file and a bound on its pieces."""
    if (path, entries) not in _held:
        _held[path, entries] = WordIds(path, entries)
    return _held[path, entries]
