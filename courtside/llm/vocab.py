"""Tables of a public BPE vocabulary file, read on the driver and broadcast (a few MB, whatever the corpus)."""

from __future__ import annotations

import json
from dataclasses import dataclass


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocab:
    """tokens: id by spelling, in letters. merges: (left id, right id, merged id) by rank. special: id by text."""

    tokens: dict[str, int]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]
    word_end: str
    pattern: str | None


def load_vocab(path: str) -> Vocab:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    tokens = model["vocab"]
    merges = [(tokens[a], tokens[b], tokens[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    steps = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    return Vocab(tokens, merges, special, model.get("end_of_word_suffix") or "", pattern)
