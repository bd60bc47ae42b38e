"""Reading of a public byte-level BPE vocabulary and the cutting of texts into its pre-tokens."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for letters from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """What counting and encoding need of a tokenizer file; under 3 MB."""

    pattern: str
    #: the file without its vocabulary, for the library to cut texts by
    cutting: str
    special: dict[str, int]
    #: ids of the bytes, plain and as the last of a word
    inner: np.ndarray
    last: np.ndarray
    #: merges by left id * size + right id: sorted keys with rank and new id
    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    size: int


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file with word ends, lower-casing and one splitting pattern."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, ids = spec["model"], spec["model"]["vocab"]
    normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or model["unk_token"] is not None:
        raise ValueError("only lower-casing byte-level BPE files without an unknown token can be read")
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    end = model["end_of_word_suffix"] or ""
    size = max(ids.values()) + 1
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    left, right, made = np.array(merges, dtype=np.int64).T
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    letters = byte_letters()
    return Vocabulary(
        pattern=split["pattern"]["Regex"],
        cutting=json.dumps({**spec, "added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}),
        special={t["content"]: t["id"] for t in spec["added_tokens"]},
        inner=np.array([ids[c] for c in letters]),
        last=np.array([ids[c + end] for c in letters]),
        keys=keys[order],
        rank=order.astype(np.int64),
        made=made[order],
        size=size,
    )


#: code points whose class is the same in every version of Unicode and which nothing is composed with:
#: Latin letters with their punctuation, general punctuation and the euro sign
SETTLED = [*range(0x180), *range(0x2000, 0x2065), 0x20AC]
WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}


def _settled(keep) -> str:
    return "".join(re.escape(chr(c)) for c in SETTLED if keep(c))


class Cutter:
    """Cuts a text into (special id or None, pre-tokens) parts as the tokenizer's library does.

    Texts of settled characters are cut by a plain pattern of them; texts with
    others by the library's own normalizer and pre-tokenizer.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.special = vocabulary.special
        classes = {
            r"\p{L}": _settled(lambda c: unicodedata.category(chr(c))[0] == "L"),
            r"\p{N}": _settled(lambda c: unicodedata.category(chr(c))[0] == "N"),
            r"\s": _settled(WHITE.__contains__),
        }
        pattern = vocabulary.pattern
        for name, letters in classes.items():
            pattern = pattern.replace(name, letters)
        self.find = re.compile(pattern).findall
        self.unsettled = re.compile(f"[^{_settled(lambda c: True)}]").search
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.cutting, self.library = vocabulary.cutting, None
        self.byte = {letter: b for b, letter in enumerate(byte_letters())}

    def _plain(self, text: str) -> list[str]:
        if not self.unsettled(text):
            return self.find(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.cutting)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, letters)).decode() for letters, _ in pieces]

    def cut(self, text: str) -> list[tuple[int | None, list[str]]]:
        if "<" not in text or not any(s in text for s in self.special):
            return [(None, self._plain(text))]
        return [(self.special[p], []) if p in self.special else (None, self._plain(p)) for p in self.split(text) if p]


def merged(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the tokens of pre-tokens, by rank-synchronous merging.

    All pre-tokens lie in one ragged array. In each round every sequence finds
    its pair of lowest rank and merges all places of it (from left to right
    where they overlap); sequences without a known pair are done.
    """
    data = [w.encode() for w in words]
    size = np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    symbol = v.inner[flat]
    ends = np.cumsum(size) - 1
    symbol[ends[size > 0]] = v.last[flat[ends[size > 0]]]
    owner = np.repeat(np.arange(len(words)), size)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.iinfo(np.int64).max
    while len(symbol):
        pair = symbol[:-1] * v.size + symbol[1:]
        at = np.minimum(np.searchsorted(v.keys, pair), len(v.keys) - 1)
        rank = np.where((v.keys[at] == pair) & (owner[:-1] == owner[1:]), v.rank[at], none)
        rank = np.append(rank, none)
        new = np.ones(len(owner), dtype=bool)
        new[1:] = owner[1:] != owner[:-1]
        head = np.flatnonzero(new)
        low = np.minimum.reduceat(rank, head)
        count = np.diff(np.append(head, len(owner)))
        low = np.repeat(low, count)
        live = low < none
        if not live.all():
            done.append((owner[~live], symbol[~live]))
        pick = live & (rank == low)
        # places that overlap their left neighbour: every second one of a run counts
        begin = pick.copy()
        begin[1:] &= ~pick[:-1]
        index = np.arange(len(pick))
        run = np.maximum.accumulate(np.where(begin, index, 0))
        pick &= (index - run) % 2 == 0
        where = np.flatnonzero(pick)
        symbol[where] = v.made[at[where]]
        gone = ~live
        gone[where + 1] = True
        symbol, owner = symbol[~gone], owner[~gone]
    if not done:
        return np.zeros(0, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
    owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owner, kind="stable")
    return symbol[order], np.searchsorted(owner[order], np.arange(len(words) + 1))
