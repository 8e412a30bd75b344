"""Byte-pair merging on ragged numpy arrays, rank by rank in step over all sequences."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def check_kind(path: str, normalizer: dict | None, pre_tokenizer: dict) -> None:
    """Refuses a vocabulary file whose text rules are not those that are built in, as its counts would be wrong."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, tokens = spec["model"], spec["added_tokens"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    bare = not any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model.get("type") != "BPE" or not plain or not bare or spec.get("normalizer") != normalizer or spec.get("pre_tokenizer") != pre_tokenizer:
        raise ValueError(f"{path}: a vocabulary of another kind, whose rules are not built in")


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file.

    byte_ids: the id of each byte as a symbol; end_ids: the id of each byte as the last symbol of a word, where the
    vocabulary has a word-end suffix.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, letters = model["vocab"], byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        self.vocab = vocab
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.end_ids = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.suffix = suffix
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        at = {c: b for b, c in enumerate(letters)}
        #: inside[a, b]: whether bytes a, b stand together inside any token.
        self.inside = np.zeros((256, 256), bool)
        for t in vocab:
            t = t[: len(t) - len(suffix)] if suffix and t.endswith(suffix) else t
            codes = [at[c] for c in t if c in at]
            self.inside[codes[:-1], codes[1:]] = True

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive and how many in each sequence. symbols: all sequences, one after another.

        In each step every live sequence applies its own lowest-rank pair wherever it stands (from the left, without
        overlap); sequences without a pair leave the arrays. rank[i] is that of the pair at i and i + 1; a step looks up
        only the pairs beside what it merged.
        """
        count = len(lengths)
        out_symbols, out_owner = [], []
        owner = np.repeat(np.arange(count), lengths)
        rank = np.full(len(symbols), NONE, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            low = np.minimum.reduceat(rank, starts)
            done = np.repeat(low == NONE, sizes)
            if done.any():
                out_symbols.append(symbols[done])
                out_owner.append(owner[done])
                keep = ~done
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                low, sizes = low[low != NONE], sizes[low != NONE]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == np.repeat(low, sizes))
            run = np.r_[True, np.diff(places) != 1]
            first = places[run][np.cumsum(run) - 1]
            places = places[(places - first) % 2 == 0]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols[places] = self.made[rank[places]]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            places = places - np.arange(len(places))
            rank[places] = NONE
            near = np.concatenate((places, places - 1))
            near = near[(near >= 0) & (near < len(symbols) - 1)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self._rank(symbols[near], symbols[near + 1])
        if not out_owner:
            return np.zeros(0, np.int32), np.zeros(count, np.int64)
        symbols, owner = np.concatenate(out_symbols), np.concatenate(out_owner)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=count)


@lru_cache(4)
def merges(path: str) -> Merges:
    """One copy in each Python worker."""
    return Merges(path)
