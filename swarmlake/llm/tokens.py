"""Encoding whole texts with a byte-level BPE file of the tokenizers library.

Special tokens in a text stand for themselves, as the library has it: they cut the
text, and what lies between is encoded by itself. Files that split otherwise than
by the byte-level pattern, or normalize, are refused.

A text is cut where a space or newline follows a character that is no white
space, and where a sign follows a letter. The vocabulary's split pattern always
ends a match there, whatever stands around it, so the ids of the parts, joined,
are the ids of the text. Words return, so each worker keeps the ids of parts it has met and hands only
new ones to the library. Where their number reaches a limit, those of the texts at hand stay.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import ragged

#: White space before a space or newline, or the mark itself: such texts are cut by the general rule.
_MARK = "\x01"
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|\x01"
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_SIGN = r"(\pL)([^\s\pL\pN'])"


def _special(settings: dict) -> dict[str, int]:
    """The added tokens of a tokenizer file, where its texts are split as assumed here."""
    splits, added = settings.get("pre_tokenizer") or {}, settings.get("added_tokens") or []
    plain = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space", True)
    if not plain or settings.get("normalizer") or any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("the tokenizer file is not one of plain byte-level BPE")
    return {t["content"]: t["id"] for t in added}


class PartEncoder:
    """Ids of texts; ``limit`` bounds the parts remembered, not the parts encoded."""

    def __init__(self, path: str, limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = _special(json.load(file))
        size = self.library.get_vocab_size()
        self.token_bytes = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        # A key that starts with the mark stands for the rest of it, one that starts with a
        # newline for itself, any other key for a space and itself.
        self.keys = pa.array([], pa.string())  # a part's slot is its place here
        self.ids = np.empty(1 << 20, dtype=np.uint16 if len(self.token_bytes) <= 1 << 16 else np.uint32)
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    @staticmethod
    def _text(key: str) -> str:
        return key[1:] if key[:1] == _MARK else key if key[:1] == "\n" else " " + key

    def _store(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.keys), len(keys)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + m + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[n + 1 : n + m + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.keys = pa.concat_arrays([self.keys, keys])

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.first[slots + 1] - self.first[slots]
        return self.ids[ragged(self.first[slots], sizes)], sizes

    def _learn(self, keys: list[str]) -> np.ndarray:
        """Slots of new parts, encoded: those with white space first and none last go in strings of many, the others alone."""
        own = [bool(k) and k[0] != _MARK and not k[-1].isspace() for k in keys]
        order = np.argsort(~np.array(own, dtype=bool), kind="stable")
        chained, alone = [k for k, o in zip(keys, own) if o], [k for k, o in zip(keys, own) if not o]
        slots = np.empty(len(keys), dtype=np.int64)
        slots[order] = len(self.keys) + np.arange(len(keys))
        all_ids, all_sizes = [], []
        for i in range(0, len(chained), 2000):
            texts = [self._text(k) for k in chained[i : i + 2000]]
            ids = np.array(self.library.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.cumsum(pc.binary_length(pa.array(texts, pa.string())).to_numpy())
            stops = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
            all_ids.append(ids)
            all_sizes.append(np.diff(stops, prepend=0))
        for i in range(0, len(alone), 2000):
            found = [e.ids for e in self.library.encode_batch_fast([self._text(k) for k in alone[i : i + 2000]], add_special_tokens=False)]
            all_ids.append(np.array([x for f in found for x in f], dtype=np.int64))
            all_sizes.append(np.array([len(f) for f in found]))
        self._store(pa.array(chained + alone, pa.string()), np.concatenate(all_ids), np.concatenate(all_sizes))
        return slots

    def _slots(self, keys: pa.Array) -> np.ndarray:
        """Slots of different parts; they hold until the next call."""
        slots = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = slots < 0
        if new.any():
            fresh = keys.filter(pa.array(new)).to_pylist()
            if len(self.keys) + len(fresh) > self.limit:
                kept, (ids, sizes) = keys.filter(pa.array(~new)), self._gather(slots[~new])
                self._forget()
                self._store(kept, ids, sizes)
                slots[~new] = np.arange(len(kept))
            slots[new] = self._learn(fresh)
        return slots

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), _SIGN, rf"\1 {_MARK}\2")
        lists = pc.split_pattern(marked, " ")
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = flat.dictionary_encode()
        firsts = pc.binary_join_element_wise(_MARK, flat.take(pa.array(at[:-1])), "").dictionary_encode()
        known = self._slots(pa.concat_arrays([coded.dictionary, firsts.dictionary]))
        slots = known[coded.indices.to_numpy()]
        slots[at[:-1]] = known[len(coded.dictionary) + firsts.indices.to_numpy()]
        ids, sizes = self._gather(slots)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[at])

    def _general(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [[_MARK + p for p in _CUT.split(t)] for t in texts]
        keys = pa.array([k for p in parts for k in p], pa.string()).dictionary_encode()
        ids, sizes = self._gather(self._slots(keys.dictionary)[keys.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(p) for p in parts])])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and how many each text has; a null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.special:
            marked = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            held = pc.match_substring_regex(texts, marked.pattern)
            if pc.any(held).as_py():
                return self._with_special(texts, held, marked)
        return self._plain(texts)

    def _with_special(self, texts: pa.Array, held: pa.Array, marked: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """Texts of which some hold special tokens, as pieces: every other piece of those is such a token."""
        pieces = [marked.split(t) if h else [t] for t, h in zip(texts.to_pylist(), held.to_pylist())]
        flat = [p if p not in self.special else "" for some in pieces for p in some]
        ids, counts = self._plain(pa.array(flat, pa.string()))
        ends = np.cumsum(counts)
        at = [k for k, p in enumerate(p for some in pieces for p in some) if p in self.special]
        ids = np.insert(ids.astype(np.int64), ends[at], [self.special[p] for some in pieces for p in some if p in self.special])
        counts[at] += 1
        own = np.cumsum([0, *map(len, pieces)])
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[own])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without special tokens."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._simple(texts)
        parts = [self._simple(texts.filter(pa.array(~odd))), self._general(texts.filter(pa.array(odd)).to_pylist())]
        order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
        counts = np.concatenate([p[1] for p in parts])
        starts = np.cumsum(counts) - counts
        ids = np.concatenate([p[0] for p in parts])[ragged(starts[order], counts[order])]
        return ids, counts[order]


_ENCODERS: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """This worker's encoder for a file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]
