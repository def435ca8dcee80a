"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries, all new words of a batch in one pass of an automaton (the
speculation). Such a cut is the merge result
exactly when every adjacent pair of its tokens is what merging that pair's own characters gives, so all pairs of all new
words of a batch are looked up together in one sorted array of known pairs (the verification, vectorised); a pair not seen
before is merged once and remembered. Only words with a failing pair go through exact merging, with a heap, so that a word
of a million characters costs n log n.

Edge cases: a null or empty text has no tokens and decodes to the empty text; a text of any length is encoded whole; equal
ranks (ties) merge from the left; repeated rows give repeated rows; an empty table gives an empty table; extra columns are
ignored, whatever their names. The strings of special tokens in a text become their ids, as the
tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditweave.llm.arrowio import id_text, map_texts

#: White space among the usual characters, as the vocabulary file's patterns mean it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Outside these characters normal form and lower case are left to the library: composition, dotted capital I and the like,
#: and the four separators that Python splits at and the patterns don't.
UNUSUAL = re.compile("[^\x00-\x1b -\u012f\u0131-\u024f]")
END = "</w>"
#: Stands for END in one letter that is no byte's.
LAST = "\ue000"
#: Runs between blanks, words, and pairs remembered by one Python worker; beyond, the oldest go, results stay the same.
MEMORY, PAIR_CACHE = 300_000, 1_000_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Memory:
    """A table of what was worked out, in two generations: what is asked for moves to the young one, which becomes the old one when it is full."""

    def __init__(self, most: int) -> None:
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.most = most

    def missing(self, keys: set[str]) -> set[str]:
        """Keys that are in neither generation; the others are in the young one afterwards."""
        if len(self.young) + len(keys) > self.most // 2:
            self.old, self.young = self.young, {}
        away = keys - self.young.keys()
        there = away & self.old.keys()
        self.young.update((k, self.old[k]) for k in there)
        return away - there


class SpeculativeBpe:
    """Encoder for a vocabulary file of kind BPE with word ends, byte letters and a split pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.size = max(self.names) + 1
        self.ranks = {self.vocab[x] * self.size + self.vocab[y]: r for r, (x, y) in enumerate(pairs)}
        self.joined = [self.vocab[x + y] for x, y in pairs]
        self.letters = byte_letters()
        self.inner, self.final = ([self.vocab[c + e] for c in self.letters] for e in ("", END))
        self.entries = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            word = t.removesuffix(END) + LAST * t.endswith(END)
            self.entries.add_word(word, (i, len(word)))
        self.entries.make_automaton()
        self.runs, self.words = Memory(MEMORY), Memory(MEMORY)
        self.alone: dict[int, bool] = {}
        self.good = self.bad = np.empty(0, np.int64)
        self.path, self._library = path, None
        self.merged_exactly = 0

    # --- words of a text

    def pieces(self, text: str) -> list[str]:
        """Lower-cased pieces of a text with unusual characters, specials excluded, by the library's normal form and split."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        text = self._library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.letters)}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    # --- speculation

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest vocabulary entries from the left, for all words in one pass: tokens, and the word that each belongs to.

        Tokens of a word that they don't cover belong to -1: the automaton leaves a gap where it has followed a longer entry in vain."""
        texts = ["".join([self.letters[c] for c in w]) + LAST for w in words]
        found = [(end, i, n) for end, (i, n) in self.entries.iter_long(" ".join(texts))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, ids, sizes = np.array(found, np.int64).T
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths + 1) - lengths - 1
        owner = np.searchsorted(starts, ends, "right") - 1
        covered = np.bincount(owner, sizes, len(texts)).astype(np.int64) == lengths
        return ids, np.where(covered[owner], owner, -1)

    # --- exact merging

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost among equals. Short words by a list of ranks, long ones by a heap."""
        if len(ids) > 64:
            return self.merge_long(ids)
        size, ranks, none = self.size, self.ranks, len(self.joined)
        ids = list(ids)
        own = [ranks.get(x * size + y, none) for x, y in zip(ids, ids[1:], strict=False)]
        while own and (r := min(own)) < none:
            i = own.index(r)
            ids[i] = self.joined[r]
            del ids[i + 1], own[i]
            if i < len(own):
                own[i] = ranks.get(ids[i] * size + ids[i + 1], none)
            if i:
                own[i - 1] = ranks.get(ids[i - 1] * size + ids[i], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, s, size = len(ids), list(ids), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := self.ranks.get(s[i] * size + s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = self.joined[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get(s[x] * size + s[y])) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [t for t in s if t >= 0]

    def symbols(self, word: bytes) -> list[int]:
        return [*(self.inner[c] for c in word[:-1]), self.final[word[-1]]]

    def spelled(self, token: int) -> list[int]:
        name = self.names[token]
        bare = name.removesuffix(END)
        s = [self.vocab[c] for c in bare]
        return [*s[:-1], self.vocab[bare[-1] + END]] if name != bare else s

    # --- verification

    def verdicts(self, keys: np.ndarray) -> np.ndarray:
        """For sorted distinct pair keys: whether the two tokens stay apart, as merging their characters shows."""
        known = lambda have: have[np.minimum(np.searchsorted(have, keys), len(have) - 1)] == keys if len(have) else np.zeros(len(keys), bool)
        good = known(self.good)
        new = keys[~good & ~known(self.bad)]
        if len(new):
            if len(self.good) + len(self.bad) > PAIR_CACHE:
                self.good = self.bad = np.empty(0, np.int64)
            ok = np.fromiter((self.merge(self.spelled(k // self.size) + self.spelled(k % self.size)) == [k // self.size, k % self.size] for k in new.tolist()), bool, len(new))
            self.good, self.bad = np.union1d(self.good, new[ok]), np.union1d(self.bad, new[~ok])
            good[np.searchsorted(keys, new)] = ok
        return good

    def stands(self, token: int) -> bool:
        """Whether merging the characters of a token gives the token."""
        if (fine := self.alone.get(token)) is None:
            fine = self.alone[token] = self.merge(self.spelled(token)) == [token]
        return fine

    def learn(self, words: set[str]) -> None:
        """Ids and names of words, each joined by spaces, into the memory."""
        new = list(self.words.missing(words))
        raw = [w.encode("utf-8", "surrogateescape") for w in new]
        ids, owner = self.greedy(raw)
        kept = owner >= 0
        ids, owner = ids[kept], owner[kept]
        count = np.bincount(owner, minlength=len(new))
        failed = count == 0
        inner = owner[:-1] == owner[1:]
        if inner.any():
            keys, at = np.unique(ids[:-1][inner] * self.size + ids[1:][inner], return_inverse=True)
            failed[owner[:-1][inner][~self.verdicts(keys)[at]]] = True
        begin, ids = np.cumsum(count) - count, ids.tolist()
        for w, r, no, i, n in zip(new, raw, failed.tolist(), begin.tolist(), count.tolist(), strict=True):
            if no or (n == 1 and not self.stands(ids[i])):
                self.merged_exactly += 1
                own = self.merge(self.symbols(r))
            else:
                own = ids[i : i + n]
            self.words.young[w] = " ".join(map(str, own)), " ".join([self.names[t] for t in own])

    def remember(self, runs: set[str]) -> None:
        """Fill the memory for runs between blanks, lower-cased; a run's pieces depend on nothing outside it."""
        pieces = {r: PIECES.findall(r) for r in self.runs.missing(runs)}
        self.learn(set().union(*pieces.values()))
        known = self.words.young
        for r, ws in pieces.items():
            self.runs.young[r] = known[ws[0]] if len(ws) == 1 else tuple(" ".join(x) for x in zip(*map(known.__getitem__, ws), strict=True))

    # --- texts

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, decimal ids joined by a space, decoded text."""
        cut: list[list[tuple[list[str], str]]] = []
        for t in texts:
            if self.at_special and "<" in t and self.at_special.search(t):
                parts = [(p, k % 2) for k, p in enumerate(self.at_special.split(t)) if p]
            else:
                parts = [(t, 0)]
            cut.append([([p], "special") if is_special else (self.pieces(p), "pieces") if UNUSUAL.search(p) else (p.lower().split(), "runs") for p, is_special in parts])
        self.remember(set().union(*(ws for parts in cut for ws, kind in parts if kind == "runs")))
        runs = self.runs.young
        odd = set().union(*(ws for parts in cut for ws, kind in parts if kind == "pieces"))
        self.learn(odd)
        odd = {w: self.words.young[w] for w in odd}
        out: list[tuple[int, str, str]] = []
        for parts in cut:
            got: list[tuple[str, str]] = []
            for ws, kind in parts:
                got += map(runs.__getitem__, ws) if kind == "runs" else [(str(self.special[w]), w) if kind == "special" else odd[w] for w in ws]
            ids, names = map(" ".join, zip(*got, strict=True)) if got else ("", "")
            out.append((ids.count(" ") + bool(ids), ids, names))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> SpeculativeBpe:
    """One for a Python worker: what it has learnt serves the worker's later tasks."""
    return SpeculativeBpe(path)


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """Per row: n_tokens, digest of the ids, digest of the decoded text; with keep_ids also ``ids`` (array), with keep_decoded ``decoded``."""

    def make():
        bpe = encoder(vocabulary_path(path))
        digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

        def work(texts):
            out = []
            for i in range(0, len(texts), 200):
                for n, ids, decoded in bpe.encode_batch(texts[i : i + 200]):
                    row = [n, digest(ids), digest(decoded)]
                    if keep_ids:
                        row.append(np.array(ids.split(), np.int32))
                    if keep_decoded:
                        row.append(decoded)
                    out.append(row)
            return list(zip(*out, strict=True))

        return work

    names, schema, types = ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()]
    if keep_ids:
        names, schema, types = [*names, "ids"], schema + ", ids array<int>", [*types, pa.list_(pa.int32())]
    if keep_decoded:
        names, schema, types = [*names, "decoded"], schema + ", decoded string", [*types, pa.string()]
    return map_texts(id_text(docs, id_col, text_col), make, schema, names, types)
