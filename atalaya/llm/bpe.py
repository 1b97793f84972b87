"""BPE encoding and decoding by a depth-first walk of the trie of distinct words.

The last token of a prefix's encoding settles the rest: what stands before it is the encoding of the shorter prefix. So
each trie node needs only its last token, found from the states of its ancestors, and prefixes that words share are
solved once. The distinct words of a batch are put into the trie in sorted order; the walk keeps one state per depth.
Words and chunks met before are taken from a bounded store, emptied as a task ends, which changes nothing but the time.

Defined results: a null text is empty and has no tokens; very long words are walked like others (time in proportion to
their length); repeated rows are encoded alike. Special tokens written out in a text are those tokens, as the library
has it; decoding writes token strings joined by one space, as the file names no decoder.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import batches, documents

#: Chunks and pairs of tokens kept within a task (about 150 and 30 MB).
KEEP_WORDS, KEEP_PAIRS = 300_000, 200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


class TrieEncoder:
    """Encodes words; built from a tokenizers file of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(merges)}
        #: How each token was made: (rank, left, right); single letters have rank -1.
        self.made = {v: (-1, v, v) for v in self.ids.values()}
        self.made |= {self.ids[a + b]: (k, self.ids[a], self.ids[b]) for k, (a, b) in enumerate(merges)}
        self.names = {v: k for k, v in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.longest = max(len(x.removesuffix(self.suffix)) or 1 for x in self.ids)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.splits = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Chunks hold no white space, so the pattern need not name it: other engines disagree on characters 28 to 31.
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.piece = regex.compile(pattern.replace(r"\s", ""))
        self.bytes = byte_letters()
        self.id_names = {v: str(v) for v in self.names}
        self.apart: dict[tuple[int, int], bool] = {}
        #: Of words and of chunks of text between white space: number of tokens, ids and token strings, each joined by a space.
        self.words: dict[str, tuple[int, str, str]] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    def forget(self) -> None:
        """Drop what was learned from texts."""
        for store in (self.apart, self.words, self.known):
            store.clear()

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether left + right, merged by rank from letters, ends as these two tokens."""
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > KEEP_PAIRS:
                self.apart.clear()
            found = self.apart[left, right] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        # Undo merges from the last back: at each time the two tokens at the border must not merge before one of them grows.
        until = len(self.rank)
        while True:
            if self.rank.get((left, right), until) < until:
                return False
            a, b = self.made[left], self.made[right]
            if a[0] < 0 and b[0] < 0:
                return True
            # On equal ranks the leftmost merge comes first, so the left one is undone after the right one.
            if a[0] > b[0]:
                until, left = a[0], a[2]
            else:
                until, right = b[0] + 1, b[1]

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The tokens of each distinct word, in trie order, sharing the states of common prefixes."""
        get, apart, letters, suffix = self.ids.get, self.apart, self.bytes.__getitem__, self.suffix
        named = sorted([(w if w.isascii() and w.isalpha() else "".join(map(letters, w.encode())), w) for w in words])
        path = ""  # letters from the root to the current node
        most = max([len(name) for name, _ in named], default=0) + 1
        tokens, sizes = [-1] * most, [0] * most  # by depth: the last token and its length

        def fits(token: int, before: int) -> bool:
            ok = apart.get((before, token))
            return self.stay_apart(before, token) if ok is None else ok

        def settle(name: str, n: int, end: str) -> None:
            # One length fits. Mostly the last token has grown by this letter, so that length is tried first.
            grown = sizes[n - 1] + 1
            for k in (grown, *range(1, grown), *range(grown + 1, min(n, self.longest) + 1)):
                token = get(name[n - k : n] + end)
                if token is not None and ((before := tokens[n - k]) < 0 or fits(token, before)):
                    tokens[n], sizes[n] = token, k
                    return
            raise ValueError(f"no token ends {name[:n]!r}")

        for name, word in named:
            at = len(name)
            same = min(at - 1, len(path))
            while name[:same] != path[:same]:
                same -= 1
            for n in range(same + 1, at):
                k = sizes[n - 1] + 1
                token = get(name[n - k : n])
                if token is not None and ((before := tokens[n - k]) < 0 or apart.get((before, token))):
                    tokens[n], sizes[n] = token, k
                else:
                    settle(name, n, "")
            path = name[: at - 1]
            settle(name, at, suffix)  # the leaf; no other word's path reaches its place
            out = []
            while at:
                out.append(tokens[at])
                at -= sizes[at]
            out.reverse()
            yield word, out

    def chunks(self, text: str) -> list[str]:
        """A text between white space; special tokens stand alone. Words never reach across white space."""
        if self.splits and "<" in text and (parts := self.splits.split(text))[1:]:
            return [x for p in parts for x in ([p] if p in self.special else self.chunks(p))]
        return text.split() if not _NOT_SPACE.search(text) else [x for x in _SPACES.split(text) if x]

    def learn(self, runs: Iterable[list[str]]) -> None:
        """Solve the chunks that the store lacks."""
        known, words, ids, names = self.known, self.words, self.id_names, self.names
        new = set(chain.from_iterable(runs))
        if len(known) + len(new) > KEEP_WORDS:  # what this batch holds again stays
            again = {x: known[x] for x in new if x in known}
            known.clear()
            words.clear()
            known.update(again)
        new.difference_update(known)
        pieces: dict[str, list[str]] = {}
        for x in new:
            if x.isascii():
                low = x.lower()
                pieces[x] = [low] if low.isalpha() else self.piece.findall(low)
            else:
                low = unicodedata.normalize("NFC", x)
                low = low.lower() if "Σ" not in low else "".join(map(str.lower, low))
                pieces[x] = self.piece.findall(low)
        for x in new & self.special.keys():
            del pieces[x]
            known[x] = 1, ids[self.special[x]], x
        for word, tokens in self.walk(set(chain.from_iterable(pieces.values())).difference(words)):
            words[word] = len(tokens), " ".join([ids[t] for t in tokens]), " ".join([names[t] for t in tokens])
        for x, own in pieces.items():
            if len(own) == 1:
                known[x] = words[own[0]]
            else:
                found = [words[w] for w in own]
                known[x] = sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])


_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")
_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; with texts also ids (array) and decoded (string).

    path: a tokenizer file that every executor has. The digests are those of the decimal ids joined by one space, and
    of the decoded text in UTF-8.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        gc.disable()  # the store has no cycles, and walking it again and again takes a third of the time
        try:
            for part, _, _ in batches(rows):
                yield encoded(enc, part)
        finally:
            enc.forget()
            gc.enable()

    def encoded(enc: TrieEncoder, part: pa.RecordBatch) -> pa.RecordBatch:
        runs = [enc.chunks(x or "") for x in part.column("text").to_pylist()]
        enc.learn(runs)
        out: list[tuple] = []
        for chunks in runs:
            found = list(map(enc.known.__getitem__, chunks))
            ids, decoded = " ".join([f[1] for f in found if f[0]]), " ".join([f[2] for f in found if f[0]])
            row = (sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            out.append((*row, [int(x) for x in ids.split()], decoded) if texts else row)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds)]  # noqa: B905
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return documents(docs).mapInArrow(run, schema)
