"""BPE encoding and decoding with a public vocabulary; each word is merged with a segment tree over its pair ranks.

The leaves hold the rank of each pair of neighbouring symbols, with its place, so the root gives the leftmost pair
of the lowest rank. A merge changes three leaves and their ancestors; it goes on until no pair has a rank. A node has
16 children, whose least is taken at once, so words of usual length have one node above their leaves.

The text is prepared as the vocabulary file states: special tokens are cut out first; then NFC, white space to
spaces, lower case per character, words by the file's pattern, and bytes as printable characters. All of this is
local to a run of non-space characters, so runs and words are encoded once per task and remembered, up to a fixed
number of each; whatever the corpus, memory stays bounded.

Defined cases: a null text counts as empty: no tokens, decoded to the empty text. Repeated rows are encoded each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = 1 << 62
#: Children of a node of the segment tree: the least of so many costs little more than the least of two.
FAN = 16
#: Number of tokens, ids as text, decoded text, ids. Nothing in it can change, so the garbage collector lets it be.
Found = tuple[int, str, str, tuple[int, ...]]
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge a word's symbol numbers: again and again the leftmost pair of the lowest rank.

    ``ranks`` has the rank of a pair under first << 20 | second, ``merged`` the symbol that each rank makes.
    ``levels`` is the segment tree, leaves first: leaf i holds rank * n + i for the pair that begins at symbol i, and a
    node is the least of its FAN children. A word of at most FAN pairs has its root right above the leaves.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    rank = ranks.get
    if n <= FAN + 1:
        return merge_short(symbols, rank, merged)
    leaves = [NONE] * (n - 1)
    for i in range(n - 1):
        if (r := rank(symbols[i] << 20 | symbols[i + 1])) is not None:
            leaves[i] = r * n + i
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, tall = levels[-1], len(levels) > 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := min(top)) != NONE:
        r, i = divmod(root, n)
        symbols[i] = made = merged[r]
        j = after[i]
        symbols[j] = -1
        after[i] = k = after[j]
        leaves[i] = NONE
        touched = i
        if k < n:
            before[k] = i
            leaves[j] = NONE
            touched = j
            if (r := rank(made << 20 | symbols[k])) is not None:
                leaves[i] = r * n + i
        p = before[i]
        if p >= 0:
            r = rank(symbols[p] << 20 | made)
            leaves[p] = NONE if r is None else r * n + p
        else:
            p = i
        if tall:
            # the changed leaves are p, i and touched: renew their ancestors level by level
            changed = {p, i, touched}
            for below, above in itertools.pairwise(levels):
                changed = {x // FAN for x in changed}
                for x in changed:
                    above[x] = min(below[x * FAN : x * FAN + FAN])
    return [s for s in symbols if s >= 0]


def merge_short(symbols: list[int], rank: Callable[[int, int], int], merged: list[int]) -> list[int]:
    """The tree of one node: the root is the least of all leaves, and a merge takes a symbol and a leaf out of the lists.

    A leaf is a rank alone, for its place in the list is that of its pair. A symbol that is in no pair stands at the end,
    which is also the place before the first, so that the first and the last symbol need no case of their own.
    """
    symbols.append(-1)
    leaves = [rank(a << 20 | b, NONE) for a, b in itertools.pairwise(symbols)]
    while (r := min(leaves)) != NONE:
        i = leaves.index(r)
        symbols[i] = made = merged[r]
        del symbols[i + 1], leaves[i]
        leaves[i] = rank(made << 20 | symbols[i + 1], NONE)
        leaves[i - 1] = rank(symbols[i - 1] << 20 | made, NONE)
    symbols.pop()
    return symbols


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes and decodes texts as the vocabulary file says."""

    def __init__(self, file: dict, memory_runs: int = 150_000, memory_words: int = 300_000):
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbol = self.vocab.get
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.ranks = {symbol(a) << 20 | symbol(b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.numbers = {i: str(i) for i in self.tokens}
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE)).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.runs = regex.compile(f"[^{SPACE}]+").findall
        characters = byte_characters()
        self.inner = [self.vocab.get(c) for c in characters]
        self.last = [self.vocab.get(c + self.suffix) for c in characters]
        self.memory, self.words_done = {}, {}
        self.memory_runs, self.memory_words = memory_runs, memory_words

    def encode_word(self, word: str) -> Found:
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        ids = merge_word(symbols, self.ranks, self.merged)
        found = len(ids), " ".join([self.numbers[i] for i in ids]), self.decode(ids), tuple(ids)
        if len(word) <= 64:
            if len(self.words_done) >= self.memory_words:
                self.words_done.clear()
            self.words_done[word] = found
        return found

    def encode_run(self, run: str) -> Found | None:
        """A run of non-space characters; None if the pattern keeps nothing of it."""
        if run.isascii():
            text = run.lower()
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", run)])
        done = self.words_done.get
        if (found := done(text)) is None:
            parts = [done(word) or self.encode_word(word) for word in self.words(text)]
            if len(parts) == 1:
                found = parts[0]
            elif parts:
                found = sum(x[0] for x in parts), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts]), tuple([i for x in parts for i in x[3]])
        if found and len(run) <= 64:
            if len(self.memory) >= self.memory_runs:
                self.memory.clear()
            self.memory[run] = found
        return found

    def encode(self, text: str) -> list[Found]:
        """What the runs of a text, and the special tokens between them, give."""
        out: list[Found] = []
        known = self.memory.get
        for k, piece in enumerate(self.cut(text) if self.cut and "<" in text else [text]):
            if k % 2:
                i = self.special[piece]
                out.append((1, str(i), piece, (i,)))
                continue
            # str.split also cuts at four separator characters that the pattern keeps
            plain = not any(c in piece for c in "\x1c\x1d\x1e\x1f")
            runs = piece.split() if plain else self.runs(piece)
            out += [found for run in runs if (found := known(run) or self.encode_run(run))]
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space."""
        return " ".join([self.tokens[i] for i in ids])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(documents: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids themselves.

    ``vocabulary`` is a JSON file on the driver; its content (a fixed few MB) is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json.loads(shared.value))
        for batch in batches:
            for first in range(0, len(batch), 64):
                part = batch.slice(first, 64)
                counts, ids, decoded, lists = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = encoder.encode(text) if text else []
                    counts.append(sum(x[0] for x in found))
                    ids.append(digest(" ".join(x[1] for x in found)))
                    decoded.append(digest(" ".join(x[2] for x in found)))
                    if with_ids:
                        lists.append([i for x in found for i in x[3]])
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)
