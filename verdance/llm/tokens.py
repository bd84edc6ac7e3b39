"""Token counts and token ids of whole texts.

``PrefixCounter`` holds the exact number of tokens of every prefix. The byte-pair merges of a piece of text end in the
one token list in which each token is a whole vocabulary entry and each two neighbours stay apart when merged on their
own. So the list of a prefix is the list of a shorter prefix plus one last token: going through the prefixes, the last
token is the one whose neighbour, the last token of the shorter prefix, it stays apart from. The counts of all prefixes
of a piece thus cost one pass over it. Pieces come from the tokenizer's own splitting pattern, and recur, so their
tables are kept; a text's prefixes are its pieces' tables behind a running sum.

``WordIds`` gives the ids of the word tokenizer. White space only separates there, so the ids of a text are those of
its space-separated words in order; words seen for the first time are handed to the library together.

Both keep the results of words in a worker, the first it meets, among them all common ones, up to a bound in bytes
(``KEEP``, of which word ids take ``IDS``). Other words, and words of more than ``LONG`` bytes, are worked out each time;
the ids of a long piece come from the library, whose merges are not quadratic in its length. It is loaded when a text
needs it, as its own vocabulary takes memory too.

Rows that share a doc_id, or have none, are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes that a worker's table of words takes, with what a dictionary entry needs besides its text.
KEEP, ENTRY = 192 << 20, 200
#: Share of it for ids: they are cheap to make again, and a worker that packs has done other work before.
IDS = 0.5
#: Bytes of a piece that is kept, and that is merged together with others.
LONG = 256

#: The pattern of the byte-level tokenizer; a fixed value of its file format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same of the word tokenizer, for lower-case text.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: (token, rank that made it, rank that merges it on).
_Edge = tuple[bytes, int, int]
_NEVER = 1 << 60


class PrefixCounter:
    """Exact token counts of every prefix, for a byte-level merge vocabulary in a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.longest = max(map(len, self.ids))
        names = (m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {
            (bytes(letters[c] for c in a), bytes(letters[c] for c in b)): k for k, (a, b) in enumerate(names)
        }
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = set(special)
        self.apart_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pattern = regex.compile(SPLIT)
        self.space = regex.compile(r"\s+")
        self.tables: dict[str, tuple[int, ...]] = {}
        self.edges: dict[bytes, tuple[list[_Edge], list[_Edge]] | None] = {}
        self.stay: dict[tuple[bytes, bytes], bool] = {}
        self.held = 0
        self.words = _Counts(self)

    def room(self, size: int) -> bool:
        """Whether an entry of so many bytes still fits; it then counts as held."""
        if size > 16 * LONG or self.held > KEEP:
            return False
        self.held += size + ENTRY
        return True

    def merged(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """The tokens of a piece by its merges, lowest rank first, until there are ``down_to``."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > down_to:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), _NEVER))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def edge(self, token: bytes) -> tuple[list[_Edge], list[_Edge]] | None:
        """What stands at the token's left and right edge while it is merged; null if its bytes merge to more tokens."""
        if token not in self.edges:
            found = None
            if len(self.merged(token)) == 1:
                left, right = [], []
                for side, out in ((0, left), (1, right)):
                    part, until = token, _NEVER
                    while part:
                        halves = self.merged(part, 2) if len(part) > 1 else []
                        made = self.rank[tuple(halves)] if halves else -1
                        out.append((part, made, until))
                        part, until = (halves[side], made) if halves else (b"", 0)
                found = left, right
            self.edges[token] = found
        return self.edges[token]

    def stays(self, a: bytes, b: bytes) -> bool:
        """Whether the bytes of two tokens merge to just these two.

        They don't if what is at a's right edge and what is at b's left edge at some time have a merge that comes
        before either is merged into its own token; of equal merges the left one comes first.
        """
        got = self.stay.get((a, b))
        if got is None:
            got = True
            for x, x_made, x_until in self.edge(a)[1]:
                for y, y_made, y_until in self.edge(b)[0]:
                    together = self.rank.get((x, y))
                    if together is not None:
                        when = max(together, x_made, y_made)
                        if when < x_until and when <= y_until:
                            got = False
            if self.room(0):
                self.stay[a, b] = got
        return got

    def prefixes(self, piece: str) -> tuple[int, ...]:
        """Token counts of the piece's prefixes of 1, 2, ... bytes."""
        data = piece.encode()
        last: list[bytes] = [b""]
        counts = [0]
        ids, stay = self.ids, self.stay
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = data[start:end]
                if token not in ids:
                    continue
                if start:
                    before = last[start]
                    fits = stay.get((before, token))
                    if fits is None:
                        fits = self.edge(token) is not None and self.stays(before, token)
                else:
                    fits = self.edge(token) is not None
                if fits:
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
        return tuple(counts[1:])

    def table(self, piece: str) -> tuple[int, ...]:
        got = self.tables.get(piece)
        if got is None:
            got = self.prefixes(piece)
            if self.room(9 * len(got)):
                self.tables[piece] = got
        return got

    def _parts(self, text: str) -> Iterator[str]:
        return iter(self.apart_special.split(text) if self.apart_special else [text])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the text's prefixes of 1, 2, ... bytes, as if each had been encoded on its own.

        A prefix holds the pieces before and a part of one piece, which that piece's table counts. Where a cut changes
        the split there are three cases: an unfinished special string is ordinary text, an unfinished contraction is
        an apostrophe and letters, and white space at the end is one piece up to the cut. (A cut inside a character
        counts its bytes.)
        """
        out, base, plain = [], 0, ""
        for part in self._parts(text):
            if part not in self.special:
                plain = part
                continue
            size = len(plain.encode())
            own = self._plain_prefixes(plain + part[:-1])
            done = (int(own[size - 1]) if size else 0) + 1
            out.append(base + np.append(own, done))
            base, plain = base + done, ""
        out.append(base + self._plain_prefixes(plain))
        return np.concatenate(out)

    def _plain_prefixes(self, part: str) -> np.ndarray:
        out, base, run, run_base = [], 0, "", 0
        for piece in self.pattern.findall(part):
            own = np.array(self.table(piece), np.int64) + base
            if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                own[1] = base + self.table("'")[-1] + self.table(piece[1])[-1]
            if self.space.match(piece):
                if not run:
                    run_base = base
                head = piece if self.space.fullmatch(piece) else piece[0]
                run += head
                n = len(head.encode())
                own[:n] = run_base + np.array(self.table(run), np.int64)[-n:]
                base = base + self.table(piece)[-1]
                if head != piece:
                    run = ""
            else:
                base, run = int(own[-1]), ""
            out.append(own)
        counts = np.concatenate(out) if out else np.zeros(0, np.int64)
        return counts

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of its pieces' tables, by space-separated words."""
        total = 0
        for part in self._parts(text):
            if part in self.special:
                total += 1
                continue
            try:
                total += self._lines(part)
            except ValueError:
                total += sum(self.table(p)[-1] for p in self.pattern.findall(part))
        return total

    def _lines(self, part: str) -> int:
        if not part:
            return 0
        lines, table = part.split("\n"), self.words
        return len(lines) - 1 + sum(
            table.first(head) + sum(map(table.__getitem__, rest)) for head, *rest in (x.split(" ") for x in lines)
        )


class _Counts(dict):
    """Token counts of a word behind one space. A word with other white space at an edge has none: the split of the
    text then differs from that of its words, and the text is split as a whole."""

    def __init__(self, counter: PrefixCounter) -> None:
        super().__init__()
        self.counter, self.heads = counter, {}

    def _new(self, word: str, lead: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError(word)
        c = self.counter
        return sum(c.table(p)[-1] for p in c.pattern.findall(lead + word))

    def __missing__(self, word: str) -> int:
        got = self._new(word, " ")
        if self.counter.room(len(word)):
            self[word] = got
        return got

    def first(self, word: str) -> int:
        got = self.heads.get(word)
        if got is None:
            got = self._new(word, "")
            if self.counter.room(len(word)):
                self.heads[word] = got
        return got


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, and with ``prefixes`` the counts of all byte prefixes; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            columns = [batch.column("doc_id"), pa.array([own.count(t) for t in texts], pa.int64())]
            if prefixes:
                columns.append(pa.array([own.prefix_counts(t) for t in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([columns[0], batch.column("n_bytes"), *columns[1:]], names=names)

    names = ["doc_id", "n_bytes", "n_tokens", *["prefix_tokens"] * prefixes]
    schema = "doc_id long, n_bytes long, n_tokens long" + ", prefix_tokens array<long>" * prefixes
    text = F.col("text").cast("string")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long"), n_bytes, text.alias("text")).mapInArrow(run, schema)


class PieceMerges:
    """Byte-pair merges of many pieces at a time: in each round every piece makes its next merge."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = {b: c for c, b in _byte_letters().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each piece's ids begin (with the end of the last)."""
        data = [p.encode() for p in pieces]
        sizes = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        token = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        token[ends] = self.last[raw[ends]]
        none = len(self.ranks)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            key = token[:-1] << 32 | token[1:]
            found = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(token), none, np.int64)
            rank[:-1] = np.where((self.keys[found] == key) & (piece[:-1] == piece[1:]), self.ranks[found], none)
            first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            best = np.minimum.reduceat(rank * len(token) + np.arange(len(token)), first)
            at, stuck = best % len(token), best // len(token) == none
            size = np.diff(np.append(first, len(token)))
            over = np.repeat(stuck, size)
            done.append((piece[over], token[over]))
            at = at[~stuck]
            token[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            piece, token = piece[keep], token[keep]
        owner = np.concatenate([p for p, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([t for _, t in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(pieces) + 1))


class WordIds:
    """Ids of the word tokenizer as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0
        self.merges = PieceMerges(path)
        self.pattern = regex.compile(WORD_SPLIT)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    @cached_property
    def tokenizer(self) -> Tokenizer:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bool:
        """Whether the text can be taken word by word: nothing in it spans a space or changes by its surroundings."""
        return unicodedata.is_normalized("NFC", text) and not any(s in text for s in self.special)

    def learned(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words: those of their pieces, which are merged together."""
        find = self.pattern.findall
        split = {w: find(w.replace("\u03a3", "\u03c3").lower()) for w in words}  # the library has no final sigma
        every = set().union(*split.values())
        pieces = [p for p in every if len(p) <= LONG]
        ids, at = self.merges(pieces)
        data, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
        own = {p: data[at[k] : at[k + 1]] for k, p in enumerate(pieces)}
        own |= {p: self.by_library(p) for p in every if len(p) > LONG}
        return {w: own[p[0]] if len(p) == 1 else b"".join([own[x] for x in p]) for w, p in split.items()}

    def by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") if self.plain(t) else None for t in texts]
        known = self.known
        fresh = self.learned(set().union(*filter(None, split)).difference(known))
        known.update(fresh)
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.by_library(text))
            else:
                out.append(b"".join(map(known.__getitem__, words)))
        for word, ids in fresh.items():
            size = ENTRY + len(word) + len(ids)
            if self.held + size > IDS * KEEP or size > ENTRY + 16 * LONG:
                del known[word]
            else:
                self.held += size
        return out


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
