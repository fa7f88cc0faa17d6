"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It starts with one state
on which every byte loops. Each merge (a, b) then places one gadget: wherever an ``a`` arc leads to a state with a
``b`` arc, an arc of the new token bypasses both, and the state behind ``a`` is split into a copy without that ``b``
arc, so that ``a`` and ``b`` can no longer follow each other. A state is kept as its difference from the one it
was split from, and an arc of a merged token as the arc of its left half, so a merge costs one row of each.

A text is split into words first; every prefix of a word has exactly one accepted token sequence, so encoding walks
the word once, byte by byte, along tables: the trie of arc labels gives the arcs that match, the automaton says
which of them leave the present state. Words already seen are looked up. Decoding emits the labels of the arcs.

The vocabulary is a parameter: it is read on the driver and sent to the tasks as plain tables (its size does not
depend on the data). Strings of added tokens in a text become those tokens.

Defined results: a null text is an empty one and has no tokens; repeated rows are encoded alike; a long text or word
takes time in proportion to its length; an empty table gives an empty result; columns that are not named are not looked
at, and named ones may have any name but those of the result. Ids without a token and bytes that are no UTF-8
decode to the replacement character.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Fixed value: the pattern that splits text into words before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that are younger than the Unicode version that the vocabulary's split knows; there
#: they are neither.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
FIRST_NEWER = chr(NEWER[0][0])
#: Bounds of what one worker remembers: words and their ids, and arcs of states.
WORD_CACHE, CACHED_WORD, ARC_CACHE = 400_000, 64, 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Ids, merges in their order and added tokens of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = byte_letters()
    label = lambda token: bytes(letters[c] for c in token)
    ids = {label(t): i for t, i in file["model"]["vocab"].items()}
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
    return {
        "ids": ids,
        "merges": [(ids[label(a)], ids[label(b)], ids[label(a + b)]) for a, b in pairs],
        "added": {t["content"]: t["id"] for t in file["added_tokens"]},
    }


class Automaton:
    """States and arcs after all merge gadgets. ``behind[token]`` is the state its arcs lead to."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[int, int, int]]):
        size = max(ids.values()) + 1
        self.left = np.full(size, -1)  # the arc a merged token's arc was made along
        self.made = np.full(size, -1)  # and the merge that made it, 0 for a byte; a token that no merge made has no arcs
        self.made[[i for w, i in ids.items() if len(w) == 1]] = 0
        self.behind = np.zeros(size, np.int64)
        self.base, self.cut, self.when = [-1], [-1], [0]
        self.arcs: dict[int, bool] = {}
        self.cuts: dict[int, dict[int, int]] = {}
        for when, (a, b, ab) in enumerate(merges, 1):
            self.gadget(a, b, ab, when)
        self.label = {i: w for w, i in ids.items()}
        self.trie, self.ends = {}, [-1]
        for word, i in ids.items():
            if self.made[i] >= 0:
                self.insert(word, i)
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered of single arcs; all of it can be found again."""
        self.arcs, self.cuts = {}, {}

    @classmethod
    def of(cls, tables: dict) -> Automaton:
        """The automaton whose plain tables (its ``vars``) were sent."""
        out = cls.__new__(cls)
        vars(out).update(tables)
        out.forget()
        return out

    def gadget(self, a: int, b: int, ab: int, when: int) -> None:
        """Bypass ``a b`` by ``ab``, which leads where ``b`` led, and split the state behind ``a``. Where ``b`` cannot
        follow ``a``, because earlier merges never leave the two side by side, there is nothing to bypass."""
        if self.made[a] < 0 or self.made[b] < 0 or not self.has_arc(int(self.behind[a]), b):
            return
        self.left[ab], self.made[ab] = a, when
        self.behind[ab] = self.behind[b]
        self.base.append(int(self.behind[a]))
        self.cut.append(b)
        self.when.append(when)
        self.behind[a] = len(self.base) - 1

    def insert(self, word: bytes, i: int) -> None:
        node = 0
        for byte in word:
            node = self.trie.setdefault(node << 8 | byte, len(self.ends))
            if node == len(self.ends):
                self.ends.append(-1)
        self.ends[node] = i

    def cuts_of(self, state: int) -> dict[int, int]:
        """Arcs the state lost, with the merge at which each went."""
        found = self.cuts.get(state)
        if found is None:
            found, at = {}, state
            while at:
                found[self.cut[at]] = self.when[at]
                at = self.base[at]
            if len(self.cuts) >= 4096:
                self.cuts.clear()
            self.cuts[state] = found
        return found

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the arc leaves the state: it was not cut, and the arcs it was made along were there in time."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            cuts, made, at = self.cuts_of(state), len(self.base), token
            known = True
            while at >= 0 and known:
                known = cuts.get(at, made + 1) > made
                made, at = int(self.made[at]), int(self.left[at])
            if len(self.arcs) >= ARC_CACHE:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def matches(self, word: bytes, i: int) -> list[tuple[int, int]]:
        """Tokens whose label starts at ``i``, with their ends, shortest first."""
        trie, ends, node, out = self.trie, self.ends, 0, []
        for j in range(i, len(word)):
            node = trie.get(node << 8 | word[j])
            if node is None:
                break
            if ends[node] >= 0:
                out.append((ends[node], j + 1))
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of a word. A prefix has one accepted sequence only, so an end from which no path goes on is dead for
        good, however it was reached, and each position is left at most once."""
        path, left, dead = [], [], set()
        i, n, options = 0, len(word), self.matches(word, 0)
        while i < n:
            state = int(self.behind[path[-1]]) if path else 0
            while options:
                token, j = options.pop()
                if j not in dead and self.has_arc(state, token):
                    path.append(token)
                    left.append((i, options))
                    i, options = j, self.matches(word, j)
                    break
            else:
                dead.add(i)
                path.pop()
                i, options = left.pop()
        return path


class Words(dict):
    """Packed ids of words, made by the automaton when first asked for; long ones are not kept."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_WORD:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = packed
        return packed


class Tokenizer:
    """Encoder and decoder of one compiled vocabulary, as used inside a task."""

    def __init__(self, vocabulary: dict):
        import regex

        self.automaton = Automaton.of(vocabulary["automaton"])
        self.words, self.split = Words(self.automaton), regex.compile(WORDS)
        self.newer = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER) + "]")
        older = WORDS
        for kind in ("L", "N"):
            older = older.replace(rf"[^\s\p{{L}}\p{{N}}]", rf"(?:{self.newer.pattern}|[^\s\p{{L}}\p{{N}}])").replace(rf" ?\p{{{kind}}}+", rf" ?(?:(?!{self.newer.pattern})\p{{{kind}}})+")
        self.split_newer = regex.compile(older)
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary["added"].items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.labels = dict(self.automaton.label) | {i: t.encode("utf-8") for t, i in vocabulary["added"].items()}

    def plain(self, text: str) -> bytes:
        split = self.split_newer if max(text, default="") >= FIRST_NEWER and self.newer.search(text) else self.split
        return b"".join(map(self.words.__getitem__, split.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.apart is None or not self.apart.search(text):
            return self.plain(text)
        return b"".join(self.added[x] if x in self.added else self.plain(x) for x in self.apart.split(text))

    def decode(self, packed: bytes | None) -> str:
        unknown = "�".encode("utf-8")
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join([self.labels.get(i, unknown) for i in ids]).decode("utf-8", "replace")


def compiled(vocabulary: dict) -> dict:
    """Plain tables of the automaton and the added tokens, made once on the driver."""
    return {"automaton": vars(Automaton(vocabulary["ids"], vocabulary["merges"])), "added": vocabulary["added"]}


def mapped(df: DataFrame, vocabulary: dict, keep: list[str], source: str, columns: dict, work) -> DataFrame:
    """``keep`` columns and the columns that ``work(tokenizer, value)`` makes of ``source``, batch by batch."""
    sent = df.sparkSession.sparkContext.broadcast(compiled(vocabulary))
    fields = [df.schema[c] for c in keep] + [StructField(name, kind) for name, (kind, _) in columns.items()]
    kinds = [kind for _, kind in columns.values()]

    def run(batches):
        import pyarrow as pa

        tokenizer = Tokenizer(sent.value)
        for batch in batches:
            made = [work(tokenizer, x.as_py()) for x in batch.column(len(keep))]
            new = [pa.array([m[i] for m in made], getattr(pa, kind)()) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [f.name for f in fields])

    picked = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{source}`"].alias("_source"))
    return picked.mapInArrow(run, StructType(fields))


def encode(docs: DataFrame, vocabulary: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids``, packed as little-endian unsigned 32-bit integers."""
    columns = {"n_tokens": (LongType(), "int64"), "ids": (BinaryType(), "binary")}

    def work(tokenizer, value):
        packed = tokenizer.encode(value)
        return len(packed) // 4, packed

    return mapped(docs, vocabulary, keep, text, columns, work)


def decode(encoded: DataFrame, vocabulary: dict, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``text``, the labels of the ids one after the other."""
    return mapped(encoded, vocabulary, keep, ids, {"text": (StringType(), "string")}, lambda t, x: (t.decode(x),))
