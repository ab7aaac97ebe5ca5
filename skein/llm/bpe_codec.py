"""BPE encoding and decoding with a tokenization automaton.

Merges are compiled by gadgets, one by one, in their order, into an automaton that reads tokens.
It starts as one state with a loop for every byte symbol. The gadget of a merge (a, b) -> ab takes
the arc b from the state after a, and adds the arc ab wherever an arc a stood; the state after ab
has the arcs that the state after b has at that moment. The paths that remain spell the results of
byte-pair merging and nothing else, and each string is spelt by one path only.

Arcs that later tokens inherit are not written out (they would be the square of the vocabulary):
a state keeps the merges that removed its own arcs and links to the state it was copied from.

For encoding, the paths are made deterministic on symbols. A state of this second automaton is the
longest end of the string that begins some token (a node of the tokens' tree, with links to
shorter ends), together with the last token of the path to each place within that end. These fix
the last token of the next prefix, since a token reaches back no further. Its table has a row for
each (state, symbol) that words have reached; the row is compiled from the gadgets when it is
first needed, and encoding a word is one look-up for each symbol, followed by one walk back over
the last tokens. (The vocabulary's own words lead to some 90,000 states and as many rows; beyond
STATES rows the table is begun anew.) Decoding emits the labels of the arcs.

Defined results: a null or empty text has no tokens and decodes to the empty text; texts of any
length are read whole; repeated rows give repeated rows; a null doc_id is passed on; extra columns
aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Hashable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import as_bytes, batches_of, doc_text, table
from skein.llm.vocab import Memo, WordVocabulary, default_path

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENDLESS = 1 << 40
#: Rows of the table, after which it is begun anew.
STATES = 400_000
START = -1


class MergeAutomaton:
    """The automaton of a list of merges of tokens, given by identifiers; symbols: the token of each symbol."""

    def __init__(self, merges: list[tuple[int, int, int]], symbols: dict[Hashable, int]) -> None:
        self.symbols = symbols
        self.removed: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born = dict.fromkeys(symbols.values(), -1)
        self.arcs: dict[tuple[int, int], bool] = {}
        self.spelt = {t: (s,) for s, t in symbols.items()}  # tokens that no path reaches are left out
        for rank, (a, b, ab) in enumerate(merges):
            self.add(rank, a, b, ab)
        self.length = {t: len(s) for t, s in self.spelt.items()}
        self.plant()
        self.begin()

    def add(self, rank: int, a: int, b: int, ab: int) -> None:
        """The gadget of one merge. Without the arc b after a, the merge never applies."""
        if a not in self.spelt or b not in self.spelt or not self.has_arc(a, b):
            return
        self.arcs.pop((a, b), None)
        self.removed[a, b] = rank
        self.left[ab], self.right[ab], self.born[ab] = a, b, rank
        self.spelt[ab] = self.spelt[a] + self.spelt[b]

    def plant(self) -> None:
        """The tokens' tree: children and depth of each node, its longest proper end that is a
        node too, and the tokens that end there, the longest first."""
        self.child: list[dict[Hashable, int]] = [{}]
        self.depth = [0]
        own: dict[int, int] = {}
        for token, symbols in self.spelt.items():
            at = 0
            for s in symbols:
                onward = self.child[at].get(s)
                if onward is None:
                    onward = self.child[at][s] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[at] + 1)
                at = onward
            own[at] = token
        self.shorter = [0] * len(self.child)
        self.ends: list[tuple[int, ...]] = [()] * len(self.child)
        level = [0]
        while level:
            below = []
            for at in level:
                for s, onward in self.child[at].items():
                    if at:
                        self.shorter[onward] = self.onward(self.shorter[at], s)
                    mine = (own[onward],) if onward in own else ()
                    self.ends[onward] = mine + self.ends[self.shorter[onward]]
                    below.append(onward)
            level = below

    def onward(self, node: int, symbol: Hashable) -> int:
        while (to := self.child[node].get(symbol)) is None:
            if not node:
                return 0
            node = self.shorter[node]
        return to

    def begin(self) -> None:
        """An empty table: the state of the empty string alone."""
        self.arcs.clear()
        self.table: list[dict[Hashable, int]] = [{}]
        self.rows = 0
        self.state: list[tuple[int, tuple[int, ...]]] = [(0, (START,))]
        self.number = {self.state[0]: 0}
        self.last = [START]

    def compiled(self, state: int, symbol: Hashable) -> int:
        """A row of the table: the state that a symbol leads to."""
        node, lasts = self.state[state]
        node = self.onward(node, symbol)
        for t in self.ends[node]:
            before = lasts[self.length[t] - 1]
            if before == START or self.has_arc(before, t):
                break
        new = (node, (t, *lasts[: self.depth[node]]))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.state)
            self.state.append(new)
            self.last.append(t)
            self.table.append({})
        self.table[state][symbol] = to
        self.rows += 1
        return to

    def has_arc(self, a: int, b: int) -> bool:
        """Whether the state after a has the arc b.

        The state after a was copied, when a was made, from that after its right part, and so
        on; the arc b was added beside the arc of its left part. An arc counts as removed if
        some merge removed it while both ends existed; of two merges of the same rank the left
        one comes first, which is why the right end's making doesn't save it.
        """
        known = self.arcs.get((a, b))
        if known is None:
            known = self.arcs[a, b] = self._has_arc(a, b)
        return known

    def _has_arc(self, a: int, b: int) -> bool:
        x, x_until = a, ENDLESS
        while True:
            y, y_until = b, ENDLESS
            while True:
                r = self.removed.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
                if y not in self.left:
                    break
                y_until = self.born[y]
                y = self.left[y]
            if x not in self.right:
                return True
            x_until = self.born[x]
            x = self.right[x]

    def path(self, symbols: Iterable[Hashable]) -> list[int]:
        """The tokens of the one path that spells these symbols."""
        if self.rows > STATES:
            self.begin()
        at, lasts, table, last = 0, [], self.table, self.last
        for s in symbols:  # no symbol leads to state 0
            at = table[at].get(s) or self.compiled(at, s)
            lasts.append(last[at])
        out, n, length = [], len(lasts), self.length
        while n:
            t = lasts[n - 1]
            out.append(t)
            n -= length[t]
        out.reverse()
        return out


class Codec:
    """Encodes texts to identifiers and decodes identifiers to text, under one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocab = WordVocabulary(path)
        self.final = {c: c + self.vocab.suffix for c in self.vocab.alphabet}
        self.automaton = MergeAutomaton(self.vocab.merges, self.vocab.symbol | {self.final[c]: t for c, t in self.vocab.final_symbol.items()})
        self.label = {i: s for s, i in self.vocab.ids.items()} | {i: s.decode() for s, i in self.vocab.special.items()}
        self.by_word = Memo(self.encode_word)
        self.by_chunk = Memo(self.encode_chunk)
        self.labels = Memo(self.decode_ids)

    def encode_word(self, word: str) -> bytes:
        return array("I", self.automaton.path([*word[:-1], self.final[word[-1]]])).tobytes()

    def encode_chunk(self, chunk: bytes) -> bytes:
        return b"".join(map(self.by_word.__getitem__, self.vocab.words(chunk)))

    def pieces(self, raw: bytes) -> list[bytes]:
        """The identifiers of the chunks of a text in UTF-8, each as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part, special in self.vocab.segments(raw):
            out += map(self.by_chunk.__getitem__, part.split())
            if special is not None:
                out.append(array("I", [self.vocab.special[special]]).tobytes())
        return out

    def encode(self, raw: bytes) -> bytes:
        return b"".join(self.pieces(raw))

    def decode_ids(self, ids: bytes) -> str:
        """Arc labels with a blank between tokens, as the library joins them where no decoder is named."""
        return " ".join([self.label[i] for i in memoryview(ids).cast("I")])

    def decode(self, ids: bytes) -> str:
        return self.decode_ids(ids)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Encodes each document, decodes what came out, and returns count and digests of both.

    With keep, the identifiers (array) and the decoded text are returned besides. One pass
    without a shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out = pa.schema(fields + [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            columns: dict = {name: [] for name in out.names if name != "doc_id"}
            for text in as_bytes(batch.column("text")):
                pieces = own.pieces(text)
                ids = b"".join(pieces)
                decoded = " ".join(map(own.labels.__getitem__, filter(None, pieces)))
                columns["n_tokens"].append(len(ids) // 4)
                columns["ids_sha256"].append(sha(ids).hexdigest())
                columns["decoded_sha256"].append(sha(decoded.encode()).hexdigest())
                if keep:
                    columns["ids"].append(list(memoryview(ids).cast("I")))
                    columns["decoded"].append(decoded)
            yield batches_of({"doc_id": batch.column("doc_id"), **columns}, out)

    return doc_text(docs).mapInArrow(run, SCHEMA + ", ids array<long>, decoded string" * keep)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
