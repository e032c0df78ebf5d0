"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For merge-type vocabularies every prefix of a text has exactly one encoding, so a table
of the *last token of each prefix* holds the whole encoding. The table is filled left to
right: an Aho-Corasick automaton reports every piece that ends at a position, and a piece
is the last token there if it is compatible with the last token of the prefix before it,
that is if merging the two pieces' characters from scratch gives just these two pieces.
The ids are then recovered backwards from the end of the table.

A text is cut before each run of spaces and around line feeds, where no piece of the
vocabulary reaches across (checked when the model is read; a model whose pieces do gets
whole texts). Characters without a piece become byte tokens and stand alone. Encodings of
short cuts are kept in a bounded table of each worker.

Edge cases: a null or empty text is the begin and end ids alone; a literal U+2581 is a
space, as in the library; texts of any length are encoded whole; rows with equal or null
ids each give a row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import python_workers, session

SPACE = "▁"
#: Encodings (of each of two generations) and compatibility tests kept by a worker.
CACHED_CUTS, CACHED_PAIRS, CACHED_CHARS = 300_000, 500_000, 48
#: Cuts of a text handled at once.
SLICE = 50_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Cuts(dict):
    """cut -> its ids as little-endian bytes, filled on demand, in two generations.

    When the young one is full it becomes the old one; what is still asked for moves back,
    so frequent cuts stay and memory stays bounded.
    """

    def __init__(self, table: PrefixTable):
        self.table = table
        self.old: dict[str, bytes] = {}

    def __missing__(self, cut: str) -> bytes:
        out = self.old.get(cut) or self.table.ids_of(cut)
        if len(cut) <= CACHED_CHARS:
            self[cut] = out
        return out

    def age(self) -> None:
        if len(self) >= CACHED_CUTS:
            self.old = dict(self)
            self.clear()


class PrefixTable:
    """A vocabulary with its automaton; encodes and decodes single texts."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without a character map that keep all spaces are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.dummy = norm.add_dummy_prefix
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.piece = [sp.id_to_piece(i).replace(SPACE, " ") for i in range(sp.vocab_size())]
        self.score = [sp.get_score(i) for i in range(sp.vocab_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(sp.vocab_size())]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(self.piece[i][3:5], 16)]) if sp.is_byte(i) else self.piece[i].encode() for i in range(sp.vocab_size())]
        order = sorted((i for p, i in self.id.items() if len(p) > 1), key=lambda i: -self.score[i])
        #: When a piece is merged, counted from the first; characters are there from the start.
        self.rank = [-1] * len(self.piece)
        for n, i in enumerate(order):
            self.rank[i] = n
        same = Counter(self.score[i] for i in order)
        self.tied = [self.rank[i] >= 0 and same[self.score[i]] > 1 for i in range(len(self.piece))]
        #: The two ids that a piece is merged from.
        self.halves: dict[int, tuple[int, int]] = {}
        for p, i in self.id.items():
            if (parts := self._merged(p, halves=True)) is not None:
                self.halves[i] = parts
        # a piece that merging cannot reach is never a token
        self.steps, self.falls, self.ends = _automaton((p, i) for p, i in self.id.items() if i in self.halves)
        across = any(re.search(r"[^ ] ", p) or ("\n" in p and len(p) > 1) for p in self.id)
        self.cut = re.compile(r"(?s).+" if across else r" *[^ \n]+|\n| +")
        self.pairs: dict[int, bool] = {}
        self.cuts = _Cuts(self)

    def _merged(self, text: str, halves: bool = False) -> Any:
        """Merging from scratch: the best-scored adjacent pair first, of equals the leftmost.

        With `halves`: the ids of the last two parts if all becomes one piece, else None.
        """
        parts = list(text)
        last: tuple[int, int] = (-1, -1)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            last = self.id[parts[at]], self.id[parts[at + 1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts if not halves else last if len(parts) == 1 else None

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of two tokens ends in these two.

        The merges next to the border are undone, the latest first. Whatever then meets
        across the border may form a piece only if that merge would have come later than
        the one just undone; at equal rank the left one comes first.
        """
        if self.tied[a] or self.tied[b]:
            return self._merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        rank, halves, piece, get = self.rank, self.halves, self.piece, self.id.get
        limit = 1 << 30
        while True:
            across = get(piece[a] + piece[b])
            if across is not None and rank[across] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, halves[b][0]
            else:
                return True

    def _step(self, state: int, c: str) -> int:
        """The automaton's next state where the trie has no branch; kept for the next time."""
        at = state
        while at and c not in self.steps[at]:
            at = self.falls[at]
        to = self.steps[at].get(c, 0)
        self.steps[state][c] = to
        return to

    def _last_tokens(self, run: str) -> list[int]:
        """Ids of a run of characters that all have pieces."""
        last = [-1]
        pairs, steps, ends = self.pairs, self.steps, self.ends
        state = 0
        for end, c in enumerate(run, 1):
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            for token, length in ends[state]:
                if length == end:
                    break
                key = last[end - length] << 20 | token
                known = pairs.get(key)
                if self.compatible(last[end - length], token) if known is None else known:
                    break
            last.append(token)
        out, at, piece = [], len(run), self.piece
        while at:
            out.append(last[at])
            at -= len(piece[last[at]])
        out.reverse()
        return out

    def ids_of(self, cut: str) -> bytes:
        if self.chars.issuperset(cut):
            ids = self._last_tokens(cut)
        else:
            ids, run = [], []
            for c in [*cut, ""]:
                if c in self.chars:
                    run.append(c)
                    continue
                if run:
                    ids += self._last_tokens("".join(run))
                    run = []
                ids += [self.byte[b] for b in c.encode()]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids, begin and end ids included, as little-endian unsigned 32-bit integers."""
        parts = [np.array([self.bos], "<u4").tobytes()]
        if text:
            text = (" " if self.dummy else "") + text.replace(SPACE, " ")
            cuts = self.cut.findall(text)
            for k in range(0, len(cuts), SLICE):
                self.cuts.age()
                parts.append(b"".join(map(self.cuts.__getitem__, cuts[k : k + SLICE])))
        parts.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids as `encode` gives them; the space that encoding put first is taken off."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[self.dummy and raw[:1] == b" " :].decode("utf-8", "replace")


def _automaton(words: Iterable[tuple[str, int]]) -> tuple[list[dict[str, int]], list[int], list[tuple[tuple[int, int], ...]]]:
    """Aho-Corasick over (word, value): branches, fall-backs, and (value, length) of all words that end in a state, longest first."""
    steps: list[dict[str, int]] = [{}]
    own: list[tuple[tuple[int, int], ...]] = [()]
    for word, value in words:
        at = 0
        for c in word:
            to = steps[at].get(c)
            if to is None:
                to = steps[at][c] = len(steps)
                steps.append({})
                own.append(())
            at = to
        own[at] = ((value, len(word)),)
    falls, ends = [0] * len(steps), list(own)
    queue = deque(steps[0].values())
    while queue:
        at = queue.popleft()
        for c, to in steps[at].items():
            back = falls[at]
            while back and c not in steps[back]:
                back = falls[back]
            falls[to] = steps[back].get(c, 0)
            ends[to] = own[to] + ends[falls[to]]
            queue.append(to)
    return steps, falls, ends


_TABLES: dict[str, PrefixTable] = {}


def prefix_table(model: bytes) -> PrefixTable:
    """The table of a model, built once in each worker process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PrefixTable(model)
    return _TABLES[key]


def _map(docs: DataFrame, id_col: str, text_col: str, model_path: str | None, fields: str, row) -> DataFrame:
    import pyarrow as pa

    spark = session(docs)
    python_workers(spark)
    with open(model_path or default_model(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # the size of a vocabulary file, whatever the corpus

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}"
    names = [x.split()[0] for x in fields.split(", ")]

    def encoded(batches: Iterator[Any]) -> Iterator[Any]:
        table = prefix_table(model.value)
        for b in batches:
            out = [row(table, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(_KINDS[fields]))], names=["doc_id", *names])

    return rows.mapInArrow(encoded, schema)


_FULL = "ids binary, decoded string"
_DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _arrow_kinds() -> dict[str, list[Any]]:
    import pyarrow as pa

    return {_FULL: [pa.binary(), pa.string()], _DIGEST: [pa.int64(), pa.string(), pa.string()]}


_KINDS = _arrow_kinds()


def _full(table: PrefixTable, text: str | None) -> tuple:
    ids = table.encode(text)
    return ids, table.decode(ids)


def _digest(table: PrefixTable, text: str | None) -> tuple:
    ids = table.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(table.decode(ids).encode()).hexdigest()


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded."""
    return _map(docs, id_col, text_col, model_path, _FULL, _full)


def encode_decode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digested where the ids are made, so ids need not leave the worker."""
    return _map(docs, id_col, text_col, model_path, _DIGEST, _digest)
