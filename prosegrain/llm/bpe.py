"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens, not characters: it accepts just the token sequences that the merges would give. It starts
as one state with a loop for every base symbol. Each merge (u, v) in turn adds a gadget: the state entered by u is
copied without v, u now leads to the copy, and wherever u could be read the joined token can be read too and leads to
where v led. A copy is kept as its label and the number of its last merge; labels made later are allowed wherever their
left part is.

For characters it is made deterministic as it is used: a reader's state is the set of arcs that may be under way, and its
table gives for each character the next state and the one arc that can end there. A word costs one table look-up for each
character; following the ended arcs back from its end gives the tokens. Decoding emits the labels of the arcs.

Defined cases: null or empty text has no tokens and decodes to the empty string; special tokens written in a text are
their own ids, as in the library; repeated rows and null ids are kept; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from prosegrain.llm import common

END = "</w>"
#: The table of transitions starts anew beyond so many states; it refills from the automaton.
MOST_STATES = 120_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Automaton:
    """States are numbers, 0 the start; labels are the vocabulary's strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.target = dict.fromkeys(vocab, 0)  # label -> the state that it leads to
        self.number: dict[tuple[str, str], int] = {}  # merge -> its place in the order
        self.parts: dict[str, tuple[str, str, int]] = {}  # joined label -> its two parts and its merge
        self.owner, self.made = [""], [0]  # state -> the label whose merges made it a copy, and the last of them
        self.arcs: list[dict[str, int]] = [{}]  # the table: for each state the labels tried so far and their targets, -1 for none
        for i, (u, v) in enumerate(merges, 1):
            self._gadget(i, u, v)
        self.next: list[dict[str, int]] = [{}]  # the labels' spelling: for each node the nodes that its symbols lead to
        self.label: list[str | None] = [None]
        for label in vocab:
            node = 0
            for c in [*label[:-5], label[-5:]] if label.endswith(END) and len(label) > 4 else label:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.label.append(None)
                node = self.next[node][c]
            self.label[node] = label
        self.size = {x: len(x) - 4 * (x.endswith(END) and len(x) > 4) for x in vocab}  # in symbols
        self._forget()

    def _forget(self) -> None:
        self.open: list[tuple] = [((0, 0),)]  # state of the reader -> the states and nodes of all arcs that may be under way
        self.known = {self.open[0]: 0}
        self.step: list[dict[str, tuple[int, str]]] = [{}]  # the table: for each state and symbol the next state and the arc that ends

    def _gadget(self, i: int, u: str, v: str) -> None:
        state, joined = self.target[u], u + v
        read = self.allowed(state, v)
        self.parts[joined] = u, v, i
        self.target[joined] = self.target[v]
        if read:
            self.number[u, v] = i
            self.owner.append(u)
            self.made.append(i)
            self.arcs.append({})
            self.target[u] = len(self.owner) - 1

    def allowed(self, state: int, label: str) -> bool:
        """Whether the state has an arc with this label.

        The copies that led to a state belong to a label, then to its right part before that label was made, and so
        on; a label made after a copy was allowed there if its left part was. So an arc is missing if one of the copies
        lacks one of the left parts that was the newest label by then.
        """
        owner, before = self.owner[state], self.made[state] + 1
        lefts, until = [(label, 1 << 60)], label
        while until in self.parts:
            until, _, born = self.parts[until]
            lefts.append((until, born))
        while owner:
            for z, born in lefts:
                m = self.number.get((owner, z))
                if m and m < before and m <= born:  # equal if a label is joined with itself
                    return False
            _, owner, born = self.parts.get(owner, ("", "", 0))
            before = min(before, born)
        return True

    def _advance(self, at: int, symbol: str) -> tuple[int, str]:
        """A new entry of the table. Of the arcs that may end with this symbol just one is allowed where it began."""
        ahead, ended = [], None
        for state, node in self.open[at]:
            to = self.next[node].get(symbol)
            if to is None:
                continue
            if self.next[to]:
                ahead.append((state, to))
            label = self.label[to]
            if label is not None and ended is None:
                arcs = self.arcs[state]
                goal = arcs.get(label)
                if goal is None:
                    goal = arcs[label] = self.target[label] if self.allowed(state, label) else -1
                if goal >= 0:
                    ended = label
                    start = goal
        ahead.append((start, 0))
        key = tuple(ahead)
        if key not in self.known:
            self.known[key] = len(self.open)
            self.open.append(key)
            self.step.append({})
        out = self.step[at][symbol] = self.known[key], ended
        return out

    def encode(self, symbols: list[str]) -> list[str]:
        """The labels of the one accepted path that spells the symbols, read off backwards from the arcs that end in each place."""
        if len(self.open) > MOST_STATES:
            self._forget()
        at, ended, step = 0, [], self.step
        for c in symbols:
            entry = step[at].get(c) or self._advance(at, c)
            at = entry[0]
            ended.append(entry[1])
        out, n = [], len(ended)
        while n:
            label = ended[n - 1]
            out.append(label)
            n -= self.size[label]
        out.reverse()
        return out


class _Chunks(dict):
    """For the text between white space: packed ids and labels; emptied when it holds ``most`` entries."""

    def __init__(self, fill, most: int = 600_000):
        super().__init__()
        self.fill, self.most = fill, most

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        if len(self) >= self.most:
            self.clear()
        out = self[chunk] = self.fill(chunk)
        return out


@lru_cache(maxsize=2)
def codec(json_file: str):
    """A function from a text to its packed ids and its decoded text."""
    from tokenizers import Tokenizer

    with open(json_file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    automaton = Automaton(vocab, [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
    library = Tokenizer.from_file(json_file)  # its normalizer and its word pattern only
    added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")")
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    printable = re.compile(r"[!-~]*")
    odd_space = re.compile(r"[\x1c-\x1f]")
    end = model["end_of_word_suffix"] or ""

    def fill(chunk: str) -> tuple[bytes, str]:
        if printable.fullmatch(chunk):  # these characters stand for themselves at the byte level
            words = plain.findall(chunk.lower())
        else:
            words = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))]
        labels = [x for w in words for x in automaton.encode([*w[:-1], w[-1] + end])]
        return array("I", [vocab[x] for x in labels]).tobytes(), " ".join(labels)

    known = _Chunks(fill)

    def run(text: str) -> tuple[bytes, str]:
        if special.search(text):
            parts = [x for s in special.split(text) for x in ([(np.asarray([added[s]], "<u4").tobytes(), s)] if s in added else [run(s)] if s else [])]
        else:
            parts = [known[c] for c in (re.split("[ \t-\r]+", text) if odd_space.search(text) else text.split())]
        return b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts if x[0]])

    return run


def _coded(batches: Iterator[pa.RecordBatch], json_file: str) -> Iterator[pa.RecordBatch]:
    run = codec(json_file)
    for batch in batches:
        n, ids, decoded = [], [], []
        for text in batch.column(1):
            packed, out = run(text.as_py() or "")
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(out.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])


def digests(docs: DataFrame, json_file: str) -> DataFrame:
    """One row per document: its number of tokens and digests of its ids and of its decoded text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(lambda b: _coded(b, json_file), SCHEMA)


def _tokens(batches: Iterator[pa.RecordBatch], json_file: str) -> Iterator[pa.RecordBatch]:
    run = codec(json_file)
    for batch in batches:
        got = [run(text.as_py() or "") for text in batch.column(1)]
        ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in got], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([x for _, x in got], pa.string())], names=["doc_id", "ids", "decoded"])


def tokens(docs: DataFrame, json_file: str) -> DataFrame:
    """One row per document: its ids and its decoded text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(lambda b: _tokens(b, json_file), "doc_id long, ids array<int>, decoded string")


def op10_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
