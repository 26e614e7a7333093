"""Token counts by a compiled finite-state transducer, without making the tokens.

The tokenizer merges the best-scored pair of neighbours first, over a whole text, so a text's tokens are not found from
left to right. But two tokens stand side by side in a result exactly when merging the two of them alone gives them back, so
each prefix of a text has one last token: the one that ends there and may follow the last token of what is before it.
Reading a text from left to right needs no more than what the last tokens before those places rule out where a vocabulary
entry that is still open may have begun. That is a state; there are finitely many, a transition by a character leads from
one to another, and it is annotated with by how many tokens the prefix's tokenisation grows (fewer than none where tokens
join). Transitions are compiled when they are first used and are kept by the worker.

A text is cut into chunks. Between two characters that no vocabulary entry holds side by side any state becomes the fresh
one, so a chunk's map of states is: what stands before its first such place, to be run from the entering state, and then a
constant. Chunks without one have a table of the entering states that occur. All chunks of a batch advance together, a
character a step, and the maps are composed by pointer doubling, which is the parallel prefix scan over them.

Defined cases: null texts are empty; an empty text has no tokens and every other one starts with the tokenizer's space;
characters outside of the vocabulary are as many tokens as they have UTF-8 bytes; special tokens' strings are ordinary
text; repeated rows are counted one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, sized, table, text_batches

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
#: Characters of a chunk, and of the texts that advance together (a longer one goes alone).
CHUNK, TOGETHER = 512, 1 << 20
#: Cells of the table of transitions, from which on it is compiled anew with the next texts.
CELLS = 8_000_000
#: A cell holds the next state above these bits and the tokens added, plus HALF, in them: a piece is shorter than HALF.
BITS, HALF = 6, 32
SPACE = "▁"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


class Vocabulary:
    """Tokens in code-point order, so that those with one beginning stand together, and which of them may not follow which."""

    def __init__(self, ranks: dict[str, int]) -> None:
        self.rank = ranks
        #: Pairs of characters within pieces; the characters of longer pieces.
        self.beside = {p[k : k + 2] for p in ranks for k in range(len(p) - 1)}
        self.inner = sorted(set("".join(self.beside)))
        steps = {t: self.merges(t) for t in {*ranks, *self.inner}}
        self.tokens = sorted(t for t, s in steps.items() if s)
        self.steps = [steps[t] for t in self.tokens]
        self.weight = [1 if t in ranks else len(t.encode()) for t in self.tokens]
        # Nodes: children, whether a token ends, and the range of the tokens that start so.
        self.children: list[dict[str, int]] = [{}]
        self.ends, self.low, self.high = [False], [0], [len(self.tokens)]
        for k, token in enumerate(self.tokens):
            at = 0
            for c in token:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(False)
                    self.low.append(k)
                    self.high.append(k)
                at = self.children[at][c]
                self.high[at] = k + 1
            self.ends[at] = True
        #: By what pieces start with: rank and rest of each, best first.
        self.longer: dict[str, list[tuple[int, str]]] = {}
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(piece)):
                self.longer.setdefault(piece[:k], []).append((rank, piece[k:]))
        #: By a first part that a token has at some time: the token, its next merge's rank, and the span of ranks of that time.
        first: dict[str, list[tuple]] = {}
        for k, s in enumerate(self.steps):
            for (_, part, _), (since, then, until) in zip(s, spans(s), strict=True):
                first.setdefault(part, []).append((k, then, since, until))
        self.first = {part: np.array(x).T for part, x in first.items()}
        self.borders: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Of a model of byte-pair merges with a space in front, kept white space and bytes for unknown characters."""
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if m.normalize(" a  b\tｃ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b\tｃ{SPACE}":
            raise ValueError("only tokenizers that leave texts as they are")
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(m.get_piece_size())]
        if sum(map(m.is_byte, range(len(special)))) != 256 or any(map(m.is_unused, range(len(special)))):
            raise ValueError("only tokenizers with bytes for unknown characters and without unused pieces")
        scores = {m.id_to_piece(i): m.get_score(i) for i, s in enumerate(special) if not s}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        return cls({p: order[s] for p, s in scores.items()})

    def merges(self, token: str) -> list[tuple] | None:
        """(rank, first part, last part) after each merge that makes ``token`` from its characters, a start included; None
        if they end as other tokens."""
        parts, steps = list(token), [(-1, token[0], token[-1])]
        while True:
            best = min(((self.rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.rank), default=None)
            if best is None:
                return steps if len(parts) == 1 else None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            steps.append((best[0], parts[0], parts[-1]))

    def border(self, last: str) -> np.ndarray:
        """What may be joined to a part ``last``: rank of the pair, token behind, and the span of ranks of the token's stage."""
        found = self.borders.get(last)
        if found is None:
            pairs = [(rank, self.first[rest]) for rank, rest in self.longer.get(last, ()) if rest in self.first]
            token, then, since, until = np.concatenate([np.zeros((4, 0)), *(x for _, x in pairs)], axis=1)
            rank = np.repeat([float(r) for r, _ in pairs], [x.shape[1] for _, x in pairs])
            found = np.stack([rank, token, since, until])[:, rank <= then]
            if len(last) == 1:
                self.borders[last] = found
        return found

    def barred(self, k: int) -> bytes:
        """The tokens (32-bit numbers in order) that can't follow token ``k``: side by side, a pair over the border is the best
        one at a time when both have come to its parts. Of equal ranks the leftmost pair goes first."""
        found = [np.zeros(0)]
        for (_, _, last), (since, then, until) in zip(self.steps[k], spans(self.steps[k]), strict=True):
            rank, token, from_, to = self.border(last)
            n = int(np.searchsorted(rank, then))
            found.append(token[:n][(from_[:n] < until) & (since <= to[:n])])
        return np.unique(np.concatenate(found)).astype(np.int32).tobytes()


def spans(steps: list[tuple]) -> list[tuple[float, float, float]]:
    """For each stage of a token between two merges: from which rank on it lasts, the rank of the next merge, and up to
    which rank it lasts. A merge that a worse one makes possible comes at once."""
    out, since = [], -1.0
    for k in range(len(steps)):
        then = steps[k + 1][0] if k + 1 < len(steps) else math.inf
        out.append((since, then, max(since, then)))
        since = max(since, then)
    return out


class Transducer:
    """States, and transitions by classes of characters, compiled when they are first used.

    A state is a tuple of (node, barred, tokens): for each open place, the vocabulary node that the text from there on
    spells, the set of tokens from that node on which can't stand there, and the number of tokens up to there less
    that up to here. State 0 is the fresh one."""

    def __init__(self, vocabulary: Vocabulary, cells: int = CELLS) -> None:
        self.v, self.cells = vocabulary, cells
        # Classes 0 to 3: unknown characters of one to four bytes; 4: pieces that are in no other piece.
        code = np.arange(0x110000)
        self.class_of = np.select([code < 0x80, code < 0x800, code < 0x10000], [0, 1, 2], 3).astype(np.uint16)
        for p in vocabulary.rank:
            if len(p) == 1:
                self.class_of[ord(p)] = 4
        for k, c in enumerate(vocabulary.inner):
            self.class_of[ord(c)] = 5 + k
        self.class_of[ord(" ")] = self.class_of[ord(SPACE)]
        self.chars = [None] * 5 + list(vocabulary.inner)
        n = len(self.chars)
        self.beside = np.zeros((n, n), bool)
        number = {c: 5 + k for k, c in enumerate(vocabulary.inner)}
        for a, b in vocabulary.beside:
            self.beside[number[a], number[b]] = True
        #: Columns of the table are given to classes as they occur.
        self.column = np.full(n, -1, np.int32)
        self.width = 0
        self.reset()

    def reset(self) -> None:
        """Forget all but the fresh state."""
        self.number: dict[tuple, int] = {((0, 0, 0),): 0}
        self.states: list[tuple] = [((0, 0, 0),)]
        self.table = np.full((1024, max(64, self.width)), -1, np.int32)
        #: Sets of barred tokens by number, by the token before, and by a set and the node whose tokens are left of it.
        self.sets: list[bytes] = [b""]
        self.set_number: dict[bytes, int] = {b"": 0}
        self.behind: dict[int, int] = {}
        self.within: dict[tuple[int, int], tuple[int, bool]] = {}

    def set_of(self, tokens: bytes) -> int:
        if tokens not in self.set_number:
            self.set_number[tokens] = len(self.sets)
            self.sets.append(tokens)
        return self.set_number[tokens]

    def narrowed(self, barred: int, node: int) -> tuple[int, bool]:
        """What of a set is left at ``node``, and whether the token that ends there may stand."""
        key = barred, node
        if key not in self.within:
            low, high = self.v.low[node], self.v.high[node]
            tokens = np.frombuffer(self.sets[barred], np.int32)
            left = tokens[slice(*np.searchsorted(tokens, (low, high)))]
            self.within[key] = self.set_of(left.tobytes()), self.v.ends[node] and not (len(left) and left[0] == low)
        return self.within[key]

    def intern(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.number[state]

    def columns_for(self, classes: np.ndarray) -> None:
        new = classes[self.column[classes] < 0]
        self.column[new] = self.width + np.arange(len(new))
        self.width += len(new)
        while self.width > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)

    def step(self, state: tuple, kind: int) -> tuple[tuple, int]:
        """The state after a character of class ``kind``, and the tokens that it adds."""
        v, c = self.v, self.chars[kind]
        if c is None:
            return self.states[0], kind + 1 if kind < 4 else 1
        last = added = None
        places = []
        for node, barred, n in state:
            to = v.children[node].get(c)
            if to is not None:
                left, stands = self.narrowed(barred, to)
                if v.children[to]:
                    places.append((to, left, n))
                if stands:
                    last, added = v.low[to], n + v.weight[v.low[to]]
        if last not in self.behind:
            self.behind[last] = self.set_of(v.barred(last))
        return (*((node, barred, n - added) for node, barred, n in places), (0, self.behind[last], 0)), added

    def compile(self, state: np.ndarray, column: np.ndarray, kind: np.ndarray) -> None:
        """Fill the table's cells of these states and columns, of characters of class ``kind``."""
        for s, k, c in sorted(set(zip(state.tolist(), column.tolist(), kind.tolist(), strict=True))):
            to, added = self.step(self.states[s], c)
            n = self.intern(to)
            self.table[s, k] = n << BITS | added + HALF

    def run(self, kinds: np.ndarray, columns: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after ``length`` characters from ``start`` on for each entering ``state``, and the tokens added:
        all advance together, and states stay numbered as they are."""
        order = np.argsort(-length, kind="stable")
        at, now = start[order], state[order].astype(np.int64)
        tokens = np.zeros(len(order), np.int64)
        running = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
        for k, n in enumerate(running.tolist()):
            i = at[:n] + k
            c = columns[i]
            cell = self.table.ravel().take(now[:n] * self.table.shape[1] + c)
            if (cell < 0).any():
                new = np.flatnonzero(cell < 0)
                self.compile(now[:n][new], c[new], kinds[i[new]])
                cell[new] = self.table.ravel().take(now[:n][new] * self.table.shape[1] + c[new])
            now[:n] = cell >> BITS
            tokens[:n] += (cell & 2 * HALF - 1) - HALF
        back_state, back_tokens = np.empty_like(now), np.empty_like(tokens)
        back_state[order], back_tokens[order] = now, tokens
        return back_state, back_tokens

    def counts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of texts that stand one after another in ``codes`` (code points), ``lengths`` of them each."""
        if self.table.size > self.cells:
            self.reset()
        some = np.flatnonzero(lengths)
        out = np.zeros(len(lengths), np.int64)
        if not len(some):
            return out
        starts = np.cumsum(lengths) - lengths
        kinds = self.class_of[np.insert(codes, starts[some], ord(SPACE))]
        self.columns_for(np.unique(kinds))
        columns = self.column[kinds]
        length = lengths[some] + 1
        first = np.cumsum(length) - length
        # Chunks: text, start, end; fresh: the place from which on the entering state doesn't matter.
        pieces = -(-length // CHUNK)
        text = np.repeat(np.arange(len(some)), pieces)
        within = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[text] + within * CHUNK
        end = np.minimum(start + CHUNK, (first + length)[text])
        fresh = np.ones(len(kinds), bool)
        fresh[1:] = ~self.beside[kinds[:-1], kinds[1:]]
        fresh[first] = True
        at = np.flatnonzero(fresh)
        at = np.append(at, len(kinds))[np.searchsorted(at, start)]
        constant = at < end
        # The constant part of each map; from a map without one, the state that a fresh start would give.
        leaves, tokens = self.run(kinds, columns, np.where(constant, at, start), end - np.where(constant, at, start), np.zeros(len(start), np.int64))
        total = np.bincount(text[constant], tokens[constant], len(some)).astype(np.int64)
        later = np.flatnonzero(within > 0)
        if len(later):
            total += self.composed(kinds, columns, text, start, np.minimum(at, end) - start, constant, leaves, later, len(some))
        out[some] = total
        return out

    def composed(self, kinds: np.ndarray, columns: np.ndarray, text: np.ndarray, start: np.ndarray, head: np.ndarray, constant: np.ndarray, leaves: np.ndarray, later: np.ndarray, texts: int) -> np.ndarray:
        """Tokens by text of the chunks' parts that hang on the entering state. An entry (chunk, state) is run once; from
        a chunk without a constant part it leads to an entry of the next chunk. The first entries are the true ones
        behind constant chunks and guesses behind others."""
        chunk, state = later, leaves[later - 1]
        known: dict[tuple[int, int], int] = {}
        added: list[np.ndarray] = []
        leads: list[tuple[int, int]] = []
        while len(chunk):
            known |= {key: len(known) + k for k, key in enumerate(zip(chunk.tolist(), state.tolist(), strict=True))}
            out, n = self.run(kinds, columns, start[chunk], head[chunk], state)
            added.append(n)
            goes_on = ~constant[chunk] & (np.append(text, -1)[chunk + 1] == text[chunk])
            leads += [(c + 1, s) if g else (-1, -1) for c, s, g in zip(chunk.tolist(), out.tolist(), goes_on.tolist(), strict=True)]
            fresh = sorted({x for x in leads[-len(chunk) :] if x[0] >= 0 and x not in known})
            chunk, state = (np.array([x[k] for x in fresh], np.int64) for k in (0, 1))
        sums = np.append(np.concatenate(added), 0)
        nothing = len(sums) - 1
        to = np.array([known.get(x, nothing) for x in leads] + [nothing])
        while (to != nothing).any():
            sums, to = sums + sums[to], to[to]
        true = np.flatnonzero(constant[later - 1])
        return np.bincount(text[later[true]], sums[true], texts).astype(np.int64)


#: A worker's transducers by vocabulary.
COMPILED: dict[str, Transducer] = {}


def transducer(vocabulary: str) -> Transducer:
    if vocabulary not in COMPILED:
        import public_tokenizers

        COMPILED[vocabulary] = Transducer(Vocabulary.load(public_tokenizers.path(vocabulary)))
    return COMPILED[vocabulary]


def count_batch(t: Transducer, texts: pa.Array) -> np.ndarray:
    """Tokens of each text of an Arrow array without nulls."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out, at = np.zeros(len(lengths), np.int64), 0
    ends = np.cumsum(lengths)
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
        codes = np.frombuffer("".join(texts.slice(at, to - at).to_pylist()).encode("utf-32-le"), np.uint32)
        out[at:to] = t.counts(codes, lengths[at:to])
        at = to
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(count_batch(t, texts))], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl(COUNTS))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sized(token_counts(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT), docs.count())
