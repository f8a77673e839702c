"""Token counts by a compiled finite-state transducer.

A byte-fallback BPE vocabulary (a sentencepiece model with identity normalisation) is compiled to a deterministic
transducer over classes of code points. A state is a node of the pieces' trie (failure links make it total) with registers
for the positions where a piece may have begun: the last token that ends there, and the tokens up to there against
those up to now. The token that ends at a position is the one piece among the suffixes of the node whose pair with the token before
it is stable (their joint encoding is just the two); for BPE it exists and is unique. So each transition has the number of tokens that it adds,
which may be negative where a merge takes tokens back. States and transitions are compiled when a text first needs them and kept in a
table of bounded size, which starts anew when it is full.

Texts of a tile are laid end to end and cut into chunks of equal width, which run in lock step through the table. What no merge
crosses (a space after another character, the end of a text, a character outside the vocabulary) resets the state, so a chunk with
a reset has a constant state map behind it, and its part before the reset runs from the state that the chunk before ends in. Chunks without any
reset get their state maps over all states that can come in, found by running them from each state that another one ends in until
none is new; these maps are composed by a parallel prefix scan. Memory is bounded by a tile of code points.

Edge cases: null and empty texts have 0 tokens. Strings of special tokens are ordinary text, as by default in the
library. A text of any length is counted whole, tile by tile. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import needed

SPACE = "▁"
SEP = 0x110000
LANE, TILE = 256, 1 << 20
#: Slots of the transition table, the most transitions in it, and the most states kept before it starts anew.
SLOTS, MOST_TRANSITIONS, MOST_STATES = 1 << 21, 1 << 20, 400_000
#: The most incoming states of chunks without a reset that maps are made for; beyond it they run one after another.
MOST_INCOMING = 64
#: Fixed classes: text boundary; characters outside the vocabulary, of 1 to 4 bytes; the space mark.
BOUND, SPACE_CLASS, FIRST_CLASS = 1, 6, 7


class Vocabulary:
    """Ranks of a sentencepiece BPE model's pieces, its trie, and the stability of pairs."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in ids}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces that go on over a space are not supported")
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.rank:
            at = 0
            for c in p:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.piece.append(None)
                at = self.child[at][c]
            self.piece[at] = p
        self.split: dict[str, tuple[str, str] | None] = {}

    def encode(self, text: str) -> list[str]:
        """The library's merges: of neighbours that join to a piece, the best-ranked and leftmost first."""
        return self.merged(text)[0]

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The parts that are left, and the two that the last merge joined."""
        parts, last = list(text), None
        while True:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts, last
            last = parts[best[1]], parts[best[1] + 1]
            parts[best[1] : best[1] + 2] = [last[0] + last[1]]

    def pair(self, a: str | None, b: str) -> bool:
        """Whether b is a token of its own, and stays one after a: whether no merge joins an end of a with a beginning of b.

        Both are taken apart in the order of their merges, last merge first; what stands at the border at one time must not join to a piece that
        is better than the merge that comes next on either side.
        """
        if self.halves(b) is None and len(b) > 1:
            return False
        if a is None:
            return True
        rank, limit = self.rank, float("inf")
        while True:
            joint = rank.get(a + b)
            if joint is not None and joint < limit:
                return False
            x, y = (rank[a] if len(a) > 1 else -1), (rank[b] if len(b) > 1 else -1)
            if x > y:
                limit, a = x, self.halves(a)[1]
            elif len(b) > 1:
                limit, b = y + 0.5, self.halves(b)[0]
            elif len(a) > 1:
                limit, a = x, self.halves(a)[1]
            else:
                return True

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge joins to the piece; None for one character, or where merges lead elsewhere."""
        if piece not in self.split:
            parts, last = self.merged(piece)
            self.split[piece] = last if parts == [piece] else None
        return self.split[piece]


class Transducer:
    """The compiled transducer, run over many chunks at once."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.code_class = np.full(SEP + 1, -1, np.int32)
        self.chars = [""] * FIRST_CLASS
        self.code_class[SEP] = BOUND
        self.code_class[[0x20, ord(SPACE)]] = SPACE_CLASS
        self.chars[SPACE_CLASS] = SPACE
        for c in sorted(c for c in v.rank if len(c) == 1 and c != SPACE):
            self.code_class[ord(c)] = len(self.chars)
            self.chars.append(c)
        # Tokens by number; 0 is none. Each knows its length and the longest piece that is a proper suffix.
        self.tokens = ["", *v.rank]
        number = {p: n for n, p in enumerate(self.tokens)}
        self.shorter = [0, *(next((number[p[i:]] for i in range(1, len(p)) if p[i:] in number), 0) for p in self.tokens[1:])]
        # Failure links in breadth-first order, the longest piece that ends in each node, and the nodes' depths.
        self.fail, self.ends, self.depth, queue = [0] * len(v.child), [number.get(p, 0) if p else 0 for p in v.piece], [0] * len(v.child), [0]
        for node in queue:
            for c, to in v.child[node].items():
                self.fail[to] = self.goto(self.fail[node], c) if node else 0
                self.ends[to] = self.ends[to] or self.ends[self.fail[to]]
                self.depth[to] = self.depth[node] + 1
                queue.append(to)
        # By node: for each position back to its depth, the place of its register before the node was reached; None where no piece can begin.
        self.before: list[tuple[int | None, ...]] = [()] * len(v.child)
        for node in queue[1:]:
            at, begins = node, set()
            while at:
                begins.add(self.depth[at])
                at = self.fail[at]
            self.before[node] = tuple(k - 1 if k in begins else None for k in range(1, self.depth[node] + 1))
        self.start_anew()

    def start_anew(self) -> None:
        self.states = [(0, (0,), (0,))]  # state 0: nothing before that a merge could reach
        self.number = {self.states[0]: 0}
        self.table = np.full((SLOTS, 2), -1, np.int64)  # state and class; next state and added tokens (and 128)
        self.compiled = 0

    def goto(self, node: int, c: str) -> int:
        while c not in self.v.child[node]:
            if not node:
                return 0
            node = self.fail[node]
        return self.v.child[node][c]

    def classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.code_class[codes]
        if found.min() < 0:
            bad = found < 0
            c = codes[bad]
            found[bad] = BOUND + 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        return found

    def resets(self, cls: np.ndarray) -> np.ndarray:
        """Where the state that comes in doesn't matter. What comes before the first place counts as a boundary."""
        spaces = cls == SPACE_CLASS
        cut = cls < SPACE_CLASS
        cut[1:] |= spaces[1:] & ~spaces[:-1]
        cut[:1] = True
        return cut

    def stable(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        x, y = self.tokens[a], self.tokens[b]
        if y[:1] == SPACE and x[-1:] != SPACE:
            x = ""
        return self.v.pair(x or None, y)

    def transition(self, state: int, cls: int) -> tuple[int, int]:
        """The next state and the tokens that it adds."""
        if cls < SPACE_CLASS:
            return 0, cls - BOUND
        node, last, count = self.states[state]
        if cls == SPACE_CLASS and last[0] and self.tokens[last[0]][-1] != SPACE:
            node, last, count = self.states[0]
        node = self.goto(node, self.chars[cls])
        token = self.ends[node]
        while not self.stable(last[len(self.tokens[token]) - 1], token):
            token = self.shorter[token]
            if not token:
                raise AssertionError("no token ends here")
        added = count[len(self.tokens[token]) - 1] + 1
        key = (node, (token, *(last[k] if k is not None else 0 for k in self.before[node])), (0, *(count[k] - added if k is not None else 0 for k in self.before[node])))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], added

    def step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and added tokens by the table; transitions that aren't in it yet are compiled."""
        key = state.astype(np.int64) << 20 | cls
        slot = (key * 0x9E3779B97F4A7C1 >> 18) & (SLOTS - 1)
        held = self.table[slot]
        odd = np.flatnonzero(held[:, 0] != key)
        while len(odd):
            free = odd[held[odd, 0] == -1]
            if len(free):
                keys, first = np.unique(key[free], return_index=True)
                for k, place in zip(keys.tolist(), slot[free[first]].tolist()):
                    self.compile(k, place)
                held[free] = self.table[slot[free]]
            odd = odd[held[odd, 0] != key[odd]]
            slot[odd] = (slot[odd] + 1) & (SLOTS - 1)
            held[odd] = self.table[slot[odd]]
        value = held[:, 1]
        return (value >> 8).astype(np.int32), ((value & 255) - 128).astype(np.int8)

    def compile(self, key: int, place: int) -> None:
        while self.table[place, 0] != -1:
            if self.table[place, 0] == key:
                return
            place = (place + 1) & (SLOTS - 1)
        to, added = self.transition(key >> 20, key & 0xFFFFF)
        self.table[place] = key, to << 8 | (added + 128)
        self.compiled += 1

    def run(self, rows: np.ndarray, state: np.ndarray, adds: np.ndarray, lanes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Runs chunks from their begin to their end row in lock step, writes what they add, and gives the states they end in."""
        state = state.copy()
        if not len(lanes):
            return state
        for k in range(int(begin.min()), int(end.max())):
            on = (begin <= k) & (k < end)
            if on.all():
                state, adds[k, lanes] = self.step(state, rows[k, lanes])
            elif on.any():
                at = np.flatnonzero(on)
                state[at], adds[k, lanes[at]] = self.step(state[at], rows[k, lanes[at]])
        return state

    def incoming(self, rows: np.ndarray, first: int, last: int, state: int) -> np.ndarray:
        """States that come into chunks first..last, none of which has a reset, when `state` comes into the first: their maps, composed by a prefix scan."""
        n, width = last - first, len(rows)
        scratch = np.zeros(rows.shape, np.int8)
        domain, outs = [state], []
        while len(outs) < len(domain) <= MOST_INCOMING:
            new = domain[len(outs) :]
            lanes = np.repeat(np.arange(first, last), len(new))
            out = self.run(rows, np.tile(np.array(new, np.int32), n), scratch, lanes, np.zeros(len(lanes), np.int64), np.full(len(lanes), width)).reshape(n, len(new))
            outs += list(out.T)
            domain += [x for x in np.unique(out).tolist() if x not in domain]
        if len(domain) > MOST_INCOMING:
            found = [state]
            for lane in range(first, last - 1):
                found.append(int(self.run(rows, np.array(found[-1:], np.int32), scratch, np.array([lane]), np.zeros(1, np.int64), np.full(1, width))[0]))
            return np.array(found, np.int32)
        order = np.argsort(domain)
        maps = order[np.searchsorted(np.array(domain)[order], np.stack(outs, axis=1))]  # (chunks, states): the place of the state that comes out
        shift = 1
        while shift < n:  # after each round, a chunk's map is that of the 2 * shift chunks up to it
            maps = np.concatenate([maps[:shift], np.take_along_axis(maps[shift:], maps[:-shift], axis=1)])
            shift *= 2
        return np.array(domain, np.int32)[np.concatenate([[0], maps[:-1, 0]])]

    def added(self, codes: np.ndarray) -> np.ndarray:
        """Tokens that each position of the text adds; what comes before the text counts as a boundary."""
        if self.compiled > MOST_TRANSITIONS or len(self.states) > MOST_STATES:
            self.start_anew()
        cls = self.classes(codes)
        n = len(cls)
        width = min(LANE, n)
        cls = np.concatenate([cls, np.full(-n % width, BOUND, np.int32)])
        cut = self.resets(cls).reshape(-1, width)
        m = len(cut)
        rows = np.ascontiguousarray(cls.reshape(m, width).T)
        has = cut.any(1)
        first = np.where(has, cut.argmax(1), width)
        adds = np.zeros((width, m), np.int8)
        with_reset, without = np.flatnonzero(has), np.flatnonzero(~has)
        ends, begins = np.zeros(m, np.int32), np.zeros(m, np.int32)
        ends[with_reset] = self.run(rows, np.zeros(len(with_reset), np.int32), adds, with_reset, first[with_reset], np.full(len(with_reset), width))
        for part in np.split(without, np.flatnonzero(np.diff(without) > 1) + 1) if len(without) else []:
            at, end = int(part[0]), int(part[-1]) + 1
            begins[at:end] = self.incoming(rows, at, end, int(ends[at - 1]))
            ends[at:end] = self.run(rows, begins[at:end], adds, part, np.zeros(len(part), np.int64), np.full(len(part), width))
        heads = np.flatnonzero(has & (first > 0))
        self.run(rows, ends[heads - 1], adds, heads, np.zeros(len(heads), np.int64), first[heads])
        return adds.T.reshape(-1)[:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, each after a boundary and, unless empty, the space that the library puts first; and the starts."""
    parts = [f" {t}" if t else "" for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    codes = np.full(int(starts[-1]), SEP, np.uint32)
    inside = np.ones(len(codes), bool)
    inside[starts[:-1]] = False
    codes[inside] = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, starts


class Counter:
    """Counts of whole texts, with bounded memory."""

    def __init__(self, model_file: str):
        self.t = Transducer(Vocabulary(model_file))

    def tile(self, codes: np.ndarray) -> np.ndarray:
        return self.t.added(codes)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        lot: list[str] = []
        size = 0

        def settle() -> None:
            nonlocal lot, size
            if lot:
                codes, starts = code_points(lot)
                out.extend(np.add.reduceat(self.tile(codes).astype(np.int64), starts[:-1]).tolist())
            lot, size = [], 0

        for text in texts:
            if len(text) > TILE:
                settle()
                out.append(self.long(text))
                continue
            lot.append(text)
            size += len(text) + 2
            if size >= TILE:
                settle()
        settle()
        return out

    def long(self, text: str) -> int:
        """A long text by tiles that end before a space after another character; without one, state goes on tile by tile."""
        total, at = 0, 0
        text = f" {text}"
        while at < len(text):
            end = min(len(text), at + TILE)
            while end < len(text):
                cut = text.rfind(" ", at + 1, end)
                while cut > at and text[cut - 1] in (" ", SPACE):
                    cut -= 1
                if cut > at:
                    end = cut
                    break
                end = min(len(text), end + TILE)
            codes = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
            total += int(self.tile(codes).sum(dtype=np.int64))
            at = end
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(model_file: str) -> Counter:
    """One compiled counter for each worker process and model."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = Counter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. See the module for edge cases."""
    source = needed(docs, doc_id=(id_col, "long"), text=(text_col, "string")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for batch in batches:
            text = batch.column(1)
            for at in range(0, len(text), 2048):
                part = text.slice(at, 2048)
                n = c.counts(part.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 2048), pa.compute.binary_length(part.cast(pa.binary())).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401

    return source.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
