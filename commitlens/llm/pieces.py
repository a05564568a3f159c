"""A SentencePiece vocabulary as a max-plus lattice.

Positions of a text are nodes and vocabulary pieces are arcs.  A state is what a path must remember at a node,
and the encoding is the best path from the start to the end:

* ``unigram`` models: an arc weighs its log probability; nothing is remembered but the position.
* ``bpe`` models: an arc weighs 0, and the last piece is remembered; a piece may follow another only if merging the two
  side by side gives back the two (other pairs weigh minus infinity).  A sequence of pieces is what the merge rules
  produce exactly if all its neighbours fit in this way, so one path at most is left for any text.

A character that no piece covers is an arc of its own and is written as its UTF-8 byte pieces.
No piece spans two neighbouring characters that are neighbours in no piece, so every path passes the node
between them: texts are solved from one such cut to the next, and short segments are remembered.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np

SPACE = "▁"
#: segments up to this length are remembered, at most this many; the first ones seen hold the frequent ones, and
#: after this many that found no room all are forgotten and it begins anew
MEMO_LENGTH, MEMO_SIZE, MEMO_TURN = 48, 400_000, 3_000_000
FITS_SIZE = 300_000


#: stands for the token before a start, a cut or an uncovered character
ALONE = -1 << 60


class Vocabulary(NamedTuple):
    """What tasks need of a model; its size is that of the vocabulary."""
    algorithm: str
    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    prefix: bool
    raw: list[bytes]  # by id: what the piece decodes to


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model file (identity normalisation, bpe or unigram)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        return from_proto(pb.ModelProto.FromString(f.read()))


def from_proto(model) -> Vocabulary:
    spec, kinds = model.normalizer_spec, type(model).SentencePiece
    algorithm = {1: "unigram", 2: "bpe"}.get(model.trainer_spec.model_type)
    if algorithm is None or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only bpe and unigram models with identity normalisation are handled")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not handled")
    normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
    in_bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL
           else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
    return Vocabulary(algorithm, normal, [in_bytes[b] for b in range(256)] if len(in_bytes) == 256 else [], unknown,
                      min(s for _, s in normal.values()) - 10.0, spec.add_dummy_prefix, raw)


def _trie(ids: dict[str, int]) -> dict:
    """Nested dicts by character; the id of a piece stands under ''."""
    root: dict = {}
    for piece, i in ids.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = i
    return root


class Lattice:
    """Paths over a text.  Tokens are piece ids, or -1 - code point for an uncovered character."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids = {p: i for p, (i, _) in vocabulary.pieces.items()}
        self.score = {i: s for i, s in vocabulary.pieces.values()}
        self.text_of = {i: p for p, i in self.ids.items()}
        self.trie = _trie(self.ids)
        self.inner = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self.bpe = vocabulary.algorithm == "bpe"
        self.spaces_cut = not any(pair[1] == SPACE != pair[0] for pair in self.inner)
        self._fits: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._missed = 0

    # -- which pieces may follow each other

    def merged(self, text: str) -> list[str]:
        """The merge rules applied to a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int | None, b: int) -> bool:
        """Whether token b may follow token a (None: the start or a cut)."""
        key = (ALONE if a is None or a < 0 else a << 32) + b
        found = self._fits.get(key)
        if found is None:
            if b < 0:
                found = True
            elif a is None or a < 0:  # nothing merges across: b alone must be what its characters give
                found = self.merged(self.text_of[b]) == [self.text_of[b]]
            else:
                found = self.merged(self.text_of[a] + self.text_of[b]) == [self.text_of[a], self.text_of[b]]
            if len(self._fits) >= FITS_SIZE:
                self._fits.clear()
            self._fits[key] = found
        return found

    # -- paths

    def arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """(end, token) of the pieces that start at i, shortest first."""
        node, j, out = self.trie, i, []
        for c in text[i:i + self.longest]:
            node = node.get(c)
            if node is None:
                break
            j += 1
            token = node.get("")
            if token is not None:
                out.append((j, token))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, -1 - ord(text[i])))
        return out

    def forward(self, text: str, start: int, token: int | None, stop: int) -> dict:
        """Best paths from (start, last token) over all pieces that start before ``stop``.

        node -> state -> (score, previous node, previous state, token); the state is the last token (bpe) or None.
        """
        nodes = {start: {token if self.bpe else None: (0.0, -1, None, None)}}
        bpe, fits, score, unknown = self.bpe, self.fits, self.score, self.v.unknown_score
        for i in range(start, stop):
            states = nodes.get(i)
            if not states:
                continue
            for j, t in self.arcs(text, i):
                weight = 0.0 if bpe else score.get(t, unknown)
                for state, (s, *_) in states.items():
                    if bpe and not fits(state, t):
                        continue
                    to = nodes.setdefault(j, {})
                    key = t if bpe else None
                    if key not in to or s + weight > to[key][0]:
                        to[key] = (s + weight, i, state, t)
        return nodes

    @staticmethod
    def back(nodes: dict, end: int, state: int | None) -> list[int]:
        """The tokens of the best path to a node and state."""
        out = []
        while True:
            _, i, before, t = nodes[end][state]
            if t is None:
                return out[::-1]
            out.append(t)
            end, state = i, before

    def cuts(self, text: str, a: int, b: int) -> list[int]:
        """Nodes in [a, b] that every path passes, given a character on both sides."""
        inner = self.inner
        return [p for p in range(max(a, 1), min(b, len(text) - 1) + 1) if text[p - 1:p + 1] not in inner]

    # -- whole segments

    def tokens(self, text: str) -> list[int]:
        """The best path over a text that starts and ends at a cut."""
        out: list[int] = []
        edges = [0, *self.cuts(text, 1, len(text) - 1), len(text)]
        for a, b in zip(edges, edges[1:]):
            part = text[a:b]
            if self.bpe:
                out += self.only_path(part)
            else:
                nodes = self.forward(part, 0, None, len(part))
                out += self.back(nodes, len(part), None)
        return out

    def only_path(self, text: str) -> list[int]:
        """The one path of a bpe model from cut to cut: the longest piece first, states that lead nowhere once only."""
        end, fits, trie, longest = len(text), self._fits, self.trie, self.longest
        path: list[int] = []
        stack: list[tuple[int, int, list]] = []  # node, key of the token before it, arcs not tried yet
        dead: set[tuple[int, int]] = set()
        i, key = 0, ALONE
        while True:
            node, j, arcs = trie, i, []
            for c in text[i:i + longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                t = node.get("")
                if t is not None:
                    arcs.append((j, t))
            if not arcs or arcs[0][0] != i + 1:
                arcs.insert(0, (i + 1, -1 - ord(text[i])))
            while True:
                while arcs:
                    j, t = arcs.pop()
                    ok = fits.get(key + t)
                    if ok is None:
                        ok = self.fits(None if key == ALONE else key >> 32, t)
                    if ok and (not dead or (j, t) not in dead):
                        break
                else:
                    dead.add((i, path.pop()))
                    i, key, arcs = stack.pop()
                    continue
                break
            path.append(t)
            if j == end:
                return path
            stack.append((i, key, arcs))
            i, key = j, t << 32 if t >= 0 else ALONE

    def to_ids(self, tokens: list[int]) -> bytes:
        """Ids of tokens, as packed int32."""
        if min(tokens, default=0) >= 0:
            return array("i", tokens).tobytes()
        out: list[int] = []
        for k, t in enumerate(tokens):
            if t >= 0:
                out.append(t)
            elif self.v.byte_ids:
                out += [self.v.byte_ids[b] for b in chr(-1 - t).encode()]
            elif k == 0 or tokens[k - 1] >= 0:  # a run of uncovered characters is one unknown piece
                out.append(self.v.unknown_id)
        return array("i", out).tobytes()

    def segment(self, text: str) -> bytes:
        """Ids (int32) of a text between two cuts; short texts and short parts of it are remembered."""
        memo = self._memo
        found = memo.get(text)
        if found is None:
            edges = [0, *self.cuts(text, 1, len(text) - 1), len(text)] if self.v.byte_ids else [0, len(text)]  # a run without byte pieces is one unknown
            if len(edges) > 2:
                parts = [text[a:b] for a, b in zip(edges, edges[1:])]
                found = b"".join([memo.get(p) or self.segment(p) for p in parts])
            else:
                found = self.to_ids(self.only_path(text) if self.bpe else self.tokens(text))
            if len(memo) < MEMO_SIZE:
                if len(text) <= MEMO_LENGTH:
                    memo[text] = found
            else:
                self._missed += 1
                if self._missed >= MEMO_TURN:
                    memo.clear()
                    self._missed = 0
        return found

    def segments(self, text: str) -> bytes:
        """Ids of a normalised text between two cuts, solved from space to space."""
        if not self.spaces_cut:
            return self.segment(text)
        words = text.split(SPACE)
        if words[0]:
            parts, rest = [words[0]], words[1:]
        else:
            parts, rest = [], words[1:]
        if "" in rest:  # runs of spaces belong to the word after them
            lead = ""
            for w in rest:
                if w:
                    parts.append(lead + SPACE + w)
                    lead = ""
                else:
                    lead += SPACE
            if lead:
                parts.append(lead)
        else:
            parts += [SPACE + w for w in rest]
        memo, segment = self._memo, self.segment
        return b"".join([memo.get(p) or segment(p) for p in parts])

    # -- chunks: transfer matrices between boundary states

    def boundary(self, text: str, b: int) -> list[tuple[int, int | None]]:
        """States at node b: (how far the token over b reaches past it, that token), in order.

        The token starts before b and ends at b or later.  Unigram paths need not know the token, nor does
        any path that enters at a cut.
        """
        if self.is_cut(text, b):
            return [(0, None)]
        out = set()
        for s in range(max(0, b - self.longest), b):
            for e, t in self.arcs(text, s):
                if e >= b and (not self.bpe or self.fits(None, t)):
                    out.add((e - b, t if self.bpe else None))
        return sorted(out, key=lambda x: (x[0], ALONE if x[1] is None else x[1]))

    def is_cut(self, text: str, p: int) -> bool:
        return 0 < p < len(text) and text[p - 1:p + 1] not in self.inner

    def head_and_tail(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and last cut in [a, b], if they are two nodes."""
        first = next((p for p in range(a, b + 1) if self.is_cut(text, p)), None)
        if first is None:
            return None
        last = next(p for p in range(b, first - 1, -1) if self.is_cut(text, p))
        return (first, last) if last > first else None

    def transfer(self, text: str, a: int, b: int, ends: bool) -> list[tuple]:
        """Finite entries (in offset, in token, out offset, out token, score) of the chunk [a, b) of a text.

        a = 0 is the start of the document; ``ends``: b is its end.  Between the first and the last cut of a
        chunk there is one state, so its matrix is a column (into the first cut) times a row (out of the last).
        """
        ins = self.boundary(text, a) if a else [(0, None)]
        middle = self.head_and_tail(text, a, b)
        if middle is None:
            return [(o, t, *x) for o, t in ins for x in self._outs(text, self.forward(text, a + o, t, b), b, ends)]
        first, last = middle
        between = self._score(text, first, last)
        column = []
        for o, t in ins:
            found = self.forward(text, a + o, t, first).get(first)
            if found:
                column.append((o, t, max(s for s, *_ in found.values())))
        row = self._outs(text, self.forward(text, last, None, b), b, ends)
        return [(o, t, eo, et, s + between + es) for o, t, s in column for eo, et, es in row]

    def _score(self, text: str, first: int, last: int) -> float:
        if self.bpe:
            return 0.0
        return sum(self.score.get(t, self.v.unknown_score) for t in self.tokens(text[first:last]))

    def _outs(self, text: str, nodes: dict, b: int, ends: bool) -> list[tuple]:
        if ends or self.is_cut(text, b):
            found = nodes.get(b, {})
            return [(0, None, max(s for s, *_ in found.values()))] if found else []
        return [(e - b, t, s) for e, states in nodes.items() if e >= b for t, (s, *_) in states.items()]

    def trace(self, text: str, a: int, b: int, enter: tuple[int, int | None], leave: tuple[int, int | None], ends: bool) -> bytes:
        """Ids of the pieces that start in [a, b), between two known boundary states."""
        o, t = enter
        middle = self.head_and_tail(text, a, b)

        def path(start: int, token: int | None, stop: int, end: int, state) -> bytes:
            nodes = self.forward(text, start, token, stop)
            if state == "any":
                state = max(nodes[end], key=lambda k: nodes[end][k][0])
            return self.to_ids(self.back(nodes, end, state))

        out_state = "any" if ends or self.is_cut(text, b) else leave[1]
        end = b if ends else b + leave[0]
        if middle is None:
            return path(a + o, t, b, end, out_state)
        first, last = middle
        return path(a + o, t, first, first, "any") + self.segments(text[first:last]) + path(last, None, b, end, out_state)


def product(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two sparse matrices of (in offset, in token, out offset, out token, score)."""
    rows: dict[tuple, list] = {}
    for o, t, eo, et, s in b:
        rows.setdefault((o, t), []).append((eo, et, s))
    best: dict[tuple, float] = {}
    for o, t, mo, mt, s in a:
        for eo, et, more in rows.get((mo, mt), ()):
            key = (o, t, eo, et)
            if key not in best or s + more > best[key]:
                best[key] = s + more
    return [(*k, s) for k, s in sorted(best.items(), key=lambda x: tuple(ALONE if y is None else y for y in x[0]))]


def normalise(text: str, prefix: bool) -> str:
    """Spaces become the visible space mark; a dummy one goes before a text that isn't empty."""
    return (SPACE if prefix and text else "") + text.replace(" ", SPACE)


#: ids that are decoded at once
STEP = 1 << 16


def decode(values: np.ndarray, offsets: np.ndarray, raw: np.ndarray, lengths: np.ndarray, starts: np.ndarray, prefix: bool) -> list[str]:
    """Texts of lists of ids (flat values and offsets), by gathering the bytes of their pieces."""
    found, total = [], np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(lengths[values], out=total[1:])
    for at in range(0, len(values), STEP):
        some = values[at:at + STEP]
        n = lengths[some]
        ends = np.cumsum(n)
        found.append(raw[np.arange(ends[-1]) + np.repeat(starts[some] - ends + n, n)].tobytes())
    data, out = b"".join(found), []
    for a, b in zip(total[offsets[:-1]].tolist(), total[offsets[1:]].tolist()):
        text = data[a:b].decode("utf-8", "replace")
        out.append(text[1:] if prefix and text[:1] == " " else text)
    return out
