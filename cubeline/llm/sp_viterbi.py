"""SentencePiece encoding and decoding by a streaming Viterbi search.

A model file gives pieces and scores; the best segmentation is the path of the highest sum of
scores.  `Stream` takes text in portions of any size.  It keeps the scores and backpointers of
the positions that some piece may still reach, and commits ids as soon as every surviving
backpointer path runs through one boundary: at once where no piece crosses the position, and
otherwise, once the backlog is a few longest pieces long, at the last boundary the paths share.
Memory is thus bounded by the longest piece, not by the text, as long as paths meet (paths of
such models meet within a few pieces).

Characters that no piece covers become byte pieces where the model has them, else the unknown
id.  Ties go to the longer last piece.  Scores are added as 64-bit floats, from 0 at each
committed boundary on, so that portions of any size give the same ids.

Texts are normalised as the file says for the identity rule: a dummy space in front if asked
for, spaces as U+2581.  Files with other rules are refused, as is decoding by guesswork:
`decode` undoes exactly this, and unknown ids give U+2047 with spaces around.

In most models no piece holds a space after another character.  Each run of spaces with the
word behind it then starts and ends at a boundary that all paths share, so its ids depend on
itself alone.  Every such word goes through a `Stream`; the ids of words no longer than the
longest piece are remembered (a bounded memory), so that a common word is searched once.

The public model file is of BPE kind; its ids by merging are another segmentation.  These are
those of the best path in the library's list when the same pieces and scores are loaded as a
unigram model.

Null text is empty and has no ids.  Repeated rows give equal values.  Texts of any length are
encoded whole.  An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import joined_parts, whole_text

SPACE = "▁"
#: Words kept in memory; none is longer than the longest piece.
WORDS = 400_000
_WORST = float("-inf")
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")


def _fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """The fields of a protocol buffer message: number, wire type, value."""
    i = 0

    def varint():
        nonlocal i
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(b):
        k = varint()
        w = k & 7
        if w == 0:
            yield k >> 3, w, varint()
        else:
            n = varint() if w == 2 else 4 if w == 5 else 8
            yield k >> 3, w, b[i : i + n]
            i += n


class Model:
    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        spec: dict[int, int | bytes] = {}
        self.dummy, squeeze, escape, rules = True, True, True, b""
        for f, _, v in _fields(open(path, "rb").read()):
            if f == 1:
                spec = {n: x for n, _, x in _fields(v)}
                self.pieces.append(spec.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", spec[2])[0] if 2 in spec else 0.0)
                self.kinds.append(spec.get(3, _NORMAL))
            elif f == 3:
                norm = {n: x for n, _, x in _fields(v)}
                rules, self.dummy, squeeze, escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if rules or squeeze or not escape:
            raise ValueError("only the identity normaliser is supported")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == _NORMAL]
        top = max(normal)
        self.unknown_score = min(normal) - 10
        #: Each prefix of a piece, with the piece's id and score where it is one.
        self.trie: dict[str, tuple[int, float] | None] = {}
        self.longest = 1
        for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)):
            if k in (_NORMAL, _USER) and p:
                self.longest = max(self.longest, len(p))
                for n in range(1, len(p)):
                    self.trie.setdefault(p[:n], None)
                self.trie[p] = (i, len(p) * top - 0.1 if k == _USER else s)
        #: The same by single characters: what follows, and under 0 the piece that ends here.
        self.root: dict = {}
        for p, hit in self.trie.items():
            if hit:
                node = self.root
                for c in p:
                    node = node.setdefault(c, {})
                node[0] = hit
        self.by_word = not any(k in (_NORMAL, _USER) and re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(self.pieces, self.kinds, strict=True))
        self.known: dict[str, bytes] = {}
        self.stream = Stream(self)
        self.surface = [
            bytes((int(p[3:5], 16),)) if k == _BYTE else " ⁇ ".encode() if k == _UNKNOWN else b"" if k == 3 else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def normal(self, text: str) -> str:
        return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        s = self.normal(text)
        if not self.by_word:
            return _ids(self, s)
        known = self.known
        out = []
        for w in _WORD.findall(s):
            got = known.get(w)
            if got is None:
                got = _ids(self, w)
                if len(w) <= self.longest:
                    if len(known) >= WORDS:
                        known.clear()
                    known[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> str:
        surface = self.surface
        b = b"".join([surface[i] for i in ids])
        return (b[1:] if self.dummy and b.startswith(b" ") else b).decode("utf-8", "replace")


def _ids(model: Model, s: str) -> bytes:
    st = model.stream
    st.feed(s)
    return st.finish().tobytes()


class Stream:
    """Encodes normalised text portion by portion; `take` and `finish` return committed ids.

    What is kept between portions is the text, scores and backpointers from the last committed
    boundary on: the paths' window and the portion ahead of it.
    """

    def __init__(self, model: Model):
        self.m = model
        self.text = ""  # from the last committed boundary on
        self.pos = 0  # starts before it are done
        self.far = 0  # the furthest position that some path reaches
        self.best, self.back = [0.0], [(0, -1)]  # by position
        self.out = array("i")
        self.commits = 0
        self.widest = 0  # most positions ever open at once

    def feed(self, portion: str) -> None:
        self.text += portion
        self._run(len(self.text) - self.m.longest)  # each start needs its longest piece's text ahead

    def finish(self) -> array:
        self._run(len(self.text))
        if self.text:
            self._commit(0, len(self.text))
        self.text, self.pos, self.far, self.best, self.back = "", 0, 0, [0.0], [(0, -1)]
        return self.take()

    def take(self) -> array:
        """The ids committed since the last call."""
        out, self.out = self.out, array("i")
        return out

    def _run(self, stop: int) -> None:
        """Takes every start before `stop`, which have their longest piece's text (or the text's end) ahead."""
        p, far, done = self.pos, self.far, 0
        if p >= stop:
            return
        text, root, low, longest = self.text, self.m.root, self.m.unknown_score, self.m.longest
        n = len(text)
        best, back = self.best, self.back
        best += [_WORST] * (n + 1 - len(best))
        back += [(0, -1)] * (n + 1 - len(back))
        while p < stop:
            if p == far:  # no piece crosses: all surviving paths run through here
                if p > done:
                    self._commit(done, p)
                    done = p
                    best[p] = 0.0
            elif p - done > 4 * longest and not (p - done) % longest and (meet := self._meet(p, far, done)) > done:
                self.widest = max(self.widest, far - done)
                self._commit(done, meet)
                done, less = meet, best[meet]
                for k in range(meet, far + 1):
                    best[k] -= less
            here, single, node, e = best[p], False, root, p
            while e < n:
                node = node.get(text[e])
                if node is None:
                    break
                e += 1
                hit = node.get(0)
                if hit:
                    score = here + hit[1]
                    if score > best[e]:
                        best[e] = score
                        back[e] = (p, hit[0])
                        if e > far:
                            far = e
                    if e == p + 1:
                        single = True
            if not single and here + low > best[p + 1]:
                best[p + 1] = here + low
                back[p + 1] = (p, -1)
                if p >= far:
                    far = p + 1
            p += 1
        self.widest = max(self.widest, far - done)
        if done:
            self.text = text[done:]
            self.best = best[done : far + 1]
            self.back = [(start - done, i) for start, i in back[done : far + 1]]
        self.pos, self.far = p - done, far - done

    def _meet(self, p: int, far: int, done: int) -> int:
        """The last boundary that the paths to all positions still open share."""
        back, live = self.back, {e for e in range(p, far + 1) if self.best[e] > _WORST}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top][0] if top > done else done)
        return live.pop()

    def _commit(self, done: int, e: int) -> None:
        """Commits the ids of the best path from the boundary `done` to the boundary `e`."""
        self.commits += 1
        m, back, path, at = self.m, self.back, [], e
        while at > done:
            start, i = back[at]
            if i < 0:
                raw = self.text[start:at].encode("utf-8", "surrogatepass")
                path += [m.byte.get(b, m.unknown) for b in reversed(raw)] if m.byte else [m.unknown]
            else:
                path.append(i)
            at = start
        path.reverse()
        self.out.extend(path)
        if e - done > self.widest:
            self.widest = e - done


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids."""

    def run(batches):
        m = model(path)
        for b in batches:
            ids = [array("i", m.encode(t)).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return joined_parts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null."""

    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if i is None else m.decode(i) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text)."""

    def run(batches):
        m = model(path)
        for b in batches:
            n, sha, same = [], [], []
            for t in b.column("text").to_pylist():
                raw = m.encode(t)
                n.append(len(raw) // 4)
                sha.append(hashlib.sha256(raw).hexdigest())
                same.append(m.decode(array("i", raw)) == t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same)], ["doc_id", "n_ids", "ids_sha256", "round_trip"])

    base = joined_parts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")
