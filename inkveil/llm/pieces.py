"""SentencePiece encoding and decoding by a streaming Viterbi search over a public vocabulary."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back
from .quality_rules import piece_model

SPACE = "▁"


class Vocabulary:
    """Pieces with scores; what no piece covers becomes bytes.

    The public vocabulary was made by merging pairs, the best-scored first. A sequence of
    pieces is the one that merging gives just when merging leaves each two neighbours
    apart (`apart`), so that paths through the pieces of a text can be told right from
    wrong piece by piece. Pieces are held with spaces for the space piece's character.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        pieces = {p.replace(SPACE, " "): known for p, known in pieces.items()}
        self.pieces, self.byte_ids = pieces, byte_ids
        self.rank = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: -pieces[p][1]))}
        spaced = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.spaced = [spaced.get(i, b"") for i in range(max(spaced, default=-1) + 1)]
        self.usable, self.rights, self.lefts = {}, {}, {}
        for p in sorted(pieces, key=len):
            parts, last = self._merges(p)
            if len(parts) == 1:
                self.usable[p] = pieces[p][0]
                self._edges(p, last)
        self.longest = max(map(len, self.usable), default=1)
        # what a piece ends with: its id if it is a piece itself, else -1
        self.endings = dict.fromkeys((p[k:] for p in self.usable for k in range(len(p))), -1) | self.usable
        # a text falls apart before a space, and around a line feed, if no piece goes on past it
        inner = any(" " in p.lstrip(" ") for p in pieces)
        alone = "" if any("\n" in p for p in pieces if len(p) > 1) else "\n"
        pattern = ".+" if inner else f"{alone}| *[^ {alone}]+| +" if alone else " *[^ ]+| +"
        self.split = re.compile(pattern, re.DOTALL).findall

    def _edges(self, piece: str, last: tuple[str, str] | None) -> None:
        """What stands at a piece's right and left edge while merging makes it, the whole first:
        (text, when it is made, when it is merged further). Letters are there from the start."""
        never = len(self.rank)
        for edges, side in ((self.rights, 1), (self.lefts, 0)):
            if last is None or last[0] not in self.usable or last[1] not in self.usable:
                edges[piece] = [(piece, -1, never)]
                continue
            made = max(self.rank[piece], *(self.rights[q][0][1] for q in last))
            inner = edges[last[side]]
            edges[piece] = [(piece, made, never), (inner[0][0], inner[0][1], made), *inner[1:]]

    def _merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """A short text's pieces by merging, best score first, the leftmost of equals; and the last two merged."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                known = self.rank.get(parts[k] + parts[k + 1])
                if known is not None and (best is None or known < best):
                    best, at = known, k
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def bytes_of(self, i: int | None) -> bytes:
        """The text of an id as UTF-8."""
        return self.spaced[i] if i is not None and 0 <= i < len(self.spaced) else b""

    def merged(self, text: str) -> list[str]:
        return self._merges(text)[0]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces as they are: back in time, what stood at
        their edges together was never merged, as it is no piece or one that comes later than
        what each of them was merged into. Of equals the leftmost is merged first."""
        a, b, rank = self.rights[left], self.lefts[right], self.rank
        i = j = 0
        while True:
            x, made_x, until_x = a[i]
            y, made_y, until_y = b[j]
            met = rank.get(x + y)
            if met is not None and met < until_x and met <= until_y:
                return False
            if made_x > made_y:
                i += 1
            elif made_y >= 0:
                j += 1
            else:
                return True

    @classmethod
    def of(cls, path: str | None) -> Vocabulary:
        model = piece_model(path)
        pieces, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = (i, model.get_score(i))
        return cls(pieces, byte_ids)


class Encoder:
    """Texts to ids by one streaming search, and back.

    The search goes left to right. The best path to each position ends in the piece that
    merging keeps apart from the piece before it, and there is one such path: it is told
    without adding up scores, which a vocabulary made by merging does not rank paths by. A
    piece to come begins within `longest` characters of the front, so that only a window
    of positions is open; as soon as the backpointer paths from all of them converge on
    one boundary, what lies before it is committed.

    No piece goes on past the boundary before a word, so that all paths converge there;
    what stands between two such boundaries is searched once and remembered as packed
    ids, in a memory of `most` bytes that starts over when it is full. The open positions
    of the last search are kept: a text that begins like the last one goes on from where
    they part, so that texts are searched in order of their characters.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 64_000_000):
        self.vocabulary, self.most = vocabulary, most
        # what stands for a character that is the space piece itself, which no boundaries give
        self.raw = {"": np.array([vocabulary.byte_ids[b] for b in SPACE.encode()], np.int32).tobytes()}
        self.known: dict[str, bytes] = dict(self.raw)
        self.before: dict[str, bytes] = {}  # what was known when the memory last started over
        self.used = 0
        self.pairs: dict[int, bool] = {}  # whether pieces are apart, by both ids
        self.last: tuple[str, list[int], list[int]] = ("", [0], [-1])  # the last text with its open positions

    def stream(self, text: str) -> list[list[int]]:
        """Ids of a text, in the lists in which they were committed; a space is the space piece."""
        out: list[list[int]] = []
        self._search(text.replace(SPACE, " "), out.append)
        return out

    def _search(self, text: str, commit) -> None:
        """One search from left to right; `commit` gets ids as soon as they are certain."""
        v, pairs = self.vocabulary, self.pairs
        ending, longest, many = v.endings.get, v.longest, len(v.spaced)
        before, sizes, ids = self.last  # the last piece of the best path to each open position, from `done` on; -1 is no piece
        alike = 0
        for x, y in zip(before, text):
            if x != y:
                break
            alike += 1
        alike = min(alike, len(sizes) - 1)
        del sizes[alike + 1 :], ids[alike + 1 :]
        done, check, n = 0, 2 * longest, len(text)
        for end in range(alike + 1, n + 1):
            begin = end - 1
            piece = text[begin:end]
            size, chosen = 1, -1
            while (known := ending(piece)) is not None:
                if known >= 0:
                    left = ids[begin - done]
                    if left < 0:
                        size, chosen = end - begin, known
                        break
                    key = left * many + known
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= 150_000:
                            pairs.clear()
                        fits = pairs[key] = v.apart(text[begin - sizes[begin - done] : begin], piece)
                    if fits:
                        size, chosen = end - begin, known
                        break
                if begin == done:
                    break
                begin -= 1
                piece = text[begin:end]
            sizes.append(size)
            ids.append(chosen)
            if end >= check:
                shared = self._converged(sizes, done, range(max(done, end - longest), end + 1))
                if shared > done:
                    commit(self._ids(text, sizes, ids, done, shared))
                    sizes, ids, done = sizes[shared - done :], ids[shared - done :], shared
                check = end + longest
        # positions are kept from the text's beginning on, or none
        self.last = (text, sizes, ids) if not done else ("", [0], [-1])
        if n > done:
            commit(self._ids(text, sizes, ids, done, n))

    @staticmethod
    def _converged(sizes: list[int], done: int, heads) -> int:
        """The last boundary on the paths to all of these positions."""
        held = set(heads)
        while len(held) > 1:
            front = max(held)
            held.discard(front)
            held.add(max(done, front - sizes[front - done]))
        return held.pop()

    def _ids(self, text: str, sizes: list[int], ids: list[int], begin: int, end: int) -> list[int]:
        """Ids of the committed path between two boundaries."""
        out, first = [], begin
        while end > begin:
            known, size = ids[end - first], sizes[end - first]
            if known >= 0:
                out.append(known)
            else:
                out += [self.vocabulary.byte_ids[x] for x in reversed(text[end - size : end].encode())]
            end -= size
        out.reverse()
        return out

    def _between(self, text: str) -> bytes:
        """Packed ids of what stands between two boundaries on which all paths converge."""
        found = array("i")
        self._search(text, found.extend)
        return found.tobytes()

    def _cut(self, text: str | None) -> list[str]:
        """A text between boundaries, with a space put before it; "" stands for a character
        that is itself the space piece."""
        if not text:
            return []
        first, *more = text.split(SPACE)
        out = self.vocabulary.split(" " + first)
        for plain in more:
            out.append("")
            out += self.vocabulary.split(plain)
        return out

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of some texts, 4 bytes an id. A character that is itself the space piece is given as bytes."""
        cut = [self._cut(t) for t in texts]
        known, before = self.known, self.before
        long = []
        for part in sorted(set().union(*cut).difference(known)):
            found = known[part] = before.get(part) or self._between(part)
            size = 150 + 4 * len(part) + len(found)
            if size < 4096:
                self.used += size
            else:
                long.append(part)  # hardly comes again
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for part in long:
            del known[part]
        if self.used > self.most // 2:
            self.before, self.known, self.used = known, dict(self.raw), 0
        return out

    def forget(self) -> None:
        """Give up the memory of what was met."""
        self.known, self.before, self.used = dict(self.raw), {}, 0

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ids: bytes in a row are read as UTF-8, the space put before is taken
        off, ids that stand for no text are passed over."""
        if ids is None:
            return ""
        return self._text(map(self.vocabulary.bytes_of, ids))

    @staticmethod
    def _text(pieces) -> str:
        text = b"".join(pieces).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(Vocabulary.of(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every document (doc_id, text) with the piece vocabulary at `path`.

    Returns doc_id, n_tokens, ids, round_trip (decoding gives the text again): a row for
    each row of docs. A null or empty text has no ids and round_trip true; other columns
    are ignored. A narrow stage: no shuffle; the memory of a task is a batch, the memory of what was met and the window.
    """

    def run(batches):
        e = encoder(path)
        spaced = e.vocabulary.spaced.__getitem__  # of ids that were just made
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                packed = [np.frombuffer(p, np.int32) for p in e.packed(texts)]
                same = [e._text(map(spaced, i.tolist())) == (t or "") for i, t in zip(packed, texts, strict=True)]
                sizes = np.array([len(i) for i in packed], np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(packed)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), ids, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])
        e.forget()

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The texts of ids (doc_id, ids); null ids give an empty text."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([e.decode(i) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
