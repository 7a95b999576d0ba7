"""What a task does to find terms in the words of documents: arrays of a batch's words at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import BLANK, PUNCT

#: How a word of a document can be a piece of a term.
EQUAL, STEM, POSSESSIVE, LAST, FIRST = range(5)
#: A piece that a longer word may begin or end with has so many characters at least.
FUSED = 4
#: Rows of a batch that are looked at together, and candidates that are judged together.
ROWS, TOGETHER = 256, 1 << 18
#: Words of so many characters at most are remembered, and so many of them.
SHORT, REMEMBERED = 64, 1 << 18

SPANS = "array<struct<line_no:int,first:int,last:int,x0:double,x1:double>>"
_SPAN = pa.list_(pa.struct([("line_no", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("x0", pa.float64()), ("x1", pa.float64())]))


def grouped(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, at): the places of value v are order[at[v]:at[v + 1]]."""
    order = np.argsort(values, kind="stable")
    return order, np.searchsorted(values[order], np.arange(size + 1))


def spread(low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): each row's places low, low + 1, ... of which there are `many`."""
    row = np.repeat(np.arange(len(many)), many)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


class Terms:
    """The readings of terms: rows (term_id, readings), a reading being its words and where it is split."""

    def __init__(self, rows: Iterable[dict]):
        self.ids, self.term, self.reading, self.split, words = [], [], [], [], []
        for row in rows:
            for number, r in enumerate(row["readings"]):
                self.term.append(len(self.ids))
                self.reading.append(number)
                self.split.append(r["split"])
                words.append(r["ws"])
            self.ids.append(row["term_id"])
        self.term, self.reading, self.split = (np.array(x, np.int64) for x in (self.term, self.reading, self.split))
        self.n = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        self.pieces: dict[str, int] = {}
        self.flat = np.array([self.pieces.setdefault(w, len(self.pieces)) for ws in words for w in ws], np.int64)
        self.of = np.repeat(np.arange(len(words)), self.n)
        self.off = np.arange(len(self.flat)) - self.at[:-1][self.of] if len(words) else np.zeros(0, np.int64)
        self.spots, self.spots_at = grouped(self.flat, len(self.pieces))
        outer = [(ws[0], ws[-1]) for ws, split in zip(words, self.split, strict=True) if len(ws) > 1 and split < 0]
        self.ends = {w: self.pieces[w] for w, _ in outer if len(w) >= FUSED}
        self.begins = {w: self.pieces[w] for _, w in outer if len(w) >= FUSED}
        # only lengths that some piece has are looked up, however long a word is
        self.end_sizes, self.begin_sizes = (sorted({len(w) for w in some}) for some in (self.ends, self.begins))
        self.known: dict[str, tuple] = {}

    def ways(self, word: str) -> tuple[tuple[int, int], ...]:
        """The pieces (how, piece) that a word of a document can be."""
        found = self.known.get(word)
        if found is None:
            found = tuple(self._ways(word))
            if len(word) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def _ways(self, word: str):
        if (p := self.pieces.get(word)) is not None:
            yield EQUAL, p
        if word[-1:] in "s'":
            stem = word.rstrip("s").rstrip("'")
            if stem != word and (p := self.pieces.get(stem)) is not None:
                yield STEM, p
            if word.endswith("'s") and (p := self.pieces.get(word[:-2])) is not None:
                yield POSSESSIVE, p
        for size in self.end_sizes:
            if size >= len(word):
                break
            if (p := self.ends.get(word[-size:])) is not None:
                yield LAST, p
        for size in self.begin_sizes:
            if size >= len(word):
                break
            if (p := self.begins.get(word[:size])) is not None:
                yield FIRST, p

    def search(self, distinct: list[str], ids: np.ndarray, first: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, reading) of all places, in words of the batch. ids are the words, as places in
        `distinct`; text t's are those from first[t] on; line is each word's line in its text.

        Of each reading only the words are looked at that can be its rarest piece in the batch.
        """
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ways = np.array([(u, how, p) for u, w in enumerate(distinct) for how, p in self.ways(w)], np.int64).reshape(-1, 3)
        if not len(ways):
            return nothing
        word, how, piece = ways.T
        row, place = spread(self.spots_at[piece], self.spots_at[piece + 1] - self.spots_at[piece])
        spot = self.spots[place]
        reading, off, how_, word_ = self.of[spot], self.off[spot], how[row], word[row]
        several, whole = self.n[reading] > 1, self.split[reading] < 0
        can = (how_ == EQUAL) | ((how_ == POSSESSIVE) & ~several) | (several & whole & ((how_ == STEM) | ((how_ == LAST) & (off == 0)) | ((how_ == FIRST) & (off == self.n[reading] - 1))))
        pair = np.unique(word_[can] * len(self.flat) + spot[can])
        word_, spot = pair // len(self.flat), pair % len(self.flat)
        times = np.bincount(ids, minlength=len(distinct))
        weight = np.bincount(spot, weights=times[word_], minlength=len(self.flat))
        best = np.lexsort((weight, self.of))[self.at[:-1]]
        chosen = (best[self.of[spot]] == spot) & (weight[best] > 0)[self.of[spot]]
        word_, spot = word_[chosen], spot[chosen]
        order, anchors = grouped(word_, len(distinct))
        spot, many = spot[order], (anchors[1:] - anchors[:-1])[ids]
        at = np.flatnonzero(many)
        equal, stem, possessive = (np.full(len(distinct), -1) for _ in range(3))
        for into, kind in ((equal, EQUAL), (stem, STEM), (possessive, POSSESSIVE)):
            into[word[how == kind]] = piece[how == kind]
        fused = [np.sort(word[how == kind] * len(self.pieces) + piece[how == kind]) for kind in (LAST, FIRST)]
        out, ends = [], np.cumsum(many[at])
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOGETHER, side="right")))
            some = at[low:high]
            row, place = spread(anchors[ids[some]], many[some])
            out.append(self._judged(some[row], spot[place], ids, first, line, equal, stem, possessive, fused))
            low = high
        if not out:
            return nothing
        return np.concatenate([s for s, _ in out]), np.concatenate([r for _, r in out])

    def _judged(self, anchor, spot, ids, first, line, equal, stem, possessive, fused):
        """Of candidates those where all words of the reading stand."""
        reading, start = self.of[spot], anchor - self.off[spot]
        text = np.searchsorted(first, anchor, side="right") - 1
        fine = (start >= first[text]) & (start + self.n[reading] <= first[text + 1])
        reading, start = reading[fine], start[fine]
        k = 0
        held = np.arange(len(start))
        bad = np.zeros(len(start), bool)
        while len(held := held[(self.n[reading[held]] > k) & ~bad[held]]):
            r, s = reading[held], start[held]
            u, p = ids[s + k], self.flat[self.at[r] + k]
            n, same = self.n[r], line[s + k] == line[s]
            ok = equal[u] == p
            ok |= (n == 1) & (possessive[u] == p)
            loose = (n > 1) & (self.split[r] < 0) & same
            ok |= loose & (stem[u] == p)
            for keys, here in ((fused[0], k == 0), (fused[1], k == n - 1)):
                may = np.flatnonzero(loose & ~ok & here)
                if len(may) and len(keys):
                    key = u[may] * len(self.pieces) + p[may]
                    ok[may] = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            bad[held[~ok]] = True
            k += 1
        cut = np.flatnonzero(~bad & (self.split[reading] >= 0))
        bad[cut] = line[start[cut] + self.split[reading[cut]]] >= line[start[cut] + self.split[reading[cut]] + 1]
        return start[~bad], reading[~bad]


def plain_lines(text: str) -> list[list[str]]:
    """What `matching.lines_of_words` gives, for a text in which no character may change (`text.MAY_CHANGE`)."""
    out = []
    for line in text.lower().split("\n"):
        words = [x for w in line.strip(BLANK).strip(PUNCT).split(" ") if (x := w if w.isalnum() else w.strip(BLANK).strip(PUNCT))]
        if words:
            out.append(words)
    return out


class Page:
    """Words of some texts in a row, from a list column of lines of words; with `texts`, of those
    that are there, and of the lines where a text is null."""

    def __init__(self, lines: pa.Array, texts: pa.Array | None = None):
        if texts is None:
            n_lines = pc.fill_null(pc.list_value_length(lines), 0).to_numpy().astype(np.int64)
            of_line = lines.flatten()
            n_words = pc.fill_null(pc.list_value_length(of_line), 0).to_numpy().astype(np.int64)
            self.words = of_line.flatten()
        else:
            held = [plain_lines(t) if t is not None else odd.as_py() or [] for t, odd in zip(texts.to_pylist(), lines, strict=True)]
            n_lines = np.fromiter(map(len, held), np.int64, len(held))
            n_words = np.fromiter((len(ws) for ls in held for ws in ls), np.int64)
            self.words = pa.array([w for ls in held for ws in ls for w in ws], pa.string())
            del held
        self.n_lines, self.n_words = n_lines, n_words
        coded = pc.dictionary_encode(self.words)
        self.distinct, self.ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        line_at = self.line_at = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        text_at = np.concatenate([[0], np.cumsum(n_lines)]).astype(np.int64)
        self.first = line_at[text_at]
        of = np.repeat(np.arange(len(n_words)), n_words)
        self.line = of - np.repeat(text_at[:-1], n_lines)[of]
        self.pos = np.arange(len(of)) - line_at[:-1][of]
        sizes = pc.utf8_length(self.words).to_numpy().astype(np.int64) if len(of) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes + 1)
        self.x0 = ends - sizes - 1 - (ends - sizes - 1)[line_at[:-1][of]] if len(of) else sizes
        self.x1 = self.x0 + sizes

    def spans(self, start: np.ndarray, n: np.ndarray) -> pa.Array:
        """Of each place the first and the last word on each line that it touches."""
        row, at = spread(start, n)
        begins = np.ones(len(row), bool)
        begins[1:] = (row[1:] != row[:-1]) | (self.line[at][1:] != self.line[at][:-1])
        a = np.flatnonzero(begins)
        b = np.append(a, len(row))[1:] - 1
        columns = [pa.array(self.line[at[a]], pa.int32()), pa.array(self.pos[at[a]], pa.int32()), pa.array(self.pos[at[b]], pa.int32()), pa.array(self.x0[at[a]].astype(np.float64)), pa.array(self.x1[at[b]].astype(np.float64))]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[a], minlength=len(start)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_SPAN.value_type)))


def _searched(batches):
    """Batches of (key, texts, lines, sent, own) in parts, each with the terms that are sought in it. `sent`, on a
    task's first row, has the terms that are sought in all texts; `own` those of the row's own."""
    sent = None
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            if "own" in part.schema.names:
                for i in range(part.num_rows):
                    yield part.slice(i, 1), Terms(part.column("own")[i].as_py())
                continue
            if sent is None:
                sent = Terms(part.column("sent")[0].as_py() or [])
            yield part, sent


def locate(key: str, batches):
    """Batches of (key, texts, lines, sent, own) to places."""
    for part, terms in _searched(batches):
        yield _places(key, part, terms)


def _covered(part: pa.RecordBatch, terms: Terms) -> tuple[Page, np.ndarray]:
    """The words of a part, and which of them some place of a term covers."""
    page = Page(part.column("lines"), part.column("texts"))
    start, reading = terms.search(page.distinct, page.ids, page.first, page.line)
    size = len(page.ids) + 1
    step = np.bincount(start, minlength=size) - np.bincount(start + terms.n[reading], minlength=size)
    return page, np.cumsum(step)[:-1] > 0


def masked(key: str, mark: str, batches):
    """Batches of (key, texts, lines, sent) to all their lines, words that a place of a term covers
    replaced by marks: (key, line_no, text, n_masked)."""
    for part, terms in _searched(batches):
        page, covered = _covered(part, terms)
        sizes = pc.utf8_length(page.words)
        shown = pc.if_else(pa.array(covered), pc.binary_repeat(pa.scalar(mark), sizes), page.words)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(page.line_at, pa.int32()), shown), " ")
        row, number = spread(np.zeros(len(page.n_lines), np.int64), page.n_lines)
        counts = np.diff(np.concatenate([[0], np.cumsum(covered)])[page.line_at])
        yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array(number, pa.int32()), text, pa.array(counts, pa.int32())], names=[key, "line_no", "text", "n_masked"])


def word_counts(batches):
    """Batches of (counted, texts, lines) to the distinct words of some texts together: (word, n, n_docs, first_at),
    n_docs the texts with the word that are `counted`, first_at its least place in a text."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4 * ROWS):
            part = batch.slice(low, 4 * ROWS)
            page = Page(part.column("lines"), part.column("texts"))
            if not len(page.ids):
                continue
            size = len(page.distinct)
            text = np.repeat(np.arange(part.num_rows), np.diff(page.first))
            pair, at = np.unique(text * size + page.ids, return_index=True)
            text, word = pair // size, pair % size
            first = np.full(size, np.iinfo(np.int64).max)
            np.minimum.at(first, word, at - page.first[text])
            counted = part.column("counted").to_numpy(zero_copy_only=False).astype(np.float64)[text]
            columns = [pa.array(page.distinct, pa.string()), *(pa.array(x.astype(np.int64)) for x in (np.bincount(page.ids, minlength=size), np.bincount(word, weights=counted, minlength=size))), pa.array(first, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_docs", "first_at"])


def masked_words(key: str, batches):
    """Batches of (key, texts, lines, sent) to the number of each text's words that a place of a term covers."""
    for part, terms in _searched(batches):
        page, covered = _covered(part, terms)
        counts = np.diff(np.concatenate([[0], np.cumsum(covered)])[np.append(page.first, len(covered))[: part.num_rows + 1]])
        yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64())], names=[key, "n_masked"])


def box_counts(batches):
    """Batches of (texts, lines, sent) to (term_id, boxes): the lines that places of each term touch, summed over a part's
    texts; terms without a place have no row."""
    for part, terms in _searched(batches):
        page = Page(part.column("lines"), part.column("texts"))
        start, reading = terms.search(page.distinct, page.ids, page.first, page.line)
        # a place's words are in a row, and each line has words, so that it touches all lines between its ends
        lines = page.line[start + terms.n[reading] - 1] - page.line[start] + 1
        boxes = np.bincount(terms.term[reading], weights=lines, minlength=len(terms.ids)).astype(np.int64)
        some = np.flatnonzero(boxes)
        ids = pa.array(terms.ids, part.schema.field("term_type").type)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(boxes[some])], names=["term_id", "boxes"])


def line_sizes(key: str, batches):
    """Batches of (key, texts, lines) to the number of words of each of a text's lines: (key, sizes)."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            held = [[len(ws) for ws in (plain_lines(t) if t is not None else odd.as_py() or [])] for t, odd in zip(part.column("texts").to_pylist(), part.column("lines"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(held, pa.list_(pa.int32()))], names=[key, "sizes"])


def covered_words(key: str, batches):
    """Batches of (key, sizes, spans) to the number of words that some span (line_no, first, last) covers: (key, n).
    What is beyond a line, or null, covers nothing."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            counts = []
            for sizes, spans in zip(part.column("sizes"), part.column("spans"), strict=True):
                sizes = np.array(sizes.as_py(), np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                whole = [s for s in ((x["line_no"], x["first"], x["last"]) for x in spans.as_py()) if None not in s]
                line, first, last = np.array(whole, np.int64).reshape(-1, 3).T
                there = (line >= 0) & (line < len(sizes))
                line, first, last = line[there], np.maximum(first[there], 0), last[there]
                first, end = at[line] + first, at[line] + np.minimum(last, sizes[line] - 1) + 1
                first, end = first[first < end], end[first < end]
                step = np.bincount(first, minlength=at[-1] + 1) - np.bincount(end, minlength=at[-1] + 1)
                counts.append(int((np.cumsum(step) > 0).sum()))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64())], names=[key, "n"])


def _places(key: str, part: pa.RecordBatch, terms: Terms) -> pa.RecordBatch:
    page = Page(part.column("lines"), part.column("texts"))
    start, reading = terms.search(page.distinct, page.ids, page.first, page.line)
    text = np.searchsorted(page.first, start, side="right") - 1
    kind = part.schema.field("term_type").type
    ids = pa.array(terms.ids, kind)
    columns = [
        part.column(key).take(pa.array(text)), ids.take(pa.array(terms.term[reading])), pa.array(terms.reading[reading], pa.int32()), pa.array(start - page.first[text], pa.int32()),
        pa.array(terms.n[reading], pa.int32()), page.words.take(pa.array(start)), page.spans(start, terms.n[reading]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[key, "term_id", "reading", "start", "n", "word", "spans"])


def contained(keys: list[str], string_key: str, batches):
    """Batches of (keys, forms, sent) to the pairs of a row and each string that a form of it has:
    one automaton of all strings goes through each form once."""
    import ahocorasick

    automaton, found_type = None, None
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            if automaton is None:
                automaton, names = ahocorasick.Automaton(), {}
                for row in part.column("sent")[0].as_py() or []:
                    names.setdefault(row["string"], []).append(row["id"])
                for string, ids in names.items():
                    automaton.add_word(string, ids)
                automaton.make_automaton()
                found_type = part.schema.field("term_type").type
            rows, found = [], []
            for i, forms in enumerate(part.column("forms").to_pylist() if len(automaton) else []):
                held = {}
                for form in dict.fromkeys(f for f in forms or [] if f):
                    for _, ids in automaton.iter(form):
                        held[id(ids)] = ids
                for ids in held.values():
                    rows += [i] * len(ids)
                    found += ids
            columns = [part.column(k).take(pa.array(rows, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, found_type)], names=[*keys, string_key])


def boxed(key: str, batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows (key, words, plain, own) to (key, term_id, start, at, box) of the words that each place of an own term covers.

    Of a row's words only those of its terms are indexed, and a term is sought by its rarest one.
    """
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            batch = whole.slice(first, ROWS)
            words = batch.column("words")
            rows, ids, starts, places = [], [], [], []
            for row, (plain, own, low) in enumerate(zip(batch.column("plain"), batch.column("own"), words.offsets.to_pylist(), strict=False)):
                own, plain = own.as_py(), plain.as_py()
                kept = [j for j, w in enumerate(plain) if w is not None]
                said = [plain[j] for j in kept]
                where: dict[str, list[int]] = {w: [] for t in own for w in t["ws"]}
                for j, w in enumerate(said):
                    if w in where:
                        where[w].append(j)
                for t in own:
                    ws, n = t["ws"], len(t["ws"])
                    off = min(range(n), key=lambda k: len(where[ws[k]]))  # noqa: B023
                    for start in (j - off for j in where[ws[off]]):
                        if start >= 0 and said[start : start + n] == ws:
                            rows += [row] * n
                            ids += [t["term_id"]] * n
                            starts += [start] * n
                            places += [low + j for j in kept[start : start + n]]
            if rows:
                at, box = (pc.struct_field(words.values, c).take(pa.array(places, pa.int64())) for c in ("at", "box"))
                term_type = batch.schema.field("own").type.value_type.field("term_id").type
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(ids, term_type), pa.array(starts, pa.int32()), at, box], names=[key, "term_id", "start", "at", "box"])
