"""Locating terms in documents: one pass over the words for terms of all, or a join for a document's own."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAY_CHANGE, collapsed, fused_after, fused_before, normalised_words, token_equals
from . import locator
from .layout import LINE_HEIGHT, line_top, page_of


def term_words(terms: DataFrame, *more: str) -> DataFrame:
    """(term_id, term) to (term_id, term, n, off, word), with `more` columns."""
    words = terms.withColumn("ws", normalised_words(F.col("term"))).filter(F.size("ws") > 0)
    return words.select(*more, "term_id", "term", F.size("ws").alias("n"), F.posexplode("ws").alias("off", "word"))


#: Bytes of terms that are sent to all tasks at most; more are to be dealt into blocks, or joined by document.
SENT = 8 << 20


def _sent(rows: DataFrame, columns: Column, size: Column, most: int) -> Column:
    """All rows as one array, a scalar of the plan: gathered when the plan runs, and only if
    `size` summed over the rows is `most` at most; else the plan fails and says so."""
    total = F.coalesce(rows.agg(F.sum(size).alias("size")).scalar(), F.lit(0))
    small = F.when(total <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} bytes of terms to send: deal them into blocks")).cast("boolean"))
    return rows.filter(small).agg(F.collect_list(columns).alias("rows")).scalar()


def _on_first_rows(value: Column) -> Column:
    """value on the first row of each part, null on the others."""
    return F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, value)


def _dealt(rows: DataFrame, blocks: int) -> list[DataFrame]:
    """rows in blocks by hash; one block is the rows themselves."""
    if blocks == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)) == b) for b in range(blocks)]


def containing(texts: DataFrame, keys: list[str], forms: str, strings: DataFrame, string_key: str, string: str, blocks: int = 1, most: int = SENT) -> DataFrame:
    """Pairs (keys, string_key) where one of the text's `forms` has the string, character by character.

    One automaton over all strings goes through each form once, so that the work is linear in
    the texts, whatever the length of words and strings. Strings of spaces alone are left out.
    Of the strings `most` bytes at most are sent to the tasks; more are to be dealt into
    `blocks`, each of which reads the texts.
    """
    types = {**dict(texts.dtypes), **dict(strings.dtypes)}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, string_key])
    out = None
    for block in _dealt(strings.select(F.col(string_key).alias("id"), F.col(string).alias("string")).filter("trim(string) <> ''"), blocks):
        sent = _sent(block, F.struct("string", "id"), F.octet_length("string") + 16, most)
        held = texts.select(*keys, F.col(forms).alias("forms"), _on_first_rows(sent).alias("sent"), F.lit(None).cast(types[string_key]).alias("term_type"))
        one = held.mapInArrow(partial(locator.contained, keys, string_key), schema)
        out = one if out is None else out.unionByName(one)
    return out


def prefilter(pages: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs (key, page_no, term_id) where the term may stand on the page or go on to the next.

    pages (key, page_no, raw_text, next_text). A term's white space is collapsed; it may
    stand anywhere, within words too. The page and the next are looked at as one text, with
    line feeds as spaces, and a hyphen at a line's end as it is, joined to what follows, or
    taken out.
    """
    both = F.concat_ws("\n", "raw_text", "next_text")
    flat = lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    held = pages.select(key, "page_no", F.array(flat(both), flat(F.replace(both, F.lit("-\n"), F.lit("-"))), flat(F.replace(both, F.lit("-\n"), F.lit("")))).alias("forms"))
    wanted = terms.select("term_id", collapsed(F.col("term")).alias("term"))
    return containing(held, [key, "page_no"], "forms", wanted, "term_id", "term")


def readings(term: Column) -> Column:
    """The ways in which a term can stand as words, an array of (ws, split).

    The first has its words. For each hyphen within a word there is one more, where a line
    ends after the part before the hyphen: that part and the rest are words of their own,
    at `split` and after it. None for a term without words.
    """
    ws = normalised_words(term)
    cuts = F.flatten(F.transform(ws, lambda w, i: F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(w) - 1)), lambda k: F.substring(w, k, F.lit(1)) == "-"), lambda k: F.struct(i.alias("split"), k.alias("at")))))
    in_two = lambda c: F.concat(
        F.slice(ws, F.lit(1), c["split"]),
        F.array(F.substring(F.get(ws, c["split"]), F.lit(1), c["at"] - 1), F.substring(F.get(ws, c["split"]), c["at"] + 1, F.length(F.get(ws, c["split"])))),
        F.slice(ws, c["split"] + 2, F.size(ws)),
    )
    plain = F.array(F.struct(ws.alias("ws"), F.lit(-1).alias("split")))
    return F.when(F.size(ws) > 0, F.concat(plain, F.transform(cuts, lambda c: F.struct(in_two(c).alias("ws"), c["split"].alias("split")))))


def lines_of_words(text: Column) -> Column:
    """A text's lines that have words, each as its words; none for a null."""
    held = F.filter(F.transform(F.split(text, "\n"), normalised_words), lambda w: F.size(w) > 0)
    return F.coalesce(held, F.array().cast("array<array<string>>"))


def texts_or_lines(text: Column) -> list[Column]:
    """A text as a task takes it: as it is, if no character of it may change, so that its words are
    taken there; else its lines of words."""
    odd = text.rlike(MAY_CHANGE)
    return [F.when(~odd, text).alias("texts"), F.when(odd, lines_of_words(text)).alias("lines")]


def word_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, n, n_docs, first_at) of each word: its places, the keys that have it, and its least place in a text.

    A task counts the distinct words of some texts together, and counts alone are moved. What
    has one key in several rows is counted a key and a word as well, and taken off: whether there is such
    a key is asked first, now, and only then are its texts moved. A null key is no key.
    """
    counts = lambda some: some.select(F.col(key).isNotNull().alias("counted"), *texts_or_lines(F.col("text"))).mapInArrow(locator.word_counts, "word string, n long, n_docs long, first_at int")
    found = counts(docs)
    twice = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(key)
    if not twice.isEmpty():
        words = F.explode(F.array_distinct(F.flatten("lines"))).alias("word")
        again = docs.join(twice, key, "left_semi").select(key, lines_of_words(F.col("text")).alias("lines")).select(key, words).groupBy(key, "word").agg(F.count("*").alias("rows")).filter("rows > 1")
        found = found.unionByName(again.select("word", F.lit(0).cast("long").alias("n"), (1 - F.col("rows")).alias("n_docs"), F.lit(None).cast("int").alias("first_at")))
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.min("first_at").alias("first_at"))


def _held(docs: DataFrame, terms: DataFrame, key: str, most: int) -> DataFrame:
    """Texts, and the terms that are sought in all of them, sent to the tasks."""
    read = terms.select("term_id", readings(F.col("term")).alias("readings"), "term").filter("readings IS NOT NULL")
    sent = _sent(read, F.struct("term_id", "readings"), F.octet_length("term") * F.size("readings") + 16, most)
    return docs.select(key, *texts_or_lines(F.col("text")), _on_first_rows(sent).alias("sent"))


def masked_lines(docs: DataFrame, terms: DataFrame, key: str = "doc_id", mark: str = "█", most: int = SENT) -> DataFrame:
    """All lines with words, each word that a place of a term covers replaced by marks: (key, line_no,
    text, n_masked). Terms are applied where they are found, so that neither places nor lines are
    moved; as in `places`, `most` bytes of terms are sent at most. More are to be located
    (`word_spans`) and applied as boxes (`masking.apply_redactions`)."""
    return _held(docs, terms, key, most).mapInArrow(partial(locator.masked, key, mark), f"`{key}` {dict(docs.dtypes)[key]}, line_no int, text string, n_masked int")


def masked_words(docs: DataFrame, terms: DataFrame, key: str = "doc_id", most: int = SENT) -> DataFrame:
    """(key, n_masked): the words of each document that a place of a term covers, a row for each row of docs."""
    return _held(docs, terms, key, most).mapInArrow(partial(locator.masked_words, key), f"`{key}` {dict(docs.dtypes)[key]}, n_masked long")


def _places(held: DataFrame, key: str, term_type: str) -> DataFrame:
    types = dict(held.dtypes)
    # where the task learns the type of the term's id, whatever there is to find
    held = held.withColumn("term_type", F.lit(None).cast(term_type))
    return held.mapInArrow(partial(locator.locate, key), f"`{key}` {types[key]}, term_id {term_type}, reading int, start int, n int, word string, spans {locator.SPANS}")


def places(docs: DataFrame, terms: DataFrame, key: str = "doc_id", blocks: int = 1, most: int = SENT) -> DataFrame:
    """Every place of every term: (key, term_id, reading, start, n, word, spans), start and n in words
    of the document, word the first one of the place, spans (line_no, first, last, x0, x1) the
    words of each line that it touches and where they begin and end on the line.

    A one-word term is equal to a word, or to its possessive without 's. A term of several
    words stands in a row of words, over line and page ends alike. On the line where it
    begins its words are tolerated as plurals or possessives; its first word may be the end
    of a longer one, and its last, if it is on that line too, the beginning of one (four
    letters or more, a missing space). Words on the lines after have to be equal. A word
    with a hyphen may be split there by a line's end; all words are then equal.

    The texts are read once and nothing of them is moved: each task is sent all terms, and
    seeks each reading by the piece of it that is rarest in a batch. A word is compared with
    pieces by the lengths that pieces have, so that a long one costs no more than its reading.
    Of the terms `most` bytes at most are sent, which is tested when the plan runs; more are
    to be dealt into `blocks`, each of which reads the texts, or joined by document (`places_of`).
    """
    out = None
    for block in _dealt(terms.select("term_id", "term"), blocks):
        one = _places(_held(docs, block, key, most), key, dict(terms.dtypes)["term_id"])
        out = one if out is None else out.unionByName(one)
    return out


def places_of(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every place of a document's own terms: wanted (key, term_id, term), each sought in the texts of
    its key alone. Rows as of `places`. Only texts with terms are moved, to meet them by key,
    and the work is that of each text with its own terms."""
    read = wanted.select(key, "term_id", readings(F.col("term")).alias("readings")).filter("readings IS NOT NULL")
    own = read.groupBy(key).agg(F.collect_list(F.struct("term_id", "readings")).alias("own"))
    held = docs.select(key, "text").join(own, key).select(key, *texts_or_lines(F.col("text")), "own")
    return _places(held, key, dict(wanted.dtypes)["term_id"])


def phrase_starts(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term_id, start, n): each place of a term, start and n in words of the document."""
    return places(docs, terms, key).select(key, "term_id", "start", "n")


def single_matches(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term_id, line_no, pos, word): words that equal a one-word term, or its possessive.
    A plain plural is not one."""
    at = F.get("spans", F.lit(0))
    return places(docs, terms, key).filter("n = 1").select(key, "term_id", at["line_no"].alias("line_no"), at["first"].alias("pos"), "word")


def word_spans(docs: DataFrame, terms: DataFrame, key: str = "doc_id", own: bool = False) -> DataFrame:
    """(key, term_id, start, line_no, first, last, x0, x1): the words of each line that each place
    of a term touches, and where they begin and end on the line. With `own`, terms are
    (key, term_id, term), sought in the texts of their key alone."""
    found = places_of(docs, terms, key) if own else places(docs, terms, key)
    return found.select(key, "term_id", "start", F.explode("spans").alias("s")).select(key, "term_id", "start", "s.*")


def rects(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Boxes of every term: one for each line that a place touches, from the first touched
    word to the last. (key, term_id, start, page_no, line_no, x0, y0, x1, y1)"""
    spans = word_spans(docs, terms, key)
    y0 = line_top(F.col("line_no"))
    return spans.select(key, "term_id", "start", page_of(F.col("line_no")).alias("page_no"), "line_no", "x0", y0.alias("y0"), "x1", (y0 + LINE_HEIGHT).alias("y1"))


def _bound(words: Column, term: Column, holds) -> Column:
    """holds(words, term) with both worked out once, not at each element of the arrays in it."""
    return F.transform(F.array(F.struct(words.alias("words"), term.alias("term"))), lambda x: holds(x["words"], x["term"]))[0]


def in_line(words: Column, term: Column) -> Column:
    """Whether a line has a term, its words tolerated as plurals or possessives, and its outer
    ones fused to a neighbour by a missing space; one word must be equal or possessive."""

    def holds(words: Column, term: Column) -> Column:
        n = F.size(term)
        at = F.sequence(F.lit(0), F.size(words) - n)
        single = F.exists(words, lambda t: (t == term[0]) | (F.concat(term[0], F.lit("'s")) == t))

        def fits(i: Column) -> Column:
            pairs = F.zip_with(F.slice(words, i + 1, n), term, lambda t, w: F.struct(t.alias("t"), w.alias("w")))
            return F.forall(
                F.transform(pairs, lambda p, k: token_equals(p["t"], p["w"]) | ((k == 0) & fused_before(p["t"], p["w"])) | ((k == n - 1) & fused_after(p["t"], p["w"]))),
                lambda ok: ok,
            )

        return F.when(n == 0, False).when(n == 1, single).when(F.size(words) < n, False).otherwise(F.exists(at, fits))

    return _bound(words, term, holds)


def hyphen_tail(words: Column, term: Column) -> Column:
    """Whether a line ends with the beginning of a term up to a hyphen in one of its words.

    The line's last word equals the head of a hyphenated word, or a later part of the
    head, and the term's words before it are the line's words before it.
    """

    def heads(word: Column) -> Column:
        parts = F.split(word, "-")
        head = F.slice(parts, 1, F.size(parts) - 1)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(head))), lambda k: F.array_join(F.slice(head, k, F.size(head)), "-"))

    def holds(words: Column, term: Column) -> Column:
        def fits(word: Column, i: Column) -> Column:
            before = (F.size(words) - 1 >= i) & (F.slice(words, F.greatest(F.lit(1), F.size(words) - i), i) == F.slice(term, 1, i))
            return F.contains(word, F.lit("-")) & F.array_contains(heads(word), F.element_at(words, -1)) & before

        return F.coalesce(F.exists(F.transform(term, fits), lambda ok: ok), F.lit(False))

    return _bound(words, term, holds)


def box_counts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", most: int = SENT) -> DataFrame:
    """(term_id, boxes): how many boxes (`rects`) each term has, those without any left out. Boxes are
    counted where they are found, and counts alone are moved; `most` bytes of terms are sent at most, as in `places`."""
    term_type = dict(terms.dtypes)["term_id"]
    held = _held(docs, terms, key, most).drop(key).withColumn("term_type", F.lit(None).cast(term_type))
    counts = held.mapInArrow(locator.box_counts, f"term_id {term_type}, boxes long")
    return counts.groupBy("term_id").agg(F.sum("boxes").alias("boxes"))


def term_hits(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(term_id, hits): boxes of each term by counts (term_id, boxes) of `box_counts`, 0 where there are none."""
    return terms.select("term_id").join(counts, "term_id", "left").groupBy("term_id").agg(F.sum(F.coalesce("boxes", F.lit(0))).cast("long").alias("hits"))


def unapplied(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """Terms without a box, by counts (term_id, boxes) or the boxes themselves."""
    return terms.join(counts.select("term_id").distinct(), "term_id", "left_anti")


def rule_summary(proposals: DataFrame, applied: DataFrame) -> DataFrame:
    """(rule_name, n_proposed, n_applied) of proposals (rule_name, term), a term applied if `applied` (term) has it."""
    marked = proposals.join(applied.select("term").distinct().withColumn("was", F.lit(1)), "term", "left")
    return marked.groupBy("rule_name").agg(F.count("*").alias("n_proposed"), F.count("was").alias("n_applied"))


def term_labels(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """(term, label): the label of the first rule that proposed a term, its name without one."""
    spaced = proposals.withColumn("term", F.replace("term", F.lit("\n"), F.lit(" ")))
    joined = spaced.join(rules.select("rule_name", "ordinal", "label"), "rule_name")
    w = Window.partitionBy("term").orderBy("ordinal")
    return joined.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("term", F.coalesce("label", "rule_name").alias("label"))


def highlights(boxes: DataFrame, title: Column | None = None) -> DataFrame:
    """Boxes as highlight annotations: corners in order, a title by default."""
    return boxes.select(
        "*",
        F.coalesce(title if title is not None else F.lit(None).cast("string"), F.lit("Text Redaction")).alias("title"),
        F.least("x0", "x1").alias("left"), F.least("y0", "y1").alias("top"), F.greatest("x0", "x1").alias("right"), F.greatest("y0", "y1").alias("bottom"),
    ).drop("x0", "y0", "x1", "y1")


def packed(words: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, words): OCR words (key, at, text, box) as one row an image, an array in the order of `at`,
    by one shuffle; what is packed already (`images.ocr_packed`) stays as it is."""
    if "words" in words.columns:
        return words.select(key, "words")
    return words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "text", "box"))).alias("words"))


def first_words(words: Column, said=lambda text: text) -> Column:
    """The first normalised word of each packed word, null where it has none."""
    return F.transform(words, lambda w: F.get(normalised_words(said(w["text"])), F.lit(0)))


def boxed(held: DataFrame, key: str = "image_id") -> DataFrame:
    """held (key, words, plain, own): packed words, their first words, and the image's terms (term_id, ws), to the
    boxes that a term covers: (key, term_id, start, at, box). Nothing is moved."""
    element, own = held.schema["words"].dataType.elementType, held.schema["own"].dataType.elementType
    types = ", ".join(f"{c} {element[c].dataType.simpleString()}" for c in ("at", "box"))
    rows = held.select(key, "words", "plain", "own")
    return rows.mapInArrow(partial(locator.boxed, key), f"`{key}` {dict(held.dtypes)[key]}, term_id {own['term_id'].dataType.simpleString()}, start int, {types}")


def ocr_matches(boxes: DataFrame, terms: DataFrame, key: str = "image_id", few: bool = False) -> DataFrame:
    """Boxes (key, at, text, box) of OCR words, loose or packed, that a term covers: (key, term_id, start, at, box).
    Terms (term_id, term) are sought in all images; those that have the key, in its image alone.

    Each box counts by its first normalised word, and a term by all its words in a row of
    boxes; boxes without words are passed over. Terms of an image meet it as one row of its
    packed words, which are moved once; not at all if the terms are said to be `few`, which are sent to all tasks.
    """
    if key in terms.columns:
        wanted = terms.select(key, F.struct("term_id", normalised_words(F.col("term")).alias("ws")).alias("t")).filter("size(t.ws) > 0")
        own = wanted.groupBy(key).agg(F.collect_set("t").alias("own"))
        return boxed(packed(boxes, key).join(F.broadcast(own) if few else own, key).withColumn("plain", first_words(F.col("words"))), key)
    loose = boxes.select(key, F.inline("words")) if "words" in boxes.columns else boxes
    words = loose.withColumn("word", F.get(normalised_words(F.col("text")), F.lit(0))).filter("word IS NOT NULL")
    placed = words.withColumn("gpos", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1)
    hits = placed.join(term_words(terms), "word").withColumn("start", F.col("gpos") - F.col("off"))
    whole = hits.groupBy(key, "term_id", "start").agg(F.collect_set("at").alias("ats"), F.first("n").alias("n")).filter("size(ats) = n")
    return whole.select(key, "term_id", "start", F.explode("ats").alias("at")).join(placed.select(key, "at", "box"), [key, "at"]).select(key, "term_id", "start", "at", "box")
