"""Images, boxes and annotations of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import pixel_hash
from ..functions.text import PLATES, normalised_words
from ..sources.shared import settle
from .detect import asked_chunks, calls_of
from .matching import SENT, boxed, containing, first_words, ocr_matches, packed

#: Bounds of what a vision service takes: encoded bytes, and each side in pixels.
MOST_BYTES, SIDES = 20 * 1024 * 1024, (50, 16000)
#: Fixed value: the colour that marks a proposed redaction.
HIGHLIGHT = (0.2157, 0.898, 1.0)
#: Annotation kinds whose box is told by their first and last corner.
MARKUP_KINDS = (8, 12)
#: Images with a string that are sent to all tasks at most, to find their words; more are joined.
FEW = 1 << 17
#: Fixed value: how a failed text detection is named.
FAILED = "Text Detection Failed"


def size_gate(n_bytes: Column, width: Column, height: Column) -> Column:
    return (n_bytes <= MOST_BYTES) & width.between(*SIDES) & height.between(*SIDES)


def affine_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, m: Column) -> Column:
    """A box of the image as the bounding box on the page: scaled to 0..1, then x' = a x + c y + e, y' = b x + d y + f."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    xs = [a * x / width + c * y / height + e for x in (x0, x1) for y in (y0, y1)]
    ys = [b * x / width + d * y / height + f for x in (x0, x1) for y in (y0, y1)]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def rounded(box: Column) -> Column:
    """Whole coordinates, halves to the even neighbour."""
    return F.struct(*[F.bround(box[k]).cast("long").alias(k) for k in ("x0", "y0", "x1", "y1")])


def ocr_words(pages: DataFrame, key: str = "image_id") -> DataFrame:
    """Nested blocks, lines and words to (key, at, text, x0, y0, x1, y1); a word's box is from its
    polygon's first to its third corner."""
    words = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda w: w["words"]))))
    rows = pages.select(key, F.posexplode(words).alias("at", "w"))
    corner = lambda i, k: F.element_at(F.col("w.polygon"), i)[k]
    return rows.select(key, "at", F.col("w.text").alias("text"), corner(1, "x").alias("x0"), corner(1, "y").alias("y0"), corner(3, "x").alias("x1"), corner(3, "y").alias("y1"))


def ocr_packed(pages: DataFrame, key: str = "image_id", kind: str = "int") -> DataFrame:
    """Nested blocks, lines and words, a row an image, to (key, words): what `ocr_words` gives as an array
    (at, text, box) in the row, box of numbers of the given kind; empty where there are no words. Nothing is moved."""
    words = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda w: w["words"]))))
    corner = lambda w, i, k, c: F.element_at(w["polygon"], i)[k].cast(kind).alias(c)
    box = lambda w: F.struct(corner(w, 1, "x", "x0"), corner(w, 1, "y", "y0"), corner(w, 3, "x", "x1"), corner(w, 3, "y", "y1")).alias("box")
    # not filtered: what a filter asks of the words would be worked out once more
    return pages.select(key, F.transform(F.coalesce(words, F.slice(words, 1, 0)), lambda w, i: F.struct(i.cast("int").alias("at"), w["text"].alias("text"), box(w))).alias("words"))


def with_pixel_hash(images: DataFrame, content: str = "content", name: str = "content_hash") -> DataFrame:
    """images with a hash of what they show: two encodings of one raster have one, and what can't be
    decoded has that of its bytes."""
    return images.withColumn(name, pixel_hash(F.col(content)))


def first_of_equal(images: DataFrame, content: Column, order: str, pixels: bool = False) -> DataFrame:
    """Of rows of equal content the first by `order`. The content counts by its SHA-256, or with
    `pixels` by that of its decoded raster; the least row of each is found by partial sums, so
    that a frequent content is not one task's."""
    named = images.withColumn("content_hash", pixel_hash(content) if pixels else F.sha2(content, 256))
    return named.groupBy("content_hash").agg(F.min_by(F.struct(*images.columns), order).alias("r")).select("content_hash", "r.*")


def place_boxes(boxes: DataFrame, instances: DataFrame) -> DataFrame:
    """Boxes found in an image on every page that shows it: (doc_id, page_no, name, box)."""
    pairs = boxes.select("content_hash", F.explode(F.arrays_zip("boxes", "names")).alias("p"))
    return pairs.join(instances, "content_hash").select(
        "doc_id", "page_no", F.col("p.names").alias("name"),
        affine_box(F.col("p.boxes")["x0"], F.col("p.boxes")["y0"], F.col("p.boxes")["x1"], F.col("p.boxes")["y1"], F.col("width"), F.col("height"), F.col("m")).alias("box"),
    )


def boxes_by_image(*found: DataFrame, key: str = "image_id") -> DataFrame:
    """All detectors' (key, name, box) of an image together, equal pairs once; images without any have no row."""
    rows = reduce(DataFrame.unionByName, found).distinct()
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "box"))).alias("pairs")).select(key, F.transform("pairs", lambda p: p["name"]).alias("names"), F.transform("pairs", lambda p: p["box"]).alias("boxes"))


def strings_by_image(strings: DataFrame, images: DataFrame, blocks: int = 1) -> DataFrame:
    """(image_id, term): each term goes to the images whose text has it anywhere, case counting;
    failed texts get none. `blocks` as of `matching.containing`."""
    held = images.filter(F.col("text") != FAILED).select("image_id", F.array("text").alias("forms"))
    return containing(held, ["image_id"], "forms", strings.select("term", F.col("term").alias("string")).distinct(), "term", "string", blocks)


def annotations(pages: DataFrame, kinds: tuple[int, ...] | None = None) -> DataFrame:
    """Annotations of pages (doc_id, page_no, annotations), pages without any kept, as
    (doc_id, page_no, kind, title, proposed, text, rect, is_candidate)."""
    rows = pages.select("doc_id", "page_no", F.explode_outer("annotations").alias("a"))
    if kinds is not None:  # only these; pages without any of them have no row
        rows = rows.filter(F.col("a.kind").isin(*kinds))
    v = F.col("a.vertices")
    markup = F.struct(F.element_at(v, 1)["x"].alias("x0"), F.element_at(v, 1)["y"].alias("y0"), F.element_at(v, -1)["x"].alias("x1"), F.element_at(v, -1)["y"].alias("y1"))
    stroke = F.col("a.stroke")
    return rows.select(
        "doc_id", "page_no", F.col("a.kind").alias("kind"), F.col("a.title").alias("title"), F.col("a.content").alias("proposed"), F.col("a.text").alias("text"),
        F.when(F.col("a.kind").isin(*MARKUP_KINDS), markup).otherwise(F.col("a.rect")).alias("rect"),
        F.coalesce(stroke == F.array(*[F.lit(x) for x in HIGHLIGHT]), F.lit(False)).alias("is_candidate"),
    )


def usable_images(instances: DataFrame) -> DataFrame:
    """Image instances (bbox, n_bytes, width, height) that have a box and pass the size gate."""
    return instances.filter(F.col("bbox").isNotNull() & size_gate(F.col("n_bytes"), F.col("width"), F.col("height")))


def full_box(width: Column, height: Column) -> Column:
    """The box over a whole image."""
    zero = F.lit(0.0)
    return F.struct(zero.alias("x0"), zero.alias("y0"), width.cast("double").alias("x1"), height.cast("double").alias("y1"))


def signature_rows(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections (image_id, score, x0, y0, x1, y1) as the model server gives them, the score to
    four digits and the corners to two, from the threshold on."""
    corners_ = F.struct(*[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return scored.withColumn("score", F.round("score", 4)).filter(F.col("score") >= threshold).select("image_id", F.lit("Signature Detected").alias("name"), corners_.alias("box"), "score")


def detected(images: DataFrame, results: DataFrame, kind: str) -> DataFrame:
    """A detector's boxes, closed where it fails: (image_id, name, box).

    images (image_id, width, height); results (image_id, box, error) in any order, matched
    by image. A result with an error gives a box over the whole image, named as failed; an
    image without a result gives none; a result for an image that was not asked about is an
    error.
    """
    met = images.select("image_id", "width", "height").join(results.select("image_id", "box", "error"), "image_id", "full")
    known = met.select("image_id", F.when(F.col("width").isNull() & F.col("height").isNull(), F.raise_error(F.concat(F.lit("a result for an unknown image: "), F.col("image_id").cast("string")))).otherwise(F.lit(True)).alias("known"), "width", "height", "box", "error")
    failed = F.col("error").isNotNull()
    rows = known.filter("known").filter(failed | F.col("box").isNotNull())
    return rows.select("image_id", F.when(failed, f"{kind} Detection Failed").otherwise(f"{kind} Detected").alias("name"), F.when(failed, full_box(F.col("width"), F.col("height"))).otherwise(F.col("box")).alias("box"))


def plate_boxes(images: DataFrame, words: DataFrame) -> DataFrame:
    """Vehicle registrations in the text of images, as the boxes of their words: (image_id, name, box).

    images (image_id, width, height, error); words (image_id, at, text, box) in reading order,
    loose or packed, which are moved once at most. Both readings of 0/O and 1/I are looked for in the whole text and then, read the same
    way, among the words. An image whose text detection failed gets a box over all of it.
    """
    whole = packed(words).withColumn("text", _seen(F.col("words")))
    readings = []
    for a, b in (("01", "OI"), ("OI", "01")):
        found = F.array_distinct(F.regexp_extract_all(F.translate("text", a, b), F.lit(f"({PLATES})"), 0))
        own = F.filter(F.transform(found, lambda t: F.struct(t.alias("term_id"), normalised_words(t).alias("ws"))), lambda t: F.size(t["ws"]) > 0)
        plain = first_words(F.col("words"), lambda t: F.translate(t, a, b))  # noqa: B023
        readings.append(F.struct(own.alias("own"), F.when(F.size(own) > 0, plain).alias("plain")))
    held = whole.select("image_id", "words", F.explode(F.array(*readings)).alias("r")).select("image_id", "words", "r.*").filter("size(own) > 0")
    found = boxed(held).select("image_id", F.col("term_id").alias("name"), "box")
    return found.unionByName(failed_images(images)).distinct()


def _seen(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def seen_texts(words: DataFrame) -> DataFrame:
    """(image_id, text): an image's words (image_id, at, text, box), loose or packed, in order, with spaces."""
    return packed(words).select("image_id", _seen(F.col("words")).alias("text"))


def image_text(images: DataFrame, words: DataFrame | Callable[[DataFrame], DataFrame], rule: dict, size: int = 6000, overlap: int = 250, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(boxes, calls) of a service that is asked about the text of images, chunk by chunk.

    images (image_id, width, height, error); words (image_id, at, text, box), loose or packed. The texts' chunks
    are asked about once, equal ones of all images together, under the rule's limits
    (`service.ask`). Every string that was named goes to all images whose text has it, case
    counting, and is found again among their words: (image_id, name, box), name being the
    string. An image whose text detection failed gets a box over all of it and is not sent;
    one without words gives nothing. calls are as of `detect.chunked_service`.

    Of images without a string no words are looked at. Where these are to be unpacked, words may be a function of
    (image_id) that gives those of these images alone, with `texts` (image_id, text): all words of each image,
    with spaces, as `seen_texts` tells them otherwise.
    """
    fine = images.filter("error IS NULL").select("image_id").distinct()
    texts = (seen_texts(words) if texts is None else texts).join(fine, "image_id", "left_semi")
    _, answers = asked_chunks(texts.select(F.col("image_id").alias("doc_id"), "text"), rule, size, overlap)
    strings = settle(answers.select(F.explode("terms").alias("term")).distinct())
    n_bytes = strings.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    met = settle(strings_by_image(strings, texts, 1 if n_bytes <= SENT else -(-2 * n_bytes // SENT)))
    # only words of images that have a string are looked at; where these are few, no words are moved
    some, few = met.select("image_id").distinct(), met.count() <= FEW
    own = met.select("image_id", F.col("term").alias("term_id"), "term")
    some = F.broadcast(some) if few else some
    held = packed(words(some) if callable(words) else words.join(some, "image_id", "left_semi"))
    boxes = ocr_matches(held, own, few=few).select("image_id", F.col("term_id").alias("name"), "box")
    return boxes.unionByName(failed_images(images)).distinct(), calls_of(answers)


def failed_images(images: DataFrame) -> DataFrame:
    """A box over each image whose text detection failed."""
    return images.filter("error IS NOT NULL").select("image_id", F.lit(FAILED).alias("name"), full_box(F.col("width"), F.col("height")).alias("box"))


#: Detectors of images by the kind of rule: (images, words, rule) to (image_id, name, box).
IMAGE_KINDS = {
    "image": lambda images, words, rule: reduce(DataFrame.unionByName, [detected(images, rule[k], name) for k, name in (("faces", "Face"), ("signatures", "Signature")) if k in rule]),
    "image_plate": lambda images, words, rule: plate_boxes(images, words),
    "image_text": lambda images, words, rule: image_text(images, words, rule)[0],
}


def detect_in_images(images: DataFrame, words: DataFrame, rules: list[dict]) -> DataFrame:
    """All rules' boxes (image_id, rule_name, name, box), equal ones of a rule once. A rule of the kind
    `image` brings what the services said of faces and signatures (image_id, box, error)."""
    unknown = [r["kind"] for r in rules if r["kind"] not in IMAGE_KINDS]
    if unknown or not rules:
        raise ValueError(f"no detector for {', '.join(unknown) or 'no rule'}; known are {', '.join(IMAGE_KINDS)}")
    each = [IMAGE_KINDS[r["kind"]](images, words, r).distinct().select("image_id", F.lit(r["name"]).alias("rule_name"), "name", "box") for r in rules]
    return reduce(DataFrame.unionByName, each)


def image_highlights(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(highlights, failures): boxes on pages (doc_id, page_no, name, box) as annotations titled
    Image Redaction; those without an area or without a box are no fault but rows of their own."""
    box = F.col("box")
    fine = box.isNotNull() & (box["x0"] != box["x1"]) & (box["y0"] != box["y1"])
    corners_ = (F.least(box["x0"], box["x1"]).alias("left"), F.least(box["y0"], box["y1"]).alias("top"), F.greatest(box["x0"], box["x1"]).alias("right"), F.greatest(box["y0"], box["y1"]).alias("bottom"))
    good = boxes.filter(F.coalesce(fine, F.lit(False))).select("doc_id", "page_no", F.col("name").alias("content"), F.lit("Image Redaction").alias("title"), *corners_)
    return good, boxes.filter(~F.coalesce(fine, F.lit(False))).select("doc_id", "page_no", "name")
