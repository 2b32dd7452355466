"""Readers of letters, pages of type, image lists and detections: each document is parsed where it lies, rows come out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions.labels import convolute


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _named(e, *names: str):
    return [x for x in e if _local(x.tag) in names]


def _words(text: str | None) -> str:
    return " ".join((text or "").split())


def parsed(documents: DataFrame, column: str, key: str, schema: str, parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """(key, schema) rows that ``parse`` makes of each document; null documents give none."""
    kind = documents.schema[key].dataType.simpleString()
    fields = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for k, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                rows = list(parse(text)) if text else []
                if rows:
                    columns = [[k] * len(rows), *map(list, zip(*rows, strict=True))]
                    kinds = [batch.column(0).type, *(to_arrow_type(f.dataType) for f in fields)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, *fields.names])

    return documents.select(key, column).mapInArrow(run, f"`{key}` {kind}, {schema}")


LETTERS = "letter string, senders array<string>, addressees array<string>, place string, to_place string, at string, not_before string, not_after string, date_text string"


def tei_letters(documents: DataFrame, column: str = "value", key: str = "path") -> DataFrame:
    """(key, letter, senders, addressees, places, dates, convolute, year) of each described letter that has a number."""

    def parse(xml: str):
        for desc in (e for e in ElementTree.fromstring(xml).iter() if _local(e.tag) == "correspDesc"):
            number = (desc.get("key") or "").strip()
            if not number:
                continue
            people, places, date = {"sent": [], "received": []}, {}, {}
            for action in _named(desc, "correspAction"):
                kind = action.get("type")
                if kind not in people:
                    continue
                people[kind] += [n for e in [*_named(action, "persName"), *_named(action, "orgName")] if (n := _words(e.text))]
                where = next((n for e in _named(action, "placeName") if (n := _words(e.text))), None)
                places[kind] = places.get(kind) or where
                if kind == "sent":
                    for e in _named(action, "date")[:1]:
                        found = {"at": e.get("when"), "not_before": e.get("notBefore") or e.get("from"), "not_after": e.get("notAfter") or e.get("to"), "text": _words(e.text)}
                        date |= {k: v for k, v in found.items() if v}
            yield number, people["sent"], people["received"], places.get("sent"), places.get("received"), date.get("at"), date.get("not_before"), date.get("not_after"), date.get("text")

    made = parsed(documents, column, key, LETTERS, parse)
    year = F.regexp_extract(F.coalesce("at", "not_before", F.lit("")), r"^(\d{4})", 1)
    return made.withColumns({"convolute": convolute(F.col("letter")), "year": F.nullif(year, F.lit("")).cast("int")})


class _Hocr(HTMLParser):
    """Pages and lines of hOCR as they come."""

    #: Classes of lines; fixed values of the format.
    LINES = ("ocr_line", "ocr_header", "ocr_textfloat", "ocr_caption")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self._page, self._depth, self._line = (0, 0.0, 0.0), 0, None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        title, kind = at.get("title") or "", at.get("class")
        box = re.search(r"bbox ([\d.]+) ([\d.]+) ([\d.]+) ([\d.]+)", title)
        if tag == "div" and kind == "ocr_page":
            number = re.search(r"ppageno (\d+)", title)
            self._page = (int(number[1]) if number else 0, *((float(box[3]), float(box[4])) if box else (0.0, 0.0)))
        elif tag == "span" and self._line is None and kind in self.LINES and box:
            size = re.search(r"x_size ([\d.]+)", title)
            self._line, self._depth = [*map(float, box.groups()), float(size[1]) if size else 0.0, ""], 1
        elif tag == "span" and self._line is not None:
            self._depth += 1

    def handle_data(self, data):
        if self._line is not None:
            self._line[5] += data

    def handle_endtag(self, tag):
        if tag == "span" and self._line is not None:
            self._depth -= 1
            if not self._depth:
                *box, text = self._line
                if _words(text):
                    self.rows.append((*self._page, *box, _words(text)))
                self._line = None


HOCR = "page int, width double, height double, x0 double, y0 double, x1 double, y1 double, size double, text string"


def hocr_lines(documents: DataFrame, column: str = "value", key: str = "path") -> DataFrame:
    """(key, page, width, height, box, size, text) of the lines of hOCR; a line without a size has 0."""

    def parse(html: str):
        reader = _Hocr()
        reader.feed(html)
        return reader.rows

    return parsed(documents, column, key, HOCR, parse)


METS = "seq int, label string, image_url string, thumb_url string, iiif boolean"
#: Uses of files in the order they are preferred; fixed values.
USES = ("DEFAULT", "MAX", "PRESENTATION")


def mets_images(documents: DataFrame, column: str = "value", key: str = "path", uses: tuple[str, ...] = USES) -> DataFrame:
    """(key, seq, label, image_url, thumb_url, iiif) of the physical pages of METS, by the files they point to."""

    def parse(xml: str):
        root = ElementTree.fromstring(xml)
        files = {}
        for group in (e for e in root.iter() if _local(e.tag) == "fileGrp"):
            for file in _named(group, "file"):
                for place in _named(file, "FLocat"):
                    files[file.get("ID")] = (group.get("USE"), next((v for k, v in place.attrib.items() if _local(k) == "href"), None))
        iiif = any(_local(e.tag) == "identifier" and e.get("type") == "iiif" for e in root.iter())
        physical = next((e for e in root.iter() if _local(e.tag) == "structMap" and e.get("TYPE") == "PHYSICAL"), None)
        pages = [e for e in physical.iter() if _local(e.tag) == "div" and e.get("TYPE") == "page"] if physical is not None else []
        for n, div in enumerate(pages, 1):
            order = div.get("ORDER") or ""
            of = dict(filter(None, (files.get(p.get("FILEID")) for p in _named(div, "fptr"))))
            yield int(order) if order.isdigit() else n, div.get("ORDERLABEL"), next((of[u] for u in uses if u in of), None), of.get("THUMBS"), iiif

    return parsed(documents, column, key, METS, parse)


def with_default_urls(images: DataFrame, object_id: Column, base: str) -> DataFrame:
    """``images`` whose missing addresses follow the library's convention under ``base``."""
    at = lambda kind: F.concat(F.lit(f"{base}/"), object_id, F.lit(f"/jpgs/{kind}/"), F.format_string("%08d", "seq"), F.lit(".jpg"))
    return images.withColumns({"image_url": F.coalesce("image_url", at("default")), "thumb_url": F.coalesce("thumb_url", at("thumbs"))})


def detections(documents: DataFrame, column: str = "value", key: str = "path") -> DataFrame:
    """(key, width, height, zone, class, confidence, polygon) of a detector's JSON; a box around a centre becomes its corners."""
    point = "array<struct<x: double, y: double>>"
    raw = F.from_json(column, f"struct<image: struct<width: int, height: int>, predictions: array<struct<class: string, confidence: double, points: {point}, x: double, y: double, width: double, height: double>>>")
    each = documents.select(key, raw.alias("r")).select(key, F.col("r.image.width").alias("image_w"), F.col("r.image.height").alias("image_h"), F.posexplode("r.predictions").alias("n", "p"))
    whole = lambda c: c.cast("int")
    given = F.transform(F.filter("p.points", lambda q: q["x"].isNotNull()), lambda q: F.array(whole(q["x"]), whole(q["y"])))
    x0, x1 = (whole(F.col("p.x") + s * F.col("p.width") / 2) for s in (-1, 1))
    y0, y1 = (whole(F.col("p.y") + s * F.col("p.height") / 2) for s in (-1, 1))
    boxed = F.when(x0.isNotNull() & y0.isNotNull(), F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)))
    polygon = F.when(F.size(given) > 0, given).otherwise(F.coalesce(boxed, F.array().cast("array<array<int>>")))
    return each.select(key, F.col("image_w").alias("width"), F.col("image_h").alias("height"), F.concat(F.lit("p"), F.col("n").cast("string")).alias("zone"), F.nullif(F.trim("p.class"), F.lit("")).alias("class"), F.col("p.confidence").alias("confidence"), polygon.alias("polygon"))


def coco_images(documents: DataFrame, column: str = "value", key: str = "path") -> DataFrame:
    """(key, file_name, width, height, n_annotations) of a COCO file."""
    raw = F.from_json(column, "struct<images: array<struct<id: bigint, file_name: string, width: int, height: int>>, annotations: array<struct<image_id: bigint, category_id: bigint>>>")
    read = documents.select(key, raw.alias("r"))
    images = read.select(key, F.explode("r.images").alias("i")).select(key, "i.*")
    counts = read.select(key, F.explode("r.annotations").alias("a")).groupBy(key, F.col("a.image_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return images.join(counts, [key, "id"], "left").select(key, "file_name", "width", "height", F.coalesce("n", F.lit(0)).alias("n_annotations"))


def coco_categories(documents: DataFrame, column: str = "value", key: str = "path") -> DataFrame:
    """(key, id, name)."""
    raw = F.from_json(column, "struct<categories: array<struct<id: bigint, name: string>>>")
    return documents.select(key, F.explode(raw["categories"]).alias("c")).select(key, "c.*")
