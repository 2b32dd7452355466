"""Readers: each gives a DataFrame of a source's rows; files are read where the tasks are."""

from __future__ import annotations

from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.geometry import parse_points


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header and quoted cells of several lines; missing required columns are an error."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns missing: {missing}")
    return rows


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV, or an empty table of ``schema`` where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return csv_table(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are dropped, or an error if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): lines with an ordinal that follows their order within files."""
    return spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())


def last_per_key(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key by ordinal, by an aggregate that keeps one row a key."""
    held = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(held, ordinal).alias("_r")).select(*keys, "_r.*")


def json_object_entries(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of one JSON object a file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")))


def manifest_canvases(manifests: DataFrame, column: str = "value") -> DataFrame:
    """(manifest_id, seq, canvas_id, label, width, height, image) of IIIF manifests, version 2 or 3, as JSON text."""
    two = "struct<sequences: array<struct<canvases: array<struct<`@id`: string, label: string, width: int, height: int, images: array<struct<resource: struct<`@id`: string>>>>>>>>"
    three = "struct<id: string, items: array<struct<id: string, label: map<string, array<string>>, width: int, height: int, items: array<struct<items: array<struct<body: struct<id: string>>>>>>>>"
    v2, v3 = F.from_json(column, two), F.from_json(column, three)
    old = F.transform(
        F.element_at(v2["sequences"], 1)["canvases"],
        lambda c: F.struct(c["@id"].alias("canvas_id"), c["label"].alias("label"), c["width"].alias("width"), c["height"].alias("height"), F.get(c["images"], 0)["resource"]["@id"].alias("image")),
    )
    new = F.transform(
        v3["items"],
        lambda c: F.struct(
            c["id"].alias("canvas_id"), F.get(F.get(F.map_values(c["label"]), 0), 0).alias("label"), c["width"].alias("width"), c["height"].alias("height"), F.get(F.get(c["items"], 0)["items"], 0)["body"]["id"].alias("image")
        ),
    )
    name = F.coalesce(F.get_json_object(column, "$.id"), F.get_json_object(column, "$['@id']"))
    each = manifests.select(name.alias("manifest_id"), F.posexplode(F.coalesce(old, new)).alias("seq", "c"))
    return each.select("manifest_id", (F.col("seq") + 1).alias("seq"), "c.*")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


PAGE_LINES = "line_id string, region string, polygon string, baseline string, text string, conf double"


def page_xml_lines(pages: DataFrame, column: str = "value", key: str = "page_id") -> DataFrame:
    """(key, seq, line_id, region, polygon, baseline, text, conf) of PAGE XML, in document order, any namespace."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(xml: str):
        for region in (e for e in ElementTree.fromstring(xml).iter() if _local(e.tag) == "TextRegion"):
            for line in (e for e in region if _local(e.tag) == "TextLine"):
                parts = {_local(e.tag): e for e in line}
                equiv = parts.get("TextEquiv")
                text = next((e.text or "" for e in equiv if _local(e.tag) == "Unicode"), None) if equiv is not None else None
                conf = equiv.get("conf") if equiv is not None else None
                points = {k: parts[k].get("points") if k in parts else None for k in ("Coords", "Baseline")}
                yield line.get("id"), region.get("id"), points["Coords"], points["Baseline"], text, float(conf) if conf else None

    def run(batches):
        import pyarrow as pa

        names = ["seq", "line_id", "region", "polygon", "baseline", "text", "conf"]
        for batch in batches:
            rows = [(k, n, *line) for k, xml in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) if xml for n, line in enumerate(parse(xml), 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = [batch.column(0).type, pa.int32(), *[pa.string()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, *names])

    made = pages.select(key, column).mapInArrow(run, f"`{key}` {kind}, seq int, {PAGE_LINES}")
    return made.withColumns({c: parse_points(F.col(c)) for c in ("polygon", "baseline")})


def oai_records(responses: DataFrame, column: str = "value") -> DataFrame:
    """(identifier, deleted, sets, title, shelfmarks, token) of OAI-PMH responses with MODS metadata."""

    def parse(xml: str):
        root = ElementTree.fromstring(xml)
        token = next((e.text for e in root.iter() if _local(e.tag) == "resumptionToken"), None)
        for record in (e for e in root.iter() if _local(e.tag) == "record"):
            texts = lambda name, r=record: [(e.text or "").strip() for e in r.iter() if _local(e.tag) == name]
            header = next((e for e in record if _local(e.tag) == "header"), None)
            deleted = header is not None and header.get("status") == "deleted"
            yield {"identifier": next(iter(texts("identifier")), None), "deleted": deleted, "sets": texts("setSpec"), "title": next(iter(texts("title")), None), "shelfmarks": texts("shelfLocator"), "token": token}

    schema = "identifier string, deleted boolean, sets array<string>, title string, shelfmarks array<string>, token string"

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("identifier", pa.string()), ("deleted", pa.bool_()), ("sets", pa.list_(pa.string())), ("title", pa.string()), ("shelfmarks", pa.list_(pa.string())), ("token", pa.string())])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for xml in batch.column(0).to_pylist() if xml for r in parse(xml)], schema=kinds)

    return responses.select(column).mapInArrow(run, schema)


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self._in = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self._in = True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._in = False

    def handle_data(self, data):
        if self._in:
            self.rows[-1][-1] += data


def html_tables(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """(key, row, cells) of table rows, cells trimmed with single spaces."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                parser = _Cells()
                parser.feed(text or "")
                rows += [(k, n, [" ".join(c.split()) for c in cells]) for n, cells in enumerate(parser.rows, 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int32(), pa.list_(pa.string())), strict=True)], names=[key, "row", "cells"])

    return pages.select(key, column).mapInArrow(run, f"`{key}` {kind}, row int, cells array<string>")


def jpeg_size(data: Column) -> Column:
    """struct(width, height) from a JPEG's first frame header, or null."""
    import pandas as pd

    @F.pandas_udf("width int, height int")
    def run(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in blobs:
            size, at = (None, None), 2
            while blob is not None and at + 9 < len(blob) and blob[at] == 0xFF:
                marker, length = blob[at + 1], int.from_bytes(blob[at + 2 : at + 4], "big")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    size = (int.from_bytes(blob[at + 7 : at + 9], "big"), int.from_bytes(blob[at + 5 : at + 7], "big"))
                    break
                at += 2 + length
            rows.append(size)
        return pd.DataFrame(rows, columns=["width", "height"]).astype("Int32")

    return run(data)


def files_with_sidecars(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(stem, content, text): binary files and the text files of the same stem."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(stem.alias("stem"), "content")
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("value").alias("text"))
    return blobs.join(texts, "stem", "left")
