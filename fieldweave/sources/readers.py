"""Scans: data sets, documents, stored results, templates and knowledge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = "label string, extraction_schema map<string,string>, pdf_path string"
SPANS = "doc_id string, page int, block_idx int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double"
HASHES = "doc_id string, full long, left long, right long"
KNOWLEDGE = "template_id string, label string, field string, type string, avg_length double, n long, extraction_mode string"
TEMPLATES = "template string, label string, seq long, full long, left long, right long"
CACHE = "key string, mtime timestamp, fields array<string>, code_version string, extracted_data map<string,string>"
#: Fixed values of the page raster: resolution, width and height, white border, and the regions that vary between documents of one layout.
DPI = 100
RASTER, BORDER, MASKS = (800, 1131), 2, ((80, 120, 240, 360), (560, 120, 720, 360))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``entry_idx, label, pdf_path, fields`` from a JSON array; ``fields`` keeps the order of the schema.

    A file that is no array of such objects fails. A number per entry orders them; it rises within a file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("entry_idx", "e"))
    schema = F.get_json_object("e", "$.extraction_schema")
    names = F.json_object_keys(schema)
    values = F.from_json(schema, "map<string,string>")
    fields = F.transform(names, lambda n, i: F.struct(i.alias("fpos"), n.alias("name"), F.try_element_at(values, n).alias("description")))
    return raw.select("entry_idx", F.get_json_object("e", "$.label").alias("label"), F.get_json_object("e", "$.pdf_path").alias("pdf_path"), fields.alias("fields"))


def valid_entries(entries: DataFrame) -> DataFrame:
    """Entries with a label and a path."""
    return entries.where("coalesce(pdf_path, '') <> '' and coalesce(label, '') <> ''")


def file_stem(path):
    """A path's last part without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, mtime, sha256, content`` of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), "content")


def pdf_spans(files: DataFrame) -> DataFrame:
    """Text spans of PDF files, for :func:`operators.blocks.from_spans`, and ``error``; needs the optional PDF library.

    A file that can't be read gives one row with its error and no span, and takes no other file with it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                own = []
                try:
                    with fitz.open(stream=r.content, filetype="pdf") as pdf:
                        for page_no, page in enumerate(pdf):
                            texts = (b for b in page.get_text("dict")["blocks"] if b.get("type") == 0)
                            for i, block in enumerate(texts):
                                own += [(r.doc_id, page_no, i, n, k, s["text"], *map(float, s["bbox"]), None) for n, line in enumerate(block["lines"]) for k, s in enumerate(line["spans"])]
                except Exception as e:  # whatever the library says of a broken file is this file's error
                    own = [(r.doc_id, *[None] * 9, f"{type(e).__name__}: {e}")]
                out += own
            yield pd.DataFrame(out, columns=["doc_id", "page", "block_idx", "line", "span", "text", "x0", "y0", "x1", "y1", "error"]).astype({c: "Int64" for c in ("page", "block_idx", "line", "span")})

    return files.select("doc_id", "content").mapInPandas(run, f"{SPANS}, error string")


def pdf_texts(files: DataFrame) -> DataFrame:
    """``doc_id, text, error``: the plain text of PDF files, pages joined by a line feed; needs the optional PDF library."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                try:
                    with fitz.open(stream=r.content, filetype="pdf") as pdf:
                        out.append((r.doc_id, "\n".join(page.get_text("text") for page in pdf), None))
                except Exception as e:  # whatever the library says of a broken file is this file's error
                    out.append((r.doc_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "text", "error"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, text string, error string")


def _weights(kind: str, size: int, target: int):
    """Rows of weights that resample ``size`` samples to ``target``: the kernel is widened by the scale when samples get fewer."""
    import numpy as np

    kernels = {"linear": (1.0, lambda x: np.maximum(0.0, 1.0 - np.abs(x))), "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0))}
    reach, kernel = kernels[kind]
    scale = size / target
    wide = max(scale, 1.0)
    center = (np.arange(target) + 0.5) * scale
    w = kernel((np.arange(size)[None, :] + 0.5 - center[:, None]) / wide)
    w[np.abs(np.arange(size)[None, :] + 0.5 - center[:, None]) >= reach * wide] = 0.0
    return w / w.sum(1, keepdims=True)


def resample(grey, width: int, height: int, kind: str = "linear"):
    """A grey page (rows by columns of bytes) in another size, columns first, each pass rounded to bytes."""
    import numpy as np

    rounded = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    grey = np.asarray(grey, float)
    if grey.shape[1] != width:
        grey = rounded(grey @ _weights(kind, grey.shape[1], width).T)
    return rounded(_weights(kind, grey.shape[0], height) @ grey) if grey.shape[0] != height else grey


def difference_hash(grey) -> int:
    """64 bits of a grey page (rows by columns): resampled to 8 rows of 9 values, a bit where a value exceeds its left neighbour."""
    small = resample(grey, 9, 8, "lanczos")
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def masked(grey):
    """A page with its variable regions in white."""
    import numpy as np

    out = np.array(grey, copy=True)
    for x0, y0, x1, y1 in MASKS:
        out[y0 : y1 + 1, x0 : x1 + 1] = 255
    return out


def raster_hashes(grey) -> tuple[int, int, int]:
    """Hashes of a rendered page and of its halves: brought to :data:`RASTER`, framed in white, its variable regions white."""
    import numpy as np

    page = masked(np.pad(resample(grey, *RASTER), BORDER, constant_values=255))
    half = page.shape[1] // 2
    return difference_hash(page), difference_hash(page[:, :half]), difference_hash(page[:, half:])


def page_hashes(files: DataFrame, page: int = 0) -> DataFrame:
    """``doc_id, full, left, right, error`` of a page's raster; needs the optional PDF library.

    A file that can't be read or has no such page has null hashes and an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz
        import numpy as np

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                try:
                    with fitz.open(stream=r.content, filetype="pdf") as pdf:
                        pix = pdf[page].get_pixmap(dpi=DPI, colorspace=fitz.csGRAY, alpha=False, annots=False)
                        grey = np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.stride)[:, : pix.width]
                    out.append((r.doc_id, *raster_hashes(grey), None))
                except Exception as e:  # whatever the library says of a broken file is this file's error
                    out.append((r.doc_id, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "full", "left", "right", "error"]).astype({c: "Int64" for c in ("full", "left", "right")})

    return files.select("doc_id", "content").mapInPandas(run, f"{HASHES}, error string")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``file, field, value`` from a folder of JSON objects, one per document; version files are left out.

    A file without a field, or that is no JSON object, has one row with null field and value: it is there, but says nothing.
    """
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    kept = raw.where(~F.col("p").endswith(".meta.json"))
    return kept.select(file_stem(F.col("p")).alias("file"), F.explode_outer(F.from_json("value", "map<string,string>")).alias("field", "value"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache entries ``key, mtime, fields, code_version, extracted_data`` as :func:`writers.write_cache` stores them; none where nothing is stored."""
    return read_or_empty(spark, path, CACHE)


def read_result_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache entries of a folder of results and their version files, keyed by stem."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    stem = lambda suffix: F.regexp_extract("p", rf"([^/]+){suffix}$", 1)
    meta = raw.where(F.col("p").endswith(".meta.json")).select(stem(r"\.meta\.json").alias("key"), F.get_json_object("value", "$.code_version").alias("code_version"))
    data = raw.where(~F.col("p").endswith(".meta.json")).select(stem(r"\.json").alias("key"), "mtime", F.json_object_keys("value").alias("fields"), F.from_json("value", "map<string,string>").alias("extracted_data"))
    return data.join(meta, "key", "left").select("key", "mtime", "fields", "code_version", "extracted_data")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one of the same shape where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
