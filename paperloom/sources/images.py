"""Page images and text recognition, as Arrow stages around optional libraries.

Pixels never leave the stage: one pass decodes, resizes, enhances and reads a page. The libraries (cv2 for images,
pdf2image for PDF, pytesseract for text) are imported by the workers; where one is missing, a page gets an error and
its document the status ``error``. Geometry and the filtering of words are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_HEIGHT = 1000
WORD = "struct<text:string,bbox:struct<x:int,y:int,w:int,h:int>,confidence:double>"
OCR_ROWS = "struct<text:array<string>,conf:array<int>,left:array<int>,top:array<int>,width:array<int>,height:array<int>>"


def resized(width: Column, height: Column, target: int = TARGET_HEIGHT) -> Column:
    """struct(width, height) of an image brought to the target height."""
    return F.struct(F.floor(F.lit(target) * width / height).cast("int").alias("width"), F.lit(target).alias("height"))


def skew(angle: Column) -> Column:
    """The turn that straightens a page whose smallest rectangle has this angle; 0 up to half a degree."""
    turn = F.when(angle < -45, -(angle + 90)).otherwise(-angle)
    return F.when(F.abs(turn) > 0.5, turn).otherwise(0.0)


def words(rows: Column) -> Column:
    """The words of raw recognition rows (OCR_ROWS): those with a confidence above -1 and a text, at 0 to 1."""
    zipped = F.arrays_zip(*[rows[k].alias(k) for k in ("text", "conf", "left", "top", "width", "height")])
    good = F.filter(zipped, lambda r: (r["conf"] > -1) & (F.regexp_replace(r["text"], r"(?U)\s", "") != ""))
    box = lambda r: F.struct(r["left"].alias("x"), r["top"].alias("y"), r["width"].alias("w"), r["height"].alias("h"))
    return F.transform(good, lambda r: F.struct(r["text"].alias("text"), box(r).alias("bbox"), (r["conf"] / F.lit(100.0)).alias("confidence"))).cast(f"array<{WORD}>")


def load_image(source):
    """A BGR array from a path, bytes, a PIL image or an array. A ValueError for anything else."""
    import numpy as np

    if isinstance(source, np.ndarray):
        return source
    import cv2

    if isinstance(source, str):
        image = cv2.imread(source)
    elif isinstance(source, bytes | bytearray):
        image = cv2.imdecode(np.frombuffer(source, dtype=np.uint8), cv2.IMREAD_COLOR)
    elif hasattr(source, "convert"):
        image = cv2.cvtColor(np.array(source.convert("RGB")), cv2.COLOR_RGB2BGR)
    else:
        raise ValueError(f"not an image: {type(source).__name__}")
    if image is None:
        raise ValueError("the image cannot be decoded")
    return image


def enhance(image, deskew: bool = True, denoise: bool = True, contrast: bool = True):
    """Straighten, denoise and raise the contrast of a BGR image."""
    import cv2
    import numpy as np

    if deskew:
        gray = cv2.cvtColor(image, cv2.COLOR_BGR2GRAY) if image.ndim == 3 else image
        points = np.column_stack(np.where(gray > 0))
        if len(points):
            angle = cv2.minAreaRect(points)[-1]
            turn = -(90 + angle) if angle < -45 else -angle
            if abs(turn) > 0.5:
                h, w = image.shape[:2]
                matrix = cv2.getRotationMatrix2D((w // 2, h // 2), turn, 1.0)
                image = cv2.warpAffine(image, matrix, (w, h), flags=cv2.INTER_CUBIC, borderMode=cv2.BORDER_REPLICATE)
    if denoise:
        image = cv2.fastNlMeansDenoisingColored(image, None, 10, 10, 7, 21)
    if contrast:
        lab = cv2.cvtColor(image, cv2.COLOR_BGR2LAB)
        lab[..., 0] = cv2.createCLAHE(clipLimit=3.0, tileGridSize=(8, 8)).apply(lab[..., 0])
        image = cv2.cvtColor(lab, cv2.COLOR_LAB2BGR)
    return image


def resize(image, target: int = TARGET_HEIGHT):
    import cv2

    h, w = image.shape[:2]
    return cv2.resize(image, (int(target * w / h), target), interpolation=cv2.INTER_AREA)


def pages_of(content: bytes, path: str | None):
    """The page images of a file: all pages of a PDF (by its name), else one image."""
    if path and path.lower().endswith(".pdf"):
        import numpy as np
        from pdf2image import convert_from_bytes

        return [np.array(p)[..., ::-1] for p in convert_from_bytes(content)]
    return [load_image(content)]


def tesseract(image, languages: str = "eng") -> dict:
    """Text and raw rows of an image."""
    import pytesseract

    data = pytesseract.image_to_data(image, lang=languages, output_type=pytesseract.Output.DICT)
    rows = {k: [int(float(x)) for x in data[k]] for k in ("conf", "left", "top", "width", "height")} | {"text": list(data["text"])}
    return {"text": pytesseract.image_to_string(image, lang=languages).strip(), "rows": rows}


def recognise(files: DataFrame, engine: Callable = tesseract, prepare: Callable | None = None, pages: Callable = pages_of, all_pages: bool = False) -> DataFrame:
    """(path, page_no, text, words, error) of files (path, content): the first page of each, or all. An error of any kind
    becomes the row's error. The functions can be replaced, which is how they are tested."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = prepare if prepare is not None else lambda image: enhance(resize(image))
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = pages(bytes(content), path)
                    for n, image in enumerate(found if all_pages else found[:1]):
                        read = engine(ready(image))
                        out.append((path, n, read["text"], read["rows"], None))
                except Exception as e:  # the document's row carries what went wrong
                    out.append((path, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page_no", "text", "rows", "error"])

    read = files.select("path", "content").mapInPandas(run, f"path string, page_no int, text string, rows {OCR_ROWS}, error string")
    return read.select("path", "page_no", "text", words(F.col("rows")).alias("words"), "error")
