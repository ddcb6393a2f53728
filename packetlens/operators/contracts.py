"""Where models and native libraries plug in: OCR, page rendering, sentence embedding. Each is made once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StringType, StructField, StructType

#: An engine takes image bytes and returns (text, confidence) of each line.
Engine = Callable[[bytes], list[tuple[str, float]]]
LEAST_CONFIDENCE = 0.3


def added(df: DataFrame, *fields: StructField) -> StructType:
    return StructType([*df.schema.fields, *fields])


def recognised(images: DataFrame, engines: list[Callable[[], Engine]], image: str = "image", prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Adds lines, confidences and error. The first engine's lines stand unless their mean confidence is below .3 and a later
    engine's is better; an image that fails in all is a row with an error."""

    def mean(lines: list[tuple[str, float]]) -> float:
        return sum(c for _, c in lines) / len(lines) if lines else 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [make() for make in engines]
        for pdf in parts:
            texts, sure, errors = [], [], []
            for data in pdf[image]:
                best, error = None, None
                for engine in own:
                    try:
                        lines = engine(prepare(data) if prepare else data)
                    except Exception as e:  # noqa: BLE001 an engine's own errors become rows
                        error = str(e)
                        continue
                    if best is None or mean(lines) > mean(best):
                        best = lines
                    if mean(best) >= LEAST_CONFIDENCE:
                        break
                texts.append([t for t, _ in best or []])
                sure.append([float(c) for _, c in best or []])
                errors.append(error if best is None else None)
            yield pdf.assign(lines=texts, confidences=sure, error=errors)

    return images.mapInPandas(run, added(images, StructField("lines", ArrayType(StringType())), StructField("confidences", ArrayType(DoubleType())), StructField("error", StringType())))


def rendered(pages: DataFrame, make: Callable[[], Callable[[str, int, int], bytes]], dpi: int = 150) -> DataFrame:
    """Adds the image of each (packet_id, page_no)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = make()
        for pdf in parts:
            yield pdf.assign(image=[draw(p, int(n), dpi) for p, n in zip(pdf["packet_id"], pdf["page_no"], strict=True)])

    return pages.mapInPandas(run, added(pages, StructField("image", BinaryType())))


def embedded(pages: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text") -> DataFrame:
    """Adds the embedding of each text, a batch at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in parts:
            yield pdf.assign(embedding=[[float(x) for x in v] for v in encode(pdf[text].tolist())])

    return pages.mapInPandas(run, added(pages, StructField("embedding", ArrayType(FloatType()))))
