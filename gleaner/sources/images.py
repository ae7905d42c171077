"""Images: decoded, shrunk and encoded again by a codec that is plugged in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.fixed import IMAGE_FORMATS, IMAGE_MOST


class Codec(Protocol):
    """Whatever reads and writes images; it is sent to the workers, so it must be picklable."""

    def shrink(self, data: bytes, most: tuple[int, int], formats: list[str]) -> tuple[bytes, str, int, int]:
        """Bytes, format, width and height of the image, no larger than `most`, its aspect kept. Raises for what is no image."""
        ...


class PillowCodec:
    """The codec of the imaging library, where that is installed."""

    def shrink(self, data: bytes, most: tuple[int, int], formats: list[str]) -> tuple[bytes, str, int, int]:
        import io

        from PIL import Image

        with Image.open(io.BytesIO(data)) as picture:
            kind = next((f for f in formats if f == (picture.format or "").lower()), "png")
            scale = min(1.0, *(m / n for m, n in zip(most, picture.size, strict=True)))
            small = picture.resize([max(1, round(scale * n)) for n in picture.size], Image.Resampling.LANCZOS) if scale < 1 else picture
            flat = small.convert("RGB") if kind == "jpeg" and small.mode != "RGB" else small
            out = io.BytesIO()
            flat.save(out, kind)
            return out.getvalue(), kind, *flat.size


def shrunk(images: DataFrame, codec: Codec, most: tuple[int, int] = IMAGE_MOST) -> DataFrame:
    """images: doc_id, figure_id, bytes. doc_id, figure_id, bytes, format, width, height; what is no image is left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc, figure, data in zip(pdf["doc_id"], pdf["figure_id"], pdf["bytes"], strict=True):
                try:
                    rows.append((doc, figure, *codec.shrink(bytes(data), most, IMAGE_FORMATS)))
                except Exception:  # a damaged image is dropped, as the caption alone still serves
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "figure_id", "bytes", "format", "width", "height"])

    kind = images.schema["doc_id"].dataType.simpleString()
    return images.select("doc_id", "figure_id", "bytes").mapInPandas(run, f"doc_id {kind}, figure_id string, bytes binary, format string, width int, height int")
