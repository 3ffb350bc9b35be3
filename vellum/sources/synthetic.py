"""Synthetic pages with known text: right-to-left lines in paragraphs, a page number and stamps, and their rasters.

Words are blocks of ink here, as there is no font; positions, text and stamps are what the operators need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import REGION

WIDTH, HEIGHT, MARGIN, LINE, LETTER = 1254, 2149, 60, 80, 18
#: Words that texts are drawn from, so a page has function words among others.
WORDS = ("في", "من", "على", "كان", "البيت", "الطريق", "ثم", "قال", "الولد", "كتاب", "قديم", "عند", "الباب", "هذا", "يوم", "بعد", "المطر", "إلى", "البحر", "لم", "يكن", "أحد", "هناك")
STAMPS = ("demo.example/books", "مكتبة")
SCHEMA = f"book_id string, page int, reference string, page_height int, regions array<{REGION}>"


def page(book: int, number: int, lines: int = 20) -> tuple[str, list[dict]]:
    """(reference text, regions from the top down) of a page, always the same."""
    g = np.random.default_rng((book, number))
    region = lambda kind, x0, y0, text: {"kind": kind, "x0": float(x0), "y0": float(y0), "x1": float(x0 + LETTER * len(text)), "y1": float(y0 + LINE // 2), "text": text, "confidence": None, "reading_order": None}
    texts = [" ".join(g.choice(WORDS, int(g.integers(4, 10)))) for _ in range(lines)]
    out = [region("body", WIDTH - MARGIN - LETTER * len(t), MARGIN + LINE * i, t) for i, t in enumerate(texts)]
    digits = str(number).translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩"))
    out.append(region("body", WIDTH / 2, HEIGHT - 200, digits))
    out += [region("body", x, HEIGHT - 120, s) for x, s in zip((50, WIDTH - 200), STAMPS)]
    return "\n".join(texts), out


def pages(spark: SparkSession, books: int = 5, per_book: int = 4) -> DataFrame:
    """SCHEMA: per_book pages of each of so many books."""

    def run(batches):
        for b in batches:
            rows = [(f"synthetic{i // per_book}", i % per_book + 1, *page(i // per_book, i % per_book + 1)) for i in b["id"].tolist()]
            yield pd.DataFrame([(k, p, t, HEIGHT, r) for k, p, t, r in rows], columns=["book_id", "page", "reference", "page_height", "regions"])

    return spark.range(books * per_book).mapInPandas(run, SCHEMA)


def raster(regions: list[dict], scale: int = 8) -> np.ndarray:
    """Gray pixels of a page, a block of ink for each word, at a fraction of its size."""
    img = np.full((HEIGHT // scale, WIDTH // scale), 255.0)
    for r in regions:
        at = r["x0"]
        for word in r["text"].split(" "):
            img[int(r["y0"]) // scale : int(r["y1"]) // scale, int(at) // scale : int(at + LETTER * len(word)) // scale] = 0
            at += LETTER * (len(word) + 1)
    return img
