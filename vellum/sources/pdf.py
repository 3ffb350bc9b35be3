"""Scanned PDF files without a PDF library: page count, page images, and a writer for such files.

A scan is a page that shows one image. Images that are gray or RGB at 8 bits, packed by Flate or not at all, are read;
other pages give an error in their row. Text content is not interpreted.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "path string, page int, width int, height int, nChannels int, data binary, dpi int, error string"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)


def objects(pdf: bytes) -> dict[int, bytes]:
    """Objects by number, those in object streams too; a later one of the same number replaces the earlier."""
    out = {int(m[1]): m[2] for m in _OBJECT.finditer(pdf)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            data = stream(body)
            head = list(map(int, data[:first].split()))[: 2 * n]
            ends = [*head[3::2], len(data) - first]
            for number, at, end in zip(head[::2], head[1::2], ends):
                out.setdefault(number, data[first + at : first + end])
    return out


def stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n", body)
    data = body[m.end() : body.rindex(b"endstream")]
    return zlib.decompressobj().decompress(data) if b"/FlateDecode" in body[: m.start()] else data


def page_objects(found: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of the page tree."""
    root = next((b for b in found.values() if re.search(rb"/Type\s*/Catalog", b)), None)
    top = root and re.search(rb"/Pages\s+(\d+)", root)
    if not top:
        raise ValueError("no page tree")
    out, todo, seen = [], [int(top[1])], set()
    while todo:
        n = todo.pop(0)
        body = found.get(n, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if n in seen:
            raise ValueError("page tree has a loop")
        seen.add(n)
        if kids:
            todo = [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])] + todo
        elif body:
            out.append(body)
    return out


def page_count(pdf: bytes) -> int:
    """Pages of a file; 0 if it can't be read."""
    try:
        return len(page_objects(objects(pdf))) if pdf[:1024].find(b"%PDF-") >= 0 else 0
    except Exception:  # any failure to read means unreadable, by definition
        return 0


def page_image(pdf: bytes, page: int, dpi: int) -> np.ndarray:
    """Gray or blue, green, red pixels of a page (numbered from 1) at a resolution, by nearest pixels."""
    found = objects(pdf)
    pages = page_objects(found)
    if not 1 <= page <= len(pages):
        raise IndexError(f"page {page} of {len(pages)}")
    body = pages[page - 1]
    drawn = [found[int(n)] for n in re.findall(rb"(\d+)\s+\d+\s+R", body) if re.search(rb"/Subtype\s*/Image", found.get(int(n), b""))]
    if len(drawn) != 1:
        raise ValueError("not a page of one image")
    head = drawn[0][: drawn[0].find(b"stream")]
    w, h, bits = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"Width", b"Height", b"BitsPerComponent"))
    channels = 3 if b"/DeviceRGB" in head else 1 if b"/DeviceGray" in head else 0
    filters = re.findall(rb"/(\w+Decode)\b", head)
    if bits != 8 or not channels or set(filters) - {b"FlateDecode"} or b"/Predictor" in head:
        raise ValueError("image of another kind")
    a = np.frombuffer(stream(drawn[0]), np.uint8)[: w * h * channels].reshape(h, w, channels)
    box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
    x0, y0, x1, y1 = map(float, box[1].split()) if box else (0, 0, w * 72 / dpi, h * 72 / dpi)
    out_w, out_h = max(1, round((x1 - x0) * dpi / 72)), max(1, round((y1 - y0) * dpi / 72))
    a = a[np.arange(out_h) * h // out_h][:, np.arange(out_w) * w // out_w]
    return a[..., ::-1] if channels == 3 else a


def write(images: list[np.ndarray], dpi: int = 300) -> bytes:
    """A PDF whose pages are these gray images."""
    bodies: list[bytes] = []
    add = lambda b: bodies.append(b) or len(bodies)
    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"")
    kids = []
    for img in images:
        h, w = img.shape
        size = b"%.3f %.3f" % (w * 72 / dpi, h * 72 / dpi)
        data, draw = zlib.compress(img.astype(np.uint8).tobytes()), b"q " + size.replace(b" ", b" 0 0 ") + b" 0 0 cm /I Do Q"
        image = add(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (w, h, len(data)) + data + b"\nendstream")
        content = add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %s] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (size, content, image)))
    bodies[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, b in enumerate(bodies):
        at.append(len(out))
        out += b"%d 0 obj\n" % (i + 1) + b + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))


def counts(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, readable, page_count."""

    def run(batches):
        for b in batches:
            n = [page_count(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "readable": [x > 0 for x in n], "page_count": n})

    return files.select("path", "content").mapInPandas(run, "path string, readable boolean, page_count int")


def render(files: DataFrame, pages: DataFrame, dpi: int = 300) -> DataFrame:
    """files(path, content), pages(path, page) -> PAGES: a page's pixels, or its error. Each file's pages are made in the row of the file."""
    wanted = pages.groupBy("path").agg(F.array_sort(F.collect_set(F.col("page").cast("int"))).alias("pages"))

    def run(batches):
        for b in batches:
            for path, content, numbers in zip(b["path"], b["content"], b["pages"]):
                for p in numbers:
                    try:
                        a = page_image(bytes(content), int(p), dpi)
                        row = (path, p, a.shape[1], a.shape[0], a.shape[2], np.ascontiguousarray(a).tobytes(), dpi, None)
                    except Exception as e:  # the page's error is its result
                        row = (path, p, 0, 0, 0, None, dpi, f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([row], columns=["path", "page", "width", "height", "nChannels", "data", "dpi", "error"])

    return files.select("path", "content").join(wanted, "path").mapInPandas(run, PAGES)

