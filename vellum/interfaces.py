"""What a stage of the book pipeline is, for those who bring their own: any object of the shape named here does.

Frames go in and frames come out, so a stage may be a column expression, a join or a function over Arrow batches.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class DocumentSource(Protocol):
    """Books: book_id, path, length, modified, sha256, fingerprint."""

    def books(self) -> DataFrame: ...


@runtime_checkable
class Rasterizer(Protocol):
    """books(book_id, path) -> book_id, page, width, height, nChannels, data, error."""

    def render(self, books: DataFrame, dpi: int) -> DataFrame: ...


@runtime_checkable
class Preprocessor(Protocol):
    """Page images -> their profile, and the images with what the profile asks for done."""

    def analyze(self, images: DataFrame) -> DataFrame: ...

    def apply(self, images: DataFrame, profiles: DataFrame) -> DataFrame: ...


@runtime_checkable
class LayoutDetector(Protocol):
    """One page (a dict of its row) -> blocks: dicts of label, x0, y0, x1, y1, position."""

    def detect(self, page: dict) -> list[dict]: ...


@runtime_checkable
class Recognizer(Protocol):
    """One page (a dict of its row) -> dict of text, confidence and lines (dicts of text, x0, y0, x1, y1, score)."""

    def recognize(self, page: dict) -> dict: ...


@runtime_checkable
class QualityEvaluator(Protocol):
    """Readings -> the same with score, tier and warnings."""

    def score(self, readings: DataFrame) -> DataFrame: ...


@runtime_checkable
class EscalationPolicy(Protocol):
    """Scored readings -> the same with action and status."""

    def route(self, readings: DataFrame, processing_pass: int) -> DataFrame: ...


@runtime_checkable
class OutputWriter(Protocol):
    """Canonical pages -> products in a folder."""

    def write(self, pages: DataFrame, folder: str) -> None: ...


@runtime_checkable
class Validator(Protocol):
    """A page log and its books -> book_id, valid, errors, warnings."""

    def validate(self, log: DataFrame, books: DataFrame) -> DataFrame: ...


@runtime_checkable
class JobManager(Protocol):
    """Pages that are still to be done, by book."""

    def pending(self, log: DataFrame) -> DataFrame: ...
