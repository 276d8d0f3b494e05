"""What a language gives the engine: the extractor contract and the registry that picks one for a module."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from plumbline.sources.readers import detect_language


class Extractor(Protocol):
    """Facts of one language as tables; everything past this is language-neutral."""

    #: The language's name, and the file that marks its modules.
    language: str
    marker: str

    def packages(self, files: DataFrame) -> DataFrame:
        """package, file, path, is_test, generated of the files (path, text) that belong to packages."""
        ...

    def extract(self, files: DataFrame) -> DataFrame:
        """One row of metrics for each package."""
        ...


class Registry:
    """Extractors by language; a module is read by the one whose marker it has."""

    def __init__(self, *extractors: Extractor):
        self.by = {e.language: e for e in extractors}
        if len(self.by) != len(extractors):
            raise ValueError("two extractors of one language")

    def detect(self, files: DataFrame) -> Extractor:
        return self.by[detect_language(files, {name: e.marker for name, e in self.by.items()})]
