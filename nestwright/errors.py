"""Exceptions."""


class NestwrightError(Exception):
    """Base class."""


class ConfigError(NestwrightError):
    """A mapping, shape or option that cannot be used."""


class MappingError(NestwrightError):
    """A row that cannot be mapped."""


class DocumentError(NestwrightError):
    """A mapped row that cannot become a document."""


class QualityError(NestwrightError):
    """Strict validation found an issue."""


class SourceError(NestwrightError):
    """A source that cannot be read."""


class SinkError(NestwrightError):
    """A target that cannot be written."""


class ShapeError(NestwrightError):
    """A shape that cannot be found or parsed."""


class MatchError(NestwrightError):
    """Columns that cannot be matched to a shape."""
