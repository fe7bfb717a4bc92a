"""What can go wrong between a path and its facts."""


class ScanError(Exception):
    """Base of all errors of a scan."""

    kind = "scan"


class IoFailure(ScanError):
    """A file can't be read, or isn't UTF-8."""

    kind = "io"


class ParseFailure(ScanError):
    """A file isn't Rust source."""

    kind = "parse"


class GlobFailure(ScanError):
    """A glob pattern is malformed."""

    kind = "glob"


class ManifestFailure(ScanError):
    """A workspace's manifest is missing or malformed."""

    kind = "manifest"


BY_KIND = {e.kind: e for e in (IoFailure, ParseFailure, GlobFailure, ManifestFailure)}
