"""Scans of artifact files: (path, content) rows, as ``binaryFile`` reads them, become records."""
