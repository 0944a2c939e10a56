"""Plan-level helpers: sessions, shared storage, iterative plans."""
