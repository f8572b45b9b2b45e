"""Content digests as native Spark expressions.

``sha2`` returns lower-case, zero-padded hex, i.e. exactly the text form the
evidence table stores; NULL content gives a NULL digest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

# SHA-2 widths supported by Spark's sha2(); 512 is the evidence default.
DIGEST_BITS = (224, 256, 384, 512)
DEFAULT_BITS = 512


def check_bits(bits: int) -> int:
    if bits not in DIGEST_BITS:
        raise ValueError(f"unsupported SHA-2 width {bits}; use one of {DIGEST_BITS}")
    return bits


def digest(content: Column | str, bits: int = DEFAULT_BITS) -> Column:
    """SHA-2 hex digest of a binary column."""
    c = F.col(content) if isinstance(content, str) else content
    return F.sha2(c, check_bits(bits))


def empty_digest(bits: int = DEFAULT_BITS) -> str:
    """Digest of zero bytes (used for zero-length files the binary reader skips)."""
    return hashlib.new(f"sha{check_bits(bits)}", b"").hexdigest()


def report_label(bits: int = DEFAULT_BITS) -> str:
    """Name of the digest in text reports, e.g. ``SHA512``."""
    return f"SHA{check_bits(bits)}"
