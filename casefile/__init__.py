"""casefile — file-evidence analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame built from native Spark
expressions.  Operators that read an input more than once write it to the
shared checkpoint folder first; all others are lazy.

Layout
------
sources/    evidence table scans, binary-file directories, file inventory
functions/  column expressions: predicates, digests, media-type rules
operators/  hashing, duplicates, media types, annotations, reports
plans/      composed jobs (hash, detect, report) and plan checks
"""

from casefile.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
