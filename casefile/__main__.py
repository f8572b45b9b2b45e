"""Command line: ``spark-submit casefile/__main__.py <job> ...`` or ``python -m casefile <job> ...``.

Jobs
----
hash         hash inline and external content -> annotation table (id, file_hash)
media-types  detect media types -> annotation table (id, media_type)
annotate     both in one read of the bytes -> <out>/file_hash, <out>/media_type
duplicates   duplicate report from evidence + hash annotation -> text part files
histogram    media-type counts from evidence + media-type annotation -> CSV
mismatch     inline and external files whose type changes with the name -> CSV
directory    raw-directory mode: <out>/metadata (attribute report) and
             <out>/duplicatefiles (duplicate report) for a folder of files
bucket       evidence metadata + annotation tables bucketed by id (catalog tables)

Every job writes its result; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys

from casefile.functions.digest import DEFAULT_BITS, DIGEST_BITS


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="casefile", description="file-evidence analytics on Spark")
    p.add_argument("--master", help="Spark master (default: from spark-submit)")
    p.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite"],
                   help="what to do when an output exists")
    sub = p.add_subparsers(dest="job", required=True)

    def job(name, help_text, evidence=True, external=False):
        s = sub.add_parser(name, help=help_text)
        if evidence:
            s.add_argument("--evidence", required=True, help="evidence table (Parquet)")
        if external:
            s.add_argument("--external", help="folder of externally stored files (file name = row id)")
            s.add_argument("--listing", default="index", choices=["index", "inventory"],
                           help="list with Spark's file index, or on executors for very large folders")
        return s

    for name, text in [("hash", "hash inline and external content"),
                       ("media-types", "detect media types"),
                       ("annotate", "hash and detect in one pass")]:
        s = job(name, text, external=True)
        s.add_argument("--out", required=True)
        if name != "media-types":
            s.add_argument("--bits", type=int, default=DEFAULT_BITS, choices=DIGEST_BITS)
    s = job("duplicates", "duplicate report")
    s.add_argument("--hashes", required=True, help="hash annotation table")
    s.add_argument("--out", required=True)
    s.add_argument("--bits", type=int, default=DEFAULT_BITS, choices=DIGEST_BITS)
    s.add_argument("--members", help="also write the long form (one row per duplicate file) as Parquet")
    s = job("histogram", "media-type counts")
    s.add_argument("--media-types", required=True, help="media-type annotation table")
    s.add_argument("--out", required=True)
    s = job("mismatch", "verdicts that change with the file name", external=True)
    s.add_argument("--out", required=True)
    s = job("directory", "raw-directory reports", evidence=False)
    s.add_argument("--input", required=True, help="folder of files")
    s.add_argument("--out", required=True)
    s.add_argument("--bits", type=int, default=DEFAULT_BITS, choices=DIGEST_BITS)
    s.add_argument("--listing", default="index", choices=["index", "inventory"],
                   help="list with Spark's file index, or on executors for very large trees")
    s = job("bucket", "bucketed evidence metadata and annotation tables")
    s.add_argument("--annotations", nargs="*", default=[], help="annotation tables to bucket alongside")
    s.add_argument("--buckets", type=int, required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--prefix", default="cf_", help="catalog table name prefix")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from casefile.operators import hashing, mediatypes
    from casefile.plans import jobs
    from casefile.session import get_session
    from casefile.sources import evidence as ev

    spark = get_session(args.master, app_name=f"casefile-{args.job}")
    mode = args.mode
    if args.job == "hash":
        jobs.hash_job(spark, args.evidence, args.external, args.out, args.bits, mode, args.listing)
    elif args.job == "media-types":
        jobs.media_type_job(spark, args.evidence, args.external, args.out, mode, args.listing)
    elif args.job == "annotate":
        jobs.annotate_job(spark, args.evidence, args.external, args.out, args.bits, mode, args.listing)
    elif args.job == "duplicates":
        jobs.duplicate_report_job(spark, args.evidence, args.hashes, args.out, args.bits, mode,
                                  members_out=args.members)
    elif args.job == "histogram":
        (jobs.media_type_histogram(spark, args.evidence, args.media_types)
         .write.mode(mode).option("header", "true").csv(args.out))
    elif args.job == "mismatch":
        table = ev.read_evidence(spark, args.evidence)
        out = mediatypes.inline_media_type_mismatch(table)
        if args.external:
            out = out.unionByName(mediatypes.external_media_type_mismatch(
                table, hashing.read_types(spark, args.external, listing=args.listing)))
        out.write.mode(mode).option("header", "true").csv(args.out)
    elif args.job == "bucket":
        names = jobs.bucket_tables(spark, args.evidence, args.out, args.buckets, tuple(args.annotations),
                                   args.prefix, mode)
        print(" ".join(f"{k}={v}" for k, v in sorted(names.items())))
    elif args.job == "directory":
        jobs.inventory_report_job(spark, args.input, f"{args.out}/metadata", mode)
        jobs.directory_duplicate_report_job(spark, args.input, f"{args.out}/duplicatefiles", args.bits, mode,
                                            listing=args.listing)
    return 0


if __name__ == "__main__":
    sys.exit(main())
