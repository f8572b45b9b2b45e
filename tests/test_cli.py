import os

from casefile.__main__ import main
from tests.conftest import make_evidence


def _text(folder):
    return "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))


def test_cli_jobs_end_to_end(spark, tmp_path):
    make_evidence(spark, [
        {"id": "a", "file_path": "x/a.json", "file_type": "DATA_FILE", "file_content": b'{"k": 1}'},
        {"id": "b", "file_path": "y/b.txt", "file_type": "DATA_FILE", "file_content": b'{"k": 1}'},
        {"id": "big", "file_path": "z/big.pdf", "file_type": "DATA_FILE", "external_path": "/ext/big"},
    ]).write.parquet(str(tmp_path / "ev"))
    (tmp_path / "ext").mkdir()
    (tmp_path / "ext" / "big").write_bytes(b"%PDF-1.4 data")
    ev, ext, out = str(tmp_path / "ev"), str(tmp_path / "ext"), str(tmp_path / "out")
    assert main(["annotate", "--evidence", ev, "--external", ext, "--out", out + "/ann"]) == 0
    assert main(["duplicates", "--evidence", ev, "--hashes", out + "/ann/file_hash", "--out", out + "/dups",
                 "--members", out + "/members"]) == 0
    members = sorted((r.id, r.n) for r in spark.read.parquet(out + "/members").collect())
    assert members == [("a", 2), ("b", 2)]
    assert "a_x/a.json\nb_y/b.txt" in _text(out + "/dups")
    assert main(["histogram", "--evidence", ev, "--media-types", out + "/ann/media_type", "--out", out + "/hist"]) == 0
    hist = _text(out + "/hist")
    assert "application/pdf,1" in hist and "application/json,1" in hist
    assert main(["mismatch", "--evidence", ev, "--external", ext, "--out", out + "/mism"]) == 0
    assert "a,x/a.json,text/plain,application/json" in _text(out + "/mism")
    assert main(["hash", "--evidence", ev, "--external", ext, "--out", out + "/h", "--bits", "256"]) == 0
    assert main(["media-types", "--evidence", ev, "--external", ext, "--out", out + "/t"]) == 0
    hashes = {r.id: r.file_hash for r in spark.read.parquet(out + "/h").collect()}
    assert hashes["big"] == __import__("hashlib").sha256(b"%PDF-1.4 data").hexdigest()
    types = {r.id: r.media_type for r in spark.read.parquet(out + "/t").collect()}
    assert types == {"a": "application/json", "b": "text/plain", "big": "application/pdf"}
    assert main(["bucket", "--evidence", ev, "--annotations", out + "/h", out + "/t", "--buckets", "2",
                 "--out", out + "/bucketed", "--prefix", "cli_"]) == 0
    assert spark.table("cli_file_hash").count() == 3
    assert main(["directory", "--input", ext, "--out", out + "/dir"]) == 0
    assert main(["directory", "--input", ext, "--out", out + "/dir2", "--listing", "inventory"]) == 0
    assert "File Path =file:" in _text(out + "/dir/metadata")
    assert os.path.isdir(out + "/dir/duplicatefiles")
