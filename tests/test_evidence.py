"""Evidence files, archives, the search through them, and manifests."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from changeproof.errors import Refused
from changeproof.sinks.manifest import manifest, manifest_drift, publish_manifest
from changeproof.sinks.store import TableStore
from changeproof.sources import evidence as V

FILES = "path string, content binary, problem string"


def packed(*members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in members:
            z.writestr(name, content)
    return bytearray(out.getvalue())


def archives(spark, most=V.MOST_BYTES, **made):
    rows = [(f"{name}.zip", bytes(content), None) for name, content in made.items()]
    return V.explode_archives(spark.createDataFrame(rows, FILES), most)


def by_member(df):
    return {(r.path, r.place, r.member): (None if r.content is None else bytes(r.content), r.problem) for r in df.collect()}


def test_a_folder_is_read_at_every_depth_and_large_files_only_by_size(spark, tmp_path):
    root = tmp_path / "a.b (c)"
    (root / "x" / "y").mkdir(parents=True)
    (root / "one.txt").write_bytes(b"1")
    (root / "x" / "y" / "two.bin").write_bytes(b"\xff\x00")
    (root / "x" / "large.txt").write_bytes(b"0" * 11)
    # Spark lists no file without bytes.
    (root / "empty").write_bytes(b"")
    got = {r.path: (r.bytes, None if r.content is None else bytes(r.content), r.problem) for r in V.read_evidence(spark, str(root), 10).collect()}
    assert got == {"one.txt": (1, b"1", None), "x/y/two.bin": (2, b"\xff\x00", None), "x/large.txt": (11, None, "file is 11 bytes, max is 10")}


def test_members_are_rows_however_they_are_packed(spark):
    long = b"ab" * 3_000_000
    got = by_member(archives(spark, a=packed(("x.txt", "é"), ("d/y", b""), ("big", long)), b=packed(("x.txt", "1"), ("x.txt", "2"), method=zipfile.ZIP_STORED), none=packed()))
    assert got == {
        ("a.zip", 0, "x.txt"): ("é".encode(), None), ("a.zip", 1, "d/y"): (b"", None), ("a.zip", 2, "big"): (long, None),
        ("b.zip", 0, "x.txt"): (b"1", None), ("b.zip", 1, "x.txt"): (b"2", None),
    }


def test_what_cannot_be_unpacked_keeps_a_row(spark):
    whole = packed(("a.txt", "aaaa" * 50), ("b.txt", "b"))
    start = bytes(whole).index(b"PK\x01\x02")
    changed = {"checksum": (start + 16, 1), "size": (start + 24, 1), "encrypted": (start + 8, 1), "method": (start + 10, 4)}
    made = {"half": whole[: len(whole) // 2], "no": b"", "text": b"not an archive at all", "bzip": packed(("a.txt", "a" * 200), method=zipfile.ZIP_BZIP2)}
    for name, (place, bit) in changed.items():
        made[name] = bytearray(whole)
        made[name][place] ^= bit
    made["stream"] = bytearray(whole)
    made["stream"][35:37] = b"\xff\xff"
    got = by_member(archives(spark, **made))
    first = {path: problem for (path, place, _), (_, problem) in got.items() if place == 0}
    assert first == {
        "half.zip": "not a zip archive", "no.zip": "not a zip archive", "text.zip": "not a zip archive", "bzip.zip": "unsupported method", "checksum.zip": "wrong checksum", "size.zip": "wrong size",
        "encrypted.zip": "encrypted member", "method.zip": "unsupported method", "stream.zip": "member cannot be inflated",
    }
    assert got[("checksum.zip", 1, "b.txt")] == (b"b", None)


def test_a_member_that_unpacks_to_too_much_is_not_unpacked(spark):
    bomb = packed(("zeros", b"\0" * 1_000_000))
    assert by_member(archives(spark, 1000, bomb=bomb)) == {("bomb.zip", 0, "zeros"): (None, "member is 1000000 bytes, max is 1000")}
    # One that states less than it holds is stopped a byte beyond what it states.
    at = bytes(bomb).index(b"PK\x01\x02") + 24
    bomb[at : at + 4] = (10).to_bytes(4, "little")
    assert by_member(archives(spark, 1000, bomb=bomb))[("bomb.zip", 0, "zeros")] == (None, "wrong size")


def scanned(spark, rows, **how):
    files = V.explode_archives(spark.createDataFrame(rows, FILES))
    return {(r.path, r.member, r.line, r.pattern, r.preview) for r in V.scan_evidence(files, **how).collect()}


def test_first_hits_with_lines_and_masked_previews(spark):
    rows = [
        ("a.json", b"one\r\ntwo COOKIE three cookie", None), ("b.bin", b"\n\xffset-cookie", None), ("c.txt", b"s.c(r\\E)t and sXc", None), ("d.txt", None, None), ("e.txt", b"", None),
        ("f.txt", None, "file is 9 bytes, max is 1"), ("long.txt", b"x" * 100 + b"apikey" + b"y" * 100, None),
    ]
    got = scanned(spark, rows, literals=("s.c(r\\E)t", "absent"))
    assert got == {
        ("a.json", None, 2, "Cookie", "one\\ntwo [MATCH] three cookie"), ("b.bin", None, None, "Cookie", "\\n\ufffdset-[MATCH]"), ("b.bin", None, None, "Set-Cookie", "\\n\ufffd[MATCH]"),
        ("c.txt", None, 1, "literal", "[MATCH] and sXc"), ("f.txt", None, None, "UNSCANNED", "file is 9 bytes, max is 1"), ("long.txt", None, 1, "apikey", "x" * 28 + "[MATCH]" + "y" * 28),
    }


def test_an_archive_that_is_not_wholly_read_counts_as_not_searched(spark):
    good, bad = packed(("a.txt", "\ncookie"), ("b.raw", "\ncookie")), packed(("a.txt", "cookie"), ("b.txt", "cookie"), ("c.txt", "cookie"))
    for place in [i for i in range(len(bad)) if bad[i : i + 4] == b"PK\x01\x02"][1:]:
        bad[place + 16] ^= 1
    got = scanned(spark, [("good.ZIP", bytes(good), None), ("bad.zip", bytes(bad), None)], names=("cookie",))
    assert got == {("good.ZIP", "a.txt", 2, "cookie", "\\n[MATCH]"), ("good.ZIP", "b.raw", None, "cookie", "\\n[MATCH]"), ("bad.zip", None, None, "UNSCANNED", "wrong checksum")}


def test_empty_tables_and_empty_patterns(spark):
    empty = V.explode_archives(spark.createDataFrame([], FILES))
    assert empty.count() == 0 and V.scan_evidence(empty).count() == 0
    with pytest.raises(ValueError):
        V.scan_evidence(empty, literals=("",))


def test_a_manifest_is_published_once_and_shows_drift(spark, tmp_path):
    files = spark.createDataFrame([("a/b.TXT", b"1"), ("a/.hidden", b""), ("c.tar.gz", b"22"), ("plain", None)], "path string, content binary")
    assert {(r.kind, r.path, r.bytes) for r in manifest(files).collect()} == {("txt", "a/b.TXT", 1), ("artifact", "a/.hidden", 0), ("gz", "c.tar.gz", 2), ("artifact", "plain", 0)}
    store = TableStore(spark, str(tmp_path / "m"))
    assert publish_manifest(store, "run", files) and not publish_manifest(store, "run", files)
    now = spark.createDataFrame([("a/b.TXT", b"2"), ("a/.hidden", b""), ("plain", b""), ("new", b"")], "path string, content binary")
    assert {tuple(r) for r in manifest_drift(store.read("manifest"), now).collect()} == {("a/b.TXT", "changed"), ("c.tar.gz", "missing"), ("new", "unlisted")}


@pytest.mark.parametrize(
    ("paths", "code"),
    [(["a", "a"], "E_DUPLICATE_ARTIFACT"), (["/a"], "E_BAD_ARTIFACT_PATH"), (["x/../a"], "E_BAD_ARTIFACT_PATH"), (["C:\\a"], "E_BAD_ARTIFACT_PATH"), ([""], "E_BAD_ARTIFACT_PATH"), ([None], "E_BAD_ARTIFACT_PATH")],
)
def test_paths_given_twice_or_leading_out_are_refused(spark, tmp_path, paths, code):
    store = TableStore(spark, str(tmp_path / "m"))
    files = spark.createDataFrame([(p, b"") for p in [*paths, "..a/b..c"]], "path string, content binary").withColumn("extra", F.lit(1))
    with pytest.raises(Refused) as e:
        publish_manifest(store, "run", files)
    assert e.value.code == code and store.manifests() == []
