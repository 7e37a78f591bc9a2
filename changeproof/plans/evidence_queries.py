"""Evidence files and archives made of the documents, written, read back and searched."""

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from changeproof.operators.scale import ensure_checkpoint_dir
from changeproof.plans import derive as D
from changeproof.plans.register import Register
from changeproof.sinks.manifest import manifest_drift, publish_manifest
from changeproof.sinks.store import TableStore
from changeproof.sources import evidence as V

REGISTER = Register()
query = REGISTER.query

TOKEN, NAMES, LITERAL = r'token\s*=\s*"[0-9a-f]{40}"', ("LICENSED UNDER", "cookie"), "http://"
#: Documents of a file or archive, and the size beyond which a file is not searched.
IN_FILE, IN_ARCHIVE, MOST = 50, 20, 400_000


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(spark, sf_dir):
    """A folder with a text file for each 50 documents, in the order of doc_id."""
    root = _folder(spark, "evidence")
    docs = D.table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {IN_FILE}").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(root)
    return root


def _bare(found):
    """Spark's names of written files are random; their folders are not."""
    return found.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))


FILES_SQL = f"""f AS (SELECT 'part=' || (doc_id // {IN_FILE}) AS path, NULL::VARCHAR AS member, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text, true AS lined FROM documents GROUP BY doc_id // {IN_FILE})"""


def _hits_sql(source: str) -> str:
    """The first hit of each of the four checks in each row's text, from what stands before it."""
    checks = [(NAMES[0], f"(?i){NAMES[0]}"), (NAMES[1], f"(?i){NAMES[1]}"), (TOKEN, TOKEN), ("literal", LITERAL)]
    one = lambda label, pattern: (
        f"""SELECT path, member, CASE WHEN lined THEN (length(before) - length(replace(before, chr(10), '')) + 1)::INT END AS line, '{label}' AS pattern,
          left(regexp_replace(right(before, 28) || '[MATCH]' || substr(text, length(before) + length(hit) + 1, 28), '\\r?\\n', '\\\\n', 'g'), 72) AS preview
          FROM (SELECT *, substr(text, 1, strpos(text, hit) - 1) AS before FROM (SELECT *, regexp_extract(text, '{pattern}') AS hit FROM {source}) WHERE hit <> '')"""
    )
    return " UNION ALL ".join(one(*c) for c in checks)


@query(f"WITH {FILES_SQL} SELECT 'txt' AS kind, path, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM f")
def evidence_manifest(spark, sf_dir):
    """The manifest of written files, published and read from there."""
    root, store = _written(spark, sf_dir), TableStore(spark, _folder(spark, "manifests"))
    publish_manifest(store, "documents", V.read_evidence(spark, root))
    return _bare(store.read("manifest"))


@query(
    f"""WITH {FILES_SQL} SELECT path, CASE substr(path, 6)::BIGINT % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'unlisted' ELSE 'changed' END AS drift FROM f WHERE substr(path, 6)::BIGINT % 5 IN (1, 2, 3)"""
)
def evidence_drift(spark, sf_dir):
    """Of the files of a manifest a fifth is gone, a fifth was not listed and a fifth has a byte more."""
    files = _bare(V.read_evidence(spark, _written(spark, sf_dir)))
    part = F.regexp_extract("path", r"=(\d+)$", 1).cast("long") % 5
    store = TableStore(spark, _folder(spark, "manifests"))
    publish_manifest(store, "documents", files.where(part != 2))
    now = files.where(part != 1).withColumn("content", F.when(part == 3, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return manifest_drift(store.read("manifest"), now)


@query(f"WITH {FILES_SQL}, s AS (SELECT * FROM f WHERE strlen(text) <= {MOST}) {_hits_sql('s')} UNION ALL SELECT path, NULL, NULL, 'UNSCANNED', 'file is ' || strlen(text) || ' bytes, max is {MOST}' FROM f WHERE strlen(text) > {MOST}")
def evidence_scan(spark, sf_dir):
    files = V.explode_archives(V.read_evidence(spark, _written(spark, sf_dir), MOST))
    return _bare(V.scan_evidence(files, NAMES, (TOKEN,), (LITERAL,)))


def _archive(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of at most 20 documents; of ten archives one is cut in half and one has a wrong checksum."""
    rows, out = rows.sort_values("doc_id"), io.BytesIO()
    number = int(rows["archive"].iloc[0])
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if number % 2 else zipfile.ZIP_STORED) as z:
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            z.writestr(f"{doc_id}.{'txt' if doc_id % 2 else 'bin'}", text)
    content = bytearray(out.getvalue())
    if number % 10 == 3:
        content = content[: len(content) // 2]
    if number % 10 == 6:
        content[z.start_dir + 16] ^= 1
    return pd.DataFrame({"path": [f"run/{number}.zip"], "content": [bytes(content)]})


def _archives(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {IN_ARCHIVE}").alias("archive"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.groupBy("archive").applyInPandas(_archive, "path string, content binary").withColumn("problem", F.lit(None).cast("string"))


ARCHIVES_SQL = f"""a AS (SELECT doc_id // {IN_ARCHIVE} AS n, 'run/' || (doc_id // {IN_ARCHIVE}) || '.zip' AS path, doc_id || CASE WHEN doc_id % 2 = 1 THEN '.txt' ELSE '.bin' END AS member, coalesce(text, '') AS text,
  doc_id % 2 = 1 AS lined, doc_id = min(doc_id) OVER (PARTITION BY doc_id // {IN_ARCHIVE}) AS first FROM documents), whole AS (SELECT * FROM a WHERE n % 10 NOT IN (3, 6))"""


@query(
    f"""WITH {ARCHIVES_SQL} SELECT path, member, CASE WHEN NOT (n % 10 = 6 AND first) THEN sha256(text) END AS sha256, CASE WHEN n % 10 = 6 AND first THEN 'wrong checksum' END AS problem FROM a WHERE n % 10 <> 3
    UNION ALL SELECT DISTINCT path, NULL, NULL, 'not a zip archive' FROM a WHERE n % 10 = 3"""
)
def archive_members(spark, sf_dir):
    return V.explode_archives(_archives(spark, sf_dir)).select("path", "member", F.sha2("content", 256).alias("sha256"), "problem")


@query(f"WITH {ARCHIVES_SQL} {_hits_sql('whole')} UNION ALL SELECT DISTINCT path, NULL, NULL, 'UNSCANNED', CASE n % 10 WHEN 3 THEN 'not a zip archive' ELSE 'wrong checksum' END FROM a WHERE n % 10 IN (3, 6)")
def archive_scan(spark, sf_dir):
    return V.scan_evidence(V.explode_archives(_archives(spark, sf_dir)), NAMES, (TOKEN,), (LITERAL,))
