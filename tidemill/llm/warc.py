"""WARC archives with revisit records.

``plan`` shuffles headers (id, target, digest, size) by payload digest: of equal payloads of at least ``LEAST`` bytes the one with the largest id is the
response, the others revisit it. Revisit records are made from headers alone. Bodies move only where their digest may be a repeated one (by a bitmap of fixed size);
those of revisits are dropped there, all others go from the scan into the archive. ``write`` writes WARC/1.1 records with fresh headers through Spark's own
writer, so any file system works, as gzip files of about ``FILE_BYTES`` of payload; ``read`` streams them and cuts records by their declared lengths, so payloads may hold anything
and a worker holds one record and one batch at a time; ``resolve`` joins
revisits of archives (not only of those written here) to the response that they name.

Defined results: null payload is the empty one; null ids and targets are written as empty and read back as null; equal rows are separate
records; rows that share the response's id and payload are responses too; line ends in targets are escaped; an empty
table gives no record. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import join_hot, lean, likely, scratch_path, ship, stage

LEAST = 1000
#: Bytes of payload in a file, on average; rows of revisits that meet one copy of a response.
FILE_BYTES, SALT_ROWS = 256 << 20, 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    heads = rows.drop("payload").filter(F.col("payload_bytes") >= least)
    originals = stage(heads.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null"), "originals")
    repeated = stage(likely(heads, originals, "payload_digest"), "heads")
    resolved = join_hot(repeated, originals, "payload_digest", "n", repeated.count()).filter(~F.col("page_id").eqNullSafe(F.col("original")))
    revisits = stage(resolved.select("page_id", "url", "payload_bytes", "payload_digest", F.col("original").alias("refers_to")), "revisits")
    gone = revisits.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).distinct()
    moved = likely(rows, originals, "payload_digest").join(gone, (F.col("payload_digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left_anti")
    responses = likely(rows, originals, "payload_digest", others=True).unionByName(moved).withColumn("refers_to", F.lit(None).cast("long"))
    return responses.unionByName(revisits, allowMissingColumns=True)


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    out = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")) for k, v in pairs]
    return F.concat(*out)


def records(planned: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One string for each record, without the two line ends that close it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", name("page_id")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))),
        F.when(revisit, _lines(("WARC-Profile", PROFILE), ("WARC-Refers-To", name("refers_to")))).otherwise(""),
        _lines(("Content-Type", "application/http; msgtype=response"), ("Content-Length", size.cast("string"))),
        F.lit("\r\n"),
    )
    return planned.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write(planned: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    size = planned.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("refers_to").isNull(), F.col("payload_bytes"))), F.lit(0))).first()
    most = max(1, int(file_bytes * size[0] // max(1, size[1])))
    records(planned).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def _number(name: str | None) -> int | None:
    inner = (name or "").strip("<>").rpartition(":")[2]
    return int(inner) if inner.lstrip("-").isdigit() else None


def _record(head: bytes, block: bytes) -> tuple:
    """(page_id, url, type, digest, payload length, refers_to, payload or None) of one record."""
    told = _fields(head)
    http, _, payload = block.partition(END.encode())
    digest = told["warc-payload-digest"].partition(":")[2]
    whole = told["warc-type"] == "response"
    if whole and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {told['warc-record-id']} has another digest")
    return _number(told["warc-record-id"]), told["warc-target-uri"] or None, told["warc-type"], digest, int(_fields(http)["content-length"]), _number(told.get("warc-refers-to")), payload if whole else None


def parse(parts: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """Records of archives given as (file, bytes up to the next double line end), in order. Payloads may end in line ends, so records are cut by length alone."""
    end = END.encode()
    held, have, need, at = [], 0, None, None

    def closed() -> None:
        if need is not None or b"".join(held) not in (b"", end):  # the last bytes of a file need not be followed by a double line end
            raise ValueError(f"{at} ends within a record")

    for name, part in parts:
        if name != at:
            closed()
            held, have, at = [], 0, name
        held.append(part + end)
        have += len(held[-1])
        while have:
            if need is None:
                held = [b"".join(held)]
                cut = held[0].find(end)
                if cut <= 0:
                    break
                if not held[0].startswith(b"WARC/"):
                    raise ValueError(f"{name} goes on with no record")
                start = cut + len(end)
                need = start + int(_fields(held[0][:cut])["content-length"])
            if have < need + len(end):
                break
            data = b"".join(held)
            if data[need : need + len(end)] != end:
                raise ValueError(f"a record of {name} doesn't end where it says")
            yield _record(data[: start - len(end)], data[start:need])
            held, have, need = [data[need + len(end) :]], have - need - len(end), None
    closed()


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under a path; a file is streamed by one task, since gzip isn't split."""
    ship(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

        found, size = [], 0
        for r in parse((f, bytes(v)) for part in parts for f, v in zip(part["file"], part["value"], strict=True)):
            found.append(r if payloads else (*r[:6], None))
            size += len(found[-1][6] or b"") + 200
            if size > 1 << 22:
                yield frame(found)
                found, size = [], 0
        if found:
            yield frame(found)

    lines = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInPandas(lean(work), RECORD).withColumn("payload", F.col("payload").cast("string"))


def resolve(found: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record with what its response says: revisits get payload (if asked for), its length and digest from the response with their digest and the id they refer to.
    Responses that many revisits name are repeated for every ``SALT_ROWS`` of these, so none of them is a hot key. ``found`` is read several times."""
    named = F.col("record_type") == "revisit"
    key = lambda c: F.concat_ws(" ", "payload_digest", F.col(c).cast("string"))
    revisits = found.filter(named).withColumn("key", key("refers_to"))
    facts = stage(revisits.groupBy("key").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SALT_ROWS)), "named")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = ["payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    originals = found.filter(~named).withColumn("key", key("page_id")).join(facts.select("key", "salts"), "key")
    originals = originals.groupBy("key", "salts").agg(*[F.first(c).alias(f"o_{c}") for c in told])
    originals = originals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    salted = join_hot(revisits, facts, "key", "n", total).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.col("salts")))
    joined = salted.join(originals, ["key", "salt"], "left")
    joined = joined.withColumns({c: F.coalesce(f"o_{c}", c) for c in told}).select(*found.columns)
    return found.filter(~named).unionByName(joined)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages to the shared folder, reads their records back and resolves the revisits, without payloads."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(plan(pages), path)
    found = stage(read(spark, path, payloads=False).drop("payload"), "records")
    return resolve(found, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


REVISIT_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest from p),
o as (select payload_digest, max(page_id) as original from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, d.payload_digest, case when original is null or original = page_id then 'response' else 'revisit' end as record_type,
       case when original <> page_id then original end as refers_to
from d left join o on d.payload_digest = o.payload_digest
"""
