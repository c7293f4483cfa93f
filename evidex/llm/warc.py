"""WARC archives in Zstandard: one frame per record, with a dictionary in a leading skippable frame.

An archive is the bytes of a .warc.zst file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
frame per record. The writer makes archives of a bounded size, in the tasks that hold the rows; Spark stores them as
rows of a Parquet table in the shared folder. The reader loads the dictionary from the leading frame, decodes one frame
per record, and checks the record's version line, headers, lengths and digests. It takes the same bytes from files read
with Spark's binaryFile source.

Records with equal payloads are told apart by digest in one aggregate and one join, on 32-byte digests instead of
payloads: the smallest id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, staged

MAGIC, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES, DICT_BYTES, LEAST, SAMPLE = 8 << 20, 32 << 10, 100, 400
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(content)) + content


def record(kind: str, page_id: int, url: str, digest: str, size: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """A record: version line, headers, blank line, block, two line ends. A revisit's block is empty."""
    block = b"" if kind == REVISIT else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == REVISIT:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of at most `size` bytes; empty where the samples are too few or too small."""
    import zstandard

    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes], dictionary: bytes = b"") -> bytes:
    """The bytes of a .warc.zst file."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
    return skippable(dictionary) + b"".join(map(pack.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends: its header, its blocks by their stated sizes, its checksum."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else size)
            if kind == 3 or at > len(data):
                raise WarcError("a damaged or cut-off frame")
    except IndexError as e:
        raise WarcError("a frame is cut off") from e
    return at + 4 * (flags >> 2 & 1)


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame at a time. Skippable frames between records are passed over."""
    import zstandard

    data = memoryview(archive)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise WarcError("no leading skippable frame")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise WarcError("the dictionary frame is cut off")
    content = bytes(data[8 : 8 + size])
    if content[:4] == FRAME:  # a dictionary may itself be compressed
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    at = 8 + size
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if len(magic) == 4 and magic[1:] == b"\x2a\x4d\x18" and magic[0] >> 4 == 5 and at + 8 <= len(data):
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME:
            raise WarcError("a frame of another kind")
        end = frame_end(data, at)
        if end > len(data):
            raise WarcError("a frame is cut off")
        one = reader.decompressobj()
        try:
            record_ = one.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"a damaged frame: {e}") from e
        if not one.eof:
            raise WarcError("a frame is cut off")
        yield record_
        at = end


def _agrees(digest: str, content: bytes) -> bool:
    """Whether a labelled digest (algorithm:value, in hexadecimal or base 32) is that of `content`; unknown algorithms pass."""
    algorithm, _, value = digest.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(algorithm, content).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-case names) and block, validated: version, fields, length, digests of block and payload."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith(("WARC/1.", "WARC/0.1")):
        raise WarcError("no version line or header end")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:  # a folded line goes on
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name or (name in headers and name != "warc-concurrent-to"):
            raise WarcError(f"a broken or repeated header: {line[:80]}")
        headers[name] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("the length doesn't match")
    block = rest[:-4]
    if "warc-block-digest" in headers and not _agrees(headers["warc-block-digest"], block):
        raise WarcError("the block's digest doesn't match")
    if headers["warc-type"] == RESPONSE and "warc-payload-digest" in headers and not _agrees(headers["warc-payload-digest"], payload_of(headers, block)):
        raise WarcError("the digest doesn't match")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """A record's payload: what follows the HTTP head where the block is an HTTP message, else the block."""
    if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def plan(pages: DataFrame, id: str = "page_id", body: str = "html", least: int = LEAST, row: str | None = None) -> DataFrame:
    """(id, digest, size, row, refers_to, again): of equal payloads of at least `least` bytes all but the smallest id refer
    to it. `row` names a column that tells rows apart; without one, rows are numbered here.

    Rows with a null id refer like others; where ids repeat, one row with the smallest id is the response.
    """
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = staged(pages.select(F.col(id).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"), number.alias("row")), "digests")
    first = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("low")).filter("n > 1").select("digest", "low")
    return rows.join(first, "digest", "left").select("id", "digest", "size", "row", F.when(F.col("row") != F.col("low.row"), F.col("low.id")).alias("refers_to"), (F.col("low").isNotNull() & (F.col("row") != F.col("low.row"))).alias("again"))


def write(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, dict_bytes: int = DICT_BYTES, sample: int = SAMPLE) -> DataFrame:
    """A table of archives (archive bytes, n_records) in the shared folder, one record per row of `pages`.

    Each task trains its archives' dictionary on up to `sample` of its own records. Null bodies are empty payloads.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    small = pages.select(F.col(id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    odd = not pages.groupBy(F.col(id).alias("_id")).count().filter("count > 1 OR _id IS NULL").isEmpty()
    if odd:  # rows with repeated or null ids are told apart by a number of their own, written with them
        small = staged(small.withColumn("row", F.monotonically_increasing_id()), "rows")
        marks = plan(small, "id", "payload", least, "row").select(F.col("row").alias("_row"), "digest", "refers_to", "again")
        rows = small.join(marks, small.row == F.col("_row")).select("id", "url", "payload", "digest", "refers_to", "again")
    else:
        marks = plan(pages, id, body, least).filter("again").select(F.col("id").alias("_id"), "refers_to")
        small = small.withColumn("digest", F.sha2("payload", 256))
        rows = small.join(marks, small.id == F.col("_id"), "left").select("id", "url", "payload", "digest", "refers_to", F.col("_id").isNotNull().alias("again"))
    text = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.regexp_replace("url", r"[\r\n]", " ").alias("url"), "payload", "digest", F.coalesce(F.col("refers_to").cast("string"), F.lit("")).alias("refers_to"), "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            nonlocal dictionary
            if dictionary is None:
                dictionary = train_dictionary(held[:sample], dict_bytes)
            return pa.RecordBatch.from_arrays([pa.array([write_archive(held, dictionary)], pa.binary()), pa.array([len(held)])], ["archive", "n_records"])

        for batch in batches:
            for part in slices(batch, "payload", archive_bytes):
                columns = {c: part.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to", "again")}
                for i, body in enumerate(raw(part, "payload")):
                    held.append(record(REVISIT if columns["again"][i] else RESPONSE, columns["id"][i], columns["url"][i], columns["digest"][i], len(body), body, columns["refers_to"][i]))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return staged(text.mapInArrow(run, "archive binary, n_records long"), "archives")


def read(archives: DataFrame, column: str = "archive", payload_types: tuple[str, ...] = (RESPONSE, REVISIT)) -> DataFrame:
    """One row per record of the given types: page_id, url, record_type, payload_bytes, payload_digest, refers_to, block.

    Only standard headers are needed, so archives of other writers are read as well; ids are the text of the record ids,
    without brackets and this writer's prefix. Records of other types (warcinfo, request, metadata) are validated and left
    out. A response's payload is measured and hashed here; a revisit has what its headers say: the digest in hexadecimal
    where it is a SHA-256, and a length only where one is given. What breaks the format raises WarcError. Null archives
    and empty tables give no rows.
    """

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def name(headers: dict[str, str], key: str) -> str | None:
        return headers.get(key, "").removeprefix("<").removesuffix(">").removeprefix("urn:page:") or None

    def digest(labelled: str) -> str | None:
        algorithm, _, value = labelled.partition(":")
        if algorithm.lower() == "sha256" and len(value.rstrip("=")) == 52:
            return base64.b32decode(value.upper().rstrip("=") + "====").hex()
        return value.lower() if algorithm.lower() == "sha256" else labelled or None

    def row(h: dict[str, str], block: bytes) -> tuple:
        ids = [name(h, k) for k in ("warc-record-id", "warc-refers-to")]
        if h["warc-type"] == REVISIT:
            stated = h.get("x-payload-length", "")
            return ids[0], h.get("warc-target-uri", ""), REVISIT, int(stated) if stated.isdigit() else None, digest(h.get("warc-payload-digest", "")), ids[1], block
        payload = payload_of(h, block)
        if h.get("x-payload-length", str(len(payload))) != str(len(payload)):
            raise WarcError("the payload's length doesn't match")
        return ids[0], h.get("warc-target-uri", ""), h["warc-type"], len(payload), hashlib.sha256(payload).hexdigest(), ids[1], block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(column):
                rows, size = [], 0
                for data in frames(cell.as_py()) if cell.is_valid else ():
                    h, block = parse(data)
                    if h["warc-type"] not in payload_types:
                        continue
                    rows.append(row(h, block))
                    size += len(block)
                    if size >= 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "block"], kinds)))
    return archives.select(column).mapInArrow(run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, block binary")
