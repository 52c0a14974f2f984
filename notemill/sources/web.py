"""Pages and decks fetched by the executors (SRC-1, SRC-2, SRC-12).

Addresses are rows, so many are fetched side by side; the number of partitions is how many at once. Only addresses of allowed hosts leave the JVM. Whatever goes wrong on the way (no connection, a status other than
2xx, a timeout, too long an answer) is one error in its row and never fails the task. Write the result before it is used twice, as each action fetches anew.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import allowed_host
from notemill.operators.extract import as_json_lines, resolve
from notemill.sources.files import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

NOT_ALLOWED, NOT_FETCHED = "host not allowed", "could not be fetched"
CHARSETS = ("ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE")
AGENT, TIMEOUT_S, MOST_BYTES = "Mozilla/5.0 (compatible; notemill)", 30.0, 256 << 20


def fetched(urls: DataFrame, hosts: tuple[str, ...] | None, url: str = "url", agent: str = AGENT, timeout_s: float = TIMEOUT_S, most_bytes: int = MOST_BYTES) -> DataFrame:
    """urls with content (bytes), status, charset and error; content is null where there is an error. hosts None allows any. A null address isn't allowed."""
    names = urls.columns
    ok = F.lit(True) if hosts is None else allowed_host(F.col(url), hosts)
    rows = urls.withColumn("__go", F.when(F.coalesce(ok, F.lit(False)) & F.col(url).isNotNull(), F.col(url)))
    kinds = {"content": pa.binary(), "status": pa.int32(), "charset": pa.string(), "error": pa.string()}

    def get(address: str) -> tuple[bytes | None, int | None, str | None, str | None]:
        from http.client import HTTPException
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(address, headers={"User-Agent": agent}), timeout=timeout_s) as answer:  # noqa: S310  the host was allowed
                data = answer.read(most_bytes + 1)
                if len(data) > most_bytes:
                    return None, answer.status, None, NOT_FETCHED
                return data, answer.status, answer.headers.get_content_charset(), None
        except HTTPError as e:
            return None, e.code, None, NOT_FETCHED
        except (OSError, ValueError, HTTPException):
            return None, None, None, NOT_FETCHED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, address in enumerate(batch.column("__go").to_pylist()):  # one row at a time: an answer may be long
                got = get(address) if address is not None else (None, None, None, NOT_ALLOWED)
                own = [batch.column(c).slice(i, 1) for c in names]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([v], t) for v, t in zip(got, kinds.values(), strict=True))], names=[*names, *kinds])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields) + ", content binary, status int, charset string, error string"
    return rows.mapInArrow(run, schema)


def fetched_html(urls: DataFrame, hosts: tuple[str, ...] | None, url: str = "url", **how: object) -> DataFrame:
    """SRC-1: urls with html, status and error; bytes are read in the charset that the answer names, else as UTF-8."""
    rows = fetched(urls, hosts, url, **how)
    html = F.col("content").cast("string")
    for charset in CHARSETS:
        html = F.when(F.upper("charset") == charset, F.decode("content", charset)).otherwise(html)
    return rows.withColumn("html", html).drop("content", "charset")


def fetched_decks(urls: DataFrame, hosts: tuple[str, ...] | None = None, url: str = "pdf_url", **how: object) -> DataFrame:
    """SRC-2: urls with content (bytes) and is_pdf; both null where a deck can't be fetched or has no address, which is never an error."""
    rows = fetched(urls, hosts, url, **how).drop("status", "charset", "error")
    return rows.withColumn("is_pdf", F.hex(F.substring("content", 1, 4)) == "25504446")


def scraped(urls: DataFrame, hosts: tuple[str, ...] | None, url: str = "url", **how: object) -> DataFrame:
    """SRC-12: one JSON object for each address: the note's fields as of extract.resolve(), or only its address and the error that kept it from being fetched or read."""
    rows = kept(fetched_html(urls.select(F.col(url).alias("url")), hosts, **how))  # asked once, read twice
    notes = resolve(rows.where("error IS NULL").select("url", "html"))
    failed = rows.where("error IS NOT NULL").select("url", "error")
    return as_json_lines(notes).unionByName(as_json_lines(failed))
