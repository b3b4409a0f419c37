"""Files in the shapes of the sources, landed in a folder that all executors share, for the queries that ingest them."""

from __future__ import annotations

import re
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import landing


def land_lines(df: DataFrame, name: str, header: str | None = None, path: str | None = None) -> str:
    """Writes a one-column frame as text files, each beginning with the header."""
    path = path or landing(df.sparkSession, name)
    if header is None:
        df.write.text(path)
    else:
        column = df.columns[0]
        df.withColumnRenamed(column, header).write.option("header", "true").option("quote", "").option("sep", "\x00").csv(path)
    return path


def land_documents(df: DataFrame, name: str, folder: str | None = None) -> str:
    """Writes each row of a one-column frame as a file of its own, in the folder that another column names."""
    path = landing(df.sparkSession, name)
    df.write.partitionBy(*[folder] * (folder is not None)).option("maxRecordsPerFile", 1).text(path)
    return path


SPACES = "http://www.opengis.net/wfs/2.0 http://www.opengis.net/gml/3.2 urn:x-inspire:specification:gmlas:Addresses:3.0 urn:x-inspire:specification:gmlas:GeographicalNames:3.0 http://www.w3.org/1999/xlink urn:x".split()
ROOT = "<wfs:FeatureCollection " + " ".join(f'xmlns:{p}="{u}"' for p, u in zip("wfs gml ad gn xlink x".split(), SPACES)) + ">"


def land_members(df: DataFrame, name: str, each: int = 2000) -> str:
    """Writes a one-column frame of feature members as XML files of about so many members."""
    column = df.columns[0]
    files = df.agg((F.floor(F.count("*") / each) + 1).alias("files"))
    rows = df.crossJoin(F.broadcast(files))  # one row
    docs = rows.groupBy(F.pmod(F.xxhash64(column), "files").alias("file")).agg(F.array_join(F.collect_list(column), "\n").alias("body"))
    return land_documents(docs.select(F.concat(F.lit(ROOT), "body", F.lit("</wfs:FeatureCollection>"))), name)


def land_archives(df: DataFrame, name: str) -> str:
    """Writes a frame (member, line) as ZIP archives of text members, one archive a partition, into the shared folder."""
    path = landing(df.sparkSession, name)

    def of(batches):
        out, n = None, 0
        key = f"part-{TaskContext.get().partitionId()}"  # a task that runs again replaces its archive
        for batch in batches:
            if out is None:
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                store.create_dir(at)
                raw = store.open_output_stream(f"{at}/{key}.zip")
                out = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
            for member, lines in batch.groupby("member")["line"]:
                folder, _, file = member.rpartition("/")
                n += 1
                out.writestr(f"{folder}/{n}-{file}", "\n".join(lines) + "\n")
                yield pd.DataFrame({"n": [len(lines)]})
        if out is not None:
            out.close()
            raw.close()

    df.select("member", "line").mapInPandas(of, "n long").write.format("noop").mode("overwrite").save()
    return path
