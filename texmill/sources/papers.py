"""Paper sources: archives to file rows, the main file, includes and bibliographies."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texmill.functions.text import paper_id
from texmill.sources.scratch import stored

# Names of main files, best first.
MAIN_NAMES = ("main.tex", "paper.tex", "arxiv.tex", "ms.tex", "article.tex")
FILES = "paper_id string, path string, size long, content string"


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, path, content of cached archives (name: paper id and suffix)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?:\.tar)?\.gz$|\.tex$", "")
    return files.select(F.coalesce(paper_id(name), name).alias("paper_id"), "path", "content")


def _members(content: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """(kind, files) of a tar.gz, a single gz or a plain TeX file; members that leave the folder are dropped."""
    if content[:2] == b"\x1f\x8b":
        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                out = []
                for m in tar:
                    path = posixpath.normpath(m.name)
                    if m.isfile() and not path.startswith(("/", "..")):
                        out.append((path, tar.extractfile(m).read()))
                return "tar.gz", sorted(out)
        except (tarfile.TarError, EOFError, OSError):
            try:
                return "gz", [("paper.tex", gzip.decompress(content))]
            except (OSError, EOFError):
                return "unknown", []
    if b"\\documentclass"[:10] in content[:10] or b"%" in content[:10]:
        return "tex", [("paper.tex", content)]
    return "unknown", []


def extracted(found: DataFrame, strict: bool = False) -> DataFrame:
    """paper_id, archive_kind, path, size, content of every file in archives().

    Bytes that are no UTF-8 become replacement characters; strict: such a file has no content.
    """

    def decoded(data: bytes) -> str | None:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None if strict else data.decode("utf-8", "replace")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, raw in zip(frame.paper_id, frame.content, strict=True):
                kind, files = _members(bytes(raw))
                rows += [(p, kind, path, len(data), decoded(data)) for path, data in files]
            yield pd.DataFrame(rows, columns=["paper_id", "archive_kind", "path", "size", "content"])

    return found.select("paper_id", "content").mapInPandas(run, "paper_id string, archive_kind string, path string, size long, content string")


def members(found: DataFrame) -> DataFrame:
    """paper_id, path, data of every file in archives(), as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, path, data) for p, raw in zip(frame.paper_id, frame.content, strict=True) for path, data in _members(bytes(raw))[1]]
            yield pd.DataFrame(rows, columns=["paper_id", "path", "data"])

    return found.select("paper_id", "content").mapInPandas(run, "paper_id string, path string, data binary")


def main_files(files: DataFrame, names: tuple[str, ...] = MAIN_NAMES, whole: bool = False) -> DataFrame:
    """paper_id, path, method: a file of a main name (best first), else the first with a document class, else the largest.

    A document class counts within the first 5000 characters, without comments. whole: it counts anywhere, comments
    too, and the last resort is the first file, as surveys of many papers do it.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    by_name = F.array_position(F.array(*map(F.lit, names)), name)
    head = F.col("content") if whole else F.regexp_replace(F.left("content", F.lit(5000)), r"(?dm)(?<!\\)%.*$", "")
    rank = F.when(by_name > 0, 0).when(F.contains(head, F.lit("\\documentclass")), 1).otherwise(2)
    rows = files.where(F.lower("path").endswith(".tex")).select("paper_id", "path", "size", by_name.alias("place"), rank.alias("rank"))
    best = Window.partitionBy("paper_id").orderBy("rank", F.when(F.col("rank") == 0, F.col("place")), F.when(F.col("rank") == 2, F.lit(0) if whole else -F.col("size")), "path")
    method = F.element_at(F.array(F.lit("name"), F.lit("documentclass"), F.lit("first" if whole else "largest")), F.col("rank") + 1)
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select("paper_id", "path", method.alias("method"))


def include_edges(files: DataFrame) -> DataFrame:
    """paper_id, parent, ord, name, child: what each file inputs or includes, resolved beside the including file.

    The name as it is wins over the name with .tex; a commented command is none; child is null if no file is there.
    """
    found = F.regexp_extract_all("content", F.lit(r"(?<!%)\\(?:input|include)\{([^}]*)\}"), F.lit(1))
    asked = files.select("paper_id", F.col("path").alias("parent"), F.posexplode(found).alias("ord", "name"))
    folder = F.regexp_extract("parent", r"^(.*/)?[^/]*$", 1)
    tried = F.array(F.struct(F.lit(0).alias("p"), F.concat(folder, F.trim("name")).alias("path")), F.struct(F.lit(1).alias("p"), F.concat(folder, F.trim("name"), F.lit(".tex")).alias("path")))
    options = asked.select("*", F.explode(tried).alias("t")).select("paper_id", "parent", "ord", "name", "t.p", "t.path")
    there = options.join(files.select("paper_id", "path"), ["paper_id", "path"]).groupBy("paper_id", "parent", "ord").agg(F.min_by("path", "p").alias("child"))
    return asked.join(there, ["paper_id", "parent", "ord"], "left")


def include_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """paper_id, path, depth (the least) of every file that a root reaches.

    Breadth first: each round takes the edges of the files found last and keeps what no round has seen, so circles
    end by themselves, however often they are asked for, and there are as many rounds as files nest.
    """
    steps = stored(edges.where("child is not null").select("paper_id", "parent", "child").distinct(), "include_edges")
    last = stored(roots.select("paper_id", "path").distinct().withColumn("depth", F.lit(0)), "include_roots")
    seen, depth = last, 0
    while True:
        depth += 1
        found = last.join(steps, (last.paper_id == steps.paper_id) & (last.path == steps.parent)).select(last.paper_id, F.col("child").alias("path")).distinct()
        last = stored(found.join(seen, ["paper_id", "path"], "left_anti").withColumn("depth", F.lit(depth)), "include_round")
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)


def flattened(files: DataFrame, mains: DataFrame) -> DataFrame:
    """paper_id, tex: each paper's main file with its includes spliced in, then its bibliography settled.

    A paper is one group: a folder of a few files. A file that is already open above is left as it was asked for.
    """
    joined = files.join(mains.select("paper_id", F.col("path").alias("main")), "paper_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import re

        held = dict(zip(frame.path, frame.content, strict=True))
        command = re.compile(r"(?<!%)\\(?:input|include)\{([^}]*)\}")

        def whole(path: str, above: tuple[str, ...]) -> str:
            folder = posixpath.dirname(path)

            def put(m) -> str:
                base = posixpath.join(folder, m[1].strip())
                child = next((posixpath.normpath(c) for c in (base, base if base.endswith(".tex") else base + ".tex") if posixpath.normpath(c) in held), None)
                return m[0] if child is None or child in above else whole(child, (*above, child))

            return command.sub(put, held[path])

        main = frame.main.iloc[0]
        folder = posixpath.dirname(main)
        text = whole(main, (main,))

        def settle(m) -> str:
            names = [n.strip() for n in m[1].split(",") if n.strip()]
            there = lambda end: any(posixpath.join(folder, n + end) in held for n in names)
            return m[0] if there(".bib") or not there(".bbl") else "\n".join(f"\\input{{{n}.bbl}}" for n in names)

        settled = re.sub(r"\\bibliography\{([^}]+)\}", settle, text)
        if settled != text:
            settled = re.sub(r"\\bibliographystyle\{[^}]+\}\n?", "", settled)
        return pd.DataFrame([(frame.paper_id.iloc[0], settled)], columns=["paper_id", "tex"])

    return joined.groupBy("paper_id").applyInPandas(run, "paper_id string, tex string")


def bibliography_decisions(commands: DataFrame, files: DataFrame) -> DataFrame:
    """id, decision (keep or input) and text, for commands (id, dir, names) against files (dir, name).

    Any .bib keeps the command; else any .bbl turns it into one input per name, those without a file too.
    """
    names = F.filter(F.transform(F.split("names", ","), lambda x: F.trim(x)), lambda x: x != "")
    asked = commands.select("id", "dir", names.alias("list")).select("id", "dir", "list", F.explode("list").alias("n"))
    seen = files.select("dir", F.col("name").alias("file"))
    tried = asked.select("id", "dir", "list", F.explode(F.array(F.struct(F.lit("bib").alias("kind"), F.concat("n", F.lit(".bib")).alias("file")), F.struct(F.lit("bbl").alias("kind"), F.concat("n", F.lit(".bbl")).alias("file")))).alias("t"))
    hit = tried.select("id", "dir", "list", "t.kind", "t.file").join(seen.withColumn("there", F.lit(True)), ["dir", "file"], "left")
    per = hit.groupBy("id", "list").agg(F.coalesce(F.bool_or(F.when(F.col("kind") == "bib", F.coalesce("there", F.lit(False)))), F.lit(False)).alias("bib"), F.coalesce(F.bool_or(F.when(F.col("kind") == "bbl", F.coalesce("there", F.lit(False)))), F.lit(False)).alias("bbl"))
    swap = ~F.col("bib") & F.col("bbl")
    inputs = F.array_join(F.transform("list", lambda n: F.concat(F.lit("\\input{"), n, F.lit(".bbl}"))), "\n")
    return per.select("id", F.when(swap, "input").otherwise("keep").alias("decision"), F.when(swap, inputs).otherwise(F.concat(F.lit("\\bibliography{"), F.array_join("list", ","), F.lit("}"))).alias("text"))


def wait_before(last: float | None, now: float, gap: float = 3.0) -> float:
    """Seconds to wait so that two requests are at least `gap` apart."""
    return 0.0 if last is None else max(0.0, gap - (now - last))


def fetch(ids: list[str], folder: str, gap: float = 3.0, opener=None) -> list[str]:
    """Download source archives that the cache folder lacks, one by one and at least `gap` seconds apart.

    Runs on the driver; a reply that is a PDF is refused and a partial file removed. Gives the paths.
    """
    import os
    import time
    import urllib.request

    opener, last, paths = opener or (lambda u: urllib.request.urlopen(u, timeout=30)), None, []
    for i in ids:
        path = os.path.join(folder, i.replace("/", "_") + ".tar.gz")
        paths.append(path)
        if os.path.exists(path):
            continue
        time.sleep(wait_before(last, time.monotonic(), gap))
        last = time.monotonic()
        try:
            with opener(f"https://arxiv.org/e-print/{i}") as reply, open(path, "wb") as out:
                if "pdf" in (reply.headers.get("Content-Type") or "").lower():
                    raise ValueError(f"{i} has no sources")
                while block := reply.read(8192):
                    out.write(block)
        except BaseException:
            if os.path.exists(path):
                os.remove(path)
            raise
    return paths


